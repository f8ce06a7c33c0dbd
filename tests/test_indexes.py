"""Postings against plain scans, trees of digests against plain comparisons; what they read."""

import os
import random
import shutil

import pytest

from storygraph.operators import analytics as A
from storygraph.operators import postings as P
from storygraph.operators import trees as T

SENTENCES = "story string, story_ord int, id string, position int, text string, bucket string"


def some_sentences(n=300, seed=3):
    rnd = random.Random(seed)
    letters = ["a", "b", "A", "é", "É", " ", "\n", "😀", "%", "_", "\\"]
    rows = [("s%d" % (i % 7), i % 7, str(i), i // 7, "".join(rnd.choices(letters, k=rnd.randint(0, 30))), "x") for i in range(n)]
    return [*rows, ("s1", 1, "none", 900, None, "x"), ("s1", 1, "empty", 901, "", "x"), ("s2", 2, "long", 902, "ab" * 1500 + "c😀d", "x")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = some_sentences()
    df = spark.createDataFrame(rows + rows[:20], SENTENCES)
    path = str(tmp_path_factory.mktemp("index") / "i")
    P.build(df, path)
    return rows, P.Index(spark, path)


def test_phrases_like_a_scan(indexed):
    rows, index = indexed
    rnd = random.Random(9)
    phrases = ["a", "é", "ab", "😀", "c😀d", "zz", "zzz", "abz", "bab", "aaaa", "\\", "%", "_", " \n", "ab" * 12, "b" + "ab" * 30, "babc😀d"]
    for _ in range(25):
        t = rnd.choice(rows[:300])[4].lower()
        i = rnd.randint(0, max(len(t) - 1, 0))
        phrases.append(t[i : i + rnd.randint(1, 12)] or "q")
    phrases = list(dict.fromkeys(phrases))
    got = {(r[0], r[1], r[2]) for r in index.holding(phrases).collect()}
    want = {(p, r[1], r[3]) for p in phrases for r in rows if r[4] is not None and p in r[4].lower()}
    assert got == want
    assert index.holding(phrases).count() == len(want)
    board = {r["phrase"]: r["n"] for r in index.scoreboard([*phrases, "AB", ""]).collect()}
    assert board == {p: sum(p.lower() in r[4].lower() for r in rows if r[4] is not None) for p in [*phrases, "AB", ""]}


def test_search_like_the_scan(spark, indexed):
    rows, index = indexed
    df = spark.createDataFrame(rows, SENTENCES)
    for query in ("ab", " Ba ", "a", "", "zzzz", "É", "éa", "aba"):
        assert [r["id"] for r in index.search(query, 20).collect()] == [r["id"] for r in A.search(df, query, 20).collect()], query


def test_search_reads_the_buckets_of_its_phrase_alone(spark, indexed, tmp_path):
    rows, index = indexed
    path = str(tmp_path / "copy")
    shutil.copytree(index.path, path)
    copy = P.Index(spark, path)
    wanted = {g for _, g in P.cover("c😀d")}
    keep = {r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(P._bucket(P.F.col("g"))).collect()}
    for name in ("postings", "counts"):
        for folder in os.listdir(f"{path}/{name}"):
            if folder.startswith("bucket=") and int(folder[7:]) not in keep:
                shutil.rmtree(f"{path}/{name}/{folder}")
    for folder in os.listdir(f"{path}/texts"):
        if folder.startswith("shard=") and not any("part" in f for f in os.listdir(f"{path}/texts/{folder}")):
            shutil.rmtree(f"{path}/texts/{folder}")
    assert [r["id"] for r in copy.search("C😀D").collect()] == ["long"]
    plan = copy._read("postings", ["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "gram" in plan.split("PushedFilters")[1].split("]")[0]


def test_rarest_gram_first(indexed):
    _, index = indexed
    first, second, rest = index.steps(["ababab" + "bc😀d"])
    assert first[0][1:] == (6, "bc😀", 1) or first[0][2] in ("c😀d", "bbc")
    assert len(second) == 1 and len(rest) == rest[0][3] == len(P.cover("abababbc😀d")) - 2
    assert index.steps(["ababzzzz"]) == []


def test_empty_index(spark, tmp_path):
    P.build(spark.createDataFrame([], SENTENCES), str(tmp_path / "e"))
    index = P.Index(spark, str(tmp_path / "e"))
    assert index.search("abc").count() == 0 and index.holding(["a", "abc"]).count() == 0
    assert [tuple(r) for r in index.scoreboard(["abc"]).collect()] == [("abc", 0)]
    with pytest.raises(ValueError):
        index.holding([""])


def planted(spark, tmp_path, schema, left, right, **kind):
    paths = [str(tmp_path / x) for x in "lr"]
    for rows, path in zip((left, right), paths, strict=True):
        T.plant(spark.createDataFrame(rows, schema).repartition(3), path, **kind)
    return paths


ROWS = "story string, position int, text string"


def without_rows(path, keep=()):
    for folder in os.listdir(f"{path}/rows"):
        if folder.startswith("_part=") and int(folder[6:]) not in keep:
            shutil.rmtree(f"{path}/rows/{folder}")


def test_first_difference_reads_one_leaf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "RUN", 8)
    monkeypatch.setattr(T, "PARTS", 8)
    rows = [(s, i, f"{s}{i}") for s in ("a", "b", "c", None) for i in range(700)]
    other = [(s, i, "x" if (s, i) == ("b", 555) else t) for s, i, t in rows]
    paths = planted(spark, tmp_path, ROWS, rows, other, order=["position"])
    assert [tuple(r) for r in T.leaves(spark, *paths).collect()] == [("b", 555 // 8)]
    [part] = [r[0] for r in T.leaves(spark, *paths).select(T.F.pmod(T.F.xxhash64("_group", "_node"), T.F.lit(T.PARTS))).collect()]
    for p in paths:
        without_rows(p, {part})
    got = {r["story"]: (r["first"], r["left_size"], r["right_size"]) for r in T.first_difference(spark, *paths).collect()}
    assert got == {s: (555 if s == "b" else None, 700, 700) for s in ("a", "b", "c", None)}


def test_equal_tables_read_no_rows(spark, tmp_path):
    rows = [("a", i, str(i % 5)) for i in range(100)] + [("a", 3, None)] * 4
    paths = planted(spark, tmp_path, ROWS, rows, rows[::-1], ids=["story", "position"])
    assert [r["same"] for r in T.tops(spark, *paths).collect()] == [True]
    for p in paths:
        without_rows(p)
        os.makedirs(f"{p}/rows", exist_ok=True)
    assert T.leaves(spark, *paths).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_trees_like_plain_comparisons(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(T, "RUN", 4)
    monkeypatch.setattr(T, "PARTS", 4)
    rnd = random.Random(seed)
    left = [(s, i, rnd.choice(["u", None, "w"])) for s in "abcd" for i in range(rnd.randint(0, 120))]
    right = list(left)
    for _ in range(rnd.randint(0, 6)):
        k = rnd.randrange(len(right))
        right[k : k + rnd.randint(0, 2)] = [] if rnd.random() < 0.5 else [(*right[k][:2], "new")]
    paths = planted(spark, tmp_path, ROWS, left, right, ids=["story", "position"])
    sides = [dict(((s, i), t) for s, i, t in x) for x in (left, right)]
    want = {}
    for key in {*sides[0], *sides[1]}:
        if key not in sides[0]:
            want[key] = "added"
        elif key not in sides[1]:
            want[key] = "removed"
        elif sorted(map(str, [t for s, i, t in left if (s, i) == key])) != sorted(map(str, [t for s, i, t in right if (s, i) == key])):
            want[key] = "changed"
    assert {(r[0], r[1]): r[2] for r in T.changes(spark, *paths, ["story", "position"]).collect()} == want
    uniq = sorted({(s, i): (s, i, t) for s, i, t in right}.values())
    (tmp_path / "o").mkdir()
    paths = planted(spark, tmp_path / "o", ROWS, left, uniq, order=["position"])
    for r in T.first_difference(spark, *paths).collect():
        a, b = [[x for x in side if x[0] == r["story"]] for side in (left, uniq)]
        first = next((k for k in range(max(len(a), len(b))) if a[k : k + 1] != b[k : k + 1]), None)
        assert (r["first"], r["left_size"], r["right_size"]) == (first, len(a), len(b))
