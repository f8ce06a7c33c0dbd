"""Every operator against a plain version of its contract, on a small table of odd documents and on the given tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storygraph.llm import bpe, bytes_dedup, language_id, line_dedup, mixing, near_dedup, pii, quality, queries, top_k, word_dedup
from storygraph.llm.common import WordHashes, rolling
from storygraph.llm.components import components
from tests.compare import duck, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, ids int, _k1 string"
WORD = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_texts():
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)]
    words = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    base = words(60)
    near = base.split()
    near[3] = "changed"
    long = words(3000)
    return [
        base, " ".join(near), base, None, "", " \t\n", "one", "Ünïcode ßtraße ÆØÅ 漢字 " * 9, "a" * 5000, long, long[:4000] + words(200), words(40) + "\n" + base + "\nSame Line\n same line \n",
        "\n\n\n", "the end <|endoftext|> Σ ΑΣ 's", "x\x1cy\x85z w", base.upper(), *["Common line\n" + words(30) for _ in range(12)], "spam spam spam spam " * 20, "\u0000 nul",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """With names that clash with the operators' own, null ids, repeated ids and repeated rows."""
    texts = odd_texts()
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], 0, -1, "x", 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odder(spark, odd):
    again = odd.filter("doc_id IN (0, 9, 16)")
    return odd.unionByName(again).unionByName(again.withColumn("text", F.lit("other text of that id"))).unionByName(again.withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "bpe": bpe.encoded, "quality": quality.judged, "quality kept": quality.kept, "words": word_dedup.deduplicated, "near": near_dedup.linked, "near kept": near_dedup.kept,
    "language": lambda d: language_id.predict(d, *language_id.learn(d)), "mixing": mixing.taken, "mixed": mixing.mixed, "pii": lambda d: pii.pseudonymized(d, "a key"), "bytes": bytes_dedup.deduplicated, "lines": line_dedup.clean,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeats_do_not_break(odder, name):
    n = OPERATORS[name](odder).count()
    assert n == odder.count() or name in ("quality kept", "near kept", "mixed")


def test_bpe(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encoded(odd).collect():
        e = t.encode(r["text"] or "", add_special_tokens=False)
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.ids and r["n_tokens"] == len(e.ids)
        assert r["decoded"] == t.decode(e.ids, skip_special_tokens=False)


def test_bpe_columns_and_random_strings(spark):
    from tokenizers import Tokenizer

    t, own, rnd = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.load(bpe.default_path())), random.Random(1)
    pool = list("abcdeXYZ  \n\t\x0b\x1c\x85 éÉßΣσİıK①½漢字ﬁ'sStT!.<|​😀") + ["<|endoftext|>", "'re"]
    for _ in range(2000):
        s = "".join(rnd.choices(pool, k=rnd.randint(0, 25)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    b = bpe.Bpe(spark)
    r = spark.createDataFrame([("hello world",), ("",)], "text string").withColumn("ids", b.encode(F.col("text"))).select(bpe.unpacked(F.col("ids")).alias("u"), b.decode(F.col("ids")).alias("d")).collect()
    assert [(x["u"], x["d"]) for x in r] == [(t.encode("hello world", add_special_tokens=False).ids, "hello</w> world</w>"), ([], "")]


def test_quality_base(odd):
    texts = dict(enumerate(odd_texts()))
    for r in quality.judged(odd).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(WORD, t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_verdict(spark, data):
    """Labelled documents: what is clean stays, what isn't goes."""
    big = data.replace("0.001", "0.01")
    r = queries.QUERIES["op2_quality"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(x["kept"] for x in r if x["quality"] == 1)
    bad = [x["kept"] for x in r if x["quality"] == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_quality_of_small_sources(spark):
    """A source's usual documents are kept and its own outlier is not, whatever other sources its language has; no verdict jumps at a size."""
    rng = random.Random(3)

    def doc(word, n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(word, word / 5))))) for _ in range(n))

    def source(name, word, n):
        return [("xx", name, "usual", doc(word, rng.randint(80, 160))) for _ in range(n)]

    rows = source("hot", 5, 400) + source("even", 12, 90) + source("odd", 12, 99) + source("more", 12, 101) + source("few", 12, 8) + source("one", 12, 1)
    rows += [("xx", f"tail{i}", "usual", doc(5, rng.randint(80, 160))) for i in range(60)]
    rows += [("xx", s, "outlier", doc(3, 120)) for s in ("even", "odd", "more")]
    got = quality.judged(spark.createDataFrame(rows, "lang string, source string, kind string, text string")).collect()
    assert not [(r["source"], r["d2"]) for r in got if r["kind"] == "usual" and not r["kept"]]
    assert [r["d2"] for r in got if r["kind"] == "outlier" and r["kept"]] == []


def test_quality_estimate_by_hand(spark):
    """One concentration-step estimate of a normal cloud with outliers is close to the cloud's own mean."""
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal([5, 1.6, 0, 0, 0], [0.9, 0.05, 0.2, 0.4, 0.4], (900, 5)), rnd.normal(9, 0.1, (250, 5))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{c} double" for c in quality.X))
    e = quality.estimates(rows)
    mean = e.first()
    assert np.allclose([mean[f"m{i}"] for i in range(5)], [5, 1.6, 0, 0, 0], atol=0.15)
    far = quality.distance(rows, e).select("x_words", "d2").collect()
    assert all(r["d2"] > quality.CUTOFF for r in far if r["x_words"] > 8.5)


def test_quality_least_determinant(spark):
    """Two clouds: from the medians alone, steps may end between them; the determinant found is about as small as that of a plain search
    from many starts, and smaller halves are never preferred to it."""
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal([5, 1.6, 0.5, 0.4, 0.3], [0.9, 0.2, 0.3, 0.4, 0.4], (420, 5)), rnd.normal([8, 2.5, 2, 3, 3], [0.9, 0.2, 0.5, 0.6, 0.6], (380, 5))])
    floor, h = np.diag(np.square(list(quality.FLOOR.values()))), len(x) // 2 + 1

    def scatter(part):
        return np.cov(part.T, bias=True) * quality.SHORT_HALF + floor

    def search(part):
        for _ in range(30):
            d = part.mean(0)
            z = x - d
            part = x[np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(scatter(part)), z))[:h]]
        return part

    best = min((search(x[rnd.choice(len(x), 12, replace=False)]) for _ in range(40)), key=lambda p: np.linalg.det(scatter(p)))
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{c} double" for c in quality.X))
    seen = []
    whole = quality._estimate
    quality._estimate = lambda *a: seen.append(whole(*a)) or seen[-1]
    try:
        quality.estimates(rows)
    finally:
        quality._estimate = whole
    found = min((r for r in seen[-2].collect()), key=lambda r: r["det"])  # the last step; what follows is reweighted
    assert found["det"] <= 1.02 * np.linalg.det(scatter(best))
    assert np.allclose([found[f"m{i}"] for i in range(5)], best.mean(0), atol=0.02)


def brute_runs(seqs, win):
    seen, out = set(), {}
    for i in sorted(seqs):
        s = seqs[i]
        mark = bytearray(len(s))
        for p in range(len(s) - win + 1):
            k = tuple(s[p : p + win])
            if k in seen:
                mark[p : p + win] = b"\1" * win
            seen.add(k)
        out[i] = mark
    return out


def test_word_dedup(odd):
    w = {i: (t or "").encode().split() for i, t in enumerate(odd_texts())}
    w = {i: re.findall(WORD.encode(), (t or "").encode()) for i, t in enumerate(odd_texts())}
    gone = brute_runs(w, word_dedup.WIN)
    for r in word_dedup.deduplicated(odd).collect():
        i = r["doc_id"]
        assert (r["n_words"], r["n_removed"]) == (len(w[i]), sum(gone[i]))
        assert r["kept"].encode() == b" ".join(x for x, g in zip(w[i], gone[i], strict=True) if not g)


def test_byte_dedup(odd):
    b = {i: (t or "").encode() for i, t in enumerate(odd_texts())}
    gone = brute_runs(b, bytes_dedup.LENGTH)
    for r in bytes_dedup.deduplicated(odd).collect():
        i = r["doc_id"]
        kept = bytes(x for x, g in zip(b[i], gone[i], strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone[i]) if g and (j == 0 or not gone[i][j - 1]))
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == (len(b[i]), len(b[i]) - len(kept), runs, kept)


def test_long_documents_are_cut_in_slices(spark, monkeypatch):
    from storygraph.llm import repeats

    parts = list(repeats.slices(lambda i: np.arange(250, dtype=np.uint64), 2, 20))
    assert len(parts) == 1
    monkeypatch.setattr(repeats, "SLICE", 100)
    parts = list(repeats.slices(lambda i: np.arange(250, dtype=np.uint64), 2, 20))
    assert [p.bases.tolist() for p in parts] == [[0], [100], [200], [0], [100], [200]]
    starts = [(d, q) for p in parts for d, q in zip(*(x.tolist() for x in p.place(np.flatnonzero(p.starts_of(20)))), strict=True)]
    assert starts == [(d, q) for d in range(2) for q in range(231)]


def test_repeated_ids_are_documents_of_their_own(odder):
    by = collections.defaultdict(list)
    for r in word_dedup.deduplicated(odder).collect():
        by[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert sorted(by[0]) == [(5, 0), (60, 0), (60, 60)]


def test_near_dedup(odd):
    sets = {}
    for i, t in enumerate(odd_texts()):
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for r in near_dedup.linked(odd).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root[i], root[i] == i)


def test_near_dedup_of_a_star(spark):
    """Copies that are all near one text but not near each other, and a chain: links are found past the hub."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(100, " ".join(base))]
    for c in range(40):
        w = list(base)
        for k in rnd.sample(range(150), 2):
            w[k] = f"c{c}_{k}"
        rows.append((c, " ".join(w)))
    chain = [f"d{i}" for i in range(150)]
    for c in range(12):
        chain[c * 11] = f"e{c}"
        rows.append((200 + c, " ".join(chain)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(40)} | {got[100]} == {0}
    assert {got[200 + c] for c in range(12)} == {200}


def two_words_changed(n, seed=7):
    """n copies of a text of 150 words, which is none of them, each with two words changed: most are just not similar enough to be linked."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        w = [f"b{i}" for i in range(150)]
        for k in rnd.sample(range(150), 2):
            w[k] = f"c{c}x{k}"
        rows.append((c, " ".join(w)))
    return rows


def least_of_components(texts):
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts}
    root, links = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, links


def test_near_dedup_just_below_the_threshold(spark, monkeypatch):
    """Components are those of brute force, and few pairs are compared for each link: most of all pairs have MATCH collisions."""
    met = []
    candidates = near_dedup.candidates
    monkeypatch.setattr(near_dedup, "candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    rows = two_words_changed(600)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, links = least_of_components(rows)
    assert got == want and links > 100
    assert met[0].select("u", "v").distinct().count() <= min(600 * 599 / 2 / 8, 30 * links)


def test_near_dedup_of_far_copies_of_a_text(spark, monkeypatch):
    """Copies that differ from a text that is among them, too much for a link: the pairs compared grow with the copies, not their square."""
    met = []
    candidates = near_dedup.candidates
    monkeypatch.setattr(near_dedup, "candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    for n in (150, 600):
        rnd = random.Random(n)
        base = [f"b{i}" for i in range(150)]
        rows = [(0, " ".join(base))]
        for c in range(1, n):
            w = list(base)
            for k in rnd.sample(range(0, 150, 5), 3):
                w[k] = f"c{c}x{k}"
            rows.append((c, " ".join(w)))
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == least_of_components(rows)[0]
    assert met[1].count() <= 20 * 600


def test_near_dedup_keeps_a_row_of_each_text(spark):
    """Ids that repeat with other texts: no text is lost, every row that goes has a row of its group that stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, 0), (1, b, 1), (2, b, 2), (3, c, 3), (3, c, 4), (None, c, 5), (4, None, 6), (4, "", 7), (4, " ", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["root"]) for r in near_dedup.kept(docs).collect()), key=str)
    assert [x[:2] for x in got if x[1].strip()] == [(0, c), (1, a), (1, b), (3, c)]
    assert sorted(x[2] for x in got if not x[1].strip()) == [6, 7, 8, 9]
    again = sorted(((r["doc_id"] or 0, r["text"] or "", r["root"]) for r in near_dedup.kept(docs.repartition(3)).collect()), key=str)
    assert got == again


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language_id.op5_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    names, f = language_id.learn(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the of and that")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(odd, names, f).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]


def test_more_than_64_languages(spark):
    """70 languages with alphabets of their own, and the filter against exact sets of n-grams."""
    rnd = random.Random(4)

    def text(k):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        return " ".join("".join(rnd.choices(letters, k=4)) for _ in range(20))

    rows = [(12 * k + i, text(k), f"l{k:02}") for k in range(70) for i in range(12)]
    names, f = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(names) == 70 and f.shape[1] == 2
    held = spark.createDataFrame([(k, text(k)) for k in range(70)], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(held, names, f).orderBy("doc_id").collect()] == names
    learned = collections.defaultdict(set)
    for _, t, lang in rows:
        for g in set(language_id.grams(t).tolist()):
            learned[lang, g].add(t)
    least = 12 * language_id.LEAST_SHARE
    for k in (0, 63, 64, 69):
        h = language_id.grams(rows[12 * k][1])
        masks = f[language_id.slots(h)[0]] & f[language_id.slots(h)[1]] & f[language_id.slots(h)[2]]
        exact = [len(learned[names[k], g]) >= least for g in h.tolist()]
        got = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        assert all(b for a, b in zip(exact, got, strict=True) if a)


def water(sizes):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        sizes = {s: rnd.choice([0, 1, 5, 1000, 30000]) for s in ["a", "b", "B", "é", None, "z", "zz"]}
        got = mixing.with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water(sizes)
        for r in got:
            assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])


def test_mixing(spark, odder, data):
    for docs in (odder, spark.read.parquet(f"{data}/documents.parquet")):
        rows = mixing.taken(docs).collect()
        again = mixing.taken(docs.repartition(5)).collect()
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
        assert [key(r) for r in sorted(rows, key=key)] == [key(r) for r in sorted(again, key=key)]
        assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
        for s, rs in by.items():
            assert sum(r["size"] for r in rs) == rs[0]["source_size"]
            assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5 + 1e-6, s
        assert sum(r["taken"] for r in rows) == sum(len(re.findall(WORD, r["text"] or "")) for r in mixing.mixed(docs).select("text").collect())


def test_mix_shuffles_texts_once(spark, data, capsys):
    """Texts went through two shuffles, in each of them twice: as a column and within the whole row."""
    mixing.mixed(spark.read.parquet(f"{data}/documents.parquet")).explain("formatted")
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    dealt = [x for x in dealt if "_doc#" in x or "text#" in x]
    assert len(dealt) == 1 and "text#" not in dealt[0]


def test_mix_of_rows_that_repeat(spark, odder):
    """Of rows alike in doc_id, source and text each has its own other columns; each document has the words that taken() says."""
    rows = [(i, f"one text {i} \n of some  words", "en", "a", 0, j, "x", 5, "k") for i in (0, None, 7) for j in range(4)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(rows)  # one source alone is taken whole, once
    words = lambda rows: collections.Counter({k: n for k, n in rows.items() if n})
    want, have = collections.Counter(), collections.Counter()
    for r in mixing.taken(odder).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    for r in mixing.mixed(odder).collect():
        have[r["doc_id"], r["source"]] += len(re.findall(WORD, r["text"] or ""))
    assert words(want) == words(have)


def test_shards_of_the_mix(spark):
    """Slots of a source are spread over shards as multinomial draws are, also where some were dropped or made up; blocks by epoch once."""
    sources = spark.createDataFrame([("a", 512 * 9000 + 100), ("b", 512 * 2000), ("c", 300)], "source string, source_size long")
    made = mixing.with_blocks(mixing.with_targets(sources, (1, 5, 2)))
    rows, made = mixing.plan(made).collect(), {r["sid"]: r for r in made.collect()}
    by = collections.Counter((r["sid"], r["shard"]) for r in rows)
    n_shards = max(s for _, s in by) + 1
    for sid in (0, 1):
        counts = np.array([by[sid, k] for k in range(n_shards - 1)])
        assert len(counts) >= 8 and counts.min() > 0.8 * counts.mean() and counts.max() < 1.2 * counts.mean()
    for sid, m in made.items():
        own = [r for r in rows if r["sid"] == sid]
        assert len(own) == m["quota"] and len({(r["epoch"], r["block"]) for r in own}) == len(own)
        assert all(0 <= r["block"] < m["n_slots"] for r in own) and sum(r["cut"] is not None for r in own) == (m["part"] > 0)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


PII = [
    (1, "Mail a.b@ex.com or A.B@EX.com; card 4111 1111 1111 1111, 4111-1111-1111-1111, not 4111111111111112."),
    (2, "Mrs. Anna Smith met Mr Smith; call +1 (212) 555-0100 from 10.20.30.40 with token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\""),
    (3, "a.b@ex.com 10.20.30.40 Mrs Anna Smith, госпожа Иванова"),
    (4, None),
    (5, ""),
    (6, "nothing here but 3.14 and 1999-2001"),
]


def test_pii(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymized(docs, "a key").collect()}
    text = {i: r["text"] for i, r in got.items()}
    assert text[4] is None and text[5] == "" and text[6] == PII[5][1]
    for secret in ("a.b@ex", "4111 1111", "4111-1111", "Anna", "Smith", "555-0100", "10.20.30.40", "0a1b2c3d", "Иванова"):
        assert secret.lower() not in "".join(t or "" for t in text.values()).lower()
    assert "4111111111111112" in text[1]
    mails = re.findall(r"\S+@\S+\.com", text[1] + " " + text[3], re.I)
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and mails[1].split("@")[0].isupper()
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", text[1])]
    assert len(set(cards)) == 1 and len(cards) == 2
    digits = [int(c) for c in reversed(cards[0])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[2]) and re.search(r'token = "[0-9a-f]{40}"', text[2])
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", text[2] + text[3]))) == 1
    assert re.search(r"госпожа \p{L}+".replace(r"\p{L}", "[а-яА-Я]"), text[3])
    first = re.search(r"Mrs\.? (\w+ \w+)", text[2])[1]
    assert first == re.search(r"Mrs\.? (\w+ \w+)", text[3])[1] and first.split()[0] in pii.GIVEN["latin", "f"]


def test_pii_collisions(spark):
    """Three-letter mails leave few surrogates: all stay distinct, and none is a real one."""
    real = [f"{a}@{b}.io" for a in "abcdefgh" for b in "xyzw"]
    rows = spark.createDataFrame([("email", m) for m in real], "kind string, norm string")
    values = [r["value"] for r in pii.surrogates(rows, "a key").collect()]
    assert len(set(values)) == len(real) and not set(values) & set(real)


def test_pii_more_entities_than_short_surrogates(spark):
    """All one-letter mails, all values of a secret with one digit, 20,000 surnames and an address without letters: longer surrogates are drawn."""
    names = [("name", f"m {''.join(chr(97 + i // 26**k % 26) for k in range(4))}") for i in range(20000)]
    mails = [("email", f"{chr(97 + i)}@{chr(97 + j)}.com") for i in range(26) for j in range(26)]
    rows = names + mails + [("secret", f"{i}_______") for i in range(10)] + [("email", "%@-.-")]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "a key").collect()
    real = {(k, n.removeprefix("m ")) for k, n in rows}
    values = {(r["kind"], r["value"].lower()) for r in got}
    assert len(got) == len(rows) == len(values) and not values & real


def test_pii_longer_surrogates_in_texts(spark):
    """All mails and secrets of a short form: each is replaced by one of its own, in all its spellings."""
    texts = [f"write to {chr(97 + i)}@{chr(97 + j)}.de or {chr(65 + i)}@{chr(97 + j)}.de, token: {i % 10}_______" for i in range(26) for j in range(26)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [re.fullmatch(r"write to (\S+@\w\.de) or (\S+@\w\.de), token: (\w+)", r["text"]).groups() for r in pii.pseudonymized(docs, "a key").orderBy("doc_id").collect()]
    assert all(a == b.lower() for a, b, _ in got) and len({a for a, _, _ in got}) == 676 and not {a for a, _, _ in got} & {t.split()[2] for t in texts}
    assert len({c for _, _, c in got}) == 10 and not {c for _, _, c in got} & {f"{i}_______" for i in range(10)}


def test_pii_names_of_one_document(spark):
    """One surname with and without its given name, mentions without a title, titles of no gender, scripts; a key of one's own."""
    texts = [
        "Mr John Smith met us. John Smith left. Mr Smith too; John Smithson stays.",
        "Mr Κώστας Παππάς and Dr Иванов and Frau Müller-Schmidt and Prof. Ada Byron, Ada Byron",
        "Mr John Smith again",
        "John Smith stays where no title names him",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymized(docs, "a key").orderBy("doc_id").collect()]
    given, last = re.fullmatch(r"Mr (\w+) (\w+) met us\. \1 \2 left\. Mr \2 too; John Smithson stays\.", got[0]).groups()
    assert given in pii.GIVEN["latin", "m"] and last != "Smith" and got[2] == f"Mr {given} {last} again" and got[3] == texts[3]
    assert re.fullmatch(r"Mr [\u0370-\u03ff]+ [\u0370-\u03ff]+ and Dr [а-яА-Я]+ and Frau [A-Z][a-z]+-[A-Z][a-z]+ and Prof\. (\w+ \w+), \1", got[1])
    assert not any(w in got[1] for w in ("Παππάς", "Иванов", "Schmidt", "Byron"))
    assert got != [r["text"] for r in pii.pseudonymized(docs, "another key").orderBy("doc_id").collect()]


def test_pii_hmac(spark):
    import hmac

    for key in ("k", "ключ" * 40):
        got = spark.createDataFrame([("a|Ж",)], "s string").select(pii.hmac(key, F.col("s")).alias("h")).first()["h"]
        assert got == hmac.new(key.encode(), "a|Ж".encode(), "sha256").hexdigest()


def test_pii_placeholders_and_keys_without_digits(spark):
    key, lower, upper = "AKIA" + "BCDEFGHIJKLMNOPQ", "abcdef" * 6, "FEDCBA" * 6
    texts = ["Password: ________", "token: --------", f"the key {key} here", f"the hash {lower} here", f"the hash {upper} here", "password: 1-------"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymized(docs, "a key").collect()}
    assert [got[i]["text"] for i in (0, 1)] == texts[:2] and [got[i]["n_secret"] for i in range(6)] == [0, 0, 1, 1, 1, 1]
    assert all(s not in got[i]["text"] for i, s in ((2, key), (3, lower), (4, upper), (5, "1-------")))


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 6)).astype(np.float32)
    v[100:180] = v[100]  # ties
    v[5] = 0
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (320, []), (340, [2.0, 1.0]), (341, [1.0, 1.0])]
    got = collections.defaultdict(list)
    for r in top_k.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = np.floor(64 * v.astype(float)).astype(int)
    for q in range(0, 300, 20):
        s = x @ x[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(best)]
    assert got[340] == [(1, 341, 192 * 64)] and 300 not in got and 301 not in got


def test_lines(odder):
    docs = odder.collect()
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter(k for r in docs for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    want = collections.Counter()
    for r in docs:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 10]
        want[(r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.clean(odder).collect()) == want


def test_line_store(spark):
    """Batch by batch: unseen lines, levels that are compacted, numbers of lines that are known already; runs are not shuffled for the joins."""
    store = line_dedup.LineStore(spark, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(h, h) for h in (1, 2, 2, 10 + i)], "h1 long, h2 long")
        assert sorted({r["h1"] for r in store.unseen(batch).collect()}) == ([1, 2, 10] if i == 0 else [10 + i])
        store.add(batch)
    assert [len(x) for x in store.levels] == [1, 0, 1] and len(store.batches) == 5
    assert sorted(r["h1"] for r in store.frequent(5).collect()) == [1, 2]
    assert [r["h1"] for r in store.frequent(6).collect()] == [2]
    held = sorted(r["h1"] for name in store.runs() for r in store.run(name).collect())
    assert held == [1, 2, 10, 11, 12, 13, 14]
    plan = store.unseen(spark.table(store.batches[0]).drop("known"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    names = store.batches + store.merged
    store.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_in_many_batches(spark, odder):
    """The result is the same whatever the batches and levels."""
    want = collections.Counter(map(tuple, line_dedup.clean(odder).select("doc_id", "n_lines", "n_dropped", "text").collect()))
    got = line_dedup.clean(odder, batches=9, fanout=2).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert collections.Counter(map(tuple, got)) == want and line_dedup.batches_for(0) == 5 and line_dedup.batches_for(9 << 30) == 9


def test_scratch_is_cleared(spark):
    from storygraph.llm import common

    df = common.stored(spark.range(5), "some")
    table = common.bucketed(spark.range(5).toDF("h"), "some", ("h",))
    common.clear_scratch(spark)
    assert not spark.catalog.tableExists(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(df.inputFiles()[0] if df.inputFiles() else "file:///nowhere").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = set(docs.columns)
    seen = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, data).cache()
        seen.append((name, docs.count()))
        assert name == "BPE" or set(docs.columns) == names
    assert [n for n, _ in seen] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources", "BPE"]
    assert seen[0][1] == seen[1][1] >= seen[2][1] and seen[3][1] == seen[4][1] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in p.quality_rules(spark, spark.read.parquet(f"{data}/documents.parquet"), data).collect()}
    texts = {i: t for i, t in duck(data).sql("SELECT doc_id, text FROM documents").fetchall()}
    assert all(i in kept for i, q in labels.items() if q == 1 and i in texts and len((texts[i] or "").split()) >= 20 and quality_base(texts[i]))


def quality_base(t):
    w = re.findall(WORD, t or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w)


def test_hashes():
    h = WordHashes()
    a, b = h.of([b"a", b"b", b"c", b"d", b"e"]), h.of([b"b", b"a", b"c", b"d", b"e"])
    assert rolling(a, 5)[0] != rolling(b, 5)[0] and len(rolling(a, 6)) == 0


def test_quality_steps_are_one_job_each(spark):
    """A job for each exchange of each step filled the driver with threads and plans."""
    rows = [(f"s{i % 3}", *[float(np.sin(i * (j + 1))) + j for j in range(len(quality.X))]) for i in range(300)]
    rows = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} double" for c in quality.X)).repartition(2)
    jobs, own, plain, spans = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.shuffle.partitions"), quality._kept_apart, []

    def counted(*args):
        spark.sparkContext.setJobGroup(name := f"step-{len(spans)}", "")
        spans.append(name)
        return plain(*args)

    quality._kept_apart = counted
    try:
        quality.estimates(rows)
    finally:
        quality._kept_apart = plain
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The steps between the first estimates and the last two; each also asks whether anything is left.
    assert len(spans) > 5
    assert max(len(jobs.getJobIdsForGroup(x)) for x in spans[1:-2]) <= 3, [len(jobs.getJobIdsForGroup(x)) for x in spans]
    assert (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")) == ("true", own)
