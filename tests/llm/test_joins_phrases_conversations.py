"""N-gram join, phrase collocations and conversation repair against plain versions of their contracts."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storygraph.llm import collocations, conversations, ngram_join

WORD = r"[^\x20\x09-\x0D]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_join(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(UPPER))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), components_of(sets, links).values(), strict=True)}


def near_copies(seed):
    rnd = random.Random(seed)
    words = lambda n: ["w%d" % rnd.randrange(4000) for _ in range(n)]
    texts, passage = [None, "", " \n\t", "one", "One", "a b c", "a b C", "a b c d e f g", "a b c d e f g h"], words(70)
    for size in (8, 20, 60, 150, 400):
        base = words(size)
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = "x%d" % rnd.randrange(8)
            texts.append(" ".join(t[: len(t) - rnd.randrange(3)]))
        texts += [" ".join(base)] * 5
    texts += [" ".join(words(rnd.randrange(1, 30)) + passage + words(rnd.randrange(1, 30))) for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_join(rows)


def test_join_just_below_the_threshold(spark):
    """Groups whose members all lie just below the threshold of what they are copies of; few of them are linked."""
    rnd = random.Random(5)
    base, rows = ["b%d" % i for i in range(150)], []
    for i in range(300):
        t = list(base)
        for j in rnd.sample(range(5, 145), 3):
            t[j] = "x%d" % rnd.randrange(3)
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_join(rows)


def test_join_odd_rows(spark):
    long = " ".join("w%d" % i for i in range(20_000))
    rows = [(None, "a b c d e", "x", 1), (None, "a b c d e", "x", 1), (4, "a b c d e", "x", 1), (2, "A b c d e", "x", 1), (2, "other words of that very id", "x", 1), (7, long, "x", 1), (6, long + " end", "x", 1), (8, None, "x", 1)]
    got = sorted(ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string, node string, check int")).collect(), key=str)
    want = [(None, 2, None), (None, 2, None), (4, 2, 2), (2, 2, 2), (2, 3, 2), (7, 19997, 6), (6, 19998, 6), (8, 0, 8)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_sets_that_share_a_hash_stay_apart(spark):
    """Two sets with one `node` and different checks are two classes, with a node each."""
    rows = spark.createDataFrame([(1, 3, 9, 5, [1]), (2, 3, 9, 6, [2]), (3, 3, 9, 5, [1]), (4, 3, 8, 5, [3])], "doc_id long, n_shingles long, node long, check long, lead array<long>")
    made = ngram_join.classes_of(rows).collect()
    assert len(made) == 3 == len({r["node"] for r in made}) and {(r["first"], r["check"], r["doc"]) for r in made} == {(9, 5, 1), (9, 6, 2), (8, 5, 4)}


def test_overlap_is_exact_or_below_its_bound():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rnd.integers(-(2**63), 2**63 - 1, 40)) for _ in range(2))
        b = np.unique(np.concatenate([b[: rnd.integers(0, 20)], a[rnd.permutation(len(a))[: rnd.integers(0, 40)]]]))
        c, least = len(np.intersect1d(a, b)), int(rnd.integers(0, 40))
        assert ngram_join.overlap(a, b, least) == (c if c >= least else -1)
    assert all(100 * (c := ngram_join.least_overlap(m, n)) >= 85 * (m + n - c) and 100 * (c - 1) < 85 * (m + n - c + 1) for m in range(1, 60) for n in range(1, 60))


def plain_collocations(rows, least, top):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in found.items():
            if any(100 * b >= 80 * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, words[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrases_text(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["É", "ß", "漢字", "x\x1cy", " "]
    rows = [("en", None), ("en", ""), (None, " . ,"), ("de", "a a a a a a a A a a\ta\na;a a a")]
    for i in range(300):
        t = []
        for _ in range(rnd.randrange(60)):
            t += rnd.choice([["new", "york", "city"], ["of", "the", "people", "by"], ["no", "no", "no"]]) if rnd.random() < 0.2 else [rnd.choice(vocabulary)]
        rows.append((["en", "de", None, "und"][i % 4], "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\r", "!"]) for w in t)))
    return rows


@pytest.mark.parametrize(("filter_bytes", "top"), [(collocations.FILTER, 2000), (1 << 8, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, filter_bytes, top):
    """With a filter so small that it tells nothing as well."""
    monkeypatch.setattr(collocations, "FILTER", filter_bytes)
    rows = phrases_text(3)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=6, top=top).collect())
    assert got == plain_collocations(rows, 6, top)


@pytest.mark.parametrize("most", [1 << 6, 1 << 26])
def test_collocations_whose_filter_grows_or_tells_nothing(spark, monkeypatch, most):
    """What a filter says of a phrase must not change while the phrase is counted."""
    for name, value in {"FILTER": 1 << 6, "MOST": most, "ROOM": 4, "ROOM_FIRST": 1}.items():
        monkeypatch.setattr(collocations, name, value, raising=False)
    for seed in (3, 4):
        rows = phrases_text(seed)
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
        assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain_collocations(rows, 6, 2000)


def test_collocations_read_few_other_phrases_however_many_are_frequent(spark, monkeypatch):
    """The filter starts far too small for the 1,800 frequent phrases; 24,000 others hold only frequent words."""
    monkeypatch.setattr(collocations, "FILTER", 1 << 8)
    rnd, made, plain = random.Random(5), spark.sparkContext.accumulator(0), collocations._reader
    rows = [("en", " ".join(rnd.sample(["w%d" % i for i in range(400)], 10))) for _ in range(1200)]
    rows += [("en", f"a{i} b{i} c{i}") for i in range(240) for _ in range(6)]

    def counted(*args):
        def read(batches):
            for batch in plain(*args)(batches):
                made.add(batch.num_rows)
                yield batch

        return read

    monkeypatch.setattr(collocations, "_reader", counted)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    found = collocations.frequent(docs, least=6).count()
    assert found <= made.value < 1.5 * found * collocations.SHARDS * 2


def test_collocations_read_each_phrase_once_however_many_tasks(spark, monkeypatch):
    """A row for each frequent phrase and language, not one for each task that it occurs in."""
    made, plain = spark.sparkContext.accumulator(0), collocations._reader

    def counted(*args):
        def read(batches):
            for batch in plain(*args)(batches):
                made.add(batch.num_rows)
                yield batch

        return read

    monkeypatch.setattr(collocations, "_reader", counted)
    docs = spark.createDataFrame([(["en", "de"][i % 2], f"so it goes on {i % 7}") for i in range(400)], "lang string, text string").repartition(16)
    found = collocations.frequent(docs, least=20).count()
    assert made.value == found > 20


def test_collocations_of_phrases_that_share_a_hash(spark, monkeypatch):
    """Hashes of 9 bits: many different phrases have the same, and are told apart by their words."""
    plain, whole, seen = collocations._Slice.keys, collocations._counted_by_words, []

    def short(self, length):
        key, valid = plain(self, length)
        return key >> np.uint64(55), valid

    monkeypatch.setattr(collocations, "_counted_by_words", lambda *args: seen.append(1) or whole(*args))
    rows = phrases_text(5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain_collocations(rows, 6, 2000) and not seen
    of = collocations._sliced

    def sliced(*args):
        for s in of(*args):
            s.keys = lambda length, s=s: short(s, length)
            yield s

    monkeypatch.setattr(collocations, "_sliced", sliced)
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain_collocations(rows, 6, 2000)
    assert seen


def test_collocations_cut_at_the_first_of_equal_scores(spark):
    rows = [("en", "a b c d. x a b. ")] * 7 + [("en", "y")]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 5, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, ""), ("de", "...")], "lang string, text string")).count() == 0


def test_long_text_of_one_word(spark):
    got = collocations.collocations(spark.createDataFrame([("en", "no " * 300_000)], "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "no no no no", 299_997, 300_000, 299_998, 300_000, 2000000 * 299_997 // 599_998)]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            yield from [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)


def plain_repair(rows):
    """One Dijkstra search from the start, whose labels are cost, audit and the lines so far."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, seen, fault = {r[1] for r in mine} - {None}, set(), []
        for _, _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, roles, lines = heapq.heappop(heap)
            state = (i, "s" in roles, len(roles) % 2, roles == "")
            if i == len(mine) and re.fullmatch("(s?(ua)+)?", roles):
                break
            if state in done:
                continue
            done.add(state)
            near = [(2, "I", i, c, f"{r}:") for c, r in (("u", "user"), ("a", "assistant"))]
            if i < len(mine):
                role, text = mine[i][2:]
                near.append((3, "D", i + 1, "", None))
                if fault[i] not in ("blank", "duplicate"):
                    more = fault[i] == "truncated"
                    near += [(more, "K", i + 1, role[:1], f"{role}:{text}"), (2 + more, "R", i + 1, "u", f"user:{text}"), (2 + more, "R", i + 1, "a", f"assistant:{text}")]
            for c, x, j, r, line in near:
                if x == "D" or (r and re.fullmatch("s?(ua)*u?", roles + r)):
                    heapq.heappush(heap, (cost + c, audit + x, j, roles + r, lines if line is None else (*lines, line)))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def talks(seed):
    rnd = random.Random(seed)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (-1, None, "assistant", "Yes."), (-1, None, "system", "Be good.")]
    roles, texts = ["user", "assistant", "system", "tool", "u", "", None], ["Yes.", "No!", "cut", "", " \t", "Why? ", "é.\n", None, "..", "long " * 400 + "."]
    for conv in range(60):
        n = rnd.choice([1, 2, 3, 8, 30])
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, rnd.choice(texts) if rnd.random() < 0.5 else f"text {conv} {turn}."))
    return rows + rows[10:20]


QUERY_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("piece", "fan"), [(256, 64), (3, 2)])
def test_repair_equals_brute_force(spark, tmp_path, monkeypatch, piece, fan):
    """Whole conversations, and ones cut into pieces that are joined in several levels."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = talks(piece)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in QUERY_COLUMNS) for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain_repair(rows)


def test_repair_of_nothing(spark, tmp_path):
    lost = next(t for t in range(999) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    for name, rows in (("none", []), ("dropped", [(7, lost, "user", "Hi.")])):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/{name}/conversations.parquet")
        got = [tuple(r) for r in conversations.op13_conversation_repair(spark, f"{tmp_path}/{name}").collect()]
        assert got == [(r[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows]


def test_search_is_the_least_of_all_paths():
    """Against all paths of short lattices, between any states."""
    rnd = random.Random(2)

    def paths(steps, i, q, end, inserts):
        if i == len(steps) and q == end:
            yield 0, ""
        if inserts:
            for c, x in paths(steps, i, conversations.NEXT[q][1], end, inserts - 1):
                yield c + 2, "I" + x
        if i < len(steps):
            for a, b, c, x in steps[i]:
                if a == q:
                    for more, rest in paths(steps, i + 1, b, end, inserts):
                        yield c + more, x + rest

    for _ in range(60):
        steps = [s for _ in range(rnd.randrange(4)) for s in conversations.row_steps(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([None, None, "blank", "truncated", "duplicate"]), rnd.choice([1, 1, 3]))]
        for q in range(4):
            for ends in [(e,) for e in range(4)] + [conversations.ENDS]:
                want = min((p for e in ends for p in paths(steps, 0, q, e, 5)), default=None)
                assert conversations.cheapest(steps, q, ends) == want


def test_line_hashes_are_independent(spark):
    """Spark seeds a hash with that of the column before: h2 must not be the hash of a constant under h1."""
    import xxhash

    from storygraph.llm import line_dedup

    keys = [f"line {i}" for i in range(50)]
    rows = spark.createDataFrame([("\n".join(keys),)], "text string").select(F.explode(line_dedup.line_places(F.col("text"))).alias("h")).select("h.h1", "h.h2", F.element_at("h.at", 1).alias("i")).collect()
    seed = xxhash.xxh64_intdigest(b"line", 42)
    for r in rows:
        h1, h2 = r["h1"] % 2**64, r["h2"] % 2**64
        assert h1 == xxhash.xxh64_intdigest(keys[r["i"]].encode(), 42) and h2 == xxhash.xxh64_intdigest(keys[r["i"]].encode(), seed)
        assert h2 != xxhash.xxh64_intdigest(b"line", h1)
