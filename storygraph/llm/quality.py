"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates, DataFrame operations alone.

Each document has a vector of transformed statistics. For each language and source, the estimate of centre and scatter is that of the
half of the documents (H of them) whose scatter has the least determinant. It is sought by concentration steps: every step takes the
documents nearest to the last centre by Mahalanobis distance and estimates anew, until its determinant falls no more. Four starts are
followed side by side: medians and quartiles, which a few wild vectors cannot move, all documents, and two halves of them dealt by hash;
after FIRST steps the BEST two of each group go on to their end, and the one that ends at the least determinant is taken. What has
settled takes part in no further step. A step cannot raise the determinant of so large a share of rows, but for the width of the bins, so
each start ends; STEPS guards against an error there and stops the run. A document whose squared distance from the final, reweighted estimate exceeds CUTOFF is
rejected.

A step is one pass over the table of vectors: rows are summed (count, sums, sums of products) by group and distance bin, and a running
count over a group's bins, of which there are at most BINS, finds the nearest half. So a step moves groups x BINS rows, whatever the
number of documents, and no task holds a group's rows. Bins are 1/32 of a doubling of the squared distance wide; of the bin in which
the half is full only the share that it lacks counts.

Steps are many and small. Adaptive planning makes a job, and a thread of the driver, of each of their exchanges; with few groups, whose
estimates are broadcast, it has nothing to split or to replan, so steps are planned without it, their exchanges in no more partitions
than the table of vectors is read in.

FLOOR is a documented parameter: the least standard deviation of each statistic, added to every scatter. A statistic that is the same in
most documents of a group (no symbols, no repeated line) has no scatter of its own; with the floor the scatter stays regular.

Every source has an estimate of its own in each language, at any number of documents. Its centre is that of its own documents. Few
documents say little of a scatter, so the language's scatter makes up PRIOR / (n + PRIOR) of that of n documents, which shrinks smoothly to
nothing. The nearest half has one document more than half of them: up to 3 that is all, and none of so few can be told to be the outlier.

Defined cases: a null text has no words and fails the base rules; a null language or source is a group of its own; rows that
repeat count each; null doc_ids are allowed; an empty table gives an empty result; other columns are kept but for those of MADE.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import SPACE, SPACES, once, stored, words

SYMBOLS = "#*$%&|<>"
WIDTH = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Columns that the operator makes, in place of any of these names.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", "grp")
#: Least standard deviation of each transformed statistic.
FLOOR = {"x_words": 1.0, "x_length": 0.03, "x_symbols": 0.15, "x_lines": 0.45, "x_repeats": 0.45}
X = list(FLOOR)
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
#: The share of rows taken in concentration steps, and rows besides it; bins of distances; documents that the language's scatter counts as.
H, MORE, BINS, PRIOR = 0.5, 1, 2048, 10
#: Steps that all starts make, and the starts of a group that go on; an error after so many steps.
FIRST, BEST, STEPS = 2, 2, 500
#: Groups whose estimates one task makes: at most so many x starts x BINS rows of sums. Their table has a file for each such task.
GROUPS = 64
#: With up to so many groups steps are planned once: their estimates (some 200 bytes for each group and start) are small enough to broadcast.
PLAIN = 4 * GROUPS
#: Determinants that differ by less than this share are the same.
SAME = 1e-6
#: The squared distance of five independent normal values is below this for all but about 1 in 100,000.
CUTOFF = 30.86
#: Rows within this squared distance (all but 1 in 40 normal ones) count in the reweighted estimate.
REWEIGHT = 12.83
#: By these the scatter of the nearest half, and of all within REWEIGHT, falls short of that of five normal values.
SHORT_HALF, SHORT_REWEIGHTED = 1.92, 1.055


def repeated_words(ws: Column, width: int = WIDTH) -> Column:
    """Number of words that a window of `width` words covers which is in the array twice or more."""

    def starts(h: Column) -> Column:
        return F.sequence(F.lit(1), F.size(h) - (width - 1))

    def window(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.element_at(h, i + k) for k in range(width)])

    def again(h: Column) -> Column:
        pairs = F.sort_array(F.transform(starts(h), lambda i: F.struct(window(h, i).alias("w"), i.alias("i"))))

        def shared(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i)["w"] == x["w"], F.lit(False))
            return F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x))

        found = F.sort_array(F.transform(once(pairs, shared), lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("at"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(width), i - acc["at"])).alias("n"))
        return F.aggregate(found, start, add, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        distinct = once(F.transform(starts(h), lambda i: window(h, i)), lambda w: F.size(F.array_distinct(w)) == F.size(w))
        return F.when((F.size(h) < width) | distinct, F.lit(0).cast("long")).otherwise(again(h))

    return once(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < width, F.lit(0).cast("long")).otherwise(count(h)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = once(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("repeats")))
    out = docs.withColumn("_w", of_words)
    return out.select(
        *[c for c in docs.columns if c not in ("text", *MADE)],
        F.col("_w.n").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        once(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("_w.repeats").alias("n_repeat_words"),
        ((F.col("_w.n") < LEAST_WORDS) | (100 * F.col("_w.repeats") > MOST_REPEATED * F.col("_w.n"))).alias("base_failed"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics, grp, the key of the group that a row's estimate is made from, and its language's key, _lang."""
    n = F.col("n_words")
    x = {
        "x_words": F.log1p(n),
        "x_length": F.log((1 + F.col("word_chars")) / (1 + n)),
        "x_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "x_lines": F.log1p(10 * F.col("n_dup_lines") / (1 + n / 20)),
        "x_repeats": F.log1p(10 * F.col("n_repeat_words") / n),
    }
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  a null is no string's equal
    lang, source = name(F.col("lang")), name(F.col("source"))
    return stats.withColumns({k: F.when(~F.col("base_failed"), v) for k, v in x.items()}).withColumns({"_lang": lang, "grp": F.concat_ws("\x01", F.length(lang).cast("string"), lang, source)})


def _start(rows: DataFrame) -> DataFrame:
    """(grp, m0.., l00..): medians, and quartiles' distances as a diagonal scatter, from counts by value to 1/100."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.round(F.col(x) * 100).cast("int").alias("v")) for i, x in enumerate(X)]))
    counts = rows.select("grp", each.alias("e")).groupBy("grp", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("grp", "k")
    upto, total = F.sum("n").over(by.orderBy("v")), F.sum("n").over(by)
    counts = counts.withColumn("share", upto / total)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("v"))) / 100
    each = counts.groupBy("grp", "k").agg(at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("iqr"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = each.groupBy("grp").agg(
        *[pick(k, "m").alias(f"m{k}") for k in range(len(X))],
        *[F.sqrt(F.pow(pick(k, "iqr") / 1.349, 2) + F.lit(FLOOR[x] ** 2)).alias(f"l{k}{k}") for k, x in enumerate(X)],
    )
    return out.select("*", *[F.lit(0.0).alias(f"l{i}{j}") for i, j in PAIRS if i != j])


def _number(x: float) -> str:
    return f"{x!r}D"


def _total(terms: list[str]) -> str:
    return " + ".join(terms) or "0.0D"


#: d2 of a row joined with its estimate, z by z; columns named by the select that they stand in.
_DISTANCE = [f"({x} - m{i} - ({_total([f'l{i}{j} * z{j}' for j in range(i)])})) / l{i}{i} AS z{i}" for i, x in enumerate(X)]
_DISTANCE.append(_total([f"z{i} * z{i}" for i in range(len(X))]) + " AS d2")
_SUMS = ["count(1) AS n", *[f"sum({x}) AS s{i}" for i, x in enumerate(X)], *[f"sum({X[i]} * {X[j]}) AS p{i}{j}" for i, j in PAIRS]]
_NAMES = ["n", *[f"s{i}" for i in range(len(X))], *[f"p{i}{j}" for i, j in PAIRS]]
_FIT = [*[f"m{i}" for i in range(len(X))], *[f"l{i}{j}" for i, j in PAIRS]]
_DET = " * ".join(f"l{i}{i} * l{i}{i}" for i in range(len(X)))


def distance(rows: DataFrame, estimate: DataFrame, *more: str, how: str = "left") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance; estimate holds the scatter's Cholesky factor. With several starts a row comes once for
    each. more: columns of the estimate to keep."""
    own = [c for c in rows.columns if c != "d2"]
    out = rows.select(*own).join(estimate.select("grp", *_FIT, *more), "grp", how).selectExpr(*own, *more, *_DISTANCE)
    return out.select(*own, *more, "d2")


def _sums() -> list[Column]:
    return [F.expr(e) for e in _SUMS]


def _estimate(sums: DataFrame, short: float, share: float, prior: DataFrame | None, keys: tuple = ("grp",), more: tuple = ()) -> DataFrame:
    """Centre, Cholesky factor and determinant of the scatter, from sums by group, of a share of its rows; prior has the languages' scatters."""
    floor = [v**2 for v in FLOOR.values()]
    made = [f"s{i} / n AS m{i}" for i in range(len(X))]
    scatter = {(i, j): f"((p{i}{j} / n - m{i} * m{j}) * {_number(short)} + {_number(floor[i] if i == j else 0.0)})" for i, j in PAIRS}
    if prior is not None:
        sums = sums.join(prior.select("grp", *[F.col(f"l{i}{j}").alias(f"_l{i}{j}") for i, j in PAIRS]), "grp")
        made.append(f"n / (n + {_number(PRIOR * share)}) AS w")
        of_language = {(i, j): _total([f"_l{i}{k} * _l{j}{k}" for k in range(j + 1)]) for i, j in PAIRS}
        scatter = {(i, j): f"(w * {v} + (1 - w) * ({of_language[i, j]}))" for (i, j), v in scatter.items()}
    for i, j in PAIRS:  # row by row
        rest = f"({scatter[i, j]} - ({_total([f'l{i}{k} * l{j}{k}' for k in range(j)])}))"
        made.append(f"sqrt(greatest({rest}, {_number(floor[i] / 4)})) AS l{i}{j}" if i == j else f"{rest} / l{j}{j} AS l{i}{j}")
    return sums.selectExpr(*keys, *more, *made).selectExpr(*keys, *more, *_FIT, f"{_DET} AS det")


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, ...): the estimates that concentration steps begin with."""
    halves = rows.groupBy("grp", F.pmod(F.xxhash64(*X), F.lit(2)).alias("start")).agg(*_sums())
    whole = halves.groupBy("grp").agg(*[F.sum(c).alias(c) for c in _NAMES]).withColumn("start", F.lit(3).cast("long"))
    sums = halves.withColumn("start", F.col("start") + 1).unionByName(whole)
    made = _estimate(sums, 1.0, 1.0, None, ("grp", "start"))
    return made.unionByName(_start(rows).withColumn("start", F.lit(0).cast("long")).withColumn("det", F.expr(_DET)))


def _kept_apart(estimate: DataFrame, groups: int) -> DataFrame:
    """The estimates of so many groups as a stored table. In a file for each shuffle partition it would be mostly footers, too large to broadcast."""
    return stored(estimate.coalesce(groups // GROUPS + 1), "quality-step")


@contextmanager
def _planned_once(rows: DataFrame, groups: int) -> Iterator[None]:
    """Queries that run inside are one job each, in no more partitions than rows is read in. With more than PLAIN groups nothing changes."""
    conf = rows.sparkSession.conf
    tasks = "spark.sql.shuffle.partitions"
    own = {k: conf.get(k) for k in ("spark.sql.adaptive.enabled", tasks)}
    try:
        if groups <= PLAIN:
            conf.set(tasks, min(int(own[tasks]), max(1, rows.rdd.getNumPartitions())))
            conf.set("spark.sql.adaptive.enabled", "false")
        yield
    finally:
        for k, v in own.items():
            conf.set(k, v)


def estimates(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of each group. rows: (grp, x_...) of documents that the base rules pass;
    prior: an estimate for each group, whose scatter counts as that of PRIOR rows."""
    groups = rows.select("grp").distinct().count()
    with _planned_once(rows, groups):
        return _settled(rows, prior, groups)


def _settled(rows: DataFrame, prior: DataFrame | None, groups: int) -> DataFrame:
    keys = ("grp", "start")
    now = _kept_apart(_starts(rows), groups)  # a few hundred bytes for each group and start
    by, ended = Window.partitionBy(*keys), []
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))
    for step in range(1, STEPS + 1):
        bins = F.least(F.lit(BINS - 1), F.floor(32 * F.log2(1 + F.col("d2")))).cast("int")
        sums = distance(rows, now, "start", "det", how="inner").withColumn("bin", bins).groupBy(*keys, "bin").agg(*_sums(), F.min("det").alias("_last"))
        before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        half = F.least(F.sum("n").over(by), F.floor(H * F.sum("n").over(by)) + MORE)
        near = sums.withColumns({"_before": before, "_half": half}).filter("_before < _half")
        near = near.withColumn("_share", F.least(F.lit(1.0), (F.col("_half") - F.col("_before")) / F.col("n")))
        near = near.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("_share")).alias(c) for c in _NAMES], F.min("_last").alias("_last"))
        made = _estimate(near, SHORT_HALF, H, prior, keys, ("_last",))
        # What a start begins with is no estimate of a half: only later determinants can be compared with the last.
        settled = (F.col("det") >= (1 - SAME) * F.col("_last")) if step > 1 else F.lit(False)
        made = made.withColumn("_settled", settled).drop("_last")
        made = made.withColumn("_nth", nth).filter(F.col("_nth") <= BEST).drop("_nth") if step == FIRST else made
        made = _kept_apart(made, groups)
        ended.append(made.filter("_settled"))
        now = made.filter("NOT _settled")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"estimates have not settled after {STEPS} steps")
    now = reduce(DataFrame.unionByName, ended)
    now = _kept_apart(now.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "start", "_settled"), groups)
    near = distance(rows, now).filter(F.col("d2") <= REWEIGHT).groupBy("grp").agg(*_sums())
    out = _estimate(near, SHORT_REWEIGHTED, 1.0, prior)
    if prior is None:
        return _kept_apart(out, groups)
    # A group without any row near its centre keeps the last step's estimate.
    return _kept_apart(out.unionByName(now.join(near, "grp", "left_anti")), groups)


def judged(docs: DataFrame) -> DataFrame:
    """docs without text, with the statistics, d2 and kept. The vectors are stored once and read in each step."""
    own = [c for c in docs.columns if c not in ("text", *MADE)]
    whole = docs.select("lang", "source", "text", F.struct(*own).alias("_doc"))  # names of our own meet none of theirs
    rows = stored(vectors(statistics(whole)), "quality-vectors")
    fit = stored(rows.filter("NOT base_failed").select("_lang", "grp", *X), "quality-fit")
    languages = estimates(fit.select(F.col("_lang").alias("grp"), *X)).withColumnRenamed("grp", "_lang")
    pairs = fit.select("grp", "_lang").distinct()
    prior = _kept_apart(pairs.join(languages, "_lang").drop("_lang"), pairs.count())
    out = distance(rows, estimates(fit.drop("_lang"), prior))
    passed = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    made = [c for c in MADE if c not in ("kept", "grp")]
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in own], *made, passed.alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass both, with their own columns."""
    whole = docs.select("lang", "source", "text", F.struct(*docs.columns).alias("_doc"))
    return judged(whole).filter("kept").select("_doc.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    return judged(docs).select(*columns)
