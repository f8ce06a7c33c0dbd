"""Layer 1: sections and lexical nodes of raw texts. raw: (story, text), a row for each story.

A story's text stays in its row until it is cut, so nothing shuffles but the numbering of sections and sentences, by story.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.functions import text as X

BUDGET = 150


def paragraphs(raw: DataFrame) -> DataFrame:
    """T4: (story, ord, text)."""
    return raw.select("story", F.posexplode(X.paragraphs(F.col("text"))).alias("ord", "text"))


def _sections(rows: DataFrame, prefix: Column | None = None) -> DataFrame:
    """rows (story, idx, title, text) with section ids and word counts."""
    id_ = F.concat(F.lit("section_"), (F.col("idx") + 1).cast("string"))
    id_ = id_ if prefix is None else F.concat(F.coalesce(F.concat(prefix, F.lit("-")), F.lit("")), id_)
    return rows.select("story", id_.alias("section"), F.col("idx").cast("int").alias("idx"), "title", "text", X.word_count(F.col("text")).alias("word_count"))


def by_story(raw: DataFrame) -> DataFrame:
    """T5: one section."""
    return _sections(raw.select("story", F.lit(0).alias("idx"), F.lit("Story").alias("title"), F.array_join(X.paragraphs(F.col("text")), "\n\n").alias("text")))


def by_paragraph(raw: DataFrame) -> DataFrame:
    """T6."""
    rows = paragraphs(raw)
    return _sections(rows.select("story", F.col("ord").alias("idx"), F.concat(F.lit("Section "), (F.col("ord") + 1).cast("string")).alias("title"), "text"))


def by_chapter(raw: DataFrame, pattern: str = X.CHAPTER) -> DataFrame:
    """A paragraph that matches starts a section; what stands before the first is the preamble."""
    rows = paragraphs(raw).withColumn("mark", F.col("text").rlike(pattern))
    return _sections(_parts(rows))


def by_own_chapter(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """by_chapter with each story's own pattern and, where it has one, the prefix of its section ids."""
    own = with_patterns(raw, patterns)
    rows = own.select("story", "pattern", F.posexplode(X.paragraphs(F.col("text"))).alias("ord", "text"))
    parts = _parts(rows.withColumn("mark", F.expr("text RLIKE pattern")))
    return _sections(parts.join(own.select("story", "prefix"), "story"), F.col("prefix"))


def _parts(rows: DataFrame) -> DataFrame:
    """(story, idx, title, text): paragraphs (story, ord, text, mark) put together, each mark starting a part."""
    by = Window.partitionBy("story").orderBy("ord")
    rows = rows.withColumn("part", F.sum(F.col("mark").cast("int")).over(by))
    parts = rows.groupBy("story", "part").agg(
        F.max(F.when(F.col("mark"), F.col("text"))).alias("marker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )
    idx = F.row_number().over(Window.partitionBy("story").orderBy("part")) - 1
    return parts.select("story", idx.alias("idx"), F.coalesce("marker", F.lit("Preamble")).alias("title"), "text")


def _chunked(rows: list, budget: int) -> list[str]:
    """The paragraphs of one story, grouped greedily; each: (text, words, is_break, is_chapter, sentences, their words)."""
    out, held, count = [], [], 0
    for p in rows:
        if (p["is_break"] or p["is_chapter"]) and held:
            out.append("\n\n".join(held))
            held, count = [], 0
        if p["is_break"]:
            continue
        parts = zip(p["sentences"], p["sizes"], strict=True) if p["words"] > 2 * budget else [(p["text"], p["words"])]
        for text, size in parts:
            held.append(text)
            count += size
            if count >= budget:
                out.append("\n\n".join(held))
                held, count = [], 0
    return [*out, "\n\n".join(held)] if held else out


def by_chunk(raw: DataFrame, budget: int = BUDGET, pattern: str = X.CHAPTER) -> DataFrame:
    """Paragraphs up to a budget of words, with forced breaks. The greedy reset is the one thing that takes a Python helper."""

    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for stories in batches:
            yield pd.Series([_chunked(list(s), budget) for s in stories], dtype=object)

    def row(p: Column) -> Column:
        def counted(words: Column) -> Column:
            def with_sizes(s: Column) -> Column:
                return F.struct(
                    p.alias("text"), words.alias("words"), p.rlike(X.SCENE_BREAK).alias("is_break"), p.rlike(pattern).alias("is_chapter"),
                    s.alias("sentences"), F.transform(s, X.word_count).alias("sizes"),
                )

            return X.once(F.when(words > 2 * budget, X.sentences(p)).otherwise(F.array().cast("array<string>")), with_sizes)

        return X.once(X.word_count(p), counted)

    cut = F.pandas_udf(chunks, "array<string>")
    rows = raw.select("story", F.transform(X.paragraphs(F.col("text")), row).alias("p")).select("story", F.posexplode(cut("p")).alias("idx", "text"))
    return _sections(rows.withColumn("title", F.concat(F.lit("Section "), (F.col("idx") + 1).cast("string"))))


def with_patterns(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """Raw with the pattern and the id prefix of its source; patterns: (story, pattern, prefix), which Spark broadcasts if it is small."""
    return raw.join(patterns, "story", "left").withColumn("pattern", F.coalesce("pattern", F.lit(X.CHAPTER)))


def lexical_nodes(sections: DataFrame, granularity: str = "sentence") -> DataFrame:
    """(story, id, section, position, text, entities), numbered through the story."""
    rows = sections.select("story", "section", "idx", F.posexplode(X.section_paragraphs(F.col("text"))).alias("para", "p"))
    if granularity == "sentence":
        rows, name = rows.select("story", "section", "idx", "para", F.posexplode(X.sentences(F.col("p"))).alias("sent", "text")), "sentence_"
    else:
        rows, name = rows.select("story", "section", "idx", "para", F.lit(0).alias("sent"), F.col("p").alias("text")), "para_"
    position = F.row_number().over(Window.partitionBy("story").orderBy("idx", "para", "sent")) - 1
    rows = rows.withColumn("position", position)
    return rows.select("story", F.concat(F.lit(name), (F.col("position") + 1).cast("string")).alias("id"), "section", "position", "text", F.array().cast("array<string>").alias("entities"))


def first_sections(sections: DataFrame, nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n sections and their nodes."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    kept = sections.filter(F.col("idx") < n)
    return kept, nodes.join(kept.select("story", "section"), ["story", "section"], "left_semi")


def section_texts(nodes: DataFrame) -> DataFrame:
    """(story, section, text), a section's nodes joined by spaces."""
    sorted_ = F.array_sort(F.collect_list(F.struct("position", "text")))
    return nodes.groupBy("story", "section").agg(F.array_join(F.transform(sorted_, lambda x: x["text"]), " ").alias("text"))


def nodes_up_to(nodes: DataFrame, sections: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The nodes of each story's sections up to its cutoff; cutoffs: (story, cutoff)."""
    return nodes.join(sections.select("story", "section", "idx"), ["story", "section"]).join(cutoffs, "story").filter(F.col("idx") <= F.col("cutoff"))


def split_anthology(books: DataFrame, titles: DataFrame, skip: int = 500) -> DataFrame:
    """Stories of anthologies. books: (book, text); titles: (book, ord, slug, pattern), a pattern for the whole title line.

    A story starts at the second line that matches its title, the first being in the table of contents, and ends where the next title
    is found `skip` characters or more after its title line, else at the end. Stories whose title is found less than twice are left out.
    """
    lines = books.select("book", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    by = Window.partitionBy("book").orderBy("n")
    at = F.coalesce(F.sum(F.length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("start", at).withColumn("end", at + F.length("line"))
    lines = lines.filter(F.trim("line") != "")
    hits = lines.join(titles, "book").filter(F.expr("line RLIKE concat('(?i)^\\\\s*', pattern, '\\\\s*$')"))
    nth = F.row_number().over(Window.partitionBy("book", "ord").orderBy("start"))
    begin = hits.withColumn("nth", nth).filter("nth = 2").select("book", "ord", "slug", "start", "end")
    after = hits.select("book", (F.col("ord") - 1).alias("ord"), F.col("start").alias("next"))
    ends = begin.join(after, ["book", "ord"], "left").groupBy("book", "ord", "slug", "start").agg(F.min(F.when(F.col("next") >= F.col("end") + skip, F.col("next"))).alias("stop"))
    body = ends.join(books, "book")
    cut = F.substring(F.col("text"), F.col("start") + 1, F.coalesce("stop", F.length("text")) - F.col("start"))
    return body.select("book", "ord", F.col("slug").alias("story"), X.trim(cut).alias("text")).withColumn("words", X.word_count(F.col("text")))
