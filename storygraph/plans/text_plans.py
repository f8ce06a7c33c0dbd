"""Queries over the text layer, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.functions import text as X
from storygraph.operators import lexical as L
from storygraph.plans.sql import DOCS, SENTENCES, with_
from storygraph.sources.projections import documents, table

# Marker lines in the form that e-books have them.
START, END = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** END OF THE PROJECT GUTENBERG EBOOK A ***"


def strip_book(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\n", F.lit("front"), F.lit(START), "text", F.lit(END), F.lit("back"))).otherwise(F.col("text"))
    return t.select("doc_id", F.md5(X.straight_quotes(X.strip_book(whole))).alias("body"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    s = X.slug(F.concat(F.col("c_mktsegment"), F.lit(" _"), "c_name", F.lit(".txt")))
    return table(spark, d, "customer").select("c_custkey", s.alias("slug"), X.title(s).alias("title"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(documents(spark, d))


def sections_story(spark: SparkSession, d: str) -> DataFrame:
    return L.by_story(documents(spark, d)).select("story", "section", "idx", "title", "word_count", F.md5("text").alias("body"))


def sections_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return L.by_paragraph(documents(spark, d)).select("story", "section", "idx", "title", "word_count")


def sections_chapter(spark: SparkSession, d: str) -> DataFrame:
    # Invented prose has no chapters: one-letter and two-letter words at a paragraph's start stand for markers.
    return L.by_chapter(documents(spark, d), r"^[A-Za-z]{1,2} ").select("story", "section", "idx", "title", "word_count")


def sections_chunk(spark: SparkSession, d: str) -> DataFrame:
    return L.by_chunk(documents(spark, d)).select("story", "section", "idx", "title", "word_count", F.md5("text").alias("body"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return L.lexical_nodes(L.by_paragraph(documents(spark, d))).select("story", "id", "section", "position", "text")


def paragraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return L.lexical_nodes(L.by_story(documents(spark, d)), "paragraph").select("story", "id", "section", "position", F.md5("text").alias("body"))


def first_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = L.by_paragraph(documents(spark, d))
    kept, nodes = L.first_sections(sections, L.lexical_nodes(sections), 2)
    return nodes.groupBy("story", "section").agg(F.count(F.lit(1)).alias("n")).join(kept.select("story", "section", "title"), ["story", "section"])


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    return L.section_texts(L.lexical_nodes(L.by_paragraph(documents(spark, d)))).select("story", "section", F.md5("text").alias("body"))


def nodes_up_to(spark: SparkSession, d: str) -> DataFrame:
    sections = L.by_paragraph(documents(spark, d))
    half = sections.groupBy("story").agg(F.floor(F.max("idx") / 2).cast("int").alias("cutoff"))
    return L.nodes_up_to(L.lexical_nodes(sections), sections, half).groupBy("story").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


_S = with_(DOCS, "d_in AS (SELECT story, ord, text AS p FROM d_para0)", SENTENCES) + (
    ", d_each AS (SELECT story, ord, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM d_sent),"
    " d_nodes AS (SELECT story, ord, text, (row_number() OVER (PARTITION BY story ORDER BY ord, i) - 1)::INT AS position FROM d_each) "
)

def anthology(spark: SparkSession, d: str) -> DataFrame:
    """A book for each conversation, with a table of contents and a story for each turn."""
    t = table(spark, d, "conversations").select(F.concat(F.lit("book_"), F.col("conv_id").cast("string")).alias("book"), F.col("turn").cast("int").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("Turn "), F.col("ord").cast("string"))
    parts = t.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", name.alias("name"), "text"))).alias("p"))
    contents = F.transform("p", lambda x: x["name"])
    bodies = F.flatten(F.transform("p", lambda x: F.array(x["name"], x["text"])))
    books = parts.select("book", F.array_join(F.concat(F.array(F.lit("Contents")), contents, F.array(F.lit("")), bodies), "\n").alias("text"))
    slug = F.concat(F.lit("turn-"), F.col("ord").cast("string"))
    out = L.split_anthology(books, t.select("book", "ord", slug.alias("slug"), name.alias("pattern")))
    return out.select("book", "ord", "story", F.md5("text").alias("body"), "words")


def own_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A pattern for the documents of each source, and a prefix for some sources."""
    raw = documents(spark, d)
    even = F.coalesce(F.col("work").rlike("[02468]$"), F.lit(False))
    pattern = F.when(even, r"^[A-Za-z]{1,2} ").otherwise(r"^[A-Za-z]{3} ")
    patterns = raw.select("story", pattern.alias("pattern"), F.when(F.col("work").rlike("[37]$"), F.col("work")).alias("prefix"))
    return L.by_own_chapter(raw, patterns).select("story", "section", "idx", "title", "word_count")


QUERIES = {
    "text_anthology": anthology,
    "text_own_chapters": own_chapters,
    "text_strip_book": strip_book,
    "text_slugs": slugs,
    "text_paragraphs": paragraphs,
    "text_sections_story": sections_story,
    "text_sections_paragraph": sections_paragraph,
    "text_sections_chapter": sections_chapter,
    "text_sections_chunk": sections_chunk,
    "text_sentences": sentences,
    "text_paragraph_nodes": paragraph_nodes,
    "text_first_sections": first_sections,
    "text_section_texts": section_texts,
    "text_nodes_up_to": nodes_up_to,
}
_TRIM = r"regexp_replace({}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
#: The greedy chunks: cut has the paragraphs, or the sentences of those over 300 words, and a step of r takes one of them.
_CHUNKS = r"""WITH RECURSIVE """ + with_(DOCS)[5:].rstrip() + r""",
d_par AS (SELECT *, len(string_split_regex(text, '\s+')) AS words, regexp_matches(text, '^\s*(?:[*•✦#]\s*){3,}\s*$|^\s*(?:[-—–]\s*){3,}\s*$') AS is_break,
  regexp_matches(text, '(?i)^(chapter\s+[IVXLC\d]+|part\s+[IVXLC\d]+)[^\n]*') AS is_chapter FROM d_para0),
d_in AS (SELECT story, ord, text AS p FROM d_par WHERE words > 300 AND NOT is_break),
""" + SENTENCES.strip() + r""",
d_long AS (SELECT story, ord, unnest(s) AS text, generate_subscripts(s, 1) AS k FROM d_sent),
d_cut AS (SELECT story, ord, 1 AS k, text, words, is_break, is_break OR is_chapter AS fresh FROM d_par WHERE words <= 300 OR is_break
  UNION ALL SELECT story, ord, k, l.text, len(string_split_regex(l.text, '\s+')), false, k = 1 AND is_chapter FROM d_long l JOIN d_par USING (story, ord)),
cut AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY ord, k) AS i FROM d_cut),
r AS (SELECT story, 0::BIGINT AS i, 0 AS chunk, 0::BIGINT AS held, NULL::INT AS own FROM (SELECT DISTINCT story FROM cut)
  UNION ALL SELECT story, i, CASE WHEN NOT is_break AND count_ >= 150 THEN place + 1 ELSE place END, CASE WHEN is_break OR count_ >= 150 THEN 0 ELSE count_ END, CASE WHEN NOT is_break THEN place END
  FROM (SELECT story, c.i, is_break, CASE WHEN fresh AND held > 0 THEN chunk + 1 ELSE chunk END AS place, CASE WHEN fresh THEN 0 ELSE held END + words AS count_ FROM r JOIN cut c USING (story) WHERE c.i = r.i + 1)),
g AS (SELECT story, own AS idx, string_agg(text, chr(10) || chr(10) ORDER BY i) AS b FROM r JOIN cut USING (story, i) WHERE own IS NOT NULL GROUP BY 1, 2)
SELECT story, 'section_' || (idx + 1) AS section, idx, 'Section ' || (idx + 1) AS title, len(string_split_regex(b, '\s+'))::INT AS word_count, md5(b) AS body FROM g"""
_OWN = r""", w AS (SELECT story, work, CASE WHEN regexp_matches(coalesce(work, ''), '[02468]$') THEN '^[A-Za-z]{1,2} ' ELSE '^[A-Za-z]{3} ' END AS pattern,
  CASE WHEN regexp_matches(work, '[37]$') THEN work || '-' ELSE '' END AS prefix FROM d_raw),
m AS (SELECT *, regexp_matches(text, pattern) AS mark FROM d_para0 JOIN w USING (story)),
p AS (SELECT *, sum(mark::INT) OVER (PARTITION BY story ORDER BY ord) AS part FROM m),
g AS (SELECT story, part, coalesce(any_value(prefix), '') AS prefix, max(text) FILTER (mark) AS marker, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS b FROM p GROUP BY story, part),
i AS (SELECT *, (row_number() OVER (PARTITION BY story ORDER BY part) - 1)::INT AS idx FROM g)
SELECT story, prefix || 'section_' || (idx + 1) AS section, idx, coalesce(marker, 'Preamble') AS title, len(string_split_regex(b, '\s+'))::INT AS word_count FROM i"""
_ANTHOLOGY = r"""WITH t AS (SELECT 'book_' || conv_id AS book, turn::INT AS ord, coalesce(text, '') AS text, 'Turn ' || turn AS name FROM conversations),
b AS (SELECT book, 'Contents' || chr(10) || string_agg(name, chr(10) ORDER BY ord) || chr(10) || chr(10) || string_agg(name || chr(10) || text, chr(10) ORDER BY ord) AS text FROM t GROUP BY book),
l0 AS (SELECT book, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM b),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY book ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l0),
h AS (SELECT l.book, t.ord, l.start, l.start + length(line) AS stop, row_number() OVER (PARTITION BY l.book, t.ord ORDER BY start) AS nth FROM l JOIN t ON t.book = l.book AND regexp_matches(line, '(?i)^\s*' || name || '\s*$')),
e AS (SELECT h.book, h.ord, h.start, min(x.start) AS next FROM h LEFT JOIN h x ON x.book = h.book AND x.ord = h.ord + 1 AND x.start >= h.stop + 500 WHERE h.nth = 2 GROUP BY ALL),
c AS (SELECT book, ord, regexp_replace(substr(text, (start + 1)::BIGINT, (coalesce(next, length(text)) - start)::BIGINT), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text FROM e JOIN b USING (book))
SELECT book, ord, 'turn-' || ord AS story, md5(text) AS body, len(string_split_regex(text, '\s+'))::INT AS words FROM c"""
ORACLES = {
    "text_anthology": _ANTHOLOGY,
    "text_own_chapters": with_(DOCS) + _OWN,
    "text_sections_chunk": _CHUNKS,
    "text_strip_book": f"SELECT doc_id, md5(replace(replace(replace(replace(replace({_TRIM.format('text')}, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '…', '...')) AS body FROM documents",
    "text_slugs": r"""WITH s AS (SELECT c_custkey, lower(regexp_replace(c_mktsegment || ' _' || c_name, '[_\s]+', '-', 'g')) AS slug FROM customer)
SELECT c_custkey, slug, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM s""",
    "text_paragraphs": with_(DOCS) + "SELECT story, ord::INT AS ord, text FROM d_para0",
    "text_sections_story": with_(DOCS)
    + r"SELECT r.story, 'section_1' AS section, 0 AS idx, 'Story' AS title, len(string_split_regex(coalesce(b, ''), '\s+'))::INT AS word_count, md5(coalesce(b, '')) AS body FROM d_raw r LEFT JOIN (SELECT story, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS b FROM d_para0 GROUP BY story) USING (story)",
    "text_sections_paragraph": with_(DOCS) + r"SELECT story, 'section_' || (ord + 1) AS section, ord::INT AS idx, 'Section ' || (ord + 1) AS title, len(string_split_regex(text, '\s+'))::INT AS word_count FROM d_para0",
    "text_sections_chapter": with_(DOCS)
    + r""", m AS (SELECT *, regexp_matches(text, '^[A-Za-z]{1,2} ') AS mark FROM d_para0),
p AS (SELECT *, sum(mark::INT) OVER (PARTITION BY story ORDER BY ord) AS part FROM m),
g AS (SELECT story, part, max(text) FILTER (mark) AS marker, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS b FROM p GROUP BY story, part),
i AS (SELECT *, (row_number() OVER (PARTITION BY story ORDER BY part) - 1)::INT AS idx FROM g)
SELECT story, 'section_' || (idx + 1) AS section, idx, coalesce(marker, 'Preamble') AS title, len(string_split_regex(b, '\s+'))::INT AS word_count FROM i""",
    "text_sentences": _S + "SELECT story, 'sentence_' || (position + 1) AS id, 'section_' || (ord + 1) AS section, position, text FROM d_nodes",
    "text_paragraph_nodes": with_(DOCS) + "SELECT story, 'para_' || (ord + 1) AS id, 'section_1' AS section, ord::INT AS position, md5(text) AS body FROM d_para0",
    "text_first_sections": _S + "SELECT story, 'section_' || (ord + 1) AS section, count(*) AS n, 'Section ' || (ord + 1) AS title FROM d_nodes WHERE ord < 2 GROUP BY story, ord",
    "text_section_texts": _S + "SELECT story, 'section_' || (ord + 1) AS section, md5(string_agg(text, ' ' ORDER BY position)) AS body FROM d_nodes GROUP BY story, ord",
    "text_nodes_up_to": _S + ", h AS (SELECT story, max(ord) // 2 AS cutoff FROM d_para0 GROUP BY story) SELECT story, count(*) AS n, max(position) AS last FROM d_nodes JOIN h USING (story) WHERE ord <= cutoff GROUP BY story",
}
