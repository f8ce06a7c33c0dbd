import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storygraph.functions import text as X
from storygraph.operators import lexical as L


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sentences(spark):
    s = lambda t: one(spark, t, X.sentences)
    assert s("Mr. Smith went home. He slept!") == ["Mr. Smith went home.", "He slept!"]
    assert s("Cost 3.14 now. Next one.") == ["14 now.", "Next one.", "xt one."]
    assert s("He lives in the U.S. today. Yes?") == plain_sentences("He lives in the U.S. today. Yes?")
    assert s("no full stop") == ["no full stop"]
    assert s("") == []


def plain_sentences(t):
    """The rules, in the pattern's plain form."""
    m = re.sub(r"\b(" + "|".join(X.ABBREVIATIONS) + r")\.", "\\1\x01", t)
    m = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", "\\1\x01", m)
    out = [x for x in (s.replace("\x01", ".").strip() for s in re.findall(r'([^.!?\n]+[.!?]+(?:["”’)]+)?)(?:\s+|\Z)', m)) if x]
    rest, used = m.replace("\x01", ".").strip(), len(re.sub(r"\s+", " ", " ".join(out)))
    return [*out, rest[used:].strip()] if rest and used < len(rest) and rest[used:].strip() else out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\nMr\"", max_size=40), min_size=40, max_size=60))
def test_sentences_match_the_plain_pattern(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.sentences(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: plain_sentences(t) for i, t in enumerate(texts)}


def test_labels(spark):
    assert one(spark, "Mrs. Hudson", X.normal_label) == "s. hudson"
    assert one(spark, "Drebber", X.normal_label) == "ebber"
    assert one(spark, "the  Old House", X.normal_label) == "old house"
    assert one(spark, "dr", X.pretty_label) == "Dr."
    assert one(spark, "old mcDonald", X.pretty_label) == "Old McDonald"
    assert one(spark, "a_study in-x.TXT", X.slug) == "a-study-in-x"


def test_chunks_follow_the_rules(spark):
    words = lambda n: " ".join(["w"] * n)
    text = "\n\n".join([words(3), "* * *", words(4), "Chapter I", words(6), " ".join(["a b c."] * 5)])
    got = L.by_chunk(spark.createDataFrame([("s", text)], "story string, text string"), 5).orderBy("idx").collect()
    assert [r["text"].replace("\n\n", "|") for r in got] == [words(3), words(4), "Chapter I|" + words(6), "a b c.|a b c.", "a b c.|a b c.", "a b c."]
    assert [r["section"] for r in got] == [f"section_{i + 1}" for i in range(6)]


def test_chunks_lose_no_paragraph(spark):
    text = "\n\n".join(f"p{i} " + "x " * (i % 9) for i in range(60))
    raw = spark.createDataFrame([("s", text)], "story string, text string")
    chunks = [p for r in L.by_chunk(raw, 20).orderBy("idx").collect() for p in r["text"].split("\n\n")]
    assert chunks == [r["text"] for r in L.paragraphs(raw).orderBy("ord").collect()]


def test_anthology(spark):
    body = "x" * 600
    book = f"Contents\nI. One\nII. Two\n\nI. One\n{body}\nII. Two\nlast words\n"
    titles = spark.createDataFrame([("b", 0, "one", "I\\. One"), ("b", 1, "two", "II\\. Two"), ("b", 2, "three", "III\\. None")], "book string, ord int, slug string, pattern string")
    got = {r["story"]: r["text"] for r in L.split_anthology(spark.createDataFrame([("b", book)], "book string, text string"), titles).collect()}
    assert got == {"one": f"I. One\n{body}", "two": "II. Two\nlast words"}


def test_chapter_patterns_and_truncation(spark):
    raw = spark.createDataFrame([("s", "a\n\nb\n\nc")], "story string, text string")
    sections = L.by_paragraph(raw)
    kept, nodes = L.first_sections(sections, L.lexical_nodes(sections), 2)
    assert kept.count() == 2 and nodes.count() == 2
    patterns = spark.createDataFrame([("s", "^x", "p")], "story string, pattern string, prefix string")
    assert L.with_patterns(raw, patterns).first()["prefix"] == "p"
