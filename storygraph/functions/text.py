"""Text functions, Column to Column; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, which Java's \s lacks.
SPACE = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters, for functions that take a set.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# What marks the body of an e-book, abbreviations, honorifics, chapter and scene markers.
BOOK_START = r"(?i)\*\*\* ?START OF (THE|THIS) PROJECT GUTENBERG EBOOK .+ \*\*\*"
BOOK_END = r"(?i)\*\*\* ?END OF (THE|THIS) PROJECT GUTENBERG EBOOK .+ \*\*\*"
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "St", "Jr", "Sr", "vs", "etc", "Prof", "Capt")
HONORIFIC = r"(?i)^(mr\.?\s*|mrs\.?\s*|ms\.?\s*|dr\.?\s*|sir\s+|lady\s+|lord\s+|professor\s+|inspector\s+|sergeant\s+|captain\s+|colonel\s+|the\s+)"
SPAN_HONORIFIC = r"(?i)^(Mr\.?|Mrs\.?|Miss|Dr\.?|Professor|Colonel|Inspector)\s+"
CHAPTER = r"(?i)^(chapter\s+[IVXLC\d]+|part\s+[IVXLC\d]+)[^\n]*"
SCENE_BREAK = r"^\s*(?:[*•✦#]\s*){3,}\s*$|^\s*(?:[-—–]\s*){3,}\s*$"
NEVER = r"^\s*$"


def once(value: Column, body) -> Column:
    """body(value) where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank. A look for other runs is cheaper than a copy, and most texts have none."""
    odd = SPACE.replace(r"\s", r"\t-\r")
    return once(c, lambda s: F.when(s.contains("  ") | s.rlike(odd), F.regexp_replace(s, f"{SPACE}+", " ")).otherwise(s))


def strip_book(text: Column) -> Column:
    """What lies between the first start marker and the last end marker."""
    lines = F.split(text, "\n", -1)
    at = lambda p: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    start = F.coalesce(F.array_min(at(BOOK_START)) + 1, F.lit(0))
    end = F.coalesce(F.array_max(at(BOOK_END)), F.size(lines))
    return trim(F.array_join(F.slice(lines, start + 1, F.greatest(F.lit(0), end - start)), "\n"))


def straight_quotes(text: Column) -> Column:
    """T2."""
    return F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), "…", "...")


def slug(name: Column) -> Column:
    """S3: of a file name."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\.[^./]*$", ""), r"[_\s]+", "-"))


def title(slug_: Column) -> Column:
    """S3: the words of a slug, first letters upper-cased, the others as they are."""
    return F.array_join(F.transform(F.split(F.regexp_replace(slug_, "-", " "), " ", -1), _capital), " ")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))


def paragraphs(text: Column) -> Column:
    """T4: array of paragraphs, white space collapsed."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{2,}", -1)
    return F.filter(F.transform(parts, lambda p: trim(collapse(p))), lambda p: p != "")


def section_paragraphs(text: Column) -> Column:
    """Array of a section's paragraphs, as they are."""
    return F.filter(F.transform(F.split(text, r"\n{2,}", -1), trim), lambda p: p != "")


def word_count(text: Column) -> Column:
    """An empty text counts 1."""
    return F.size(F.split(text, f"{SPACE}+", -1))


def sentences(text: Column) -> Column:
    """Array of sentences. Text before an unspaced full stop is skipped and the rest is cut by length, as the rules say.

    The pattern is the linear form: it starts a match only where one can start.
    """
    mask = "\x01"
    # Full stops are found first, and what stands before them is looked at then.
    masked = F.regexp_replace(text, r"\.(?<=\b(?:" + "|".join(ABBREVIATIONS) + r")\.)", mask)
    masked = F.regexp_replace(masked, r"\.(?<=\b[A-Za-z]\.)(?=[A-Za-z]\.)", mask)
    plain = lambda c: trim(F.translate(c, mask, "."))
    pattern = rf'(?:\G|(?<=[.!?\n]))([^.!?\n]++[.!?]++(?:["”’)]++)?)(?:{SPACE}+|\z)'
    found = lambda m: F.filter(F.transform(F.regexp_extract_all(m, F.lit(pattern), F.lit(1)), plain), lambda s: s != "")
    used = lambda s: F.length(collapse(F.array_join(s, " ")))
    tail = lambda rest, s: trim(once(used(s), lambda n: F.substring(rest, n + 1, F.length(rest))))
    with_tail = lambda s, t: F.when(t != "", F.concat(s, F.array(t))).otherwise(s)
    return once(masked, lambda m: once(found(m), lambda s: once(tail(plain(m), s), lambda t: with_tail(s, t))))


def raw_key(id_: Column) -> Column:
    return F.regexp_replace(F.lower(id_), "[^a-z0-9]+", "_")


def pretty_label(label: Column) -> Column:
    """C2."""
    return F.regexp_replace(F.array_join(F.transform(F.split(label, f"{SPACE}+", -1), _capital), " "), r"^Dr\.?$", "Dr.")


def normal_label(label: Column) -> Column:
    """H1: without one leading honorific; the first alternative that fits wins, even inside a word."""
    return F.lower(trim(collapse(F.regexp_replace(label, HONORIFIC, ""))))


def guessed_type(id_: Column) -> Column:
    """X6."""
    return (
        F.when(id_.startswith("location_"), "location")
        .when(id_.startswith("object_"), "object")
        .when(id_.startswith("organisation_") | id_.startswith("organization_"), "organisation")
        .when(id_.startswith("document_"), "document")
        .when(id_.startswith("case_"), "case")
        .otherwise("character")
    )


def cut(text: Column, longest: int, kept: int) -> Column:
    """Texts over `longest` characters, cut to `kept` and an ellipsis."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)
