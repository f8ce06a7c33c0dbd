"""PII surrogates with DataFrame operations alone.

Entities are found by one pattern, and each distinct one (type, normal form) gets a surrogate from an HMAC-SHA-256 under the caller's key: a value of the same type
and format. Letters become letters and digits digits, of the same case and in the same places; card numbers keep passing their check
digit and other numbers of that length are left alone; addresses stay addresses; a name is replaced by one of its title's gender and its
own script (Latin, Cyrillic or Greek; names in other scripts get Latin ones). Given names and surnames are entities of their own, so that
Mr John Smith and Mr Smith keep one surname, in all documents; where a document has Mr John Smith, John Smith without a title is replaced
too (the counts hold the titled ones alone). One entity has one surrogate in all documents and spellings (coreference), and two entities never share one (distinctness):
surrogates that collide with each other or with a real entity are drawn again until none does. From draw LONGER on, each draw of a
name, address or secret is longer by a syllable or a letter, so there are always more surrogates than entities. The other types have
10^9 values of a format or more; where these are as good as used up, MOST_DRAWS draws end in an error that names the types.

The table of entities is the only thing joined with; a frequent entity is one row of it, and its many documents are spread by
Spark's split of skewed joins. Documents without entities pass without a shuffle.
The pattern runs only over texts that pass a cheap test for what every entity has. A placeholder for a secret, without a letter or
digit, is none and stays; a secret of fewer digits than a telephone number has is a secret.

Defined cases: null texts stay null; empty texts stay empty; rows that repeat, and null doc_ids, are treated like all others; an empty
table gives an empty result; other columns are kept but for the names of the counts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.common import ascii_lower, once, stored, unwrapped, wrapped

#: The key of the registered query alone, whose results anyone may repeat; pass a secret one to pseudonymized().
QUERY_KEY = "storygraph"
TYPES = ("email", "secret", "ip", "iban", "card", "id", "phone", "name")
#: The first draw that makes longer values; draws after which a type counts as used up.
LONGER, MOST_DRAWS = 2, 100
#: Titles by gender (n: either), given names and surname parts by script and gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа"),
    "n": ("Dr", "Prof"),
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "latin": ""}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Henry", "Jonas"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Helen", "Julia"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Егор", "Иван", "Лев", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга"),
    ("greek", "m"): ("Αλέξης", "Γιάννης", "Δημήτρης", "Κώστας", "Μάνος", "Νίκος", "Πέτρος", "Στέφανος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία"),
}
STEMS = {
    "latin": ("Bar", "Cor", "Del", "Fen", "Gar", "Hol", "Kel", "Lan", "Mar", "Nor", "Pel", "Ros", "San", "Tor", "Val", "Win"),
    "cyrillic": ("Бар", "Вол", "Гор", "Дол", "Кар", "Лоб", "Мар", "Нор", "Пол", "Род", "Сав", "Тор", "Фед", "Хол", "Чер", "Шум"),
    "greek": ("Αλεξ", "Βασ", "Γεωρ", "Δημ", "Ζαχ", "Θεοδ", "Καρ", "Λαμπ", "Μαρκ", "Νικ", "Παπ", "Ραλ", "Σταυρ", "Τριαντ", "Φωτ", "Χριστ"),
}
MIDDLES = {
    "latin": ("a", "e", "i", "o", "en", "er", "in", "on"),
    "cyrillic": ("а", "е", "и", "о", "ан", "ер", "ин", "он"),
    "greek": ("α", "ε", "ι", "ο", "αν", "ερ", "ιν", "ον"),
}
ENDS = {
    ("latin", "m"): ("berg", "dale", "feld", "ford", "land", "man", "sen", "ton"),
    ("latin", "f"): ("berg", "dale", "feld", "ford", "land", "man", "sen", "ton"),
    ("cyrillic", "m"): ("ев", "ов", "ин", "кин", "нов", "ров", "ский", "цев"),
    ("cyrillic", "f"): ("ева", "ова", "ина", "кина", "нова", "рова", "ская", "цева"),
    ("greek", "m"): ("άκης", "ίδης", "όπουλος", "ούδης", "άτος", "έλης", "ίνης", "ώτης"),
    ("greek", "f"): ("άκη", "ίδου", "οπούλου", "ούδη", "άτου", "έλη", "ίνη", "ώτη"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "(?:" + "|".join(t for of in TITLES.values() for t in of) + ")"
_PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"""(?<=(?i:token|secret|password|passwd|api_key|apikey)\s{0,3}[=:]\s{0,3}["']{0,1})[A-Za-z0-9_-]{8,}""",
    r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
)
PATTERN = "|".join(_PATTERNS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled: a multiple of 10 for card numbers."""
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when((F.length(digits) - i) % 2 == 0, at(i)).otherwise(doubled(at(i))))


def kind(s: Column) -> Column:
    """Type of a match of PATTERN; null for what is none after all."""
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "id")
        .when(s.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), once(_digits(s), lambda d: F.when(_luhn(d) % 10 == 0, "card")))
        .when(s.rlike(r"^[+(0-9][0-9() .-]+$") & (F.length(_digits(s)) >= 10), "phone")
        .when(s.rlike(rf"^{_TITLE}\.? "), "name")
        .when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & ~s.rlike("^[0-9A-F]{32,64}$"), "iban")
        .otherwise(F.when(s.rlike(r"[\p{L}0-9]"), "secret"))
    )


def normal(s: Column, of: Column) -> Column:
    """What all spellings of an entity share; a name's holds its gender."""
    titled = lambda g: s.rlike("^(?:" + "|".join(TITLES[g]) + r")\.? ")
    gender = F.when(titled("f"), "f").when(titled("n"), "n").otherwise("m")
    name = F.concat(gender, F.lit(" "), F.lower(F.regexp_replace(s, rf"^{_TITLE}\.? ", "")))
    return F.when(of.isin("card", "id", "phone"), _digits(s)).when(of == "name", name).when(of == "ip", s).otherwise(ascii_lower(s))


def parts(of: Column, norm: Column) -> Column:
    """The entities (kind, norm) that a match stands for: of a name with a blank the given name and the surname, else itself."""
    entity = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    word = lambda i: F.concat_ws(" ", F.split_part(norm, F.lit(" "), F.lit(1)), F.split_part(norm, F.lit(" "), F.lit(i)))
    return F.when((of == "name") & (F.size(F.split(norm, " ")) > 2), F.array(entity(F.lit("given"), word(2)), entity(of, word(3)))).otherwise(F.array(entity(of, norm)))


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string, in hex."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def surrogate(of: Column, norm: Column, attempt: Column, key: str) -> Column:
    """A value of the same type and shape, from a keyed hash; names, addresses and secrets grow from draw LONGER on."""
    seed = F.concat_ws("|", of, norm, attempt.cast("string"))
    stream = F.concat(*[hmac(key, F.concat_ws("|", seed, F.lit(str(i)))) for i in range(4)])

    def made(h: Column) -> Column:
        byte = lambda i: F.conv(F.substring(h, i % 128 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
        letter = lambda i: F.char(byte(i) % 26 + 97)
        digit = lambda i: (byte(i) % 10).cast("string")
        shaped = lambda s: F.array_join(F.transform(chars(s), lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), letter(i)).otherwise(c)), "")
        hexed = F.array_join(F.transform(chars(norm), lambda c, i: F.substring(h, i % 256 + 1, F.lit(1))), "")
        keep = lambda n: F.concat(F.substring(norm, F.lit(1), n), shaped(F.substring(norm, n + 1, F.length(norm))))
        stem = lambda s: F.regexp_extract(s, r"^(.*)\.", 1)
        extra = F.when(attempt < LONGER, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - (LONGER - 1))))
        letters = F.array_join(F.transform(extra, lambda i: letter(128 - i)), "")
        body = F.concat(F.substring(norm, F.lit(1), F.lit(1)), shaped(F.substring(norm, F.lit(2), F.length(norm) - 2)))
        card = once(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        ip = F.concat_ws(".", (byte(F.lit(0)) % 223 + 1).cast("string"), *[byte(F.lit(i)).cast("string") for i in (1, 2, 3)])

        def named(script: str, gender: str) -> Column:
            own = "m" if gender == "n" else gender
            syllable = lambda i: F.concat(_pick(STEMS[script], byte(i)), _pick(MIDDLES[script], byte(i + 1)))
            longer = F.array_join(F.transform(extra, lambda i: syllable(8 + 2 * i)), "")
            end = lambda i: _pick(ENDS[script, own], byte(F.lit(i)))
            first = GIVEN[script, "m"] + GIVEN[script, "f"] if gender == "n" else GIVEN[script, gender]
            last = F.initcap(F.concat(longer, syllable(F.lit(1)), _pick(STEMS[script], byte(F.lit(5))), end(3)))
            double = F.concat_ws("-", F.initcap(F.concat(syllable(F.lit(6)), end(4))), last)
            return F.when(of == "given", F.concat(_pick(first, byte(F.lit(4))), F.lower(longer))).when(norm.contains("-"), double).otherwise(last)

        name = F.lit(None).cast("string")
        for script, letters_of in SCRIPTS.items():
            for gender in TITLES:
                name = F.coalesce(name, F.when(norm.startswith(f"{gender} ") & norm.rlike(letters_of), named(script, gender)))
        return (
            F.when(of == "ip", ip)
            .when(of == "card", card)
            .when(of.isin("name", "given"), name)
            .when(of == "email", F.concat(letters, shaped(stem(norm)), F.regexp_extract(norm, r"\.[^.]*$", 0)))
            .when(of == "phone", keep(F.greatest(F.lit(0), F.length(norm) - 10)))
            .when(of == "iban", keep(F.lit(2)))
            .when((of == "secret") & norm.rlike("^[0-9a-f]*[a-f][0-9a-f]*$"), F.concat(letters, hexed))
            .when(of == "secret", F.concat(letters, shaped(norm)))
            .otherwise(shaped(norm))
        )

    return once(stream, made)


def rendered(s: Column, of: Column, value: Column) -> Column:
    """A surrogate in the spelling of the occurrence s; what makes it longer comes first."""
    longer = F.length(value) - F.length(s)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    weave = lambda a, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(value, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
    cased = F.array_join(F.transform(chars, lambda c, i: once(F.substring(value, longer + i + 1, F.lit(1)), lambda x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x))), "")
    return (
        F.when(of.isin("card", "id", "phone"), F.aggregate(chars, start, weave, lambda a: a["out"]))
        .when(of == "ip", value)
        .when(of == "name", F.concat(F.regexp_extract(s, rf"^{_TITLE}\.? ", 0), value))
        .otherwise(F.concat(F.substring(value, F.lit(1), longer), cased))
    )


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes: a digit, an @, an access key's start, a hash of letters alone, a word before a secret, or a title and a blank."""
    near = [F.lower(text).contains(w) for w in ("token", "secret", "passw", "api_key", "apikey")]
    titles = [text.contains(f"{t}{end}") for of in TITLES.values() for t in of for end in (" ", ". ")]
    out = text.rlike("[0-9@]|AKIA|[0-9A-Fa-f]{32}")
    for c in near + titles:
        out |= c
    return F.coalesce(out, F.lit(False))


def found(text: Column) -> Column:
    """The entities of a text in order: array of (s, kind, norm); matches that are none after all have a null kind."""
    typed = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda s: F.struct(s.alias("s"), kind(s).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), normal(x["s"], x["kind"]).alias("norm")))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, value) for distinct entities (kind, norm): no two share a value and no value is a real entity."""
    real = entities.select("kind", F.when(F.col("kind").isin("name", "given"), F.substring("norm", 3, 1000)).otherwise(F.col("norm")).alias("_plain")).distinct()
    drawn = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_DRAWS):
        drawn = stored(drawn.select("kind", "norm", "attempt", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key).alias("value")), "surrogates")
        winner = drawn.groupBy("kind", "value").agg(F.min(F.struct("attempt", "norm")).alias("w"))
        judged = drawn.join(winner, ["kind", "value"]).withColumn("_plain", F.lower("value")).join(real.withColumn("_real", F.lit(True)), ["kind", "_plain"], "left")
        # An earlier draw keeps its value, so each round settles at least the winners.
        again = (F.col("w.norm") != F.col("norm")) | F.col("_real").isNotNull()
        judged = judged.select("kind", "norm", "attempt", F.coalesce(again, F.lit(False)).alias("again"))
        if judged.filter("again").isEmpty():
            return drawn.select("kind", "norm", "value")
        drawn = judged.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    used_up = [r["kind"] for r in judged.filter("again").select("kind").distinct().collect()]
    raise ValueError(f"no surrogates are left for some entities of {used_up} after {MOST_DRAWS} draws")


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs with its texts' entities replaced under a secret key, and n_<type> counts."""
    none = F.array().cast("array<struct<s:string,kind:string,norm:string>>")
    count = lambda t: F.size(F.filter(F.coalesce("_found", none), lambda x: x["kind"] == t)).cast("long")
    counts = {f"n_{t}": count(t) for t in TYPES}
    own_columns, docs = docs.columns, wrapped(docs, "doc_id", "text")
    hashes = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", "doc_id", F.lit("row")).alias("_k2")]
    # The pattern is slow, so it runs once over the texts that may hold something; these are few and stored with what was found.
    seen = stored(docs.filter(may_hold(F.col("text"))).select("*", *hashes, found(F.col("text")).alias("_found")), "entity-texts")
    some = F.coalesce(F.exists("_found", lambda x: x["kind"].isNotNull()), F.lit(False))
    having = seen.filter(some)
    entities = F.flatten(F.transform("_found", lambda x: parts(x["kind"], x["norm"])))
    each = stored(having.select("_k1", "_k2", F.explode(F.array_distinct(entities)).alias("e")).filter("e.kind IS NOT NULL").select("_k1", "_k2", "e.*"), "entities")
    values = surrogates(each.select("kind", "norm").distinct(), key)
    own = each.join(values, ["kind", "norm"]).groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "norm").alias("k"), "value"))).alias("_own"))  # a document's own entities
    value = lambda x: F.array_join(F.transform(parts(x["kind"], x["norm"]), lambda e: F.try_element_at("_own", F.concat_ws(":", e["kind"], e["norm"]))), " ")
    full = F.filter("_found", lambda x: (x["kind"] == "name") & (F.size(F.split(x["norm"], " ")) > 2))
    untitled = F.array_distinct(F.transform(full, lambda x: F.struct(F.regexp_replace(x["s"], rf"^{_TITLE}\.? ", "").alias("s"), value(x).alias("value"))))
    mention = lambda s: F.concat(F.lit(r"(?<!\p{L})"), s, F.lit(r"(?!\p{L})"))
    between = lambda text: F.aggregate("_names", text, lambda t, n: F.regexp_replace(t, mention(n["s"]), n["value"]))
    replaced = F.transform(
        F.arrays_zip(F.split("text", PATTERN, -1).alias("before"), F.col("_found").alias("x")),
        lambda z: F.concat(between(z["before"]), F.when(z["x"].isNull(), F.lit("")).when(z["x"]["kind"].isNull(), z["x"]["s"]).otherwise(rendered(z["x"]["s"], z["x"]["kind"], value(z["x"])))),
    )
    out = having.join(own, ["_k1", "_k2"]).withColumn("_names", untitled).withColumn("text", F.array_join(replaced, "")).withColumns(counts)
    rest = docs.filter(~may_hold(F.col("text"))).select("_doc", "text").unionByName(seen.filter(~some).select("_doc", "text"))
    rest = rest.withColumns({n: F.lit(0).cast("long") for n in counts})
    made = ["_doc", "text", *counts]
    return unwrapped(out.select(*made).unionByName(rest.select(*made)), own_columns, "text", *counts)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
