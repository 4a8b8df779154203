"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

DataFrame functions only. A surrogate is a keyed hash of the entity alone, so equal entities get equal
surrogates everywhere, whatever their spelling (coreference), and texts are rewritten row by row. The distinct entities
are then compared: where two would get the same surrogate, or one that is itself an entity of
the data, all but one try again; such exceptions, few as they are, go back to their documents by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.session import cut_lineage

# Honorifics by the gender they state.
HONORIFICS = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "Госпожа", "Г-жа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
ANY_HONORIFIC = "|".join(x for g in HONORIFICS.values() for x in g)
NAME = "\\p{Lu}[\\p{L}'’-]*\\p{L}"
NAMED = f"(?<!\\p{{L}})({ANY_HONORIFIC})\\.? ({NAME}(?: {NAME}){{0,2}})(?!\\p{{L}})"

EMAIL = "[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+"
SECRET = "(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
ADDRESS = "(?<![\\d.])(?:\\d{1,3}\\.){3}\\d{1,3}(?!\\.?\\d)"
ACCOUNT = "(?<![0-9A-Za-z])[A-Z]{2}\\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = "(?<![\\d-])(?:\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}|\\d{4}[ -]?\\d{6}[ -]?\\d{5})(?![\\d-]*\\d)"
SOCIAL = "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-]*\\d)"
PHONE = "(?<![\\w.])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)[ .-]?|\\d{3}[ .-])\\d{3}[ .-]\\d{4}(?!\\d)|(?<!\\w)\\+\\d{1,3}(?:[ .-]?\\d{2,4}){2,5}(?!\\d)"
PATTERN = "|".join((EMAIL, SECRET, ADDRESS, ACCOUNT, CARD, SOCIAL, PHONE))

# Letters by hexadecimal digit, for names in each script.
LETTERS = {
    "latin": ("bdfgklmnprstvzhj", "aeioaeioaeiouuua", {"f": "a", "m": "n", "n": "e"}),
    "cyrillic": ("бвгдзклмнпрстфхц", "аеиоаеиоаеиоуууа", {"f": "а", "m": "н", "n": "е"}),
    "greek": ("βγδζθκλμνπρστφχψ", "αεηιοαεηιοαεηιοω", {"f": "α", "m": "ς", "n": "ο"}),
}
HEX = "0123456789abcdef"


def _keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits of a nested keyed hash."""
    message = F.concat_ws("|", *parts)
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 256)), 256)


def _kind(x: Column) -> Column:
    is_ = x.rlike
    return (
        F.when(F.contains(x, F.lit("@")), "email").when(is_("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret").when(is_("^(?:\\d{1,3}\\.){3}\\d{1,3}$"), "address")
        .when(is_("^\\p{L}[\\p{L}'’-]*$"), "name").when(is_("^[A-Z]{2}\\d{2}"), "account").when(is_("^\\d{3}-\\d{2}-\\d{4}$"), "social")
        .when(is_("^\\d[\\d -]*$") & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 15), "card").otherwise("phone")
    )


def _canonical(x: Column, kind: Column) -> Column:
    """What spellings of one entity have in common."""
    return (
        F.when(kind.isin("email", "secret", "name"), F.lower(x)).when(kind == "address", x)
        .when(kind == "account", F.regexp_replace(x, " ", "")).otherwise(F.regexp_replace(x, "[^0-9]", ""))
    )


def _letters(digits: Column, script: str, gender: Column) -> Column:
    """Four syllables and an ending that shows the gender, from eight hexadecimal digits."""
    consonants, vowels, endings = LETTERS[script]
    sounds = [F.translate(F.substring(digits, k + 1, 1), HEX, vowels if k % 2 else consonants) for k in range(8)]
    ending = F.when(gender == "f", endings["f"]).when(gender == "m", endings["m"]).otherwise(endings["n"])
    return F.concat(*sounds, ending)


def _luhn(digits: Column) -> Column:
    """Sum that is a multiple of ten for a valid card number."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def surrogate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate in canonical spelling: a pure function of the key, the entity and the attempt."""
    h = _keyed(key, kind, canon, gender, attempt.cast("string"))
    digits = F.translate(h, "abcdef", "250741")
    n = F.length(canon)
    letters = F.translate(h, HEX, "abcdefghijklmnop")
    domain = F.translate(_keyed(key, F.lit("domain"), F.substring_index(canon, "@", -1)), HEX, "abcdefghijklmnop")
    octet = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10)
    numbers = F.concat(F.substring(canon, 1, 1), F.substr(digits, F.lit(1), n - 1))
    body = F.substr(numbers, F.lit(1), n - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    account = F.array_join(F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c, i: F.when(i < 2, c).when(
        c.rlike("[0-9]"), F.substr(digits, i + 1, F.lit(1))).otherwise(F.upper(F.substr(letters, i + 1, F.lit(1))))), "")
    script = lambda name: _letters(h, name, gender)
    return (
        F.when(kind == "email", F.concat(F.substring(letters, 1, 12), F.lit("@"), F.substring(domain, 1, 10), F.lit(".example")))
        .when(kind == "secret", F.substr(F.repeat(h, F.ceil(n / 64).cast("int")), F.lit(1), n))
        .when(kind == "address", F.concat_ws(".", *[octet(k) for k in range(4)]))
        .when(kind == "name", F.when(canon.rlike("^\\p{IsCyrillic}"), script("cyrillic")).when(canon.rlike("^\\p{IsGreek}"), script("greek")).otherwise(script("latin")))
        .when(kind == "account", account)
        .when((kind == "card") & (_luhn(canon) % 10 == 0), F.concat(body, check))
        .otherwise(numbers)
    )


def _formed(x: Column, kind: Column, own: Column) -> Column:
    """The surrogate ``own`` spelled as ``x`` is: its punctuation, spaces and case."""
    spelled = lambda keep: F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c, i: F.when(
        c.rlike(f"[{keep}]"), F.substr(own, F.length(F.regexp_replace(F.substr(x, F.lit(1), i), f"[^{keep}]", "")) + 1, F.lit(1))).otherwise(c)), "")
    upper = (x == F.upper(x)) & (F.length(x) > 1)
    return (
        F.when(kind.isin("email", "address"), own).when(kind == "secret", F.when(upper, F.upper(own)).otherwise(own))
        .when(kind == "name", F.when(upper, F.upper(own)).otherwise(F.initcap(own))).when(kind == "account", spelled("0-9A-Z")).otherwise(spelled("0-9"))
    )


def _found(docs: DataFrame, text: Column) -> DataFrame:
    """``t`` with ``mentions`` (x, kind, canon, gender) and the ``pieces`` between them."""
    gender = lambda h: F.when(h.isin(HONORIFICS["m"]), "m").when(h.isin(HONORIFICS["f"]), "f").otherwise("n")
    may_name = F.col("t").rlike(f"(?:{ANY_HONORIFIC})\\.? \\p{{Lu}}")
    named = F.zip_with(
        F.regexp_extract_all("t", F.lit(NAMED), F.lit(1)), F.regexp_extract_all("t", F.lit(NAMED), F.lit(2)),
        lambda h, names: F.transform(F.split(names, " "), lambda x: F.struct(F.lower(x).alias("x"), x.alias("spelled"), gender(h).alias("gender"))))
    named = F.when(may_name, F.flatten(named))
    first = docs.withColumn("t", text).withColumn("named", named)
    spelled = F.array_sort(F.array_distinct(F.flatten(F.transform("named", lambda n: F.array(n["spelled"], F.upper(n["spelled"]))))), lambda a, b: F.length(b) - F.length(a))
    pattern = F.when(F.size("named") > 0, F.concat(F.lit(f"{PATTERN}|(?<!\\p{{L}})(?:"), F.array_join(spelled, "|"), F.lit(")(?!\\p{L})"))).otherwise(F.lit(PATTERN))
    second = first.withColumn("pattern", pattern)
    third = second.withColumn("xs", F.coalesce(F.regexp_extract_all("t", F.col("pattern"), F.lit(0)), F.array().cast("array<string>")))
    known = lambda x: F.when(_kind(x) == "name", F.coalesce(F.get(F.filter("named", lambda n: n["x"] == F.lower(x)), F.lit(0))["gender"], F.lit("n"))).otherwise("")
    mentions = F.transform("xs", lambda x: F.struct(x.alias("x"), _kind(x).alias("kind"), _canonical(x, _kind(x)).alias("canon"), known(x).alias("gender")))
    pieces = F.when(F.size("xs") > 0, F.split("t", F.col("pattern"))).otherwise(F.array("t"))
    return third.select(*docs.columns, "t", mentions.alias("mentions"), pieces.alias("pieces"))


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """Entities with the ``attempt`` at which their surrogates are distinct and new to the data."""
    state = cut_lineage(entities.distinct().withColumn("attempt", F.lit(0)))
    while True:
        made = state.withColumn("made", surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt")))
        least = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon", "gender")).alias("stays"))
        own = state.select(F.col("kind").alias("k"), F.col("canon").alias("c")).distinct()
        judged = made.join(least, ["kind", "made"]).join(own, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("c")), "left")
        clash = (F.col("stays") != F.struct("attempt", "canon", "gender")) | F.col("c").isNotNull()
        judged = cut_lineage(judged.select("kind", "canon", "gender", "attempt", clash.alias("clash")))
        if not judged.filter("clash").limit(1).count():
            return state
        state = judged.select("kind", "canon", "gender", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``clean_text``, ``n_entities`` and ``kinds`` (how often each kind stood in the text).

    Found are e-mail and IP addresses, bank accounts, cards, social security and telephone numbers, long
    hexadecimal secrets, and names: the capitalised words after an honorific, and their later mentions in the same text.
    Domains keep their identity under ``.example``; cards stay valid if they were; the first digit of numbers stays.

    NULL text stays NULL and has no entities. Rows with equal text are rewritten equally. An empty table
    gives an empty one. Input columns named like an added one are replaced.
    """
    added = ["clean_text", "n_entities", "kinds"]
    own = [c for c in docs.columns if c.lower() not in added]
    framed = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), F.col(ident).alias("i"), F.xxhash64(text).alias("d"))
    found = _found(framed, F.col("row")[text])
    entities = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.canon", "m.gender")
    late = _settled(entities, key).filter("attempt > 0")
    empty = F.array().cast("array<struct<kind:string,canon:string,gender:string,attempt:int>>")
    if late.limit(1).count():
        spread = found.select("i", "d", F.explode("mentions").alias("m")).select("i", "d", "m.kind", "m.canon", "m.gender").distinct()
        by_doc = spread.join(late.hint("rebalance"), ["kind", "canon", "gender"]).groupBy("i", "d").agg(F.collect_list(F.struct("kind", "canon", "gender", "attempt")).alias("late"))
        met = found.alias("a").join(by_doc.alias("b"), F.col("a.i").eqNullSafe(F.col("b.i")) & F.col("a.d").eqNullSafe(F.col("b.d")), "left").select("row", "mentions", "pieces", F.coalesce("late", empty).alias("late"))
    else:
        met = found.select("row", "mentions", "pieces", empty.alias("late"))
    tries = lambda m: F.coalesce(F.get(F.filter("late", lambda e: (e["kind"] == m["kind"]) & (e["canon"] == m["canon"]) & (e["gender"] == m["gender"])), F.lit(0))["attempt"], F.lit(0))
    made = F.transform("mentions", lambda m: _formed(m["x"], m["kind"], surrogate(key, m["kind"], m["canon"], m["gender"], tries(m))))
    kinds = F.transform("mentions", lambda m: m["kind"])
    named = met.select("row", "pieces", made.alias("made"), kinds.alias("kinds"))
    joined = F.array_join(F.flatten(F.zip_with("pieces", "made", lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("kinds")), lambda k: F.struct(k, F.size(F.filter("kinds", lambda x: x == k)))))
    return named.select(
        *[F.col("row")[c].alias(c) for c in own], F.when(F.col("row")[text].isNotNull(), joined).alias("clean_text"),
        F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("n_entities"), counts.alias("kinds"))
