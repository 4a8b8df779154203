"""Line-first quality rules: judge every line, drop the failing ones, then judge what the document lost.

DataFrame functions only, one row at a time: no shuffle, and every step is linear in the text apart
from one sort of its three-word windows, so the work of a document depends on that document alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]"
MARKS = "#*$%&|<>"

# Marks that end a sentence, menu words and stock phrases that are not prose.
SENTENCE_END = "[.!?…。！？؟।][\"'”’»)\\]]*$"
MENU_WORDS = "home|menu|search|login|log in|logout|sign in|sign up|register|contact|about|about us|help|faq|next|previous|back|top|share|print|sitemap|archive|cart"
STOCK_PHRASES = (
    "all rights reserved|copyright|©|licensed under|license, version|is licensed|privacy policy|cookie policy|use cookies|"
    "terms of use|terms of service|enable javascript|click here|read more|subscribe to|lorem ipsum"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the method; percentages are whole numbers, so that equality is exact.

    A line fails ``punctuation`` without a mark that ends a sentence or when more than
    ``max_mark_pct`` percent of its word characters are ``#*$%&|<>``, ``navigation`` with
    ``separators`` or more of ``|``, ``>``, ``»``, ``•`` between words or as a menu word alone,
    ``boilerplate`` with a stock phrase. A document is rejected when the failing lines hold more
    than ``max_lost_pct`` percent of its word characters.
    """

    separators: int = 2
    max_mark_pct: int = 10
    max_lost_pct: int = 50
    min_words: int = 50
    max_repeat_pct: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def _punctuation(line: Column, rules: LineRules) -> Column:
    marks = F.length(F.regexp_replace(line, f"[^{MARKS}]+", ""))
    return ~line.rlike(SENTENCE_END) | (100 * marks > rules.max_mark_pct * F.length(F.regexp_replace(line, f"{SPACE}+", "")))


def _navigation(line: Column, rules: LineRules) -> Column:
    menu = f"(?i)^(?:{MENU_WORDS})[.!?]?$"
    separated = f"(?:[^|>»•]*[|>»•]){{{rules.separators},}}"
    return line.rlike(menu) | line.rlike(f"^{separated}")


def _boilerplate(line: Column) -> Column:
    return line.rlike(f"(?i)(?:{STOCK_PHRASES})")


def judge(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with the figures and the verdict of every document.

    Added: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines`` (lines with a word), ``n_failed_lines``, ``lost_chars``, ``clean_text`` (the lines
    that passed, blank ones included, joined by newline), ``base_failed``, ``kept``.

    NULL text counts as no words: all figures are 0, ``clean_text`` is NULL, ``base_failed`` holds.
    An input column named like an added one is replaced. Repeated rows are judged one by one; an
    empty table gives an empty table. Texts have no length limit but must fit a task's memory
    several times over, as any row does.
    """
    whole = F.coalesce(F.col("t"), F.lit(""))
    framed = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))

    # words with their windows: zip_with pads with NULL, so the last two windows are NULL
    split = framed.select("*", words_of(F.col("t")).alias("w"), F.split(whole, "\n").alias("l"))
    after = lambda k: F.slice(F.col("w"), k, F.greatest(F.size("w"), F.lit(1)))
    pairs = F.zip_with(F.col("w"), after(2), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.zip_with(pairs, after(3), lambda ab, c: F.concat(ab, F.lit(" "), c))
    placed = F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    with_word = F.filter(F.col("l"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    stripped = F.transform(F.col("l"), lambda x: F.struct(x.alias("x"), F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "").alias("s")))
    measured = split.select(
        "row", "t", F.size("w").cast("long").alias("n"), F.length(F.array_join("w", "")).cast("long").alias("chars"),
        F.length(F.regexp_replace(whole, f"[^{MARKS}]+", "")).cast("long").alias("symbols"),
        F.sort_array(placed).alias("s"), with_word.alias("lw"), stripped.alias("ls"),
    )

    # equal neighbours of the sorted windows are repeats; their places come back in order
    behind = F.slice(F.col("s"), 2, F.greatest(F.size("s"), F.lit(1)))
    equal = F.zip_with(F.col("s"), behind, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    failed = F.transform(F.col("ls"), lambda x: F.struct(
        x["x"].alias("x"), F.length(F.regexp_replace(x["s"], f"{SPACE}+", "")).cast("long").alias("c"),
        ((x["s"] != "") & (_punctuation(x["s"], rules) | _navigation(x["s"], rules) | _boilerplate(x["s"]))).alias("f"),
    ))
    found = measured.select(
        "row", "t", "n", "chars", "symbols", places.alias("p"), failed.alias("lf"),
        F.size("lw").cast("long").alias("lines"), (F.size("lw") - F.size(F.array_distinct("lw"))).cast("long").alias("dups"),
    )
    next_place = F.slice(F.col("p"), 2, F.greatest(F.size("p"), F.lit(1)))
    steps = F.zip_with(F.col("p"), next_place, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    bad = F.filter(F.col("lf"), lambda x: x["f"])
    summed = found.select(
        "row", "t", "n", "chars", "symbols", "lines", "dups",
        F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("repeats"),
        F.size(bad).cast("long").alias("failed"), F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("lost"),
        F.when(F.col("t").isNotNull(), F.array_join(F.transform(F.filter(F.col("lf"), lambda x: ~x["f"]), lambda x: x["x"]), "\n")).alias("clean"),
    )
    base = (F.col("n") < rules.min_words) | (100 * F.col("repeats") > rules.max_repeat_pct * F.col("n"))
    verdict = ~base & (100 * F.col("lost") <= rules.max_lost_pct * F.col("chars"))
    added = {
        "n_words": F.col("n"), "word_chars": F.col("chars"), "n_symbols": F.col("symbols"), "n_dup_lines": F.col("dups"),
        "n_repeat_words": F.col("repeats"), "n_lines": F.col("lines"), "n_failed_lines": F.col("failed"),
        "lost_chars": F.col("lost"), "clean_text": F.col("clean"), "base_failed": base, "kept": verdict,
    }
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return summed.select(*own, *[c.alias(n) for n, c in added.items()])


def passed(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The rows of ``judge`` that are kept.

    A plain filter would be pushed below the projections of ``judge`` and repeat them wherever their
    results are named; a generator that gives no row for a rejected document is not.
    """
    judged = judge(docs, rules, text)
    return judged.select(F.inline(F.when(F.col("kept"), F.array(F.struct(*[F.col(f"`{c}`") for c in judged.columns])))))
