"""Line deduplication: lines that stand in many documents go from all of them.

DataFrame functions only. What is counted is narrow (a line's digest and its document), so a line
found in a third of all documents is summed by each task before it moves. Texts move once at most,
to meet the places of their dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case; other letters stay."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def drop_common_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_dropped``.

    A key of ``min_chars`` code points or more that is found in ``min_docs`` documents or more loses
    all its lines. Documents are told apart by ``ident``: rows that repeat an id count once, NULL is
    one id of its own. NULL and empty texts are one empty line; NULL stays NULL in ``clean_text``
    only if ``n_dropped`` is 0. An input column named like an added one is replaced. Keys are told
    apart by a 128-bit digest.
    """
    added = {"clean_text", "n_lines", "n_dropped"}
    # a document is its id and its text: rows equal in both lose the same lines
    framed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c.lower() not in added or c in (ident, text)]).alias("row"),
        F.col(ident).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).select("*", F.unhex(F.md5("t")).alias("d"))
    keyed = framed.select("i", "d", F.posexplode(F.split("t", "\n")).alias("pos", "line")).select("i", "d", "pos", line_key(F.col("line")).alias("k"))
    lines = keyed.filter(F.length("k") >= min_chars).select("i", "d", "pos", F.unhex(F.md5("k")).alias("h"))
    common = lines.select("h", "i").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h")
    dropped = lines.join(common, "h").select("i", "d", "pos").groupBy("i", "d").agg(F.collect_set("pos").alias("gone"))

    cut = F.split("t", "\n")
    whole = framed.select("row", "i", "d", cut.alias("l"))
    met = whole.alias("a").join(dropped.alias("b"), F.col("a.i").eqNullSafe(F.col("b.i")) & (F.col("a.d") == F.col("b.d")), "left").select("row", "l", "gone")
    n = F.size("l")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col("gone"), F.array().cast("array<int>")))
    kept = met.select("row", "l", stay.alias("stay"))
    out = kept.select(
        "row", F.array_join(F.transform("stay", lambda p: F.col("l")[p]), "\n").alias("clean_text"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("stay")).cast("long").alias("n_dropped"),
    )
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    null = F.col("row")[text].isNull() & (F.col("n_dropped") == 0)
    return out.select(*own, F.when(~null, F.col("clean_text")).alias("clean_text"), "n_lines", "n_dropped")
