"""Chat formatting with shared beginnings: conversations that begin alike share the formatted turns, written once.

A conversation is a path in a prefix tree whose nodes are formatted turns. A node is known by its depth
and a hash of all turns down to it, and belongs to the least conversation that passes it. What belongs to
one conversation is a run: the end of its path, from where it leaves the path of another. Depth first, a
run is written as a whole, then what branches off it, the deepest branch first. So a node's ancestors are
one interval of the stream for each run on its path, however long the path is.

Everything is a DataFrame operation; only the digests of whole conversations are taken in Python.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landsift.llm.words import bounded_batches
from landsift.session import cut_lineage, shared_folder

START, END = "<|im_start|>", "<|im_end|>\n"
NONE = -(1 << 63)  # stands for a NULL conversation or turn
SPAN_BITS = 10  # turns of 2^10 numbers are numbered together
BLOCK_BITS = 10  # characters of the stream that meet on one key when it is read


# ---- template ----


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash more stands between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As a text, and on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a pair of backslashes is one, so what follows it is no line break
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, t, role, text, piece, n (characters), loss_from and loss_to (within the piece; equal without loss)."""
    said, named = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    framed = turns.select(F.coalesce(F.col(conv).cast("long"), F.lit(NONE)).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(NONE)).alias("t"), named.alias("role"), said.alias("text"))
    escaped = framed.select("*", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    first = F.length("head").cast("long")
    last = first + F.when(F.col("role") == "assistant", F.length("body")).otherwise(0)
    whole = F.concat("head", "body", F.lit(END))
    return escaped.select("c", "t", "role", "text", whole.alias("piece"), F.length(whole).cast("long").alias("n"), first.alias("loss_from"), last.alias("loss_to"))


def parsed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with role, text and loss (the unescaped text under the mask)."""
    body = F.substring("piece", len(START) + 1, F.length("piece") - len(START) - len(END))
    cut = F.instr(body, "\n")
    loss = F.substring(F.col("piece"), F.col("loss_from").cast("int") + 1, (F.col("loss_to") - F.col("loss_from")).cast("int"))
    return pieces.select("*", unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"), unescape(loss).alias("loss"))


# ---- the tree ----


def _before(sums: DataFrame, **columns: Column) -> DataFrame:
    """What lies in the earlier spans of a conversation, for spans that have any; one row a span comes in."""
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sums.select("c", "b", *[c.over(earlier).alias(n) for n, c in columns.items()], F.lag(F.lit(True)).over(Window.partitionBy("c").orderBy("b")).alias("later"))
    return ranked.filter("later").drop("later").hint("rebalance")


def _numbered(pieces: DataFrame) -> DataFrame:
    """Turns with their place k in the conversation. Spans of turn numbers are sorted alone."""
    spans = pieces.withColumn("b", F.shiftright("t", SPAN_BITS))
    inside = Window.partitionBy("c", "b").orderBy("t", "role", "text")
    placed = spans.withColumn("i", F.row_number().over(inside).cast("long"))
    offsets = _before(spans.groupBy("c", "b").agg(F.count(F.lit(1)).alias("size")), skipped=F.sum("size"))
    said = [F.xxhash64("piece").alias("e1"), F.xxhash64(F.lit("second"), "piece").alias("e2")]
    return placed.join(offsets, ["c", "b"], "left").select("c", "b", (F.col("i") + F.coalesce("skipped", F.lit(0))).alias("k"), "piece", "n", "loss_from", "loss_to", *said)


def _paths(turns: DataFrame) -> DataFrame:
    """c, k, n, pos (characters before the turn) and owner of every turn. Prefixes are told apart by 128 bits."""
    narrow = turns.select("c", "b", "k", "n", F.xxhash64("k", "e1", "e2").alias("h1"), F.xxhash64(F.lit("second"), "k", "e2", "e1").alias("h2"))
    upto = Window.partitionBy("c", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = narrow.select("c", "b", "k", "n", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"), F.sum("n").over(upto).alias("end"))
    spans = narrow.groupBy("c", "b").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("n").alias("n"))
    offsets = _before(spans, y1=F.bit_xor("h1"), y2=F.bit_xor("h2"), skipped=F.sum("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = inside.join(offsets, ["c", "b"], "left").select(
        "c", "k", "n", (F.col("end") - F.col("n") + zero("skipped")).alias("pos"),
        F.col("x1").bitwiseXOR(zero("y1")).alias("x1"), F.col("x2").bitwiseXOR(zero("y2")).alias("x2"))
    owners = known.groupBy("k", "x1", "x2").agg(F.min("c").alias("owner")).hint("rebalance")
    return known.join(owners, ["k", "x1", "x2"]).select("c", "k", "n", "pos", "owner")


def _ends(paths: DataFrame) -> DataFrame:
    """One row a conversation: its path's last owner, and its own run, if it has one: depth, place, length and whose path it leaves."""
    own = F.col("owner") == F.col("c")
    return paths.groupBy("c").agg(
        F.max_by("owner", "k").alias("leaf"), F.count(F.lit(1)).alias("n_turns"), F.max(F.col("pos") + F.col("n")).alias("end"),
        F.min(F.when(own, F.col("k"))).alias("depth"), F.min(F.when(own, F.col("pos"))).alias("origin"),
        F.sum(F.when(own, F.col("n"))).alias("size"), F.max_by("owner", F.when(~own, F.col("k"))).alias("parent"))


def _chained(runs: DataFrame) -> DataFrame:
    """Runs with all runs above them, from the root down to themselves. Pointers double, so rounds are few."""
    step = F.struct((-F.col("depth")).alias("deepest"), F.col("c").alias("run"), "origin")
    chained = cut_lineage(runs.select("c", "origin", "size", F.col("parent").alias("up"), F.array(step).alias("chain")))
    while not chained.filter("up IS NOT NULL").isEmpty():
        above = chained.select(F.col("c").alias("up"), F.col("chain").alias("upper"), F.col("up").alias("further")).hint("rebalance")
        met = chained.join(above, "up", "left")
        chained = cut_lineage(met.select("c", "origin", "size", F.col("further").alias("up"), F.when(F.col("upper").isNull(), F.col("chain")).otherwise(F.concat("upper", "chain")).alias("chain")))
    return chained.drop("up")


def _placed(chained: DataFrame) -> DataFrame:
    """Runs with their place in the depth-first stream. Each task adds up its own; a row a task is added up in one place."""
    dealt = chained.repartitionByRange("chain").sortWithinPartitions("chain")
    rows = cut_lineage(dealt.select("*", F.monotonically_increasing_id().alias("row"))).withColumn("part", F.shiftright("row", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("size").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return summed.join(parts, "part").select("c", "origin", "size", "chain", (F.col("first") + F.col("inside")).alias("start"))


def _intervals(placed: DataFrame) -> DataFrame:
    """run, stream_start, position, size, and ancestors: the intervals of the stream that hold its ancestors."""
    steps = placed.select("c", F.posexplode("chain").alias("i", "step"), (F.col("chain")).alias("chain"))
    above = steps.filter(F.col("i") < F.size("chain") - 1).select("c", "i", F.col("step.run").alias("run"), F.get("chain", F.col("i") + 1)["origin"].alias("cut"))
    starts = placed.select(F.col("c").alias("run"), F.col("start").alias("from"), "origin").hint("rebalance")
    met = above.join(starts, "run").select("c", F.struct("i", "from", (F.col("from") + F.col("cut") - F.col("origin")).alias("to")).alias("x"))
    gathered = met.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("x"))
    kept = F.transform(F.coalesce("x", F.array().cast("array<struct<i:int,from:bigint,to:bigint>>")), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))
    return placed.join(gathered, "c", "left").select(F.col("c").alias("run"), F.col("start").alias("stream_start"), F.col("origin").alias("position"), "size", kept.alias("ancestors"))


def write_chats(turns: DataFrame, path: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> str:
    """Format all conversations, merge what they share, and write the tree; gives the folder.

    A turn is ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. Control strings inside roles and texts get
    a backslash more, which reading takes away. The characters are the tokens: ``nodes`` holds each formatted
    turn of the tree once, in order of ``stream_start``, with the ``position`` of its first character in every
    conversation that has it (the others follow one by one) and the part of it under the loss mask (texts of
    ``assistant``). ``runs`` gives for each run of nodes the stretches of the stream that hold its ancestors;
    a character sees these and its own run up to itself. ``conversations`` names the run each one ends in, and where.

    Turns stand in order of ``turn`` (NULL first), then role, then text; NULL roles and texts are empty; a NULL
    ``conv`` is a conversation of its own, with the least number. Repeated rows are turns of their own. An empty
    table writes empty tables; further columns are not read, whatever their names. A text has no limit but must
    fit a task several times over; of a conversation only turns of one number, or of 1,024 neighbouring
    ones, are sorted in one task.
    """
    spark = turns.sparkSession
    path = path or f"{shared_folder(spark)}/chats-{uuid.uuid4().hex}"
    work = f"{shared_folder(spark)}/chat-work-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str, to: str = work) -> DataFrame:
        df.write.parquet(f"{to}/{name}")
        return spark.read.parquet(f"{to}/{name}")

    numbered = kept(_numbered(formatted(turns, conv, turn, role, text)), "turns")
    paths = kept(_paths(numbered), "paths")
    ends = kept(_ends(paths), "ends")
    runs = kept(_intervals(_placed(_chained(ends.filter("depth IS NOT NULL")))), "runs", path)
    ends.select(F.col("c").alias("conv"), F.col("leaf").alias("run"), "n_turns", "end").write.parquet(f"{path}/conversations")
    starts = runs.select(F.col("run").alias("c"), "stream_start", F.col("position").alias("origin")).hint("rebalance")
    own = paths.filter("owner = c").join(starts, "c").select("c", "k", (F.col("stream_start") + F.col("pos") - F.col("origin")).alias("stream_start"), F.col("pos").alias("position"))
    nodes = numbered.join(own, ["c", "k"]).select("stream_start", "position", F.col("c").alias("run"), "n", "loss_from", "loss_to", "piece")
    nodes.repartitionByRange("stream_start").sortWithinPartitions("stream_start").write.parquet(f"{path}/nodes")
    return path


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """conv, position, piece, role, text, loss of every turn of every conversation, found by the attention intervals.

    An interval asks for the blocks of the stream it touches; a node lies in the block of its first character.
    """
    nodes, runs, convs = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "runs", "conversations"))
    own = F.struct(F.col("stream_start").alias("from"), (F.col("stream_start") + F.col("end") - F.col("position")).alias("to"))
    seen = convs.join(runs.hint("rebalance"), "run").select("conv", F.explode(F.concat("ancestors", F.array(own))).alias("x")).select("conv", "x.from", "x.to")
    asked = seen.filter(F.col("from") < F.col("to")).select("*", F.explode(F.sequence(F.shiftright("from", BLOCK_BITS), F.shiftright(F.col("to") - 1, BLOCK_BITS))).alias("block"))
    kept = nodes.withColumn("block", F.shiftright("stream_start", BLOCK_BITS)).hint("rebalance")
    met = asked.join(kept, "block").filter((F.col("stream_start") >= F.col("from")) & (F.col("stream_start") < F.col("to")))
    return parsed(met.select("conv", "position", "piece", "loss_from", "loss_to"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns come in order, one turn at a time."""

    def row() -> pa.RecordBatch:
        values = [conv, turns, said.hexdigest(), lost, loss.hexdigest(), chars]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    conv = None
    for batch in batches:
        for c, role, text, under, n in zip(*[batch.column(k).to_pylist() for k in ("conv", "role", "text", "loss", "n")], strict=True):
            if c != conv:
                if conv is not None:
                    yield row()
                conv, turns, lost, chars, said, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            said.update(f"{role}\n{text}\n".encode())
            loss.update(under.encode())
            turns, lost, chars = turns + 1, lost + len(under), chars + n
    if conv is not None:
        yield row()


def digested(spark: SparkSession, path: str) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations, read back."""
    bounded_batches(spark)
    turns = read_turns(spark, path).select("conv", "position", "role", "text", "loss", F.length("piece").cast("long").alias("n"))
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "position").drop("position")
    return ordered.mapInArrow(_digest, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
