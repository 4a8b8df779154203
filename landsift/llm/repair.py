"""Conversation structure repair: the cheapest edits that make the turns go system, user, assistant, user, assistant ...

A repaired conversation is read by four states: nothing yet (0), after system (1), after user (2), after
assistant (3, where it may end; it may also stay empty). For a stretch of turns the cost of reaching
every state from the left and of ending from every state to the right are four numbers each. They meet
in the middle; of the crossings of least cost the one with the least list of edits is taken, and both
halves are solved alone (Hirschberg), so no table of states by turns is kept.

Conversations are dealt by range of turn, so a long one lies in several tasks. Stretches of bounded size
are what tasks hold. A conversation that is one stretch is solved where it lies; of any other each
stretch is summed up in a few numbers, the states between the stretches are chosen from these, and then
every stretch is solved alone, in a task of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.words import bounded_batches
from landsift.session import shared_folder

BLANK = " \t\n\x0b\x0c\r"
STATES = range(4)
FAR = 1 << 60
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 16 << 20
NO_TURN = -(1 << 63)

# What a turn is to the repair: its initial (s, u, a, or o for any other), in upper case if it is
# truncated; x if it must go.
DELETE, TRUNCATED, INSERT, REROLE = 2, 5, 5, 1
ROLE_AFTER = {2: "user", 3: "assistant"}


def _next(state: int) -> int:
    """Where one more user or assistant turn leads."""
    return 3 if state == 2 else 2


@lru_cache(None)
def edits(kind: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """Letter, next state and cost of what may be done with a turn: D delete, K keep, R give another role."""
    out = [("D", state, DELETE)]
    if kind != "x":
        more, initial = (TRUNCATED if kind.isupper() else 0), kind.lower()
        if (initial, state) == ("s", 0):
            out.append(("K", 1, more))
        if initial == ("a" if state == 2 else "u"):
            out.append(("K", _next(state), more))
        out.append(("R", _next(state), REROLE + more))
    return tuple(out)


# A forward vector holds, by state, the cost of the cheapest way there, the rank of its edits up to the last
# turn among those of the other states, and how many inserts follow. A state's edits up to a turn never
# begin another's, so the order is that of (rank, inserts and next letter).
Forward = tuple[tuple[int, int, int] | None, ...]


def _with_inserts(reached: list[tuple[int, int, str] | None]) -> Forward:
    order = sorted({r[1:] for r in reached if r})
    base = [(r[0], order.index(r[1:]), 0) if r else None for r in reached]
    best = list(base)
    for state, found in enumerate(base):
        for k in (1, 2):
            state = _next(state)
            if found and (best[state] is None or (found[0] + INSERT * k, found[1], k) < best[state]):
                best[state] = (found[0] + INSERT * k, found[1], k)
    return tuple(best)


def entered(state: int) -> Forward:
    return tuple((0, 0, 0) if s == state else None for s in STATES)


BEGIN = _with_inserts([(0, 0, ""), None, None, None])  # before the first turn of a conversation


@lru_cache(1 << 16)
def _forward_step(vector: Forward, kind: str) -> tuple[int, Forward]:
    """The vector behind one more turn and the inserts that follow it, its least cost taken off."""
    reached: list[tuple[int, int, str] | None] = [None] * 4
    for state, found in enumerate(vector):
        if found:
            cost, rank, k = found
            for letter, to, more in edits(kind, state):
                new = (cost + more, rank, "I" * k + letter)
                if reached[to] is None or new < reached[to]:
                    reached[to] = new
    out = _with_inserts(reached)
    least = min(f[0] for f in out if f)
    return least, tuple((f[0] - least, *f[1:]) if f else None for f in out)


def forward(kinds: str, vector: Forward) -> Forward:
    total = 0
    for kind in kinds:
        least, vector = _forward_step(vector, kind)
        total += least
    return tuple((f[0] + total, *f[1:]) if f else None for f in vector)


@lru_cache(1 << 16)
def _backward_step(costs: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...], str]:
    """Costs of ending from before a turn, and the least letter that begins a cheapest way, by state."""
    after = [min(costs[s], INSERT + costs[_next(s)], 2 * INSERT + costs[_next(_next(s))]) for s in STATES]
    ways = [[(more + after[to], letter) for letter, to, more in edits(kind, state)] for state in STATES]
    best = [min(w) for w in ways]
    least = min(b[0] for b in best)
    return least, tuple(min(b[0] - least, FAR) for b in best), "".join(b[1] for b in best)


def backward(kinds: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    total, letters = 0, ""
    for kind in reversed(kinds):
        least, costs, letters = _backward_step(costs, kind)
        total += least
    return tuple(min(c + total, FAR) for c in costs), letters


def ends(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else FAR for s in STATES)


MAY_END = (0, FAR, FAR, 0)


def between(kinds: str, first: int, last: int) -> str:
    """The least of the cheapest edits from one state to another, over one turn or more."""
    if len(kinds) == 1:
        ways = []
        for letter, state, cost in edits(kinds, first):
            for k in range(3):
                if state == last:
                    ways.append((cost + INSERT * k, letter + "I" * k))
                state = _next(state)
        return min(ways)[1]
    middle = len(kinds) // 2
    left, right = kinds[:middle], kinds[middle:]
    there, (rest, letters) = forward(left, entered(first)), backward(right, ends(last))
    crossing = min((f[0] + rest[s], f[1], "I" * f[2] + letters[s], s) for s, f in enumerate(there) if f)[3]
    return between(left, first, crossing) + between(right, crossing, last)


@lru_cache(1 << 14)
def _solved(kinds: str) -> tuple[int, str]:
    rest, letters = backward(kinds, MAY_END)
    cost, _, _, first = min((f[0] + rest[s], f[1], "I" * f[2] + letters[s], s) for s, f in enumerate(BEGIN) if f)
    last = min((f, s) for s, f in enumerate(forward(kinds, entered(first))) if f and MAY_END[s] == 0)[1]
    return cost, "I" * BEGIN[first][2] + between(kinds, first, last)


def solve(kinds: str) -> tuple[int, str]:
    """Cost and edits (D, I, K, R) of a whole conversation; of equally cheap ones the least in ASCII."""
    return _solved(kinds) if kinds else (0, "")


def summary(kinds: str) -> list[int]:
    """For each state before and after: cost, rank, inserts at the end, first letter; what ``choose`` needs."""
    firsts = [backward(kinds, ends(last))[1] for last in STATES]
    out = []
    for first in STATES:
        for last, f in enumerate(forward(kinds, entered(first))):
            out += [*f, ord(firsts[last][first])] if f else [FAR, 0, 0, 0]
    return out


def choose(summaries: list[list[int]]) -> tuple[int, list[int]]:
    """Cost, and the state before the first stretch, between the stretches and behind the last."""
    begin = [x for first in STATES for last in STATES for x in ([*BEGIN[last], ord("I")] if first == 0 and BEGIN[last] else [FAR, 0, 0, 0])]
    stretches = [begin, *summaries]
    costs, letters = [MAY_END], [[""] * 4]
    for m in reversed(stretches):
        ways = [[(m[16 * a + 4 * b] + costs[-1][b], b) for b in STATES] for a in STATES]
        least = [min(w)[0] for w in ways]
        # a stretch without an edit of its own (no insert before the first turn) begins as what follows
        letters.append([min((letters[-1][b] if m is begin and m[16 * a + 4 * b + 2] == 0 else chr(m[16 * a + 4 * b + 3])) if c < FAR else "~" for c, b in ways[a] if c == least[a]) for a in STATES])
        costs.append(tuple(min(c, FAR) for c in least))
    costs.reverse()
    letters.reverse()
    state, path = 0, []
    for i, m in enumerate(stretches):
        state = min((m[16 * state + 4 * b + 1], "I" * m[16 * state + 4 * b + 2] + letters[i + 1][b], b) for b in STATES
                    if m[16 * state + 4 * b] + costs[i + 1][b] == costs[i][state])[2]
        path.append(state)
    return costs[0][0], path


# ---- in tasks ----

FLAGS = ("blank", "duplicate", "truncated", "illegal")


def _faults(faults: str, marks: list[bytes]) -> str:
    """b blank, d said before, t truncated, . none; each turn's first."""
    seen: set[bytes] = set()
    out = []
    for fault, mark in zip(faults, marks, strict=True):
        out.append("d" if fault != "b" and mark in seen else fault)
        seen.add(mark)
    return "".join(out)


def kinds_of(initials: str, faults: str) -> str:
    return "".join("x" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initials, faults, strict=True))


def _illegal(initials: str) -> int:
    return sum(initials[k:k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


SEGMENT = (
    "conv_key struct<id: {ident}>, first_row long, whole boolean, initials string, faults string, turns array<long>, marks array<binary>, "
    "cost long, audit string, rows array<struct<role: string, text: string>>"
)


def _rows(roles: pa.Array, texts: pa.Array, offsets: list[int]) -> pa.Array:
    pairs = pa.StructArray.from_arrays([roles.cast(pa.string()), texts.cast(pa.string())], names=["role", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def _apply(audit: str, initials: str, state: int, base: int, sources: list[int | None], roles: list[str | None]) -> None:
    """Append, for each turn of a repaired stretch, the row its text comes from (None: no text) and its role (None: as it was)."""
    at = base
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        state = 1 if letter == "K" and initials[at - base] == "s" else _next(state)
        roles.append(None if letter == "K" else ROLE_AFTER[state])
        sources.append(None if letter == "I" else at)
        at += letter != "I"


def _stretches(table: pa.Table, rows: int, size: int) -> list[int]:
    """Where a new conversation begins or a stretch is full; 0 first."""
    c = table.column("c").combine_chunks() if table.num_rows else table.column("c")
    n = len(c)
    null = pc.is_null(c).to_numpy(zero_copy_only=False)
    same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] & null[:-1])
    heads = np.concatenate(([0], np.flatnonzero(~same) + 1, [n]))
    weight = np.concatenate(([0], np.cumsum(pc.binary_length(table.column("text")).to_numpy().astype(np.int64))))
    out = []
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        while a < b:
            out.append(a)
            a = min(b, a + rows, max(a + 1, int(np.searchsorted(weight, weight[a] + size, side="right")) - 1))
    return out


def _pack(rows: int, size: int):
    """Sorted turns to stretches. The first and the last conversation of a task may go on in others, so they stay unsolved."""

    def emit(table: pa.Table, cuts: list[int], opened: set[int]) -> pa.RecordBatch:
        faults, initials = "".join(table.column("fault").to_pylist()), "".join(table.column("initial").to_pylist())
        turns, marks = table.column("turn"), table.column("mark")
        spoken = marks.to_pylist()
        ends_, sources, new_roles, offsets = [*cuts[1:], table.num_rows], [], [], [0]
        whole, fault_of, cost_of, audit_of, turn_at, mark_at = [], [], [], [], [], []
        for k, (a, b) in enumerate(zip(cuts, ends_, strict=True)):
            part, begin = faults[a:b], initials[a:b]
            whole.append(k not in opened)
            if k in opened:
                fault_of.append(part)
                cost_of.append(None)
                audit_of.append(None)
                sources.extend(range(a, b))
                new_roles.extend([None] * (b - a))
            else:
                part = _faults(part, spoken[a:b])
                cost, audit = solve(kinds_of(begin, part))
                fault_of.append(part)
                cost_of.append(cost)
                audit_of.append(audit)
                _apply(audit, begin, 0, a, sources, new_roles)
            offsets.append(len(sources))
        taken = pa.array(sources, pa.int64())
        role = pc.coalesce(pa.array(new_roles, pa.string()), table.column("role").combine_chunks().take(taken).cast(pa.string()))
        text = pc.fill_null(table.column("text").combine_chunks().take(taken), "")
        bounds = pa.array([*cuts, table.num_rows], pa.int32())
        # the marks of solved stretches are not needed again
        open_marks = pa.array([spoken[a:b] if k in opened else None for k, (a, b) in enumerate(zip(cuts, ends_, strict=True))], pa.list_(pa.binary()))
        at = pa.array(cuts, pa.int64())
        key = table.column("c").combine_chunks().take(at)
        return pa.RecordBatch.from_arrays([
            pa.StructArray.from_arrays([key], names=["id"]), table.column("row").combine_chunks().take(at), pa.array(whole, pa.bool_()),
            pa.array([initials[a:b] for a, b in zip(cuts, ends_, strict=True)], pa.string()), pa.array(fault_of, pa.string()),
            pa.ListArray.from_arrays(bounds, turns.combine_chunks()), open_marks,
            pa.array(cost_of, pa.int64()), pa.array(audit_of, pa.string()), _rows(role, text, offsets),
        ], names=["conv_key", "first_row", "whole", "initials", "faults", "turns", "marks", "cost", "audit", "rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, going = None, True  # going: what comes first may have begun before, in another task or as a stretch already given
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            rest = rest.combine_chunks()
            if not rest.num_rows:
                continue
            cuts = _stretches(rest, rows, size)
            if len(cuts) == 1:
                continue
            last, ids = cuts[-1], rest.column("c").take(pa.array(cuts)).to_pylist()
            opened = {k for k in range(len(cuts) - 1) if ids[k] == ids[k + 1] or (ids[k] == ids[k - 1] if k else going)}
            yield emit(rest.slice(0, last), cuts[:-1], opened)
            going = ids[-2] == ids[-1]
            rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield emit(rest.combine_chunks(), [0], {0})

    return work


OPEN = "conv_key struct<id: {ident}>, first_row long, initial string, final string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, low long, high long, distinct long, turn_first long, turn_last long, m array<long>"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of figures for every stretch of a conversation that has several."""
    for batch in batches:
        for k in range(batch.num_rows):
            initials, faults = batch.column("initials")[k].as_py(), batch.column("faults")[k].as_py()
            turns = batch.column("turns")[k].values.to_numpy()
            turns = turns[turns != NO_TURN]
            some = [turns[0], turns[-1], 1 + int((turns[1:] != turns[:-1]).sum()), turns[0], turns[-1]] if len(turns) else [None, None, 0, None, None]
            values = [initials[0], initials[-1], faults.count("b"), faults.count("d"), faults.count("t"), _illegal(initials), *some, summary(kinds_of(initials, faults))]
            names = ["initial", "final", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "low", "high", "distinct", "turn_first", "turn_last", "m"]
            types = [pa.string(), pa.string(), *[pa.int64()] * 9, pa.list_(pa.int64())]
            row = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([row.column("conv_key"), row.column("first_row"), *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], names=["conv_key", "first_row", *names])


CHOSEN = "conv_key struct<id: {ident}>, first_row long, before long, after long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states around every stretch; figures of the whole conversation stand with its first."""

    def finish(key: pa.Array, rows: list[dict]) -> pa.RecordBatch:
        cost, path = choose([r["m"] for r in rows])
        figures = {name: sum(r[f"n_{name}"] for r in rows) for name in FLAGS}
        figures["illegal"] += sum(_illegal(a["final"] + b["initial"]) for a, b in zip(rows[:-1], rows[1:], strict=True))
        timed = [r for r in rows if r["distinct"]]
        distinct = sum(r["distinct"] for r in timed) - sum(a["turn_last"] == b["turn_first"] for a, b in zip(timed[:-1], timed[1:], strict=True))
        gaps = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
        alone = [None] * (len(rows) - 1)
        columns = [[r["first_row"] for r in rows], path[:-1], path[1:], *[[v, *alone] for v in (gaps, *[figures[f] for f in FLAGS], cost)]]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([key] * len(rows)), *[pa.array(c, pa.int64()) for c in columns]],
            names=["conv_key", "first_row", "before", "after", "gaps", *FLAGS, "cost"])

    key, rows = None, []
    for batch in batches:
        for k, row in enumerate(batch.to_pylist()):
            if rows and row["conv_key"] != rows[-1]["conv_key"]:
                yield finish(key, rows)
                rows = []
            key = batch.column("conv_key").slice(k, 1)
            rows.append(row)
    if rows:
        yield finish(key, rows)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired turns of a stretch between its two states."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            before, after, leads = (row.column(c)[0].as_py() for c in ("before", "after", "leads"))
            initials, faults, rows = row.column("initials")[0].as_py(), row.column("faults")[0].as_py(), row.column("rows").flatten()
            lead = BEGIN[before][2] if leads else 0
            audit = "I" * lead + between(kinds_of(initials, faults), before, after)
            sources: list[int | None] = []
            roles: list[str | None] = []
            _apply(audit, initials, 0 if leads else before, 0, sources, roles)
            taken = pa.array(sources, pa.int64())
            role = pc.coalesce(pa.array(roles, pa.string()), rows.field("role").take(taken).cast(pa.string()))
            text = pc.fill_null(rows.field("text").take(taken), "")
            yield pa.RecordBatch.from_arrays(
                [row.column("conv_key"), row.column("first_row"), pa.array([audit], pa.string()), _rows(role, text, [0, len(sources)])],
                names=["conv_key", "first_row", "audit", "rows"])


# ---- the operator ----


@dataclass
class Repaired:
    """``report``: a row per conversation with gaps, blank, duplicate, truncated, illegal, cost. ``pieces``: its stretches in
    order of ``piece``, with their edits (``audit``) and the repaired turns (``rows``: role, text); ``whole`` marks a
    conversation that is one stretch."""

    report: DataFrame
    pieces: DataFrame


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> Repaired:
    """Find the faults of every conversation and the cheapest edits that repair it.

    Turns stand in order of ``turn`` (NULL first), then role, then text. A NULL role or text is one blank; a
    NULL ``conv`` is a conversation of its own. First faults: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate
    (role and text seen before), truncated (the last such character is none of ``.!?``). Keeping costs 0,
    another role 1, deletion 2 (the only way with blank and duplicate turns), a turn put in 5; a truncated
    turn that stays 5 more. The outcome's initials are none or ``s?(ua)+``; of equally cheap edits the least
    in ASCII are taken. ``gaps`` counts the numbers missing between the least and the greatest turn.

    Repeated rows are duplicates of each other; an empty table gives empty tables; further columns are not
    read, whatever their names. A turn of -2^63 counts as NULL. A stretch holds ``segment_rows`` turns and
    ``segment_bytes`` of text, or one turn, whose text has no limit but must fit a task several times over. The
    figures of a conversation's stretches, some hundred numbers each, meet in one task.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    named = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    framed = turns.select(F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"), named.alias("role"), said.alias("text"))
    bare = F.btrim("text", F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    judged = framed.select(
        "*", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), ".").otherwise("t").alias("fault"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("mark"))
    order = [F.col("c").asc_nulls_first(), F.col("turn")]
    dealt = judged.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").select("*", F.monotonically_increasing_id().alias("row"))
    ident = framed.schema["c"].dataType.simpleString()
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    dealt.mapInArrow(_pack(segment_rows, segment_bytes), SEGMENT.format(ident=ident)).write.parquet(path)
    packed = spark.read.parquet(path)
    done, several = packed.filter("whole"), packed.filter("NOT whole")

    # rows carry their order in first_row, so the first to say something is the least
    spoken = several.select("conv_key", "first_row", F.posexplode("marks").alias("pos", "mark"))
    first = spoken.groupBy("conv_key", "mark").agg(F.min(F.col("first_row") + F.col("pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").hint("rebalance")
    again = spoken.join(first, ["conv_key", "mark"]).filter(F.col("first_row") + F.col("pos") > F.col("first"))
    again = again.groupBy("first_row").agg(F.collect_list("pos").alias("again"))
    letters = F.transform(F.split("faults", ""), lambda f, i: F.when(F.array_contains(F.coalesce("again", F.array().cast("array<int>")), i) & (f != "b"), "d").otherwise(f))
    marked = several.join(again, "first_row", "left").withColumn("faults", F.array_join(letters, "")).select("conv_key", "first_row", "initials", "faults", "turns", "rows")
    figures = marked.select("conv_key", "first_row", "initials", "faults", "turns").mapInArrow(_sum_up, OPEN.format(ident=ident))
    chosen = figures.repartition("conv_key").sortWithinPartitions("conv_key", "first_row").mapInArrow(_choose, CHOSEN.format(ident=ident))
    leads = F.col("cost").isNotNull().alias("leads")
    met = marked.select("conv_key", "first_row", "initials", "faults", "rows").join(chosen.select("first_row", "before", "after", leads), "first_row")
    solved = met.select("conv_key", "first_row", "initials", "faults", "rows", "before", "after", "leads").mapInArrow(
        _finish, "conv_key struct<id: {0}>, first_row long, audit string, rows array<struct<role: string, text: string>>".format(ident))

    count = lambda letter: F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))
    pair = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    illegal = F.size(F.filter(pair, lambda x: (F.length(x) == 2) & ~x.isin("su", "ua", "au")))
    known = F.filter("turns", lambda t: t != NO_TURN)
    gaps = F.coalesce(F.array_max(known) - F.array_min(known) + 1 - F.size(F.array_distinct(known)), F.lit(0))
    plain = done.select("conv_key", gaps.alias("gaps"), *[c.cast("long").alias(n) for n, c in zip(FLAGS, (count("b"), count("d"), count("t"), illegal))], "cost")
    summed = chosen.filter(F.col("cost").isNotNull()).select("conv_key", "gaps", *FLAGS, "cost")
    own = F.col("conv_key.id").alias(conv)
    report = plain.unionByName(summed).select(own, "gaps", *FLAGS, "cost")
    both = done.select("conv_key", "first_row", "audit", "rows", "whole").unionByName(solved.withColumn("whole", F.lit(False)))
    return Repaired(report, both.select(own, F.col("first_row").alias("piece"), "audit", "rows", "whole"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of every conversation of several stretches, which come in order; their texts pass one by one."""

    def finish(key: pa.Array, edits_: list[str], digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(["".join(edits_)]), pa.array([digest.hexdigest()])], names=["conv_key", "audit", "repaired_sha256"])

    key = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            if key is None or row.column("conv_key")[0].as_py() != key[0].as_py():
                if key is not None:
                    yield finish(key, audit, digest)
                key, audit, digest, begun = row.column("conv_key"), [], hashlib.sha256(), False
            audit.append(row.column("audit")[0].as_py())
            rows = row.column("rows").flatten()
            for role, text in zip(rows.field("role"), rows.field("text"), strict=True):
                digest.update(f"{chr(10) if begun else ''}{role.as_py()}:{text.as_py()}".encode())
                begun = True
    if key is not None:
        yield finish(key, audit, digest)


def digested(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``audit`` and ``repaired_sha256`` (of ``role:text``, joined by newline) of every repaired conversation."""
    keyed = pieces.select(F.struct(F.col(conv).alias("id")).alias("conv_key"), "piece", "whole", "audit", "rows")
    said = F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    plain = keyed.filter("whole").select("conv_key", "audit", F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256"))
    ordered = keyed.filter("NOT whole").repartition("conv_key").sortWithinPartitions("conv_key", "piece").select("conv_key", "audit", "rows")
    ident = pieces.schema[conv].dataType.simpleString()
    streamed = ordered.mapInArrow(_digest, f"conv_key struct<id: {ident}>, audit string, repaired_sha256 string")
    return plain.unionByName(streamed).select(F.col("conv_key.id").alias(conv), "audit", "repaired_sha256")
