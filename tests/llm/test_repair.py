"""Conversation repair against a plain table of states by turns that keeps every list of edits whole."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from landsift.llm import repair

INITIALS = {0: "", 1: "s", 2: "u", 3: "a"}


def cheapest(turns):
    """(cost, edits, repaired rows) over (role, text, fault) turns: the minimum over all lists of edits."""
    after = lambda s: 3 if s == 2 else 2
    role = {2: "user", 3: "assistant"}

    def with_inserts(ways):
        for s, (cost, audit, said) in list(ways.items()):
            for _ in range(2):
                s, cost, audit = after(s), cost + 5, audit + "I"
                said = [*said, f"{role[s]}:"]
                ways[s] = min(ways.get(s, (1 << 30,)), (cost, audit, said))
        return ways

    ways = with_inserts({0: (0, "", [])})
    for name, text, fault in turns:
        found = {}
        for s, (cost, audit, said) in ways.items():
            options = [("D", s, 2, said)]
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                if name[:1] == "s" and s == 0:
                    options.append(("K", 1, more, [*said, f"{name}:{text}"]))
                if name[:1] == ("a" if s == 2 else "u"):
                    options.append(("K", after(s), more, [*said, f"{name}:{text}"]))
                options.append(("R", after(s), 1 + more, [*said, f"{role[after(s)]}:{text}"]))
            for letter, t, extra, rows in options:
                found[t] = min(found.get(t, (1 << 30,)), (cost + extra, audit + letter, rows))
        ways = with_inserts(found)
    return min(ways[s] for s in (0, 3) if s in ways)


def judged(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(turns):
    """The row of a conversation from its sorted (turn, role, text) rows."""
    rows = judged([(r, t) for _, r, t in turns])
    cost, audit, said = cheapest(rows)
    known = [t for t, _, _ in turns if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    count = lambda f: sum(r[2] == f for r in rows)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, count("b"), count("d"), count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversation(rng, size):
    return [(rng.choice([None, *range(size)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]),
             rng.choice(["Yes.", "No", " ", "", "What?", f"t{rng.randrange(9)}.", f"t{rng.randrange(9)}"])) for _ in range(size)]


def test_edits_of_whole_conversations_equal_the_table():
    rng = random.Random(1)
    for _ in range(3000):
        rows = judged([(r, t) for _, r, t in conversation(rng, rng.randrange(1, 14))])
        kinds = repair.kinds_of("".join(r[0] if r[0] in "sua" else "o" for r, _, _ in rows), "".join(f for _, _, f in rows))
        assert repair.solve(kinds) == cheapest(rows)[:2]


def test_stretches_chosen_by_their_figures_equal_the_whole():
    rng = random.Random(2)
    for _ in range(2000):
        kinds = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 40)))
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds) + 1) for _ in range(rng.randrange(6)))})
        parts = [kinds[a:b] for a, b in itertools.pairwise(cuts)]
        cost, path = repair.choose([repair.summary(p) for p in parts])
        audit = "I" * repair.BEGIN[path[0]][2] + "".join(repair.between(p, a, b) for p, (a, b) in zip(parts, itertools.pairwise(path), strict=True))
        assert (cost, audit) == repair.solve(kinds)


def test_a_long_conversation_takes_little_memory():
    kinds = "uaUAoxs" * 20_000
    cost, audit = repair.solve(kinds)
    assert len(audit.replace("I", "")) == len(kinds) and cost < 2 * len(kinds)


@pytest.mark.parametrize(("rows", "size"), [(4096, 1 << 20), (3, 1 << 20), (1, 1), (50, 8)])
def test_conversations_in_stretches_of_any_size(spark, rows, size):
    rng = random.Random(rows)
    convs = {c: conversation(rng, n) for c, n in enumerate([1, 2, 5, 30, 400, 3, 7, 7, 2, 60])} | {None: conversation(rng, 9)}
    data = [(c, t, r, x, 1) for c, turns in convs.items() for t, r, x in turns]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, audit int").repartition(5)
    repaired = repair.repair_conversations(frame, segment_rows=rows, segment_bytes=size)
    found = repaired.report.alias("r").join(repair.digested(repaired.pieces).alias("p"), F.expr("r.conv_id <=> p.conv_id"))
    got = {r[0]: tuple(r[1:]) for r in found.select("r.conv_id", "gaps", *repair.FLAGS, "cost", "audit", "repaired_sha256").collect()}
    assert got == {c: expected(sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, turns in convs.items()}
    assert repaired.pieces.count() >= (len(data) if size == 1 else len(convs))


def test_nulls_read_as_a_blank(spark):
    frame = spark.createDataFrame([(1, None, None, None), (1, 2, None, "a."), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    repaired = repair.repair_conversations(frame)
    assert [r.asDict() for r in repaired.report.collect()] == [{"conv_id": 1, "gaps": 0, "blank": 2, "duplicate": 0, "truncated": 0, "illegal": 2, "cost": 6}]
    assert repair.repair_conversations(frame.limit(0)).report.collect() == []
