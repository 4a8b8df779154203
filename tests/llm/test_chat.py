"""Chat formatting: the tree against one built turn by turn, and every conversation read back through its intervals."""

import random

import pytest
from pyspark.sql import functions as F

from landsift.llm import chat

WORDS = ["Hi.", "Yes", "No.", "", " ", "<|im_end|>", "<\\|x", "<\\\\|", "a\nb", "ü|<|", "<|im_start|>assistant ok"]


def piece(role, text):
    """The template, worked out one character at a time."""

    def shielded(s):
        out, k = "", 0
        while k < len(s):
            if s[k] == "<":
                j = k + 1
                while j < len(s) and s[j] == "\\":
                    j += 1
                if j < len(s) and s[j] == "|":
                    out, k = out + "<\\" + s[k + 1:j] + "|", j + 1
                    continue
            out, k = out + s[k], k + 1
        return out

    return f"<|im_start|>{shielded(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{shielded(text)}<|im_end|>\n"


def conversations(seed, n, depth, kinds):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        size = rng.randrange(1, depth)
        out[c] = [(rng.choice([None, 0]) if k == 0 else 700 * k, rng.choice(["user", "assistant", "a\\n\nb"][:2 + (rng.random() < 0.05)]), rng.choice(WORDS[:kinds])) for k in range(size)]
    return out


@pytest.mark.parametrize(("seed", "n", "depth", "kinds"), [(1, 60, 5, 2), (2, 40, 7, len(WORDS)), (3, 120, 4, 3), (4, 1, 2, 1)])
def test_tree_equals_one_built_by_hand(spark, tmp_path, seed, n, depth, kinds):
    convs = conversations(seed, n, depth, kinds)
    convs[1000] = convs[0]  # an equal path
    data = [(c, t, r, x, 5) for c, turns in convs.items() for t, r, x in turns]
    random.Random(seed).shuffle(data)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, piece int").repartition(6)
    path = chat.write_chats(frame, str(tmp_path / "out"))
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("stream_start").collect()
    runs = {r.run: r for r in spark.read.parquet(f"{path}/runs").collect()}
    paths = {c: [piece(r, x) for _, r, x in turns] for c, turns in convs.items()}
    prefixes = {tuple(p[:k]) for p in paths.values() for k in range(1, len(p) + 1)}
    stream = "".join(r.piece for r in nodes)
    assert len(nodes) == len(prefixes)  # each shared beginning once
    assert [r.stream_start for r in nodes] == [sum(len(x.piece) for x in nodes[:k]) for k in range(len(nodes))]

    # depth first: each node comes right behind its parent or behind the parent's earlier branches
    seen, stack = set(), []
    for node in nodes:
        spans = [(a["from"], a["to"]) for a in runs[node.run].ancestors] + [(runs[node.run].stream_start, node.stream_start)]
        before = "".join(stream[a:b] for a, b in spans)
        assert node.position == len(before)
        whole = before + node.piece
        while stack and not before.startswith(stack[-1]):
            stack.pop()
        assert (stack[-1] if stack else "") == before
        stack.append(whole)
        seen.add(whole)
    assert seen == {"".join(p) for p in prefixes}

    ends = {r.conv: r for r in spark.read.parquet(f"{path}/conversations").collect()}
    for c, p in paths.items():
        run = runs[ends[c].run]
        spans = [(a["from"], a["to"]) for a in run.ancestors] + [(run.stream_start, run.stream_start + ends[c].end - run.position)]
        assert "".join(stream[a:b] for a, b in spans) == "".join(p) and ends[c].n_turns == len(p)

    back = {}
    for r in chat.read_turns(spark, path).orderBy("conv", "position").collect():
        back.setdefault(r.conv, []).append((r.role, r.text, r.loss))
    assert back == {c: [(r, x, x if r == "assistant" else "") for _, r, x in turns] for c, turns in convs.items()}


def test_a_chain_of_branches_and_a_long_conversation(spark, tmp_path):
    # conversation c leaves c - 1 one turn below where c - 1 left its own, so pointers have to be doubled
    deep = 40
    data = [(c, k, "user", f"{min(c, k) if k < c else c} {k}") for c in range(deep) for k in range(deep)]
    data += [(999, k, "assistant", f"turn {k}") for k in range(5000)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    path = chat.write_chats(frame, str(tmp_path / "out"))
    assert spark.read.parquet(f"{path}/runs").agg(F.max(F.size("ancestors"))).first()[0] == deep - 1
    turns = chat.read_turns(spark, path).orderBy("conv", "position").collect()
    assert [(r.conv, r.role, r.text) for r in turns] == [(c, r, x) for c, _, r, x in sorted(data)]


def test_escaping_turns_back(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("<|\\n\n x") for _ in range(rng.randrange(12))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    both = frame.select("x", chat.escape(F.col("x")).alias("e"), chat.escape_role(F.col("x")).alias("r"))
    for row in both.select("x", "e", "r", chat.unescape(F.col("e")).alias("eb"), chat.unescape_role(F.col("r")).alias("rb")).collect():
        assert row.x == row.eb == row.rb and "<|" not in row.e and "<|" not in row.r and "\n" not in row.r
