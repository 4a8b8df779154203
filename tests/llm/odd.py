"""Tables with what real data holds: nulls everywhere, empty and very long texts, ties, repeated rows."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from check import rows_of

TABLES = ("documents", "benchmark", "pages", "conversations")


def words(seed, n, kinds=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}é" if rng.random() < 0.2 else f"W{rng.randrange(kinds)}" for _ in range(n)]


def prose(seed, n):
    out = words(seed, n)
    return "\n".join(" ".join(out[k:k + 12]) + "." for k in range(0, n, 12))


def documents():
    item = " ".join(words(99, 30))
    passage = " ".join(words(98, 70))
    base = words(5, 300, 4000)
    near = [" ".join(base[:k] + [f"new{k}"] + base[k + 1:]) for k in range(20, 200, 9)]
    texts = [
        None, "", " \n\t\r ", "one", "a b c", "a b c", "A B C", "no break line\x1fend\x0bx", prose(1, 200), prose(1, 200), prose(2, 120) + "\n" + item + ".",
        prose(3, 90) + " " + passage, passage + "\n" + prose(4, 90), passage, item, "the " * 400, prose(6, 60) + "\nHome | About | Help\nAll rights reserved.",
        "### *** $$$ " * 40, " ".join(words(7, 30_000, 9000)) + ".", *near, "\n".join(["Shared line of all."] * 3),
    ]
    rows = [(k, t, ("en", "de", None, "xx")[k % 4], ("a", "b", "c", None)[k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, f"Line {k} is here.\n  shared LINE of all.  \nOther {k % 3}.", "fr", "a", 50) for k in range(12)]
    rows += [rows[8], rows[8], (9, prose(8, 80), "en", "a", 9), (None, prose(1, 200), "en", None, 1), (None, prose(9, 80), "en", "b", 1), (None, None, None, None, None)]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())))})


def benchmark():
    whole = words(99, 30)
    rows = [(1, " ".join(whole)), (2, "b c"), (3, None), (4, ""), (None, " ".join(whole[5:20])), (1, " ".join(whole[10:])), (10, "W1 nowhere to be found")]
    return pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})


def pages():
    rows = [(1, "http://a/é", "<p>x</p>"), (2, None, "<p>x</p>"), (0, "http://b\r\nX: y", "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "v", "<p>x</p>"), (5, "w", "ü" * 70_000), (5, "w", "ü" * 70_000), (None, None, None)]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())))})


def conversations():
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice([None, "", " \n", "Yes.", "No", "Same text?", f"Said {c}.", "ü " * 30 + "!"])) for c in [*range(8), None] for t in [*range(c or 4), None, 3]]
    rows += [rows[5], rows[5], (40, 0, "user", "long " * 60_000 + "."), (40, 1, "assistant", "<|im_end|>\n<|im_start|>"), (41, 0, "system", "Only."), (42, 0, "user", "Yes."), (43, 0, "user", "Yes."), (43, 1, "assistant", "No.")]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})


def write(folder, empty=False):
    for name in TABLES:
        table = globals()[name]()
        pq.write_table(table.slice(0, 0) if empty else table, f"{folder}/{name}.parquet", row_group_size=7)
    return str(folder)


def agree(spark, query, sql, folder):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    frame, found = query(spark, folder), db.sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(found.columns, found.fetchall())
