"""SQL that checks the operators, in pieces that the pipeline's SQL is made of as well."""

from __future__ import annotations

from landsift.llm import mixing, quality, sharding

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = quality.LineRules()
_SEPARATED = f"^(?:[^|>»•]*[|>»•]){{{_RULES.separators},}}"


def judged_sql(documents: str = "documents") -> str:
    """Every document with the figures and the verdict of the line rules."""
    return f"""
    SELECT d.*, n_failed_lines, lost_chars, clean_text, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {_RULES.max_lost_pct} * word_chars AS kept
    FROM (SELECT b.*, coalesce(c.n, 0) AS n_repeat_words FROM (
        SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lw) AS n_lines, len(lw) - len(list_distinct(lw)) AS n_dup_lines
        FROM (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lw FROM {documents}) a) b
    LEFT JOIN (SELECT rid, count(DISTINCT i + k) AS n FROM (
        SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM (
        SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (
        SELECT row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {documents}) a,
        unnest(range(1, len(w) - 1)) u(i)) x) y WHERE c > 1) z, unnest([0, 1, 2]) v(k) GROUP BY rid) c USING (rid)) d
    JOIN (SELECT rid, sum(CASE WHEN f THEN 1 ELSE 0 END) AS n_failed_lines, sum(CASE WHEN f THEN length(regexp_replace(s, '[ \\t-\\r]', '', 'g')) ELSE 0 END) AS lost_chars,
        CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT f), '') END AS clean_text FROM (
        SELECT *, s <> '' AND (NOT regexp_matches(s, {quoted(quality.SENTENCE_END)})
        OR 100 * length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) > {_RULES.max_mark_pct} * length(regexp_replace(s, '[ \\t-\\r]', '', 'g')) OR regexp_matches(s, '(?i)^(?:{quality.MENU_WORDS})[.!?]?$')
        OR regexp_matches(s, '{_SEPARATED}') OR regexp_matches(s, '(?i)(?:{quality.STOCK_PHRASES})')) AS f FROM (
        SELECT rid, text, i, l[i] AS x, trim(l[i], {BLANKS}) AS s FROM (
        SELECT row_number() OVER () AS rid, text, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}) a, unnest(range(1, len(l) + 1)) u(i)) b) c
        GROUP BY rid) e USING (rid)"""


def network_sql(source: str, keys: list[int]) -> str:
    """The Feistel rounds over ident, n, lb, rb (bits of both halves) and x, as layers of selects."""
    layer = f"SELECT ident, n, lb, rb, x >> rb AS l, x & ((1::UBIGINT << rb) - 1) AS r FROM {source}"
    for i, key in enumerate(keys):
        width = "lb" if i % 2 == 0 else "rb"
        layer = f"SELECT *, xor(r, {key}::UBIGINT) AS f FROM ({layer})"
        layer = f"SELECT * REPLACE ((xor(f, f >> 16) * 2246822507::UBIGINT) & 4294967295 AS f) FROM ({layer})"
        layer = f"SELECT * REPLACE ((xor(f, f >> 13) * 3266489909::UBIGINT) & 4294967295 AS f) FROM ({layer})"
        layer = f"SELECT ident, n, lb, rb, r AS l, xor(l, xor(f, f >> 16) & ((1::UBIGINT << {width}) - 1)) AS r FROM ({layer})"
    return f"SELECT ident, n, lb, rb, (l << rb) | r AS x FROM ({layer})"


CRC_SQL = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex({0}), '..'), lambda b: CAST('0x' || b AS UBIGINT))),
    lambda c, b: xor(c >> 8, crc_list[CAST(xor(c & 255, b) AS BIGINT) + 1]))"""
CRC_TABLE = """crc AS MATERIALIZED (SELECT k, v FROM (WITH RECURSIVE r AS (SELECT k, k::UBIGINT AS v, 0 AS i FROM range(256) t(k)
    UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, i + 1 FROM r WHERE i < 8)
    SELECT k, v FROM r WHERE i = 8))"""


def placed_sql(rows: str, order: str) -> str:
    """Tables ``numbered`` (the rows with ident and n) and ``walk`` (ident, x): x below n is the row's place."""
    keys = sharding.round_keys(0)
    return f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS ident, count(*) OVER () AS n FROM {rows}),
    bits AS MATERIALIZED (SELECT ident, n, bits - bits // 2 AS lb, bits // 2 AS rb, ident::UBIGINT AS x FROM (SELECT ident, n, greatest(2, length(bin(n - 1))) AS bits FROM numbered)),
    walk AS ({network_sql("bits", keys)} UNION ALL
        {network_sql("(SELECT ident, n, lb, rb, x FROM walk WHERE x >= n)", keys)})"""


ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def hits_sql(documents: str) -> str:
    """Tables ``hd`` (rid, the row, w), ``occurs`` (rid, item_id, k, size): occurrences of benchmark windows."""
    return f"""hd AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM {documents}),
    hm AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
    hw AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS x
        FROM hm, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(k) WHERE len(w) > 0),
    occurs AS MATERIALIZED (SELECT rid, item_id, k, size FROM (SELECT rid, z.size, k, array_to_string(w[k:k + z.size - 1], ' ') AS x
        FROM hd, (SELECT DISTINCT size FROM hw) z, unnest(range(1, len(w) - z.size + 2)) u(k)) y JOIN hw USING (size, x))"""


def links_sql(documents: str, width: int, percent: int) -> str:
    """Tables w (rid, doc_id, w), s (rid, h), and root (rid, root, least): components by links between sets."""
    return f"""w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM {documents}),
    s AS MATERIALIZED (SELECT DISTINCT rid, md5(array_to_string(w[k:k + least({width}, len(w)) - 1], ' ')) AS h
        FROM w, unnest(range(1, len(w) - least({width}, len(w)) + 2)) u(k) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    e AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.h = b.h AND a.rid <> b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
        GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))
        UNION SELECT a.rid, b.rid FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.rid <> b.rid WHERE len(a.w) > 0 AND len(b.w) > 0),
    reach AS (SELECT rid, rid AS other FROM w UNION SELECT reach.rid, e.b FROM reach JOIN e ON reach.other = e.a)"""


FIVE = "CAST('0x' || substr(h, {0}, 5) AS INTEGER)"
BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({FIVE.format(5 * g + 1)} >> {k}) & 31) + 1, 1)" for g in range(8) for k in (15, 10, 5, 0))
