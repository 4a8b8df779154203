"""Mixing sources to target weights: iterative proportional fitting of token counts, then sampling.

Token counts are raked to three marginals: source, language and topic. Sources are many, so each is a row
that holds its counts by language and topic; languages and topics are those of the targets and one for
the rest. A round is one pass over the sources: their factors follow row by row, and the sums by language
and topic (a fixed number of figures) come back to fit the other two factors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.functions.keys import random_column
from landsift.llm.quality import words_of
from landsift.session import cut_lineage

OTHER = "other"


@dataclass(frozen=True)
class Mix:
    """Targets are shares of tokens; each set is scaled to one over the values that hold tokens.

    ``sources`` gives shares by source, the rest of them none; without it a source's share is its
    token count to the power ``smoothing``. What no language target or topic rule names is ``other``.
    ``topics`` are patterns, the first that a text contains decides. ``keep`` is the share of all tokens wanted.
    """

    languages: dict[str, float]
    topics: dict[str, str]
    topic_shares: dict[str, float]
    sources: dict[str, float] | None = None
    smoothing: float = 0.5
    keep: float = 0.5
    rounds: int = 20
    seed: int = 11
    language_names: list[str] = field(init=False)
    topic_names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "language_names", [*(x for x in self.languages if x != OTHER), OTHER])
        object.__setattr__(self, "topic_names", [*self.topics, OTHER])


def _lookup(shares: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(v) for pair in shares.items() for v in pair] or [F.lit(""), F.lit(0.0)]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(0.0))


def topic_of(text: Column, mix: Mix) -> Column:
    topic = F.lit(OTHER)
    for name, pattern in reversed(mix.topics.items()):
        topic = F.when(text.rlike(pattern), name).otherwise(topic)
    return topic


def _scaled(shares: list[float], tokens: list[float]) -> list[float]:
    held = [s if t > 0 else 0.0 for s, t in zip(shares, tokens, strict=True)]
    total = sum(held)
    return [s / total if total else 0.0 for s in held]


def _ratio(target: float, got: float) -> float:
    return target / got if got > 0 else 0.0


def rake(counts: DataFrame, mix: Mix) -> tuple[DataFrame, list[float]]:
    """``counts`` (source ``s``, counts ``n`` by language and topic) with factor ``a``, and the factors of ``n``'s cells.

    A document of a cell has weight ``a`` times the cell's factor: its share of the mix per token.
    """
    langs, topics = mix.language_names, mix.topic_names
    cells = [(i, j) for i in range(len(langs)) for j in range(len(topics))]
    total = F.aggregate("n", F.lit(0.0), lambda x, y: x + y)
    weighed = counts.withColumn("share", _lookup(mix.sources, F.col("s")) if mix.sources is not None else F.pow(total, mix.smoothing))
    weighed = weighed.withColumn("share", F.when(total > 0, F.col("share")).otherwise(0.0))
    first = weighed.agg(F.sum("share").alias("share"), *[F.sum(F.col("n")[k]).alias(f"c{k}") for k in range(len(cells))]).first()
    scale, held = first["share"] or 0.0, [first[f"c{k}"] or 0.0 for k in range(len(cells))]
    of_lang = _scaled([mix.languages.get(x, 0.0) for x in langs], [sum(h for h, c in zip(held, cells, strict=True) if c[0] == i) for i in range(len(langs))])
    of_topic = _scaled([mix.topic_shares.get(x, 0.0) for x in topics], [sum(h for h, c in zip(held, cells, strict=True) if c[1] == j) for j in range(len(topics))])
    b, c = [1.0] * len(langs), [1.0] * len(topics)

    def factor() -> Column:
        fitted = F.aggregate(F.zip_with("n", F.array(*[F.lit(b[i] * c[j]) for i, j in cells]), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        return F.when((fitted > 0) & F.lit(scale > 0), F.col("share") / F.lit(scale or 1.0) / fitted).otherwise(0.0)

    for _ in range(mix.rounds):
        sums = weighed.withColumn("a", factor()).agg(*[F.sum(F.col("a") * F.col("n")[k]) for k in range(len(cells))]).first()
        got = dict(zip(cells, (x or 0.0 for x in sums), strict=True))
        b = [_ratio(of_lang[i], sum(got[i, j] * c[j] for j in range(len(topics)))) for i in range(len(langs))]
        c = [_ratio(of_topic[j], sum(got[i, j] * b[i] for i in range(len(langs)))) for j in range(len(topics))]
    return weighed.withColumn("a", factor()), [b[i] * c[j] for i, j in cells]


def mix_documents(docs: DataFrame, mix: Mix, ident: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens`` (words), ``probability`` and ``kept``.

    A document is kept when a hash of its id, uniform from 0 to 1, lies below its probability: its
    weight times the tokens wanted, at most 1, so scarce cells stay whole but are not repeated. NULL source is
    a source of its own, NULL language is ``other``, NULL text has no tokens and topic ``other``. Cells or sources without tokens
    have probability 0. Rows that share an id are kept or left together. Empty tables give empty results.
    Input columns named like an added one are replaced.
    """
    added = ["topic", "n_tokens", "probability", "kept"]
    own = [c for c in docs.columns if c.lower() not in added]
    langs, topics = mix.language_names, mix.topic_names
    known = F.coalesce(F.when(F.col(lang).isin(langs), F.col(lang)), F.lit(OTHER))
    keyed = docs.select(
        F.struct(*[F.col(c) for c in own]).alias("row"), F.col(source).alias("s"), known.alias("l"),
        topic_of(F.coalesce(F.col(text), F.lit("")), mix).alias("topic"), F.size(words_of(F.col(text))).cast("long").alias("n_tokens"))
    count = lambda i, j: F.sum(F.when((F.col("l") == langs[i]) & (F.col("topic") == topics[j]), F.col("n_tokens")).otherwise(0)).cast("double")
    counted = keyed.groupBy("s").agg(F.array(*[count(i, j) for i in range(len(langs)) for j in range(len(topics))]).alias("n"))
    factors, cell = rake(cut_lineage(counted), mix)
    tokens = factors.agg(F.sum(F.aggregate("n", F.lit(0.0), lambda x, y: x + y))).first()[0] or 0.0
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("l")) - 1
    place = (place * len(topics) + F.array_position(F.array(*map(F.lit, topics)), F.col("topic"))).cast("int")
    met = keyed.alias("k").join(factors.select(F.col("s").alias("f"), "a").hint("rebalance"), F.col("k.s").eqNullSafe(F.col("f")), "left")
    weight = F.col("a") * F.element_at(F.array(*map(F.lit, cell)), place)
    rated = met.select("row", "topic", "n_tokens", F.least(F.lit(1.0), weight * F.lit(mix.keep * tokens)).alias("probability"))
    return rated.select(
        *[F.col("row")[c].alias(c) for c in own], "topic", "n_tokens", "probability",
        (random_column(F.col("row")[ident], mix.seed) < F.col("probability")).alias("kept"))


def mixing_sql(mix: Mix, documents: str) -> str:
    """The same in SQL: common table expressions that end in ``mixed``, all documents with the added columns."""
    langs, topics = mix.language_names, mix.topic_names
    names = ", ".join(f"'{x}'" for x in langs)
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mix.topics.items())
    values = lambda shares, keys: ", ".join(f"('{k}', {shares.get(k, 0.0)!r}::DOUBLE)" for k in keys)
    steps = [f"""doc AS MATERIALIZED (SELECT *, CASE WHEN lang IN ({names}) THEN lang ELSE 'other' END AS l, CASE {cases} ELSE 'other' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {documents})""",
        "cell AS MATERIALIZED (SELECT source AS s, l, topic AS t, sum(n_tokens)::DOUBLE AS n FROM doc GROUP BY ALL)",
        f"""src AS MATERIALIZED (SELECT s, share / sum(share) OVER () AS share FROM (
            SELECT s, CASE WHEN sum(n) > 0 THEN pow(sum(n), {mix.smoothing!r}) ELSE 0 END AS share FROM cell GROUP BY s) x)""",
        f"""tl AS MATERIALIZED (SELECT l, share / sum(share) OVER () AS share FROM (
            SELECT v.l, CASE WHEN sum(n) > 0 THEN any_value(v.share) ELSE 0 END AS share FROM (VALUES {values(mix.languages, langs)}) v(l, share) LEFT JOIN cell USING (l) GROUP BY v.l) x)""",
        f"""tt AS MATERIALIZED (SELECT t, share / sum(share) OVER () AS share FROM (
            SELECT v.t, CASE WHEN sum(n) > 0 THEN any_value(v.share) ELSE 0 END AS share FROM (VALUES {values(mix.topic_shares, topics)}) v(t, share) LEFT JOIN cell USING (t) GROUP BY v.t) x)""",
        "b0 AS (SELECT l, 1::DOUBLE AS b FROM tl)", "c0 AS (SELECT t, 1::DOUBLE AS c FROM tt)"]
    fit = lambda r: f"""a{r} AS MATERIALIZED (SELECT s, coalesce(any_value(share) / nullif(sum(n * b * c), 0), 0) AS a FROM cell JOIN b{r} USING (l) JOIN c{r} USING (t)
        JOIN src ON src.s IS NOT DISTINCT FROM cell.s GROUP BY cell.s, src.s)""".replace("SELECT s, coalesce", "SELECT cell.s AS s, coalesce")  # noqa: E731
    for r in range(mix.rounds):
        steps += [fit(r), f"m{r} AS MATERIALIZED (SELECT l, t, sum(a * n) AS m FROM cell JOIN a{r} ON a{r}.s IS NOT DISTINCT FROM cell.s GROUP BY l, t)",
                  f"b{r + 1} AS MATERIALIZED (SELECT l, coalesce(any_value(share) / nullif(sum(m * c), 0), 0) AS b FROM tl LEFT JOIN m{r} USING (l) LEFT JOIN c{r} USING (t) GROUP BY l)",
                  f"c{r + 1} AS MATERIALIZED (SELECT t, coalesce(any_value(share) / nullif(sum(m * b), 0), 0) AS c FROM tt LEFT JOIN m{r} USING (t) LEFT JOIN b{r + 1} USING (l) GROUP BY t)"]
    r = mix.rounds
    steps += [fit(r), f"""mixed AS MATERIALIZED (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{mix.seed}')), 1, 8)) AS BIGINT) / 4294967296e0 < probability AS kept
        FROM (SELECT doc.*, least(1, a * b * c * {mix.keep!r} * (SELECT sum(n) FROM cell)) AS probability
        FROM doc JOIN a{r} ON a{r}.s IS NOT DISTINCT FROM doc.source JOIN b{r} USING (l) JOIN c{r} ON c{r}.t = doc.topic) x)"""]
    return ",\n    ".join(steps)
