"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens (words) are summed over the cells source x language x topic. Raking scales the cells' weights to
the target share of each source, each language and each topic in turn, ``ROUNDS`` times. A document's
probability is that of its cell: weight over tokens, scaled so that the expected tokens are
``budget`` times the corpus, clipped at 1 with the excess spread over the other cells (water-filling).
Its uniform number is the first 48 bits of the SHA-256 of its id, so the sample is repeatable and
does not depend on partitioning. All of it is DataFrame expressions; only cells are shuffled.

Targets: a source's share is its token share to the power ``source_power``, a topic's likewise; a
language's share is given by ``languages`` (others share what ``OTHER_LANGUAGES`` leaves them), all
normalised over what occurs.

Topics are told by fixed lexical rules, in this order: ``legal`` (licence words), ``contact`` (mail
addresses), ``tabular`` (several cell bars), ``prose``.

Defined results: a null source or language is a category of its own, ``(none)``; null or empty texts
have no tokens and are kept with their cell's probability, 0 in a cell without tokens; equal ids share
their fate; a null id draws as the empty string; cells of equal rates are filled together; an empty table
gives no rows; a very long text is one row; other columns are kept, but one of an output's name is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, unused

ROUNDS = 8
BUDGET = 0.5
SOURCE_POWER = 0.7
TOPIC_POWER = 0.7
#: Target shares; languages not named share OTHER_LANGUAGES in proportion to their tokens.
LANGUAGES = {"en": 0.5, "de": 0.18, "es": 0.14, "fr": 0.18}
OTHER_LANGUAGES = 0.05

NONE = "(none)"
_DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """The topic by fixed lexical rules; plain searches spare most texts the patterns."""
    low = F.lower(text)
    licence = low.contains("licen") | low.contains("released under") | low.contains("all rights reserved") | low.contains("copyright")
    return (
        F.when(licence & text.rlike("(?i)\\b(licen[sc]ed? under|released under|all rights reserved|copyright)\\b"), "legal")
        .when(text.contains("@") & text.rlike("[A-Za-z0-9._-]@[A-Za-z0-9-]+\\.[A-Za-z]"), "contact")
        .when(text.contains(" | ") & text.rlike(" \\| [^|]* \\| [^|]* \\| "), "tabular")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words of the text: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def uniform_of(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the SHA-256 of the id's text."""
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _described(docs: DataFrame, prefix: str, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    """``docs`` with the fields the mixer needs, under names that begin with ``prefix``."""
    fields = {
        "source": F.coalesce(F.col(source), F.lit(NONE)),
        "lang": F.coalesce(F.col(lang), F.lit(NONE)),
        "topic": F.coalesce(topic_of(F.col(text)), F.lit("prose")),
        "tokens": tokens_of(F.col(text)),
        "u": uniform_of(F.col(doc_id)),
    }
    return docs.withColumns({f"{prefix}{k}": c for k, c in fields.items()})


def _targets(cells: DataFrame, dim: str, power: float, shares: dict[str, float] | None, rest: float) -> DataFrame:
    """``dim, target``: target shares of the values that occur with tokens, summing to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    everything = Window.partitionBy(F.lit(0))
    if shares is None:
        raw = F.pow("t", F.lit(power))
    else:
        named = F.coalesce(*[F.when(F.col(dim) == k, F.lit(v)) for k, v in shares.items()], F.lit(None).cast("double"))
        others = F.sum(F.when(named.isNull(), F.col("t"))).over(everything)
        raw = F.coalesce(named, F.lit(rest) * F.col("t") / others)
    return sums.select(dim, raw.alias("raw")).select(dim, (F.col("raw") / F.sum("raw").over(everything)).alias("target"))


def cell_weights(
    spark: SparkSession,
    cells: DataFrame,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    source_power: float = SOURCE_POWER,
    topic_power: float = TOPIC_POWER,
    languages: dict[str, float] = LANGUAGES,
    other_languages: float = OTHER_LANGUAGES,
) -> DataFrame:
    """Raked ``weight`` (shares of the mixture) and sampling ``prob`` of each cell ``source, lang, topic, tokens``.

    Marginals are sums by key with partial aggregation, joined back; no cell set of one key meets in one task.
    """
    cells = cells.where("tokens > 0")
    how = {"source": (source_power, None, 0.0), "lang": (1.0, languages, other_languages), "topic": (topic_power, None, 0.0)}
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim in _DIMS:
        fitted = fitted.join(_targets(cells, dim, *how[dim]).withColumnRenamed("target", f"t_{dim}"), dim)
    fitted = stored(spark, fitted, "cells")
    for _ in range(rounds):
        for dim in _DIMS:
            sums = fitted.groupBy(dim).agg(F.sum("weight").alias("s"))
            fitted = fitted.join(sums, dim).withColumn("weight", F.col("weight") * F.col(f"t_{dim}") / F.col("s")).drop("s")
        fitted = stored(spark, fitted, "cells")  # each join above reads its input twice
    fitted = fitted.select(*_DIMS, "tokens", "weight", (F.col("weight") / F.col("tokens")).alias("rate"))
    # Water-filling: with the cells of the highest rate at probability 1, the others share what is left.
    # Rates are grouped first, so the ordered window runs over distinct rates.
    rates = fitted.groupBy("rate").agg(F.sum("tokens").cast("double").alias("t"), F.sum("weight").alias("w"))
    down = Window.orderBy(F.desc("rate")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.lit(budget) * F.sum("t").over(whole) - F.coalesce(F.sum("t").over(down), F.lit(0.0))
    scale = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(down), F.lit(0.0)))
    scales = rates.select("rate", scale.alias("scale")).where("scale * rate <= 1")
    best = scales.agg(F.max_by("scale", "rate").alias("scale"))
    return fitted.select(*_DIMS, "tokens", "weight", F.least(F.lit(1.0), F.coalesce(best.scalar() * F.col("rate"), F.lit(1.0))).alias("prob"))


def calibrated(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", **targets) -> DataFrame:
    """``docs`` with ``mix_topic, mix_tokens, mix_weight, mix_prob, mix_keep``."""
    own = unused(docs, "mixer_")
    described = _described(docs, own, doc_id, text, source, lang)
    names = [f"{own}{d}" for d in _DIMS]
    cells = described.groupBy(*names).agg(F.sum(f"{own}tokens").alias("tokens")).toDF(*_DIMS, "tokens")
    fitted = stored(spark, cell_weights(spark, stored(spark, cells, "cells"), **targets), "cells")
    fitted = fitted.select(*[F.col(d).alias(f"{own}{d}") for d in _DIMS], F.col("weight").alias(f"{own}weight"), F.col("prob").alias(f"{own}prob"))
    # No size bound on the cells is proven (sources may be many), so Spark picks the join by their size.
    joined = described.join(fitted, names, "left")
    prob = F.coalesce(f"{own}prob", F.lit(0.0))
    out = {"mix_topic": F.col(f"{own}topic"), "mix_tokens": F.col(f"{own}tokens"), "mix_weight": F.coalesce(f"{own}weight", F.lit(0.0)), "mix_prob": prob, "mix_keep": F.col(f"{own}u") < prob}
    return joined.select(*[c for c in docs.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def sample(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents drawn by their calibrated probabilities, with the columns of ``docs``."""
    own = unused(docs, "drawn_")
    plain = docs.toDF(*[f"{own}{c}" for c in docs.columns])  # so that no column has an output's name
    names = {k: f"{own}{options.pop(k, k)}" for k in ("doc_id", "text", "source", "lang")}
    return calibrated(spark, plain, **names, **options).where("mix_keep").select(*plain.columns).toDF(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, calibrated probability and draw of every document."""
    out = calibrated(spark, table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_prob", 5).alias("prob"), F.col("mix_keep").alias("keep"),
    )


def _rake_sql() -> str:
    """The fitting as a chain of common table expressions, one a dimension and round."""
    steps, last = [], "c0"
    for i in range(ROUNDS):
        for dim in _DIMS:
            name = f"r{i}{dim[0]}"
            steps.append(f"{name} AS (SELECT * REPLACE (weight * t_{dim} / sum(weight) OVER (PARTITION BY {dim}) AS weight) FROM {last})")
            last = name
    return ",\n".join(steps) + f",\nfit AS (SELECT *, weight / tokens AS rate FROM {last})"


_SHARES = " ".join(f"WHEN lang = '{k}' THEN {v}" for k, v in LANGUAGES.items())

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN regexp_matches(text, '(?i)\b(licen[sc]ed? under|released under|all rights reserved|copyright)\b') THEN 'legal'
    WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'contact'
    WHEN regexp_matches(text, ' \| [^|]* \| [^|]* \| ') THEN 'tabular' ELSE 'prose' END AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
  CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / CAST({1 << 48} AS DOUBLE) AS u FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
ts AS (SELECT source, pow(sum(tokens), {SOURCE_POWER}) AS raw FROM c GROUP BY source),
tt AS (SELECT topic, pow(sum(tokens), {TOPIC_POWER}) AS raw FROM c GROUP BY topic),
tl0 AS (SELECT lang, sum(tokens) AS t, CASE {_SHARES} END AS named FROM c GROUP BY lang),
tl AS (SELECT lang, coalesce(named, {OTHER_LANGUAGES} * t / sum(CASE WHEN named IS NULL THEN t END) OVER ()) AS raw FROM tl0),
c0 AS (SELECT c.*, tokens AS weight, ts.raw / (SELECT sum(raw) FROM ts) AS t_source, tl.raw / (SELECT sum(raw) FROM tl) AS t_lang, tt.raw / (SELECT sum(raw) FROM tt) AS t_topic
  FROM c JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic)),
{_rake_sql()},
g AS (SELECT rate, sum(tokens) AS t, sum(weight) AS w FROM fit GROUP BY rate),
s AS (SELECT rate, ({BUDGET} * sum(t) OVER () - coalesce(sum(t) OVER down, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER down, 0)) AS scale FROM g WINDOW down AS (ORDER BY rate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT max_by(scale, rate) AS scale FROM s WHERE scale * rate <= 1),
p AS (SELECT source, lang, topic, least(1.0, coalesce(scale * rate, 1.0)) AS prob FROM fit, best)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(prob, 0), 5) AS prob, d.u < coalesce(prob, 0) AS keep FROM d LEFT JOIN p USING (source, lang, topic)
"""
