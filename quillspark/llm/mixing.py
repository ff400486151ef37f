"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The tokens of each (source, language, topic) cell are raked until the cells' weights meet the target marginals
of all three. A cell's calibrated probability follows from raked weight over tokens; documents are sampled by a
hash of their id, so a rerun or a lost executor gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, save

#: Up to so many cells are raked in one partition and broadcast to the documents; more are summed and joined by shuffles.
MAX_CELLS = 100_000
#: Targets: shares proportional to a power of the shares in the corpus; below 1 small groups gain.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 20
CALIBRATIONS = 8
KEEP = 0.7
SEED = 17


def tokens(text: str = "text") -> Column:
    """Runs without ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("long")


def form_topic(text: str = "text", n_tokens: str = "n_tokens") -> Column:
    """A topic by form, for corpora without a topic column: table, long, medium or short."""
    pipes = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("|"), F.lit(""))), F.lit(0))
    return F.when((pipes > 0) & (pipes * 20 >= F.col(n_tokens)), "table").when(F.col(n_tokens) >= 800, "long").when(F.col(n_tokens) >= 150, "medium").otherwise("short")


def _share(total: Column, target, name: str) -> Column:
    """The target share of a margin's value, before normalisation."""
    if isinstance(target, (int, float)):
        return F.pow(total, F.lit(float(target)))
    pairs = [F.lit(x) for kv in target.items() for x in (kv[0], float(kv[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0)) if pairs else F.lit(0.0)


def rake(cells: DataFrame, targets: dict, rounds: int = ROUNDS, keep: float = KEEP, calibrations: int = CALIBRATIONS) -> DataFrame:
    """cells (margin columns, n_docs, n_tokens) with weight, raked tokens, and probability.

    targets: for each margin column either a dict of target weights by value or a power of the corpus shares.
    A value missing from a dict has target 0; a target without tokens is ignored and the rest shares its part.
    keep: the share of all tokens that the sample holds on average, as far as probabilities up to 1 allow.
    """
    raked = _rake_together if cells.count() <= MAX_CELLS else _rake_apart
    return raked(cells, targets, rounds, keep, calibrations).select(*targets, "n_docs", "n_tokens", "weight", "probability")


def _rake_together(cells: DataFrame, targets: dict, rounds: int, keep: float, calibrations: int) -> DataFrame:
    """Windows over one partition, which holds all cells."""
    margins = list(targets)
    whole = W.partitionBy()
    df = cells.coalesce(1).withColumn("weight", F.col("n_tokens").cast("double"))
    for m in margins:
        df = df.withColumn(f"_t_{m}", _share(F.sum("weight").over(W.partitionBy(m)), targets[m], m))
        # each value counts once, by its cells' equal parts
        df = df.withColumn("_part", F.col(f"_t_{m}") / F.sum(F.lit(1)).over(W.partitionBy(m)))
        df = df.withColumn(f"_t_{m}", F.col(f"_t_{m}") / F.sum("_part").over(whole) * F.sum("weight").over(whole)).drop("_part")
    df = save(df, "cells")
    for i in range(rounds):
        df = df.coalesce(1) if i % 5 == 0 else df
        for m in margins:
            df = df.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_t_{m}"), F.sum("weight").over(W.partitionBy(m))), F.lit(0.0)))
        if i % 5 == 4 or i == rounds - 1:
            df = save(df, "cells")
    df = df.coalesce(1).withColumn("_ratio", _ratio()).withColumn("_scale", F.lit(keep))
    budget = F.lit(keep) * F.sum("n_tokens").over(whole)
    for _ in range(calibrations):
        full = F.col("_ratio") * F.col("_scale") >= 1
        fixed = F.sum(F.when(full, F.col("n_tokens")).otherwise(0)).over(whole)
        rest = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(whole)
        df = df.withColumn("_next", F.coalesce(F.try_divide(budget - fixed, rest), F.col("_scale")))
        df = df.withColumn("_scale", F.greatest("_next", "_scale")).drop("_next")
    return df.withColumn("probability", F.least(F.lit(1.0), F.col("_ratio") * F.col("_scale")))


def _rake_apart(cells: DataFrame, targets: dict, rounds: int, keep: float, calibrations: int) -> DataFrame:
    """The same with sums that are aggregated in part before they meet and then joined, so no task holds all cells or those of one value; only single numbers reach the driver."""

    def kept(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
        out = save(df, "cells")
        if before is not None:
            drop(before)
        return out

    df = kept(cells.withColumn("weight", F.col("n_tokens").cast("double")))
    tokens_ = df.agg(F.sum("weight")).first()[0] or 0.0
    aims = {}
    for m in targets:
        aim = df.groupBy(m).agg(_share(F.sum("weight"), targets[m], m).alias("_aim")) if isinstance(targets[m], (int, float)) else df.select(m).distinct().withColumn("_aim", _share(F.lit(0.0), targets[m], m))
        share = aim.agg(F.sum("_aim")).first()[0] or 0.0
        aims[m] = save(aim.withColumn("_aim", F.try_divide(F.col("_aim"), F.lit(float(share))) * tokens_), "aims")
    for _ in range(rounds):
        for m in targets:
            totals = df.groupBy(m).agg(F.sum("weight").alias("_sum")).join(aims[m], m)
            factor = F.coalesce(F.try_divide(F.col("weight") * F.col("_aim"), F.col("_sum")), F.lit(0.0))
            df = kept(df.join(totals, m).withColumn("weight", factor).select(*cells.columns, "weight"), df)
    df, scale = kept(df.withColumn("_ratio", _ratio()), df), float(keep)
    for _ in range(calibrations):
        full = F.col("_ratio") * F.lit(scale) >= 1
        fixed, rest = df.agg(F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if rest:
            scale = max(scale, (keep * tokens_ - fixed) / rest)
    return df.withColumn("probability", F.least(F.lit(1.0), F.col("_ratio") * F.lit(scale)))


def _ratio() -> Column:
    """Raked tokens for each token."""
    return F.coalesce(F.try_divide(F.col("weight"), F.col("n_tokens").cast("double")), F.lit(0.0))


def _uniform(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 13), 16, 10).cast("double") / float(2**52)


_MADE = ("topic", "n_tokens", "weight", "probability", "sampled")


def _mixed(docs: DataFrame, targets: dict | None, keep: float, seed: int, doc_id: str, text: str, topic: Column | None) -> DataFrame:
    """`docs` with the columns of mix() under names that begin with _quill_."""
    targets = targets or POWERS
    margins = list(targets)
    clear = docs.drop(*[c for c in docs.columns if c.startswith("_quill_")])
    tagged = clear.withColumn("_quill_n_tokens", tokens(text))
    tagged = tagged.withColumn("_quill_topic", topic if topic is not None else form_topic(text, "_quill_n_tokens"))
    keys = {m: F.coalesce(F.col("_quill_topic" if m == "topic" else m).cast("string"), F.lit("(none)")) for m in margins}
    cells = tagged.groupBy(*[c.alias(m) for m, c in keys.items()]).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_quill_n_tokens").alias("n_tokens"))
    raked = save(rake(save(cells, "counts"), targets, keep=keep), "raked")
    small = raked.count() <= MAX_CELLS
    raked = raked.select(*[F.col(m).alias(f"_quill_k_{m}") for m in margins], _ratio().alias("_quill_weight"), F.col("probability").alias("_quill_probability"))
    on = [keys[m] == F.col(f"_quill_k_{m}") for m in margins]
    out = tagged.join(F.broadcast(raked) if small else raked, on, "left").drop(*[f"_quill_k_{m}" for m in margins])
    return out.withColumn("_quill_sampled", _uniform(doc_id, seed) < F.col("_quill_probability"))


def mix(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    """`docs` with columns topic, n_tokens, weight (raked tokens for each token), probability and sampled.

    topic: an expression over the columns of `docs`, such as a topic column of theirs; without one, the form of
    the text stands in. Columns of the made names are replaced, topic after it was read; all others stay. A null
    source, language or topic is a group of its own, a null or empty text has no tokens and a probability of 0,
    except where every token is kept. Copies of a row share their fate; an empty table stays empty.
    """
    mixed = _mixed(docs, targets, keep, seed, doc_id, text, topic)
    return mixed.select(*[c for c in docs.columns if c not in _MADE and not c.startswith("_quill_")], *[F.col(f"_quill_{c}").alias(c) for c in _MADE])


def sample(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    """The sampled rows of `docs`, with its own columns as they are, but for those that begin with _quill_."""
    return _mixed(docs, targets, keep, seed, doc_id, text, topic).where("_quill_sampled").select(*[c for c in docs.columns if not c.startswith("_quill_")])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op6_sql() -> str:
    """The same rounds written out: three windows a round, then the calibrations."""
    steps = [
        r"""tagged AS (SELECT doc_id, source, lang, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS BIGINT) AS n_tokens FROM documents)""",
        """topics AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN p > 0 AND p * 20 >= n_tokens THEN 'table' WHEN n_tokens >= 800 THEN 'long' WHEN n_tokens >= 150 THEN 'medium' ELSE 'short' END AS topic
            FROM (SELECT *, coalesce(length(text) - length(replace(text, '|', '')), 0) AS p FROM tagged))""",
        """cells AS (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n_tokens FROM topics GROUP BY 1, 2, 3)""",
    ]
    for m in POWERS:
        steps.append(f"total_{m} AS (SELECT {m}, pow(sum(n_tokens), {POWERS[m]}) AS t FROM cells GROUP BY {m})")
        steps.append(f"target_{m} AS (SELECT {m}, t / (SELECT sum(t) FROM total_{m}) * (SELECT sum(n_tokens) FROM cells) AS t FROM total_{m})")
    steps.append("r0 AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n_tokens, c.n_tokens AS weight, ts.t AS t_source, tl.t AS t_lang, tt.t AS t_topic FROM cells c JOIN target_source ts USING (source) JOIN target_lang tl USING (lang) JOIN target_topic tt USING (topic))")
    k = 0
    for _ in range(ROUNDS):
        for m in POWERS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT source, lang, topic, n_tokens, t_source, t_lang, t_topic, coalesce(weight * t_{m} / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0) AS weight FROM r{k})")
            k += 1
    steps.append(f"s0 AS MATERIALIZED (SELECT source, lang, topic, n_tokens, weight, coalesce(weight / nullif(n_tokens, 0), 0) AS ratio, CAST({KEEP} AS DOUBLE) AS scale FROM r{k})")
    for i in range(CALIBRATIONS):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT source, lang, topic, n_tokens, weight, ratio, greatest(scale, coalesce(({KEEP} * sum(n_tokens) OVER () - sum(CASE WHEN ratio * scale >= 1 THEN n_tokens ELSE 0 END) OVER ())
            / nullif(sum(CASE WHEN ratio * scale >= 1 THEN 0 ELSE weight END) OVER (), 0), scale)) AS scale FROM s{i})""")
    return f"""WITH {", ".join(steps)}
    SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(c.ratio, 6) AS weight, round(least(1.0, c.ratio * c.scale), 6) AS probability,
        CAST(CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || '|{SEED}'), 1, 13)) AS BIGINT) AS DOUBLE) / {float(2**52)} < least(1.0, c.ratio * c.scale) AS sampled
    FROM topics d JOIN s{CALIBRATIONS} c ON coalesce(d.source, '(none)') = c.source AND coalesce(d.lang, '(none)') = c.lang AND d.topic = c.topic"""
