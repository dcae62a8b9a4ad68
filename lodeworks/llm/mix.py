"""Mixing sources to target weights.

Tokens are added up per source, repetition rates follow from the target shares and
the caps, and each document is emitted floor(rate) times plus one copy by a
hash-seeded Bernoulli draw whose probability is the rate's fraction. Whether a document
gets that copy depends on its key, the mixture, the seed and the rate alone. Sources of few
documents miss their share by chance; :func:`shares` reports by how much and what
deviation the draw makes one expect. ``balanced=True`` is another draw
(see :func:`draw_thresholds`), which sets its thresholds on the tokens drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut

BUCKETS = 4_096
SEED = 42


def source_name(col: str) -> Column:
    """One spelling per source: lower case, outer space dropped, inner ``-`` and spaces as ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[-\s]+", "_")


def draw(key: str, mix: str, seed: int = SEED) -> Column:
    """Bucket of the document's draw, 0..BUCKETS-1, from a hash of document, mixture and seed alone."""
    return F.pmod(F.xxhash64(F.col(key), F.col(mix), F.lit(seed)), F.lit(BUCKETS)).cast("int")


def chance(key: str, mix: str, seed: int = SEED) -> Column:
    """The document's draw as a number of [0, 1) in steps of 2^-53, from the same hash."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(mix), F.lit(seed)), 11) * F.lit(2.0**-53)


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, share, tokens, docs, max_repeats, rate, expected_sd.

    sizes: source, tokens, docs, squares (the sum of the squared sizes). ``expected_sd`` is the standard deviation of
    the tokens that the Bernoulli draws give around rate x tokens. Shares are normalised over the sources of the mixture that
    hold any token; the mixture is made as large as the caps allow, so the tightest
    source is used ``max_repeats`` times and the others less. Rows of targets
    without a positive share or cap count as absent.
    """
    t = targets.where("target_share > 0 and max_repeats >= 1").select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats")
    t = t.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = t.join(sizes.where("tokens > 0"), "source")
    per_mix = W.partitionBy("mix_name")
    part = F.col("rate") - F.floor("rate")
    return (
        have.withColumn("share", F.col("target_share") / F.sum("target_share").over(per_mix))
        .withColumn("total", F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(per_mix))
        .withColumn("rate", F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("total") / F.col("tokens")))
        .withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate")))
        .withColumn("expected_sd", F.sqrt(part * (1 - part) * F.col("squares")))
        .select("mix_name", "source", "share", "tokens", "docs", "max_repeats", "rate", "expected_sd")
    )


def size_class(tokens: str = "n_tokens") -> Column:
    """Documents of like size: the whole part of log2 of their tokens."""
    return F.floor(F.log2(tokens)).cast("int")


def _thresholds(pdf: pd.DataFrame) -> pd.DataFrame:
    """One mixture and source: largest size class first, each class making up for what the larger ones missed."""
    pdf = pdf.sort_values(["size_class", "bucket"])
    rate = float(pdf["rate"].iloc[0])
    part, carry, out = rate - math.floor(rate), 0.0, []
    for size, held in reversed(list(pdf.groupby("size_class"))):
        drawn = np.concatenate([[0], np.cumsum(held["t"].to_numpy())])
        borders = np.concatenate([[0], held["bucket"].to_numpy() + 1])
        wanted = part * drawn[-1] + carry
        k = int(np.argmin(np.abs(drawn - wanted)))
        carry = wanted - drawn[k]
        out.append((pdf["mix_name"].iloc[0], pdf["source"].iloc[0], int(size), int(borders[k])))
    return pd.DataFrame(out, columns=["mix_name", "source", "size_class", "threshold"])


def draw_thresholds(docs: DataFrame, rate: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_name, source, size_class, threshold): documents whose bucket is below it get the extra copy.

    Per mixture, source and size class the tokens of each of the ``BUCKETS`` buckets are added up, with
    map-side combine, so a hot source shrinks before the shuffle to at most
    64 x BUCKETS rows. A threshold is the bucket border at which the drawn tokens come nearest to
    fraction x tokens.
    """
    held = (
        docs.join(rate.select("mix_name", "source", "rate"), "source")
        .groupBy("mix_name", "source", "rate", size_class().alias("size_class"), draw("doc_id", "mix_name", seed).alias("bucket"))
        .agg(F.sum("n_tokens").alias("t"))
    )
    return held.groupBy("mix_name", "source").applyInPandas(_thresholds, "mix_name string, source string, size_class int, threshold int")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = SEED, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). docs: doc_id, source, n_tokens (see :func:`source_name`).

    rows: mix_name, doc_id, source, copy (from 1), n_tokens, one row per copy. Documents without
    source, or of a source the mixture does not name, are not used; those without
    tokens add nothing and are left out. Repeated documents count as different ones
    with equal draws. Empty tables give empty results. The plan has one row per mixture and named source
    and is the only thing joined to the documents, which are never shuffled.
    """
    docs = docs.where("n_tokens > 0 and source is not null")
    square = F.col("n_tokens").cast("double") * F.col("n_tokens")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.sum(square).alias("squares"))
    plan = cut(rates(sizes, targets))
    use = plan.select("mix_name", "source", "rate")
    if balanced:
        use = use.join(draw_thresholds(docs, plan, seed), ["mix_name", "source"])
        drawn = docs.withColumn("size_class", size_class()).join(use, ["source", "size_class"])
        extra = draw("doc_id", "mix_name", seed) < F.col("threshold")
    else:
        drawn = docs.join(use, "source")
        extra = chance("doc_id", "mix_name", seed) < F.col("rate") - F.floor("rate")
    rows = (
        drawn.withColumn("copies", F.floor("rate").cast("int") + F.when(extra, 1).otherwise(0))
        .where("copies > 0")
        .select("mix_name", "doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")
    )
    return rows, plan


def shares(rows: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reached share of every source of every mixture; absent sources reach 0.

    ``deviation`` is used tokens less rate x tokens, ``expected_sd`` its standard deviation under the Bernoulli draw,
    ``z`` their ratio (null where nothing is left to chance).
    """
    got = rows.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    named = targets.select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats")
    per_mix = W.partitionBy("mix_name")
    deviation = F.coalesce(F.coalesce("used_tokens", F.lit(0)) - F.col("rate") * F.col("tokens"), F.lit(0.0))
    return (
        named.join(plan.select("mix_name", "source", "share", "rate", "tokens", "expected_sd"), ["mix_name", "source"], "left")
        .join(got, ["mix_name", "source"], "left")
        .select(
            "mix_name", "source", "target_share", F.round(F.coalesce("share", F.lit(0.0)), 9).alias("wanted_share"),
            F.round(F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(per_mix)), F.lit(0.0)), 9).alias("reached_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
            F.round(F.coalesce("rate", F.lit(0.0)), 9).alias("rate"),
            F.round(deviation, 3).alias("deviation"), F.round(F.coalesce("expected_sd", F.lit(0.0)), 3).alias("expected_sd"),
            F.round(F.when(F.col("expected_sd") > 0, deviation / F.col("expected_sd")), 4).alias("z"),
        )
    )
