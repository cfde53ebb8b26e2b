"""Carrying values between areas through population-weighted blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import weighted_mean_of_sums, weighted_sums
from ..operators.aggregate import stack_grains
from ..operators.joins import left_join


def _by_block_key(blocks: DataFrame, key: str, grains: dict[str, str], weight: str) -> DataFrame:
    """Blocks summed to (districts, source area): what the join has to carry.

    Blocks of one source area in the same districts share the joined value, so
    weights and counts add up first.  Counts of zero weight are kept apart,
    because a null value counts there as absent.
    """
    w = F.col(weight)
    return blocks.groupBy(*grains.values(), key).agg(
        F.sum(w).alias("__weight"),
        F.count(F.lit(1)).alias("__n"),
        F.count_if(w.isNull()).alias("__unknown"),
    )


def _weighted(blocks: DataFrame, values: DataFrame, key: str, value: str, weight: str, grains, skip_null: bool) -> DataFrame:
    joined = left_join(_by_block_key(blocks, key, grains, weight), values, [key])
    # A sum over blocks with an unknown weight is itself unknown.
    w = F.when(F.col("__unknown") == 0, F.col("__weight"))
    districts = list(grains.values())
    summed = joined.groupBy(*districts).agg(
        *weighted_sums(F.col(value), w, skip_null), F.sum("__n").alias("__rows")
    )
    measures = [weighted_mean_of_sums().alias(value), F.sum("__rows").alias("n")]
    return stack_grains(summed, grains, measures)


def score_by_area(
    blocks: DataFrame, answers: DataFrame, area: str, score: str, weight: str, grains: dict[str, str], name: str
) -> DataFrame:
    """Survey scores averaged by area, then over the blocks of each district.

    ``grains`` maps a chamber label to the district column of ``blocks``.  Areas
    without answers are left out with their population.
    """
    means = answers.groupBy(area).agg(F.avg(score).alias(score))
    means = means.filter(F.col(area).isNotNull())
    return _weighted(blocks, means, area, score, weight, grains, True).withColumnRenamed(score, name)


def areal_share(blocks: DataFrame, shares: DataFrame, area: str, share: str, weight: str, grains: dict[str, str]) -> DataFrame:
    """Shares known by area, averaged over the blocks of each district.

    A populated block whose area has no share makes the district's share null.
    """
    return _weighted(blocks, shares, area, share, weight, grains, False).drop("n")
