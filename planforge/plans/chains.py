"""The tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planforge.operators import analytics as N
from planforge.operators import capacity as K
from planforge.plans import layers


def base(spark: SparkSession, sf: str) -> DataFrame:
    """The planning base, from its layer."""
    return layers.planning(spark, sf)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with planning rows and equipment of a cell as arrays: for figures that need no row per pair of both."""
    return layers.refreshed(spark, sf).folded()


def capacity(spark: SparkSession, sf: str) -> DataFrame:
    return K.capacity_modes(base(spark, sf))


def both_modes(base: DataFrame) -> DataFrame:
    return N.flexible(K.normal_and_maximum(base))


def demand_vs_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return both_modes(base(spark, sf))
