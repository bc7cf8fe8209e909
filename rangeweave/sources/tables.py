"""Signals from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(table: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Samples (sid, i, x): the values of each key in the given order, numbered from 0.

    Positions of a key come from a window over the key; keys with more rows than one task should
    hold want `series_long`.
    """
    i = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return table.select(F.col(key).cast("string").alias("sid"), i.cast("long").alias("i"), F.col(value).cast("double").alias("x"))


def series_long(table: DataFrame, key: str, value: str, time: str, order: list[str], *, unit: str = "day") -> DataFrame:
    """series() for long signals in time order: rows are numbered within spans of `time`, then spans are offset.

    time must be the first column of the order.
    """
    rows = table.withColumn("__span", F.date_trunc(unit, time))
    counts = rows.groupBy(key, "__span").agg(F.count(F.lit(1)).alias("c"))
    head = F.coalesce(F.sum("c").over(W.partitionBy(key).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select(F.col(key).alias("__k"), F.col("__span").alias("__s"), head.alias("head"))
    own = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, "__span").orderBy(*order)) - 1)
    joined = own.join(heads, F.col(key).eqNullSafe(F.col("__k")) & F.col("__span").eqNullSafe(F.col("__s")))
    return joined.select(F.col(key).cast("string").alias("sid"), (F.col("head") + F.col("__n")).cast("long").alias("i"), F.col(value).cast("double").alias("x"))


def lengths(samples: DataFrame) -> DataFrame:
    """Rows (sid, n)."""
    return samples.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


def downmix(samples: DataFrame) -> DataFrame:
    """Samples (sid, i, x) as the mean of the channels of (sid, i, ch, x)."""
    return samples.groupBy("sid", "i").agg(F.avg("x").alias("x"))


def sign_extend_24(word):
    """A 24-bit two's complement number held in the low bits of a larger one."""
    return word - F.shiftleft(word.bitwiseAND(F.lit(0x800000)), 1)


def quantize(x, bits: int):
    """Integer PCM of a sample: limited to the width, cut towards zero."""
    top = 1 << (bits - 1)
    return F.greatest(F.least(x, F.lit(float(top - 1))), F.lit(float(-top))).cast("int")
