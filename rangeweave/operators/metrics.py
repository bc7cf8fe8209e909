"""Quality and size of what was encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.params import CodecParams

HEADER_BYTES, MATCH_BYTES = 66, 17


def snr(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """Rows (sid, snr) in dB over the samples both have; infinite without noise."""
    both = original.select("sid", "i", F.col("x").alias("a")).join(decoded.select("sid", "i", F.col("x").alias("b")), ["sid", "i"])
    sums = both.groupBy("sid").agg(F.sum(F.col("a") * F.col("a")).alias("signal"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("noise"))
    value = F.when(F.col("noise") <= 0, float("inf")).when(F.col("signal") <= 0, float("-inf")).otherwise(10 * F.log10(F.col("signal") / F.col("noise")))
    return sums.select("sid", value.alias("snr"))


def compression_ratio(lengths: DataFrame, p: CodecParams, *, bytes_per_sample: int = 2) -> DataFrame:
    """Rows (sid, in_bytes, out_bytes, ratio) from the lengths (sid, n): the container's size is known beforehand."""
    n_ranges = F.ceil(F.col("n") / p.R)
    n_domains = F.when(F.col("n") < p.tile, 0).otherwise(F.floor((F.col("n") - p.tile) / p.step) + 1)
    rows = lengths.select("sid", (F.col("n") * bytes_per_sample).cast("long").alias("in_bytes"), (HEADER_BYTES + 4 * p.R * n_domains + MATCH_BYTES * n_ranges).cast("long").alias("out_bytes"))
    return rows.withColumn("ratio", F.when(F.col("out_bytes") > 0, F.col("in_bytes") / F.col("out_bytes")).otherwise(0.0))
