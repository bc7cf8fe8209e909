"""The dictionary: sliding windows of a signal, each shrunk to a range's size by block means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a chunk; a signal longer than that is cut, with an overlap of one window.
CHUNK = 65_536


def domains(samples: DataFrame, tile: int, size: int, step: int = 1, *, chunk: int = CHUNK) -> DataFrame:
    """Rows (sid, dom, tile): window dom starts at sample dom * step and spans `tile` samples.

    The first size * (tile // size) of them are averaged in blocks. Windows that run over the end
    are left out. Each sample also goes to the chunk before if a window of that one may reach it.
    """
    chunk, block = max(chunk, tile), tile // size
    own = F.floor(F.col("i") / chunk)
    homes = F.when((F.col("i") % chunk < tile - 1) & (F.col("i") >= chunk), F.array(own, own - 1)).otherwise(F.array(own))
    rows = samples.select("sid", "i", "x", F.explode(homes).alias("chunk"))
    w = W.partitionBy("sid", "chunk").orderBy("i")
    means = F.avg("x").over(w.rowsBetween(0, block - 1))
    rows = rows.select("sid", "i", "chunk", means.alias("m"), F.lead("i", tile - 1).over(w).alias("end"))
    rows = rows.withColumn("tile", F.array(F.col("m"), *[F.lead("m", k * block).over(w) for k in range(1, size)]))
    whole = F.col("end").isNotNull() & (F.col("i") % step == 0) & (F.floor(F.col("i") / chunk) == F.col("chunk"))
    return rows.where(whole).select("sid", F.floor(F.col("i") / step).alias("dom"), "tile")
