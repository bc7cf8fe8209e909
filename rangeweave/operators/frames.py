"""Framing: padding, ranges, sliding frames, voice activity, masks.

Samples are rows (sid, i, x). No operator gathers a signal into one task: groups are frames of a
few samples, and what needs order across a long signal works on chunks of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames of a chunk in ordered passes over a signal.
FRAME_CHUNK = 65_536


def _ordered(cols: str = "x") -> Column:
    """The group's values in order of i."""
    return F.transform(F.sort_array(F.collect_list(F.struct("i", cols))), lambda s: s[cols])


def reflect_pad(samples: DataFrame, multiple: int) -> DataFrame:
    """samples with every signal's length brought up to a multiple, by reflection at its end.

    Sample n + j is sample n - 2 - j: the last one is not repeated. Shorter signals reflect again
    and again; a single sample repeats. Only the last `multiple` samples of a signal are moved.
    """
    last = samples.withColumn("back", F.row_number().over(W.partitionBy("sid").orderBy(F.desc("i")))).where(F.col("back") <= multiple)
    tails = last.groupBy("sid").agg((F.max("i") + 1).alias("n"), _ordered().alias("tail"))
    tails = tails.withColumn("pad", F.pmod(-F.col("n"), F.lit(multiple))).where("pad > 0")
    added = tails.select("sid", "n", "tail", F.explode(F.expr("sequence(n, n + pad - 1)")).alias("i"))
    period = F.greatest(2 * (F.col("n") - 1), F.lit(1))
    q = F.pmod("i", period)
    at = F.when(F.col("n") == 1, 0).otherwise(F.least(q, period - q)) - F.col("n") + F.size("tail")
    return samples.select("sid", "i", "x").unionByName(added.select("sid", "i", F.element_at("tail", (at + 1).cast("int")).alias("x")))


def ranges(samples: DataFrame, size: int, *, pad: bool = True) -> DataFrame:
    """Rows (sid, rid, r): non-overlapping runs of `size` samples; incomplete ones only if not padded away."""
    rows = reflect_pad(samples, size) if pad else samples
    return rows.groupBy("sid", F.floor(F.col("i") / size).alias("rid")).agg(_ordered().alias("r"))


def sliding_frames(samples: DataFrame, size: int, hop: int | None = None) -> DataFrame:
    """Rows (sid, frame, r) of all whole windows of `size` samples that start at a multiple of hop."""
    hop = hop or size
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop))
    each = samples.withColumn("frame", F.explode(F.sequence(low.cast("long"), F.floor(F.col("i") / hop).cast("long"))))
    each = each.where((F.col("i") >= F.col("frame") * hop) & (F.col("i") < F.col("frame") * hop + size))
    return each.groupBy("sid", "frame").agg(_ordered().alias("r")).where(F.size("r") == size)


def elements(rows: DataFrame, vector: str, *, at: str = "pos", value: str = "x") -> DataFrame:
    """One row per element of a vector column."""
    return rows.select(*[c for c in rows.columns if c != vector], F.posexplode(vector).alias(at, value))


def frame_energy(samples: DataFrame, frame: int, *, pad: bool = True) -> DataFrame:
    """Rows (sid, f, energy): mean square of every frame, the last one padded by reflection."""
    rows = reflect_pad(samples, frame) if pad else samples
    return rows.groupBy("sid", F.floor(F.col("i") / frame).alias("f")).agg(F.avg(F.col("x") * F.col("x")).alias("energy"))


def smooth(frames: DataFrame, width: int = 5) -> DataFrame:
    """frames with smoothed: the sum of the `width` frames around, missing ones as 0, over width.

    Every frame is sent to its neighbours and summed up there, so frames need no order.
    """
    ahead = (width - 1) // 2
    near = frames.select("sid", F.explode(F.expr(f"sequence(f - {ahead}, f + {width - 1 - ahead})")).alias("f"), F.col("energy").alias("e"), F.col("f").alias("from"))
    own = F.max(F.when(F.col("f") == F.col("from"), F.col("e")))
    return near.groupBy("sid", "f").agg(own.alias("energy"), (F.sum("e") / width).alias("smoothed")).where("energy is not null")


def hysteresis(frames: DataFrame, high: float, low: float | None = None, *, chunk: int = FRAME_CHUNK) -> DataFrame:
    """frames with voiced: 1 from a frame above `high` until one below `low` (half of high), else 0.

    The state at a frame is the last event at or before it. Events are carried within chunks of
    frames, then from chunk to chunk over one row each.
    """
    low = 0.5 * high if low is None else low
    rows = frames.withColumn("event", F.when(F.col("smoothed") > high, 1).when(F.col("smoothed") < low, 0)).withColumn("chunk", F.floor(F.col("f") / chunk))
    inner = W.partitionBy("sid", "chunk").orderBy("f").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("state", F.last("event", ignorenulls=True).over(inner))
    ends = rows.groupBy("sid", "chunk").agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("f"))).alias("end"))
    carry = F.last("end", ignorenulls=True).over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(ends.select("sid", "chunk", carry.alias("carry")), ["sid", "chunk"])
    return rows.select("sid", "f", "energy", "smoothed", F.coalesce("state", "carry", F.lit(0)).alias("voiced"))


def voiced_frames(samples: DataFrame, frame: int, high: float, low: float | None = None, width: int = 5) -> DataFrame:
    """Rows (sid, f, energy, smoothed, voiced)."""
    return hysteresis(smooth(frame_energy(samples, frame), width), high, low)


def mask(samples: DataFrame, frames: DataFrame, frame: int) -> DataFrame:
    """samples with x set to 0 in frames that are not voiced."""
    keyed = samples.withColumn("f", F.floor(F.col("i") / frame))
    joined = keyed.join(frames.select("sid", "f", "voiced"), ["sid", "f"])
    return joined.select("sid", "i", (F.col("x") * F.col("voiced")).alias("x"))


def active_signals(samples: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Rows (sid, energy, n) of signals whose sum of squares is not below the floor."""
    return samples.groupBy("sid").agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.count(F.lit(1)).alias("n")).where(F.col("energy") >= floor)


def transient_mask(samples: DataFrame, lag: int = 256) -> DataFrame:
    """Rows (sid, i, mask): rise of |x| over `lag` samples, over its signal's maximum + 1e-8.

    The sample `lag` back comes by an equi-join on position, so a long signal is not one task.
    """
    now = samples.select("sid", "i", F.abs("x").alias("a"))
    then = now.select("sid", (F.col("i") + lag).alias("i"), F.col("a").alias("b"))
    rise = now.join(then, ["sid", "i"], "left").select("sid", "i", F.greatest(F.lit(0.0), F.coalesce(F.col("a") - F.col("b"), F.lit(0.0))).alias("rise"))
    top = rise.groupBy("sid").agg(F.max("rise").alias("top"))
    return rise.join(top, "sid").select("sid", "i", (F.col("rise") / (F.col("top") + 1e-8)).alias("mask"))


def energy_prune(rows: DataFrame, size: int, threshold: float, *, vector: str = "r") -> DataFrame:
    """Ranges worth a search: mean square of at least 0.75 of the threshold."""
    from rangeweave.functions import vec

    return rows.where(vec.energy(vector, size) / size >= 0.75 * threshold)
