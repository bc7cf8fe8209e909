"""Best affine match of a range among its candidates.

A pair is fitted as r ~ s * t + o for the tile t and its mirror image; the error is the norm of the
residual. Errors are compared at ERROR_DIGITS decimals, ties go to the tile as it is before its
mirror, then to the better similarity rank. Scales are clipped only after the choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeweave.functions import vec

ERROR_DIGITS = 9


def fit(pairs: DataFrame, n: int, *, r: str = "r", t: str = "tile", weights: str | None = None, tiny: float = 1e-12) -> DataFrame:
    """pairs with s, o and err of the affine fit of range r by tile t; weights: a column of factors of
    the residual's elements. Means, scale, offset and error are steps of their own."""
    out = pairs.withColumn("__mr", vec.mean(r, n)).withColumn("__mt", vec.mean(t, n))
    rc, tc = ([x - F.col(m) for x in vec.items(v, n)] for v, m in ((r, "__mr"), (t, "__mt")))
    out = out.withColumn("s", vec.total([a * b for a, b in zip(rc, tc, strict=True)]) / (vec.total([b * b for b in tc]) + tiny))
    out = out.withColumn("o", F.col("__mr") - F.col("s") * F.col("__mt"))
    gaps = [F.col("s") * b + F.col("o") - a for a, b in zip(vec.items(r, n), vec.items(t, n), strict=True)]
    if weights:
        gaps = [g * w for g, w in zip(gaps, vec.items(weights, n), strict=True)]
    out = out.withColumn("__gap", F.array(*gaps))
    return out.withColumn("err", F.round(vec.norm("__gap", n), ERROR_DIGITS)).drop("__mr", "__mt", "__gap")


def both_ways(pairs: DataFrame, n: int, *, weights: list[Column] | None = None) -> DataFrame:
    """Each pair twice, fitted: sym 0 with its tile, sym 1 with the tile's mirror."""
    rows = pairs.withColumn("__w", F.array(*weights)) if weights else pairs
    out = fit(symmetry_pairs(rows), n, weights="__w" if weights else None)
    return out.drop("__w") if weights else out


def symmetry_pairs(rows: DataFrame, vector: str = "tile") -> DataFrame:
    """Each row as it is (sym 0) and with its vector reversed (sym 1)."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("sym"), F.col(vector).alias("v")), F.struct(F.lit(1).alias("sym"), F.reverse(vector).alias("v"))))
    return rows.withColumn("way", ways).select(*[c for c in rows.columns if c != vector], F.col("way.sym").alias("sym"), F.col("way.v").alias(vector))


def choose(fits: DataFrame, *, group: list[str], s_clip: float) -> DataFrame:
    """The row of least (err, sym, rank) in each group: (group.., dom, s, o, sym, err)."""
    best = fits.groupBy(*group).agg(F.min(F.struct("err", "sym", "rank", "dom", "s", "o")).alias("best"))
    return best.select(*group, "best.dom", vec.clip(F.col("best.s"), s_clip).alias("s"), "best.o", "best.sym", "best.err")


def best_match(pairs: DataFrame, n: int, *, group: list[str] = ("sid", "rid"), s_clip: float = 16.0) -> DataFrame:
    """Best match of each range. pairs: candidates (sid, rid, rank, dom) with r and tile."""
    return choose(both_ways(pairs, n), group=list(group), s_clip=s_clip)


def best_textured_match(pairs: DataFrame, n: int, *, group: list[str] = ("sid", "rid"), flat: float = 1e-12) -> DataFrame:
    """Best match among tiles that are not flat (centred energy of `flat` or more); scales as fitted.

    Ranges whose candidates are all flat have no row.
    """
    textured = pairs.withColumn("__tc", vec.centred("tile", n)).where(vec.energy("__tc", n) >= flat).drop("__tc")
    return choose(both_ways(textured, n), group=list(group), s_clip=float("inf"))


def perceptual_weights(r: str, n: int, *, transient: float = 1.0, mask: str | None = None) -> list[Column]:
    """Weights falling from 1 to 0.5, raised where the range steps to its next element."""
    xs = vec.items(r, n)
    steps = [F.abs(b - a) for a, b in zip(xs[:-1], xs[1:], strict=True)] + [F.lit(0.0)]
    if mask:
        steps = [e * m for e, m in zip(steps, vec.items(mask, n), strict=True)]
    return [F.lit(w) * (1 + transient * e) for w, e in zip(vec.ramp(1.0, 0.5, n), steps, strict=True)]


def perceptual_error(tile: str, r: str, n: int, **options) -> Column:
    """Norm of the weighted difference of a tile and a range, without a fit."""
    gaps = [(a - b) * w for a, b, w in zip(vec.items(tile, n), vec.items(r, n), perceptual_weights(r, n, **options), strict=True)]
    return F.sqrt(vec.total([g * g for g in gaps]))


def best_weighted_match(pairs: DataFrame, n: int, *, group: list[str] = ("sid", "rid"), transient: float = 1.0, low: float = 0.25, high: float = 4.0, prune: bool = False) -> DataFrame:
    """Best match by the weighted error of a plain fit, among tiles of similar energy.

    Only tiles whose centred energy over the range's lies strictly between low and high are looked
    at; scales are as fitted. Ranges left without a tile have no row. prune: mirrored tiles count
    only if the least plain error that their correlation allows is below the best weighted error of
    the tiles as they are; weights of less than 1 can lose a winner that way.
    """
    ratio = vec.energy("__tc", n) / (vec.energy("__rc", n) + 1e-12)
    near = pairs.withColumn("__tc", vec.centred("tile", n)).withColumn("__rc", vec.centred("r", n)).withColumn("__ratio", ratio)
    near = near.where((F.col("__ratio") > low) & (F.col("__ratio") < high)).drop("__tc", "__rc", "__ratio")
    fits = both_ways(near, n, weights=perceptual_weights("r", n, transient=transient))
    if prune:
        plain = F.min(F.when(F.col("sym") == 0, F.col("err"))).over(W.partitionBy(*group))
        fits = fits.withColumn("__plain", plain).withColumn("__tc", vec.centred("tile", n)).withColumn("__rc", vec.centred("r", n))
        fits = fits.where((F.col("sym") == 0) | (least_error(F.col("__rc"), F.col("__tc"), n) < F.col("__plain")))
    return choose(fits, group=list(group), s_clip=float("inf"))


def least_error(rc: Column, tc: Column, n: int) -> Column:
    """The least error of an unweighted fit that the correlation of two centred vectors allows."""
    size = vec.norm(rc, n)
    return F.round(size * F.sqrt(1 - F.pow(F.least(F.lit(1.0), vec.correlation_bound(rc, tc, n)), F.lit(2.0))), ERROR_DIGITS)
