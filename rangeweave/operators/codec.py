"""Encoding signals as matches with a dictionary of their own windows, and decoding.

Decoding needs no loop: tiles come from the stored dictionary, never from the output, so what the
passes of an iterative decoder reach has a closed form, and so has the pass at which it would stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions import vec
from rangeweave.operators import domains as D
from rangeweave.operators import embed, frames, match, search
from rangeweave.params import CodecParams

FLAT = 1e-12


def dictionary(samples: DataFrame, p: CodecParams) -> DataFrame:
    """Rows (sid, dom, tile, emb) of the unmasked signals."""
    return embed.with_embedding(D.domains(samples, p.tile, p.R, p.step), "tile", p.R, p.emb_dim)


def source_ranges(samples: DataFrame, p: CodecParams) -> DataFrame:
    """Rows (sid, rid, r) of signals that are not silent, voiced frames only if p.mask."""
    live = samples
    if p.mask:
        live = frames.mask(samples, frames.voiced_frames(samples, p.frame, p.energy_threshold, width=p.smooth_window), p.frame)
    loud = frames.active_signals(live).select("sid")
    return frames.ranges(live.join(loud, "sid", "left_semi"), p.R)


def settled(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the shared folder of spark.checkpoint.dir, or persisted where that is unset."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def candidates(ranges: DataFrame, domains: DataFrame, p: CodecParams) -> DataFrame:
    """Rows (sid, rid, rank, dom, score, r, tile): the top_k entries of each range that is loud enough.

    Blocked and cell search settle what they read, as they read it several times, and move numbers
    and embeddings only; r and tile join what they find.
    """
    loud = frames.energy_prune(ranges, p.R, p.energy_threshold)
    positions = embed.live_positions(p.R, p.emb_dim) if p.R <= embed.UNROLL else None
    if p.query_mode == "range":
        queries = embed.with_embedding(loud, "r", p.R, p.emb_dim)
    else:
        own = domains.select("sid", F.col("dom").alias("rid"), "emb")
        queries = loud.join(own, ["sid", "rid"])
    if p.search_mode == "exact":
        return search.topk(queries, domains, p.top_k, p.emb_dim, on=["sid"], query="rid", entry="dom", positions=positions)
    queries, domains = settled(queries.select("sid", "rid", "r", "emb")), settled(domains.select("sid", "dom", "tile", "emb"))
    names = {"on": "sid", "query": "rid", "entry": "dom"}
    asked, held = queries.select("sid", "rid", "emb"), domains.select("sid", "dom", "emb")
    found = search.topk_blocked(asked, held, p.top_k, **names) if p.search_mode == "blocked" else search.topk_cells(asked, held, p.top_k, probes=p.probes, **names)
    return found.join(queries.select("sid", "rid", "r"), ["sid", "rid"]).join(domains.select("sid", "dom", "tile"), ["sid", "dom"])


def encode(samples: DataFrame, p: CodecParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges, domains, matches) of all signals. Silent signals have no rows.

    Every range of a signal that has a dictionary gets a match: ranges too quiet to search, and
    those without a query in "domain_alias" mode, follow p.silence_mode.
    """
    ranges, domains = source_ranges(samples, p), dictionary(samples, p)
    found = match.best_match(candidates(ranges, domains, p), p.R, s_clip=p.s_clip)
    sentinel = p.silence_mode == "sentinel"
    fill = {"dom": F.lit(-1 if sentinel else 0).cast("long"), "s": F.lit(0.0), "o": F.lit(0.0), "sym": F.lit(0), "err": F.lit(0.0 if sentinel else float("inf"))}
    known = domains.where("dom = 0").select("sid")
    rows = ranges.select("sid", "rid").join(known, "sid", "left_semi").join(found, ["sid", "rid"], "left")
    return ranges, domains, rows.select("sid", "rid", *[F.when(F.col("sym").isNull(), v).otherwise(F.col(c)).alias(c) for c, v in fill.items()])


def gather(matches: DataFrame, domains: DataFrame, size: int) -> DataFrame:
    """matches with the tile each one names, mirrored where sym = 1; zeros (and s = o = 0) for none.

    textured: whether the tile is not flat.
    """
    rows = matches.join(domains.select("sid", "dom", "tile"), ["sid", "dom"], "left")
    none = F.array(*[F.lit(0.0)] * size)
    tile = F.when(F.col("tile").isNull(), none).when(F.col("sym") == 1, F.reverse("tile")).otherwise(F.col("tile"))
    rows = rows.select("sid", "rid", "dom", tile.alias("tile"), *[F.when(F.col("dom") < 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("s", "o")], "sym")
    rows = rows.withColumn("__m", vec.mean("tile", size)).withColumn("__c", F.array(*[x - F.col("__m") for x in vec.items("tile", size)]))
    return rows.withColumn("textured", vec.energy("__c", size) > FLAT).drop("__m", "__c")


def used_scale(p: CodecParams, passes: Column | None = None) -> Column:
    """The scale in force after so many passes (p.iterations if not given)."""
    d, s = p.s_damping, F.col("s")
    if p.scale_mode == "stored":
        return vec.clip(s, p.s_clip)
    if d == 0:
        return F.when(F.col("textured"), 0.0).otherwise(vec.clip(s, p.s_clip))
    t = F.lit(p.iterations) if passes is None else passes
    return F.when(F.col("textured"), vec.clip(s * (1 - F.pow(F.lit(d), t)), p.s_clip)).otherwise(vec.clip(s * (1 - d), p.s_clip))


def convergence(matches: DataFrame, domains: DataFrame, p: CodecParams) -> DataFrame:
    """Rows (sid, passes): the first pass whose relative change is below p.eps, else p.iterations.

    The output of pass t is f_t * v + F for fixed v and F with f_t = 1 - d ** t, so three sums over
    a signal give every pass's norm and change. Scales are taken as unclipped.
    """
    d, rows = p.s_damping, gather(matches, domains, p.R)
    ts = vec.items("tile", p.R)
    moving = F.col("textured")
    fixed_s = F.when(moving, 0.0).otherwise(F.col("s") * (1 - d) if d > 0 else F.col("s"))
    rows = rows.withColumn("__v", F.array(*[F.when(moving, F.col("s") * t).otherwise(0.0) for t in ts])).withColumn("__f", F.array(*[fixed_s * t + F.col("o") for t in ts]))
    sums = rows.groupBy("sid").agg(F.sum(vec.energy("__v", p.R)).alias("A"), F.sum(vec.dot("__v", "__f", p.R)).alias("B"), F.sum(vec.energy("__f", p.R)).alias("C"))
    share = [0.0] + [1 - d**t if d > 0 else 0.0 for t in range(1, p.iterations + 1)]
    size = [F.sqrt(F.greatest(F.lit(0.0), F.lit(g * g) * F.col("A") + F.lit(2 * g) * F.col("B") + F.col("C"))) for g in share]
    first, out = size[1], F.lit(p.iterations)
    for t in range(p.iterations, 1, -1):
        change = F.lit(abs(share[t] - share[t - 1])) * F.sqrt("A") / F.when(size[t - 1] > 0, size[t - 1]).otherwise(1.0)
        out = F.when(change < p.eps, t).otherwise(out)
    return sums.select("sid", F.when(first < p.eps, 1).otherwise(out).alias("passes"))


def decode(matches: DataFrame, domains: DataFrame, lengths: DataFrame, p: CodecParams) -> DataFrame:
    """Rows (sid, i, x). lengths: (sid, n), the signals' original lengths."""
    rows, passes = gather(matches, domains, p.R), None
    if p.scale_mode == "refit" and p.s_damping > 0 and p.eps > 0:
        rows, passes = rows.join(convergence(matches, domains, p), "sid"), F.col("passes")
    rows = rows.withColumn("used", used_scale(p, passes))
    out = F.array(*[F.col("used") * t + F.col("o") for t in vec.items("tile", p.R)])
    flat = rows.select("sid", "rid", out.alias("y")).join(lengths.select("sid", "n"), "sid")
    flat = flat.select("sid", "n", "rid", F.posexplode("y").alias("pos", "x"))
    return flat.select("sid", (F.col("rid") * p.R + F.col("pos")).alias("i"), "x", "n").where("i < n").drop("n")


def overlap_average(pieces: DataFrame, hop: int, vector: str = "r", frame: str = "frame") -> DataFrame:
    """Rows (sid, i, x): the mean over all frames that cover a sample; frame f starts at f * hop."""
    flat = pieces.select("sid", frame, F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy("sid", (F.col(frame) * hop + F.col("pos")).alias("i")).agg(F.avg("x").alias("x"))
