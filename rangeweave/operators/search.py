"""Top-k similarity joins by inner product.

exact: an equi-join on the signal and a ranked window, for many short signals; the rank limit is
applied before and after the shuffle. blocked: blocks of queries against blocks of entries as
matrix products, for few long signals. cells: entries lie in the cell of the centre they are most like, queries look into
the best cells only, as blocks. lsh: random projections find candidates, exact ranking follows. In
cells and lsh queries with fewer than k candidates are searched exactly.

Scores are compared at SCORE_DIGITS decimals, equal ones by the entry's number, so that a rank does
not hang on the last bit of a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeweave.functions import vec

SCORE_DIGITS = 9


def ranked(pairs: DataFrame, k: int | None, *, group: list[str], entry: str, score: str = "score") -> DataFrame:
    """pairs with rank 0, 1, .. in each group; only the first k if k is given."""
    w = W.partitionBy(*group).orderBy(F.desc(score), F.asc(entry))
    out = pairs.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank") - 1)


def score(a: str, b: str, dim: int, positions: list[int] | None = None):
    at = positions if positions is not None else range(dim)
    return F.round(vec.total([F.col(a).getItem(j) * F.col(b).getItem(j) for j in at]), SCORE_DIGITS)


def topk(queries: DataFrame, entries: DataFrame, k: int | None, dim: int, *, on: list[str], query: str, entry: str, emb: str = "emb", positions: list[int] | None = None) -> DataFrame:
    """Exact top k: the columns of both sides but the embeddings, score and rank. k None: all, ranked."""
    left = queries.withColumnRenamed(emb, "__q")
    right = entries.withColumnRenamed(emb, "__e")
    pairs = left.join(right, on).withColumn("score", score("__q", "__e", dim, positions)).drop("__q", "__e")
    return ranked(pairs, k, group=[*on, query], entry=entry)


def _best(s: np.ndarray, keys: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best scores of every row, ties to the smaller key."""
    rows, cols = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k, None]) if k is not None and k < s.shape[1] else (g.ravel() for g in np.indices(s.shape))
    order = np.lexsort((keys[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return (rows, cols) if k is None else (rows[nth < k], cols[nth < k])


def _split(df: DataFrame, on: str, key: str, rows: int, dense: bool, name: str) -> DataFrame:
    """df with the block of `rows` rows or so that each row falls into: by its number if those are dense, else by its hash."""
    if dense:
        return df.withColumn(name, F.floor(F.col(key) / rows))
    sizes = df.groupBy(F.col(on).alias("__on")).agg(F.ceil(F.count(F.lit(1)) / rows).alias("__blocks"))
    return df.join(sizes, F.col(on) == F.col("__on")).withColumn(name, F.pmod(F.xxhash64(key), F.col("__blocks"))).drop("__on", "__blocks")


def topk_blocked(queries: DataFrame, entries: DataFrame, k: int | None, *, on: str, query: str, entry: str, emb: str = "emb", rows: int = 2048, dense: bool = True) -> DataFrame:
    """Exact top k of (on, query, emb) among (on, entry, emb) in blocks of `rows`: (on, query, entry, score, rank).

    Every block of entries is a group of its own, to which all query blocks of its signal come, so
    the work spreads over as many tasks as there are blocks. k None: all entries, ranked. dense:
    whether the numbers within `on` have few gaps, so that they can name the blocks.
    """

    def block(df: DataFrame, key: str, name: str) -> DataFrame:
        return _split(df, on, key, rows, dense, f"{name}_b").groupBy(on, f"{name}_b").agg(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col(emb).alias("v"))).alias(name))

    right = block(entries, entry, "e")
    homes = _split(entries, on, entry, rows, dense, "e_b").select(on, "e_b").distinct()
    left = block(queries, query, "q").join(homes, on)
    pairs = left.join(right, [on, "e_b"]).select(on, "q", "e")

    def matrix(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        keys, v = cell.values.field("key").to_numpy(), cell.values.field("v")
        return keys, v.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                (asked, q), (keys, e) = matrix(b.column(1)[n]), matrix(b.column(2)[n])
                s = np.round(q @ e.T, SCORE_DIGITS)
                at, of = _best(s, keys, k)
                sid = b.column(0).take(pa.array(np.full(len(at), n)))
                yield pa.RecordBatch.from_arrays([sid, pa.array(asked[at]), pa.array(keys[of]), pa.array(s[at, of])], names=[on, query, entry, "score"])

    kind = queries.schema[on].dataType.simpleString()
    found = pairs.mapInArrow(run, f"{on} {kind}, {query} long, {entry} long, score double")
    return ranked(found, k, group=[on, query], entry=entry)


def _nearest(rows: DataFrame, centres: DataFrame, k: int, *, on: str, key: str, emb: str, slot: int = 1 << 16) -> DataFrame:
    """Rows (on, key, cell): the k best centres of every row. Rows of a long signal are dealt over slots, each with all centres."""
    sizes = rows.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / slot).alias("slots"))
    left = rows.join(sizes, on).select(F.struct(on, F.pmod(F.xxhash64(key), F.col("slots")).alias("slot")).alias("space"), key, emb)
    right = centres.join(sizes, on).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    right = right.select(F.struct(on, "slot").alias("space"), "cell", emb)
    found = topk_blocked(left, right, k, on="space", query=key, entry="cell", emb=emb, dense=False)
    return found.select(F.col(f"space.{on}").alias(on), key, "cell")


def topk_cells(queries: DataFrame, entries: DataFrame, k: int, *, on: str, query: str, entry: str, emb: str = "emb", probes: int = 16, rows: int = 2048) -> DataFrame:
    """Top k of (on, query, emb) among (on, entry, emb) in the `probes` best cells: (on, query, entry, score, rank).

    Of n entries of a signal about sqrt(n), by their hash, are centres; each entry is in the cell of
    its best centre, so a query meets about probes * sqrt(n) entries. With no more centres than
    probes the result is exact. Of entries with one embedding the k smallest numbers count, as more
    can never rank. Queries with fewer rows than they should have are searched in all cells.
    """
    sizes = entries.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    stride = F.greatest(F.floor(F.sqrt("n")), F.lit(1))
    centres = entries.join(sizes, on).where(F.pmod(F.xxhash64(entry), stride) == 0).select(on, F.col(entry).alias("cell"), emb)
    homes = _nearest(entries, centres, 1, on=on, key=entry, emb=emb)
    same = W.partitionBy(on, "cell", emb).orderBy(entry)
    held = entries.join(homes, [on, entry]).withColumn("__nth", F.row_number().over(same)).where(F.col("__nth") <= k)
    asked = queries.join(_nearest(queries, centres, probes, on=on, key=query, emb=emb), [on, query])
    space = F.struct(on, "cell").alias("space")
    near = topk_blocked(asked.select(space, query, emb), held.select(space, entry, emb), k, on="space", query=query, entry=entry, emb=emb, rows=rows, dense=False)
    found = ranked(near.select(F.col(f"space.{on}").alias(on), query, entry, "score"), k, group=[on, query], entry=entry)
    # The shuffle behind found is planned once and read by both uses.
    enough = found.groupBy(on, query).agg(F.count(F.lit(1)).alias("c")).join(sizes, on).where(F.col("c") >= F.least(F.lit(k), F.col("n"))).select(on, query)
    rest = topk_blocked(queries.select(on, query, emb).join(enough, [on, query], "left_anti"), entries.select(on, entry, emb), k, on=on, query=query, entry=entry, emb=emb, rows=rows)
    return found.join(enough, [on, query], "left_semi").unionByName(rest)


def lsh_index(entries: DataFrame, *, emb: str = "emb", bucket: float = 0.5, tables: int = 12, seed: int = 7):
    """A fitted random-projection index over the entries."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = entries.withColumn("features", array_to_vector(emb))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)


def topk_lsh(queries: DataFrame, entries: DataFrame, k: int, dim: int, *, query: str, entry: str, emb: str = "emb", radius: float = 1.2, **index) -> DataFrame:
    """Top k among the entries within `radius` of a query that the index finds: (query, entry, score, rank).

    Queries for which it finds fewer than k are ranked against all entries.
    """
    from pyspark.ml.functions import array_to_vector

    model = lsh_index(entries, emb=emb, **index)
    left = queries.select(F.col(query), F.col(emb).alias("__q")).withColumn("features", array_to_vector("__q"))
    right = entries.select(F.col(entry), F.col(emb).alias("__e")).withColumn("features", array_to_vector("__e"))
    near = model.approxSimilarityJoin(left, right, radius, "distance")
    pairs = near.select(F.col(f"datasetA.{query}").alias(query), F.col(f"datasetB.{entry}").alias(entry), F.col("datasetA.__q").alias("__q"), F.col("datasetB.__e").alias("__e"))
    found = pairs.select(query, entry, score("__q", "__e", dim).alias("score"))
    enough = found.groupBy(query).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).select(query)
    alone = queries.select(F.col(query), F.col(emb).alias("emb"), F.lit(0).alias("all")).join(enough, query, "left_anti")
    rest = topk_blocked(alone, entries.select(F.col(entry), F.col(emb).alias("emb"), F.lit(0).alias("all")), k, on="all", query=query, entry=entry)
    return ranked(found.join(enough, query, "left_semi"), k, group=[query], entry=entry).unionByName(rest.select(query, entry, "score", "rank"))
