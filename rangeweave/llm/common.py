"""What the operators share: scratch tables, vectorised word hashing, components of a graph."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 24


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share.

    Where that setting is absent and all runs on one machine (tests), a temporary folder is set for
    the session. On a cluster that would lose rows, so there the setting must be present.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rangeweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rangeweave/{uuid.uuid4().hex}"


def tune(spark: SparkSession) -> None:
    """Session settings that bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, *, partition_by: str | None = None, dictionary: bool = True) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it again.

    Cuts the lineage, so that a lost executor costs a read of files and not the whole job. The
    shuffle files behind df are released before returning. Tables of hashes, whose values hardly
    repeat, are written faster without a dictionary.
    """
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower())
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    schema = df.schema
    del df, writer
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to.

    The scheduler may still hold the job that ran last, so an empty one takes its place first.
    """
    spark.range(1, numPartitions=1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def likely(rows: DataFrame, wanted: DataFrame, column: str, slots: int = 1 << 16) -> DataFrame:
    """rows whose column (a long with well-mixed bits) may be in wanted (column), by a bitmap of fixed size.

    A filter before a join, to keep rows out of its shuffle: none that is wanted is lost. The bitmap
    is a table of `slots` rows at most, so it can be broadcast at any size of the input; when it is
    full it lets everything through.
    """
    slot = F.pmod(column, F.lit(slots))
    spot = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 40) & 63 as int))")
    bitmap = wanted.select(slot.alias("__slot"), spot.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))
    return rows.withColumn("__slot", slot).join(F.broadcast(bitmap), "__slot").where(spot.bitwiseAND(F.col("__bits")) != 0).select(*rows.columns)


# --- words ---------------------------------------------------------------------------------

#: Bytes between words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_U64 = np.uint64
#: The low bytes of a number, by how many.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes hashed at a time.
_SLICE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Roller:
    """Polynomial hashes modulo 2**64 of any slice of an array, by prefix sums.

    Each instance has its own random odd base and, for bytes, its own random table; two instances
    together give 128 independent bits.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = mix64(np.array([seed], dtype=np.uint64))[0]
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
        self.base = int(rng.integers(2**62, 2**63)) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([[_U64(1)], np.full(n - 1, b, dtype=np.uint64)]).cumprod(dtype=np.uint64) for b in (self.base, self.inverse))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each data[start:end] of bytes; starts and ends ascend. Works in slices of bounded size."""
        out, k = np.zeros(len(starts), dtype=np.uint64), 0
        while k < len(starts):
            m = max(k + 1, int(np.searchsorted(ends, starts[k] + _SLICE, side="right")))
            low, high = starts[k], ends[m - 1]
            out[k:m] = self.slices(self.prefix(self.table[data[low:high]]), starts[k:m] - low, ends[k:m] - low)
            k = m
        return out

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """64-bit hash of every k consecutive words: len(words) - k + 1 of them."""
        if len(words) < k:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(len(words) - k + 1)
        return self.slices(self.prefix(words), at, at + k)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: Roller) -> np.ndarray:
    """64-bit hash of each data[start:end]: of the bytes as two numbers where they fit, else by `long`. Starts and ends ascend."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))
    size = ends - starts
    out = mix64(eight[starts] & _MASKS[np.minimum(size, 8)] ^ (mix64(np.arange(18, dtype=np.uint64)) ^ long.seed)[np.minimum(size, 17)])
    more = np.flatnonzero(size > 8)
    out[more] = mix64(out[more] ^ (eight[starts[more] + 8] & _MASKS[np.minimum(size[more] - 8, 8)]))
    most = np.flatnonzero(size > 16)
    if len(most):
        # Only the bytes of these words, which are few, are looked at.
        tops = np.append(0, np.cumsum(size[most]))
        own = np.arange(tops[-1]) + np.repeat(starts[most] - tops[:-1], size[most])
        out[most] = long.words(data[own], tops[:-1], tops[1:])
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in the UTF-8 bytes of one text."""
    ink = np.zeros(len(data) + 2, dtype=np.int8)
    ink[1:-1] = ~_SPACE[data]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- groups --------------------------------------------------------------------------------


def components(edges: DataFrame, *, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps over a staged edge table; every step is a min
    aggregate (combined before the shuffle) and a join, so no neighbour list is ever gathered.
    Nodes without an edge are not returned. Null ends and loops are ignored.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        # a > b in every row. Large: each node links its larger neighbours to its smallest one.
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            out = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
            near = e.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = near.where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.distinct()

    e = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        e = stage(star(stage(star(e, True)), False))
        # The edge set has settled when its size and a checksum of its rows stay the same.
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) % 1000003 as decimal(38,0)))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
