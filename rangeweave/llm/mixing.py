"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source's target size comes from its weight, limited to `most` times its own size, what a
limit leaves over going to the others. A document's expected copies are target / size of its
source. Documents of a source are put in one order (by size class, then by a digest of the id),
their expected copies are summed up from the front, one random offset is added, and a document is
emitted once for every integer between the sums before and after it.

The order is cut into chunks of bounded size, (source, size class, digest range), so that no task
holds a source: sums run within chunks, then over the few rows of chunk totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeweave.llm.common import stage

MOST = 3
#: Rows of a chunk, on average, if ids are distinct.
CHUNK = 20_000
SEED = 17


def word_count(text: Column | str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Binary digits of the size: their number, then the first four. Sizes of a class differ by an eighth at most."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 4))


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, *, source: str = "source", most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on. Together the targets
    equal all sizes. None exceeds `most` times its source's size: capping the sources above that
    and sharing the excess by weight until none is above ends in min(cap, weight * level) for one
    level, found here from sums over the sources in the order of cap / weight.
    """
    by_name = W.orderBy(F.col(source).isNull(), F.col(source))
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col(source).isNull(), F.col(source))
    every = W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    found = ranked.withColumn("level", level)
    # The first source, in that order, that the level does not fill decides the level of all after it.
    own = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    found = found.withColumn("level", F.first(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return found.select(source, "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Rows (id, size, source, source_size, target, copies), one per row of docs.

    copies times size is what the mix takes of a document: every source's sum comes within about
    its largest document of its target, and no document is taken more than `most` times. Null
    texts and texts without a word have size 0. Null sources form one source. Rows that repeat an
    id are rows of their own, in an order that does not matter as they tie in size or not at all.
    If all sizes are 0, all targets and copies are 0. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    # One number of ranges for all sources, so that a chunk holds about `chunk` rows at most; from the count of rows alone.
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("digest", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = stage(rows)
    ranges = max(1, -(-rows.count() // chunk))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * ranges))
    key = ["source", "class", "range"]
    parts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    per_class = parts.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sized = per_class.groupBy("source").agg(F.sum("s").alias("source_size"))
    aimed = targets(sized, most=most)
    # Rows before each class of a source, then before each range of a class.
    head = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = per_class.select("source", "class", head.alias("head"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("source", "class").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    heads = parts.select(*key, inner.alias("inner")).alias("p").join(classes.alias("c"), same("p", "c", ["source", "class"]))
    heads = heads.select("p.source", "p.class", "p.range", (F.col("inner") + F.col("head")).alias("base")).alias("h").join(aimed.alias("t"), same("h", "t", ["source"]))
    heads = heads.select("h.source", "h.class", "h.range", "base", "source_size", "target")
    placed = rows.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy("digest", "id", "size"))).alias("r").join(heads.alias("h"), same("r", "h", key))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("r.source"), F.lit(""))))
    end = (F.col("base") + F.col("at")).cast("double")
    taken = F.floor(offset + end * rate) - F.floor(offset + (end - 1) * rate)
    return placed.select("id", "size", "r.source", "source_size", "target", F.least(taken, F.lit(most)).cast("long").alias("copies"))


def report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows (id, size, source_size, target, taken), taken the words that the mix takes of the row."""
    got = copies(docs, id_col=id_col, **options)
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns of docs, whatever their names.

    Rows that repeat an id with the same source and size get the copies of all of them together.
    Null texts and texts without a word have size 0 and are taken like any other; null ids and
    null sources are values of their own. An empty table gives an empty result.
    """
    got = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    counts = got.groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0").alias("k")
    own = [F.col(f"`{c}`") for c in (id_col, source_col, text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), own[0].alias("id"), own[1].cast("string").alias("source"), word_count(own[2]).alias("size"), F.xxhash64(own[2]).alias("tag")).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("id", "source", "size")]
    # Each of `rows` equal-keyed rows takes its share of the copies; the remainder goes by rank.
    rank = F.row_number().over(W.partitionBy("d.id", "d.source", "d.size").orderBy("tag"))
    placed = rows.join(counts, same).select("doc", "copies", "rows", F.when(F.col("rows") > 1, rank).otherwise(1).alias("rank"))
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("rank") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    taken = placed.select("doc", each.alias("each")).where("each > 0")
    return taken.select("doc", F.explode(F.expr("sequence(1, each)"))).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), c AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 4) AS class FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l
), p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, c.source,
    CAST(row_number() OVER (PARTITION BY c.source ORDER BY class, digest, c.doc_id, size) AS DOUBLE) AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('17/' || coalesce(c.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(u + place * rate) - floor(u + (place - 1) * rate), 3) AS BIGINT) AS taken FROM p
"""
