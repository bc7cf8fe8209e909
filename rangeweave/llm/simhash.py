"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints are 64 bits: majority votes of the XXH64 values of a text's word shingles. To find
all pairs within ``tau`` bits, the 64 bit positions are dealt into m parts, correlated positions
into the same part, and part i gets a threshold t_i with sum(t_i) = tau - m + 1 (-1: the part is
not used). By the generalised pigeonhole principle every pair within tau differs in at most t_i
bits of some used part. Parts and thresholds are chosen by dynamic programming on candidate counts
estimated from the bit frequencies of all fingerprints. A part with threshold t is probed by
leaving out every choice of t of its bits: two values within t bits share one of the reduced keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rangeweave.llm.common import components, stage, tune

SHINGLE = 3
TAU = 3
SEED = 42
#: Rows of a block; larger buckets are compared block by block in separate groups.
BLOCK = 1000
#: Costs of a bucket row, a compared pair and one more kind of key in the plan, for choosing the parts.
ROW_COST, PAIR_COST, KEY_COST = 400.0, 1.0, 1e8
#: Kinds of keys of one part; a plan of thousands could not be compiled.
MOST_KEYS = 600


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint, as an unsigned integer, of one UTF-8 text; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(flat[i:j], SEED) for i, j in spans], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id_col, fp): fp the fingerprint as a signed long. Null and empty texts have fp 0."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in pc.cast(b.column(1), pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


# --- the plan of the search ------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and the 64 x 64 matrix of how often two bits are both 1, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), dtype=np.float64), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "both"])

    parts = fps.select("fp").mapInArrow(run, "n long, both array<double>")
    sums = parts.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = sums.collect()  # 4,096 rows at any size of the input
    both = np.zeros(4096)
    for r in rows:
        both[r["at"]] = r["v"]
    return int(rows[0]["n"]) if rows else 0, both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """64 bit positions in m groups of near-equal size, correlated positions together."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, groups))) // (m - k)
        own = [max(left, key=lambda j: (corr[j, left].sum(), -j))]
        left.remove(own[0])
        while len(own) < width:
            own.append(best := max(left, key=lambda j: (corr[j, own].sum(), -j)))
            left.remove(best)
        groups.append(sorted(own))
    return groups


def within(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated shares of pairs that differ in at most 0, 1, .. most of these bits."""
    at = np.zeros(most + 2)
    at[0] = 1.0
    for j in bits:
        q = 2 * p[j] * (1 - p[j])
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return np.minimum(np.cumsum(at[: most + 1]), 1.0).tolist()


def allocate(n: int, both: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Parts and thresholds [(bits, t)] of least estimated cost, over all numbers of parts up to tau + 3."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, tau + 4):
        groups, want = group_bits(n, both, m), tau - m + 1
        # table[s]: least cost, and thresholds, of the parts so far with thresholds of sum s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for k, bits in enumerate(groups):
            share = within(p, bits, tau)
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in table.items():
                for t in range(-1, tau + 1):
                    keys = comb(len(bits), t) if t >= 0 else 0
                    if keys > MOST_KEYS:
                        continue
                    own = keys * (n * ROW_COST + KEY_COST) + (share[t] * n * n / 2 * PAIR_COST * (comb(len(bits), t) ** 0.5) if t >= 0 else 0)
                    if s + t - (len(groups) - 1 - k) <= want and (s + t not in new or cost + own < new[s + t][0]):
                        new[s + t] = (cost + own, [*ts, t])
            table = new
        if want in table and (best is None or table[want][0] < best[0]):
            best = table[want][0], [(g, t) for g, t in zip(groups, table[want][1], strict=True) if t >= 0]
    assert best is not None
    return best[1]


def probe_masks(plan: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(part, mask of the bits kept) of every key, as signed longs."""
    out = []
    for i, (bits, t) in enumerate(plan):
        for gone in combinations(bits, t):
            mask = sum(1 << j for j in bits if j not in gone)
            out.append((i, mask - (1 << 64) if mask >= 1 << 63 else mask))
    return out


# --- probing and verification -----------------------------------------------------------------


def blocks(keyed: DataFrame, key: str = "key", block: int = BLOCK) -> DataFrame:
    """keyed rows (key, item, ..) of keys that occur twice or more, as (g, item, ..) rows of bounded groups.

    A bucket of c rows is dealt into ceil(c / block) blocks by a hash of the item, and every pair
    of blocks becomes one group g: any two items of a bucket meet in some group, and no group
    exceeds about two blocks whatever the bucket's size.
    """
    sizes = stage(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    n = F.ceil(F.col("c") / block).cast("int")
    rows = keyed.join(sizes, key).withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("item", F.lit(7)), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("g"), *[c for c in keyed.columns if c != key])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n items' component under the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_groups(rows: DataFrame, linked, columns: list[str], id_type: str) -> DataFrame:
    """Edges (a, b) of a spanning forest of each group's links.

    rows: (g, item, ...); columns: what linked() gets. linked(arrays, i, j) tells for candidate
    pairs of positions which ones are links. All pairs of a group are looked at in vectors; what
    leaves the task is at most one edge for each row.
    """

    def emit(g: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        heads, tails, at, d = [], [], np.arange(len(g)), 1
        while True:
            at = at[: np.searchsorted(at, len(g) - d)]
            at = at[g[at] == g[at + d]]
            if not len(at):
                break
            hit = at[linked(cols, at, at + d)]
            heads.append(hit)
            tails.append(hit + d)
            d += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (heads, tails))
        label = spanning(i, j, len(g))
        own = np.flatnonzero(label != np.arange(len(g)))
        item = cols["item"]
        return pa.RecordBatch.from_arrays([pa.array(item[own]), pa.array(item[label[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 8 * BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            g = t["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            held = t.slice(cut).to_batches()
            if cut:
                yield emit(g[:cut], {c: t[c].slice(0, cut).to_numpy() for c in columns})
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield emit(t["g"].to_numpy(), {c: t[c].to_numpy() for c in columns})

    sorted_rows = rows.select("g", *columns).repartition("g").sortWithinPartitions("g")
    return sorted_rows.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def near_fingerprints(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """Links (a, b), enough of them to connect all fp within tau bits. fps: distinct values fp."""
    n, both = bit_statistics(fps)
    masks = probe_masks(allocate(n, both, tau))
    keys = F.array(*[F.xxhash64(F.lit(i), F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for i, m in masks])
    keyed = fps.select(F.explode(keys).alias("key"), F.col("fp").alias("item"))

    def linked(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = cols["item"].view(np.uint64)
        return np.bitwise_count(x[i] ^ x[j]) <= tau

    return link_groups(blocks(keyed), linked, ["item"], "long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most tau bits are linked; component_id is the
    smallest id reachable. Empty, blank and null texts have fingerprint zero, which links like any
    other. Texts of fewer words than a shingle are one shingle. Repeated rows each give a row;
    null ids are ignored in the minimum (a component of null ids only has a null component_id).
    Equal fingerprints are one node, so groups of copies never become pairs. An empty table gives
    an empty result; columns other than the two named are not looked at.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = stage(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    joined = components(near_fingerprints(nodes.select("fp"), tau))
    roots = stage(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(roots.join(least, "root").select("fp", "component_id"))
    out = rows.join(named, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """docs with one document of each near-duplicate group: the one of the smallest id.

    Of rows that repeat that id, one stays. Rows without an id stay, as nothing can name them. Null
    and empty texts are one group; columns of any other name pass through, and an empty table gives
    an empty result.
    """
    return one_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, tau=tau), id_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """docs whose id names its component in found (id_col, component_id), once each, and those without an id."""
    marks = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("c"), F.max(F.col(id_col) == F.col("component_id")).alias("keep"))
    marks = stage(marks.where("not keep or c > 1"))
    once = docs.join(stage(marks.select(id_col)), id_col, "left_anti")
    more = docs.join(stage(marks.where("keep").select(id_col)), id_col, "left_semi").dropDuplicates([id_col])
    return once.unionByName(more.select(*[F.col(f"`{c}`") for c in docs.columns]))
