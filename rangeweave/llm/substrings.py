"""Removal of long repeated passages by relative Lempel-Ziv parsing.

The reference is all text of the corpus, indexed by blocks: content-defined runs of BLOCK words,
chosen so that any WINDOW consecutive words hold at least one block and equal windows hold equal
blocks. A block's context is itself with WINDOW - BLOCK words on either side, as far as the text
goes: every window that holds the block lies within it.

A text is factored from left to right. A block whose whole context occurs earlier too points at the
first such place; a factor runs on over blocks as long as they point to one place after the other,
and all its words are duplicate. Where a factor ends, the context of the next block is one that no
earlier text has: there, and there only, windows are checked one by one against the windows around
the other first contexts of the same block. A window that is found is a factor of its own.

That finds every repeated window: contexts that are equal share all their windows, so the earliest
place of a window lies in the first of some context. What is shuffled is one row per block, then
the windows around blocks that have several contexts. Equal texts are one text from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.llm.common import Roller, likely, mix64, stage, tune, unstage, word_hashes, word_spans

WINDOW = 20
BLOCK = 6

_FIRST, _SECOND, _PLACE = Roller(11), Roller(12), Roller(13)


def _words(raw: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw or b"", dtype=np.uint8)
    return raw or b"", data, *word_spans(data)


def _sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every k neighbours."""
    have = 1
    while have < k:
        step = min(have, k - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def block_positions(words: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the index blocks of one text, given its word hashes.

    A block is chosen where its hash is the least of some window's blocks (all of them at ties).
    """
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g, w = _PLACE.grams(words, block), window - block + 1

    low = _sliding(g, w, np.minimum)  # of each window
    pad = np.zeros(w - 1, dtype=np.uint64)
    chosen = _sliding(np.concatenate([pad, low, pad]), w, np.maximum) == g
    at = np.flatnonzero(chosen)
    return at, g[at]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word."""
    return word_hashes(data, starts, ends, _FIRST), word_hashes(data, starts, ends, _SECOND)


def contexts(words: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the contexts of the blocks at `at`; a context that the text cuts off is unlike one that it does not."""
    n, reach = len(words[0]), window - block
    low, high = np.maximum(at - reach, 0), np.minimum(at + window, n)
    shape = ((at - low) * 64 + (high - at)).astype(np.uint64)
    return tuple(mix64(r.slices(r.prefix(w), low, high) ^ mix64(shape)) for r, w in zip((_FIRST, _SECOND), words, strict=True))


def _index(docs: DataFrame, id_col: str, text_col: str, window: int, block: int) -> DataFrame:
    """Rows (id, tag, n_words, digest, blocks) per input row; tag identifies the text, blocks are (h, c1, c2, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, found = [], [], []
            for raw in pc.cast(b.column(2), pa.binary()).to_pylist():
                raw, data, starts, ends = _words(raw)
                own = tuple(np.zeros(0, dtype=np.uint64) for _ in range(3)) + (np.zeros(0, dtype=np.int64),)
                if len(starts) >= window:
                    words = _hashes(data, starts, ends)
                    at, g = block_positions(words[0], window, block)
                    own = (g, *contexts(words, at, window, block), at)
                counts.append(len(starts))
                digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                found.append(own)
            tops = np.cumsum([0, *(len(x[3]) for x in found)])
            flat = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.uint64) for k in range(4)]
            blocks = pa.StructArray.from_arrays([*(pa.array(x.view(np.int64)) for x in flat[:3]), pa.array(flat[3].astype(np.int32))], ["h", "c1", "c2", "p"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(tops, pa.int32()), blocks)],
                names=["id", "tag", "n_words", "digest", "blocks"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, tag long, n_words long, digest string, blocks array<struct<h: long, c1: long, c2: long, p: int>>")


def _windows(texts: DataFrame, kind: str, window: int, block: int) -> DataFrame:
    """Rows (h1, h2, id, tag, p) of every window that holds one of the blocks. texts: (id, tag, text, places)."""
    reach = window - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, ats, first, second = [], [], [], []
            for k, (raw, places) in enumerate(zip(pc.cast(b.column(2), pa.binary()).to_pylist(), b.column(3), strict=True)):
                _, data, starts, ends = _words(raw)
                words, p = _hashes(data, starts, ends), places.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.unique((p[:, None] - np.arange(reach + 1)).ravel())
                at = at[(at >= 0) & (at <= len(starts) - window)]
                first.append(_FIRST.slices(_FIRST.prefix(words[0]), at, at + window))
                second.append(_SECOND.slices(_SECOND.prefix(words[1]), at, at + window))
                ats.append(at)
                of.append(np.full(len(at), k))
            if of:
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(ats).astype(np.int32))],
                    names=["h1", "h2", "id", "tag", "p"],
                )

    return texts.mapInArrow(run, f"h1 long, h2 long, id {kind}, tag long, p int")


def parse(n: int, at: np.ndarray, source: np.ndarray, place: np.ndarray, checked: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> list[tuple[int, int]]:
    """Greedy factors (first word, number of words) of a text of n words that occur earlier, each of `window` words or more.

    at: sorted places of blocks whose context occurs earlier, source and place: in which text and
    where. A factor runs on while the next block lies within reach and points to the same source,
    equally far on; it takes in the contexts of its blocks. checked: sorted starts of the windows
    found at the ends of factors; neighbouring ones are one factor.
    """
    out = []
    if len(at):
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > window - block + 1) | (source[1:] != source[:-1]) | (np.diff(place) != np.diff(at))
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        low, high = np.maximum(at[heads] - (window - block), 0), np.minimum(at[tails] + window, n)
        out += zip(low.tolist(), (high - low).tolist(), strict=True)
    if len(checked):
        heads = np.flatnonzero(np.append(True, np.diff(checked) != 1))
        tails = np.append(heads[1:], len(checked)) - 1
        out += zip(checked[heads].tolist(), (checked[tails] - checked[heads] + window).tolist(), strict=True)
    return sorted(out)


def factors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): per input row what is known of its text, and per text what it repeats.

    texts: (id, tag, n_words, digest, copy): copy is true where the same word sequence occurs under
    a smaller id. spans: (id, tag, blocks: array<struct<p, source, place>>, checked: array<int>),
    for other texts: blocks whose context occurs earlier, and windows found at the ends of factors.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    index = stage(_index(docs, id_col, text_col, window, block))
    least = stage(index.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", F.col("id").alias("first")))
    flat = index.select("id", "tag", "n_words", "digest")
    texts = stage(flat.join(least, "digest", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())).drop("first"))
    copies = texts.where("copy").select(F.col("id").alias("i"), F.col("tag").alias("t")).distinct()
    own = index.where(F.size("blocks") > 0).join(copies, F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left_anti")
    blocks = own.select("id", "tag", F.explode("blocks").alias("b")).select("id", "tag", F.col("b.h").alias("h"), F.col("b.c1").alias("c1"), F.col("b.c2").alias("c2"), F.col("b.p").alias("p"))
    # Rows that repeat an id and its text are one text: a block counts once per (id, tag, p).
    mark = F.xxhash64("id", "tag", "p")
    again = stage(blocks.groupBy("h").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("h"))
    hits = stage(likely(blocks, again, "h").join(again, "h"))
    unstage(index, least, again)
    # The first of each context; contexts of one block that are alike in all words are one.
    key = F.struct(F.col("id").isNull().alias("void"), "id", "tag", "p")
    first = stage(hits.groupBy("h", "c1", "c2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("c")))
    lone = first.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h")
    source = F.xxhash64("first.id", "first.tag")
    pointed = hits.join(first.where("c > 1"), ["h", "c1", "c2"]).where(key > F.col("first")).select("id", "tag", F.struct("p", source.alias("source"), F.col("first.p").alias("place")).alias("b"))
    pointed = stage(pointed)
    # At the ends of factors: windows around the first contexts of blocks that have several.
    ends = first.join(lone, "h").groupBy(F.col("first.id").alias("id"), F.col("first.tag").alias("tag")).agg(F.collect_set("first.p").alias("places"))
    ends = stage(ends)
    text = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    near = text.join(ends, F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))).select("id", "tag", "text", "places")
    windows = stage(_windows(near, kind, window, block))
    seen = windows.groupBy("h1", "h2").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least <> most").select("h1", "h2", "least")
    checked = stage(windows.join(seen, ["h1", "h2"]).where(key > F.col("least")).select("id", "tag", "p"))
    unstage(hits, first, ends, windows)
    both = pointed.select("id", "tag", "b", F.lit(None).cast("int").alias("p")).unionByName(checked.select("id", "tag", F.lit(None).cast(pointed.schema["b"].dataType).alias("b"), "p"))
    spans = stage(both.groupBy("id", "tag").agg(F.sort_array(F.collect_set("b")).alias("blocks"), F.sort_array(F.collect_set("p")).alias("checked")))
    unstage(pointed, checked)
    return texts, spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256, n_factors, kept.

    Words are runs of bytes other than space and 0x09 to 0x0D. A word goes if it lies in a window
    of `window` words whose word sequence starts earlier too (smaller id, or the same id and an
    earlier start); windows are judged on the input. kept holds the words left, joined by single
    spaces, where something but not all was removed, else null; kept_sha256 is the digest of the
    words left in any case. Null and empty texts have no word. A null id comes after all others.
    Rows that repeat an id with the same text count as one text and all give the same row; rows
    of one id with different texts come one after the other in an arbitrary, fixed order. An empty table gives
    an empty result; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts, spans = factors(docs, id_col=id_col, text_col=text_col, window=window, block=block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, digests, kept, counts = [], [], [], [], []
            for raw, seen, ends in zip(pc.cast(b.column(2), pa.binary()).to_pylist(), b.column(3), b.column(4), strict=True):
                words = raw.split()
                at, source, place = (seen.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                out = np.zeros(len(words), dtype=bool)
                parsed = parse(len(words), at, source, place, ends.values.to_numpy(zero_copy_only=False).astype(np.int64), window, block)
                for start, n in parsed:
                    out[start : start + n] = True
                left = b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x])
                sizes.append(len(words))
                gone.append(int(out.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
                counts.append(len(parsed))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), pa.array(counts, pa.int64())],
                names=["i", "n_words", "n_removed", "kept_sha256", "kept", "n_factors"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    s = spans.select(F.col("id").alias("i"), F.col("tag").alias("t"), "blocks", "checked")
    cut = source.join(s, F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))).select("id", "tag", "text", "blocks", "checked")
    cut = cut.mapInArrow(run, f"i {kind}, n_words long, n_removed long, kept_sha256 string, kept string, n_factors long")
    # Texts without such spans are whole, or copies of a text of a smaller id and gone.
    rest = texts.join(s.select("i", "t"), F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left_anti")
    gone = F.col("copy") & (F.col("n_words") >= window)
    rest = rest.select(
        F.col("id").alias("i"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("digest")).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_factors"),
    )
    return rest.unionByName(cut).withColumnRenamed("i", id_col)
