"""The binary container of an encoded signal.

Little-endian, without padding: a header of 66 bytes, the dictionary's tiles as 32-bit floats, then
17 bytes for each match. The header ends in the SHA-256 of all that follows it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, VERSION = b"FWAV", 1
_HEAD = struct.Struct("<4sBIIBHHfIII32s")
_MATCH = np.dtype([("dom", "<i4"), ("s", "<f4"), ("o", "<f4"), ("sym", "i1"), ("err", "<f4")])

_HEAD_COLUMNS = ["sid", "range_size", "framerate", "sampwidth", "tile", "step", "energy_threshold", "n_ranges", "n_domains", "n", "error"]


@dataclass(frozen=True)
class Header:
    range_size: int
    framerate: int
    sampwidth: int
    tile_size: int
    domain_step: int
    energy_threshold: float
    n_ranges: int
    n_domains: int
    original_len: int


def pack(h: Header, tiles: np.ndarray, matches: np.ndarray) -> bytes:
    """A container. matches: rows (dom, s, o, sym, err) in order of their ranges."""
    if max(h.tile_size, h.domain_step) > 0xFFFF:
        raise ValueError("tile_size and domain_step are limited to 65535")
    m = np.zeros(len(matches), dtype=_MATCH)
    for k, name in enumerate(_MATCH.names):
        m[name] = [row[k] for row in matches]
    payload = np.asarray(tiles, dtype="<f4").tobytes() + m.tobytes()
    fields = (h.range_size, h.framerate, h.sampwidth, h.tile_size, h.domain_step, h.energy_threshold, h.n_ranges, h.n_domains, h.original_len)
    return _HEAD.pack(MAGIC, VERSION, *fields, hashlib.sha256(payload).digest()) + payload


def unpack(data: bytes, *, verify: bool = True) -> tuple[Header, np.ndarray, np.ndarray]:
    """(header, tiles, matches) of a container; no tiles at all give an empty matrix."""
    if len(data) < _HEAD.size:
        raise ValueError("shorter than a header")
    magic, version, *fields, digest = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("wrong magic number")
    if version != VERSION:
        raise ValueError(f"version {version} is not supported")
    h, payload = Header(*fields), data[_HEAD.size :]
    size = 4 * h.n_domains * h.range_size
    if len(payload) < size + _MATCH.itemsize * h.n_ranges:
        raise ValueError("shorter than its header says")
    if verify and hashlib.sha256(payload).digest() != digest:
        raise ValueError("checksum mismatch")
    tiles = np.frombuffer(payload, dtype="<f4", count=h.n_domains * h.range_size).reshape(h.n_domains, h.range_size)
    return h, tiles, np.frombuffer(payload, dtype=_MATCH, count=h.n_ranges, offset=size)


def contents(matches: DataFrame, domains: DataFrame, signals: DataFrame, p) -> DataFrame:
    """Rows (sid, content), one container per row of signals (sid, framerate, sampwidth, n).

    Signals without matches (silent, or shorter than a tile) get a container without any. Each
    container is made in one task, as it is one value.
    """
    import pandas as pd

    head = signals.select("sid", F.struct("framerate", "sampwidth", "n").alias("h"))
    empty = lambda t: F.lit(None).cast(t)
    kind, tile_t = "struct<rid:bigint,dom:bigint,s:double,o:double,sym:int,err:double>", "struct<dom:bigint,tile:array<double>>"
    rows = head.select("sid", "h", empty(kind).alias("m"), empty(tile_t).alias("t"))
    rows = rows.unionByName(matches.select("sid", empty("struct<framerate:int,sampwidth:int,n:bigint>").alias("h"), F.struct("rid", "dom", "s", "o", F.col("sym").cast("int").alias("sym"), "err").alias("m"), empty(tile_t).alias("t")))
    rows = rows.unionByName(domains.select("sid", empty("struct<framerate:int,sampwidth:int,n:bigint>").alias("h"), empty(kind).alias("m"), F.struct("dom", "tile").alias("t")))
    flat = rows.select("sid", "h.framerate", "h.sampwidth", "h.n", "m.rid", F.col("m.dom").alias("mdom"), "m.s", "m.o", "m.sym", "m.err", "t.dom", "t.tile")

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h = frame[frame["n"].notna()]
        m, t = frame[frame["rid"].notna()].sort_values("rid"), frame[frame["dom"].notna()].sort_values("dom")
        if not len(h):
            return pd.DataFrame({"sid": [], "content": []})
        tiles = np.stack(t["tile"].to_list()) if len(t) and len(m) else np.zeros((0, p.R))
        header = Header(p.R, int(h["framerate"].iloc[0]), int(h["sampwidth"].iloc[0]), p.tile, p.step, p.energy_threshold, len(m), len(tiles), int(h["n"].iloc[0]))
        return pd.DataFrame({"sid": [key[0]], "content": [pack(header, tiles, m[["mdom", "s", "o", "sym", "err"]].to_numpy())]})

    return flat.groupBy("sid").applyInPandas(one, "sid string, content binary")


def parse(files: DataFrame, *, verify: bool = True, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, domains, matches) of rows (path, content); sid is the path.

    A bad file raises; unless strict, it has a header row of nulls that says why in `error`, and no
    other rows.
    """

    def rows_of(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    try:
                        h, tiles, m = unpack(content.as_py(), verify=verify)
                    except (ValueError, struct.error) as e:
                        if strict:
                            raise
                        if kind == "head":
                            blank = [pa.array([path])] + [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.float64())] + [pa.nulls(1, pa.int64())] * 3 + [pa.array([str(e)])]
                            yield pa.RecordBatch.from_arrays(blank, names=_HEAD_COLUMNS)
                        continue
                    if kind == "head":
                        cols = {"sid": [path], "range_size": [h.range_size], "framerate": [h.framerate], "sampwidth": [h.sampwidth], "tile": [h.tile_size], "step": [h.domain_step], "energy_threshold": [float(h.energy_threshold)], "n_ranges": [h.n_ranges], "n_domains": [h.n_domains], "n": [h.original_len], "error": [None]}
                    elif kind == "tiles":
                        cols = {"sid": [path] * len(tiles), "dom": np.arange(len(tiles)), "tile": list(tiles.astype(np.float64))}
                    else:
                        cols = {"sid": [path] * len(m), "rid": np.arange(len(m)), "dom": m["dom"].astype(np.int64), "s": m["s"].astype(np.float64), "o": m["o"].astype(np.float64), "sym": m["sym"].astype(np.int32), "err": m["err"].astype(np.float64)}
                    types = {"sid": pa.string(), "error": pa.string()} | ({"tile": pa.list_(pa.float64())} if kind == "tiles" else {})
                    yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c)) for c, v in cols.items()], names=list(cols))

        return run

    rows = files.select("path", "content")
    heads = rows.mapInArrow(rows_of("head"), "sid string, range_size long, framerate long, sampwidth long, tile long, step long, energy_threshold double, n_ranges long, n_domains long, n long, error string")
    tiles = rows.mapInArrow(rows_of("tiles"), "sid string, dom long, tile array<double>")
    heads = heads.drop("error") if strict else heads
    return heads, tiles, rows.mapInArrow(rows_of("matches"), "sid string, rid long, dom long, s double, o double, sym int, err double")


def read(spark: SparkSession, path: str, *, verify: bool = True, pattern: str = "*.[fF][wW][aA][vV]") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, domains, matches) of the containers in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return parse(files, verify=verify)
