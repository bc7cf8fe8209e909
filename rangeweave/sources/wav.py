"""WAV files: reading with channels mixed down, and writing.

Files come through Spark's binary source, so any file system that Spark knows will do, and each is
decoded in one Arrow task; samples leave it in pieces. Integer samples keep their scale.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave import schemas

#: Samples of one outgoing batch.
PIECE = 1 << 20
#: Matches *.wav in any case.
GLOB = "*.[wW][aA][vV]"


#: Samples of so many bytes as numbers, but for 3, which go through words of 4, and what is added to them when written.
_KINDS = {1: "u1", 2: "<i2", 3: "<i4", 4: "<i4"}
_SHIFT = {1: 128.0}


def decode_pcm(raw: bytes, width: int, *, floating: bool = False, legacy: bool = False) -> np.ndarray:
    """Samples of little-endian PCM bytes of 1 to 4 bytes a sample, in double precision.

    Width 1 is unsigned, the others signed; width 4 is integer unless `floating`. legacy=True takes
    every 4-byte sample for a float, whatever the file says.
    """
    if width not in _KINDS:
        raise ValueError(f"samples of {width} bytes are not supported")
    if width == 3:  # into the high bytes of a word; an arithmetic shift brings the sign along
        words = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        words[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        return (words.view("<i4").ravel() >> 8).astype(np.float64)
    kind = "<f4" if width == 4 and (floating or legacy) else _KINDS[width]
    return np.frombuffer(raw, dtype=kind).astype(np.float64) - _SHIFT.get(width, 0.0)


def encode_pcm(x: np.ndarray, width: int) -> bytes:
    """Bytes of samples: limited to the width and cut towards zero; width 4 is a raw float."""
    if width not in _KINDS:
        raise ValueError(f"samples of {width} bytes are not supported")
    if width == 4:
        return np.asarray(x, dtype="<f4").tobytes()
    top = 1 << (8 * width - 1)
    shift = _SHIFT.get(width, 0.0)
    whole = np.clip(np.asarray(x) + shift, shift - top, shift + top - 1).astype(_KINDS[width])
    return whole.view(np.uint8).reshape(len(whole), -1)[:, :width].tobytes() if len(whole) else b""


def parse(data: bytes, *, legacy: bool = False, unit: bool = False) -> tuple[dict, np.ndarray]:
    """Header fields and mono samples of a WAV file. Compressed formats are refused.

    unit: samples of 4 bytes come between -1 and 1, integers scaled and floats limited to that, as
    they are written.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data) and body is None:
        name, size = struct.unpack_from("<4sI", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", chunk)
            if form[0] == 0xFFFE and len(chunk) >= 26:
                form = (struct.unpack_from("<H", chunk, 24)[0], *form[1:])
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if form is None or body is None:
        raise ValueError("no format or no samples")
    tag, channels, rate, _, _, bits = form
    if tag not in (1, 3):
        raise ValueError(f"compressed format {tag} is not supported")
    width = (bits + 7) // 8
    if tag == 3 and width != 4:
        raise ValueError(f"floats of {width} bytes are not supported")
    body = body[: len(body) // (width * channels) * width * channels]
    x = decode_pcm(body, width, floating=tag == 3, legacy=legacy)
    if unit and width == 4:
        x = x / (1 << 31) if tag == 1 and not legacy else np.clip(np.nan_to_num(x, nan=0.0), -1, 1)
    return {"framerate": rate, "sampwidth": width, "n_channels": channels}, x.reshape(-1, channels).mean(axis=1)


def build(x: np.ndarray, framerate: int, sampwidth: int, *, legacy: bool = False) -> bytes:
    """A mono WAV file. Width 4 is tagged as floating point, or as integer if legacy."""
    body = encode_pcm(np.asarray(x, dtype=np.float64), sampwidth)
    tag = 3 if sampwidth == 4 and not legacy else 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body) + (len(body) & 1), b"WAVE", b"fmt ", 16, tag, 1, framerate, framerate * sampwidth, sampwidth, 8 * sampwidth, b"data", len(body))
    return head + body + b"\0" * (len(body) & 1)


def list_files(spark: SparkSession, path: str, pattern: str = GLOB) -> DataFrame:
    """Rows (path, content) of the matching files of a folder, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read(spark: SparkSession, path: str, *, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signals, samples) of the WAV files in a folder; sid is the file's path.

    A file that cannot be read has a row in signals with n null, and no samples.
    """
    return from_files(list_files(spark, path), legacy=legacy)


def from_files(files: DataFrame, *, legacy: bool = False, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signals, samples) of rows (path, content). unit: see parse()."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    h, x = parse(content.as_py(), legacy=legacy, unit=unit)
                    rows.append((path, path, h["framerate"], h["sampwidth"], h["n_channels"], len(x)))
                except (ValueError, struct.error):
                    rows.append((path, path, None, None, None, None))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=schemas.SIGNALS.names)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    _, x = parse(content.as_py(), legacy=legacy, unit=unit)
                except (ValueError, struct.error):
                    continue
                for at in range(0, len(x), PIECE):
                    part = x[at : at + PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=schemas.SAMPLES.names)

    rows = files.select("path", "content")
    return rows.mapInArrow(heads, schemas.SIGNALS), rows.mapInArrow(samples, schemas.SAMPLES)


def contents(samples: DataFrame, signals: DataFrame, *, legacy: bool = False) -> DataFrame:
    """Rows (sid, content): a mono WAV file per signal, from the rates and widths in signals.

    A file is one value, so a signal here is one task's: at most some hundred million samples.
    """
    import pandas as pd

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("i")["x"].to_numpy()
        return pd.DataFrame({"sid": [key[0]], "content": [build(x, int(frame["framerate"].iloc[0]), int(frame["sampwidth"].iloc[0]), legacy=legacy)]})

    rows = samples.join(signals.select("sid", "framerate", "sampwidth"), "sid")
    return rows.groupBy("sid").applyInPandas(one, "sid string, content binary")


def write_files(rows: DataFrame, name: str = "name", content: str = "content", *, folder: str) -> DataFrame:
    """Write each row's content to folder/name and return rows (path, bytes).

    Goes through pyarrow's file systems. A file is written under another name and then moved, so a
    task that is tried again leaves whole files only.
    """
    import uuid

    from pyarrow import fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for n, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, target = c.as_py(), f"{root}/{n}"
                held = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(held) as out:
                    out.write(data)
                system.move(held, target)
                paths.append(target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(F.col(name), F.col(content)).mapInArrow(run, "path string, bytes long")
