"""Spectral embeddings of short vectors.

Up to UNROLL elements they are column expressions; beyond, one matrix product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions import vec

UNROLL = 16


def _padded(xs: list[Column], k: int) -> list[Column]:
    return xs[:k] + [F.lit(0.0)] * (k - len(xs))


def tonal_coefficients(v, n: int, *, weighted: bool = True) -> list[Column]:
    """DCT coefficients from 1 on, higher ones weighted up to double if wanted."""
    weights = vec.ramp(1, 2, n) if weighted else [1.0] * n
    return [c * F.lit(w) for c, w in zip(vec.dct(vec.items(v, n)), weights, strict=True)][1:]


def transient_coefficients(v, n: int) -> list[Column]:
    """DCT coefficients of the steps between elements, later ones weighted up to double."""
    xs = vec.items(v, n)
    steps = [F.lit(0.0)] + [b - a for a, b in zip(xs[:-1], xs[1:], strict=True)]
    return vec.dct([d * F.lit(w) for d, w in zip(steps, vec.ramp(1, 2, n), strict=True)])


def heads(n: int, dim: int, head: str) -> list[tuple[str, int, int]]:
    """(kind, coefficients kept, places) of each part of an embedding.

    multi: tonal and transient of dim / 2 places each; tonal: padded to dim places; transient: the
    first dim coefficients; plain: the unweighted tonal ones, not padded.
    """
    half = dim // 2
    parts = {"multi": [("tonal", half), ("transient", half)], "tonal": [("tonal", dim)], "transient": [("transient", dim)], "plain": [("plain", dim)]}[head]
    out = []
    for kind, k in parts:
        have = min(k, n if kind == "transient" else n - 1)
        out.append((kind, have, k if kind == "tonal" else have))
    if head == "multi":
        out[1] = (*out[1][:2], dim - half)
    return out


def live_positions(n: int, dim: int) -> list[int]:
    """Positions of multi_head that are not padding: all that a dot product has to look at."""
    half = dim // 2
    return [*range(min(half, n - 1)), *range(half, half + min(half, n))]


def embed_batch(x: np.ndarray, dim: int) -> np.ndarray:
    """multi_head of every row of a matrix."""
    n, half = x.shape[1], dim // 2
    basis, weight = np.array(vec.dct_matrix(n)), np.array(vec.ramp(1, 2, n))
    tonal = ((x @ basis.T) * weight)[:, 1 : half + 1]
    steps = np.concatenate([np.zeros((len(x), 1)), np.diff(x, axis=1)], axis=1) * weight
    transient = (steps @ basis.T)[:, :half]
    out = np.zeros((len(x), dim))
    for part, at in ((tonal, 0), (transient, half)):
        size = np.linalg.norm(part, axis=1, keepdims=True)
        out[:, at : at + part.shape[1]] = np.where(size > 1e-8, part / np.where(size > 1e-8, size, 1), part)
    return out


def with_embedding(rows: DataFrame, vector: str, n: int, dim: int, name: str = "emb", head: str = "multi") -> DataFrame:
    """rows with an embedding of a vector column; each part over its norm, if that is over 1e-8.

    Coefficients, norms and quotients are steps of their own, so that no expression repeats another.
    """
    if n <= UNROLL:
        raw = {"tonal": lambda: tonal_coefficients(vector, n), "plain": lambda: tonal_coefficients(vector, n, weighted=False), "transient": lambda: transient_coefficients(vector, n)}
        parts = heads(n, dim, head)
        out = rows
        for j, (kind, have, _) in enumerate(parts):
            out = out.withColumn(f"__c{j}", F.array(*raw[kind]()[:have]))
        for j, (_, have, _) in enumerate(parts):
            size = vec.norm(f"__c{j}", have)
            out = out.withColumn(f"__s{j}", F.when(size > 1e-8, size).otherwise(1.0))
        xs = []
        for j, (_, have, places) in enumerate(parts):
            xs += _padded([x / F.col(f"__s{j}") for x in vec.items(f"__c{j}", have)], places)
        return out.withColumn(name, F.array(*xs)).drop(*[f"__{c}{j}" for c in "cs" for j in range(len(parts))])
    if head != "multi":
        raise ValueError("long vectors have the multi-head embedding only")
    names, at = rows.columns, rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
            e = pa.FixedSizeListArray.from_arrays(pa.array(embed_batch(x, dim).ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, e], names=[*names, name])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields]).add(name, T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, schema)
