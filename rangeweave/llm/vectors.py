"""Near-duplicate vectors by counting collisions of one-dimensional projections.

1. Vectors that nearly coincide (within EPSILON of an angle) become one ball with a multiplicity,
   so groups of copies never turn into pairs. What holds between two balls' centres, up to twice
   EPSILON, holds for their members; the rare pairs of balls for which that does not decide are
   resolved by blocks of members.
2. Centres are projected on many random lines, and each line is sorted. A window of fixed width is
   laid around every query on it. As nearly half of all vectors lie in such a window near the
   middle of a line, only its two ends count, beyond a cut: two vectors within the threshold are
   often out there together, two others nearly never, so few pairs collide without being near.
3. Collisions of a pair are counted over all lines, and pairs with enough of them are verified by
   their exact cosine. Only then do vectors travel; a line holds numbers.

Number of lines, cut and count follow from the threshold and the number of vectors: the cheapest
ones for which a pair just at the threshold is found with probability RECALL (projections of a pair
are jointly normal, and lines are independent, so this is exact), closer ones more often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, cos, erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.llm.common import components, mix64, stage, tune, unstage

LEAST = 0.9
EPSILON = 1e-4
RECALL = 0.985
#: Half width of a window, in standard deviations of the difference of a pair at the threshold.
REACH = 1.96
#: Rows of a block; longer lists are compared block by block.
BLOCK = 1000
#: Lines projected on at a time.
LINES = 4096
#: Numbers of vectors that directions are made once for.
HELD = 1 << 20
#: Costs of projecting a number, of an end of a line that a vector is in, of a collision and of a verified pair.
NUMBER_COST, END_COST, COLLISION_COST, PAIR_COST = 1e-4, 1.0, 1.0, 20.0
#: Signs that near-coincident vectors are looked for by.
SIGNS = 32

_ERF = np.vectorize(erf, otypes=[np.float64])


def together(cut: float, cosine: float, half: float) -> float:
    """Probability that both projections of a pair are beyond the cut, at one end, within half of each other."""
    x, step = np.linspace(cut, cut + 6, 600, retstep=True)
    spread = sqrt(2 * max(1 - cosine * cosine, 1e-12))
    inner = _ERF((x + half - cosine * x) / spread) - _ERF((np.maximum(cut, x - half) - cosine * x) / spread)
    return float((np.exp(-x * x / 2) / sqrt(2 * pi) * np.maximum(inner, 0) / 2).sum() * step)


@lru_cache(maxsize=64)
def plan_for(n: int, dim: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, float, float, int]:
    """(lines, cut, half width of a window, collisions needed) of least estimated cost for n vectors."""
    half, best = REACH * sqrt(2 - 2 * least), None
    for cut in np.arange(0.0, 6.01, 0.25).tolist():
        near, far, out = 2 * together(cut, least, half), 2 * together(cut, 0.0, half), 1 - erf(cut / sqrt(2))
        for need in (2, 3, 4, 5):
            mean = float(need)  # collisions expected at the threshold, so many that `need` are reached
            while sum(_poisson(mean, k) for k in range(need)) > 1 - recall:
                mean *= 1.02
            lines = ceil(mean / near)
            stray, term = lines * far, 1.0
            for k in range(1, need + 1):
                term *= stray / k
            pairs = n * n / 2
            cost = n * lines * dim * NUMBER_COST + n * lines * out * END_COST + pairs * stray * COLLISION_COST + pairs * min(term, 1.0) * PAIR_COST
            if best is None or cost < best[0]:
                best = cost, lines, cut, need
    return best[1], best[2], half, best[3]


def _poisson(mean: float, k: int) -> float:
    out = exp(-mean)
    for j in range(1, k + 1):
        out *= mean / j
    return out


@lru_cache(maxsize=16)
def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count]).standard_normal((dim, count))


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that are null, empty, zero or not finite."""
    out: list[np.ndarray | None] = [None] * len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts, flat = np.cumsum(sizes) - sizes, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        x = flat[starts[own, None] + np.arange(size)]
        top = np.abs(x).max(axis=1)  # not a number where a component is null or none
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for k, v in zip(own[good].tolist(), x, strict=True):
            out[k] = v
    return out


def _signs(x: np.ndarray, tables: int, signs: int, seed: int) -> np.ndarray:
    """The bucket of every row in every table, as numbers."""
    bits = (x @ _directions(x.shape[1], tables * signs, seed) > 0).reshape(len(x), tables, signs)
    return bits @ (1 << np.arange(signs, dtype=np.int64))


def _spread(rows: DataFrame, schema: str, tables: int, signs: int, seed: int) -> DataFrame:
    """rows (rid, ..., vec) with keys: the buckets, one per table (null for vectors that are none)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_rows(b.column(names.index("vec")))
            keys: list = [None] * len(units)
            for dim in {len(v) for v in units if v is not None}:
                own = [i for i, v in enumerate(units) if v is not None and len(v) == dim]
                for i, k in zip(own, _signs(np.stack([units[i] for i in own]), tables, signs, seed), strict=True):
                    keys[i] = k
            dims = [None if v is None else len(v) for v in units]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=[*names, "dim", "keys"])

    return rows.mapInArrow(run, schema + ", dim int, keys array<long>")


def _groups(rows: DataFrame, columns: list[str], handle, schema: str, names: list[str]) -> DataFrame:
    """handle(slice of a table, arrays) -> tuples of columns, for each group of equal g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            g = t["g"].to_numpy()
            cut = len(g) if last else int(np.searchsorted(g, g[-1]))
            held = t.slice(cut).to_batches() if cut < len(g) else []
            edges = np.flatnonzero(np.concatenate([[True], g[1:cut] != g[: cut - 1], [True]])) if cut else [0]
            out = [handle(t.slice(i, j - i)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            if out:
                yield pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in out]).combine_chunks().to_batches()[0] if sum(len(x[0]) for x in out) else pa.RecordBatch.from_arrays(out[0], names=names)

        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= 4 * BLOCK:
                yield from ready(False)
        if held:
            yield from ready(True)

    return rows.select("g", *columns).repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _balls(rows: DataFrame, vec_type: str, epsilon: float) -> DataFrame:
    """Rows (rid, leader, mult, vec): mult and vec, of leaders only, the members and the centre."""
    near = cos(epsilon)
    signed = _spread(rows.select("rid", "vec"), f"rid long, vec {vec_type}", 1, SIGNS, 31)
    keyed = stage(signed.where("keys is not null").select("rid", "vec", F.xxhash64("dim", F.element_at("keys", 1)).alias("key")))
    sizes = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    joined = keyed.join(sizes, "key", "left")
    alone = joined.where("c is null").select("rid", F.col("rid").alias("leader"), F.lit(1).cast("long").alias("mult"), "vec")
    part = F.pmod(F.xxhash64("rid", F.lit(5)), F.ceil(F.col("c") / BLOCK))
    many = joined.where("c is not null").select(F.xxhash64("key", part).alias("g"), "rid", "vec")

    def gather(t: pa.Table) -> list[pa.Array]:
        rid, vec = t["rid"].to_numpy(), t["vec"].combine_chunks()
        x = np.stack(unit_rows(vec))
        leader, left = np.full(len(rid), -1, dtype=np.int64), np.arange(len(rid))[np.argsort(rid, kind="stable")]
        mult = np.zeros(len(rid), dtype=np.int64)
        while len(left):
            own = x[left] @ x[left[0]] >= near
            own[0] = True
            leader[left[own]] = left[0]
            mult[left[0]] = own.sum()
            left = left[~own]
        heads = leader == np.arange(len(rid))
        return [pa.array(rid), pa.array(rid[leader]), pa.array(mult, mask=~heads), vec.take(pa.array(np.arange(len(rid)), mask=~heads))]

    schema = f"rid long, leader long, mult long, vec {vec_type}"
    return alone.unionByName(_groups(many, ["rid", "vec"], gather, schema, ["rid", "leader", "mult", "vec"]))


def _ends(balls: DataFrame, plan: dict[int, tuple[int, float, float, int]], vec_type: str) -> DataFrame:
    """Rows (line, rid, value): the lines on which a ball's centre is beyond the cut. Lines of one dimension and end have one number."""

    def project(rid: np.ndarray, x: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        lines, cut, _, _ = plan[dim]
        for low in range(0, lines, LINES):
            ways = _directions(dim, min(LINES, lines - low), 1000 + low).astype(np.float32)
            for top in range(0, len(x), BLOCK):
                value = x[top : top + BLOCK] @ ways
                at = np.flatnonzero((value >= cut) | (value <= -cut))
                i, j = np.divmod(at, value.shape[1])
                value = value.ravel()[at]
                line = ((low + j) * 2 + (value < 0)) << 20 | dim
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(rid[top + i]), pa.array(np.abs(value))], names=["line", "rid", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by dimension: as many vectors as the directions are made once for
        for b in batches:
            units, rid = unit_rows(b.column(1)), b.column(0).to_numpy()
            for dim in sorted({len(v) for v in units}):
                own = np.array([i for i, v in enumerate(units) if len(v) == dim])
                held.setdefault(dim, []).append((rid[own], np.stack([units[i] for i in own]).astype(np.float32)))
                if sum(len(r) for r, _ in held[dim]) * dim >= HELD:
                    yield from project(*map(np.concatenate, zip(*held.pop(dim), strict=True)), dim)
        for dim in sorted(held):
            yield from project(*map(np.concatenate, zip(*held[dim], strict=True)), dim)

    return balls.select("rid", "vec").mapInArrow(run, "line long, rid long, value float")


def _collisions(ends: DataFrame, plan: dict[int, tuple[int, float, float, int]]) -> DataFrame:
    """Rows (a, b), a < b, of pairs that collide often enough."""
    sizes = stage(ends.groupBy("line").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    n = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = ends.join(sizes, "line").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    rows = rows.select(F.xxhash64("line", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "line", "rid", "value", "own", (F.col("own") == F.col("other")).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            g = t["g"].to_numpy()
            cut = len(g) if last else int(np.searchsorted(g, g[-1]))
            held = t.slice(cut).to_batches() if cut < len(g) else []
            if cut:
                yield from meet(*(t[c].slice(0, cut).to_numpy(zero_copy_only=False) for c in ("g", "line", "rid", "value", "own", "home")))

        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= 8 * BLOCK:
                yield from ready(False)
        if held:
            yield from ready(True)

    def meet(g, line, rid, value, own, home) -> Iterator[pa.RecordBatch]:
        half = np.array([plan[int(d)][2] for d in line & ((1 << 20) - 1)], dtype=np.float32)
        at, d, heads, tails, size = np.arange(len(g)), 1, [], [], 0
        while len(at):  # windows on sorted lists: the query meets the d-th after it, as long as that is within
            at = at[: np.searchsorted(at, len(g) - d)]
            at = at[(g[at] == g[at + d]) & (value[at + d] - value[at] <= half[at])]
            # In a list of two blocks only pairs across them count; each block's own pairs have a list.
            ok = at[(own[at] != own[at + d]) | (home[at] & home[at + d])]
            heads.append(rid[ok])
            tails.append(rid[ok + d])
            size += len(ok)
            d += 1
            if size > 1 << 20 or not len(at):
                i, j = np.concatenate(heads), np.concatenate(tails)
                if len(i):
                    yield packed(np.minimum(i, j), np.maximum(i, j))
                heads, tails, size = [], [], 0

    def packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Pairs by parts that follow from them, as bytes: they are many, and few stay."""
        part = (mix64(mix64(a.view(np.uint64)) ^ b.view(np.uint64)) >> np.uint64(52)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part = part[order]
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = pa.array((np.append(heads, len(part)) * 16).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(heads), [None, ends.buffers()[1], pa.py_buffer(np.stack([a[order], b[order]], axis=1))])
        return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), data], names=["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def ready() -> pa.RecordBatch:
            a, b = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2).T
            name = mix64(mix64(a.view(np.uint64)) + b.view(np.uint64))
            order = np.argsort(name)
            same = name[order[1:]] == name[order[:-1]]
            order = order[np.append(same, False) | np.append(False, same)]  # most pairs collide once
            a, b = a[order], b[order]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
            heads = heads[np.diff(np.append(heads, len(a))) >= needed]
            return pa.RecordBatch.from_arrays([pa.array(a[heads]), pa.array(b[heads])], names=["a", "b"])

        for x in batches:
            for p, data in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield ready()
                    held = []
                part = p
                held.append(data)
        if held:
            yield ready()

    needed = min((x[3] for x in plan.values()), default=2)
    met = rows.repartition("g").sortWithinPartitions("g", "value").mapInArrow(run, "part int, data binary")
    return met.repartition("part").sortWithinPartitions("part").mapInArrow(count, "a long, b long")


def _pairs(balls: DataFrame, vec_type: str, least: float, epsilon: float) -> DataFrame:
    """Rows (kind, a, b, n) from all collisions: 0 edges of spanning forests of links between balls, 1
    a ball a has n links to vectors of other balls, 2 pairs of balls whose members must be looked at."""
    low, high = cos(min(pi, acos(least) + 2 * epsilon)), cos(max(0.0, acos(least) - 2 * epsilon))
    # Dimensions are few; the plan of each follows from the number of its balls.
    plan = {r["d"]: plan_for(1 << max(r["n"] - 1, 1).bit_length(), r["d"], low) for r in balls.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    near = _collisions(stage(_ends(balls, plan, vec_type)), plan)
    one = balls.select(F.col("rid").alias("a"), F.col("mult").alias("m"), F.col("vec").alias("p"))
    two = balls.select(F.col("rid").alias("b"), F.col("mult").alias("k"), F.col("vec").alias("q"))
    full = stage(near).join(one, "a").join(two, "b").select("a", "b", "m", "k", "p", "q")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            a, b, m, k = (t.column(c).to_numpy() for c in range(4))
            u, v, score = unit_rows(t.column(4)), unit_rows(t.column(5)), np.zeros(t.num_rows)
            for dim in {len(x) for x in u}:
                own = [i for i, x in enumerate(u) if len(x) == dim]
                score[own] = np.einsum("ij,ij->i", np.stack([u[i] for i in own]), np.stack([v[i] for i in own]))
            single = (m == 1) & (k == 1)
            sure, maybe = np.where(single, score >= least, score >= high), ~single & (score < high) & (score >= low)
            ids, at = np.unique(np.concatenate([a[sure], b[sure]]), return_inverse=True)
            p, q = at[: sure.sum()], at[sure.sum() :]
            links = np.zeros(len(ids), dtype=np.int64)
            np.add.at(links, p, k[sure])
            np.add.at(links, q, m[sure])
            label = _forest(p, q, len(ids))
            roots = np.flatnonzero(label != np.arange(len(ids)))
            kind = np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(roots), len(ids), maybe.sum()])
            zeros = np.zeros(len(roots), dtype=np.int64), np.zeros(maybe.sum(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([ids[roots], ids, a[maybe]])), pa.array(np.concatenate([ids[label[roots]], ids, b[maybe]])), pa.array(np.concatenate([zeros[0], links, zeros[1]]))],
                names=["kind", "a", "b", "n"],
            )

    return full.mapInArrow(verify, "kind int, a long, b long, n long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _resolve(doubtful: DataFrame, members: DataFrame, vec_type: str, least: float) -> DataFrame:
    """Rows (a, b, x, n) for pairs of balls of which some members link: member x has n links in the other ball.

    members: (rid, leader, vec). Both balls are cut into blocks, and every pair of blocks is one
    group, so members are compared in matrices and never become rows of pairs.
    """
    sizes = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    pairs = doubtful.select("a", "b").distinct()
    pairs = pairs.join(sizes.select(F.col("leader").alias("a"), F.col("parts").alias("na")), "a").join(sizes.select(F.col("leader").alias("b"), F.col("parts").alias("nb")), "b")
    pairs = pairs.withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("g", F.xxhash64("a", "b", "i", "j"))
    own = members.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("rid", F.lit(9)), F.col("parts")).cast("int").alias("part"), "rid", "vec")
    sides = pairs.select("g", "a", "b", F.col("a").alias("leader"), F.col("i").alias("part"), F.lit(0).alias("side")).unionByName(pairs.select("g", "a", "b", F.col("b").alias("leader"), F.col("j").alias("part"), F.lit(1).alias("side")))
    rows = sides.join(own, ["leader", "part"])

    def meet(t: pa.Table) -> list[pa.Array]:
        side, rid, vec = t["side"].to_numpy(), t["rid"].to_numpy(), t["vec"].combine_chunks()
        x, left, right = unit_rows(vec), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = np.stack([x[k] for k in left]) @ np.stack([x[k] for k in right]).T >= least if len(left) and len(right) else np.zeros((len(left), len(right)), dtype=bool)
        n, of = np.concatenate([hit.sum(axis=1), hit.sum(axis=0)]).astype(np.int64), np.concatenate([left, right])
        of, n = of[n > 0], n[n > 0]
        return [t["a"].combine_chunks().take(pa.array(of)), t["b"].combine_chunks().take(pa.array(of)), pa.array(rid[of]), pa.array(n)]

    return _groups(rows, ["a", "b", "side", "rid", "vec"], meet, "a long, b long, x long, n long", ["a", "b", "x", "n"])


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, epsilon: float = EPSILON) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    n_links: other rows whose cosine is found to be `least` or more; component_id: the smallest id
    reachable by links; kept: whether that is the own id. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, as do vectors of different dimensions
    with each other. Rows are vectors of their own: repeated ids and vectors count each. An empty
    table gives an empty result; columns other than the two named are not looked at.
    """
    tune(table.sparkSession)
    vec_type = table.schema[vec_col].dataType.simpleString()
    rows = stage(table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("rid", F.monotonically_increasing_id()))
    members = stage(_balls(rows, vec_type, epsilon))
    balls = members.where("rid = leader").select("rid", "mult", "vec")
    found = stage(_pairs(balls, vec_type, least, epsilon))
    exact = stage(_resolve(found.where("kind = 2").select("a", "b"), members.select("rid", "leader").join(rows.select("rid", "vec"), "rid"), vec_type, least))
    edges = found.where("kind = 0").select("a", "b").unionByName(exact.select("a", "b").distinct())
    joined = components(edges)
    links = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "l")
    extra = exact.groupBy(F.col("x").alias("e")).agg(F.sum("n").alias("extra"))
    whole = balls.select("rid", "mult").join(links, F.col("rid") == F.col("l"), "left").join(joined, F.col("rid") == F.col("node"), "left")
    whole = stage(whole.select(F.col("rid").alias("ball"), F.coalesce("component", "rid").alias("root"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    named = rows.select("id", "rid").join(members.select(F.col("rid").alias("m"), "leader"), F.col("rid") == F.col("m"), "left")
    named = named.join(whole, F.col("leader") == F.col("ball"), "left").join(extra, F.col("rid") == F.col("e"), "left")
    named = stage(named.select("id", "rid", "root", (F.coalesce("links", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("n_links")))
    least_of = stage(named.where("root is not null").groupBy("root").agg(F.min("id").alias("smallest")))
    unstage(rows, members, found, exact, whole)
    out = named.join(least_of, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
