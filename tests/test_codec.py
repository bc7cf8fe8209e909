"""The codec against an independent model in plain NumPy, and its closed form against a loop."""

import numpy as np
import pytest

from rangeweave.functions.mel import mel_weights
from rangeweave.operators import codec, domains, embed, frames, metrics, search
from rangeweave.params import CodecParams
from rangeweave.sources import tables


def as_samples(spark, **signals):
    rows = [(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "sid string, i long, x double")


def model_dct(x):
    n = len(x)
    k = np.arange(n)[:, None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m @ x


def model_embed(x, dim=16):
    n, half = len(x), dim // 2
    ramp = np.linspace(1, 2, n)
    tonal = np.zeros(half)
    t = (model_dct(x) * ramp)[1 : half + 1]
    tonal[: len(t)] = t
    d = model_dct(np.diff(x, prepend=x[0]) * ramp)[:half]
    out = [v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-8 else v for v in (tonal, d)]
    out = np.concatenate(out)
    return np.pad(out, (0, dim - len(out)))


def model(x, p):
    """(domains, matches) by direct loops."""
    n = len(x)
    padded = np.pad(x, (0, -n % p.R), mode="reflect")
    ranges = padded.reshape(-1, p.R)
    doms = np.array([x[d : d + p.R * p.block].reshape(p.R, p.block).mean(axis=1) for d in range(0, n - p.tile + 1, p.step)])
    embs = np.array([model_embed(d, p.emb_dim) for d in doms])
    out = []
    for r in ranges:
        if (r * r).mean() < 0.75 * p.energy_threshold:
            out.append((-1, 0.0, 0.0, 0, 0.0))
            continue
        order = np.lexsort((np.arange(len(doms)), -np.round(embs @ model_embed(r, p.emb_dim), 9)))[: p.top_k]
        best = None
        for sym in (0, 1):
            for rank, d in enumerate(order):
                t = doms[d][::-1] if sym else doms[d]
                tc = t - t.mean()
                s = ((r - r.mean()) * tc).sum() / ((tc * tc).sum() + 1e-12)
                o = r.mean() - s * t.mean()
                key = (round(float(np.linalg.norm(s * t + o - r)), 9), sym, rank)
                if best is None or key < best[0]:
                    best = key, (int(d), float(np.clip(s, -p.s_clip, p.s_clip)), float(o), sym, key[0])
        out.append(best[1])
    return doms, out


def tone():
    t = np.arange(960) / 8000
    return np.trunc(0.5 * 32767 * np.sin(2 * np.pi * 440 * t))


@pytest.fixture(scope="module")
def encoded(spark):
    p = CodecParams(tile=128, mask=False)
    x = as_samples(spark, tone=tone())
    parts = [df.persist() for df in codec.encode(x, p)]
    return p, x, parts


def test_shapes_of_the_tone(encoded):
    p, _, (r, d, m) = encoded
    assert (p.R, p.step) == (4, 1)
    assert (r.count(), d.count(), m.count()) == (240, 833, 240)


def test_matches_equal_the_model(encoded):
    p, _, (_, d, m) = encoded
    doms, want = model(tone(), p)
    tiles = np.array([row["tile"] for row in d.orderBy("dom").collect()])
    assert np.allclose(tiles, doms)
    got = [(row["err"]) for row in m.orderBy("rid").collect()]
    assert np.allclose(got, [w[4] for w in want], atol=1e-6)


@pytest.mark.parametrize(("mode", "low", "high"), [("stored", 16, 18), ("refit", 8.3, 8.7)])
def test_quality_of_the_tone(encoded, mode, low, high):
    p, x, (_, d, m) = encoded
    out = codec.decode(m, d, tables.lengths(x), CodecParams(tile=128, scale_mode=mode))
    assert low <= metrics.snr(x, out).first()["snr"] <= high


def test_domain_alias_is_worse(spark, encoded):
    _, x, _ = encoded
    p = CodecParams(tile=128, mask=False, query_mode="domain_alias", scale_mode="stored")
    _, d, m = codec.encode(x, p)
    assert 11 <= metrics.snr(x, codec.decode(m, d, tables.lengths(x), p)).first()["snr"] <= 13


@pytest.mark.parametrize("damping", [0.0, 0.25, 0.5, 1.0])
def test_closed_form_equals_the_loop(spark, damping):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 50, 96).round(2)
    p = CodecParams(tile=32, top_k=4, mask=False, s_damping=damping, iterations=6, eps=1e-3)
    _, d, m = (df.persist() for df in codec.encode(as_samples(spark, a=x), p))
    tiles = {r["dom"]: np.array(r["tile"]) for r in d.collect()}
    matches = m.orderBy("rid").collect()
    out, passes = np.zeros(96), 0
    for _ in range(p.iterations):
        new = np.zeros_like(out)
        for r in matches:
            t = tiles[r["dom"]][::-1] if r["sym"] else tiles[r["dom"]]
            tc, y = t - t.mean(), out[r["rid"] * p.R : (r["rid"] + 1) * p.R]
            flat = (tc * tc).sum() <= 1e-12
            opt = 0.0 if flat else ((y - y.mean()) * tc).sum() / (tc * tc).sum()
            s = ((1 - damping) * r["s"] + damping * opt) if damping > 0 else (r["s"] if flat else opt)
            new[r["rid"] * p.R : (r["rid"] + 1) * p.R] = np.clip(s, -p.s_clip, p.s_clip) * t + r["o"]
        base = np.linalg.norm(out)
        delta, out, passes = np.linalg.norm(new - out) / (base if base > 0 else 1), new, passes + 1
        if delta < p.eps:
            break
    got = codec.decode(m, d, spark.createDataFrame([("a", 96)], "sid string, n long"), p).orderBy("i").collect()
    assert np.allclose([r["x"] for r in got], out)
    assert codec.convergence(m, d, p).first()["passes"] == passes


def test_constant_silent_and_short_signals(spark):
    p = CodecParams(tile=32, top_k=4, mask=False)
    x = as_samples(spark, flat=[7.0] * 50, zero=[0.0] * 50, short=[1.0] * 10)
    r, d, m = codec.encode(x, p)
    assert {row["sid"] for row in r.collect()} == {"flat", "short"}
    got = m.collect()
    assert {row["sid"] for row in got} == {"flat"}
    assert all(abs(row["s"]) < 1e-6 and row["err"] < 1e-6 for row in got)


def test_silent_stretch_and_both_silence_modes(spark):
    x = np.concatenate([np.sin(np.arange(40)) * 100, np.zeros(40)])
    for mode, dom in (("sentinel", -1), ("domain0", 0)):
        p = CodecParams(tile=16, range_size=4, top_k=3, silence_mode=mode)
        _, d, m = codec.encode(as_samples(spark, a=x), p)
        quiet = [r for r in m.collect() if r["rid"] >= 12]
        assert {r["dom"] for r in quiet} == {dom}
        out = codec.decode(m, d, spark.createDataFrame([("a", 80)], "sid string, n long"), p)
        assert out.count() == 80
        assert out.where("i >= 48 and x <> 0").count() == 0


def test_mirrored_tile_is_found(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 10, 64)
    x[60:64] = x[:16].reshape(4, 4).mean(axis=1)[::-1] * 2 + 3
    p = CodecParams(tile=16, range_size=4, top_k=500, mask=False)
    _, _, m = codec.encode(as_samples(spark, a=x), p)
    last = m.where("rid = 15").first()
    assert last["err"] < 1e-6


def test_more_candidates_never_fit_worse(spark):
    x = np.random.default_rng(9).normal(0, 10, 80)
    errs = []
    for k in (1, 4, 1000):
        _, _, m = codec.encode(as_samples(spark, a=x), CodecParams(tile=32, top_k=k, mask=False))
        errs.append([r["err"] for r in m.orderBy("rid").collect()])
    assert all(b <= a + 1e-9 for a, b in zip(errs[0], errs[1], strict=True))
    assert all(b <= a + 1e-9 for a, b in zip(errs[1], errs[2], strict=True))


def test_chunks_of_long_signals_change_nothing(spark):
    x = as_samples(spark, a=np.random.default_rng(1).normal(0, 1, 500))
    whole = {r["dom"]: r["tile"] for r in domains.domains(x, 32, 4, 3).collect()}
    cut = {r["dom"]: r["tile"] for r in domains.domains(x, 32, 4, 3, chunk=50).collect()}
    assert whole.keys() == cut.keys()
    assert all(np.allclose(whole[k], cut[k]) for k in whole)
    f = frames.smooth(frames.frame_energy(x, 4))
    a, b = (sorted(map(tuple, frames.hysteresis(f, 1.1, 0.9, chunk=c).select("f", "voiced").collect())) for c in (10**6, 7))
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_reflection(spark, n):
    x = np.arange(n, dtype=float)
    got = [r["x"] for r in frames.reflect_pad(as_samples(spark, a=x), 8).orderBy("i").collect()]
    assert got == np.pad(x, (0, -n % 8), mode="reflect").tolist()


def test_hysteresis_keeps_its_state(spark):
    rows = [("a", f, float(e), float(e)) for f, e in enumerate([0, 3, 7, 11, 7, 6, 4, 7, 12, 1])]
    got = frames.hysteresis(spark.createDataFrame(rows, "sid string, f long, energy double, smoothed double"), 10.0).orderBy("f").collect()
    assert [r["voiced"] for r in got] == [0, 0, 0, 1, 1, 1, 0, 0, 1, 0]


def test_smoothing_of_few_frames(spark):
    rows = [("a", f, float(f + 1)) for f in range(3)]
    got = frames.smooth(spark.createDataFrame(rows, "sid string, f long, energy double")).orderBy("f").collect()
    assert [round(r["smoothed"], 9) for r in got] == [1.2, 1.2, 1.2]


def test_blocked_search_and_batch_embedding_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sid string, k long, v array<double>")
    e = embed.with_embedding(rows, "v", 4, 16)
    assert np.allclose([r["emb"] for r in e.orderBy("k").collect()], embed.embed_batch(x, 16))
    assert np.allclose(embed.embed_batch(x, 16), [model_embed(v) for v in x])
    q, d = e.select("sid", F_k("rid"), "emb"), e.select("sid", F_k("dom"), "emb")
    a = search.topk(q, d, 5, 16, on=["sid"], query="rid", entry="dom").select("rid", "rank", "dom").collect()
    b = search.topk_blocked(q, d, 5, on="sid", query="rid", entry="dom", rows=7).select("rid", "rank", "dom").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def F_k(name):  # noqa: N802
    from pyspark.sql import functions as F

    return F.col("k").alias(name)


def test_long_vectors_take_the_batch_path(spark):
    x = np.random.default_rng(4).normal(size=(5, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = [r["emb"] for r in embed.with_embedding(rows, "v", 32, 16).orderBy("k").collect()]
    assert np.allclose(got, [model_embed(v) for v in x])


def test_snr_edges(spark):
    a = as_samples(spark, a=[1, 2, 3], z=[0, 0, 0])
    b = as_samples(spark, a=[1, 2], z=[1, 0, 0])
    got = {r["sid"]: r["snr"] for r in metrics.snr(a, b).collect()}
    assert got == {"a": float("inf"), "z": float("-inf")}


def test_mel_bank_is_triangular():
    w = mel_weights()
    assert w.shape == (40, 513)
    assert (w >= 0).all()
    assert ((np.diff(np.sign(np.diff(w[20][w[20] > 0]))) != 0).sum()) <= 1


def test_top_k_plan_limits_before_the_shuffle_ends(spark):
    p = CodecParams(tile=32, top_k=4, mask=False)
    x = as_samples(spark, a=np.random.default_rng(1).normal(0, 9, 80))
    plan = codec.candidates(frames.ranges(x, p.R), codec.dictionary(x, p), p)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
