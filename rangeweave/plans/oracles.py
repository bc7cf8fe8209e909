"""DuckDB SQL with the same results as the registered queries, put together from named parts."""

from __future__ import annotations

from math import cos, pi, sqrt

R, TILE, BLOCK, K = 4, 32, 8, 8


def _dct(k: int, xs: list[str]) -> str:
    n = len(xs)
    c = sqrt(1 / n) if k == 0 else sqrt(2 / n)
    return "(" + " + ".join(f"{x} * ({c * cos(pi * (2 * j + 1) * k / (2 * n))!r})" for j, x in enumerate(xs)) + ")"


def _at(v: str) -> list[str]:
    return [f"{v}[{j}]" for j in range(1, R + 1)]


def _unit(v: str) -> str:
    return f"CASE WHEN sqrt(list_sum(list_transform({v}, lambda z: z * z))) > 1e-8 THEN list_transform({v}, lambda y: y / sqrt(list_sum(list_transform({v}, lambda z: z * z)))) ELSE {v} END"


def _ramp(low: float, high: float) -> list[float]:
    return [low + (high - low) * j / (R - 1) for j in range(R)]


def _with(*parts: str, out: str) -> str:
    seen = list(dict.fromkeys(parts))
    return "WITH " + ",\n".join(seen) + "\n" + out


U = "u AS (SELECT CAST(user_id AS VARCHAR) AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
E = U.replace("u AS", "e AS").replace("user_id", "event_type")
N = "n AS (SELECT sid, count(*) AS n FROM u GROUP BY sid)"


def _pad(src: str, multiple: int, name: str) -> str:
    return f"""{name} AS (SELECT sid, i, x FROM {src} UNION ALL
  SELECT s.sid, 2 * (c.n - 1) - s.i, s.x FROM {src} s JOIN (SELECT sid, count(*) AS n, (({multiple} - count(*) % {multiple}) % {multiple}) AS pad FROM {src} GROUP BY sid) c ON s.sid = c.sid
  WHERE s.i BETWEEN c.n - 1 - c.pad AND c.n - 2)"""


UP = _pad("u", R, "up")
RANGES = f"ranges AS (SELECT sid, i // {R} AS rid, list(x ORDER BY i) AS r FROM up GROUP BY sid, i // {R})"
DOMAINS = f"""bm AS (SELECT sid, i, avg(x) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING) AS m FROM u),
domains AS (SELECT a.sid, a.i AS dom, [{", ".join(f"t{k}.m" for k in range(R))}] AS tile FROM bm a JOIN n ON a.sid = n.sid AND a.i + {TILE} <= n.n
  {" ".join(f"JOIN bm t{k} ON t{k}.sid = a.sid AND t{k}.i = a.i + {k * BLOCK}" for k in range(R))})"""
_TONAL = f"[{', '.join(f'{_dct(k, _at("v"))} * {w!r}' for k, w in enumerate(_ramp(1, 2)) if k)}, 0.0, 0.0, 0.0, 0.0, 0.0]"
_STEPS = ["0.0"] + [f"(v[{j + 1}] - v[{j}]) * {w!r}" for j, w in zip(range(1, R), _ramp(1, 2)[1:], strict=True)]
_TRANSIENT = f"[{', '.join(_dct(k, _STEPS) for k in range(R))}]"


def _emb(src: str, vector: str, keys: str, name: str) -> str:
    return f"""{name}0 AS (SELECT {keys}, {vector} AS v FROM {src}),
{name}1 AS (SELECT {keys}, v, {_TONAL} AS a, {_TRANSIENT} AS b FROM {name}0),
{name} AS (SELECT {keys}, v AS {vector}, {_unit("a")} AS tonal, {_unit("b")} AS transient, list_concat({_unit("a")}, {_unit("b")}, [0.0, 0.0, 0.0, 0.0]) AS emb FROM {name}1)"""


REMB, DEMB = _emb("ranges", "r", "sid, rid", "remb"), _emb("domains", "tile", "sid, dom", "demb")
_SCORE = "round(list_sum(list_transform(list_zip(q.emb, d.emb), lambda p: p[1] * p[2])), 9)"


def _top(name: str, queries: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.sid, q.rid, q.r, d.dom, d.tile, {_SCORE} AS score,
  CAST(row_number() OVER (PARTITION BY q.sid, q.rid ORDER BY {_SCORE} DESC, d.dom) - 1 AS INTEGER) AS rank
  FROM ({queries}) q JOIN demb d ON q.sid = d.sid) WHERE rank < {K})"""


TOP = _top("top", "SELECT sid, rid, r, emb FROM remb WHERE list_sum(list_transform(r, lambda a: a * a)) / 4 >= 0.75 * 1e-4")
ALIAS = _top("top", "SELECT r.sid, r.rid, r.r, d.emb FROM ranges r JOIN demb d ON r.sid = d.sid AND r.rid = d.dom WHERE list_sum(list_transform(r.r, lambda a: a * a)) / 4 >= 0.75 * 1e-4")
BASE = (U, N, UP, RANGES)
SEARCH = (*BASE, DOMAINS, REMB, DEMB, TOP)

_MR, _MT = "((r[1] + r[2] + r[3] + r[4]) / 4)", "((t[1] + t[2] + t[3] + t[4]) / 4)"
_NUM = " + ".join(f"(r[{j}] - mr) * (t[{j}] - mt)" for j in range(1, R + 1))
_DEN = " + ".join(f"(t[{j}] - mt) * (t[{j}] - mt)" for j in range(1, R + 1))
_RES = [f"(s * t[{j}] + o - r[{j}])" for j in range(1, R + 1)]


def _fit(top: str = "top", where: str = "true", weights: list[str] | None = None) -> str:
    gaps = [f"({g} * {w})" for g, w in zip(_RES, weights, strict=True)] if weights else _RES
    return f"""ways AS (SELECT sid, rid, rank, dom, r, tile AS t, 0 AS sym FROM {top} UNION ALL SELECT sid, rid, rank, dom, r, list_reverse(tile), 1 FROM {top}),
w1 AS (SELECT *, {_MR} AS mr, {_MT} AS mt FROM ways),
w2 AS (SELECT *, {_NUM} AS num, {_DEN} AS den, {" + ".join(f"(r[{j}] - mr) * (r[{j}] - mr)" for j in range(1, R + 1))} AS ren FROM w1),
w3 AS (SELECT *, num / (den + 1e-12) AS s FROM w2 WHERE {where}),
w4 AS (SELECT *, mr - s * mt AS o FROM w3),
w5 AS (SELECT *, round(sqrt({" + ".join(f"{g} * {g}" for g in gaps)}), 9) AS err FROM w4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, rid ORDER BY err, sym, rank) AS nth FROM w5) WHERE nth = 1)"""


def _best(limit: str) -> str:
    s = f"least(greatest(s, -{limit}), {limit})" if limit else "s"
    return f"SELECT sid, rid, dom, sym, round({s}, 6) AS s, round(o, 6) AS o, round(err, 6) AS err FROM best"


def _flat(src: str, vector: str, keys: str, n: str | int = R) -> str:
    return f"SELECT {keys}, CAST(p.pos AS INTEGER) AS pos, round({vector}[p.pos + 1], 6) AS x FROM {src}, range({n}) p(pos)"


# --- voice activity ----------------------------------------------------------------------------


def _voiced(src: str, frame: int, high: float, tag: str = "") -> str:
    padded = _pad(src, frame, f"fp{tag}")
    return f"""{padded},
fe{tag} AS (SELECT sid, i // {frame} AS f, avg(x * x) AS energy FROM fp{tag} GROUP BY sid, i // {frame}),
fs{tag} AS (SELECT *, sum(energy) OVER (PARTITION BY sid ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smoothed FROM fe{tag}),
fv{tag} AS (SELECT *, CAST(coalesce(last_value(CASE WHEN smoothed > {high} THEN 1 WHEN smoothed < {high / 2} THEN 0 END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS voiced FROM fs{tag})"""


# --- codec ---------------------------------------------------------------------------------------

_THR = 2000.0
_MASKED = f"mu AS (SELECT u.sid, u.i, u.x * v.voiced AS x FROM u JOIN fv v ON u.sid = v.sid AND u.i // {2 * R} = v.f)"
_MUP = _pad("mu", R, "mup")
_MRANGES = f"ranges AS (SELECT sid, i // {R} AS rid, list(x ORDER BY i) AS r FROM mup WHERE sid IN (SELECT sid FROM mu GROUP BY sid HAVING sum(x * x) >= 1e-8) GROUP BY sid, i // {R})"
_MTOP = _top("top", f"SELECT sid, rid, r, emb FROM remb WHERE list_sum(list_transform(r, lambda a: a * a)) / 4 >= 0.75 * {_THR}")
ENCODE = (U, N, _voiced("u", 2 * R, _THR), _MASKED, _MUP, _MRANGES, DOMAINS, REMB, DEMB, _MTOP, _fit())
_MATCHES = """matches AS (SELECT r.sid, r.rid, coalesce(b.dom, -1) AS dom, CASE WHEN b.sid IS NULL THEN 0.0 ELSE least(greatest(b.s, -16.0), 16.0) END AS s, coalesce(b.o, 0.0) AS o, coalesce(b.sym, 0) AS sym, coalesce(b.err, 0.0) AS err
  FROM ranges r LEFT JOIN best b ON r.sid = b.sid AND r.rid = b.rid WHERE r.sid IN (SELECT sid FROM domains))"""
_GATHER = """g AS (SELECT m.sid, m.rid, m.s, m.o, CASE WHEN d.tile IS NULL THEN [0.0, 0.0, 0.0, 0.0] WHEN m.sym = 1 THEN list_reverse(d.tile) ELSE d.tile END AS t FROM matches m LEFT JOIN domains d ON m.sid = d.sid AND m.dom = d.dom),
g1 AS (SELECT *, (t[1] + t[2] + t[3] + t[4]) / 4 AS mt FROM g),
g2 AS (SELECT *, (t[1] - mt) * (t[1] - mt) + (t[2] - mt) * (t[2] - mt) + (t[3] - mt) * (t[3] - mt) + (t[4] - mt) * (t[4] - mt) > 1e-12 AS moving FROM g1)"""
CODED = (*ENCODE, _MATCHES, _GATHER)


def _decode(scale: str) -> str:
    return f"y AS (SELECT g2.sid, g2.rid * {R} + p.pos AS i, {scale} * t[p.pos + 1] + o AS x FROM g2 JOIN n ON g2.sid = n.sid, range({R}) p(pos) WHERE g2.rid * {R} + p.pos < n.n)"


_CLIP = "least(greatest({}, -16.0), 16.0)"
_SHARES = [0.0] + [1 - 0.5**t for t in range(1, 9)]
_SIZE = [f"sqrt(greatest(0.0, {g * g!r} * A + {2 * g!r} * B + C))" for g in _SHARES]
_STOP = f"CASE WHEN {_SIZE[1]} < 0.02 THEN 1 " + " ".join(f"WHEN {abs(_SHARES[t] - _SHARES[t - 1])!r} * sqrt(A) / CASE WHEN {_SIZE[t - 1]} > 0 THEN {_SIZE[t - 1]} ELSE 1.0 END < 0.02 THEN {t}" for t in range(2, 9)) + " ELSE 8 END"
_V = "CASE WHEN moving THEN s * t[p.pos + 1] ELSE 0.0 END"
_F = "(CASE WHEN moving THEN 0.0 ELSE s * 0.5 END * t[p.pos + 1] + o)"

_EMBV = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings)"
_VSCORE = "round(list_sum(list_transform(list_zip(q.emb, d.emb), lambda p: p[1] * p[2])), 9)"
_WEIGHTS = [f"({w!r} * (1 + {f'abs(r[{j + 2}] - r[{j + 1}])' if j < R - 1 else '0.0'}))" for j, w in enumerate(_ramp(1.0, 0.5))]

_SIMILAR = "den / (ren + 1e-12) > 0.25 AND den / (ren + 1e-12) < 4"
_LEAST = "round(sqrt(ren) * sqrt(1 - pow(least(1.0, CASE WHEN sqrt(den) < 1e-12 OR sqrt(ren) < 1e-12 THEN 0.0 ELSE abs(num) / (sqrt(ren) * sqrt(den)) END), 2)), 9)"
_PRUNED = f"""w6 AS (SELECT *, min(CASE WHEN sym = 0 THEN err END) OVER (PARTITION BY sid, rid) AS plain, {_LEAST} AS least_err FROM w5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, rid ORDER BY err, sym, rank) AS nth FROM w6 WHERE sym = 0 OR least_err < plain) WHERE nth = 1)"""

# --- files -----------------------------------------------------------------------------------------


def _le(value: str, size: int) -> str:
    """A number's little-endian bytes in lower-case hexadecimal digits."""
    return " || ".join(f"printf('%02x', (CAST({value} AS BIGINT) >> {8 * j}) & 255)" for j in range(size))


def _text(name: str) -> str:
    return f"'{name.encode().hex()}'"


#: A header of 16-bit mono samples at 8 kHz, and the first two samples.
_WAV_HEAD = " || ".join([_text("RIFF"), _le("36 + 2 * n", 4), _text("WAVE"), _text("fmt "), _le("16", 4), _le("1", 2), _le("1", 2), _le("8000", 4), _le("16000", 4), _le("2", 2), _le("16", 2), _text("data"), _le("2 * n", 4), "samples"])


def _cut(x: str, low: float, high: float) -> str:
    return f"trunc(least(greatest({x}, {low}), {high}))"


_P16 = f"p16 AS (SELECT sid, i, CAST({_cut('x * 150', -32768.0, 32767.0)} AS BIGINT) AS pcm FROM u)"
_FIRST = f"first AS (SELECT sid, string_agg({_le('pcm', 2)}, '' ORDER BY i) AS samples FROM p16 WHERE i < 2 GROUP BY sid)"
#: Signals of which something is stored, with the sizes of that.
_STORED = """r_n AS (SELECT sid, count(*) AS n_ranges FROM matches GROUP BY sid), d_n AS (SELECT sid, count(*) AS n_domains FROM domains GROUP BY sid)"""
_MEL = "(CASE WHEN {0} < 1000 THEN {0} * 3 / 200.0 ELSE 15 + 27 * ln({0} / 1000.0) / ln(6.4) END)"
_HZ = "(CASE WHEN {0} < 15 THEN {0} * 200 / 3.0 ELSE 1000 * exp(({0} - 15) * ln(6.4) / 27) END)"
_LOW, _HIGH = _MEL.format("20.0"), _MEL.format("22050.0")
_EDGES = f"edges AS (SELECT k, {_HZ.format('m')} AS f FROM (SELECT k, {_LOW} + ({_HIGH} - {_LOW}) * k / 41.0 AS m FROM range(42) t(k)))"
_BANK = """bank AS (SELECT CAST(a.k AS INTEGER) AS mel, CAST(b.bin AS INTEGER) AS bin,
  greatest(0.0, least((b.bin * 44100 / 1024.0 - a.f) / (c.f - a.f), (d.f - b.bin * 44100 / 1024.0) / (d.f - c.f))) * 2 / (d.f - a.f) AS weight
  FROM edges a JOIN edges c ON c.k = a.k + 1 JOIN edges d ON d.k = a.k + 2, range(513) b(bin))"""

SQL = {
    "samples_indexed": _with(U, out="SELECT sid, i, round(x, 6) AS x FROM u"),
    "downmix_mean": "SELECT CAST(l_orderkey AS VARCHAR) AS sid, CAST(l_linenumber AS BIGINT) AS i, round(avg(x), 6) AS x FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_discount FROM lineitem) GROUP BY l_orderkey, l_linenumber",
    "pcm24_sign_extend": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN w >= 8388608 THEN w - 16777216 ELSE w END AS BIGINT) AS sample FROM (SELECT *, (l_partkey * 7919) % 16777216 AS w FROM lineitem)",
    "pcm_quantize_16": _with(U, out="SELECT sid, i, CAST(trunc(least(greatest((x - 200) * 150, -32768.0), 32767.0)) AS INTEGER) AS pcm FROM u"),
    "frame_energy": _with(E, _voiced("e", 64, 5000.0), out="SELECT sid, f, round(energy, 6) AS energy FROM fe"),
    "energy_smoothed": _with(E, _voiced("e", 64, 5000.0), out="SELECT sid, f, round(energy, 6) AS energy, round(smoothed, 6) AS smoothed FROM fs"),
    "voiced_frames": _with(E, _voiced("e", 64, 5000.0), out="SELECT sid, f, round(smoothed, 6) AS smoothed, voiced FROM fv"),
    "masked_samples": _with(E, _voiced("e", 64, 5000.0), out="SELECT e.sid, e.i, round(e.x * v.voiced, 6) AS x FROM e JOIN fv v ON e.sid = v.sid AND e.i // 64 = v.f"),
    "active_signals": _with(U, out="SELECT sid, round(sum(x * x), 6) AS energy, count(*) AS n FROM u GROUP BY sid HAVING sum(x * x) >= 300000"),
    "reflect_padded": _with(U, _pad("u", 16, "p"), out="SELECT sid, i, round(x, 6) AS x FROM p"),
    "ranges_tumbling": _with(*BASE, out=_flat("ranges", "r", "sid, rid")),
    "frames_sliding": _with(U, N, out="SELECT u.sid, k.frame, CAST(u.i - 2 * k.frame AS INTEGER) AS pos, round(u.x, 6) AS x FROM (SELECT sid, unnest(range((n - 4) // 2 + 1)) AS frame FROM n WHERE n >= 4) k JOIN u ON u.sid = k.sid AND u.i BETWEEN 2 * k.frame AND 2 * k.frame + 3"),
    "domains_block_mean": _with(U, N, DOMAINS, out=_flat("domains", "tile", "sid, dom")),
    "transient_mask": _with(E, "l AS (SELECT sid, i, greatest(0.0, coalesce(abs(x) - lag(abs(x), 256) OVER (PARTITION BY sid ORDER BY i), 0.0)) AS rise FROM e)", out="SELECT sid, i, round(rise / (max(rise) OVER (PARTITION BY sid) + 1e-8), 6) AS mask FROM l"),
    "dct_coefficients": _with(*BASE, f"c AS (SELECT sid, rid, [{', '.join(_dct(k, _at('r')) for k in range(R))}] AS v FROM ranges)", out=_flat("c", "v", "sid, rid")),
    "embed_tonal_plain": _with(*BASE, f"c AS (SELECT sid, rid, [{', '.join(_dct(k, _at('r')) for k in range(1, R))}] AS a FROM ranges)", f"t AS (SELECT sid, rid, {_unit('a')} AS v FROM c)", out=_flat("t", "v", "sid, rid", R - 1)),
    "embed_tile": _with(*BASE, REMB, out=_flat("remb", "tonal", "sid, rid", 8)),
    "embed_transient": _with(*BASE, REMB, out=_flat("remb", "transient", "sid, rid", 4)),
    "embed_multihead": _with(U, N, DOMAINS, DEMB, out=_flat("demb", "emb", "sid, dom", 16)),
    "energy_prune": _with(*BASE, out="SELECT sid, rid, round(list_sum(list_transform(r, lambda a: a * a)), 6) AS energy FROM ranges WHERE list_sum(list_transform(r, lambda a: a * a)) / 4 >= 0.75 * 2000"),
    "correlation_bound": _with(*BASE, DOMAINS, f"c AS (SELECT a.sid, a.rid, a.r, d.tile AS t FROM ranges a JOIN domains d ON a.sid = d.sid AND d.dom = 0), c1 AS (SELECT *, {_MR} AS mr, {_MT} AS mt FROM c), c2 AS (SELECT *, {_NUM} AS num, sqrt({_DEN}) AS td, sqrt({_DEN.replace('t[', 'r[').replace('mt', 'mr')}) AS rd FROM c1)", out="SELECT sid, rid, round(CASE WHEN td < 1e-12 OR rd < 1e-12 THEN 0.0 ELSE abs(num) / (rd * td) END, 6) AS bound FROM c2"),
    "correlation_bounds": _with(*BASE, DOMAINS, f"c AS (SELECT a.sid, a.rid, d.dom, a.r, d.tile AS t FROM ranges a JOIN domains d ON a.sid = d.sid), c1 AS (SELECT *, {_MR} AS mr, {_MT} AS mt FROM c), c2 AS (SELECT *, {_NUM} AS num, sqrt({_DEN}) AS td, sqrt({_DEN.replace('t[', 'r[').replace('mt', 'mr')}) AS rd FROM c1)", out="SELECT sid, rid, dom, round(CASE WHEN td < 1e-12 OR rd < 1e-12 THEN 0.0 ELSE abs(num) / (rd * td) END, 6) AS bound FROM c2"),
    "topk_vectors": _with(_EMBV, out=f"SELECT q, rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS q, d.vec_id, {_VSCORE} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_VSCORE} DESC, d.vec_id) - 1 AS INTEGER) AS rank FROM v q, v d WHERE q.vec_id % 100 = 0) WHERE rank < 5"),
    "all_pairs_ranked": _with(_EMBV, out=f"SELECT q.vec_id AS q, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_VSCORE} DESC, d.vec_id) - 1 AS INTEGER) AS rank, d.vec_id, round({_VSCORE}, 6) AS score FROM v q, v d WHERE q.vec_id % 100 = 0"),
    "topk_range_domain": _with(*SEARCH, out="SELECT sid, rid, rank, dom, round(score, 6) AS score FROM top"),
    "topk_domain_alias": _with(*BASE, DOMAINS, DEMB, ALIAS, out="SELECT sid, rid, rank, dom, round(score, 6) AS score FROM top"),
    "symmetry_pairs": _with(U, N, DOMAINS, "s AS (SELECT sid, dom, 0 AS sym, tile FROM domains UNION ALL SELECT sid, dom, 1, list_reverse(tile) FROM domains)", out=_flat("s", "tile", "sid, dom, sym")),
    "affine_best_match": _with(*SEARCH, _fit(), out=_best("16.0")),
    "affine_nonflat_match": _with(*SEARCH, _fit(where="den >= 100"), out=_best("")),
    "affine_weighted": _with(*SEARCH, _fit(where="den / (ren + 1e-12) > 0.25 AND den / (ren + 1e-12) < 4", weights=_WEIGHTS), out=_best("")),
    "affine_weighted_pruned": _with(*SEARCH, _fit(where=_SIMILAR, weights=_WEIGHTS).split(",\nbest AS")[0], _PRUNED, out=_best("")),
    "perceptual_error": _with(*SEARCH, out=f"SELECT sid, rid, rank, round(sqrt({' + '.join(f'pow((tile[{j + 1}] - r[{j + 1}]) * {w}, 2)' for j, w in enumerate(_WEIGHTS))}), 6) AS err FROM top"),
    "encode_matches": _with(*ENCODE, _MATCHES, out="SELECT sid, rid, dom, sym, round(s, 6) AS s, round(o, 6) AS o, round(err, 6) AS err FROM matches"),
    "gather_tiles": _with(*CODED, out=_flat("g", "t", "sid, rid").replace(" AS x", " AS x")),
    "decode_refit": _with(*CODED, _decode(f"(CASE WHEN moving THEN 0.0 ELSE {_CLIP.format('s')} END)"), out="SELECT sid, i, round(x, 6) AS x FROM y"),
    "decode_damped": _with(*CODED, _decode(f"(CASE WHEN moving THEN {_CLIP.format(f's * {1 - 0.5**8!r}')} ELSE {_CLIP.format('s * 0.5')} END)"), out="SELECT sid, i, round(x, 6) AS x FROM y"),
    "decode_stored": _with(*CODED, _decode(_CLIP.format("s")), out="SELECT sid, i, round(x, 6) AS x FROM y"),
    "convergence_pass": _with(*CODED, f"z AS (SELECT sid, {_V} AS v, {_F} AS f FROM g2, range({R}) p(pos)), abc AS (SELECT sid, sum(v * v) AS A, sum(v * f) AS B, sum(f * f) AS C FROM z GROUP BY sid)", out=f"SELECT sid, CAST({_STOP} AS INTEGER) AS passes FROM abc"),
    "overlap_average": _with(U, N, out="SELECT u.sid, u.i, round(avg(u.x), 6) AS x FROM (SELECT sid, unnest(range((n - 4) // 2 + 1)) AS frame FROM n WHERE n >= 4) k JOIN u ON u.sid = k.sid AND u.i BETWEEN 2 * k.frame AND 2 * k.frame + 3 GROUP BY u.sid, u.i"),
    "snr": _with(*CODED, _decode(_CLIP.format("s")), "q AS (SELECT u.sid, sum(u.x * u.x) AS a, sum((u.x - y.x) * (u.x - y.x)) AS b FROM u JOIN y ON u.sid = y.sid AND u.i = y.i GROUP BY u.sid)", out="SELECT sid, round(CASE WHEN b <= 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(a / b) END, 6) AS snr FROM q"),
    "wav_file_bytes": _with(U, N, _P16, _FIRST, out=f"SELECT n.sid, 44 + 2 * n AS n_bytes, {_WAV_HEAD} AS head FROM n JOIN first ON n.sid = first.sid"),
    "wav_headers": _with(U, N, out="SELECT sid, 8000 AS framerate, 2 AS sampwidth, 1 AS n_channels, n FROM n"),
    "wav_samples_8": _with(U, out=f"SELECT sid, i, {_cut('x - 40 + 128', 0.0, 255.0)} - 128 AS x FROM u"),
    "wav_samples_24": _with(U, out=f"SELECT sid, i, {_cut('x * 150', -8388608.0, 8388607.0)} AS x FROM u"),
    "container_headers": _with(*CODED, _STORED, out=f"SELECT n.sid, CAST({R} AS BIGINT) AS range_size, CAST(8000 AS BIGINT) AS framerate, CAST(2 AS BIGINT) AS sampwidth, CAST({TILE} AS BIGINT) AS tile, CAST(1 AS BIGINT) AS step, {_THR} AS energy_threshold, coalesce(n_ranges, 0) AS n_ranges, CASE WHEN n_ranges > 0 THEN coalesce(n_domains, 0) ELSE 0 END AS n_domains, n FROM n LEFT JOIN r_n ON n.sid = r_n.sid LEFT JOIN d_n ON n.sid = d_n.sid"),
    "container_matches": _with(*CODED, out="SELECT sid, rid, dom, sym, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 3) AS s FROM matches"),
    "container_tiles": _with(*CODED, out=_flat("domains", "CAST(CAST(tile AS FLOAT[]) AS DOUBLE[])", "sid, dom").replace(", 6)", ", 2)") + " WHERE sid IN (SELECT sid FROM matches)"),
    "mel_bank": _with(_EDGES, _BANK, out="SELECT mel, bin, round(weight, 9) AS weight FROM bank WHERE weight > 0"),
    "payload_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "pending_files": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "compression_ratio": _with(U, N, f"b AS (SELECT sid, n * 2 AS in_bytes, CAST(66 + 16 * CASE WHEN n < {TILE} THEN 0 ELSE n - {TILE} + 1 END + 17 * ceil(n / {R}) AS BIGINT) AS out_bytes FROM n)", out="SELECT sid, in_bytes, out_bytes, round(in_bytes / out_bytes, 6) AS ratio FROM b"),
}
#: Other ways to the same rows.
SQL |= {"topk_ranges_blocked": SQL["topk_range_domain"], "encode_blocked": SQL["encode_matches"]}
