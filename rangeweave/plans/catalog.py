"""Registered queries over the signal operators.

Signals come from the provided tables: U, one per user (events in time order), and E, one per event
type (long ones). V are the 64-dimensional unit vectors of `embeddings`. Vectors are returned as one
row per element, rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.functions import mel, vec
from rangeweave.operators import codec, domains, embed, frames, match, metrics, search
from rangeweave.params import CodecParams
from rangeweave.sources import container, tables, wav

P = CodecParams(tile=32, top_k=8)
#: Voice activity at the values' own scale.
HIGH = 5000.0
QUIET = CodecParams(tile=32, top_k=8, energy_threshold=2000.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.series(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.series_long(table(spark, sf_dir, "events"), "event_type", "value", "ts", ["ts", "event_id"])


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def flat(rows: DataFrame, vector: str) -> DataFrame:
    return frames.elements(rows, vector).withColumn("x", F.round("x", 6))


def user_ranges(spark, sf_dir):
    return frames.ranges(users(spark, sf_dir), P.R)


def user_domains(spark, sf_dir):
    return codec.dictionary(users(spark, sf_dir), P)


def pairs(spark, sf_dir, p: CodecParams = P) -> DataFrame:
    """Candidates with their vectors."""
    return codec.candidates(user_ranges(spark, sf_dir), user_domains(spark, sf_dir), p)


# --- samples and frames --------------------------------------------------------------------


@query
def samples_indexed(spark, sf_dir):
    return users(spark, sf_dir).select("sid", "i", r6("x"))


@query
def downmix_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    channels = F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.col("l_extendedprice").alias("x")), F.struct(F.lit(1).alias("ch"), F.col("l_discount").alias("x"))))
    rows = li.select(F.col("l_orderkey").cast("string").alias("sid"), F.col("l_linenumber").cast("long").alias("i"), channels.alias("c"))
    return tables.downmix(rows.select("sid", "i", "c.ch", "c.x")).select("sid", "i", r6("x"))


@query
def pcm24_sign_extend(spark, sf_dir):
    word = F.pmod(F.col("l_partkey") * 7919, F.lit(16777216))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tables.sign_extend_24(word).cast("long").alias("sample"))


@query
def pcm_quantize_16(spark, sf_dir):
    return users(spark, sf_dir).select("sid", "i", tables.quantize((F.col("x") - 200) * 150, 16).alias("pcm"))


@query
def frame_energy(spark, sf_dir):
    return frames.frame_energy(kinds(spark, sf_dir), 64).select("sid", "f", r6("energy"))


@query
def energy_smoothed(spark, sf_dir):
    return frames.smooth(frames.frame_energy(kinds(spark, sf_dir), 64)).select("sid", "f", r6("energy"), r6("smoothed"))


@query
def voiced_frames(spark, sf_dir):
    return frames.voiced_frames(kinds(spark, sf_dir), 64, HIGH).select("sid", "f", r6("smoothed"), "voiced")


@query
def masked_samples(spark, sf_dir):
    x = kinds(spark, sf_dir)
    return frames.mask(x, frames.voiced_frames(x, 64, HIGH), 64).select("sid", "i", r6("x"))


@query
def active_signals(spark, sf_dir):
    return frames.active_signals(users(spark, sf_dir), 300_000.0).select("sid", r6("energy"), "n")


@query
def reflect_padded(spark, sf_dir):
    return frames.reflect_pad(users(spark, sf_dir), 16).select("sid", "i", r6("x"))


@query
def ranges_tumbling(spark, sf_dir):
    return flat(user_ranges(spark, sf_dir), "r")


@query
def frames_sliding(spark, sf_dir):
    return flat(frames.sliding_frames(users(spark, sf_dir), 4, 2), "r")


@query
def domains_block_mean(spark, sf_dir):
    return flat(domains.domains(users(spark, sf_dir), P.tile, P.R, P.step), "tile")


@query
def transient_mask(spark, sf_dir):
    return frames.transient_mask(kinds(spark, sf_dir), 256).select("sid", "i", r6("mask"))


# --- embeddings ------------------------------------------------------------------------------


@query
def dct_coefficients(spark, sf_dir):
    return flat(user_ranges(spark, sf_dir).select("sid", "rid", F.array(*vec.dct(vec.items("r", P.R))).alias("v")), "v")


def _embedded(spark, sf_dir, dim: int, head: str) -> DataFrame:
    rows = embed.with_embedding(user_ranges(spark, sf_dir), "r", P.R, dim, "v", head)
    return flat(rows.select("sid", "rid", "v"), "v")


@query
def embed_tonal_plain(spark, sf_dir):
    return _embedded(spark, sf_dir, 16, "plain")


@query
def embed_tile(spark, sf_dir):
    return _embedded(spark, sf_dir, 8, "tonal")


@query
def embed_transient(spark, sf_dir):
    return _embedded(spark, sf_dir, 8, "transient")


@query
def embed_multihead(spark, sf_dir):
    return flat(user_domains(spark, sf_dir).select("sid", "dom", F.col("emb").alias("v")), "v")


@query
def energy_prune(spark, sf_dir):
    rows = frames.energy_prune(user_ranges(spark, sf_dir), P.R, QUIET.energy_threshold)
    return rows.select("sid", "rid", F.round(vec.energy("r", P.R), 6).alias("energy"))


def _bounds(spark, sf_dir, entries: DataFrame) -> DataFrame:
    both = user_ranges(spark, sf_dir).join(entries.select("sid", "dom", "tile"), "sid")
    bound = vec.correlation_bound(F.col("rc"), F.col("tc"), P.R)
    rows = both.select("sid", "rid", "dom", vec.centred("r", P.R).alias("rc"), vec.centred("tile", P.R).alias("tc"))
    return rows.select("sid", "rid", "dom", F.round(bound, 6).alias("bound"))


@query
def correlation_bound(spark, sf_dir):
    """The bound of every range with the first domain; correlation_bounds has all domains."""
    return _bounds(spark, sf_dir, user_domains(spark, sf_dir).where("dom = 0")).drop("dom")


@query
def correlation_bounds(spark, sf_dir):
    """The bound of every range with every domain of its signal."""
    return _bounds(spark, sf_dir, user_domains(spark, sf_dir))


# --- search ----------------------------------------------------------------------------------


def _vectors(spark, sf_dir, name: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias("emb"))
    return rows.withColumn("space", F.lit(0))


#: The queries of a search over V are the vectors whose number this divides; entries are all vectors.
EVERY = 100


@query
def topk_vectors(spark, sf_dir):
    q, e = _vectors(spark, sf_dir, "q").where(F.col("q") % EVERY == 0), _vectors(spark, sf_dir, "vec_id")
    return search.topk_blocked(q, e, 5, on="space", query="q", entry="vec_id", rows=512).select("q", "rank", "vec_id", r6("score"))


@query
def all_pairs_ranked(spark, sf_dir):
    """Every entry ranked for each query: the full descending sort."""
    q, e = _vectors(spark, sf_dir, "q").where(F.col("q") % EVERY == 0), _vectors(spark, sf_dir, "vec_id")
    return search.topk_blocked(q, e, None, on="space", query="q", entry="vec_id").select("q", "rank", "vec_id", r6("score"))


@query
def topk_range_domain(spark, sf_dir):
    return pairs(spark, sf_dir).select("sid", "rid", "rank", "dom", r6("score"))


@query
def topk_domain_alias(spark, sf_dir):
    return pairs(spark, sf_dir, CodecParams(tile=32, top_k=8, query_mode="domain_alias")).select("sid", "rid", "rank", "dom", r6("score"))


@query
def topk_lsh(spark, sf_dir):
    q, e = _vectors(spark, sf_dir, "q").where(F.col("q") % EVERY == 0), _vectors(spark, sf_dir, "vec_id")
    return search.topk_lsh(q, e, 5, 64, query="q", entry="vec_id").select("q", "rank", "vec_id", r6("score"))


@query
def topk_ranges_blocked(spark, sf_dir):
    """topk_range_domain by blocks, the way of long signals."""
    p = CodecParams(tile=32, top_k=8, search_mode="blocked")
    return pairs(spark, sf_dir, p).select("sid", "rid", "rank", "dom", r6("score"))


@query
def topk_ranges_cells(spark, sf_dir):
    """Long signals searched in the best cells of their dictionaries only."""
    x, p = kinds(spark, sf_dir), CodecParams(tile=32, top_k=8, search_mode="cells")
    return codec.candidates(frames.ranges(x, p.R), codec.dictionary(x, p), p).select("sid", "rid", "rank", "dom", r6("score"))


# --- matching --------------------------------------------------------------------------------


@query
def symmetry_pairs(spark, sf_dir):
    return flat(match.symmetry_pairs(user_domains(spark, sf_dir).select("sid", "dom", "tile")), "tile")


def _matches(rows: DataFrame) -> DataFrame:
    return rows.select("sid", "rid", "dom", "sym", r6("s"), r6("o"), r6("err"))


@query
def affine_best_match(spark, sf_dir):
    return _matches(match.best_match(pairs(spark, sf_dir), P.R, s_clip=P.s_clip))


@query
def affine_nonflat_match(spark, sf_dir):
    return _matches(match.best_textured_match(pairs(spark, sf_dir), P.R, flat=100.0))


@query
def affine_weighted(spark, sf_dir):
    return _matches(match.best_weighted_match(pairs(spark, sf_dir), P.R))


@query
def affine_weighted_pruned(spark, sf_dir):
    return _matches(match.best_weighted_match(pairs(spark, sf_dir), P.R, prune=True))


@query
def perceptual_error(spark, sf_dir):
    return pairs(spark, sf_dir).select("sid", "rid", "rank", F.round(match.perceptual_error("tile", "r", P.R), 6).alias("err"))


# --- codec -----------------------------------------------------------------------------------


@query
def encode_matches(spark, sf_dir):
    return _matches(codec.encode(users(spark, sf_dir), QUIET)[2])


def _encoded(spark, sf_dir):
    x = users(spark, sf_dir)
    _, d, m = codec.encode(x, QUIET)
    return x, d, m


@query
def encode_blocked(spark, sf_dir):
    """encode_matches with candidates found by blocks."""
    p = CodecParams(tile=32, top_k=8, energy_threshold=2000.0, search_mode="blocked")
    return _matches(codec.encode(users(spark, sf_dir), p)[2])


@query
def gather_tiles(spark, sf_dir):
    _, d, m = _encoded(spark, sf_dir)
    return flat(codec.gather(m, d, P.R).select("sid", "rid", "tile"), "tile")


def _decoded(spark, sf_dir, **options) -> DataFrame:
    x, d, m = _encoded(spark, sf_dir)
    p = CodecParams(tile=32, top_k=8, energy_threshold=2000.0, **options)
    return codec.decode(m, d, tables.lengths(x), p)


@query
def decode_refit(spark, sf_dir):
    return _decoded(spark, sf_dir).select("sid", "i", r6("x"))


@query
def decode_damped(spark, sf_dir):
    return _decoded(spark, sf_dir, s_damping=0.5, eps=0.0).select("sid", "i", r6("x"))


@query
def decode_stored(spark, sf_dir):
    return _decoded(spark, sf_dir, scale_mode="stored").select("sid", "i", r6("x"))


@query
def convergence_pass(spark, sf_dir):
    _, d, m = _encoded(spark, sf_dir)
    p = CodecParams(tile=32, top_k=8, energy_threshold=2000.0, s_damping=0.5, eps=0.02)
    return codec.convergence(m, d, p)


@query
def overlap_average(spark, sf_dir):
    return codec.overlap_average(frames.sliding_frames(users(spark, sf_dir), 4, 2), 2).select("sid", "i", r6("x"))


@query
def snr(spark, sf_dir):
    x = users(spark, sf_dir)
    return metrics.snr(x, _decoded(spark, sf_dir, scale_mode="stored")).select("sid", r6("snr"))


# --- files -----------------------------------------------------------------------------------

RATE = 8000


def _files(rows: DataFrame) -> DataFrame:
    """(sid, content) as rows of the binary source."""
    return rows.select(F.col("sid").alias("path"), "content")


def _waves(spark, sf_dir, width: int) -> DataFrame:
    """A WAV file for each user: the values, 40 less in 8 bits, 150 times in wider ones."""
    scaled = F.col("x") - 40 if width == 1 else F.col("x") * 150
    x = users(spark, sf_dir).select("sid", "i", scaled.alias("x"))
    heads = x.select("sid").distinct().select("sid", F.lit(RATE).alias("framerate"), F.lit(width).alias("sampwidth"))
    return wav.contents(x, heads)


@query
def wav_file_bytes(spark, sf_dir):
    """Headers and sizes of files that the WAV sink makes, and the first bytes of their samples."""
    c = F.col("content")
    return _waves(spark, sf_dir, 2).select("sid", F.length(c).cast("long").alias("n_bytes"), F.lower(F.hex(F.substring(c, 1, 48))).alias("head"))


@query
def wav_headers(spark, sf_dir):
    """What the WAV scan reads of the headers of such files."""
    found, _ = wav.from_files(_files(_waves(spark, sf_dir, 2)))
    return found.select("sid", "framerate", "sampwidth", "n_channels", "n")


@query
def wav_samples_8(spark, sf_dir):
    return wav.from_files(_files(_waves(spark, sf_dir, 1)))[1].select("sid", "i", "x")


@query
def wav_samples_24(spark, sf_dir):
    return wav.from_files(_files(_waves(spark, sf_dir, 3)))[1].select("sid", "i", "x")


def _containers(spark, sf_dir):
    x, d, m = _encoded(spark, sf_dir)
    heads = tables.lengths(x).select("sid", F.lit(RATE).alias("framerate"), F.lit(2).alias("sampwidth"), "n")
    return container.parse(_files(container.contents(m, d, heads, QUIET)))


@query
def container_headers(spark, sf_dir):
    """Headers of stored containers, read back."""
    return _containers(spark, sf_dir)[0].select("sid", "range_size", "framerate", "sampwidth", "tile", "step", r6("energy_threshold"), "n_ranges", "n_domains", "n")


@query
def container_matches(spark, sf_dir):
    """Matches of stored containers, read back: numbers are exact, the rest has 32 bits."""
    return _containers(spark, sf_dir)[2].select("sid", "rid", "dom", "sym", F.round("s", 3).alias("s"))


@query
def container_tiles(spark, sf_dir):
    """Dictionaries of stored containers, read back."""
    return frames.elements(_containers(spark, sf_dir)[1], "tile").withColumn("x", F.round("x", 2))


@query
def mel_bank(spark, sf_dir):
    """The non-zero weights of the default bank; a constant, it reads no table."""
    return mel.mel_table(spark).select("mel", "bin", F.round("weight", 9).alias("weight"))


@query
def payload_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query
def pending_files(spark, sf_dir):
    """Inputs without an output: documents that have no label."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query
def compression_ratio(spark, sf_dir):
    return metrics.compression_ratio(tables.lengths(users(spark, sf_dir)), P).select("sid", "in_bytes", "out_bytes", r6("ratio"))
