"""Folders of files: compress, decompress, skip what is done, report."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.operators import codec
from rangeweave.params import CodecParams
from rangeweave.sources import container, wav


def base(path: str):
    """A path's last part."""
    return F.element_at(F.split(path, "/"), -1)


def listed(spark: SparkSession, source: str, pattern: str, extension: str, output: str | None = None) -> DataFrame:
    """Rows (path, content, name) of the files in source; name is that of the output.

    It is the file's own without its extension, but the whole where two files differ in that only
    (a.wav, a.WAV); output, if given, is the name for a single file.
    """
    files = wav.list_files(spark, source, pattern)
    if output is not None:
        return files.withColumn("name", F.lit(output))
    stem = F.regexp_replace(base("path"), r"\.[^.]*$", "")
    twins = files.select("path").groupBy(stem.alias("twin")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("twin")
    named = files.withColumn("twin_of", stem).join(twins, F.col("twin_of") == F.col("twin"), "left")
    return named.select("path", "content", F.concat(F.when(F.col("twin").isNull(), F.col("twin_of")).otherwise(base("path")), F.lit(f".{extension}")).alias("name"))


def pending(spark: SparkSession, source: str, target: str, pattern: str, extension: str, output: str | None = None) -> DataFrame:
    """listed() without the files whose output is in target."""
    files = listed(spark, source, pattern, extension, output)
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(target)
    if not folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder):
        return files
    return files.join(sizes_in(spark, target).select("name"), "name", "left_anti")


def compress(spark: SparkSession, source: str, target: str, p: CodecParams, *, skip: bool = True, output: str | None = None) -> DataFrame:
    """Encode every WAV file of a folder into target/<name>.fwav; one job for all. Returns metrics.

    A file that cannot be read has an error in its row, and the others go on. Samples of 4 bytes,
    integers or floats, are encoded between -1 and 1, which is what their width stands for in a
    container. output: name of the result, where source is a single file.
    """
    began = time.time()
    files = (pending if skip else listed)(*((spark, source, target) if skip else (spark, source)), wav.GLOB, "fwav", output).persist()
    signals, samples = wav.from_files(files, unit=True)
    signals, samples = signals.persist(), samples.persist()
    good = signals.where("n is not null")
    _, domains, matches = codec.encode(samples, p)
    names = files.select(F.col("path").alias("sid"), "name")
    made = container.contents(matches, domains, good, p).join(names, "sid")
    wav.write_files(made, folder=target).count()
    sizes = files.select("path", "name", F.length("content").alias("size"))
    error = F.when(F.col("n").isNull(), F.lit("not a readable file"))
    rows = signals.select("sid", error.alias("error")).join(sizes, F.col("sid") == F.col("path")).join(sizes_in(spark, target), "name", "left")
    done = report(rows, time.time() - began)
    for df in (files, signals, samples):
        df.unpersist()
    return done


def report(rows: DataFrame, seconds: float) -> DataFrame:
    """Metrics of rows (sid, error, size, output, bytes), collected: a row for each file of the call."""
    good = F.col("error").isNull()
    ratio = F.when(F.coalesce("bytes", F.lit(0)) > 0, F.col("size") / F.col("bytes")).otherwise(0.0)
    out = rows.select(F.col("sid").alias("input"), F.when(good, F.col("output")).alias("output"), F.lit(seconds).alias("time_s"), F.when(good, ratio).alias("ratio"), "error")
    return rows.sparkSession.createDataFrame(out.collect(), out.schema)


def sizes_in(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, output, bytes) of the files of a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(base("path").alias("name"), F.col("path").alias("output"), F.col("length").alias("bytes"))


def decompress(spark: SparkSession, source: str, target: str, p: CodecParams, *, skip: bool = True) -> DataFrame:
    """Decode every container of a folder into target/<name>.wav. Returns metrics.

    Range size, tile and step are those of each container's header: containers are decoded together
    with those that share them. One that is broken has an error in its row, and the others go on.
    """
    began = time.time()
    pattern = "*.[fF][wW][aA][vV]"
    files = (pending(spark, source, target, pattern, "wav") if skip else listed(spark, source, pattern, "wav")).persist()
    every, domains, matches = (df.persist() for df in container.parse(files, strict=False))
    heads = every.where("error is null")
    names = files.select(F.col("path").alias("sid"), "name")
    shape = ["tile", "range_size", "step"]
    shapes = heads.select(*shape).distinct().collect()  # as many as there are settings in use
    for k in shapes:
        own = replace(p, tile=k["tile"], range_size=k["range_size"], domain_step=k["step"])
        some = heads.where((F.col("tile") == k["tile"]) & (F.col("range_size") == k["range_size"]) & (F.col("step") == k["step"]))
        ids = some.select("sid")
        decoded = codec.decode(matches.join(ids, "sid", "left_semi"), domains.join(ids, "sid", "left_semi"), some.select("sid", "n"), own)
        # Signals without a match are silent: zeros of their length.
        bare = some.where("n_ranges = 0 and n > 0").select("sid", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"), F.lit(0.0).alias("x"))
        rows = decoded.unionByName(bare).join(some.select("sid", F.col("sampwidth").alias("w")), "sid")
        rows = rows.select("sid", "i", F.when(F.col("w") == 4, F.greatest(F.least("x", F.lit(1.0)), F.lit(-1.0))).otherwise(F.col("x")).alias("x"))
        made = wav.contents(rows, some.select("sid", "framerate", "sampwidth")).join(names, "sid")
        wav.write_files(made, folder=target).count()
    out = sizes_in(spark, target) if shapes else spark.createDataFrame([], "name string, output string, bytes long")
    rows = every.select("sid", "error").join(files.select("path", "name", F.length("content").alias("size")), F.col("sid") == F.col("path")).join(out, "name", "left")
    done = report(rows, time.time() - began)
    for df in (files, every, domains, matches):
        df.unpersist()
    return done


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as a JSON list, without null fields."""
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in metrics.collect()]
    with open(path, "w") as f:
        json.dump(rows, f, indent=2)
