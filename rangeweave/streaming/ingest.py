"""Continuous ingestion: new WAV files of a folder become matches, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rangeweave.operators import codec
from rangeweave.params import CodecParams
from rangeweave.sources import wav

_FILES = "path string, modificationTime timestamp, length long, content binary"


def encode_folder(spark: SparkSession, source: str, target: str, checkpoint: str, p: CodecParams, *, per_batch: int = 100) -> StreamingQuery:
    """Encode files as they appear; the checkpoint remembers which are done.

    Each micro-batch of at most per_batch files is one encoding job; its matches, dictionary and
    signals are written to folders of their own under target, by batch, so a batch that is run
    again replaces what it has written. Stops when no file is left (run it again for more).
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", wav.GLOB).option("maxFilesPerTrigger", per_batch).load(source)

    def batch(rows: DataFrame, number: int) -> None:
        signals, samples = wav.from_files(rows)
        _, domains, matches = codec.encode(samples, p)
        for name, df in (("signals", signals), ("domains", domains), ("matches", matches)):
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
