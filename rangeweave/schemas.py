"""Relations of the engine. Schemas are fixed; none is inferred."""

from pyspark.sql import types as T

_vector = T.ArrayType(T.DoubleType(), False)


def _schema(text: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in text.items()])


SIGNALS = _schema({"sid": T.StringType(), "path": T.StringType(), "framerate": T.IntegerType(), "sampwidth": T.IntegerType(), "n_channels": T.IntegerType(), "n": T.LongType()})
SAMPLES = _schema({"sid": T.StringType(), "i": T.LongType(), "x": T.DoubleType()})
FRAMES = _schema({"sid": T.StringType(), "f": T.LongType(), "energy": T.DoubleType(), "smoothed": T.DoubleType(), "voiced": T.IntegerType()})
RANGES = _schema({"sid": T.StringType(), "rid": T.LongType(), "r": _vector})
DOMAINS = _schema({"sid": T.StringType(), "dom": T.LongType(), "tile": _vector, "emb": _vector})
CANDIDATES = _schema({"sid": T.StringType(), "rid": T.LongType(), "rank": T.IntegerType(), "dom": T.LongType(), "score": T.DoubleType()})
MATCHES = _schema({"sid": T.StringType(), "rid": T.LongType(), "dom": T.LongType(), "s": T.DoubleType(), "o": T.DoubleType(), "sym": T.IntegerType(), "err": T.DoubleType()})
METRICS = _schema({"input": T.StringType(), "output": T.StringType(), "time_s": T.DoubleType(), "ratio": T.DoubleType(), "error": T.StringType()})
