"""Language identification by prediction by partial matching.

For each language a context tree over lower-cased UTF-8 bytes is counted: how often each byte
followed each context of up to ORDER bytes. The code length of a byte is that of PPM with escape
method C under these frozen counts: -log2(n / (T + D)) where the context has seen the byte, else
the escape -log2(D / (T + D)) and the same one order lower (nothing for a context never seen; 8
bits below order 0). A text belongs to the language that codes it in the fewest bits.

The counts come from a bounded sample of labelled texts: at most TRAIN_ROWS of each language and
TRAIN_ALL of all, none over TRAIN_BYTES bytes, of at most LANGUAGES languages (those of most texts).
So the model's size has a proven bound too (it goes to the executors with the task). The sample is
the text of least hash in each of a number of hash classes of a language: minima combine before the
shuffle, so no task meets a language's rows. Scoring looks up whole texts, a slice at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.llm.common import tune

ORDER = 4
TRAIN_ROWS = 120
TRAIN_BYTES = 100_000
TRAIN_ALL, LANGUAGES = 2_000, 200
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 18
_U64 = np.uint64


class Table:
    """A hash table from uint64 keys to rows of floats, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self.keys, self.values = keys, values
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of those that want one slot, the last gets it
            stay = self.slot[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        at = self._home(keys)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            got = self.slot[at[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[got] != keys[wrong])]
        return out


class Model:
    """Code-length tables of all languages. grams[k]: by k + 1 bytes; escapes[k]: by the k bytes before."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        counts = [[Counter() for _ in range(order + 1)] for _ in self.langs]
        for x, lang in enumerate(self.langs):
            for text in texts[lang]:
                data = prepare(text)
                for k in range(order + 1):
                    keys = self.keys(np.frombuffer(b"\n" * order + data, dtype=np.uint8), k)[order:]
                    for key, n in zip(*map(np.ndarray.tolist, np.unique(keys, return_counts=True)), strict=True):
                        counts[x][k][key] += n
        self.grams, self.escapes = [], []
        if not self.langs:  # nothing learned: no text is looked up
            return
        lower: dict[int, np.ndarray] = {}
        for k in range(order + 1):
            seen = sorted(set().union(*(c[k] for c in counts)))
            cost = np.zeros((len(seen), len(self.langs)))
            ends: dict[int, np.ndarray] = {}
            for x, c in enumerate(counts):
                total, kinds = Counter(), Counter()
                for key, n in c[k].items():
                    total[key >> 8] += n
                    kinds[key >> 8] += 1
                for ctx, t in total.items():
                    ends.setdefault(ctx, np.zeros(len(self.langs)))[x] = -np.log2(kinds[ctx] / (t + kinds[ctx]))
                low = (1 << 8 * k) - 1
                for row, key in enumerate(seen):
                    if n := c[k].get(key):
                        cost[row, x] = -np.log2(n / (total[key >> 8] + kinds[key >> 8]))
                    else:
                        t, d = total.get(key >> 8, 0), kinds.get(key >> 8, 0)
                        below = lower[key & low][x] if k else 8.0
                        cost[row, x] = below + (-np.log2(d / (t + d)) if t else 0.0)
            lower = dict(zip(seen, cost, strict=True))
            self.grams.append(Table(np.array(seen, dtype=np.uint64), cost.astype(np.float32)))
            own = sorted(ends)
            self.escapes.append(Table(np.array(own, dtype=np.uint64), np.array([ends[c] for c in own], dtype=np.float32).reshape(-1, len(self.langs))))

    @staticmethod
    def keys(data: np.ndarray, k: int) -> np.ndarray:
        """For every byte, it and the k bytes before it as one number (bytes before the start are 0)."""
        out = np.zeros(len(data), dtype=np.uint64)
        for j in range(k, -1, -1):
            out <<= _U64(8)
            out[j:] |= data[: len(data) - j]
        return out

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte of data in every language."""
        out = np.zeros((len(data), len(self.langs)), dtype=np.float32)
        todo, keys = np.arange(len(data)), self.keys(data, self.order)
        for k in range(self.order, -1, -1):
            keys = keys & _U64((1 << 8 * (k + 1)) - 1)
            row = self.grams[k].find(keys)
            hit = row >= 0
            out[todo[hit]] += self.grams[k].values[row[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            row = self.escapes[k].find(keys >> _U64(8))
            known = row >= 0
            out[todo[known]] += self.escapes[k].values[row[known]]
        out[todo] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each prepared text in each language; many texts, or parts of one, at a time."""
        total, pad = np.zeros((len(texts), len(self.langs))), b"\n" * self.order
        pieces: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pieces:
                data = np.frombuffer(b"".join(x for _, x in pieces), dtype=np.uint8)
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.bits(data), axis=0, dtype=np.float64)])
                ends = np.cumsum([len(x) for _, x in pieces])
                starts = ends - [len(x) for _, x in pieces] + self.order
                np.add.at(total, [i for i, _ in pieces], sums[ends] - sums[starts])
            pieces.clear()
            size = 0

        for i, x in enumerate(texts):
            for at in range(0, len(x), _SLICE):
                head = pad if not at else x[at - self.order : at]
                pieces.append((i, head + x[at : at + _SLICE]))
                size += len(pieces[-1][1])
                if size >= _SLICE:
                    flush()
        flush()
        return total


def prepare(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, order: int = ORDER) -> Model:
    """Fit on at most `rows` labelled texts of each language, of at most TRAIN_BYTES bytes, none held out.

    Null and empty texts, and rows without a language, teach nothing; copies of a text count once. An
    empty table gives a model that knows no language.
    """
    size = F.octet_length(text_col)
    pool = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & size.between(1, TRAIN_BYTES))
    pool = pool.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col, F.lit(3)).alias("h"), F.col(text_col).alias("text"))
    known = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "lang").limit(LANGUAGES).collect()
    if not known:
        return Model({}, order)
    rows = max(1, min(rows, TRAIN_ALL // len(known)))
    named = pool.where(F.col("lang").isin([r["lang"] for r in known]))
    # The few texts themselves are read in a second, filtered scan.
    least = named.groupBy("lang", F.pmod("h", F.lit(2 * rows)).alias("k")).agg(F.min("h").alias("h")).collect()
    chosen: dict[str, list[int]] = {}
    for r in sorted(least, key=lambda r: (r["lang"], r["h"])):
        if len(own := chosen.setdefault(r["lang"], [])) < rows:
            own.append(r["h"])
    few = named.where(F.col("h").isin(sorted({h for own in chosen.values() for h in own}))).groupBy("lang", "h").agg(F.first("text").alias("text")).collect()
    few = [r for r in few if r["h"] in chosen[r["lang"]]]
    texts: dict[str, list[str]] = {}
    for r in sorted(few, key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts, order)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and a score from 0 to 1.

    A text that is null or has no letter is `und` with score 0, as is every text if the model
    has learned no language. The score is the share of 2**-bits of the best language, so 1 where
    no other language comes near; at a tie the first language in code point order wins. Every
    byte of every text counts, however long. Columns that are already named like the two new ones
    are replaced; all others pass through.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (lang, score)]
    base = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if x and _LETTER.search(x) else "" for x in b.column(at).to_pylist()] if model.langs else [""] * b.num_rows
            bits = model.lengths([prepare(x) for x in texts])
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model.langs and len(texts):
                best = bits.argmin(axis=1)
                share = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
                scores = np.where([bool(x) for x in texts], 1.0 / share.sum(axis=1), 0.0)
                names = [model.langs[i] if x else UNKNOWN for i, x in zip(best, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(scores)], names=[*rest, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*base.schema.fields]).add(lang, StringType()).add(score, DoubleType())
    return base.mapInArrow(run, schema)


def predictions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one per row of docs, by a model fitted on docs.

    Null ids are not held out; repeated rows each give a row, all alike. Null texts and texts
    without a letter are `und`. Columns of docs other than the three named are not looked at, and an
    empty table gives an empty result.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return identify(rows, model, text_col=text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of `least` or more, with the columns of docs.

    Null texts, empty ones and those without a letter go; a null lang, a null id and repeated rows
    make no difference. Columns of any name pass through, and an empty table gives an empty result.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    lang, score = (f"{x}{'_' * max(map(len, docs.columns))}" for x in ("lang", "score"))  # longer than any column of docs
    named = identify(docs, model, text_col=text_col, lang=lang, score=score)
    return named.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
