"""Byte-pair encoding as a streaming transducer, and its inverse.

Within one pre-token the encoding of every prefix ends in exactly one token, and a sequence of
tokens is the encoding of its bytes if and only if each neighbouring pair is (for merge lists whose
rules only join symbols made by earlier rules; others are refused). So one pass over the bytes
keeps, for each prefix, its last token. How many bytes after a boundary can bear on it follows from
the merge list; a boundary that far behind the last byte read is stable, and the tokens before it
are emitted and forgotten. So a pre-token of any length takes constant memory. Texts are cut at
white space into slices of bounded size, decoding is a state machine that is fed some ids at a time.

Unicode tables differ between libraries. Where the two that are at hand disagree on a character,
the tokenizers library is asked, once, how it reads it (see Tables); it encodes nothing here.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from rangeweave.llm.common import tune

_NEVER = 1 << 60
#: Entries of the memo of pre-tokens and of pairs in one Python worker (some 150 MB); beyond, the memo starts anew.
MEMO = 200_000
#: Code points looked at together when the tables of characters are made.
SPAN = 1 << 13


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """Symbols, merge rules and the prefix trie of a vocabulary.

    symbols 0..255 are bytes, 256..511 bytes that end a pre-token (where the vocabulary marks
    them), and 512 + r is what rule r makes. ids[symbol] is the id in the vocabulary.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        letters = byte_letters()
        symbol = {c: b for b, c in enumerate(letters)} | ({c + suffix: 256 + b for b, c in enumerate(letters)} if suffix else {})
        self.suffix, self.pair, self.split = bool(suffix), {}, [(-1, -1)] * 512
        self.text = [bytes([b]) for b in range(256)] * 2
        self.ids = [vocab.get(c + end, -1) for end in ("", suffix) for c in letters]
        for rank, rule in enumerate(merges):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            if left not in symbol or right not in symbol or left + right in symbol:
                raise ValueError(f"rule {rank} joins a symbol that no earlier rule makes, or makes one twice")
            a, b = symbol[left], symbol[right]
            symbol[left + right] = 512 + rank
            self.pair[a, b] = rank
            self.split.append((a, b))
            self.text.append(self.text[a] + self.text[b])
            self.ids.append(vocab[left + right])
        self.names = {i: t for t, i in vocab.items()}
        # The trie of all symbols' bytes: node -> {byte: node}; a symbol that ends a pre-token
        # ends in its own kind of leaf.
        self.next: list[dict[int, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        ends = {256 + b for b in range(256)} if suffix else set()
        self._joins: dict[int, bool] = {}
        # A symbol whose bytes are taken apart by earlier rules is never made, and left out.
        made = [True] * 512
        for s, raw in enumerate(self.text):
            if s >= 512:
                a, b = self.split[s]
                made.append(made[a] and made[b] and self._kept(a, b, s - 512))
                if b in ends:
                    ends.add(s)
            if 256 <= s < 512 and not suffix or not made[s]:
                continue
            node = 0
            for byte in raw:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.next[node][byte]
            (self.final if s in ends else self.inner)[node] = s
        self.lengths = list(map(len, self.text))
        self.longest = max(self.lengths)

    @cached_property
    def far(self) -> int:
        return max(self.lookahead(), self.longest)

    def lookahead(self) -> int:
        """Bytes after a boundary that can bear on it: the most a chain of ever earlier rules spans.

        Rule r joins u and v unless v's end is taken first by an earlier rule (x, y), x a suffix of
        v; that one may be kept from it by a still earlier one, and so on.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in self.split[512:]:
            right = self.text[b]
            far = max(len(right) + reach.get(right[k:], 0) for k in range(len(right)))
            left = self.text[a]
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, side by side, encode as just these two symbols.

        Undoes the merges on the inner edges of both, latest first; no rule for the two symbols
        that then touch may come before the merges that took them away. Equal ranks go left first.
        """
        key = a << 32 | b
        if (known := self._joins.get(key)) is not None:
            return known
        ok = self._kept(a, b, _NEVER)
        if len(self._joins) >= MEMO:
            self._joins.clear()
        self._joins[key] = ok
        return ok

    def _kept(self, a: int, b: int, limit: int) -> bool:
        """Whether no rule before rule `limit` reaches over the boundary of a and b."""
        x, y, px, py = a, b, limit, limit
        pair, split = self.pair, self.split
        while True:
            rank = pair.get((x, y))
            if rank is not None and rank < px and rank <= py and rank < limit:
                return False
            if x >= 512 and x > y:
                px, x = x - 512, split[x][1]
            elif y >= 512:
                py, y = y - 512, split[y][0]
            else:
                return True

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Symbols of one pre-token that comes in pieces, each as soon as it is stable.

        last[i]: last symbol of the first i bytes held; last[0]: the one before them. Symbols that
        start in the newest bytes wait for more, as a longer one may start there too.
        """
        data, last, done = bytearray(), [-1], 0
        source, piece = iter(pieces), None
        while True:
            ahead = next(source, None)
            if piece is None and ahead is not None:
                piece = ahead
                continue
            end = ahead is None
            data += piece or b""
            last += [-1] * (len(data) + 1 - len(last))
            if end:
                self._advance(data, last, done, len(data), True)
                yield from self._back(last, len(data))
                return
            stop = max(done, len(data) - self.longest)
            self._advance(data, last, done, stop, False)
            done, piece = stop, ahead
            if done > 2 * self.far:
                cut = done
                while cut > done - self.far:  # a boundary this far behind is stable, and so are those before it
                    cut -= self.lengths[last[cut]]
                yield from self._back(last, cut)
                del data[:cut], last[:cut]
                done -= cut

    def _advance(self, data: bytes | bytearray, last: list[int], low: int, high: int, end: bool) -> None:
        """Find the symbols that start at low to high. end: the data end the pre-token."""
        nexts, inner, apart, n = self.next, self.inner, self.apart, len(data)
        for start in range(low, high):
            before, node, at = last[start], 0, start
            while at < n:
                node = nexts[node].get(data[at], -1)
                if node < 0:
                    break
                at += 1
                s = self.final[node] if end and at == n and self.suffix else inner[node]
                if s >= 0 and last[at] < 0 and (before < 0 or apart(before, s)):
                    last[at] = s

    def _back(self, last: list[int], n: int) -> list[int]:
        """The symbols of the first n bytes."""
        out = []
        while n:
            out.append(last[n])
            n -= self.lengths[last[n]]
        return out[::-1]

    def encode(self, raw: bytes) -> list[int]:
        """Symbols of one whole pre-token. One that comes in a single piece needs no buffer."""
        if len(raw) > PIECE:
            return list(self.stream([raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]))
        last = [-1] * (len(raw) + 1)
        self._advance(raw, last, 0, len(raw), True)
        return self._back(last, len(raw))


class Tables:
    """How the tokenizers library reads characters, as far as Python's two tables do not agree on them.

    letters, numbers: what goes into a character class besides \\p{L} and \\p{N}, and what is taken
    out; lower: lower-case forms that str.lower does not know; odd: characters that the library puts
    in another canonical order or composes differently.
    """

    def __init__(self):
        self.rare: set[str] = set()
        self.lower: dict[int, str] = {}
        lower, self.nfc = normalizers.Lowercase(), normalizers.NFC()
        splits = {kind: pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True) for kind in "LN"}
        more, less = ({kind: [] for kind in splits} for _ in range(2))
        for low in range(0, 0x110000, SPAN):  # a worker never holds all characters
            every = "".join([chr(c) for c in range(low, low + SPAN) if not 0xD800 <= c < 0xE000])
            kinds = [(x, unicodedata.category(x)) for x in every]
            for kind, split in splits.items():
                own = set(regex.findall(rf"\p{{{kind}}}", every))
                for x in sorted(own ^ {x for x, k in kinds if k[0] == kind}):
                    known = bool(split.pre_tokenize_str(x))
                    if known != (x in own):
                        (more if known else less)[kind].append(x)
                        self.rare.add(x)
            new = {x for x, k in kinds if k == "Cn"}.difference(regex.findall(r"\p{Cn}", every))
            self.lower |= {ord(x): y for x in new if (y := lower.normalize_str(x)) != x.lower()}
            self.rare |= self._odd(kinds)
        self.rare |= set(map(chr, self.lower))
        self.letters, self.numbers = (self._class(kind, more[kind], less[kind]) for kind in splits)

    def _odd(self, kinds: list[tuple[str, str]]) -> set[str]:
        """Those of some characters (and what they are made of) that the library orders or composes differently."""
        odd, nfc = set(), self.nfc
        for x, k in kinds:
            if k[0] == "M" and unicodedata.combining(x):
                # Marks of the lowest and highest classes before and after show where x is put.
                for text in ("a\u0345" + x, "a\u0301" + x, "a" + x + "\u0334", "a\u0334" + x, "a" + x + "\u0301", "a" + x + "\u0345"):
                    if nfc.normalize_str(text) != unicodedata.normalize("NFC", text):
                        odd.add(x)
            parts = unicodedata.decomposition(x)
            if parts and parts[0] != "<":
                text = unicodedata.normalize("NFD", x)
                if nfc.normalize_str(text) != unicodedata.normalize("NFC", text):
                    odd |= {x, *text}
        return odd

    def _class(self, kind: str, more: list[str], less: list[str]) -> str:
        """A set expression for what the library takes to be of this kind, without its brackets."""
        span = lambda xs: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(xs))
        return f"[\\p{{{kind}}}{span(more)}]" + (f"--[{span(less)}]" if less else "")

    def has_rare(self, text: str) -> bool:
        """Whether the text holds a character that Python's tables are not sure to have right."""
        return not self.rare.isdisjoint(text.encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass"))

    def normalized(self, text: str, rare: bool) -> str:
        """NFC and lower case, as the library does them."""
        if rare:
            text = self.nfc.normalize_str(text).translate(self.lower)
        else:
            text = unicodedata.normalize("NFC", text)
        return text.replace("\u03a3", "\u03c3").lower()  # final sigma is not told apart


def _runs(xs: list[str]) -> list[tuple[int, int]]:
    """Runs of neighbouring code points of sorted characters."""
    out: list[tuple[int, int]] = []
    for c in map(ord, xs):
        if out and out[-1][1] == c - 1:
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return out


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


#: Pre-token patterns by the tokenizer's kind, L and N for the sets of letters and numbers; white space is the Unicode property in both.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^\p{White_Space}[L][N]]+"
_BYTE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^\p{White_Space}[L][N]]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of a pre-token read at a time, characters of a text.
PIECE, SLICE = 2048, 1 << 16
_ASCII = bytes(range(128))
_WORD_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_SPACE = regex.compile(r"(?<!\p{White_Space})\p{White_Space}")


def pattern(text: str, exact: bool) -> regex.Pattern:
    """The pattern with the library's sets of letters and numbers, or with those of the regex module for texts without rare characters."""
    letters, numbers = (tables().letters, tables().numbers) if exact else (r"[\p{L}]", r"[\p{N}]")
    return regex.compile(text.replace("[L]", f"[{letters}]").replace("[N]", f"[{numbers}]"), regex.V1)


class Codec:
    """Encoder and decoder of one vocabulary file.

    Two kinds are known: words (NFC, lower case, white space dropped, marked word ends; decoding
    joins the tokens' names by spaces) and byte level (every byte kept; decoding gives the text).
    """

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("only BPE vocabularies are supported")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.words = self.merges.suffix
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.merges.names | {i: t for t, i in self.specials.items()}
        self.numbers = {i: str(i) for i in self.names}
        kind = _WORD if self.words else _BYTE
        self._pattern, self._exact = pattern(kind, False), pattern(kind, True)
        self._ascii = _WORD_ASCII if self.words else self._pattern
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._memo: dict[str, tuple[int, ...]] = {}
        self._raw = {i: t.encode() for t, i in self.specials.items()} | {i: self.merges.text[s] for s, i in enumerate(self.merges.ids) if i >= 0}

    def _piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        out = tuple([self.merges.ids[s] for s in self.merges.encode(raw)])
        if len(raw) <= 64:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[token] = out
        return out

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens, a slice at a time. Slices begin with white space, which no
        pre-token, composition or case form reaches over."""
        low, memo, piece = 0, self._memo, self._piece
        while low < len(text):
            cut = _SPACE.search(text, low + SLICE) if low + SLICE < len(text) else None
            part = text[low : cut.start()] if cut else text[low:]
            low += len(part)
            find = self._ascii
            if not part.isascii():
                rare = tables().has_rare(part)
                find = self._exact if rare else self._pattern
                part = tables().normalized(part, rare) if self.words else part
            elif self.words:
                part = part.lower()
            yield list(chain.from_iterable([memo.get(t) or piece(t) for t in find.findall(part)]))

    def parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, a slice at a time, special tokens found in it included, none added."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield from self._plain(text[at : m.start()])
            yield [self.specials[m[0]]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens kept."""
        state = self.decoder()
        return state.feed(ids) + state.end()

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """A state machine from ids to text: it holds whether a word came before, or an unfinished character."""

    def __init__(self, codec: Codec):
        self.names, self.raw, self.first = codec.names if codec.words else None, codec._raw, True
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """The text that these further ids add."""
        if self.names is None:
            return self.bytes.decode(b"".join([self.raw[i] for i in ids]))
        lead = "" if self.first or not ids else " "
        self.first = self.first and not ids
        return lead + " ".join([self.names[i] for i in ids])

    def end(self) -> str:
        return self.bytes.decode(b"", True) if self.names is None else ""


@lru_cache(maxsize=2)
def _codec(source: bytes) -> Codec:
    return Codec(source)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    vocabulary: path of the vocabulary file on the driver; its bytes (a file of fixed size) are
    broadcast. ids_sha256 is over the decimal ids joined by single spaces, decoded_sha256 over the
    decoded text in UTF-8. Null texts are encoded as the empty text, which has no tokens. Rows are
    independent: repeated rows, null ids and other columns need no care, and an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    source = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        numbers = codec.numbers
        for b in batches:
            counts, first, second, lists = [], [], [], []
            for text in b.column(1).to_pylist():
                n, own, one, two, state = 0, [], hashlib.sha256(), hashlib.sha256(), codec.decoder()
                for ids in codec.parts(text or ""):
                    if ids:
                        one.update(((" " if n else "") + " ".join([numbers[i] for i in ids])).encode())
                        two.update(state.feed(ids).encode())
                        n += len(ids)
                    if with_ids:
                        own += ids
                two.update(state.end().encode())
                counts.append(n)
                first.append(one.hexdigest())
                second.append(two.hexdigest())
                if with_ids:
                    lists.append(own)
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names=["i", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string")).mapInArrow(run, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("i", id_col)
