"""Byte-pair encoding and decoding of whole texts with a published vocabulary.

Merging takes the leftmost pair of least merge rank, again and again. A short piece keeps the ranks of its pairs in a list. A longer
one keeps its symbols in a doubly linked list and the mergeable pairs in a priority queue ordered by (merge rank, position); a queue
entry whose symbols have changed since is stale and skipped. Decoding concatenates the vocabulary strings.

Every task reads the vocabulary file once. A text is cut at white space, where no token can span, and a task remembers what
it has encoded: few whole chunks, and more of the pieces that chunks consist of, each as the bytes that are joined and
digested. Forgetting that bounded memory costs time, never results.

Defined results: a null text counts as empty and has no tokens; special tokens written out in a text
are encoded as special tokens; repeated rows are encoded each; columns of the input other than the key
columns and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.shared import ship

#: str.split() also cuts at these four, which are no white space to the vocabulary's normalizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile(r"[^\S\x1c-\x1f]+")
#: Bits that hold an id.
SHIFT = 20
MASK = (1 << SHIFT) - 1
#: Chunks that a worker remembers, pieces in each of its two generations, and characters of the longest of them: about 70 MB.
CHUNKS = 40_000
PIECES = 100_000
LONGEST = 48
#: Bytes of a piece up to which its pairs are searched as a list.
SHORT = 64
#: Above every rank: a pair that is not merged.
NONE = 1 << 62


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordPairEncoder:
    """Encoder for a vocabulary file of kind BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {
            self.ids[a] << SHIFT | self.ids[b]: rank << SHIFT | self.ids[a + b] for rank, (a, b) in enumerate(pairs)
        }
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")")
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece without white space."""
        text = [self.letters[b] for b in piece.encode("utf-8")]
        text[-1] += self.end
        symbols = [self.ids[x] for x in text]
        n, rank_of = len(symbols), self.merges.get
        if n <= SHORT:
            return self._merge_short(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []  # rank and merged symbol, then position, in one integer
        for i in range(n - 1):
            if (found := rank_of(symbols[i] << SHIFT | symbols[i + 1])) is not None:
                queue.append(found * n + i)
        heapq.heapify(queue)
        while queue:
            found, left = divmod(heapq.heappop(queue), n)
            right = after[left]
            if right >= n or symbols[left] < 0 or rank_of(symbols[left] << SHIFT | symbols[right]) != found:
                continue  # stale: one of the two was merged meanwhile
            symbols[left], symbols[right] = found & MASK, -1
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (found := rank_of(symbols[left] << SHIFT | symbols[right])) is not None:
                    heapq.heappush(queue, found * n + left)
            if (first := before[left]) >= 0:
                if (found := rank_of(symbols[first] << SHIFT | symbols[left])) is not None:
                    heapq.heappush(queue, found * n + first)
        return [s for s in symbols if s >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        rank_of = self.merges.get
        ranks = [rank_of(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (found := min(ranks)) != NONE:
            i = ranks.index(found)
            symbols[i] = found & MASK
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(symbols[i] << SHIFT | symbols[i + 1], NONE)
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << SHIFT | symbols[i], NONE)
        return symbols

    def piece(self, piece: str) -> tuple[bytes, bytes]:
        """Ids and vocabulary strings of a piece, each joined by one space."""
        if (found := self.known.get(piece)) is None:
            if (found := self.older.get(piece)) is None:
                found = self._joined(self.merge(piece))
            if len(piece) <= LONGEST:
                if len(self.known) >= PIECES:
                    self.older, self.known = self.known, {}
                self.known[piece] = found
        return found

    def _joined(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and vocabulary strings of what stands between white space."""
        if "<" in chunk:
            parts = []
            for i, part in enumerate(self.marks.split(chunk)):
                parts += [self._joined([self.special[part]])] if i % 2 else self.plain(part)
        else:
            parts = self.plain(chunk)
        if len(parts) == 1:
            return parts[0]
        return b" ".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def plain(self, text: str) -> list[tuple[bytes, bytes]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        lower = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if lower.isalpha():
            return [self.piece(lower)]
        return [self.piece(p) for p in self.pieces(lower)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in order, one space between two, as the file names no decoder."""
        return " ".join(self.strings[i] for i in ids)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids and vocabulary strings of a whole text, each joined by one space."""
        ids, decoded = [], []
        for chunk in WHITE.split(text) if SEPARATORS.search(text) else text.split():
            if (found := self.chunks.get(chunk)) is None:
                found = self.chunk(chunk)
                if len(chunk) <= LONGEST:
                    if len(self.chunks) >= CHUNKS:
                        self.chunks.clear()
                    self.chunks[chunk] = found
            if found[0]:
                ids.append(found[0])
                decoded.append(found[1])
        return b" ".join(ids), b" ".join(decoded)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordPairEncoder:
    return WordPairEncoder(path)


def encode_decode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """Encode each text and decode it again.

    Returns key, n_tokens, ids_sha256, decoded_sha256 and, if `full`, ids (array) and decoded (text).
    `vocabulary` must be readable under the same path on every executor.
    """
    fields = [df.schema[key], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column("_text"):
                ids, decoded = encoder.encode(text.as_py())
                n = ids.count(b" ") + 1 if ids else 0
                row = [n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                rows.append(row + [[int(i) for i in ids.split()], decoded.decode()] if full else row)
            columns = [[r[i] for r in rows] for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    given = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInArrow(run, T.StructType(fields))
