"""Byte-level BPE by prefix dynamic programming, and its use on whole texts.

For every prefix of a piece of bytes there is exactly one token that can end its
encoding: the vocabulary's token whose pairing with the last token of the prefix
before it is one that merging would leave apart. ``Piece`` stores that token per
prefix. Bytes can then be appended, or replaced in the middle, without touching
the prefixes before them, and the encoding is read off backwards.

``TextEncoder`` applies it to whole texts: a text is cut into chunks (white space,
or a word with the space before it) which the splitting pattern never crosses,
and the ids of frequent chunks are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters with Unicode's White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

# A word with the space before it, or white space up to the last one before a word.
CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")

# Bounds of the tables that a Python worker keeps.
CHUNKS_KEPT = 1_000_000
PIECES_KEPT = 300_000
PAIRS_KEPT = 1_000_000


class Vocabulary:
    """Tokens by id, ids by bytes, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = {number: token for token, number in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        # Finds all tokens in a text of bytes, by their ends, longest first.
        self.finder = ahocorasick.Automaton()
        for token, number in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), number))
        self.finder.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of lines ``base64 rank``."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def may_meet(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stay_apart(self.tokens[left], self.tokens[right])
        return known

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        """Merge the lowest-ranked pair again and again; false once a merge crosses the border."""
        ids, data, border = self.ids, left + right, len(left)
        edges = list(range(len(data) + 1))
        while True:
            ranked = [ids.get(data[edges[i] : edges[i + 2]], len(ids)) for i in range(len(edges) - 2)]
            lowest = min(ranked, default=len(ids))
            if lowest == len(ids):
                return edges == [0, border, len(data)]
            merged = edges.pop(ranked.index(lowest) + 1)
            if merged == border:
                return False


class Piece:
    """Bytes between two cuts of the splitting pattern, with the last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> Piece:
        """Bytes at the end; earlier prefixes keep their tokens."""
        return self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, end: int, new: bytes) -> Piece:
        """Other bytes in place of [start, end); prefixes up to ``start`` keep their tokens."""
        self.data = self.data[:start] + new + self.data[end:]
        last, vocabulary = self.last, self.vocabulary
        del last[start:]
        pairs, may_meet, done = vocabulary.pairs, vocabulary.may_meet, start
        seen = max(0, start - vocabulary.longest)  # no token that ends later begins before
        for stop, (size, token) in vocabulary.finder.iter(self.data[seen:].decode("latin-1")):
            if stop + seen != done:  # a prefix that is kept, or whose token is found
                continue
            if size <= done:
                pair = last[done - size], token
                if not (pairs[pair] if pair in pairs else may_meet(*pair)):
                    continue
            last.append(token)
            done += 1
        return self

    def ids(self) -> list[int]:
        found, stop = [], len(self.data)
        while stop:
            token = self.last[stop - 1]
            found.append(token)
            stop -= len(self.vocabulary.tokens[token])
        return found[::-1]


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    ``encode`` gives the ids of each of some chunks; a chunk is encoded by itself,
    so the result is that of the whole text.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.words: dict[str, bytes] = {}  # by the word, without the one space before it
        self.others: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        if "  " in text or " \n" in text or "\n " in text or RARE_SPACE.search(text):
            chunks = CHUNK.findall(text)
            return b"".join(self._found(self.others, chunks, chunks, CHUNKS_KEPT // 10))
        # Only single spaces between words: each starts a chunk. Line breaks may
        # stand inside a chunk, where they have a word on either side.
        first, *words = text.split(" ")
        start = self._found(self.others, [first], [first], CHUNKS_KEPT // 10) if first else []
        return b"".join(start + self._found(self.words, words, None, CHUNKS_KEPT))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def _found(self, known: dict[str, bytes], keys: list[str], chunks: list[str] | None, most: int) -> list[bytes]:
        """Packed ids by key; those not known yet are encoded (a space and the key, or the chunk) and kept while there is room."""
        found = list(map(known.get, keys))
        if None in found:
            new = dict.fromkeys([key for key, ids in zip(keys, found) if ids is None])
            ids = self.encode([" " + key for key in new] if chunks is None else list(new))
            new = {key: np.array(one, "<u4").tobytes() for key, one in zip(new, ids)}
            if len(known) < most:
                known.update(new)
            found = [new[key] if ids is None else ids for key, ids in zip(keys, found)]
        return found


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, as its authors' library reads it."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(spelled.replace(r"\s", f"[{WHITE_SPACE}]"))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


@cache
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One per Python worker."""
    known, split = vocabulary(path), splitter(pattern)
    pieces: dict[str, list[int]] = {}

    def piece(part: str) -> list[int]:
        found = pieces.get(part)
        if found is None:
            found = Piece(known, part.encode()).ids()
            if len(pieces) < PIECES_KEPT:
                pieces[part] = found
        return found

    return TextEncoder(lambda chunks: [list(chain.from_iterable(map(piece, split.findall(chunk)))) for chunk in chunks])


def encoded(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and ``ids`` (array of int).

    A NULL or empty text has no ids. Keys are passed on as they are: NULL and
    repeated ones keep their rows. Other columns are not read. An empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a small part at a time bounds the ids held
                part = batch.slice(at, 256)
                ids = [encoder.ids(body).astype(np.int32) for body in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["k", "ids"]
                )

    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ids: ``key`` and ``bytes``, which need not be whole characters.

    NULL ids decode to no bytes; an unknown id raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path).tokens
        for batch in batches:
            data = [b"".join(map(of.__getitem__, row or ())) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["k", "bytes"])

    rows = tokens.select(F.col(key).alias("k"), F.col(ids))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, bytes binary").withColumnRenamed("k", key)


def round_trip(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving the ids.

    Columns ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; cases as in
    ``encoded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, of = text_encoder(path, pattern), vocabulary(path).tokens
        written = {number: str(number) for number in of}
        for batch in batches:
            counts, digests, decodings = [], [], []
            for body in batch.column(1).to_pylist():
                ids = encoder.ids(body).tolist()
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                decodings.append(hashlib.sha256(b"".join(map(of.__getitem__, ids))).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decodings, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("k", key)
