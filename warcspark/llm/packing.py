"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into
whole sequences and a rest. Pieces go to the tightest open sequence that still holds them,
longest first. The open sequences are kept by remaining capacity in a segment tree over the
capacities 0..length: a node knows whether any capacity below it is in use, so the smallest
one that fits is found in a number of steps logarithmic in the length.

Scale: texts are tokenized where they are read; only lengths are shuffled. Pieces are dealt by
hash of what they are and of their place among the staged rows, so equal rows spread as well, to
shards of `shard_pieces` at most (but for a chance below 1e-20 each, as they are filled to nine
tenths); a shard leaves about half a sequence unfilled, which is below one in ten thousand.

Defined cases: null or empty texts are the end id alone; documents of equal length are packed
by id; rows that repeat an id are packed one by one; empty tables give an empty result; other
columns don't matter. A null id is packed as any other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_cache, sliced, staged

LENGTH, END_ID, SHARD_PIECES = 2048, 0, 16384
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, whose ids a worker remembers; beyond that it forgets them all and begins anew.
CACHE_WORDS, CACHE_PARTS = 200_000, 350_000
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: str.split() takes these for white space, the tokenizer doesn't; on all else they agree.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Byte-level pieces write each byte as a character: printable ones of Latin-1 stay, the rest count up from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: The vocabulary's own split pattern, for the letters of ASCII and Latin-1 in lower case, which
#: no normalization changes.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]{1,64}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """The ids of a run of non-white characters, as little-endian unsigned 32-bit numbers.

    White space separates tokens in this vocabulary and is dropped, so a text's ids are its
    words' ids one after the other, and a plain word's those of its parts. Words with other
    letters or white space, or with `<`, which may begin a special token, and very long ones
    go to the tokenizer whole; the parts of plain words need no more than its merges.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model
        self._parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            if len(self._parts) >= CACHE_PARTS:
                self._parts.clear()
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = self._parts[part] = to_bytes("<%dI" % len(found := self._merges.tokenize(letters)), *[x.id for x in found])
        return ids

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        ids = b"".join(map(self._part, _PARTS.findall(word.lower()))) if plain else self._encode(word)
        if plain:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        odd = any(c in text for c in _SEPARATORS)
        return b"".join(map(self.__getitem__, _SPACE.split(text) if odd else text.split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, which keeps it from task to task."""
    return WordIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document, with the crc32 of its ids; ids themselves: see piece_ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("packing", word_ids.cache_clear)
        words, end = word_ids(path), np.asarray([end_id], dtype="<u4").tobytes()
        for b in sliced(batches):
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (words.of(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for col, v in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class OpenBins:
    """Open sequences by remaining capacity; a segment tree finds the smallest capacity that is enough."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.used = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        at = capacity + self.size
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, number) of the tightest sequence that holds `least`."""
        at = least + self.size
        if not self.used[at]:
            while at > 1 and not (at % 2 == 0 and self.used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.used[2 * at] else 2 * at + 1
        capacity = at - self.size
        number = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.used[at] = 0
            while at > 1 and not self.used[at ^ 1]:
                at >>= 1
                self.used[at] = 0
        return capacity, number


def best_fit_decreasing(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each piece, given longest first, and how many sequences there are."""
    bins, n = OpenBins(length), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        found = bins.take(size) if size < length else None
        if found is None:
            found, n = (length, n), n + 1
        capacity, k = found
        number[i], offset[i] = k, length - capacity
        if capacity > size:
            bins.add(capacity - size, k)
    return number, offset, n


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset."""
    cut = staged(pieces(docs, path=path, length=length, end_id=end_id), "pack-pieces")
    shards = max(1, -(-10 * cut.count() // (9 * shard_pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task may get several shards; they come one after the other."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            number, offset, n = best_fit_decreasing(t.column("length").to_numpy(), length)
            if n >= 1 << 31:
                raise ValueError("a shard has too many sequences for its numbers")
            ids = number + (int(t.column("shard")[0].as_py()) << 31)
            t = t.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))
            return t.combine_chunks().to_batches()[0]

        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and held[-1].column(0)[0].as_py() != shard[lo]:
                        yield done()
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    # a staged file's name begins with the number of its task
    place = (F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1), F.col("_metadata.row_index"))
    dealt = cut.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *place), F.lit(shards)).alias("shard"), "*")
    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard", F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    return sorted_.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
