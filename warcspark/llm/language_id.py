"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree up to ORDER bytes deep, learned once and
then frozen. A byte costs -log2 n/(t+d) bits in the longest context that has seen it, after
d/(t+d) for each escape from a longer one (t: how often the context came, d: how many different
bytes followed it); a byte that no context has seen costs 8 bits more. The language with the
shortest code for the text wins; the score is its posterior share under equal priors.

Trees are held as tables of packed byte strings. A row has the whole cost of its last byte for
every language, so a text is scored by one look-up for each byte and a few for unknown ones.

The trees are fitted on a bounded sample: at most FIT_ROWS whole texts of each language, by
the smallest hash of the id, and as many of them as fit into the language's equal share of
FIT_CHARS letters (longer ones are passed over). Both bounds hold before anything reaches the
driver; the model's size follows them. All texts are then scored whole where they are read,
without a shuffle, long ones in pieces of CHUNK bytes that hand their last context on, so memory
follows the text's length and CHUNK times the number of languages, not their product.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the
language first in code-point order; without any labelled text everything is `und`; repeated
rows are scored one by one; texts of any length are scored as a whole, in pieces; empty tables give empty
results; other columns, of any type, don't matter: those to keep give way to outputs of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_cache, crc_mod, hash_unit, kept_beside, mapped, release, sliced

ORDER, FIT_ROWS, FIT_CHARS, SEED = 4, 300, 64_000_000, 5
#: Languages that a model holds at most; all labels beyond are an error, not a silent drop.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
#: Bytes that are scored at once.
CHUNK = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters stay, other ASCII becomes a blank, bytes of longer characters stay.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TABLE)


def has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts after `order` zero bytes each, runs of blanks made one; begin and end of each."""
    pad = b"\0" * order
    a = np.frombuffer(pad + pad.join(texts) if texts else b"", np.uint8)
    if not texts:
        return a, np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    end = np.cumsum(n + order)
    keep = np.ones(len(a), bool)
    blank = a == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.concatenate([[0], np.cumsum(keep)])
    return a[keep], place[end - n], place[end]


def packed(a: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes up to each place from `order` on, as one number."""
    keys = a[order:].astype(np.uint64)
    for k in range(1, order + 1):
        keys |= a[order - k : len(a) - k].astype(np.uint64) << np.uint64(8 * k)
    return keys


@dataclass
class Rows:
    """Sorted keys and a row of numbers for each; found through a hash table made on first use."""

    keys: np.ndarray
    values: np.ndarray
    _slots: tuple[np.ndarray, np.ndarray, np.uint64] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "_slots": None}

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        if self._slots is None:
            bits = max(4, int(4 * len(self.keys)).bit_length())
            shift = np.uint64(64 - bits)
            at_key, at_row = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32)
            left, where = np.arange(len(self.keys)), ((self.keys * _SPREAD) >> shift).astype(np.int64)
            while len(left):
                free = at_key[where] == _EMPTY
                _, first = np.unique(where[free], return_index=True)
                put = np.flatnonzero(free)[first]
                at_key[where[put]], at_row[where[put]] = self.keys[left[put]], left[put]
                rest = np.ones(len(left), bool)
                rest[put] = False
                left, where = left[rest], (where[rest] + 1) & ((1 << bits) - 1)
            self._slots = at_key, at_row, shift
        return self._slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at_key, at_row, shift = self._table()
        where = ((keys * _SPREAD) >> shift).astype(np.int64)
        got = at_key[where]
        out = np.where(got == keys, at_row[where], -1)
        open_ = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(open_):
            where_open = (where[open_] + 1) & (len(at_key) - 1)
            where[open_] = where_open
            got = at_key[where_open]
            hit = got == keys[open_]
            out[open_[hit]] = at_row[where_open[hit]]
            open_ = open_[~hit & (got != _EMPTY)]
        return out


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[Rows]
    contexts: list[Rows]

    def forget(self) -> None:
        """Lets the hash tables go; they come again when used."""
        for rows in self.grams + self.contexts:
            rows._slots = None

    def costs(self, keys: np.ndarray, k: int | None = None) -> np.ndarray:
        """Bits of the last byte of each key, for each language; keys hold k + 1 bytes."""
        k = self.order if k is None else k
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8, np.float32)
        at = self.grams[k].find(keys)
        out = self.grams[k].values[at]
        if len(lost := np.flatnonzero(at < 0)):
            shorter = keys[lost] & np.uint64((1 << (8 * k)) - 1)
            more = self.costs(shorter, k - 1)
            ctx = self.contexts[k].find(keys[lost] >> np.uint64(8))
            more[ctx >= 0] += self.contexts[k].values[ctx[ctx >= 0]]
            out[lost] = more
        return out

    def code_lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text for each language, and its bytes."""
        if any(len(t) > CHUNK for t in texts):
            each = [self._long(t) if len(t) > CHUNK else self.code_lengths([t]) for t in texts]
            return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
        a, begin, end = joined(texts, self.order)
        if not len(a):
            return np.zeros((len(texts), len(self.languages))), end - begin
        costs = self.costs(packed(a, self.order))
        costs = np.concatenate([costs, np.zeros((1, costs.shape[1]), costs.dtype)])
        bounds = np.stack([begin - self.order, end - self.order], 1).ravel()
        sums = np.add.reduceat(costs, bounds, axis=0, dtype=np.float64)[::2]
        sums[end == begin] = 0
        return sums, end - begin


    def _long(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text, piece by piece."""
        bits, n, last = np.zeros(len(self.languages)), 0, np.zeros(self.order, np.uint8)
        for at in range(0, len(text), CHUNK):
            a = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)
            blank = a == 32
            before = np.concatenate([[at > 0 and text[at - 1] == 32], blank[:-1]])
            a = np.concatenate([last, a[~(blank & before)]])
            bits += self.costs(packed(a, self.order)).sum(0, dtype=np.float64)
            n, last = n + len(a) - self.order, a[len(a) - self.order :]
        return bits[None], np.array([n])


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """The frozen trees of the given texts of each language."""
    languages = sorted(x for x in texts if any(texts[x]))
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lang in languages:
        a, begin, end = joined([text_bytes(t) for t in texts[lang] if t], order)
        keys = packed(a, order)
        inside = np.zeros(len(keys) + 1, np.int64)
        np.add.at(inside, begin - order, 1)
        np.add.at(inside, end - order, -1)
        keys = keys[np.cumsum(inside)[:-1] > 0]
        for k in range(order + 1):
            counted[k].append(np.unique(keys & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True))
    model = Model(languages, order, [], [])
    for k in range(order + 1):
        grams = np.unique(np.concatenate([g for g, _ in counted[k]])) if languages else np.empty(0, np.uint64)
        contexts = np.unique(grams >> np.uint64(8))
        escape = np.zeros((len(contexts), len(languages)), np.float32)
        model.contexts.append(Rows(contexts, escape))
        lower = model.costs(grams & np.uint64((1 << (8 * k)) - 1), k - 1)
        cost = lower.copy()
        for j, (g, n) in enumerate(counted[k]):
            c = g >> np.uint64(8)
            at = np.searchsorted(contexts, c)
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = kinds > 0
            escape[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            cost[:, j] += escape[np.searchsorted(contexts, grams >> np.uint64(8)), j]
            cost[np.searchsorted(grams, g), j] = -np.log2(n / (total[at] + kinds[at]))
        model.grams.append(Rows(grams, cost.astype(np.float32)))
    return model


def sample(docs: DataFrame, train: Column, rows: int = FIT_ROWS, chars: int = FIT_CHARS, seed: int = SEED) -> dict[str, list[str]]:
    """At most `rows` whole texts of each language among the training rows, by the smallest hash of the id, and
    `chars` letters of them in all."""
    d = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = d.groupBy("lang").agg((F.approx_count_distinct("doc_id", 0.02) + 1).alias("ids")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # of so many ids this share holds `rows` all but surely; the window then keeps `rows` of a task before they move
    share = {r["lang"]: min(1.0, 1.15 * (rows + 6 * rows**0.5 + 10) / r["ids"]) for r in counts}
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    d = d.withColumn("h", hash_unit(F.col("doc_id"), seed=seed)).withColumn("n", F.length("text"))
    d = d.where((F.col("h") < wanted) & (F.col("n") <= chars // len(counts)))
    order = W.partitionBy("lang").orderBy("h", "doc_id", "text")
    d = d.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)
    d = d.withColumn("run", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("run") <= chars // len(counts))
    out: dict[str, list[str]] = {}
    for r in sorted(d.select("lang", "r", "text").collect(), key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.text)
    return out


OUT = ("lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """keep, lang_pred, score and bits_per_byte of each row of docs, which has a text; the last three, whose names may get
    a prefix, replace kept columns of their names."""
    out = [prefix + c for c in OUT]
    columns = kept_beside(docs, keep, out)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        m = shared.value
        claim_cache("language_id", m.forget)
        for b in sliced(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            lang: list[str] = [UNDETERMINED] * len(texts)
            score, bits = np.zeros(len(texts)), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            at = 0
            while at < len(todo):
                group: list[bytes] = []
                size, first = 0, at
                while at < len(todo) and (not group or size < CHUNK):
                    group.append(text_bytes(texts[todo[at]]))
                    size, at = size + len(group[-1]), at + 1
                length, n = m.code_lengths(group)
                best = length.argmin(1)
                gap = np.minimum(length - length.min(1, keepdims=True), 1000)
                share = 1 / np.exp2(-gap).sum(1)
                for j, i in enumerate(todo[first:at]):
                    lang[i] = m.languages[best[j]]
                score[todo[first:at]], bits[todo[first:at]] = share, length.min(1) / np.maximum(n, 1)
            yield b, [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)]

    return mapped(docs, columns, "text", run, dict(zip(out, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def fit_documents(docs: DataFrame) -> Model:
    try:
        return fit(sample(docs, ~held_out(F.col("doc_id"))))
    finally:
        release()
