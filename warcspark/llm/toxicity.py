"""Toxicity scores from a learned lexicon that is matched with misspellings, in context.

The lexicon is learned from labelled texts: words, and stems that several words begin with,
whose presence speaks for the label beyond chance. The Levenshtein automata of all its terms
run over the trie of the terms as one machine: a state is the set of (trie node, edits spent)
that the letters read so far can have reached, made deterministic as words need it. An edit is
a letter put in, left out, replaced, or swapped with its neighbour; terms and stems of fewer
than FUZZY_FROM letters match exactly. A word hits a stem if some beginning of it does, and the
terms that begin with a stem stay beside it. Misspellings that clean labelled texts use are
ordinary words, and of stems, ordinary beginnings.

Each hit is weighed in a window of WINDOW words: inside quotation marks or next to a word of
reporting it counts as quotation, else as abuse. A logistic model over the counts of exact,
misspelled and stem hits, and of quoted ones, gives the score.

Scale: the model is fitted on the driver on at most FIT_TOXIC + FIT_CLEAN labelled texts by
the smallest hash of the id, and at most FIT_CHARS letters of them; only their ids are
broadcast to find them, and both bounds hold before a text reaches the driver. All texts are then scored whole where they are read, without a shuffle.

Defined cases: null and empty texts have no hits and the score of a text without any; a
document with several labels is toxic if one of them says so; null labels don't count; without
both classes among the labels, or without any term that tells them apart, every score is the
share of toxic ones; repeated rows are scored
one by one, and of rows that repeat an id the model sees the smallest text only; texts of any length are read as a whole, as words of one
Python list; empty tables give empty results; other columns, of any type, don't matter: those to keep give way to outputs of their name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_cache, crc_mod, hash_unit, kept_beside, mapped, release, sliced, staged, temporary

FIT_TOXIC, FIT_CLEAN, FIT_CHARS, SEED = 1500, 4500, 64_000_000, 11
MIN_DOCS, MIN_GAIN, MIN_PRECISION, MAX_TERMS = 3, 11.5, 0.95, 2000
STEM_FROM, STEM_TO, STEM_FORMS, FUZZY_FROM, WINDOW, CACHE = 4, 8, 3, 5, 6, 150_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¡¿"
_OPEN, _CLOSE = '"“„«‹‘', '"”“»›’'
#: Words of reporting, in the languages of the tables.
REPORTING = frozenset("said says wrote writes quoted quote quoting called reported sagte sagt schrieb zitat dijo dice escribió cita dit écrit citation".split())


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


class Machine:
    """The terms' Levenshtein automata and their trie as one lazily built deterministic machine."""

    def __init__(self, terms: list[str], stems: list[str], exceptions: frozenset[str] = frozenset()) -> None:
        self.exceptions = exceptions
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.fuzzy: list[bool] = [False]  # whether a term or stem that allows an edit lies below
        for words, ends in ((terms, self.term), (stems, self.stem)):
            for w in words:
                at = 0
                for c in w:
                    self.fuzzy[at] |= len(w) >= FUZZY_FROM
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.fuzzy.append(False)
                    at = self.child[at][c]
                self.fuzzy[at] |= len(w) >= FUZZY_FROM
                ends[at] = w
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, str] | None] = []
        self.done: list[str | None] = []  # a stem ends here: the rest of the word is free
        self.almost: list[str | None] = []  # the same with an edit spent
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, found: set) -> frozenset:
        """With what leaving out a term's letter reaches; a node's fewest edits are enough."""
        for node, spent, need in list(found):
            if not spent and not need and self.fuzzy[node]:
                found |= {(n, 1, "") for n in self.child[node].values() if self.fuzzy[n]}
        return frozenset(x for x in found if x[1] == 0 or (x[0], 0, "") not in found or x[2])

    def _state(self, found: frozenset) -> int:
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
            self.steps.append({})
            exact = [self.term[n] for n, e, need in found if not e and not need and n in self.term]
            near = sorted(self.term[n] for n, e, need in found if e and not need and n in self.term and len(self.term[n]) >= FUZZY_FROM)
            self.ends.append(("exact", exact[0]) if exact else ("near", near[0]) if near else None)
            self.done.append(next((self.stem[n] for n, e, need in found if not e and not need and n in self.stem), None))
            self.almost.append(min((self.stem[n] for n, e, need in found if e and not need and n in self.stem and len(self.stem[n]) >= FUZZY_FROM), default=None))
        return self.number[found]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, spent, need in self.states[state]:
            if need:
                if c == need:
                    out.add((node, spent, ""))
                continue
            below = self.child[node]
            if c in below:
                out.add((below[c], spent, ""))
            if not spent and self.fuzzy[node]:
                out.add((node, 1, ""))
                for a, n in below.items():
                    if self.fuzzy[n]:
                        out.add((n, 1, ""))
                        if a != c and c in self.child[n] and self.fuzzy[self.child[n][c]]:
                            out.add((self.child[n][c], 1, a))
        to = self.steps[state][c] = self._state(self._closed(out))
        return to

    def found(self, word: str) -> tuple[str, str, str] | None:
        """('exact' | 'near' | 'stem', term or stem, key), or None. The key of a misspelling is the word,
        or the shortest beginning that is near a stem, with a star; exceptions are such keys."""
        at, stem, almost = self.start, None, None
        for i, c in enumerate(word):
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at]:
                break
            stem = stem or self.done[at]
            if not almost and self.almost[at]:
                almost = self.almost[at], word[: i + 1] + "*"
        hit = self.ends[at]
        if hit and hit[0] == "exact":
            return *hit, word
        if stem:
            return "stem", stem, stem
        return (*hit, word) if hit else ("near", *almost) if almost else None

    def match(self, word: str) -> tuple[str, str] | None:
        """('exact' | 'near' | 'stem', term or stem), or None."""
        hit = self.found(word)
        return hit[:2] if hit and (hit[0] != "near" or hit[2] not in self.exceptions) else None


KINDS = ("exact", "near", "stem")
#: A misspelling or a stem counts as an exact hit, unless the labels say otherwise: the model learns what differs.
ALIKE = np.array([[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0.95, 1, 0, 0], [0, 1, 0, 1, 0], [0, 0, 0, 0, 1.0]])


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    exceptions: frozenset[str]
    weights: np.ndarray
    _machine: Machine | None = field(default=None, repr=False)
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None, "_known": {}}

    def kind(self, word: str) -> int:
        """0 for an ordinary word, else 1 more than its place in KINDS."""
        found = self._known.get(word)
        if found is None:
            if self._machine is None:
                self._machine = Machine(self.terms, self.stems, self.exceptions)
            if len(self._known) >= CACHE:
                self._known.clear()
            p = plain(word)
            hit = self._machine.match(p) if p else None
            found = self._known[word] = KINDS.index(hit[0]) + 1 if hit else 0
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(place among the words, kind, whether it is quoted) of each hit."""
        words = text.split() if text else []
        kinds = list(map(self.kind, words))
        return [(i, k, quoted(words, i)) for i, k in enumerate(kinds) if k] if any(kinds) else []

    def features(self, text: str | None) -> list[float]:
        n = Counter(4 if q else k for _, k, q in self.hits(text))
        return [1.0, *(math.log1p(n[k]) for k in (1, 2, 3, 4))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ ALIKE @ self.weights, -35, 35)))


def quoted(words: list[str], i: int) -> bool:
    """Whether the word at i stands in quotation marks or by a word of reporting, within the window."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    if any(plain(w) in REPORTING for w in before[:-1] + after[1:3]):
        return True
    opened = next((True for w in reversed(before) if w[0] in _OPEN or w.lstrip("([").startswith(tuple(_OPEN))), False)
    if opened and not any(w.rstrip(".,;:!?)")[-1:] in _CLOSE for w in before[:-1] if len(w) > 1 and w[0] not in _OPEN):
        return any(w.rstrip(".,;:!?)")[-1:] in _CLOSE for w in after if w.rstrip(".,;:!?)"))
    return False


def _gain(t: float, c: float, nt: int, nc: int) -> float:
    """Log-likelihood, in nats, that t of t + c texts are toxic rather than as many as of all; 0 if fewer are."""
    n, p = t + c, nt / (nt + nc)
    if t <= 0 or t / n <= p:
        return 0.0
    return t * math.log(t / n / p) + (c * math.log(c / n / (1 - p)) if c else 0.0)


def learn_lexicon(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str]]:
    """Terms and stems. Support is the number of toxic texts, but no more than that of different
    neighbours, so copies of one text don't lend weight to whatever else it says."""
    nt = sum(toxic)
    nc = len(toxic) - nt
    docs: Counter[str] = Counter()
    ctx: dict[str, set[int]] = defaultdict(set)
    for text, y in zip(texts, toxic, strict=True):
        if y:
            words = [plain(w) for w in text.split()]
            docs.update(set(words))
            for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
                if len(c := ctx[w]) < 4 * FIT_TOXIC:
                    c.add(hash((a, b)))
    docs.pop("", None)
    by_stem: dict[str, set[str]] = defaultdict(set)
    for w in docs:
        for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1):
            by_stem[w[:k]].add(w)
    maybe = {w for w, n in docs.items() if n >= MIN_DOCS and len(w) >= 3}
    stems = {s for s, ws in by_stem.items() if sum(docs[w] > 1 and len(ctx[w]) > 1 for w in ws) >= STEM_FORMS}
    clean: Counter[str] = Counter()
    stem_docs: dict[str, list[int]] = {s: [0, 0] for s in stems}
    for text, y in zip(texts, toxic, strict=True):
        words = {plain(w) for w in text.split()}
        if not y:
            clean.update(words & maybe)
        for s in {w[:k] for w in words for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1)} & stems:
            stem_docs[s][0 if y else 1] += 1

    def good(t: int, c: int, contexts: int) -> float:
        t = min(t, contexts)
        sure = (t / nt) / (t / nt + (c + 0.5) / nc) >= MIN_PRECISION
        gain = _gain(t, c, nt, nc)
        return gain if sure and gain >= MIN_GAIN else 0.0

    found = {w: g for w in maybe if (g := good(docs[w], clean[w], len(ctx[w])))}
    terms = sorted(found, key=lambda w: (-found[w], w))[:MAX_TERMS]
    kept: list[str] = []
    fit = {s: good(t, c, sum(len(ctx[w]) for w in by_stem[s])) for s, (t, c) in stem_docs.items()}
    for s in sorted((s for s in fit if fit[s]), key=lambda s: (len(s), s)):
        if any(s.startswith(k) for k in kept):
            continue
        while longer := [x for x in fit if len(x) == len(s) + 1 and x.startswith(s) and fit[x] and stem_docs[x][0] >= 0.95 * stem_docs[s][0]]:
            s = longer[0]
        if s not in kept:
            kept.append(s)
    kept = sorted(kept, key=lambda s: (-fit[s], s))[:MAX_TERMS]
    return sorted(terms), sorted(kept)


def fit(texts: list[str], toxic: list[int]) -> Model:
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model([], [], frozenset(), np.array([40.0 if share == 1 else -40.0, 0, 0, 0, 0]))
    terms, stems = learn_lexicon(texts, toxic)
    if not terms and not stems:  # nothing tells the classes apart
        return Model([], [], frozenset(), np.array([math.log(y.mean() / (1 - y.mean())), 0, 0, 0, 0]))
    free = Machine(terms, stems)
    used = {plain(w) for t, k in zip(texts, toxic, strict=True) if not k for w in t.split()}
    ordinary = frozenset(m[2] for w in used if w and (m := free.found(w)) and m[0] == "near")
    model = Model(terms, stems, ordinary, np.zeros(5))
    x = np.array([model.features(t) for t in texts])
    z = x @ ALIKE
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = model.scores(x)
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ model.weights)
        model.weights = model.weights + step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return model


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", hash_unit(F.col("doc_id"), seed=SEED))
    chosen = [known.where((F.col("toxic") > 0) == flag).orderBy("_h", "doc_id").limit(n) for flag, n in ((True, FIT_TOXIC), (False, FIT_CLEAN))]
    few = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic", "_h")
    found = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(few), "doc_id")
    with temporary(docs.sparkSession):
        rows = staged(found.groupBy("doc_id", "toxic", "_h").agg(F.min("text").alias("text")), "toxicity-sample")
        size, taken = 0, []
        for r in sorted(rows.select("doc_id", "_h", F.length("text").alias("n")).collect(), key=lambda r: (r["_h"], r["doc_id"])):
            if size + r["n"] <= FIT_CHARS:
                taken.append(r["doc_id"])
                size += r["n"]
        got = sorted(rows.where(F.col("doc_id").isin(taken)).collect(), key=lambda r: (r["_h"], r["doc_id"]))
    try:
        return fit([r["text"] for r in got], [int(r["toxic"] > 0) for r in got])
    finally:
        got.clear()
        release()


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """keep, score, predicted and hits of each row of docs, which has a text; the last three, whose names may get a prefix,
    replace kept columns of their names."""
    out = [prefix + c for c in ("score", "predicted", "hits")]
    kept = kept_beside(docs, keep, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        m = shared.value
        claim_cache("toxicity", m._known.clear)
        for b in sliced(batches):
            x = np.array([m.features(t) for t in b.column(b.num_columns - 1).to_pylist()], float).reshape(-1, 5)
            s = m.scores(x)
            hits = np.rint(np.expm1(x[:, 1:])).sum(1).astype(np.int32)
            yield b, [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits)]

    return mapped(docs, kept, "text", run, dict(zip(out, (T.DoubleType(), T.IntegerType(), T.IntegerType()), strict=True)))
