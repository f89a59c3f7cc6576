"""Which sources of a language use its words unlike each other: divergences from in-mapper stripes.

A term is a run of letters (A to Z and all beyond ASCII), only A to Z lower-cased. A language keeps
the terms that at least `least` of its documents hold. A source's share of a kept term is
p = 1 + floor(SCALE (count + 2) / (N + 2 V)), with N its occurrences of kept terms and V their
number; two shares differ by floor((p - q)^2 / (p + q)). All of it is whole numbers.

Each task folds whole documents into stripes: for a term of a language the number of documents and
the occurrences by source. When the stripes of a task hold `cells` counts, or `held` bytes of terms, they
are handed on and it starts anew, so its memory is bounded; the shuffle brings the parts of a stripe
together, where they are summed. What each source has in all is known then, and a second pass over the merged
stripes, dealt by language and a hash of the term, gives sums for each pair of sources and the best terms of each.

Scale: texts are read once and never shuffled, stripes are merged before and after the shuffle, and
a hot language spreads over as many parts as it has terms for. A stripe has a count for each source of
its language, and the result has a row for each pair of sources, so work grows with the square of
the sources of a language, as the result does. Nothing comes to the driver but two sums.

Defined cases: null text, lang and source count as ''; repeated rows and ids count as often as they stand, each as a
document of its own; documents without terms, and texts of any length, are no exception; a language without kept terms has
pairs of value 0; a language with one source has no pairs; ties go by UTF-8 order; an empty table gives no rows;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import coded_terms, sliced, staged

#: What stands between terms: all of ASCII but letters.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, SCALE, TOP = 10, 1_000_000_000, 10
#: Counts and bytes of terms that the stripes of a task hold before they are handed on; counts a part of the second pass has.
CELLS, HELD, PART = 400_000, 64 << 20, 400_000
ROWS, BYTES = 8192, 8 << 20
_STRIPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("cells", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])


class Stripes:
    """term -> [documents, {source: occurrences}] for each language; the term None counts the documents of a source."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str | None, list]] = {}
        self.cells, self.held = 0, 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        groups = list(dict.fromkeys(zip(langs, sources, strict=True)))
        number = {g: k for k, g in enumerate(groups)}
        group = np.fromiter((number[g] for g in zip(langs, sources, strict=True)), np.int64, len(langs))
        rows, codes, terms = coded_terms(texts, BREAKS)
        wide, names = max(1, len(terms)), terms.to_pylist()
        once, n = np.unique(rows * wide + codes, return_counts=True)  # a document's terms, and how often it has each
        at, back = np.unique(group[once // wide] * wide + once % wide, return_inverse=True)
        docs, counts = np.bincount(back, minlength=len(at)), np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)
        for key, d, c in zip(at.tolist(), docs.tolist(), counts.tolist(), strict=True):
            self._put(groups[key // wide], names[key % wide], d, c)
        for k, c in enumerate(np.bincount(group, minlength=len(groups)).tolist()):
            self._put(groups[k], None, 0, c)

    def _put(self, group: tuple[str, str], term: str | None, docs: int, n: int) -> None:
        lang, source = group
        mine = self.of.setdefault(lang, {})
        stripe = mine.get(term)
        if stripe is None:
            stripe = mine[term] = [0, {}]
            self.held += len(term or "")
        stripe[0] += docs
        if source in stripe[1]:
            stripe[1][source] += n
        else:
            stripe[1][source] = n
            self.cells += 1

    def full(self, cells: int, held: int) -> bool:
        return self.cells >= cells or self.held >= held

    def take(self, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
        """All stripes, which are forgotten."""
        for lang, mine in self.of.items():
            items = list(mine.items())
            for start in range(0, len(items), rows):
                part = items[start : start + rows]
                cells = [[{"source": s, "n": n} for s, n in c.items()] for _, (_, c) in part]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([t for t, _ in part], pa.string()), pa.array([d for _, (d, _) in part], pa.int64()), pa.array(cells, _STRIPES.field("cells").type)], schema=_STRIPES)
        self.__init__()


def merged_stripes(docs: DataFrame, *, least: int = LEAST, cells: int = CELLS, held: int = HELD) -> DataFrame:
    """lang, term, docs and cells (source, n) of each kept term; with the term null, the documents of each source."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for b in sliced(batches, ROWS, BYTES):
            stripes.add(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
            if stripes.full(cells, held):
                yield from stripes.take()
        yield from stripes.take()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(fold, "lang string, term string, docs long, cells array<struct<source:string,n:long>>")
    # the exchange is by term, so that both sums below find their rows together
    flat = parts.repartition("lang", "term").select("lang", "term", "docs", F.posexplode("cells").alias("k", "cell"))
    flat = flat.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    whole = flat.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return whole.where(F.col("term").isNull() | (F.col("docs") >= least))


def group_sums(stripes: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), lang_n and terms (kept terms of the language) of each source."""
    flat = stripes.select("lang", "term", F.explode("cells").alias("cell"))
    kept = F.col("term").isNotNull()
    sums = flat.groupBy("lang", F.col("cell.source").alias("source")).agg(F.coalesce(F.sum(F.when(kept, F.col("cell.n"))), F.lit(0)).alias("n"))
    terms = stripes.groupBy(F.col("lang").alias("_lang")).agg(F.count("term").alias("terms"))
    every = W.partitionBy("lang")
    return sums.withColumn("lang_n", F.sum("n").over(every)).join(terms, F.col("lang") == F.col("_lang")).drop("_lang")


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exactly, however large the counts are."""
    if counts.size and int(counts.max()) + 2 >= (1 << 63) // SCALE:
        counts, total = counts.astype(object), np.asarray(total, dtype=object)
    return (1 + (SCALE * (counts + 2)) // (total + 2 * terms)).astype(np.int64)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _best(values: np.ndarray, names: list[str], at: np.ndarray, top: int) -> list[tuple[int, str]]:
    if len(at) > top:
        at = at[values[at] >= np.partition(values[at], len(at) - top)[len(at) - top]]
    return sorted(((int(values[i]), names[i]) for i in at), key=lambda x: (-x[0], x[1]))[:top]


def diverge(stripes: DataFrame, groups: DataFrame, *, top: int = TOP, part: int = PART) -> DataFrame:
    """lang, source, part, item and value: a part's sum for each pair of sources (one way round), and its best terms."""
    kept = stripes.where("term is not null")
    most = kept.groupBy("lang").agg(F.sum(F.size("cells")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // part), int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    left = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("salt"), "term", "cells")
    right = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:
            return out.empty_table()
        known = known.sort_by("source")
        sources, lang = known["source"].to_pylist(), known["lang"][0].as_py()
        column = {s: k for k, s in enumerate(sources)}
        total, lang_n, terms = known["n"].to_numpy(), known["lang_n"][0].as_py(), known["terms"][0].as_py()
        sums = np.zeros((len(sources), len(sources)), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in sources]
        step = max(1, (1 << 20) // len(sources))
        for start in range(0, mine.num_rows, step):
            names, cells = mine["term"][start : start + step].to_pylist(), mine["cells"].slice(start, step).combine_chunks()
            counts = np.zeros((len(names), len(sources)), np.int64)
            flat = cells.flatten()
            which = np.fromiter((column[s] for s in flat.field("source").to_pylist()), np.int64, len(flat))
            counts[np.repeat(np.arange(len(names)), cells.value_lengths().to_numpy()), which] = flat.field("n").to_numpy()
            p, q = shares(counts, total, terms), shares(counts.sum(axis=1), lang_n, terms)
            for a in range(len(sources)):
                sums[a, a + 1 :] += differences(p[:, a + 1 :], p[:, a : a + 1]).sum(axis=0)
                at = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
                best[a] = sorted(best[a] + _best(differences(p[:, a], q), names, at, top), key=lambda x: (-x[0], x[1]))[:top]
        pairs = [(a, b) for a in range(len(sources)) for b in range(a + 1, len(sources))]
        rows = [(sources[a], "pair", sources[b], int(sums[a, b])) for a, b in pairs] + [(sources[a], "term", t, v) for a, found in enumerate(best) for v, t in found]
        return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], out.field(k + 1).type) for k in range(4))], schema=out)

    return left.groupBy("lang", "salt").cogroup(right.groupBy("lang", "salt")).applyInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, *, least: int = LEAST, top: int = TOP, cells: int = CELLS, held: int = HELD, part: int = PART) -> DataFrame:
    """lang, source, part, item, value and rank for docs with text, lang and source; see the module."""
    stripes = staged(merged_stripes(docs, least=least, cells=cells, held=held), "audit-stripes")
    groups = staged(group_sums(stripes), "audit-groups")
    found = staged(diverge(stripes, groups, top=top, part=part), "audit-parts")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
