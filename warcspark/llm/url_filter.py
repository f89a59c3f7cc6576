"""URL filters: rules indexed by their rarest literal token.

A rule is a host and a path prefix. It fits its host and all subdomains, where the URL's path
starts with the rule's. Each rule is kept under one of its complete literal tokens, the one
that is rarest in the URLs at hand. The tokens of a URL fetch candidate rules, and only those
run their regular expression. Of the rules that fit, the longest wins; ties go to the rule
given first. URLs without a fitting rule take the default verdict.

Defined cases: null URLs and those without `://` have an empty host and path and take the
default. Extra columns pass through the operator unless they have the name of an output
column, which then replaces them. Repeated rows are judged one by one. An empty table gives
an empty result, and no rules at all give everyone the default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The host ends at the first of `/?#`, the path at the first of `?#`.
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: Rules travel as one broadcast; more than this many belong in a table of their own.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    def __post_init__(self) -> None:
        """Hosts of URLs are lower-cased from A to Z, so those of rules are as well."""
        object.__setattr__(self, "host", self.host.translate(_LOWER))

    @property
    def text(self) -> str:
        return self.host + self.path

    def pattern(self) -> str:
        """For the host, a `#`, which neither part can hold, and the path."""
        return rf"(?:[^#]*\.)?{re.escape(self.host)}#{re.escape(self.path)}"

    def tokens(self) -> set[str]:
        """Tokens that any URL which the rule fits has as a whole: the path's last run may go on, so it doesn't count."""
        found = {f"h:{m[0]}" for m in _TOKEN.finditer(self.host)}
        return found | {f"p:{m[0]}" for m in _TOKEN.finditer(self.path) if m.end() < len(self.path)}


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{x}" for x in _TOKEN.findall(host)} | {f"p:{x}" for x in _TOKEN.findall(path)}


def token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each wanted token; one row for each of them comes to the driver."""
    if not wanted:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for u in b.column(0).to_pylist():
                for t in url_tokens(*split_url(u)) & wanted:
                    seen[t] = seen.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    rows = urls.select(url_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self._patterns: dict[int, re.Pattern[str]] = {}
        for i, r in enumerate(rules):
            if tokens := r.tokens():
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def _fits(self, i: int, at: str) -> bool:
        """A rule's pattern is compiled when the rule is a candidate for the first time."""
        if i not in self._patterns:
            self._patterns[i] = re.compile(self.rules[i].pattern())
        return self._patterns[i].match(at) is not None

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        tried = set(self.always)
        for t in url_tokens(host, path):
            tried.update(self.by_token.get(t, ()))
        fits = [i for i in tried if self._fits(i, f"{host}#{path}")]
        if not fits:
            return None
        best = self.rules[min(fits, key=lambda i: (-len(self.rules[i].text), i))]
        return best.text, best.verdict


def filter_urls(df: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict; no shuffle but the count of the rules' own tokens."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with the tasks")
    wanted = set().union(*(r.tokens() for r in rules)) if rules else set()
    shared = df.sparkSession.sparkContext.broadcast((list(rules), token_counts(df, url_col, wanted)))
    out = ["host", "path", "rule", "verdict"]
    keep = [f for f in df.schema.fields if f.name not in out]
    schema = T.StructType(keep + [T.StructField(c, T.StringType()) for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(*shared.value)
        for b in batches:
            parts = [split_url(u) for u in b.column(b.schema.get_field_index(url_col)).to_pylist()]
            hits = [index.judge(*p) for p in parts]
            new = [[p[0] for p in parts], [p[1] for p in parts], [h and h[0] for h in hits], [h[1] if h else default for h in hits]]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(x, pa.string()) for x in new], [f.name for f in keep] + out)

    return df.mapInArrow(run, schema)
