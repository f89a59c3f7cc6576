"""Options of readers, builders and writers: error policies, repairs, digests, presets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column

IGNORE, WARN, FAIL = "ignore", "warn", "fail"


@dataclass(frozen=True)
class WarcOptions:
    """A policy for each category: `ignore` says nothing, `warn` leaves a finding, `fail` makes the
    record's first such finding its error."""

    version: str = "1.1"
    syntax: str = WARN
    spec: str = WARN
    unknown_type: str = WARN
    block: str = IGNORE
    add_missing_record_id: bool = True
    add_missing_content_length: bool = True
    add_missing_digest: bool = False
    default_algorithm: str = "sha256"
    default_encoding: str = "base16"
    fix_content_length: bool = False
    fix_digest: bool = False
    fix_syntax_errors: bool = False
    fix_warc_fields: bool = False
    parse_block: bool = True
    #: A row holds this much of a block, and block_truncated says so where there is more; sizes and digests are those of
    #: the whole block, and sources.datasource.block_chunks gives all of it. A row holds less than 2 GB.
    max_block_bytes: int = 1 << 30
    #: Blank out invalid and illegal values, as strict consumers want; else they stay beside the finding.
    blank_invalid: bool = False
    #: Makes ids of records without one: a Column, or a function of no arguments that gives one.
    record_id: Column | Callable[[], Column] | None = None

    def __post_init__(self) -> None:
        for name in ("syntax", "spec", "unknown_type", "block"):
            if getattr(self, name) not in (IGNORE, WARN, FAIL):
                raise ValueError(f"{name} must be one of ignore, warn and fail")
        if self.version not in ("1.0", "1.1"):
            raise ValueError("version must be 1.0 or 1.1")

    def policy(self, category: str) -> str:
        return {"syntax": self.syntax, "spec": self.spec, "type": self.unknown_type, "block": self.block}[category]

    def but(self, **changes: object) -> WarcOptions:
        return replace(self, **changes)

    @classmethod
    def no_validation(cls, **more: object) -> WarcOptions:
        """Headers as they are; no findings and no parsed blocks."""
        return cls(**{"syntax": IGNORE, "spec": IGNORE, "unknown_type": IGNORE, "parse_block": False, **more})

    @classmethod
    def strict(cls, **more: object) -> WarcOptions:
        """The first finding of any kind but a block's is the record's error."""
        return cls(**{"syntax": FAIL, "spec": FAIL, "unknown_type": FAIL, **more})

    @classmethod
    def from_strings(cls, given: Mapping[str, str]) -> WarcOptions:
        """From the string options of a reader or writer; names are matched without case or underscores."""
        low = {k.replace("_", "").lower(): v for k, v in given.items()}
        base = {"novalidation": cls.no_validation, "strict": cls.strict}.get(low.get("preset", "").lower(), cls)()
        got: dict[str, object] = {}
        for f in fields(cls):
            if (v := low.get(f.name.replace("_", ""))) is not None and f.name != "record_id":
                kind = type(getattr(base, f.name))
                got[f.name] = v.strip().lower() in ("true", "1", "yes") if kind is bool else kind(v)
        return replace(base, **got)
