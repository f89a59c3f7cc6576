"""From archive bytes to framed records. The only code that walks bytes one after the other.

A record's place in a stream, its version line, header lines and end mark depend on what came
before, so they are found here; all that depends on one record alone is left to expressions.
Input is read in pieces and one record is held at a time.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from email.errors import HeaderParseError
from email.header import decode_header
from typing import BinaryIO

from ..functions.fields import normalize_constant
from ..options import FAIL, IGNORE, WarcOptions
from ..schema import RECORD_TYPES

PIECE = 1 << 20
_BLANK = b" \t\r\n"
_END = b"\r\n\r\n"
#: What a record starts with.
_GZIP, _WARC = b"\x1f\x8b", b"WARC/"


class Corrupt(Exception):
    """The compressed data is broken or ends early."""


class Bytes:
    """A stream with look-ahead that knows how far it has come."""

    def __init__(self, raw: BinaryIO) -> None:
        self._raw, self._held, self._at, self.taken, self._over = raw, b"", 0, 0, False

    def _fill(self, n: int) -> None:
        have = len(self._held) - self._at
        if have >= n or self._over:
            return
        parts = [self._held[self._at :]]
        while have < n:
            piece = self._more(max(PIECE, n - have))
            if not piece:
                self._over = True
                break
            parts.append(piece)
            have += len(piece)
        self._held, self._at = b"".join(parts), 0

    def _more(self, n: int) -> bytes:
        return self._raw.read(n)

    def peek(self, n: int) -> bytes:
        self._fill(n)
        return self._held[self._at : self._at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self._at += len(out)
        self.taken += len(out)
        return out

    def skip(self, n: int) -> int:
        left = n
        while left and (got := self.take(min(left, PIECE))):
            left -= len(got)
        return n - left

    def line(self) -> bytes:
        """Up to and with the next line feed, or all that is left."""
        seen = 0
        while True:
            end = self._held.find(b"\n", self._at + seen)
            if end >= 0:
                return self.take(end + 1 - self._at)
            seen = len(self._held) - self._at
            self._fill(seen + 1)
            if len(self._held) - self._at == seen:
                return self.take(seen)

    def find_start(self) -> int:
        """Moves to the next record start; returns the bytes skipped. Fewer than five bytes are never a start."""
        skipped = 0
        while len(window := self.peek(PIECE)) >= 5:
            places = [p for p in (window.find(_GZIP), window.find(_WARC)) if 0 <= p <= len(window) - 5]
            if places:
                return skipped + self.skip(min(places))
            skipped += self.skip(len(window) - 4)
        return skipped


class Member(Bytes):
    """The content of one gzip member of another stream."""

    def __init__(self, outer: Bytes) -> None:
        super().__init__(io.BytesIO())
        self._outer, self._z = outer, zlib.decompressobj(31)

    def _more(self, n: int) -> bytes:
        while not self._z.eof:
            piece = self._outer.peek(1 << 16)
            if not piece:
                raise Corrupt("the compressed data ends early")
            try:
                out = self._z.decompress(piece)
            except zlib.error as e:
                raise Corrupt(str(e)) from None
            self._outer.take(len(piece) - len(self._z.unused_data))
            if out:
                return out
        return b""

    def drain(self) -> None:
        """Reads to the end, where the checksum stands."""
        while self.take(PIECE):
            pass


class Failed(Exception):
    """A finding whose policy is to fail; ends the stream."""

    def __init__(self, kind: str, msg: str) -> None:
        super().__init__(msg)
        self.kind, self.msg = kind, msg


class Findings(list):
    def __init__(self, options: WarcOptions) -> None:
        super().__init__()
        self._options = options

    def say(self, category: str, msg: str, line: int | None = None, field: str | None = None) -> None:
        policy = self._options.policy(category)
        if policy == FAIL:
            raise Failed(category, msg)
        if policy != IGNORE:
            self.append({"category": category, "kind": category, "field": field, "line": line, "msg": msg, "expected": None, "actual": None})


def _decoded(line: bytes) -> str:
    """Text of a header line, with RFC 2047 words decoded."""
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        text = line.decode("iso-8859-1")
    if "=?" not in text:
        return text
    # after the last end of a word none can follow; looked at with the rest, each start there would be tried to the end
    end = text.rfind("?=") + 2
    tail = text[end:] if "=?" in text[end:] else ""
    return "".join(p if isinstance(p, str) else p.decode(c or "ascii") for p, c in decode_header(text[: len(text) - len(tail)])) + tail


def parse_fields(src: Bytes, found: Findings, line: int = 0) -> list[dict[str, str]]:
    """Header fields up to and with the empty line that ends them; `line` is the number of the last line read."""
    headers: list[dict[str, str]] = []

    def next_line(ends: bool = True) -> tuple[bytes, bool]:
        nonlocal line
        raw = src.line()
        line += 1
        whole = raw.endswith(b"\n")
        if ends and whole and not raw.endswith(b"\r\n"):
            found.say("syntax", "the line doesn't end in a carriage return", line)
        return raw.strip(_BLANK), whole

    def keep(logical: bytes) -> None:
        try:
            text = _decoded(logical)
        except (HeaderParseError, LookupError, ValueError):
            found.say("syntax", "encoded words in the line can't be read", line)
            return
        name, colon, value = text.partition(":")
        if not colon:
            found.say("syntax", f"the line has no colon: {text}", line)
            return
        headers.append({"name": normalize_constant(name.strip(" \t\r\n")), "value": value.strip(" \t\r\n")})

    while True:
        logical, whole = next_line()
        if not whole:
            if logical:
                found.say("syntax", "the last line doesn't end", line)
                keep(logical)
            return headers
        if not logical:
            return headers
        while src.peek(1) in (b" ", b"\t"):
            more, whole = next_line()
            logical += b" " + more
            if not whole:
                found.say("syntax", "the header ends in a folded line", line)
                keep(logical)
                return headers
        keep(logical)
        if src.peek(1) in (b"\r", b"\n"):
            mark, whole = next_line(ends=False)
            if mark or not whole:
                found.say("syntax", "no empty line ends the fields")
            return headers


def _end_mark(src: Bytes, found: Findings) -> None:
    mark = src.peek(4)
    if mark == _END:
        src.take(4)
        return
    shown = f"{mark.decode('iso-8859-1')!r} in place of {_END.decode()!r}"
    if mark in (b"\n", b"\n\n"):
        src.take(len(mark))
        found.say("spec", f"line feeds alone end the record: {shown}")
    elif len(mark) < 4:
        src.take(len(mark))
        found.say("spec", f"the end mark is too short: {shown}")
    else:  # the bytes stay, as garbage before the next record
        found.say("spec", f"something else stands for the end mark: {shown}")


def _number(headers: list[dict[str, str]], name: str) -> int:
    value = next((h["value"] for h in headers if h["name"] == name), "")
    digits = value[1:] if value[:1] in "+-" else value
    if value[:1] == "-" or not (digits.isascii() and digits.isdigit()):
        return 0
    digits = digits.lstrip("0") or "0"
    return n if len(digits) < 20 and (n := int(digits)) < 1 << 63 else 0


#: The algorithms of digests.
_ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def _said(headers: list[dict[str, str]], name: str) -> str | None:
    return next((h["value"] for h in headers if h["name"] == name), None)


def _head_length(data: bytes) -> int | None:
    """Bytes up to and with the first line of at most one byte and a line feed; None if there is none."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        if end - at < 2:
            return end + 1
        at = end + 1
    return None


def _hash_on(src: Bytes, headers: list[dict[str, str]], held: bytes, left: int, options: WarcOptions) -> dict:
    """Size and digests of a block of which `held` is read and `left` bytes are not; none of them are kept."""
    wanted = {options.default_algorithm}
    for name in ("WARC-Block-Digest", "WARC-Payload-Digest"):
        if said := _said(headers, name):
            algorithm = said.partition(":")[0].lower() or "sha256"
            wanted.add({"sha-1": "sha1", "sha-256": "sha256", "sha-512": "sha512"}.get(algorithm, algorithm))
    block = {a: hashlib.new(a, held) for a in _ALGORITHMS if a in wanted}
    http = (_said(headers, "Content-Type") or "").lower().startswith("application/http")
    cut = _head_length(held) if http else None
    payload = {a: hashlib.new(a, held[cut:]) for a in block} if cut is not None else {}
    size = len(held)
    while left and (piece := src.take(min(left, PIECE))):
        for h in (*block.values(), *payload.values()):
            h.update(piece)
        left, size = left - len(piece), size + len(piece)
    digests = lambda found: [(a, h.digest()) for a, h in found.items()]
    return {"size": size, "block": digests(block), "payload": digests(payload if http else block)}


def open_record(raw: BinaryIO) -> tuple[Bytes, list[dict[str, str]]]:
    """The stream behind the header of the record that starts here, and the header."""
    src = Bytes(raw)
    inner = Member(src) if src.peek(2) == _GZIP else src
    if not inner.line().startswith(_WARC):
        raise Corrupt("no version line starts the record")
    return inner, parse_fields(inner, Findings(WarcOptions.no_validation()), 1)


def chunks(raw: BinaryIO, size: int) -> Iterator[bytes]:
    """The block of the record that starts here, in pieces of `size` bytes, the last of which may be shorter."""
    inner, headers = open_record(raw)
    left = _number(headers, "Content-Length")
    while left and (piece := inner.take(min(left, size))):
        yield piece
        left -= len(piece)


def frames(raw: BinaryIO, options: WarcOptions, *, offset: int = 0, path: str | None = None, with_block: bool = True, one: bool = False, types: frozenset[str] = frozenset()) -> Iterator[dict]:
    """A row for each record of a stream; a fatal error ends it with a row that has `error`. With `types`, blocks of records of
    other types are passed over."""
    src = Bytes(raw)
    while True:
        before, after = Findings(options), Findings(options)
        row: dict = {"file_path": path, "record_offset": offset + src.taken, "record_size": 0, "skipped_bytes": 0, "is_gzip": None, "version": None, "version_major": None, "version_minor": None, "kind": None, "headers": None, "block": None, "block_truncated": None, "whole": None, "before": before, "after": after, "error": None}
        start = src.taken
        try:
            if len(head := src.peek(5)) < 5:
                return
            if head[:2] != _GZIP and head != _WARC:
                if options.syntax == FAIL:
                    raise Failed("syntax", "no record starts here")
                skipped = src.find_start()
                row["skipped_bytes"], row["record_offset"] = skipped, offset + src.taken
                start = src.taken
                if len(head := src.peek(5)) < 5:
                    raise Failed("no_record", f"no record starts in the last {skipped} bytes")
                found_at = f"{skipped} bytes stand before the record"
                before.say("syntax", found_at)
            row["is_gzip"] = head[:2] == _GZIP
            inner = Member(src) if row["is_gzip"] else src
            first = inner.line()
            if not first.startswith(_WARC):
                raise Failed("syntax", "no version line starts the record")
            if not first.endswith(b"\n"):
                raise Failed("syntax", "the data ends in the version line")
            version = first[5:].strip().decode("iso-8859-1")
            known = next((v for v in ("1.0", "1.1") if version.startswith(v)), None)
            row |= {"version": known or version, "version_major": 1 if known else 0, "version_minor": int(known[2]) if known else 0}
            if not known:
                before.say("spec", f"records of version {version} are not known")
            if not first.endswith(b"\r\n"):
                before.say("syntax", f"the version line {first.strip().decode('iso-8859-1')!r} doesn't end in a carriage return", 1)
            row["headers"] = parse_fields(inner, before, 1)
            kind = (_said(row["headers"], "WARC-Type") or "").lower()
            row["kind"] = kind if kind in RECORD_TYPES else None
            length = _number(row["headers"], "Content-Length")
            wanted = with_block and (not types or kind in types)
            held = min(length, options.max_block_bytes) if wanted else 0
            row["block"] = inner.take(held) if wanted else None
            row["block_truncated"] = wanted and held < length
            if row["block_truncated"]:
                row["whole"] = _hash_on(inner, row["headers"], row["block"], length - held, options)
            else:
                inner.skip(length - held)
            _end_mark(inner, after)
            if row["is_gzip"]:
                inner.drain()
        except Failed as e:
            row["error"] = {"kind": e.kind, "msg": e.msg}
        except Corrupt as e:
            row["error"] = {"kind": "gzip", "msg": str(e)}
        row["record_size"] = src.taken - start
        yield row
        if row["error"] or one:
            return
