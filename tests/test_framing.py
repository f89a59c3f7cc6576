import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from warcspark.options import WarcOptions
from warcspark.sources.framing import Bytes, Findings, Failed, frames, parse_fields

U = "urn:uuid:e9a0cecc-0221-11e7-adb1-0242ac120008"


def record(body=b"hello", *, version="1.1", eol="\r\n", end=b"\r\n\r\n", kind="resource", length=None, more=""):
    head = f"WARC/{version}{eol}WARC-Type: {kind}{eol}WARC-Record-ID: <{U}>{eol}WARC-Date: 2017-03-06T04:03:53Z{eol}Content-Type: text/plain{eol}{more}Content-Length: {len(body) if length is None else length}{eol}{eol}"
    return head.encode() + body + end


def rows(data, options=None, **more):
    return list(frames(io.BytesIO(data), options or WarcOptions(), **more))


def messages(r):
    return [f["msg"] for f in [*r["before"], *r["after"]]]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_streams(n):
    a = record()
    for data, gz in ((a * n, False), (gzip.compress(a) * n, True)):
        got = rows(data)
        assert len(got) == n and all(r["block"] == b"hello" and r["is_gzip"] is gz and not messages(r) and not r["error"] for r in got)
        assert [r["record_offset"] for r in got] == [i * len(data) // n for i in range(n)]
        assert sum(r["record_size"] for r in got) == len(data)
        assert all(x["record_offset"] + x["record_size"] <= y["record_offset"] for x, y in zip(got, got[1:], strict=False))


def test_mixed_stream_with_offset_and_path():
    a = record()
    got = rows(a + gzip.compress(a) + a, offset=100, path="p")
    assert [r["is_gzip"] for r in got] == [False, True, False] and got[0]["record_offset"] == 100 and got[2]["file_path"] == "p"


def test_garbage():
    a = record()
    r = rows(b"XX" + a)[0]
    assert r["skipped_bytes"] == 2 and r["record_offset"] == 2 and messages(r) == ["2 bytes stand before the record"]
    assert rows(b"XX" + a, WarcOptions(syntax="ignore"))[0]["before"] == []
    bad = rows(b"GARBAGE" + a, WarcOptions.strict())
    assert len(bad) == 1 and bad[0]["error"]["msg"] == "no record starts here"
    only = rows(b"nothing to see here")
    assert len(only) == 1 and only[0]["error"]["kind"] == "no_record"
    tail = rows(a + a + b"trailing garbage")
    assert [bool(r["error"]) for r in tail] == [False, False, True]
    assert len(rows(a + b"1234")) == 1 and rows(b"abc") == []


@pytest.mark.parametrize(
    "end, said",
    [(b"\r\n\r\n", None), (b"", "too short"), (b"\n", "line feeds alone"), (b"\n\n", "line feeds alone"), (b"\r\n", "too short"), (b"abcd", "something else")],
)
def test_end_marks(end, said):
    r = rows(record(end=end))[0]
    assert (not messages(r)) if said is None else said in messages(r)[0]
    if said:
        assert rows(record(end=end), WarcOptions.strict())[0]["error"]["kind"] == "spec"
        assert messages(rows(record(end=end), WarcOptions.no_validation())[0]) == []


def test_versions():
    assert [(r["version"], r["version_major"], r["version_minor"]) for v in ("1.0", "1.1", "1.10", "2.0") for r in rows(record(version=v))] == [("1.0", 1, 0), ("1.1", 1, 1), ("1.1", 1, 1), ("2.0", 0, 0)]
    assert messages(rows(record(version="2.0"))[0]) == ["records of version 2.0 are not known"]
    assert rows(record(version="2.0"), WarcOptions.strict())[0]["error"]["kind"] == "spec"
    assert rows(gzip.compress(b"no archive at all\r\n"))[0]["error"]["msg"] == "no version line starts the record"
    lf = rows(record(eol="\n"))[0]
    assert messages(lf)[0].startswith("the version line") and [f["line"] for f in lf["before"]] == list(range(1, 8))[: len(lf["before"])]


def test_broken_gzip():
    z = gzip.compress(record(b"x" * 5000))
    assert rows(z[:-9])[0]["error"]["kind"] == "gzip"
    assert rows(z[:-8] + b"12345678")[0]["error"]["kind"] == "gzip"
    assert rows(z[:20] + b"\xff" * 10 + z[30:])[0]["error"]["kind"] == "gzip"


def test_lengths():
    assert rows(record(length=3) + record())[0]["block"] == b"hel"
    assert rows(record(length=500))[0]["block"].startswith(b"hello")
    assert rows(record(length="x"))[0]["block"] == b"" and rows(record(length=-1))[0]["block"] == b""
    cut = rows(record(b"x" * 100) + record(), WarcOptions(max_block_bytes=10))
    assert cut[0]["block"] == b"x" * 10 and cut[0]["block_truncated"] and cut[1]["block"] == b"hello" and not cut[1]["block_truncated"]
    skip = rows(record(b"x" * 100) * 3, with_block=False)
    assert [r["block"] for r in skip] == [None] * 3


def fields(text, syntax="warn"):
    found = Findings(WarcOptions(syntax=syntax))
    src = Bytes(io.BytesIO(text))
    try:
        h = parse_fields(src, found)
    except Failed as e:
        return None, [e.msg], b""
    return [(x["name"], x["value"]) for x in h], [(f["msg"], f["line"]) for f in found], src.take(100)


CASES = [
    (b"A: 1\r\nB: 2\r\n\r\nrest", [("A", "1"), ("B", "2")], []),
    (b"A: 1\nB: 2\r\n\r\nrest", [("A", "1"), ("B", "2")], ["the line doesn't end in a carriage return"]),
    (b"A 1\r\nB: 2\r\n\r\nrest", [("B", "2")], ["the line has no colon: A 1"]),
    (b"A: 1\r\nB: 2", [("A", "1"), ("B", "2")], ["the last line doesn't end"]),
    (b"", [], []),
    (b"A: 1\r\n  x\r\n\ty\r\nB: 2\r\n\r\nrest", [("A", "1 x y"), ("B", "2")], []),
    (b"A: 1\r\n  x\nB: 2\r\n\r\nrest", [("A", "1 x"), ("B", "2")], ["the line doesn't end in a carriage return"]),
    (b"A: 1\r\n  x", [("A", "1 x")], ["the header ends in a folded line"]),
    (b"A: 1\r\n", [("A", "1")], []),
    (b"A: 1\r\n\r", [("A", "1")], ["no empty line ends the fields"]),
    (b"A: 1\r\n\n rest", [("A", "1")], []),
    (b"no colon", [], ["the last line doesn't end", "the line has no colon: no colon"]),
    ("A: =?utf-8?q?caf=C3=A9?=\r\n\r\n".encode(), [("A", "café")], []),
]


@pytest.mark.parametrize("text, want, said", CASES)
@pytest.mark.parametrize("policy", ["ignore", "warn", "fail"])
def test_header_fields(text, want, said, policy):
    got, found, rest = fields(text, policy)
    if policy == "fail" and said:
        assert got is None and found == said[:1]
    else:
        assert got == want
        assert [m for m, _ in found] == (said if policy == "warn" else [])
        if text.endswith(b"rest"):
            assert rest.strip() == b"rest"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=60), st.booleans()), max_size=5), st.integers(1, 40))
def test_any_blocks_come_back(parts, piece):
    class Drip(io.RawIOBase):
        """A stream that gives little at a time."""

        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n=-1):
            out = self.data[self.at : self.at + min(piece, n)]
            self.at += len(out)
            return out

    data = b"".join(gzip.compress(record(b)) if z else record(b) for b, z in parts)
    got = list(frames(Drip(data), WarcOptions()))
    assert [r["block"] for r in got] == [b for b, _ in parts] and not any(messages(r) for r in got)
