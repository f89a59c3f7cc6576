import gzip
import random

import pytest

from tests.test_framing import record
from warcspark.operators import analytics as A
from warcspark.options import WarcOptions
from warcspark.sources import splits as S
from warcspark.sources.datasource import load


def member(data, level=6):
    return gzip.compress(data, level, mtime=0)


def whole(rng, n, nested=0):
    """An archive whose records hold noise, magic bytes, version lines and, stored as they are, other archives."""
    out = []
    for k in range(n):
        kind = rng.randint(0, 5)
        body = rng.randbytes(rng.randint(0, 3000))
        if kind == 0:
            body = b"\n".join([b"WARC/1.0", body, b"\x1f\x8b\x08" * 20, record(b"inner")])
        if kind == 1 and nested:
            body = whole(rng, nested)
        one = record(body)
        out.append(one if rng.random() < 0.2 else member(one, rng.choice([0, 6])))
        if rng.random() < 0.1:
            out.append(b"garbage WARC between")
    return b"".join(out)


def rows(df):
    return sorted((r.file_path, r.record_offset, r.record_size, r.skipped_bytes, len(r.validation), bytes(r.block or b""), str(r.error)) for r in df.collect())


def test_ranges_give_what_one_reader_gives(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "a").mkdir()
    for name, data in (("plain", whole(rng, 40)), ("nested", whole(rng, 30, 25)), ("empty", b""), ("noise", rng.randbytes(9000)), ("cut", whole(rng, 20)[:-40]), ("tail", whole(rng, 10) + b"x" * 3000), ("magic", whole(rng, 9) + b"\x1f\x8b\x08 is no member" + whole(rng, 9))):
        (tmp_path / "a" / f"{name}.warc.gz").write_bytes(data)
        # what follows a broken member isn't read by either
    broken = member(record(b"a" * 5000)) + member(record(b"b" * 9000, ))[:-20] + whole(rng, 20)
    (tmp_path / "a" / "broken.warc.gz").write_bytes(broken)
    want = rows(load(spark, str(tmp_path / "a")))
    for split in (3000, 1 << 20):
        assert rows(load(spark, str(tmp_path / "a"), split_bytes=split)) == want
    ranges = S.split_ranges(spark, [(str(tmp_path / "a" / "plain.warc.gz"), (tmp_path / "a" / "plain.warc.gz").stat().st_size)], split=4096).collect()
    assert len(ranges) > 8


def test_a_strict_reader_stops_where_it_stops_alone(spark, tmp_path):
    f = tmp_path / "g.warc"
    f.write_bytes(record(b"a" * 900) * 3 + b"GARBAGE" + record(b"b" * 900) * 30)
    for split in (None, 1000):
        with pytest.raises(Exception, match="no record starts here"):
            load(spark, str(f), WarcOptions.strict(), split_bytes=split).count()


def test_wrong_guesses_are_walked_again(tmp_path, monkeypatch):
    """An archive stored within a record: guesses within it are right by themselves, and no record of the file."""
    inner = b"".join(member(record(b"i%d" % k)) for k in range(200))
    data = member(record(b"first")) + member(record(inner), 0) + member(record(b"last"))
    f = tmp_path / "n.warc.gz"
    f.write_bytes(data)
    split = 2000
    guesses = [S.guess(str(f), k * split, (k + 1) * split) for k in range(-(-len(data) // split))]
    assert sum(g is not None for g in guesses) > 10
    o = WarcOptions()
    walks = [(k, 0 if k == 0 else g, *(S.walk(str(f), 0 if k == 0 else g, (k + 1) * split, o) if k == 0 or g is not None else (None, None, None))) for k, g in enumerate(guesses)]
    starts = [len(member(record(b"first"))), len(data) - len(member(record(b"last")))]
    assert S.chain(str(f), 0, split, walks, o) == [(0, starts[1]), (starts[1], None)]


def test_guesses_are_found_at_every_place(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "_PROOF", 120)
    for before in range(0, 120, 3):
        for one in (member(record(b"x")), record(b"x")):
            f = tmp_path / "p"
            f.write_bytes(b"\x1f\x8b\x08WARC/1." + b"-" * before + b"\n" + one)
            at = 11 + before
            assert S.guess(str(f), 4, 1000) == at and S.guess(str(f), 4, at) is None and S.guess(str(f), at, 1000) == at and S.guess(str(f), at + 1, 1000) is None


def test_index_cuts(spark, tmp_path):
    f = tmp_path / "i.warc"
    f.write_bytes(record(b"y" * 1000) * 50)
    (tmp_path / "other.warc").write_bytes(record(b"z"))
    A.index(load(spark, str(f))).write.parquet(str(tmp_path / "index"))
    got = load(spark, f"{tmp_path}/*.warc", index=str(tmp_path / "index"), rangeBytes="10000")
    assert got.rdd.getNumPartitions() > 4 and got.count() == 51 == got.select("file_path", "record_offset").distinct().count()
