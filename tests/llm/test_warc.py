"""op11: round trip against plain Python, and salvage of damaged archives."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import pytest

from scour.llm import op11_warc as W
from scour.llm.common import scratch, ship

SCHEMA = "page_id bigint, url string, html string"


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def _pages(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip_equals_brute_force(spark):
    rows = [(i, f"http://h/{i}", random.Random(i % 7).choice(["a", "é" * 50, "<html>\r\n\r\nWARC/1.1\r\n", "x" * 100_000])) for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "bad url\r\nX: y", "only"), (None, "u", "a"), (None, "u", "nobody"), (53, "u", "twice"), (53, "u", "twice")]
    want = []
    for page, _, html in rows:
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(ids, default=None)
        own = top is None or page == top
        want.append((page, len((html or "").encode()), _digest(html), "response" if own else "revisit", None if own else top))
    got = [tuple(r) for r in W.round_trip(_pages(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    least = [tuple(r) for r in W.round_trip(_pages(spark, rows), least=3).collect()]
    assert {r[0] for r in least if r[2] == _digest("a")} == {r[0] for r in rows if r[2] == "a"}
    assert all(r[3] == "response" for r in least if r[1] < 3)


def test_empty_table_and_clashing_columns(spark):
    assert W.round_trip(_pages(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "u", "x", "body!", 9, 2), (2, "u", "x", "", 9, 3)], SCHEMA + ", body string, first_id int, key int")
    assert {(r.page_id, r.record_type, r.refers_to) for r in W.round_trip(df).collect()} == {(1, "revisit", 2), (2, "response", None)}


def test_files_are_plain_gzip_members(spark):
    path = scratch(spark, "t")
    W.write_warc(_pages(spark, [(i, "u", f"text {i}") for i in range(30)]), path, row_bytes=500)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) > 1
    plain = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert plain.count(b"WARC-Type: response") == 30
    back = W.read_warc(spark, path, payloads=True)
    assert {bytes(r.payload).decode() for r in back.collect()} == {f"text {i}" for i in range(30)}


def _members(n=12):
    raw = [W.build_record(str(i), "u", (f"page {i} " * (20 + i)).encode(), None, False, "1970-01-01T00:00:00Z") for i in range(n)]
    return raw, [gzip.compress(r, 1, mtime=0) for r in raw]


def _read(data):
    out = list(W.salvage(data))
    places = [(s, n) for s, n, *_ in out]
    assert places == sorted(places)
    ids = [f["record_id"] for _, _, f, _ in out if f]
    return [int(i[10:-1]) for i in ids], [(s, n) for s, n, f, _ in out if f is None]


def test_salvage_flipped_byte_cut_and_garbage():
    raw, members = _members()
    starts = [sum(map(len, members[:i])) for i in range(len(members) + 1)]
    data = bytearray(b"".join(members))
    data[starts[4] + len(members[4]) // 2] ^= 255
    ids, gaps = _read(bytes(data))
    assert ids == [i for i in range(12) if i != 4]
    assert gaps == [(starts[4], len(members[4]))]
    ids, gaps = _read(b"junk\x1f\x8b\x08!" + b"".join(members[:3]) + members[3][:-9])
    assert ids == [0, 1, 2]
    assert [g[0] for g in gaps] == [0, 8 + starts[3]]
    # a record lost whole leaves no gap; two damaged neighbours make one
    data = bytearray(b"".join(members))
    for i in (6, 7):
        data[starts[i] + 30] ^= 1
    assert _read(bytes(data)) == ([i for i in range(12) if i not in (6, 7)], [(starts[6], starts[8] - starts[6])])


def test_salvage_plain_records_and_failed_digests():
    raw, members = _members(5)
    wrong = raw[2].replace(b"page 2", b"page X", 1)
    ids, gaps = _read(raw[0] + wrong + members[1] + raw[3] + gzip.compress(wrong) + raw[4])
    assert ids == [0, 1, 3, 4]
    assert gaps[0] == (len(raw[0]), len(wrong))
    assert len(gaps) == 2
    bad_length = raw[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert _read(bad_length + raw[2])[0] == [2]
    assert _read(b"") == ([], [])
    assert _read(b"\0" * 50) == ([], [(0, 50)])
    assert _read(W.EMPTY_MEMBER + members[0] + W.EMPTY_MEMBER)[0] == [0]


def test_salvage_any_damage_keeps_other_records():
    raw, members = _members(8)
    starts = [sum(map(len, members[:i])) for i in range(9)]
    r = random.Random(3)
    for _ in range(60):
        data = bytearray(b"".join(members))
        at = r.randrange(len(data))
        length = r.randint(1, 40)
        data[at:at + length] = bytes(r.randrange(256) for _ in range(length))
        hit = {i for i in range(8) if starts[i] < at + length and at < starts[i + 1]}
        ids, gaps = _read(bytes(data))
        assert set(range(8)) - hit <= set(ids)
        assert sum(n for _, n in gaps) <= sum(len(members[i]) for i in hit) + length


def test_long_member_ends_in_an_empty_one():
    body = W.build_record("1", "u", bytes(1 << 24), None, False, "1970-01-01T00:00:00Z")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = packer.compress(body) + packer.flush()
    assert member[-1] == 1
    assert _read(member + W.EMPTY_MEMBER)[0] == [1]


def test_gaps_are_logged_with_their_file(spark):
    _, members = _members(4)
    ship(spark)
    path = scratch(spark, "damaged").removeprefix("file:")
    import os
    os.makedirs(path)
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(members[0] + members[1][:40] + members[2])
    open(f"{path}/b.warc.gz", "wb").close()
    got = W.read_warc(spark, path).collect()
    assert [(r.start, r.length) for r in got if r.reason] == [(len(members[0]), 40)]
    assert len([r for r in got if r.record_id]) == 2
    assert all(r.path.endswith("a.warc.gz") for r in got)


@pytest.mark.parametrize("url,want", [(None, "urn:page:1"), ("http://a/b c", "http://a/b%20c"), ("a\r\nb", "a%0D%0Ab"), ("é", "é")])
def test_addresses_stay_on_one_line(url, want):
    assert W._uri(url, "1") == want
