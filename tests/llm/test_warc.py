import base64
import hashlib
import io
import random
import time
import zlib
from pathlib import Path

import pyarrow.fs as pafs
import pytest

from afterbell.llm.warc import read_archives, record, salvage, warc_round_trip, write_archives

SCHEMA = "page_id long, url string, html string, reason string, uri string"


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by the rule."""
    ordered = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] is None, rows[k][1] or ""))
    first, out = {}, []
    for k in ordered:
        page_id, _, html = rows[k][:3]
        data = (html or "").encode()
        if len(data) >= least and data in first:
            out.append((page_id, len(data), sha1(data), "revisit", first[data]))
        else:
            if len(data) >= least:
                first[data] = page_id
            out.append((page_id, len(data), sha1(data), "response", None))
    return sorted(out, key=repr)


def made_pages(r, n):
    bodies = ["", "<p>one</p>", "<html>é中😀\r\n\r\nWARC/1.1\r\n</html>", "x" * 3000] + ["".join(r.choice("ab<>\r\n") for _ in range(r.randint(1, 400))) for _ in range(n // 4)]
    rows = [(i * 3, f"http://h{i % 5}/p?q={i} é\n", r.choice(bodies), "x", "u") for i in range(n)]
    rows += [(None, None, "<p>one</p>", "x", "u"), (None, "http://a", None, "x", "u"), (5, "", "only", "x", "u"), (-1, "http://b", "x" * 3000, "x", "u")]
    rows += [(7, "http://same", "equal rows", "x", "u")] * 40 + [(1, "http://other", "equal rows", "x", "u")] + [(8, "http://twice", "tw", "x", "u")] * 3
    return rows


@pytest.mark.parametrize("least", [0, 11])
def test_pages_come_back_from_archives(spark, least):
    rows = made_pages(random.Random(2), 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = warc_round_trip(df, least_revisit_bytes=least).collect()
    assert sorted((tuple(o)[:5] for o in out), key=repr) == plain(rows, least)
    assert {o.target_uri for o in out} >= {"urn:none", "http://h0/p?q=0%20%C3%A9%0A"}
    assert warc_round_trip(df.limit(0)).collect() == []


def test_many_equal_pages_and_files(spark, tmp_path, monkeypatch):
    from afterbell.llm import warc

    monkeypatch.setattr(warc, "HOT_ROWS", 20)
    rows = made_pages(random.Random(3), 200)
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = write_archives(df, f"file://{tmp_path}", compress=False, file_bytes=5_000)
    out = read_archives(manifest, with_payload=True).collect()
    assert sorted(((int(o.page_id) if o.page_id else None, o.payload_bytes, o.payload_digest, o.record_type, int(o.refers_to) if o.refers_to else None) for o in out), key=repr) == plain(rows)
    assert len({o.uri for o in out}) > 4 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert all(len(o.payload) == o.payload_bytes for o in out if o.record_type == "response")
    assert len({p.name for p in Path(tmp_path).iterdir() if p.suffix == ".part"}) == 0
    ids = [line for p in Path(tmp_path).iterdir() if p.suffix == ".warc" for line in p.read_bytes().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)


class Memory(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, count, at):
        return self.getbuffer()[at : at + count].tobytes()


def archive(r, n, packed):
    out, at = [], [0]
    for i in range(n):
        payload = bytes(r.choice(b"ab\r\n\x1f\x8b\x08") for _ in range(r.randint(0, 700)))
        data = record("response", f"{i:036d}", str(i), "http://x", sha1(payload), len(payload), payload, None, "2020-01-01T00:00:00Z")
        if packed if packed is not None else i % 2:
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = c.compress(data) + c.flush()
        out.append(data)
        at.append(at[-1] + len(data))
    return b"".join(out), at


def read(data):
    found = list(salvage(Memory(data)))
    covered = sorted({(a, b) for a, b, _, _ in found})
    assert not covered or covered[0][0] == 0 and covered[-1][1] == len(data)
    assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
    return {int(f["page-id"]): (a, b) for a, b, f, _ in found if "warc-type" in f}, [(a, b, f["reason"]) for a, b, f, _ in found if "reason" in f]


@pytest.mark.parametrize("packed", [True, False, None])
def test_damage_costs_only_the_records_it_touches(packed):
    r = random.Random(4)
    for _ in range(60):
        data, at = archive(r, 12, packed)
        damaged, hit = bytearray(data), set()
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(data))
            size = r.choice((1, 5, 900))
            for j in range(k, min(k + size, len(data))):
                damaged[j] ^= r.randint(1, 255)
        hit = {i for i in range(12) if damaged[at[i] : at[i + 1]] != data[at[i] : at[i + 1]]}
        found = list(salvage(Memory(bytes(damaged))))
        whole = {(at[i], at[i + 1]) for i in range(12) if i not in hit}
        records, gaps = ({(a, b) for a, b, f, _ in found if ("reason" in f) == gap} for gap in (False, True))
        # a change in a head that no check sees leaves a record readable
        assert whole <= records and all(any(at[i] <= a < at[i + 1] for i in hit) for a, _ in records - whole)
        assert {int(f["page-id"]): (a, b) for a, b, f, _ in found if (a, b) in whole} == {i: (at[i], at[i + 1]) for i in range(12) if i not in hit}
        assert sum(b - a for a, b in records | gaps) == len(data) and len(records & gaps) == 0


def test_bytes_lost_added_and_cut_off():
    r = random.Random(5)
    for packed in (True, False):
        data, at = archive(r, 6, packed)
        assert set(read(data[: at[5] + 40])[0]) == {0, 1, 2, 3, 4}
        assert read(data[: at[5] + 40])[1][0][:2] == (at[5], at[5] + 40)
        assert set(read(data[: at[2] + 9] + data[at[2] + 30 :])[0]) == {0, 1, 3, 4, 5}
        got, gaps = read(data[: at[3]] + b"junk WARC/1.1 \x1f\x8b\x08 junk" + data[at[3] :])
        assert set(got) == set(range(6)) and [(a, b) for a, b, _ in gaps] == [(at[3], at[3] + 22)]
        assert set(read(b"\x00" * 3_000_000 + data)[0]) == set(range(6))
    assert read(b"") == ({}, []) and read(b"nothing")[1] == [(0, 7, "no version line")]
    wrong = data.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert set(read(wrong)[0]) >= {1, 2, 3, 4, 5}


def test_reader_takes_several_records_in_a_member_and_digests_that_lie(spark, tmp_path):
    one = record("response", "a", "1", "http://x", sha1(b"aa"), 2, b"aa", None, "2020-01-01T00:00:00Z")
    lie = record("response", "b", "2", "http://x", sha1(b"ab"), 2, b"aa", None, "2020-01-01T00:00:00Z")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nfolded: a\r\n b\r\nContent-Length: 3\r\n\r\nhey\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "m.warc.gz").write_bytes(c.compress(info + one + b"junk" + lie + one) + c.flush())
    out = read_archives(spark.createDataFrame([(f"file://{tmp_path}/m.warc.gz",)], "uri string"), with_payload=True).collect()
    assert [(o.record_type, o.page_id, o.reason, o.payload) for o in out] == [
        ("warcinfo", None, None, bytearray(b"hey")), ("response", "1", None, bytearray(b"aa")), (None, None, "no version line", None), (None, None, "payload digest differs", None), ("response", "1", None, bytearray(b"aa")),
    ]
    assert pafs.FileSystem.from_uri(f"file://{tmp_path}")[0] is not None


@pytest.mark.parametrize("junk", [b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\x00", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n"])
def test_a_megabyte_of_junk_takes_linear_time(junk):
    data, at = archive(random.Random(6), 2, True)
    began = time.time()
    got, _ = read(data[: at[1]] + junk * (1_000_000 // len(junk)) + data[at[1] :])
    assert set(got) == {0, 1} and time.time() - began < 30
