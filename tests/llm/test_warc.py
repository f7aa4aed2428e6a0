import base64
import gzip
import hashlib
import os
import random

import pytest

from agora.llm.warc import SEPARATOR, Record, digest, member, read_warc, record, salvage, write_warc

DATE = "2020-01-01T00:00:00Z"


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://a.example/{i}", f"<p>page {i}\r\n\r\nWARC/1.1\r\n {rng.random()}</p>" * rng.randint(1, 30)) for i in range(40)]
    rows += [(100 + i, None, rows[i % 3][2]) for i in range(20)]
    rows += [(50, "u\r\nx y", None), (51, "", ""), (None, "n", rows[0][2]), (None, "m", "alone"), (None, "m", "alone"), (52, "w", "é\x00\x1f\x8b\x08"),
             (53, "t", "twice"), (53, "t", "twice"), (54, "t", "twice"), (55, "big", "<b>x</b>\n" * 400_000)]
    return rows


def expected(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = first.get(h or "") if len(body) >= min_bytes else None
        to = None if to == i else to
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 6, 10_000])
def test_write_and_read_back(spark, tmp_path, min_bytes):
    rows = pages()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, first string, same int").repartition(3)
    folder = f"{tmp_path}/a"
    write_warc(table, folder, min_bytes, records_per_file=7)
    got = read_warc(spark, folder).collect()
    assert [r.gap for r in got] == [None] * len(rows)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows, min_bytes)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"} <= texts
    assert {r.url for r in got if r.page_id == 50} == {"u%0D%0Ax%20y"} and {r.url for r in got if r.page_id == 100} == {None}
    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert len(files) > 3
    whole = gzip.open(f"{folder}/{files[0]}").read()  # any gzip reader gets the records
    assert whole.startswith(b"WARC/1.1\r\n") and 1 <= whole.count(b"\r\nWARC-Type: ") <= 7


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").collect() == []


BODIES = [f"<p>body {i} {'x' * 50 * i}</p>".encode() for i in range(8)]
PLAIN = [record(i, "u", b, None, DATE) for i, b in enumerate(BODIES)]
PACKED = [member(r) for r in PLAIN]


def read(content):
    found = list(salvage(content))
    return [g.page_id for *_, g in found if isinstance(g, Record)], [(a, b, g) for a, b, g in found if isinstance(g, str)]


def joined(parts, separator=b""):
    starts, out = [], b""
    for p in parts:
        starts.append(len(out))
        out += p + separator
    return bytearray(out), starts


@pytest.mark.parametrize("separator", [b"", SEPARATOR])
def test_damaged_members_are_quarantined(separator):
    data, at = joined(PACKED, separator)
    assert read(bytes(data)) == (list(range(8)), [])
    data[at[3] + 40] ^= 255
    ids, gaps = read(bytes(data))
    end = at[3] + len(PACKED[3]) if separator else at[4]
    assert ids == [0, 1, 2, 4, 5, 6, 7] and [(a, b) for a, b, _ in gaps] == [(at[3], end)]
    data[at[4]] ^= 255  # its magic: one gap up to the next member that is whole
    ids, gaps = read(bytes(data))
    assert ids == [0, 1, 2, 5, 6, 7] and gaps[0][0] == at[3] and gaps[-1][1] in (at[5], at[4] + len(PACKED[4]))


def test_truncation_and_foreign_bytes():
    data, at = joined(PACKED)
    assert read(bytes(data[:-5])) == ([*range(7)], [(at[7], len(data) - 5, "gzip member end")])
    ids, gaps = read(b"junk\x1f\x8b\x08junk" + bytes(data))
    assert ids == [*range(8)] and [g[:2] for g in gaps] == [(0, 11)]
    assert read(b"") == ([], []) and read(b"no archive")[1] == [(0, 10, "version line")]
    assert read(bytes(data[:at[4]]) + b"\0" * 100 + bytes(data[at[4]:]))[0] == [*range(8)]


def test_plain_records():
    data, at = joined(PLAIN)
    assert read(bytes(data)) == ([*range(8)], [])
    wrong = bytes(data).replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(PLAIN[2].split(CRLF2, 1)[1]) - 4), b"Content-Length: 9999999\r\n\r\nHTTP", 1)
    shift = len(wrong) - len(data)
    ids, gaps = read(wrong)
    assert ids == [0, 1, 3, 4, 5, 6, 7] and gaps == [(at[2], at[3] + shift, "record end")]
    data[at[5] + len(PLAIN[5]) - 8] ^= 1  # a byte of the payload
    assert read(bytes(data)) == ([0, 1, 2, 3, 4, 6, 7], [(at[5], at[6], "payload digest")])
    assert read(bytes(joined([PLAIN[0], PACKED[1], PLAIN[2]])[0])) == ([0, 1, 2], [])


CRLF2 = b"\r\n\r\n"


def test_every_single_flipped_byte_costs_one_record_at_most():
    data, at = joined(PACKED[:3], SEPARATOR)
    for i in range(0, len(data), 3):
        broken = bytearray(data)
        broken[i] ^= 0x55
        ids, gaps = read(bytes(broken))
        assert len(ids) >= 2 and all(i in (0, 1, 2) for i in ids)
        if len(ids) == 2:
            assert gaps and gaps[0][0] <= i < gaps[-1][1]


def test_member_of_two_records_and_other_types():
    assert read(member(PLAIN[0] + PLAIN[1]) + PACKED[2])[0] == [2]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    kinds = [g.kind for *_, g in salvage(info + PLAIN[0])]
    assert kinds == ["warcinfo", "response"] and digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_damaged_archive_through_spark(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d")
    data, at = joined(PACKED)
    data[at[2] + 30] ^= 255
    with open(f"{tmp_path}/d/x.warc.gz", "wb") as f:
        f.write(data)
    with open(f"{tmp_path}/d/y.warc", "wb") as f:
        f.write(b"".join(PLAIN))
    got = read_warc(spark, f"{tmp_path}/d", payload=False)
    assert "payload" not in got.columns and got.where("gap is null").count() == 15
    gap = got.where("gap is not null").collect()
    assert [(r.start, r.end) for r in gap] == [(at[2], at[3])] and gap[0].file.endswith("x.warc.gz")
