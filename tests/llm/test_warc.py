import base64
import gzip
import hashlib
import io
import random
import time
import zlib

from tallymast.llm import queries, warc

from .conftest import FOLDER


def row(payload, **more):
    return {"record_id": "urn:page:1", "target_uri": "http://a/b c", "record_type": "response", "refers_to": None, "payload": payload, "payload_bytes": None, "payload_digest": None, **more}


def member(payload, **more):
    return gzip.compress(b"".join(warc.record(row(payload, **more), "2024-01-01T00:00:00Z")))


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip_in_small_reads(monkeypatch):
    rnd = random.Random(13)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x" * 100_000, rnd.randbytes(70_000)] + [rnd.randbytes(rnd.randrange(300)) for _ in range(50)]
    data = b"".join(member(p) for p in payloads)
    for chunk in (7, 1000, 1 << 18):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        rows = list(warc.records(io.BytesIO(data), True))
        assert [r["payload"] for r in rows] == payloads and all(r["verified"] for r in rows)
        assert [r["payload_digest"] for r in rows] == [sha(p) for p in payloads]
        assert rows[0]["target_uri"] == "http://a/b%20c" and rows[0]["record_id"] == "urn:page:1"
    for r in rows[::7]:  # every record can be read from its own offset
        assert next(warc.records(io.BytesIO(data[r["offset"] :]), True))["payload"] == r["payload"]


def test_public_gzip_reads_the_members():
    text = gzip.decompress(member(b"<p>one</p>") + member(b"two")).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "\r\n\r\n<p>one</p>\r\n\r\nWARC/1.1" in text and text.endswith("two\r\n\r\n")


def test_damage_is_reported_and_bounded():
    good = member(b"good")
    plain = gzip.decompress(good)
    wrong = gzip.compress(plain.replace(b"\r\n\r\ngood", b"\r\n\r\nevil"))
    short = gzip.compress(plain[:-8])
    long = gzip.compress(plain + plain)
    other = gzip.compress(b"no record\r\n\r\n")
    rows = list(warc.records(io.BytesIO(good + wrong + short + long + other + good)))
    assert [r.get("verified") for r in rows] == [True, False, None, None, None, True]
    assert [bool(r.get("error")) for r in rows] == [False, False, True, True, True, False]
    torn = list(warc.records(io.BytesIO(good + good[:-3])))
    assert torn[0]["verified"] and torn[-1]["error"] and len(torn) == 2
    flipped = bytearray(good)
    flipped[len(good) // 2] ^= 255
    assert list(warc.records(io.BytesIO(bytes(flipped) + good)))[-1]["error"]
    assert list(warc.records(io.BytesIO(b""))) == []


def test_a_large_record_is_inflated_in_pieces():
    start, size = time.time(), 40_000_000
    seen, members = 0, warc.Members(io.BytesIO(member(b"0123456789" * (size // 10))))
    members.open(), members.head(), members.head()
    for piece in members.take(size):
        seen += len(piece)
        assert len(members.out) + len(piece) <= 4 * warc.CHUNK
    assert seen == size and time.time() - start < 30


def test_query_against_plain_python(spark):
    df = queries.QUERIES["op13_warc"](spark, FOLDER)
    assert df.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    check(df.collect(), [(r["page_id"], r["html"]) for r in pages])


def check(rows, pages):
    last = {}
    for i, html in pages:
        last[html or ""] = max(last.get(html or "", i), i)
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages)
    for i, html in pages:
        payload, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), sha(payload))
        top = last[html or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == i else ("revisit", top))


def test_copies_revisit_the_last_one(spark, tmp_path):
    pages = [(1, "a"), (2, None), (3, "é" * 50), (4, "a"), (5, ""), (6, "b" * 3_000_000), (7, "a"), (8, "é" * 50)]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nWARC-Type: x", h, "x", "x", "x") for i, h in pages], "page_id long, url string, html string, sha string, payload string, same string").repartition(3)
    warc.write_archives(warc.revisits(df), str(tmp_path / "w"), archiveBytes="100")
    for path in (tmp_path / "w").glob("*.warc.gz"):  # plain members on disk
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")
    records = warc.read_archives(spark, str(tmp_path / "w"), payload="true", partitionBytes="1000")
    rows = records.collect()
    assert all(r["verified"] and r["error"] is None and r["target_uri"].startswith("http://h/") and "%0D%0A" in r["target_uri"] for r in rows)
    assert {r["record_id"]: (r["payload"] or b"").decode() for r in rows if r["record_type"] == "response"} == {"urn:page:5": "", "urn:page:6": "b" * 3_000_000, "urn:page:7": "a", "urn:page:8": "é" * 50}
    check(warc.pages_of(records).collect(), pages)
    big = warc.revisits(df, least_bytes=2).where("record_type = 'revisit'").collect()
    assert [(r["record_id"], r["refers_to"]) for r in big] == [("urn:page:3", "urn:page:8")]


def test_only_committed_archives_are_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    df = spark.createDataFrame([(1, "u", "one"), (None, None, "two"), (3, "u", "three"), (3, "u", "three")], "page_id long, url string, html string")
    warc.write_archives(warc.revisits(df), folder)
    (tmp_path / "w" / "part-of-a-failed-attempt.warc.gz").write_bytes(member(b"lost"))
    records = warc.read_archives(spark, folder)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.pages_of(records).collect()) == [(0, "response"), (1, "response"), (3, "response"), (3, "response")]
    warc.write_archives(warc.revisits(df), folder)  # appends
    assert warc.read_archives(spark, folder).count() == 8
    alien = tmp_path / "alien"
    alien.mkdir()
    (alien / "x.warc.gz").write_bytes(member(b"one") + zlib.compress(b""))
    assert [(r["payload_bytes"], bool(r["error"])) for r in warc.read_archives(spark, str(alien)).collect()] == [(3, False), (None, True)]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.revisits(none), str(tmp_path / "w"))
    assert warc.pages_of(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0
