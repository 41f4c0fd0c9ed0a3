import base64
import gzip
import hashlib
import os

from readloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: y", "<p>é</p>"), (9, None, None), (8, "http://c/", ""),
    (1, "http://d/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n"), (2, "http://e/", "€" * 200_000), (4, "u", "€" * 200_000),
    (2**60 + 1, "v", "big id"), (2**60 + 3, "v", "big id"), (6, "http://f/", "x" * warc.CHUNK), (None, "n", "no id"),
]


def test_round_trip(spark, tmp_path):
    archives = warc.write(made(spark, ROWS).repartition(3), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.records(archives).collect()}
    assert len(got) == len(ROWS)
    first = {}
    for i, _, html in ROWS:
        first[html or ""] = min(first.get(html or "", i), i) if i is not None else i
    for i, _, html in ROWS:
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), digest(html))
        revisit = first[html or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", first[html or ""]) if revisit else ("response", None))


def test_chunks_carry_payload_and_digests(spark, tmp_path):
    archives = warc.write(made(spark, ROWS), f"{tmp_path}/w")
    rows = warc.read_chunks(archives).toPandas()
    assert rows.data.map(len).max() <= warc.CHUNK
    for i, _, html in ROWS:
        of = rows[rows.page_id.isna() if i is None else rows.page_id == str(i)].sort_values("chunk")
        if of.record_type.iloc[0] == "response":
            assert b"".join(of.data).decode() == (html or "")
            sha = hashlib.sha1()
            for data, so_far in zip(of.data, of.digest_so_far, strict=True):
                sha.update(data)
                assert so_far == base64.b32encode(sha.digest()).decode()
        assert of["last"].tolist() == [False] * (len(of) - 1) + [True]


def test_archives_are_gzip_of_records(spark, tmp_path):
    warc.write(made(spark, ROWS).coalesce(1), f"{tmp_path}/w").count()
    (name,) = os.listdir(f"{tmp_path}/w")
    data = gzip.decompress(open(f"{tmp_path}/w/{name}", "rb").read())
    assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID: <urn:uuid:") == len(ROWS)
    assert b"\r\nX: y" not in data.split(b"<p>")[0]


def test_least_bytes_and_no_rows(spark, tmp_path):
    archives = warc.write(made(spark, ROWS[:4]), f"{tmp_path}/w", least=1)
    assert sorted(r.record_type for r in warc.records(archives).collect()) == ["response"] * 3 + ["revisit"]
    assert warc.records(warc.write(made(spark, []), f"{tmp_path}/none")).count() == 0


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "a", "same")] * 2 + [(2, "b", "same")] * 2
    got = warc.records(warc.write(made(spark, rows), f"{tmp_path}/w")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id == 2) == [(2, "revisit", 1)] * 2
    assert [r.record_type for r in got if r.page_id == 1] == ["response"] * 2


def test_chunk_rows_are_bounded_and_in_order(spark):
    html = ["é" * 5000, None, "", "x" * 640, "y" * 64, "é" * 5000]
    pages = spark.createDataFrame([(i, f"u{i}", t, 7) for i, t in enumerate(html)], "page_id long, url string, html string, chunk int")
    rows = warc.chunk_rows(warc.roles(pages), size=64).collect()
    assert max(len(r.data) for r in rows) == 64
    joined, before = {}, None
    for r in rows:
        assert r.chunk == (before.chunk + 1 if before and not before.last else 0)
        joined[r.page_id] = joined.get(r.page_id, b"") + bytes(r.data)
        before = r
    assert before.last and joined == {str(i): b"" if i in (2, 5) else (t or "").encode() for i, t in enumerate(html)}
