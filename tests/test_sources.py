"""Charsets, files, web pages, streams and the driver's entry."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from leafspan.sources import charset, files, http
from leafspan.sources import html as H
from leafspan.streaming import page_stream, ring_stream

BODY = "content binary, content_type string"


@pytest.mark.parametrize(
    ("body", "kind", "text"),
    [
        (b"\xef\xbb\xbfa\xc3\xa9", None, "aé"),
        (b"\xff\xfea\x00", None, "a"),
        (b"\xfe\xff\x00a", None, "a"),
        (b"\xff\xfe\x00\x00a\x00\x00\x00", None, "a"),
        (b"A\xc3", None, "A�"),
        (b"", None, ""),
        (b"\xef", None, "�"),
        (b"\xe9", "text/html; charset=iso-8859-1", "é"),
        (b"\xcf\xf0", 'text/html; charset="windows-1251"', "Пр"),
        (b"\xc4\xe3", "text/html;CHARSET=gb2312", "你"),
        (b"\xef\xbb\xbfx", "text/html; charset=utf-8", "x"),
        (b"\xef\xbb\xbfx", "text/html; charset=iso-8859-1", "ï»¿x"),
        (b"\xff\xfea\x00", "text/html; charset=utf-16", "a"),
        (None, None, None),
    ],
)
def test_decode(spark, body, kind, text):
    df = spark.createDataFrame([(bytearray(body) if body is not None else None, kind)], BODY)
    assert df.select(charset.decode("content")).first()[0] == text


def test_unknown_charset(spark):
    df = spark.createDataFrame([(bytearray(b"x\xc3\xa9"), "text/html; charset=no-such")], BODY)
    assert df.select(charset.decode("content", on_unknown="null")).first()[0] is None
    assert df.select(charset.decode("content", on_unknown="utf-8")).first()[0] == "xé"
    with pytest.raises(PythonException, match="Invalid charset"):
        df.select(charset.decode("content")).collect()


def test_quoted_charset(spark):
    df = spark.createDataFrame([('a; charset=""',), ('a; charset="x"',), ("a",), (None,), ("charset=y; q=1",)], "content_type string")
    assert [r[0] for r in df.select(charset.header_charset()).collect()] == ['""', "x", None, None, "y"]


def test_files(spark, tmp_path):
    (tmp_path / "x.html").write_bytes("<p>é".encode())
    (tmp_path / "y.html").write_bytes(b"<p>\xe9")
    text = files.html_files(spark, f"{tmp_path}/x.html")
    assert text.first()["html"] == "<p>é"
    latin = files.html_bodies(spark, f"{tmp_path}/y.html", "text/html; charset=latin1")
    assert latin.select("html", "n_bytes").first() == ("<p>é", 4)
    urls = spark.createDataFrame([("https://www.x.com/a",), ("http://z.org/",), (None,)], "url string")
    assert [r[0] for r in urls.select(files.cache_name()).collect()] == ["x.html", "z.html", None]
    have, rest = files.with_cached(urls, text)
    assert have.select("html").first()[0] == "<p>é" and rest.count() == 2


def test_web_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hello")
    http.register(spark)
    urls = f"file://{tmp_path}/a.html\nfile://{tmp_path}/missing.html\n"
    df = spark.read.format("web_pages").option("urls", urls).option("urlsPerPartition", "1").load()
    rows = {r["url"].rpartition("/")[2]: r for r in df.withColumn("html", charset.decode("body")).collect()}
    assert rows["a.html"]["html"] == "<p>hello" and rows["a.html"]["error"] is None
    lost = rows["missing.html"]
    assert lost["error"] and lost["body"] is None and lost["endpoint_id"] == "unknown"


def test_page_stream(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, "u", None)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/in")
    q = H.parse(page_stream(spark, f"{tmp_path}/in"), columns=["local_name"]).where("local_name = 'p'")
    s = q.writeStream.format("memory").queryName("nodes_seen").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.table("nodes_seen").count() == 2


def test_ring_stream(spark, tmp_path):
    rows = [(i, "e", None, None, 7, 10 * i, f"2024-01-01 00:00:{i:02d}") for i in range(1, 20)] + [(99, None, "http://h/x", 5, None, 8, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "download_id bigint, endpoint_id string, url string, content_length bigint, expected_size int, total_bytes bigint, t string").withColumn("received_at", F.to_timestamp("t")).drop("t")
    df.where("download_id < 10").coalesce(1).write.parquet(f"{tmp_path}/s")
    df.where("download_id >= 10").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    stream = ring_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s"))
    s = stream.writeStream.format("memory").queryName("hints").outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination()
    got = {r["download_id"]: r["size_hint"] for r in spark.table("hints").collect()}
    assert got[99] == 5 and sorted(got) == [*range(1, 20), 99]
    # files may arrive in either order; whichever is first starts from the expected size
    assert [got[k] for k in (1, 2, 3)] == [7, 10, 15] or [got[k] for k in (10, 11, 12)] == [7, 100, 105]
