import gzip

from civicframe.llm import queries
from civicframe.llm import warc_derive as W

HTML = '<html><head><title>A &amp; B</title></head><body><nav><a href="/x?a=1&amp;b=2">x</a></nav><article><p>Hé <a href="z">z</a></p></article></body></html>'


def made(html=HTML, url="http://a.example/p/q"):
    return W.response(url, html.encode(), "2024-01-02T03:04:05Z", "1")


def test_records_are_linked():
    raw = made()
    got = W.derive(raw)
    source, _ = W.parse(raw)
    meta, about = W.parse(got["metadata"])
    conv, text = W.parse(got["conversion"])
    assert got["problem"] is None
    assert meta["warc-refers-to"] == conv["warc-refers-to"] == source["warc-record-id"] == got["response_id"]
    assert conv["warc-concurrent-to"] == meta["warc-record-id"] == got["metadata_id"]
    assert meta["warc-refers-to-target-uri"] == "http://a.example/p/q" and meta["warc-refers-to-date"] == "2024-01-02T03:04:05Z"
    assert conv["warc-source-payload-digest"] == source["warc-payload-digest"] == got["payload_digest"]
    assert text.decode() == "x\nHé z" and W.digest(text) == got["text_digest"] == conv["warc-block-digest"]
    lines = about.decode().split("\r\n")
    assert "title: A & B" in lines and "outlink: http://a.example/x?a=1&b=2 L a/@href" in lines
    assert "outlink: http://a.example/p/z L a/@href" in lines
    assert "source-status: HTTP/1.1 200 OK" in lines and "source-header-Content-Type: text/html; charset=utf-8" in lines


def test_same_input_same_records_and_gzip():
    assert W.derive(made()) == W.derive(gzip.compress(made()))


def test_problems_are_named():
    raw = made()
    assert W.derive(b"")["problem"] == "no WARC header"
    assert W.derive(raw[:-20])["problem"] == "record cut short"
    assert W.derive(raw.replace(b"<nav>", b"<NAV>"))["problem"] == "block digest differs"
    assert W.derive(W.derive(raw)["metadata"])["problem"] == "not a response record"
    assert W.derive(gzip.compress(raw)[:-9])["problem"] == "broken gzip member"


def test_spark_round(spark):
    rows = [(1, "http://a/", HTML, "clash"), (1, "http://a/", HTML, ""), (None, None, None, None), (4, "http://b/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = W.apply(W.responses(pages)).collect()
    assert len(got) == 4 and all(r["problem"] is None for r in got)
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2]
    assert W.apply(W.responses(pages.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "page_id long, record binary")
    assert {r["problem"] for r in W.apply(bad).collect()} == {"no WARC header"}


def test_query_returns_whole_records(spark, tmp_path):
    queries.op9_warc_derive(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/records")
    rows = spark.read.parquet(f"{tmp_path}/records").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    for r in rows:
        meta, about = W.parse(bytes(r["metadata"]))
        conv, text = W.parse(bytes(r["conversion"]))
        assert meta["warc-refers-to"] == conv["warc-refers-to"] == r["response_id"] and conv["warc-concurrent-to"] == r["metadata_id"]
        assert about.count(b"outlink: ") == r["n_links"] and W.digest(text) == r["text_digest"]
