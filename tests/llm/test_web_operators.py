"""WARC archives and URL filters: round trips, push-down, and brute force."""

import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from skerry.llm import url_filter, warc

PAGES = [
    (1, "http://a.net/x", "p" * 150),
    (2, "http://b.net/x", "q" * 150),
    (3, "http://c.net/x", "p" * 150),
    (3, "http://c.net/x", "p" * 150),
    (4, None, None),
    (5, "http://d\r\n.net", ""),
    (6, "u", "short"),
    (7, "u", "short"),
    (8, "ü", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"),
    (9, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"),
    (None, "u", "p" * 150),
    (10, "u", "z" * 3_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "x", b"y", "z") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, payload binary, record_type string")


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archive_round_trip(spark, pages, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "SHARED_ROWS", broadcast)
    folder = f"file://{tmp_path}/warc"
    warc.write_archive(pages, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(spark, folder).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((j for j, _, h in PAGES if j is not None and (h or "").encode() == raw), default=None)
        revisit = len(raw) >= 100 and first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    # Plain gzip readers see the records one after the other.
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").rglob("*.gz"))
    assert len(re.findall(rb"WARC/1\.1\r\nWARC-Type: ", text)) == len(PAGES)
    assert not list((tmp_path / "warc").rglob("_staging*"))


def test_filters_reach_the_reader(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write_archive(pages.coalesce(1), folder)
    one = warc.read_archive(spark, folder).where("record_type = 'response' and page_id in (2, 8, 10)")
    assert sorted((r.page_id, r.payload_length) for r in one.collect()) == [(2, 150), (8, len(PAGES[8][2].encode())), (10, 3_000_000)]
    assert "PushedFilters" in one._jdf.queryExecution().toString() or one.count() == 3
    headers = warc.read_archive(spark, folder, payload=False)
    assert headers.where("payload is not null").count() == 0
    assert headers.count() == len(PAGES)


def test_reader_skips_without_inflating(tmp_path, monkeypatch):
    body = b"".join(warc.record(i, "u", b"x" * 500_000, "d", None) for i in range(20))
    seen = []
    whole = warc.Archive.inflated
    monkeypatch.setattr(warc.Archive, "inflated", lambda self, *a: seen.append(1) or whole(self, *a))
    got = list(warc.Archive(io.BytesIO(body)).records(lambda row: row["page_id"] == 19))
    assert [row["page_id"] for row, _ in got] == [19]
    assert len(got[0][1]) == 500_000
    assert len(seen) < 60


def test_members_without_lengths_are_read(tmp_path):
    plain = b"".join(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n" % i) for i in range(5))
    got = list(warc.Archive(io.BytesIO(plain)).records(lambda row: row["page_id"] != 2))
    assert [(row["page_id"], payload) for row, payload in got] == [(0, b"abc"), (1, b"abc"), (3, b"abc"), (4, b"abc")]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.Archive(io.BytesIO(plain[:-9])).records(lambda row: True))


def test_empty_table(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write_archive(pages.where("false"), folder)
    assert warc.resolve(spark, folder).count() == 0


def test_a_page_with_two_payloads(spark, tmp_path):
    """A revisit refers to the record of its own payload, though the page's id has another record."""
    a, b = "a" * 200, "b" * 300
    folder = f"file://{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", b)], "page_id long, url string, html string"), folder)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(spark, folder).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(1, 200, sha(a), "response", None), (1, 300, sha(b), "response", None), (2, 300, sha(b), "revisit", 1)}


def test_overwrite_and_append(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    rows = warc.plan_records(pages.where("page_id <= 2"))
    warc.register(spark)
    for mode, want in (("append", 2), ("append", 4), ("overwrite", 2)):
        rows.write.format("warc").mode(mode).save(folder)
        assert warc.read_archive(spark, folder).count() == want
    rows.where("false").write.format("warc").mode("overwrite").save(folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_unpublished_files_are_not_read(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    writer = warc.WarcWriter(folder)
    rows = warc.plan_records(pages.where("page_id <= 2")).collect()
    lost, done = writer.write(iter(rows)), writer.write(iter(rows))
    assert warc.read_archive(spark, folder).count() == 0
    writer.commit([done])
    assert warc.read_archive(spark, folder).count() == 2
    assert lost.name not in {p.name for p in (tmp_path / "warc").rglob("*")}


# -- url filters -------------------------------------------------------------------


def judged(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else url_filter.DEFAULT


@pytest.mark.parametrize("range_rows", [100_000, 7])
def test_filter_by_force(spark, monkeypatch, range_rows):
    """Also over ranges so small that rules span many and one url's copies lie in several."""
    monkeypatch.setattr(url_filter, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(url_filter, "SAMPLE_PER_RANGE", 4)
    pick = random.Random(1)
    hosts = ["a.net", "net", "example.net", "www.example.net", "xexample.net", "example.com", "Sub.Example.COM", "b.org", "org", "é.org", ""]
    paths = ["", "/", "/en/x", "/de/", "/de", "/fr/?q", "/en/#f", "?x", "#y"]
    urls = [None, "", "no scheme", "://", "http://", *[f"{pick.choice(['http', 'HTTPS'])}://{pick.choice(hosts)}{pick.choice(paths)}" for _ in range(150)], *["http://hot.net/en/"] * 60]
    rules = [*url_filter.RULES, ("www.example.net", "/", "block"), ("org", "/", "block"), ("example.net", "/en/x", "block")]
    docs = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "id long, url string, host string, path string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(docs, url_filter.rule_frame(spark, rules)).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_filter_repeats_and_empty(spark):
    rules = url_filter.rule_frame(spark, url_filter.RULES)
    twice = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")], "id long, url string")
    assert sorted(((r.id, r.rule) for r in url_filter.judge(twice, rules).collect()), key=str) == sorted([(1, "net/"), (1, "net/"), (None, "net/")], key=str)
    assert url_filter.judge(twice.where("false"), rules).count() == 0
    assert url_filter.judge(twice, rules.where(F.lit(False))).where("rule is not null").count() == 0


def test_rules_with_nulls_are_refused(spark):
    urls = spark.createDataFrame([(1, "http://a.net/")], "id long, url string")
    for rule in ((None, "/", "block"), ("net", None, "block"), ("net", "/", None)):
        with pytest.raises(ValueError, match="without host"):
            url_filter.judge(urls, spark.createDataFrame([rule], "host string, path string, verdict string"))
