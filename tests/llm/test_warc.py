import gzip
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import warc as w
from lecturelake.llm.oracles import ORACLES
from lecturelake.llm.queries import queries

RECORD = "record_id long, kind string, url string, date_ms long, http map<string,string>"


def test_query(spark, sf_dir, duck, agree):
    agree(queries()["op2_revisits"](spark, sf_dir), duck.sql(ORACLES["op2_revisits"]))


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#frag", "example.com/a?a=1&b=2"),
        ("https://example.com/a", "example.com/a"),
        ("https://www2.example.com:443", "example.com"),
        ("http://example.com:8080/A//", "example.com:8080/A"),
        ("http://example.com?ref=x", "example.com"),
        ("", None),
        ("http://", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(w.canonical_url(F.col("u"))).first()[0] == canonical


def resolved(spark, records, **how):
    return {r["record_id"]: (r["status"], r["response_id"], r["headers"]) for r in w.resolve(spark.createDataFrame(records, RECORD), **how).collect()}


def test_rules(spark):
    u = "http://a.b/x"
    out = resolved(spark, [
        (1, "response", u, 100, {"etag": '"1"', "content-type": "text/html", "x": "old"}),
        (2, "revisit", "https://www.a.b/x#y", 200, {"etag": 'W/"1"', "content-type": "no", "x": "new", "date": "d"}),
        (3, "revisit", u, 100, {"etag": '"1"'}),
        (4, "revisit", u, 300, {"etag": '"2"'}),
        (5, "revisit", u, 300, {"last-modified": "m"}),
        (6, "response", u, 400, {"last-modified": "m"}),
        (7, "response", u, 400, {"last-modified": "n"}),
        (8, "revisit", u, 500, {"last-modified": "n"}),
        (9, "revisit", u, 500, {"last-modified": "m", "etag": '"9"'}),
        (10, "revisit", None, 500, {"etag": '"1"'}),
        (11, "request", u, 500, {}),
    ])
    assert out[2] == ("resolved", 1, {"etag": 'W/"1"', "content-type": "text/html", "x": "new", "date": "d"})
    assert {k: v[0] for k, v in out.items()} == {2: "resolved", 3: "no-response", 4: "etag-mismatch", 5: "no-validator", 8: "resolved", 9: "date-mismatch", 10: "no-response"}
    assert out[8][1] == 7


@pytest.mark.parametrize("rows_per_slice", [1, 10, 100_000])
def test_hot_url_against_brute_force(spark, rows_per_slice):
    rng = random.Random(9)
    records = [(i, rng.choice(["response", "revisit", "revisit"]), rng.choice(["http://hot/"] * 5 + ["http://b/", ""]), rng.randint(0, 300), {"etag": '"e"'}) for i in range(400)]
    got = {k: v[1] for k, v in resolved(spark, records, rows_per_slice=rows_per_slice).items()}
    for i, kind, url, at, _ in records:
        if kind == "revisit":
            there = [(a, j) for j, k, v, a, _ in records if k == "response" and v == url != "" and a < at]
            assert got[i] == (max(there)[1] if there else None)


def test_burst_of_captures_at_one_time(spark, rows):
    """Many captures of one URL at few times are a row a time before they are ordered."""
    given = [(i, "response" if i % 3 == 0 else "revisit", "http://hot/", 100 + 10 * (i % 2), {"etag": '"e"'}) for i in range(600)]
    got = resolved(spark, given)
    late = max(i for i, kind, _, at, _ in given if kind == "response" and at == 100)
    assert got == {i: ("resolved", late, {"etag": '"e"'}) if at == 110 else ("no-response", None, None) for i, kind, _, at, _ in given if kind == "revisit"}


RECORDS = "record_id long, kind string, url string, date_ms long, http string, body string"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    """Bodies may hold what separates records, and what opens one."""
    body = "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nünï 你好"
    rows = [(i, "response", "http://a/", 1_700_000_000_123, "ETag: x\r\nX: 1\r\nx: 2", body * i) for i in range(1, 9)] + [(9, "revisit", "http://a/", 0, "ETag: x", None)]
    path = str(tmp_path / "w")
    w.write_warc(spark.createDataFrame(rows, RECORDS).coalesce(1), path, compression, records_per_file=4)
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]) == 3
    want = [(i, "response", "http://a/", 1_700_000_000_123, {"etag": "x", "x": "2"}, (body * i).encode()) for i in range(1, 9)] + [(9, "revisit", "http://a/", 0, {"etag": "x"}, b"")]
    assert sorted(map(tuple, w.read_warc(spark, path).collect())) == want
    assert sorted(map(tuple, w.read_warc(spark, path, bodies=False).collect())) == [(*r[:5], None) for r in want]


def record(kind, block, length=None, end=b"\r\n\r\n"):
    n = b"" if length is None else b"content-length : %d\r\n" % length
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://h/\r\n" + n + b"\r\n" + block + end


def test_files_of_other_makers(spark, tmp_path):
    """Members of gzip a record, records that hold no answer, binary bodies, lost lengths, cut files."""
    raw = b"HTTP/1.1 200 OK\r\nETag: q\r\n\r\n\xff\x00\r\n\r\nWARC/1.0\r\n"
    good = [record(b"warcinfo", b"software: x\r\n", 13), record(b"response", raw, len(raw)), record(b"request", b"GET / HTTP/1.1\r\n\r\n", 18)]
    lost = [record(b"resource", b"no length\r\n"), record(b"response", raw, len(raw))]
    files = {
        "a.warc": b"".join(good),
        "b.warc.gz": b"".join(map(gzip.compress, good)),
        "c.warc.gz": gzip.compress(b"".join(good))[:-9],
        "d.warc": b"".join(good)[:-25],
        "e.warc": b"".join(lost),
        "f.warc": b"",
        "g.warc.gz": b"\x1f\x8bbroken",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    kinds = lambda name: [r["kind"] for r in w.read_warc(spark, str(tmp_path / name)).collect()]
    assert kinds("a.warc") == kinds("b.warc.gz") == ["warcinfo", "response", "request"]
    assert kinds("c.warc.gz")[:2] in ([], ["warcinfo", "response"]) and kinds("d.warc") == ["warcinfo", "response"]
    assert kinds("e.warc") == ["resource", "response"] and kinds("f.warc") == kinds("g.warc.gz") == []
    r = w.read_warc(spark, str(tmp_path / "b.warc.gz")).where("kind = 'response'").first()
    assert r["http"] == {"etag": "q"} and bytes(r["body"]) == raw.split(b"\r\n\r\n", 1)[1]


def test_edges(spark, rows):
    none = spark.createDataFrame([], RECORD)
    assert w.resolve(none).count() == 0
    twice = [(1, "response", "http://a/", 1, {"etag": "x"}), (2, "revisit", "http://a/", 2, None)] * 2
    df = spark.createDataFrame(twice, RECORD)
    assert w.resolve(df).count() == 2
    assert rows(w.resolve(df.withColumn("status", F.lit("x")).withColumn("_r", F.lit(1)))) == rows(w.resolve(df))


def test_records_without_a_date(spark):
    out = resolved(spark, [
        (1, "response", "http://a/", None, {"etag": "x"}),
        (2, "revisit", "http://a/", 5, {"etag": "x"}),
        (3, "revisit", "http://a/", None, {"etag": "x"}),
        (4, "response", "http://a/", 7, {"etag": "x"}),
        (5, "revisit", "http://a/", None, {"etag": "x"}),
        (6, "revisit", None, None, {"etag": "x"}),
        (7, "revisit", "http://a/", 9, {"etag": "x"}),
        (8, "revisit", "http://none.dated/", None, {}),
    ], rows_per_slice=1)
    assert {k: v[:2] for k, v in out.items()} == {k: ("no-response", None) for k in (2, 3, 5, 6, 8)} | {7: ("resolved", 4)}


def test_pages_without_an_id(spark, tmp_path, agree):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a/", "x"), (2, "http://a/", "y"), (None, None, None)], "page_id long, url string, html string")
    w.write_warc(w.archive_of(pages), f"{tmp_path}/archive")
    out = w.resolve(w.read_warc(spark, f"{tmp_path}/archive"))
    assert sorted((r["record_id"] or 0, r["canonical_url"] or "") for r in out.collect()) == [(0, ""), (0, ""), (0, "a"), (0, "a"), (9, ""), (10, ""), (17, "a"), (18, "a")]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    agree(queries()["op2_revisits"](spark, str(tmp_path)), con.sql(ORACLES["op2_revisits"]))


@pytest.mark.parametrize("intervals", [4, 1000])
def test_odd_dates_leave_slices_even(spark, intervals):
    dates = [(1_700_000_000_000 + i * 1000,) for i in range(2000)] + [(0,), (None,), (7_000_000_000_000,)]
    found = w.sliced(spark.createDataFrame(dates, "date_ms long"), 50, intervals).collect()
    dated = sorted((r["date_ms"], r["_slice"]) for r in found if r["date_ms"] is not None)
    assert len(found) == 2003 and [x[1] for x in dated] == sorted(x[1] for x in dated)
    assert max(Counter(x[1] for x in dated).values()) <= max(150, 2000 // intervals + 50)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Records of all sizes: no file holds more bytes than the bound, unless it holds one record."""
    sizes = [10] * 300 + [3000] * 40 + [9000] * 12 + [90_000] * 3
    random.Random(1).shuffle(sizes)
    rows = [(i, "response", "http://a/", 0, "ETag: x", "b" * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, RECORDS).repartition(2)
    w.write_warc(df, f"{tmp_path}/w", "none", file_bytes=40_000, classes=(2000, 6000, 20_000))
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    held = [x.count(b"WARC-Record-ID") for x in files]
    assert sum(held) == len(sizes) and all(n == 1 or len(x) <= 40_000 for n, x in zip(held, files, strict=True))
    assert max(held) > 10
    got = {r["record_id"]: len(r["body"]) for r in w.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == dict(enumerate(sizes))
