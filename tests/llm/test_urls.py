from __future__ import annotations

from evidentia.llm import urls


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")


def judge(url):
    """(host, path, rule, verdict) by trying every entry."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = lambda h, p: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((r for r in urls.RULES if fits(*r[:2])), key=lambda r: len(r[0] + r[1]), default=None)
    listed = max((r for r in urls.LISTED if fits(*r[:2])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], (best or listed or (0, 0, "allow"))[2]


def test_against_every_entry(spark, small):
    made = ["http://a.example.org/es/1", "HTTP://A.EXAMPLE.ORG/en/12?x#y", "https://org/", "https://org", "x://com/fr/", "//com/fr/", None, "", "a://b://c/d", "http://notexample.org/es/", "http://spam-farm.example.com/x", "http://é.ÉX.com/de/ñ", "http://org./", "http://?q", "http://example.org/es/" + "x" * 100_000]
    rows = [(i, u, "h", None, "r", None) for i, u in enumerate(made + made[:3])] + [(None, made[0], None, None, None, None)]
    got = urls.url_filter(spark, pages(spark, rows), urls.default_entries(spark)).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, [(k, *judge(u)) for k, u, *_ in rows]))
    table = spark.read.parquet(f"{small}/pages.parquet")
    want = {r.page_id: judge(r.url) for r in table.select("page_id", "url").collect()}
    for r in urls.url_filter(spark, table, urls.default_entries(spark)).collect():
        assert want[r.page_id] == (r.host, r.path, r.rule, r.verdict)


def test_filter_has_no_false_negative_and_is_bounded(spark):
    entries = spark.range(5000).selectExpr("concat('h', id, '.net/') as entry")
    table, blocks = urls.bloom(entries, 5000)
    assert table.count() <= blocks <= urls.BLOCKS_MOST and blocks * urls.BITS >= 12 * 5000


def test_empty(spark):
    assert urls.url_filter(spark, pages(spark, []), urls.default_entries(spark)).count() == 0
    none = urls.default_entries(spark).limit(0)
    assert [r.verdict for r in urls.url_filter(spark, pages(spark, [(1, "http://org/", None, None, None, None)]), none).collect()] == ["allow"]
