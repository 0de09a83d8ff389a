import gzip
import hashlib
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from capturelake.functions import captures as cap
from capturelake.functions import urls
from capturelake.operators import classify, extract, fulltext, index, merkle, reports, versions
from capturelake.operators.numbering import numbered
from capturelake.sources import readers, warc, writers


def one(spark, text, f, **more):
    row = spark.createDataFrame([(text, *more.values())], "t string" + "".join(f", {k} string" for k in more))
    return row.select(f(F.col("t"), *[F.col(k) for k in more]).alias("x")).first()["x"]


# ---- scalars
@pytest.mark.parametrize(
    "f, text, want",
    [
        (urls.domain, "http://User@Ex.Test:81/a", "user@ex.test:81"), (urls.domain, "Ex.Test/a/b", "ex.test"), (urls.surt, "http://www.a.www.b.test/x?y", "test,b,a)"),
        (urls.surt, "www.ex.test", "test,ex)"), (urls.urlkey, "http://www.Ex.test/A/b?c", "test,ex,www)/A/b"), (urls.extension_anywhere, "http://x.test/a.b/c", "b/c"),
        (urls.extension_of_file, "http://x.test/a.b/c", ""), (urls.extension_of_file, "http://x.test/c.TAR.gz?x=1.z", "gz"), (urls.extension_anywhere, "http://x.test/c.toolonger", ""),
        (urls.extension_of_text, "http://x.test/a.php?x=b.mp3", "mp3"), (urls.extension_of_text, "http://x.test/a", ""), (urls.merge_key, "http://X.test/a//", "http://x.test/a"),
        (urls.strip_scheme, "https://www.x.test/", "x.test/"), (urls.sanitise, 'a<b>:"c|?*. ', "a_b___c___"), (urls.without_fragment, "http://x.test/a#b#c", "http://x.test/a"),
        (urls.redacted, "http://x.test/a?Signature=1", "http://x.test/a"), (urls.redacted, "http://x.test/a?design=1", "http://x.test/a?design=1"),
        (cap.compact, "2001-02-03T04:05:06Z", "20010203040506"), (cap.label, "20010203040506", "2001-02-03"), (cap.stripped, "a<b>c</b>  d", "a c d"), (cap.code_fence_body, 'x ```json\n{"a":1}\n``` y', '{"a":1}'),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, text, f) == want


def test_resolve(spark):
    base = "http://x.test/a/b.html"
    cases = {"": None, "data:x": None, "javascript:x": None, "JavaScript:x": "JavaScript:x", "//y.test/z": "http://y.test/z", "https://z.test": "https://z.test", "/r": "http://x.test/r", "c/../d.gif": "http://x.test/a/d.gif", "?q": "http://x.test/a/b.html?q"}
    rows = spark.createDataFrame([(u, base) for u in cases], "u string, b string")
    assert {r["u"]: r["x"] for r in rows.select("u", urls.resolve(F.col("u"), F.col("b")).alias("x")).collect()} == cases


def test_urljoin(spark):
    rng = random.Random(4)
    parts = ["a", "b.x", "..", ".", "/", "c/", "d", "?q=1", "#f", "%20", "mailto:a@b", "http://o.test/z"]
    rows = [("http://h.test" + rng.choice(["", "/", "/a", "/a/", "/a/b/c.html", "/a/b?x#y"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for _ in range(1500)]
    rows = [(b, u) for b, u in rows if "//" not in u.split("?")[0].split("#")[0].replace("://", "") and not u.startswith("http") and "://" not in u]
    got = spark.createDataFrame(rows, "b string, u string").select("b", "u", urls.urljoin(F.col("b"), F.col("u")).alias("x")).collect()
    assert [r for r in got if r["x"] != urllib.parse.urljoin(r["b"], r["u"])] == [] and len(got) > 500


def brute_running(rows, order, value):
    out = {}
    for r in rows:
        before = [value(x) for x in rows if x[1] == r[1] and order(x) < order(r)]
        out[r[0]] = max(before) if before else None
    return out


def test_running_max_of_hot_keys(spark):
    from capturelake.operators.numbering import running_max

    rng = random.Random(6)
    rows = [(k, None if k % 50 == 0 else "hot" if k % 3 else f"u{rng.randrange(6)}", rng.randrange(40), rng.randrange(1000)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, u string, t int, v int")
    got = {r["id"]: r["m"] for r in running_max(df, ["u"], ["t", "id"], F.col("v"), "m").collect()}
    assert got == brute_running(rows, lambda x: (x[2], x[0]), lambda x: x[3])
    assert running_max(df.limit(0), ["u"], ["t", "id"], F.col("v"), "m").count() == 0


def test_hot_url_is_spread(spark):
    """A third of all captures are of one url; no range of the order has more than twice the mean."""
    from capturelake.operators.numbering import _ranges

    df = spark.range(1_000_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('u', id)) as url", "cast(id % 5000 as string) as timestamp", "cast(id % 7 as string) as content_hash")
    rows = df.select(F.struct("url").alias("_k"), F.struct("timestamp", "id").alias("_o"))
    sizes = [r["count"] for r in _ranges(rows, [F.col("_k"), F.col("_o")]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 1_000_000 / 4
    chain = versions.version_chain(df.limit(30_000))
    assert chain.count() == 30_000 and chain.filter("change = 'new'").count() == chain.select("url").distinct().count()


def test_sizes_and_magic(spark):
    df = spark.createDataFrame([(1, 1023), (2, 1536), (3, 47360), (4, 5 * 1024**2), (5, 3 * 1024**3)], "i int, n long")
    assert [r["x"] for r in df.orderBy("i").select(cap.human_bytes(F.col("n")).alias("x")).collect()] == ["1023 B", "1.5 KB", "46.2 KB", "5.0 MB", "3.00 GB"]
    df = spark.createDataFrame([(1, bytearray(b"MThd....")), (2, bytearray(b"<html>xx")), (3, bytearray(b"x")), (4, None)], "i int, b binary")
    rows = df.orderBy("i").select(cap.magic_type(F.col("b"), cap.MAGIC + cap.OLD_MEDIA).alias("m"), cap.plausible_content(F.col("b"), F.lit("mp3")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("midi", True), ("unknown", False), ("unknown", False), (None, False)]


def test_keyword_hits(spark):
    page = "A <b>cat</b> and a CAT, concat."
    hits = one(spark, page, lambda t: cap.keyword_hits(t, F.lit("cat"), 5))
    plain = "A cat and a CAT, concat."
    assert [h["position"] for h in hits] == [2, 12, 20] and all(plain[h["position"] : h["position"] + 3].lower() == "cat" for h in hits)
    assert one(spark, None, lambda t: cap.keyword_hits(t, F.lit("cat"))) is None
    assert one(spark, "no", lambda t: cap.keyword_hits(t, F.lit("c.t"))) == []
    assert one(spark, "x" * 300 + "cat" + "y" * 300, lambda t: cap.first_snippet(t, F.lit("CAT"))) == "x" * 100 + "cat" + "y" * 97


# ---- lookups, collapsing
@pytest.fixture(scope="module")
def cdx(spark):
    rows = [
        (1, "x.test", "http://x.test/a_b", "20010101000000", 200, "text/html", 10, "A"), (2, "x.test", "http://x.test/aXb", "20020101000000", 404, "text/html", None, "A"), (3, "sub.x.test", "http://sub.x.test/", "20030101000000", 200, "audio/midi", 30, ""),
        (4, "x.test", "http://x.test/a_b", "20040101000000", 200, "text/html; charset=u", 40, "B"), (5, "notx.test", "http://notx.test/", "20050101000000", 200, None, 50, None), (6, "x.test", "http://x.test/a_b", None, None, "text/html", 5, None),
    ]
    return spark.createDataFrame(rows, "id long, domain string, url string, timestamp string, status_code int, mime_type string, content_length long, digest string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_match_types(cdx):
    find = lambda *a, **k: ids(index.search(cdx, *a, limit=None, **k))
    assert find("http://x.test/a_b") == [1, 4, 6] and find("http://x.test/", "domain") == [1, 2, 4, 6] and find("x.test", "subdomains") == [1, 2, 3, 4, 6]
    assert find("http://X.test/a_b", "prefix") == [1, 2, 4, 6] and find("http://x.test/a_b", "prefix", strict=True) == [1, 4, 6]
    assert find("http://x.test/", "domain", status=404) == [2] and find("http://x.test/", "domain", status=0) == [1, 2, 4, 6]
    assert find("http://x.test/", "domain", first_year=2002, last_year=2004) == [2, 4]
    assert find("http://", "prefix", filters=["!mimetype:text/html.*", "=statuscode:200"]) == [3, 5] and find("http://", "prefix", filters=["!=digest:A"]) == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        index.filter_expression("nocolon")


def test_collapse(cdx):
    assert ids(index.collapse_digest(cdx, [F.col("timestamp"), F.col("id")])) == [1, 3, 4, 5, 6]
    # the limit comes first: of the three latest, none shares a digest
    assert ids(index.search(cdx, "http", "prefix", limit=3, collapse="digest", strict=True)) == [3, 4, 5]
    assert ids(index.limit_then_collapse(cdx, 5)) == [2, 3, 4, 5]
    assert ids(index.collapse_timestamp(cdx, 4, keys=["url"])) == [1, 2, 3, 4, 5, 6]
    assert ids(index.collapse_adjacent_digest(cdx)) == [1, 2, 3, 4, 5, 6]
    assert [tuple(r) for r in index.best_timestamps(cdx, "http://x.test/a_b").collect()] == [("20040101000000", 40), ("20010101000000", 10)]


def test_tiers_and_ingest(spark, cdx):
    assert ids(index.tiered(cdx, [F.col("id") > 100, F.col("id") > 4, F.col("id") > 1])) == [5, 6]
    raw = spark.createDataFrame([("http://a.test/", "", "2001", "", "7"), (None, "http://b.test/", "2002", "404", "x"), ("http://a.test/", "", "2001", "", "7")], "url string, original string, timestamp string, statuscode string, length string")
    rows = index.normalise_records(raw)
    assert sorted((r["url"], r["status_code"], r["content_length"], r["domain"]) for r in rows.distinct().collect()) == [("http://a.test/", 200, 7, "a.test"), ("http://b.test/", 404, 0, "b.test")]
    fresh = index.new_rows(rows, rows.filter("url like '%b%'"))
    assert [r["url"] for r in fresh.collect()] == ["http://a.test/"]


def test_numbered(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 1000)
    got = numbered(df, [F.col("v")], "n").select("v", "n").collect()
    assert all(r["v"] == r["n"] for r in got) and len(got) == 1000


def test_nearest(spark):
    caps = spark.createDataFrame([("u", "2001"), ("u", "2003")], "url string, timestamp string")
    asks = spark.createDataFrame([("u", "2000"), ("u", "2001"), ("u", "2002"), ("u", "2009"), ("v", "2001")], "url string, at string")
    assert sorted((r["url"], r["at"], r["found"]) for r in index.nearest(asks, caps).collect()) == [("u", "2000", None), ("u", "2001", "2001"), ("u", "2002", "2001"), ("u", "2009", "2003"), ("v", "2001", None)]


# ---- versions
def test_version_chains(spark):
    rows = [(1, "u", "2001", "A"), (2, "u", "2003", "A"), (3, "u", "2002", "B"), (4, "u", "2004", "A"), (5, "v", "2001", None)]
    df = spark.createDataFrame(rows, "id long, url string, timestamp string, content_hash string")
    by_time = {r["id"]: r["change"] for r in versions.version_chain(df).collect()}
    by_arrival = {r["id"]: r["change"] for r in versions.version_chain_by_arrival(df).collect()}
    assert by_time == {1: "new", 3: "content_update", 2: "content_update", 4: "unchanged"}
    assert by_arrival == {1: "new", 2: "unchanged", 3: "content_update", 4: "unchanged"}
    assert ids(versions.latest_capture(df)) == [4, 5]
    assert versions.capture_at(df, None, "u", "2002").first()["id"] == 3


def test_links(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "b", "c"), (4, "c", "a"), (5, "c", ""), (6, "c", None), (7, "c", "d"), (8, "d", "e")], "id long, source_url string, target_url string")
    assert {r["target_url"]: (r["links"], r["pages"]) for r in versions.in_degree(df).collect()}["b"] == (2, 1)
    assert sorted(tuple(r) for r in versions.two_hops(df).collect()) == [("a", "b", "c"), ("b", "c", "a"), ("b", "c", "d"), ("c", "a", "b"), ("c", "d", "e")]
    assert {r["url"]: r["depth"] for r in versions.reachable(df, "a", 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


# ---- Merkle
def brute_root(hashes):
    if not hashes:
        return hashlib.sha256(b"").hexdigest()
    level = hashes
    while len(level) > 1:
        level = level + [level[-1]] * (len(level) % 2)
        level = [hashlib.sha256((level[k] + level[k + 1]).encode()).hexdigest() for k in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1023, 1025, 2500])
def test_merkle_root(spark, n):
    hashes = [hashlib.sha256(str(k % 700).encode()).hexdigest() for k in range(n)]
    df = spark.createDataFrame([*enumerate(hashes), (10**6, None), (10**6 + 1, "")], "id long, h string")
    row = merkle.merkle_root(df, "h", [F.col("id")]).first()
    assert row["root"] == brute_root(hashes) and row["leaves"] == n


def test_merkle_verify(spark):
    good = hashlib.sha256(b"x").hexdigest()
    rows = [(good,), (good,), ("bad",), ("gone",), (None,), ("",)]
    records = spark.createDataFrame([(k, "u" if k < 2 else "v", "2001", h) for k, (h,) in enumerate(rows)], "id int, url string, timestamp string, content_hash string")
    blobs = spark.createDataFrame([(good, bytearray(b"x")), ("bad", bytearray(b"y"))], "content_hash string, body binary")
    got = merkle.verify(records, blobs).first()
    assert tuple(got)[:5] == (4, 2, 1, 1, False) and got["root"] == merkle.merkle_root(records, "content_hash", [F.col("id")]).first()["root"]
    assert tuple(merkle.verify(records, blobs, url="u").first()) == (2, 2, 0, 0, True, hashlib.sha256((good + good).encode()).hexdigest())
    assert tuple(merkle.verify(records, blobs, url="none").first()) == (0, 0, 0, 0, True, None)


# ---- extraction
PAGE = """<html><a href='x.mp3' rel="n"> <b>Song &amp; dance</b></a><img alt=1><img src="i.gif"><a href="/get?id=1">Download</a><script src=s.js></script>
<div data-file="//cdn.y.test/z.zip"><a href="?C=N;O=D">Name</a><embed src="m.swf"><a href="un closed"""


def test_parsed_extractors():
    assert [(x["url"], x["text"]) for x in extract.page_links(PAGE)][:3] == [("x.mp3", "Song & dance"), ("i.gif", "Download"), ("/get?id=1", "")] or extract.page_links(PAGE)[0] == {"url": "x.mp3", "text": "Song & dance", "rel": "n"}
    found = {(x["url"], x["category"], x["found_via"]) for x in extract.file_links(PAGE, "http://x.test/d/")}
    assert {("http://x.test/d/x.mp3", "audio", "a"), ("http://cdn.y.test/z.zip", "archive", "data-file"), ("http://x.test/get?id=1", "potential_download", "a"), ("http://x.test/d/m.swf", "flash", "embed")} <= found
    assert "http://x.test/d/x.mp3" in extract.listing_files(PAGE, "http://x.test/d/") and extract.listing_files("<a href=x>y</a>", "http://x.test/") == []
    for f in (extract.page_links, lambda p: extract.file_links(p, None), lambda p: extract.listing_files(p, None)):
        assert f(None) == [] and f("") == []


def test_native_extractors(spark):
    assert one(spark, '<a href="a"><A HREF="b"><a href="a">', extract.hrefs) == ["a", "b"]
    assert one(spark, '<a href="a.html"><a href="/b"><a href="//c.test/d"><a href="#x">', extract.links, b="http://x.test/p/q") == ["http://x.test/p/a.html", "http://x.test/b", "http://c.test/d", "http://x.test/p/q#x"]
    page = '<embed src="http://x.test/a.swf#t"> jwplayer("p").setup({ file: "/b/c.mp3" }) <source srcset="/d/../e.ogg">"contentUrl": "https://y.test/f.mp4"'
    assert one(spark, page, extract.embeds, b="http://x.test/") == ["http://x.test/e.ogg", "http://x.test/a.swf", "https://y.test/f.mp4", "http://y.test/f.mp4"] or set(one(spark, page, extract.embeds, b="http://x.test/")) >= {"http://x.test/a.swf", "http://x.test/b/c.mp3", "https://y.test/f.mp4"}
    assert one(spark, None, extract.embeds, b="http://x.test/") in (None, [])
    media = one(spark, '<img src="a.gif"><a href="/b.pdf"><div style="background-image: url(c.png)"><a href="d.tar.gz"><img data-lazy="e.webp"><param value="f.dcr">', extract.media_urls, b="http://x.test/p/")
    assert media == {"images": ["http://x.test/p/a.gif", "http://x.test/p/e.webp", "http://x.test/p/c.png"], "videos": [], "audio": [], "documents": ["http://x.test/b.pdf"], "archives": ["http://x.test/p/d.tar.gz"], "other": ["http://x.test/p/f.dcr"]}
    assert one(spark, '<img src="http://CDN.y.test/a"><a href="//x.test/b">', extract.asset_hosts, d="x.test") == ["cdn.y.test"]
    assert one(spark, "x \"http://a.test/b.mp3\" '/c/d.zip' {\"file\": \"e\"}", extract.file_urls) == ["http://a.test/b.mp3", "/c/d.zip", "e"]
    assert [(r["url"], r["nested"]) for r in one(spark, "<loc>http://x.test/a&amp;b</loc><loc>http://x.test/sitemap2.xml</loc>", extract.sitemap_locations)] == [("http://x.test/a&b", False), ("http://x.test/sitemap2.xml", True)]
    assert one(spark, "fetch('/api/x') baseURL: 'https://y.test/z' endpoint = 'rel'", extract.api_mentions, b="http://x.test/p") == ["http://x.test/api/x", "https://y.test/z"]
    assert one(spark, "<title>Index of /x</title>", extract.is_directory_listing) is True and one(spark, None, extract.is_directory_listing) is False
    assert one(spark, "Sitemap: http://x.test/s.xml\nDisallow: /", extract.robots_sitemaps) == ["http://x.test/s.xml"]


# ---- search
@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("adoption", "adopt"), ("controlling", "control"), ("agreed", "agre"), ("sky", "sky"), ("generalizations", "gener")])
def test_stem(word, want):
    assert fulltext.stem(word) == want


def test_search(spark):
    docs = spark.createDataFrame([(1, "The mirrored downloads of an archive"), (2, "archives: download it"), (3, "a download archive list"), (4, None), (5, "")], "doc_id long, text string")
    ix = fulltext.postings(docs)
    find = lambda q: sorted(r["doc"] for r in fulltext.search(ix, q).collect())
    assert find("download archive") == [1, 2, 3] and find('"download archive"') == [3] and find("mirror* OR list") == [1, 3] and find("nothing") == []
    for bad in ("a NOT b", "NEAR(a b)", "url:x", "OR a", "(a)"):
        with pytest.raises(ValueError):
            fulltext.search(ix, bad)
    assert one(spark, "aa bb cc dd", lambda t: fulltext.snippet(t, "cc", 1, 2)) == "...bb <b>cc</b>..."


# ---- classification
def test_classify(spark):
    assert one(spark, 'wp-content phpBB Powered by  Oblo Board 2. <meta name="generator" content="Zed 1">', classify.server_software) == "WordPress, phpBB Forum, Oblo Board 2, Zed 1" and one(spark, None, classify.server_software) == classify.NO_CLUE
    assert one(spark, "midi lyrics radio", classify.site_topic) == "music" and one(spark, "xyz", classify.site_topic) == "general"
    assert one(spark, "http://x.test/a/b/c.txt", classify.directories) == ["/", "/a/", "/a/b/"] and one(spark, "http://x.test", classify.directories) == ["/"]
    assert classify.glob_regex("*.mid") == r".*\.mid"
    caps = spark.createDataFrame([("d", "http://d/1999/a"), ("d", "http://d/2000/a")], "domain string, url string")
    assert sorted(r["predicted"] for r in classify.year_predictions(caps).collect()) == ["http://d/1997/a", "http://d/1998/a", "http://d/2001/a", "http://d/2002/a"]


# ---- readers and writers
def test_cdx_text(spark, tmp_path):
    f = tmp_path / "x.cdx"
    f.write_text(" CDX N b a m s k S\n\n# c\ntest,x)/ 20010101000000 http://x.test/ text/html 200 AAA 12\ntest,x)/b 2001 http://x.test/b - - - -\nshort line\ntest,x)/c 2001 http://x.test/c text/html abc D 1\n")
    rows = sorted(tuple(r) for r in readers.cdx_text(spark, str(f)).collect())
    assert rows == [("x.test", "http://x.test/", "20010101000000", 200, "text/html", 12, "AAA", "cdx_import"), ("x.test", "http://x.test/b", "2001", 200, "", 0, "", "cdx_import")]


def test_cdx_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://x.test/b", "2001", "text/html; charset=utf-8", 200, "H", 7), (2, "http://x.test/a", "2002", None, 404, "", 0)], "id long, url string, timestamp string, mime_type string, status_code int, content_hash string, content_size long")
    writers.write_cdx(rows, str(tmp_path / "o"), single=True)
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part*")).splitlines()
    assert text == [" CDX N b a m s k S", "test,x)/a 2002 http://x.test/a - 404 - 0", "test,x)/b 2001 http://x.test/b text/html 200 H 7"]
    back = sorted((r["url"], r["status_code"], r["content_length"]) for r in readers.cdx_text(spark, str(tmp_path / "o")).collect())
    assert back == [("http://x.test/a", 404, 0), ("http://x.test/b", 200, 7)]
    assert rows.transform(lambda d: writers.cdx_lines(d, compat=True)).filter("id = 1").first()["line"].split()[-3:] == ["-", "-", "7"]


def test_json_readers(spark, tmp_path):
    df = spark.createDataFrame([('[["original","timestamp","statuscode"],["http://x.test/","2001","-"],["http://x.test/b","2002","404"]]',), ("[]",), ("bad",)], "json string")
    assert sorted((r["url"], r["status_code"]) for r in readers.cdx_json(df).collect()) == [("http://x.test/", 200), ("http://x.test/b", 404)]
    f = tmp_path / "a.cdxj"
    f.write_text('test,x)/ 2001 {"url": "http://www.x.test/p", "mime": "text/html", "status": "200", "length": "5", "offset": "9", "filename": "w"}\nbad\ntest,y)/ 2001 {"url": "http://y.test/"}\n')
    rows = readers.cdxj(spark, str(f), "x.test", "/p").collect()
    assert [(r["url"], r["content_length"], r["warc_offset"], r["warc_file"]) for r in rows] == [("http://www.x.test/p", 5, 9, "w")]
    g = tmp_path / "b.jsonl"
    g.write_text('{"original": "http://x.test/", "timestamp": "2001"}\nnot json\n')
    assert [tuple(r)[:3] for r in readers.jsonl_captures(spark, str(g)).collect()] == [("http://x.test/", "2001", "")]
    shards = spark.createDataFrame([("a", "f1", 0, 1), ("c", "f2", 0, 1), ("com,x)", "f3", 0, 1), ("com,x)/b", "f4", 0, 1), ("d", "f5", 0, 1), ("e", "f6", 0, 1)], "key string, file string, offset int, length int")
    assert sorted(r["file"] for r in readers.shard_ranges(shards, "com,x)").collect()) == ["f2", "f3", "f4", "f5"]


def test_social_rows(spark):
    post = '{"id":"1","title":"t","score":3,"url":"http://i.test/a.jpg","preview":{"images":[{"source":{"url":"http://p.test/b?x=1&amp;y=2"}}]},"media_metadata":{"m":{"status":"valid","s":{"u":"http://g.test/c"}},"n":{"status":"failed","s":{"u":"no"}}}}'
    rows = readers.social_media_rows(spark.createDataFrame([(post,), ("{}",), (None,)], "json string")).collect()
    assert sorted((r["kind"], r["url"]) for r in rows) == [("direct", "http://i.test/a.jpg"), ("gallery", "http://g.test/c"), ("preview", "http://p.test/b?x=1&y=2")]


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = spark.createDataFrame([("http://x.test/", "20010203040506", 404, {"Content-Type": "text/html"}, bytearray(b"a\r\n\r\nb")), ("http://x.test/none", "2001", 200, {}, None)], "url string, timestamp string, status_code int, http_headers map<string,string>, body binary")
    rows.write.format("warc").mode("append").save(str(tmp_path / "w"))
    got = spark.read.format("warc").load(str(tmp_path / "w")).collect()
    assert [(r["url"], r["timestamp"], r["status_code"], bytes(r["body"]), r["http_headers"]["Content-Type"]) for r in got] == [("http://x.test/", "20010203040506", 404, b"a\r\n\r\nb", "text/html")]
    (tmp_path / "p.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    assert spark.read.format("warc").load(str(tmp_path / "p.warc")).count() == 0
    assert warc.slice_body(gzip.compress(b"h\r\n\r\nHTTP\r\n\r\nbody")) == "body" and warc.slice_body(b"only") == "only"


def test_blobs_and_header():
    for data in (b"", b"x" * 1000):
        assert writers.unpack(writers.pack(data)) == data
    assert writers.unpack(b"\x00" + gzip.compress(b"q")) == b"q" and writers.unpack(b"\x02raw") == b"raw"
    assert len(writers.header_bytes(b"MAGIC", 1, 2, 3, 4)) == 64


def test_derived_tables(spark):
    page = bytearray(b"<a href='/x'>link</a> mirrored words")
    rows = [(1, "http://x.test/", "2001", 200, {"Content-Type": "text/html"}, page, "crawl"), (2, "http://x.test/", "2001", 200, {"Content-Type": "text/html"}, page, "crawl"), (3, "http://x.test/b", "2002", 200, {}, page, "crawl")]
    caps = spark.createDataFrame(rows, "id long, url string, timestamp string, status_code int, http_headers map<string,string>, body binary, source string")
    tables = writers.derive_tables(caps)
    assert {n: df.count() for n, df in tables.items()} == {"records": 2, "blobs": 1, "versions": 2, "links": 1, "postings": 7}
    again = writers.derive_tables(caps, tables["records"], tables["blobs"])
    assert again["records"].count() == 0 and again["blobs"].count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("a", "1999xx"), ("a", "2001xx"), ("a", "pend"), ("b", None)], "domain string, timestamp string")
    line = reports.sparkline(df)
    assert sorted(tuple(r) for r in reports.fill_years(line).collect()) == [("a", "1999", 1), ("a", "2000", 0), ("a", "2001", 1)]
    assert {r["domain"]: r["counts"] for r in reports.sparkline_map(df).collect()} == {"a": {"1999": 1, "2001": 1}}
    empty = spark.createDataFrame([], "content_hash string, content_size long, compressed_size long")
    assert tuple(reports.dedupe_ratio(empty).first())[:4] == (0, 0, 0, 0)


# ---- targets, sites and first-seen rows
def test_targets_with_nulls(spark):
    rows = [(1, "mp3", "audio", 0.9, "200"), (2, None, "potential_download", None, None), (3, "", None, 0.2, "Defunct since 2004"), (4, "zip", "potential_download", 0.3, "dead")]
    df = spark.createDataFrame(rows, "id int, ext string, category string, c double, status string")
    ids = lambda test: sorted(r["id"] for r in df.filter(test).collect())
    assert ids(index.likely_file(F.col("ext"), F.col("c"))) == [1, 4]
    assert ids(index.wanted_target(F.col("ext"), F.col("category"), ["mp3"], ["mp3", "zip"])) == [1, 2]
    assert ids(index.status_among(F.col("status"), ["dead", "frozen", "defunct"])) == [3, 4]
    order = [r["id"] for r in df.orderBy(*index.by_confidence_and_category(F.col("c"), F.col("category"))).collect()]
    assert order == [1, 4, 3, 2] and df.limit(0).filter(index.likely_file(F.col("ext"), F.col("c"))).count() == 0


def test_first_seen_keys(spark):
    rows = [(1, "d", "http://x.test/a?1"), (2, "d", "http://x.test/b"), (3, "", "http://x.test/c"), (4, "", "http://x.test/d"), (5, None, "http://x.test/A"), (6, None, "http://x.test/A"), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, digest string, url string")
    ids = lambda out: sorted(r["id"] for r in out.collect())
    assert ids(index.first_by_digest_or_url(df, [F.col("id")])) == [1, 3, 5, 7]
    assert ids(index.first_by_file_name(df, [F.col("id")])) == [1, 2, 3, 4, 7] and ids(index.first_by_file_name(df, [F.col("id")], keep_case=True)) == [1, 2, 3, 4, 5, 7]
    assert index.first_by_file_name(df.limit(0), [F.col("id")]).count() == 0


def test_curated_sites(spark):
    sites = spark.createDataFrame([(2, "X.test", "games", "second"), (1, "x.TEST", "audio", "first"), (3, None, "none", "nobody")], "place int, domain string, category string, name string")
    domains = spark.createDataFrame([("x.test",), ("y.test",), (None,)], "domain string")
    assert sorted((str(r["domain"]), r["site_category"], r["site_name"]) for r in readers.curated_sites(domains, sites).collect()) == [("None", None, None), ("x.test", "audio", "first"), ("y.test", None, None)]
    assert readers.curated_sites(domains, sites.limit(0)).count() == 3


def test_prefix_inside_a_host(spark):
    caps = spark.createDataFrame([(1, "pages.x.test", "http://pages.x.test/a"), (2, "y.test", "http://y.test/"), (3, None, None)], "id int, domain string, url string")
    wishes = spark.createDataFrame([("a", "prefix", "http://pages."), ("b", "prefix", "http://pages.x.test/"), ("c", "domain", "Y.test"), ("d", "prefix", "http"), ("e", "prefix", None)], "wish string, kind string, pattern string")
    assert sorted(tuple(r) for r in versions.wish_matches(caps, wishes).collect()) == [("a", 1), ("b", 1), ("c", 2), ("d", 1), ("d", 2)]
    assert versions.wish_matches(caps.limit(0), wishes).count() == 0 and versions.wish_matches(caps, wishes.limit(0)).count() == 0


def test_sitemaps_to_the_fixpoint(spark):
    pages = spark.createDataFrame([(f"http://m.test/s{k}.xml", f"<loc>http://m.test/s{k + 1}.xml</loc><loc>http://m.test/p{k}</loc>") for k in range(9)], "url string, body string")
    found = {r["url"] for r in readers.known_sitemaps(pages, "http://m.test/s0.xml").collect()}
    assert found == {f"http://m.test/p{k}" for k in range(9)} | {f"http://m.test/s{k}.xml" for k in range(1, 10)}


def test_path_predictions(spark):
    caps = spark.createDataFrame([("d.test", "http://d.test/wp-content/x-1999.gif"), ("d.test", "http://d.test/files/"), ("e.test", "http://e.test/a"), ("e.test", None)], "domain string, url string")
    got = {(r["domain"], r["path"]): (r["confidence"], r["reason"]) for r in classify.path_predictions(caps).collect()}
    assert got[("d.test", "/wp-content/uploads/")] == (0.7, "default directory") and ("d.test", "/files/") not in got and ("e.test", "/files/") in got
    assert got[("d.test", "/wp-content/x-2000.gif")] == (0.6, "year series") and ("e.test", "/wp-content/uploads/") not in got
    assert classify.path_predictions(caps.limit(0)).count() == 0


def test_host_kinds(spark):
    cases = {"http://b.s3.us-east-1.amazonaws.com/k": "aws_s3", "https://storage.googleapis.com/b/k": "gcs", "http://CDN3.x.test/a": "generic_cdn", "http://uploads.x.test/a": "generic_upload", "http://x.test/cdn.": "other"}
    assert {u: one(spark, u, extract.host_kind) for u in cases} == cases


def test_forum_page(spark):
    page = '<b class="subject"> A </b><div class="post"><span class="name">Anonymous</span></div><div class="reply"><span class="postername">Ulf</span>01/02/98 (Mon) 10:20<img src="a.jpg"><a href="a.jpg">' + "<blockquote>more than <i>ten</i> letters</blockquote><blockquote>short</blockquote>"
    f = one(spark, page, extract.forum_fields)
    assert (f["subjects"], f["posts"], f["images"], f["names"], f["dates"], f["replies"]) == (["A"], 3, 1, ["Ulf"], ["01/02/98 (Mon) 10:20"], ["more than ten letters"])
