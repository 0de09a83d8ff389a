import random
import re
import string

import pytest
from pyspark.sql import functions as F

from capturelake.functions.address import address

BASE = "http://ex.test/a/b_c-d.html?x=1&y=2"
SAME = [
    " http://ex.test/a/b_c-d.html?x=1&y=2\n", "HTTP://EX.Test/A/b_c-d.HTML?X=1&Y=2", "http://ex.test/a/b_c-d.html?y=2&x=1", '"http://ex.test/a/b_c-d.html?x=1&y=2",',
    "(http://ex.test:80/a/b_c-d.html?x=1&amp;y=2)", "http://ex.test./a//b_c%2Dd.html/?x=1&&y=2#", "http://ex.te st/a/./b_c-d.htm%20l?x=1&y=2&", "<http://ex.test/a/%62_c-d.html?x=1&#38;y=2>",
    "http://ex.test/q/../a/b_c-d.html?x=1&y=2", " http://ex.test:080/a/b_c-d.html?x=1&y=2;", "http:///ex.test/a/b_c-d.html?x=1&y=2",
]
OTHER = [
    "https://ex.test/a/b_c-d.html?x=1&y=2", "http://www.ex.test/a/b_c-d.html?x=1&y=2", "http://ex.test:8080/a/b_c-d.html?x=1&y=2", "http://ex.test/a/b_c-d.html?x=1",
    "http://ex.test/a/b-c-d.html?x=1&y=2", "http://ex.test/a/b_c-d.html~?x=1&y=2", "http://ex.test/a/b_c-dhtml?x=1&y=2", "http://ex.test/a/b_c-d.html?x=1&y=2#top", "http://ex.test/a%2Fb_c-d.html?x=1&y=2",
]


def addresses(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string")
    return [r["a"] for r in rows.select("i", address(F.col("u")).alias("a")).orderBy("i").collect()]


def test_same_and_other(spark):
    base, *rest = addresses(spark, [BASE, *SAME, *OTHER])
    assert base == BASE
    assert rest[: len(SAME)] == [BASE] * len(SAME)
    assert BASE not in rest[len(SAME) :] and len(set(rest[len(SAME) :])) == len(OTHER)


def test_no_address(spark):
    assert addresses(spark, [None, "", " ", "#", "javascript:void(0)", "mailto:x@y.test", "about:blank", "ftp://x.test/", "http://", "x.test/a"]) == [None] * 10


@pytest.mark.parametrize("text, want", [("http://ex.test/\n", "http://ex.test"), ("http://ex.test/100%", "http://ex.test/100%"), ("http://ex.test/%C3%89", "http://ex.test/é"), ("http://ex.test/?", "http://ex.test")])
def test_forms(spark, text, want):
    assert addresses(spark, [text]) == [want]


@pytest.mark.parametrize(
    "text, want",
    [
        ("http://ex.test/a/b/c/d/e/f/g/h/../../../../../../../../z", "http://ex.test/z"), ("http://ex.test/?a=1&amp;amp;amp;b=2", "http://ex.test?a=1&b=2"), ("http://ex.test/?a=1&#38;#038;amp;b=2", "http://ex.test?a=1&b=2"),
        ("http://ex.test/&eacute;", "http://ex.test/é"), ("http://ex.test/&Eacute;&#xe9;", "http://ex.test/éé"), ("http://ex.test/a&ensp;&#32;b", "http://ex.test/ab"), ("http://ex.test/?a&unheardof;b", "http://ex.test?a&unheardof;b"),
    ],
)
def test_any_depth(spark, text, want):
    assert addresses(spark, [text]) == [want]


def test_long_text(spark):
    long = "http://ex.test/" + "a/" * 200_000 + "b"
    assert addresses(spark, [long, long.upper() + "/"]) == [long, long]


def respell(rng, url):
    out = url
    for _ in range(3):
        k = rng.randrange(7)
        if k == 0:
            out = rng.choice(["\t", " ", " ", "\n"]) + out + rng.choice(["  ", "\r\n"])
        elif k == 1:
            out = "".join(c.upper() if rng.random() < 0.3 else c for c in out)
        elif k == 2:
            at = rng.randrange(len(out) // 2, len(out))
            out = out[:at] + rng.choice(["\n", " ", "\t"]) + out[at:]
        elif k == 3 and re.search(r"/[a-z]", out[10:]):
            m = list(re.finditer(r"[a-z]", out))[-1]
            if "%" not in out[max(0, m.start() - 2) : m.start() + 1]:
                out = out[: m.start()] + f"%{ord(m[0]):02X}" + out[m.end() :]
        elif k == 4 and "?" not in out.strip():
            out = out.rstrip() + rng.choice(["/", "?", "#", "//"])
        elif k == 5:
            out = out.replace("&", "&amp;") if "&amp;" not in out else out
        elif not out.startswith('"'):
            out = '"' + out + '"'
    return out


def test_random_spellings(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    pairs = []
    for _ in range(400):
        url = f"http://{word()}.test/{word()}/{word()}.mid"
        if rng.random() < 0.5:
            url += f"?a={word()}&b={word()}"
        pairs.append((url, respell(rng, url)))
    got = addresses(spark, [p for _, p in pairs])
    assert [(a, p) for (a, p), g in zip(pairs, got) if a != g] == []


def test_climbs_of_any_depth(spark):
    cases = {"/a/b/c/d/e/../../../../../f": "/f", "/" + "a/" * 40 + "../" * 40 + "g/": "/g", "/a/../../b": "/b", "/a/..b/../c": "/a/c", "/../..c": "/..c"}
    df = spark.createDataFrame([(f"http://x.test{k}", f"http://x.test{v}") for k, v in cases.items()], "url string, want string")
    assert not [tuple(r) for r in df.select(address(F.col("url")).alias("got"), "want").collect() if r["got"] != r["want"]]
