import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from capturelake.functions.address import address
from capturelake.llm import duplicates, leakage, queries, survivor, tokens, truncation
from capturelake.llm.duplicates import Field
from capturelake.session import materialise


# ---- duplicates
def test_copies(spark):
    rows = [
        (1, "http://x.test/a", "s", None), (2, " HTTP://X.test/a/", "s", None), (3, "http://x.test/a", "t", None), (4, None, "s", None), (5, "", "s", None), (6, "#", "s", None),
        (7, "http://x.test/a?", "s", None), (7, "http://x.test/a?", "s", None), (8, "http://y.test/", None, None), (9, "http://y.test", None, None), (10, "http://y.test", "", None),
    ]
    df = spark.createDataFrame(rows, "id long, url string, source string, row_id int").withColumn("first_id", F.lit(0)).withColumn("k0", F.lit("z"))
    fields = [Field("url", address), Field("source")]
    assert sorted(tuple(r) for r in duplicates.copies(df, "id", fields).collect()) == [(1, 2), (1, 7), (1, 7), (8, 9)]
    assert {r["first_id"]: r["copies"] for r in duplicates.collapse(df, "id", fields).collect()} == {1: 4, 3: 1, 8: 2, 10: 1}
    assert duplicates.copies(df.limit(0), "id", fields).count() == 0


def test_tables_of_different_keys(spark):
    a = spark.createDataFrame([(1, "http://x.test/a", "s"), (2, "http://x.test/A/", "s"), (3, "http://x.test/a", "t")], "id long, url string, source string")
    b = spark.createDataFrame([(1, "http://x.test/a"), (2, "HTTP://x.test/a"), (3, None)], "key long, link string")
    c = spark.createDataFrame([(5, "s"), (4, "s"), (6, None), (7, None), (8, "S")], "id long, name string")
    tables = {"a": (a, "id", [Field("url", address), Field("source")]), "b": (b, "key", [Field("link", address)]), "c": (c, "id", [Field("name")])}
    assert sorted(tuple(r) for r in duplicates.copies_in(tables).collect()) == [("a", 1, 2), ("b", 1, 2), ("c", 4, 5), ("c", 6, 7)]
    assert sorted(tuple(r) for r in duplicates.collapse_in(tables).collect()) == [("a", 1, 2), ("a", 3, 1), ("b", 1, 2), ("c", 4, 2), ("c", 6, 2), ("c", 8, 1)]
    with pytest.raises(ValueError):
        duplicates.encode({"a": (a, "id", [Field("url", address), Field("source", F.lower)])})


def test_hot_group(spark):
    df = spark.range(30_000).selectExpr("id", "concat('http://x.test/', if(id % 3 = 0, 'hot', cast(id as string)), if(id % 2 = 0, '/', '')) as url")
    got = duplicates.copies(df, "id", [Field("url", address)])
    assert got.count() == 9_999 and got.select("first_id").distinct().count() == 1


# ---- survivors
def test_best_hits(spark, sources):
    rng = random.Random(3)
    rows = [(k, f"http://x.test/{rng.randrange(60)}" + rng.choice(["", "/", "#"]), rng.choice(["wayback", " CRAWL", "nobody"]), rng.choice(["20010101000000", "20020101000000", "2001", None, ""]), rng.choice([None, 0, -1, 5, 7]), rng.choice(["200", "", None]), "m", rng.choice([None, 0.5, 0.9, float("nan")])) for k in range(1, 500)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "hit_id long, url string, archive string, timestamp string, size long, status string, mimetype string, confidence double, zone string")
    got = {tuple(r) for r in survivor.best_hits(survivor.prepare(df, sources)).collect()}
    groups = defaultdict(list)
    for i, u, a, t, s, _, _, c in rows:
        known = a.strip().lower() in ("wayback", "crawl") and t in ("20010101000000", "20020101000000")
        instant = (t if a.strip().lower() == "wayback" else str(int(t) - 77_000_000)) if known else None  # Berlin is an hour ahead, the day before
        groups[u.rstrip("/#")].append((i, s if s and s > 0 else None, instant, None if c is None or c != c else c))
    best = lambda hs: min(hs, key=lambda h: (h[3] is None, -(h[3] or 0), h[2] is None, -int(h[2] or 0), h[0]))[0] if hs else 0
    want = {(min(h[0] for h in hs), best(hs), best([h for h in hs if h[1]]), best([h for h in hs if h[2]])) for hs in groups.values() if len(hs) > 1}
    assert got == want
    assert survivor.best_hits(survivor.prepare(df.limit(0), sources)).count() == 0


def test_precedence(spark, sources):
    rows = [(k, f"http://x.test/{k // 2}", "wayback", ["20010101000000", "20020101000000"][k % 2], 1, ["new", "old"][k % 2] if k < 8 else ["old", "new"][k % 2], "m", 0.5) for k in range(10)]
    rows += [(100, "http://x.test/q", "wayback", None, 1, "new", "m", 0.9), (101, "http://x.test/q", "wayback", "2001", 1, "old", "m", 0.1), (102, "http://x.test/q", "wayback", "", 1, "-", "m", 0.1)]
    df = spark.createDataFrame(rows, "hit_id long, url string, archive string, timestamp string, size long, status string, mimetype string, confidence double")
    hits = survivor.prepare(df, sources)
    assert survivor.learn_precedence(hits, "status") == {"new": 0, "old": 1}
    built = {r["group_hit_id"]: r for r in survivor.survivors(hits).collect()}
    assert (built[100]["status"], built[100]["from_precedence"], built[100]["hits"]) == ("old", True, 3)
    assert built[0]["status"] == "old" and not built[0]["from_precedence"]
    assert survivor.survivors(hits.limit(0)).count() == 0


HIT = "hit_id long, url string, archive string, timestamp string, size long, status string, mimetype string, confidence double"


def test_best_hits_by_precedence(spark, sources):
    rows = [(k, f"http://x.test/{k // 2}", "wayback", ["20010101000000", "20020101000000"][k % 2], 1, ["old", "new"][k % 2], "m", 0.5) for k in range(2, 8)]
    rows += [(k, "http://x.test/q", "wayback", "2001", 0 if k == 12 else 1, status, "m", 0.5) for k, status in ((10, "-"), (11, "old"), (12, "new"), (13, "old"))]
    rows += [(20, "http://x.test/r", "wayback", None, 1, "old", "m", 0.9), (21, "http://x.test/r", "wayback", "2001", 1, "new", "m", 0.5)]
    hits = survivor.prepare(spark.createDataFrame(rows, HIT), sources)
    found = lambda **x: {tuple(r) for r in survivor.best_hits(hits, **x).collect() if r["group_hit_id"] >= 10}
    assert found(stated=("confidence", "instant")) == {(10, 12, 11, 0), (20, 20, 20, 0)}  # states decide what confidence and instant leave equal
    assert found(stated=("confidence", "instant"), current=()) == found() == {(10, 10, 10, 0), (20, 20, 20, 0)}


def test_p6_found_learns_precedence(spark, tmp_path, sources, monkeypatch):
    rows = [(2 * g + k, f"http://x.test/{g}", "wayback", ["20010101000000", "20020101000000"][k], 1, "200", f"t/{g + k}", 0.5) for g in range(1200) for k in (0, 1)]
    spark.createDataFrame([(*r[:7], "d", r[7]) for r in rows], HIT.replace("confidence", "download_url string, confidence")).write.parquet(f"{tmp_path}/archive_hits.parquet")
    sources.write.parquet(f"{tmp_path}/archive_sources.parquet")
    learned = []
    learn = survivor.learn_precedences
    monkeypatch.setattr(survivor, "learn_precedences", lambda *a: learned.append(learn(*a)) or learned[-1])
    got = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert got == {(2 * g, 2 * g + 1, 2 * g + 1, 2 * g + 1) for g in range(1200)}
    assert learned == [{"status": {}, "mimetype": {f"t/{k}": k for k in range(1201)}}]  # of any number of values


def test_acyclic():
    def plain(edges):
        kept = defaultdict(set)
        for a, b in edges:
            met, todo = set(), [b]
            while todo:
                met.add(x := todo.pop())
                todo += kept[x] - met
            if a not in met:
                kept[a].add(b)
        return {a: bs for a, bs in kept.items() if bs}

    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(2, 12)
        edges = [tuple(rng.sample([str(k) for k in range(n)], 2)) for _ in range(rng.randint(1, 40))]
        assert survivor.acyclic(edges) == plain(edges)


# ---- tokens
@pytest.fixture(scope="module")
def enc():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.encoding(f.read())


def test_tree_concatenation(enc):
    rng = random.Random(7)
    parts = ["abc", " ", "  ", "\n", "'", "s", "'ll", "123", "!", "...", "日本語", "é", "́", "😀", "aaaa", "\t", "THE", "x" * 30, "!" * 20, "'" * 5, "\xa0", "\x1c", "9" * 20, " " * 25, "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        size = rng.choice([4, 7, 15, 30])
        assert tokens.encode_text(enc, text, size) == enc.encode_ordinary(text), (text, size)
        assert "".join(p for _, p in tokens.segments(text, size)) == text


@pytest.mark.parametrize("unit", ["a", "ab", "日本", " ", "!?", "1", "'"])
def test_long_runs(enc, unit):
    text = unit * 40_000
    assert tokens.encode_text(enc, text, 1000) == enc.encode_ordinary(text)


def test_texts_go_through_the_tree(spark, sf, enc, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    joins = []
    windows = tokens._concatenate
    monkeypatch.setattr(tokens, "_concatenate", lambda *a: joins.append(1) or windows(*a))
    assert [x.tolist() for x in tokens.encode_texts(enc, texts)] == [enc.encode_ordinary(t) if t else [] for t in texts]
    several = [t for t in texts if t and len(tokens.segments(t)) > 1]
    assert len(several) > len(texts) / 4 and len(joins) >= len(several) / 2
    kept = tokens.encode(spark.createDataFrame([(1, "ab", 5), (2, None, None)], "doc_id long, text string, n int"), keep=("n",))
    assert sorted(map(tuple, kept.collect())) == [(1, 5, enc.encode_ordinary("ab")), (2, None, [])]


def test_encode_table(spark, enc):
    texts = [None, "", " ", "Hello world", "x" * 5000, "word " * 3000, "日本語の文章。" * 900, "same", "same"]
    df = spark.createDataFrame([(k if k < 8 else 7, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = tokens.encode(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1  # one scan, in which each text is cut, coded and joined
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    want = sorted((k if k < 8 else 7, enc.encode_ordinary(t) if t else []) for k, t in enumerate(texts))
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == want
    assert all(enc.decode(ids) == (texts[k] or "") for k, ids in want)
    assert tokens.encode(df.limit(0)).count() == 0


# ---- leaks
ITEM = "Each visitor of Kelithlo receives a clumsy bookmark pays with 7 letters and returns the cartridge before the hidden cupboard closes"
SHORT = "one two three four"


def brute(docs, items, run):
    out = set()
    for i, t in items:
        w = leakage.words(t)
        grams = {tuple(w[j : j + run]) for j in range(len(w) - run + 1)}
        for d, x in docs:
            v = leakage.words(x)
            if any(tuple(v[j : j + run]) in grams for j in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def test_leaks_by_hand(spark):
    words = ITEM.split()
    docs = [
        (1, "so: " + " ".join(words[:13]) + " end"), (2, " ".join(words[:12])), (3, "<p>" + "&nbsp;".join(w.upper() for w in words[3:16]) + "</p>"), (4, ",\n".join(words[2:9] + ["other"] + words[9:20])),
        (5, "".join(c + "​" for c in " ".join(words[:14]))), (6, None), (7, ""), (8, "x " * 50_000 + " ".join(words[4:17]) + " y" * 50_000), (9, SHORT), (10, " ".join(words) + ". " + " ".join(words)),
    ]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, SHORT), (3, None), (4, ITEM.replace("Kelithlo", "Another"))], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(df, items).collect()}
    assert got == brute(docs, [(1, ITEM), (4, ITEM.replace("Kelithlo", "Another"))], 13)
    assert {d for d, i in got if i == 1} == {1, 3, 5, 8, 10}
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_leaks_random(spark, monkeypatch, seed):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 300)  # several shards
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randint(3, 40))) for k in range(50)]
    docs = []
    for d in range(200):
        body = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items)[1]
            n = rng.randint(8, 18)
            at = rng.randrange(max(1, len(source) - n))
            place = rng.randint(0, len(body))
            body[place:place] = source[at : at + n]
        docs.append((d, " ".join(body)))
    items = [(k, " ".join(w)) for k, w in items]
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items, 13)


def test_survivor_fields(spark, sources):
    rows = [
        (1, "http://x.test/q", "wayback", "20010101000000", 5, "200", None, "-", 0.2),
        (2, "http://x.test/q/", "CRAWL", "2001", 0, "404", "a/b", "http://d.test/2", 0.9),
        (3, "http://X.test/q", "nobody", "20020101000000", -1, "-", "", None, None),
        (4, "http://x.test/r", None, "", None, None, None, None, None),
        (5, "http://x.test/s", "wayback", "20010101000000", 1, None, "t/new", None, 0.5), (6, "http://x.test/s", "wayback", "20020101000000", 1, None, "t/old", None, 0.5),
        (7, "http://x.test/t", "wayback", "2001", 1, None, "t/new", None, 0.9), (8, "http://x.test/t", "wayback", "2001", 1, None, "t/old", None, 0.1),
    ]
    df = spark.createDataFrame(rows, "hit_id long, url string, archive string, timestamp string, size long, status string, mimetype string, download_url string, confidence double")
    built = {r["group_hit_id"]: r.asDict() for r in survivor.survivors(survivor.prepare(df, sources)).collect()}
    want = {"url": "http://x.test/q/", "archive": "CRAWL", "timestamp": "20010101000000", "instant": 978307200, "size": 5, "status": "404", "mimetype": "a/b", "download_url": "http://d.test/2", "confidence": 0.9}
    assert {k: built[1][k] for k in want} == want and built[1]["hits"] == 3
    assert {k for k, v in built[4].items() if v not in (None, False)} == {"group_hit_id", "hits", "url"}
    assert (built[7]["mimetype"], built[7]["mimetype_from_precedence"], built[7]["from_precedence"]) == ("t/old", True, False)


# ---- truncation
@pytest.mark.parametrize(
    "text, want",
    [
        (None, "blank"), (" \n​", "blank"), ("It is done.", "complete"), ("It is done. And th", "open"), ("Is it so?\n", "complete"), ('He said "no."', "complete"), ("古い文です。", "complete"), ("古い文で", "complete"), ("OK", "complete"),
        ("x y.\n\nPage 3 of 9", "open"), ("x y.\n* * *", "complete"), ("x y.\n-- the webmaster", "open"), ("x y.\n(c) 2004 Oblo", "open"), ("x y.\n=====", "complete"),
        ("<html><body><p>a b.</p></body></html>", "complete"), ("<html><body><p>a b. c", "cut"), ('text <a href="http://x.', "cut"), ("a.iso   01-Oct-1998 12:40   8229K", "complete"), ("a.iso   01-Oct-1998 12:40   8229K\nb.is", "open"), ("a.iso   01-Oct-1998 12:40   8229K\nb16.", "open"),
        ("2001-01-01T00:00:00Z 200 http://x.test/a 12 bytes", "complete"), ("2001-01-01T00:00:00Z 200 http://x.test/a 12 bytes\n2001-01-01T00:0", "cut"), ("2001-01-01T00:00:00Z 200 http://x.test/a 12 bytes\n2001-01-01T00:00:00Z 200 http://x.", "cut"),
        ("Please mirror it,", "open"), ("Fixed. Version 82.", "cut"), ("It was in 2005.", "complete"), ("la moitiÃ© du sommaire.", "complete"),
    ],
)
def test_endings(text, want):
    assert truncation.ending(text)[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("カウンターは2で止まり、サーバーは応答しなくなりました。カウンターは19で止", "open"), ("一覧には6件の版がありますが、開ける", "open"), ("古い文です。次", "open"), ("一覧には6件の版があります（開けるのは一つだけです。）", "complete"),
        ("プライバシーポリシー", "complete"), ("お問い合わせ", "complete"), ("古い、", "cut"), ("ဒီစာမျက်နှာသည်ဟောင်းသည်။", "complete"), ("หน้านี้ถูกเก็บไว้เมื่อปีที่แล้วและยังเปิดได้", "open"), ("x" * 65, "open"), ("Donaudampfschifffahrt", "complete"),
        ("http://x.test/" + "a/" * 60, "complete"), ("0f" * 64, "complete"), ("index.html", "complete"), ("🕸️", "complete"),
    ],
)
def test_single_words(text, want):
    assert truncation.ending(text)[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("<!-- " + "a note. " * 400 + "--><html><body><p>It ends. ", "cut"), ("<script>" + "x = 1;\n" * 400 + "</script>\n<body><p>It ends.", "cut"), ("A word. " * 400 + "The <body> tag is old.", "complete"),
        ('See <img src="data:image/png;base64,' + "QUJD" * 2000, "cut"), ("a.iso   01-Oct-1998 12:40   8229K\n" + "b" * 17_000, "open"),
        ('See <img alt="' + "a word " * 800, "cut"), ("<!-- " + "n" * 3000 + " -->\n<html><p>It ends.", "cut"),
        ("Read me.\n- copy the fi", "open"), ("Read me.\n--copy the fi", "open"), ("Read me.\n-- ", "open"),
    ],
)
def test_endings_of_whole_texts(text, want):
    assert truncation.ending(text)[0] == want


def test_measures(spark):
    text = 'a"b\\<&>\n\té😀'
    import html
    import json

    row = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in truncation.measures(F.col("t")).items()]).first()
    assert row["characters"] == len(text) and row["utf8_bytes"] == len(text.encode()) and row["utf16_units"] == len(text.encode("utf-16-le")) // 2
    assert row["json_characters"] == len(json.dumps(text, ensure_ascii=False)) - 2 and row["html_characters"] == len(html.escape(text, quote=False)) + 5
    assert row["crlf_bytes"] == len(text.replace("\n", "\r\n").encode())


def test_limits_and_verdicts(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(9)).capitalize() + "."
    rows = []
    for k in range(600):
        text = " ".join(sentence() for _ in range(rng.randint(1, 14)))
        source = "limited" if k % 2 else "free"
        if source == "limited":
            text = text[:300]
        if k % 10 == 0:
            text += "\nThat is all for now folks"  # an unknown footer, on a tenth of the texts
        rows.append((k, source, text))
    rows += [(1000, None, "cut in the mid"), (1001, "free", None), (1002, "free", ""), (1002, "free", "twice cut he"), (1002, "free", "twice cut he")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, text string, lengths string")
    seen = materialise(truncation.inspect(df), "t")
    limits = {(r["source"], r["measure"]): r["limit"] for r in truncation.hidden_limits(seen).collect()}
    assert set(limits.values()) == {300} and {s for s, _ in limits} == {"limited"}
    judged = truncation.judge(seen).collect()
    cut = sorted(r["row_id"] for r in judged if r["cut"])
    want = [i for i, _, t in rows if t and not t.endswith((".", "folks"))]
    assert cut == sorted(want) and len(judged) == len([1 for r in rows if r[2]])
    empty = materialise(truncation.inspect(df.limit(0)), "t")
    assert truncation.judge(empty).count() == 0 and truncation.hidden_limits(empty).count() == 0


def test_two_limits_and_new_footers(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zetas"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(k, "a", (text(200))[: 500 if k % 3 else 300]) for k in range(300)] + [(1000 + k, "a", text(rng.randint(5, 70))) for k in range(300)]
    # a source with a footer that nothing else has, of which every fourth is cut inside it at the source's limit
    foot = lambda k: f"{text(rng.randint(4, 30))}\nVerbatim copy kept by the Oblo guild, leaf {1000 + k}"
    rows += [(2000 + k, "b", foot(k)) for k in range(300)]
    rows += [(3000 + k, "b", (text(60)[:203] + ".\nVerbatim copy kept by the Oblo guild, leaf 12345")[:250]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    seen = materialise(truncation.inspect(df), "t")
    limits = {(r["source"], r["limit"]) for r in truncation.hidden_limits(seen).collect()}
    assert {("a", 500), ("a", 300), ("b", 250)} <= limits
    cut = {r["row_id"] for r in truncation.judge(seen).collect() if r["cut"]}
    assert not {i for i in cut if 1000 <= i < 3000} and {3000 + k for k in range(20)} <= cut
    assert {k for k in range(300)} - cut <= {i for i, _, t in rows if t.endswith(".")}


def test_copies_are_no_footers(spark):
    opening = "This page is a mirror of the old archive, kept by volunteers since the host closed its doors "
    rows = [(k, "a", f"Text number {'x' * k}a is here.\nA second line of it is" + ("." if k % 2 else " here")) for k in range(300)]  # footers: distinct texts
    rows += [(1000 + k, "a", "The archive was saved.\nIts last line was cut in tra") for k in range(150)]  # copies of a cut text
    rows += [(2000 + k, "a", opening + "and word after word" [: 4 + k % 15]) for k in range(60)]  # one page cut at different places
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    cut = {r["row_id"] for r in truncation.judge(materialise(truncation.inspect(df), "t")).collect() if r["cut"]}
    assert cut == {i for i, _, _ in rows if i >= 1000}
