import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from capturelake.functions.values import clean_value, to_bigint, to_boolean, to_double, to_timestamp
from capturelake.operators.history import OPEN_END, version_history
from capturelake.operators.orphans import Reference, orphan_counts, orphan_rows
from capturelake.operators.skew import balanced_summary, fragment_replicate_join, plan_loads
from capturelake.operators.widen import cells_of, widen


# ---- a few keys holding most rows
def skewed(spark, n=6000):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", f"u{rng.randrange(500)}" if rng.random() < 0.9 else None, rng.randrange(100)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, u string, v int")


def test_loads_are_balanced(spark):
    rows, df = skewed(spark)
    plan = plan_loads(df, ["k"], tasks=8)
    assert plan.total == len(rows) and abs(sum(plan.loads) - len(rows)) < 1
    assert max(plan.loads) < 1.3 * len(rows) / 8
    hot = dict((k[0], t) for k, t in plan.heavy)["hot"]
    assert len(set(hot)) >= 4 and len(plan.heavy) <= 16


def test_summary(spark):
    rows, df = skewed(spark)
    got = {r["k"]: (r["rows"], r["items"], r["first"], r["last"]) for r in balanced_summary(df, ["k"], "u", first_last="v").collect()}
    want = defaultdict(lambda: [0, set(), []])
    for k, u, v in rows:
        want[k][0] += 1
        want[k][1] |= {u} - {None}
        want[k][2].append(v)
    assert got == {k: (n, len(us), min(vs), max(vs)) for k, (n, us, vs) in want.items()}
    assert balanced_summary(df.limit(0), ["k"], "u").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fragment_replicate_join(spark, how):
    rows, df = skewed(spark)
    df = df.withColumn("_task", F.lit(1)).withColumn("_tasks", F.lit("x")).withColumn("_k0", F.lit(2)).withColumn("id", F.monotonically_increasing_id())
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, w int")
    out = fragment_replicate_join(df, right, ["k"], ["id"], how=how)
    got = Counter((r["k"], r["w"]) for r in out.collect())
    want = Counter((r["k"], r["w"]) for r in df.join(right, "k", how).collect())
    assert got == want and out.columns == [*df.columns, "w"]
    with pytest.raises(ValueError):
        fragment_replicate_join(df, right, ["k"], ["id"], how="full")


# ---- history
def brute_history(rows):
    shots = sorted({(u, t, h.lower()) for u, t, h in rows if u is not None and t is not None and h})
    out = []
    for u in sorted({s[0] for s in shots}):
        runs, last = [], None
        for _, t, h in [s for s in shots if s[0] == u]:
            if h != last:
                runs.append((t, h))
            last = h
        out += [(u, h, t, runs[k + 1][0] if k + 1 < len(runs) else OPEN_END) for k, (t, h) in enumerate(runs)]
    return out


@pytest.mark.parametrize("block", [10**9, 86400, 7])
def test_history(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), f"200001{rng.randrange(1, 4):02}0000{rng.randrange(60):02}", rng.choice(["A", "a", "b", "c", "", None])) for _ in range(1500)]
    rows += [("one", "20000101000000", "x")] * 3
    df = spark.createDataFrame([(*r, i, "new") for i, r in enumerate(rows)], "url string, timestamp string, content_hash string, _block int, _t string")
    got = sorted(tuple(r) for r in version_history(df, block_seconds=block).select("url", "content_hash", "valid_from", "valid_to").collect())
    assert got == sorted(brute_history(rows))


def test_history_words_of_64(spark):
    rows = [("u", f"20000101{k // 3600:02}{k % 3600 // 60:02}{k % 60:02}", "ab"[(k // 70) % 2]) for k in range(1000)]
    df = spark.createDataFrame(rows, "url string, timestamp string, content_hash string")
    got = sorted(tuple(r) for r in version_history(df).select("url", "content_hash", "valid_from", "valid_to").collect())
    assert got == sorted(brute_history(rows)) and len(got) == 15


def test_history_forms_and_empty(spark):
    df = spark.createDataFrame([("u", "2000-01-01T00:00:00.000Z", "AA"), ("u", "20000101000000", "aa"), ("u", "2000-01-02T00:00:00+00:00", "b"), ("u", "nonsense", "c"), ("u", None, "c")], "url string, timestamp string, content_hash string")
    assert [tuple(r) for r in version_history(df).orderBy("valid_from").collect()] == [("u", "aa", "20000101000000", "20000102000000"), ("u", "b", "20000102000000", OPEN_END)]
    assert version_history(df.limit(0)).count() == 0


# ---- wide tables
ATTRS = [("page_title", "string"), ("word_count", "bigint"), ("quality", "double"), ("is_redirect", "boolean"), ("first_seen", "timestamp"), ("record_id", "string")]


def test_typed_values(spark):
    cases = {
        to_bigint: {"1,234": 1234, "12,5": None, "9e2": 900, "1225.0": 1225, "1.5": None, "+23": 23, "-7": -7, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "1e30": None, "0x": None, "--5": None, "1 2": None, "00012": 12, ".0": 0, "1e-1": None, "1e400": None},
        to_double: {".903": 0.903, "17.09e-2": 0.1709, "0.5.1": None, "1/3": None, "1,234": 1234.0, "1e400": None, "NaN": None, "5": 5.0},
        to_boolean: {"YES": True, "n": False, "1": True, "0": False, "10": None, "tru": None},
        to_timestamp: {"2017-07-07": True, "20150923063114": True, "Fri, 11 Feb 2005 11:51:08 GMT": True, "2009-09-18T04:36:17Z": True, "2009-02-30": None, "31 Foo 2001": None, "1234567890": None, "soon": None, "2009-02-28 25:00:00": None, "12 Feb 2005": True},
    }
    for f, want in cases.items():
        rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", f(F.col("t")).alias("v")).collect()
        assert {r["t"]: (None if r["v"] is None else True if f is to_timestamp else r["v"]) for r in rows} == want


def test_clean_values(spark):
    want = {' "a b" ': "a b", '""': None, '"n/a"': None, "N/A": None, " ": None, "-": None, "?": None, "\t x ": "x", '"': '"', '"q': '"q', None: None, "null": None, "--": "--"}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", clean_value(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == want


def test_widen(spark):
    rows = [
        (1, 5, "Page-Title", "first"), (2, 5, "pageTitle", "second"), (3, 5, "WORD COUNT", "1,000"), (4, 5, "word_count", "many"), (5, 5, "page_titles", "x"), (6, None, "page_title", "x"),
        (7, 6, " is.redirect ", '"true"'), (8, 6, "first_seen", "2001-02-03 04:05:06"), (9, 7, "word_count", "many"), (10, 8, "quality", "1e-3"), (10, 8, "quality", "1e-3"), (11, 9, None, "x"), (12, 9, "record_id", "own"),
        (13, 10, "page_title", "y" * 300_000),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "meta_id long, record_id long, key string, value string, _ix int, _entity string")
    attrs = spark.createDataFrame(ATTRS, "attr string, value_type string")
    wide = widen(df, attrs)
    got = {r["record_id"]: r.asDict() for r in wide.collect()}
    assert set(got) == {5, 6, 8, 9, 10}
    assert (got[5]["page_title"], got[5]["word_count"], got[5]["quality"]) == ("second", 1000, None)
    assert got[6]["is_redirect"] is True and str(got[6]["first_seen"]) == "2001-02-03 04:05:06"
    assert got[8]["quality"] == 0.001 and got[9]["record_id_value"] == "own" and len(got[10]["page_title"]) == 300_000
    assert dict(wide.dtypes)["word_count"] == "bigint" and dict(wide.dtypes)["first_seen"] == "timestamp"
    assert {tuple(r) for r in cells_of(wide).collect()} >= {(5, "page_title"), (5, "word_count"), (6, "first_seen")}
    assert widen(df.limit(0), attrs).count() == 0


def test_widen_hot_entity(spark):
    df = spark.range(20_000).selectExpr("id as meta_id", "if(id % 3 = 0, 1, id) as record_id", "'word_count' as key", "cast(id as string) as value")
    got = {r["record_id"]: r["word_count"] for r in widen(df, spark.createDataFrame(ATTRS, "attr string, value_type string")).collect()}
    assert got[1] == 19998 and got[2] == 2 and len(got) == 20_000 - 6667 + (1 % 3 == 0)


# ---- orphans
def test_orphans(spark):
    parents = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "id long, x string")
    children = spark.createDataFrame([(10, 1, "p1"), (11, 3, "p1"), (12, 3, "p2"), (13, None, "p1"), (14, 3, None), (14, 3, None)], "cid long, ref long, period string")
    refs = [Reference("c", children.withColumn("k1", F.lit(0)), "cid", [F.col("ref")], parents, [F.col("id")], F.col("period"))]
    assert sorted(r["row_id"] for r in orphan_rows(refs).collect()) == [11, 12, 14, 14]
    assert sorted((r["period"] or "", r["orphans"], r["keys"]) for r in orphan_counts(refs).collect()) == [("", 2, 1), ("p1", 1, 1), ("p2", 1, 1)]
    none = [Reference("c", children.limit(0), "cid", [F.col("ref")], parents, [F.col("id")])]
    assert orphan_rows(none).count() == 0 and orphan_counts(none).count() == 0
    alone = [Reference("c", children, "cid", [F.col("ref"), F.col("period")], parents.limit(0), [F.col("id"), F.col("x")])]
    assert orphan_rows(alone).count() == 3
