import pytest
from pyspark.sql import functions as F

from barloom.plans import intervals_at, ordered_scan
from helpers import d, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, as one account may."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("k"),
        (F.col("id") * 7919 % 3001).alias("t"),
        (F.col("id") * 31 % 17 - 8).alias("v"))


def brute(data, keys=1):
    """Number, running sum, min, max, min before and previous values, row by row."""
    out, groups = [], {}
    for k, t, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        seen = groups.setdefault(k, [])
        values = [x for _, x in seen if x is not None]
        now = values + ([v] if v is not None else [])
        out.append((k, t, v, len(seen) + 1, sum(now) if now else None, min(now, default=None),
                    max(now, default=None), min(values, default=None),
                    seen[-1][1] if seen else None, seen[-1][0] if seen else None))
        seen.append((t, v))
    return out


ARGS = dict(number="n", running={"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"),
                                 "mb": ("min_before", "v")}, previous={"pv": "v", "pt": "t"})


def same(df, slice_by):
    got = [tuple(r) for r in ordered_scan(df, ["k"], ["t"], slice_by=slice_by, **ARGS).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute([tuple(r) for r in df.collect()]), key=key)


@pytest.mark.parametrize("width", [1, 40, 10**6])
def test_scan_equals_brute_force_at_every_slice_width(spark, skewed, width):
    same(skewed, F.floor(F.col("t") / width))


def test_null_values_keys_and_slices(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, 5), ("a", 1, None), ("a", 2, None),
                                ("a", 3, 4), ("a", 4, -4)], "k string, t int, v int")
    same(df, F.when(F.col("t") > 2, F.col("t")))


def test_no_job_runs_while_the_plan_is_built(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan-plan", "")
    ordered_scan(skewed, ["k"], ["t"], slice_by=F.col("t"), **ARGS)
    assert not tracker.getJobIdsForGroup("scan-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_intervals_at_equal_brute_force(spark):
    facts = spark.createDataFrame(
        [(i % 290, "SH" if i % 3 else "SZ", d(f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}"))
         for i in range(300)] + [(900, None, d("2020-01-01")), (901, "SH", None)],
        "id int, market string, at date")
    spans = spark.createDataFrame(
        [("SH", "a", d("2019-01-01"), d("2020-03-15")), ("SH", "b", d("2020-03-16"), None),
         ("SZ", "c", d("2020-02-10"), d("2020-05-31")), ("SZ", "d", d("2020-05-01"), None),
         ("SH", "reversed", d("2020-06-01"), d("2020-01-01"))],
        "market string, name string, a date, b date")
    out = intervals_at(facts, spans, "market", "at", "a", "b", "hits").select(
        "id", "market", "at", F.sort_array(F.transform(
            F.coalesce("hits", F.array()), lambda s: s["name"])).alias("names")).collect()
    held = spans.collect()
    key = lambda r: (r[0], str(r[1]), str(r[2]), r[3])
    want = sorted(((f.id, f.market, f["at"], sorted(
        s.name for s in held if s.market == f.market and f["at"] and s.a <= f["at"]
        and (s.b is None or f["at"] <= s.b))) for f in facts.collect()), key=key)
    assert sorted((tuple(r) for r in out), key=key) == want
