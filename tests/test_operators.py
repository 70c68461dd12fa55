"""Skew-safe sequence operators equal plain window functions, including a hot key."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopy.operators.rangejoin import interval_join
from canopy.operators.sequence import asof_join, prev_row, trailing_agg


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}"
        # many equal timestamps on purpose
        ts = t0 + dt.timedelta(seconds=rnd.randint(0, 4 * 86400) // 30 * 30)
        rows.append((i, key, ts, float(rnd.randint(0, 1000)) / 10))
    return spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, v double")


def test_prev_and_next_row_equal_lag_lead(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    p = prev_row(df, ["k"], "t", {"id": "p"}, order_col="id", bucket_s=3600)
    n = prev_row(df, ["k"], "t", {"id": "n"}, order_col="id", bucket_s=3600, direction="next")
    exp = {r.id: (r.p, r.n) for r in ref.collect()}
    got_p = {r.id: r.p for r in p.collect()}
    got_n = {r.id: r.n for r in n.collect()}
    assert {i: (got_p[i], got_n[i]) for i in exp} == exp


def test_trailing_agg_equals_range_window(spark):
    df = _skewed(spark)
    look = 7200
    w = (Window.partitionBy("k").orderBy(F.unix_micros(F.col("t").cast("timestamp")))
         .rangeBetween(-look * 10**6, 0))
    ref = {r.id: (r.s, r.c) for r in df.select("id", F.sum("v").over(w).alias("s"),
                                                F.count("v").over(w).alias("c")).collect()}
    for bucket in (None, 1800.0):  # one copy per row, and four
        got = trailing_agg(df, ["k"], "t", "v", look, bucket_s=bucket)
        g = {r.id: (r.trailing_sum, r.trailing_cnt) for r in got.collect()}
        assert g.keys() == ref.keys()
        for i in ref:
            assert g[i][1] == ref[i][1]
            assert abs(g[i][0] - ref[i][0]) < 1e-6


def test_asof_backward_forward_strict_tolerance(spark):
    df = _skewed(spark)
    left = df.filter("id % 3 = 0").select("id", "k", "t")
    right = df.filter("id % 3 <> 0").select(F.col("id").alias("rid"), "k", F.col("t").alias("rt"))
    lrows = left.collect()
    rrows = right.collect()
    by_key = {}
    for r in rrows:
        by_key.setdefault(r.k, []).append((r.rt, r.rid))

    def expect(l, exact, forward, tol):
        cands = by_key.get(l.k, [])
        if forward:
            c = [x for x in cands if (x[0] >= l.t if exact else x[0] > l.t)]
            best = min(c, key=lambda x: (x[0], -x[1])) if c else None
        else:
            c = [x for x in cands if (x[0] <= l.t if exact else x[0] < l.t)]
            best = max(c) if c else None
        if best and tol is not None and abs((best[0] - l.t).total_seconds()) > tol:
            best = None
        return best[1] if best else None

    for exact, forward, tol in [(True, False, None), (False, False, None), (True, True, None),
                                (True, False, 600.0)]:
        got = asof_join(left, right, ["k"], "t", "rt", {"rid": "m"}, right_order="rid",
                        allow_exact=exact, tolerance_s=tol, bucket_s=5400.0,
                        direction="forward" if forward else "backward")
        g = {r.id: r.m for r in got.collect()}
        e = {l.id: expect(l, exact, forward, tol) for l in lrows}
        if forward:  # forward ties: smallest time, largest order among equals is not defined; compare times
            rt = {r.rid: r.rt for r in rrows}
            assert {i: (rt[v] if v is not None else None) for i, v in g.items()} == \
                   {i: (rt[v] if v is not None else None) for i, v in e.items()}
        else:
            assert g == e, (exact, forward, tol)


def test_interval_join_matches_nested_loop(spark):
    df = _skewed(spark)
    pts = df.select("id", "k", "t")
    iv = df.filter("id % 50 = 0").select(F.col("id").alias("iid"), "k", F.col("t").alias("s"),
                                          (F.col("t") + F.expr("INTERVAL 90 MINUTES")).alias("e"))
    got = interval_join(pts, iv, ["k"], "t", "s", "e", bucket_s=3600.0)
    exp = pts.alias("p").join(iv.alias("i"), (F.col("p.k") == F.col("i.k")) &
                              F.col("p.t").between(F.col("i.s"), F.col("i.e")))
    assert sorted((r.id, r.iid) for r in got.collect()) == sorted((r.id, r.iid) for r in exp.collect())
    anti = interval_join(pts, iv, ["k"], "t", "s", "e", bucket_s=3600.0, how="left_anti")
    assert anti.count() == pts.count() - exp.select("id").distinct().count()


def test_asof_last_values_equals_separate_asof_joins(spark):
    from canopy.operators.sequence import asof_last_values
    df = _skewed(spark)
    left = df.filter("id % 4 = 0").select("id", "k", "t")
    right = df.filter("id % 4 <> 0").select(
        F.col("id").alias("rid"), "k", F.col("t").alias("rt"),
        F.when(F.col("v") > 50, F.col("id")).alias("hi_id"),
        F.when(F.col("v") <= 50, F.col("id")).alias("lo_id"))
    got = asof_last_values(left, right, ["k"], "t", "rt", {"hi_id": "hi", "lo_id": "lo"},
                           right_order="rid", bucket_s=7200.0)
    a = asof_join(left, right.filter("hi_id IS NOT NULL"), ["k"], "t", "rt", {"hi_id": "hi"},
                  right_order="rid", matched_time=None)
    b = asof_join(left, right.filter("lo_id IS NOT NULL"), ["k"], "t", "rt", {"lo_id": "lo"},
                  right_order="rid", matched_time=None)
    exp = {r.id: [r.hi] for r in a.collect()}
    for r in b.collect():
        exp[r.id].append(r.lo)
    assert {r.id: [r.hi, r.lo] for r in got.collect()} == exp


def test_auto_bucket_splits_hot_key_and_stays_exact(spark):
    from canopy.operators.sequence import BUCKET_MIN_S, auto_bucket_s
    df = _skewed(spark)
    wide = auto_bucket_s([(df, "t")], ["k"])
    narrow = auto_bucket_s([(df, "t")], ["k"], target_rows=100)
    assert narrow < wide and narrow >= BUCKET_MIN_S
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = {r.id: r.p for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}
    got = prev_row(df, ["k"], "t", {"id": "p"}, order_col="id", bucket_s=narrow)
    assert {r.id: r.p for r in got.collect()} == exp


def test_trailing_sum_exact_sums_no_frame_anew(spark):
    """Dense rows: every row's lookback holds all before it, and the plan has no sliding frame that sums them for each row."""
    from canopy.operators.sequence import trailing_sum_exact
    df = spark.range(3000).select("id", F.lit("a").alias("k"), F.expr("if(id % 7 = 0, null, id)").alias("v"),
                                  F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id div 3)").alias("t"))
    got = trailing_sum_exact(df, ["k"], "t", "v", 100)
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(i, None if i % 7 == 0 else i, i // 3) for i in range(3000)]
    exp = {}
    for i, _, t in rows:
        inside = [v for _, v, u in rows[max(0, i - 310):i + 3] if v is not None and t - 100 <= u <= t]
        exp[i] = (sum(inside), len(inside))
    assert {r.id: (r.trailing_sum, r.trailing_cnt) for r in got.collect()} == exp


def test_trailing_sum_exact_equals_range_window(spark):
    from canopy.operators.sequence import running_sum, trailing_sum_exact
    df = _skewed(spark).withColumn("iv", (F.col("v") * 10).cast("long"))
    look = 7200
    w = (Window.partitionBy("k").orderBy(F.unix_micros(F.col("t").cast("timestamp")))
         .rangeBetween(-look * 10**6, 0))
    exp = {r.id: (r.s, r.c) for r in df.select("id", F.sum("iv").over(w).alias("s"),
                                                F.count("iv").over(w).alias("c")).collect()}
    for bucket in (None, 900.0):  # one bucket per lookback, and eight buckets per lookback
        got = trailing_sum_exact(df, ["k"], "t", "iv", look, bucket_s=bucket)
        assert {r.id: (r.trailing_sum, r.trailing_cnt) for r in got.collect()} == exp
    wc = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    cum = {r.id: r.s for r in df.select("id", F.sum("iv").over(wc).alias("s")).collect()}
    got = running_sum(df, ["k"], "t", {"iv": "cum"}, bucket_s=600.0)
    assert {r.id: r.cum for r in got.collect()} == cum


def test_auto_bucket_bounds_hot_key_partitions(spark):
    """The largest (key, bucket) group stays near the row target, far below the hot key's size."""
    from canopy.operators.sequence import _bucket, _us, auto_bucket_s, epoch_us
    df = _skewed(spark, n=20000)
    hot = df.groupBy("k").count().agg(F.max("count")).first()[0]
    width = auto_bucket_s([(df, "t")], ["k"], target_rows=500)
    groups = df.groupBy("k", _bucket(epoch_us("t"), _us(width)).alias("b")).count()
    biggest = groups.agg(F.max("count")).first()[0]
    assert hot > 10000 and biggest <= 2 * 500, (hot, biggest)


def test_greedy_spacing_equals_a_sequential_scan(spark):
    """Sparse keys, a dense one that never pauses, ties; arrays and pointer doubling."""
    import random
    from canopy.operators.spacing import greedy_min_gap
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, i, t0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(
        [("dense", 7 * j) for j in range(300)] + [(rng.choice("ab"), rng.randint(0, 40000)) for _ in range(150)] + [("a", 500)] * 3)]
    want, last = [], {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in last or t - last[k] >= dt.timedelta(seconds=60):
            want.append(i)
            last[k] = t
    df = spark.createDataFrame(rows, "key string, id long, time timestamp_ntz")
    for piece_rows in (1000, 20):   # 20: the dense key goes by doubling
        got = greedy_min_gap(df, ["key"], "time", "id", 60, 50000, bucket_s=600, piece_rows=piece_rows)
        assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert greedy_min_gap(df.limit(0), ["key"], "time", "id", 60, 0).count() == 0


def test_range_sums_equal_a_nested_loop(spark):
    import random
    from canopy.operators.sequence import epoch_us, range_sums
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), t0 + dt.timedelta(seconds=rng.randint(0, 3000)), rng.choice([None, *range(-50, 50)])) for _ in range(600)]
    points = [(rng.choice(["a", "hot", "none"]), i, t0 + dt.timedelta(seconds=rng.randint(-100, 3200))) for i in range(80)]
    r = spark.createDataFrame(rows, "key string, at timestamp_ntz, v long")
    p = spark.createDataFrame(points, "key string, id long, time timestamp_ntz")
    t, reach = epoch_us("time"), 200 * 1_000_000
    got = {x.id: tuple(x[2:]) for x in range_sums(p, r, ["key"], "id", "at", "v", {"b": (t - reach, t - 1), "a": (t + 1, t + reach)}, bucket_s=500).collect()}
    d = dt.timedelta(seconds=200)
    for k, i, at in points:
        b = [v for q, x, v in rows if q == k and at - d <= x < at and v is not None]
        a = [v for q, x, v in rows if q == k and at < x <= at + d and v is not None]
        assert got[i] == (sum(b), len(b), sum(a), len(a))


def test_asof_of_rows_already_dealt_by_the_key(spark):
    """Inputs that a join has partitioned by the key keep their matches, whatever Spark makes of the union."""
    rows = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(300)],
                                 "key string, id long, time timestamp_ntz").repartition(3).checkpoint()
    dealt = rows.join(rows.groupBy("key").count().where("count > 20"), "key", "left_semi")
    old = spark.conf.get("spark.sql.unionOutputPartitioning")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        probe = dealt.withColumn("probe", F.col("time") + F.expr("INTERVAL 60 SECONDS"))
        right = dealt.select("key", F.col("id").alias("nid"), F.col("time").alias("nt"))
        got = asof_join(probe, right, ["key"], "probe", "nt", {"nid": "nid"}, direction="forward", matched_time=None, bucket_s=600)
        assert {r.id: r.nid for r in got.collect()} == {i: i + 9 if i + 9 < 300 else None for i in range(300)}
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", old)


def test_a_burst_is_split_at_quantiles(spark):
    """90 % of one key's rows within a minute: no job before the plan's own, bounded pieces, rows as of plain windows."""
    from canopy.operators.sequence import _bucketing, asof_last_values, epoch_us, running_sum
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot", i, t0 + dt.timedelta(seconds=86400, microseconds=rng.randint(0, 60_000_000)) if i % 10 else
             t0 + dt.timedelta(seconds=rng.randint(0, 30 * 86400)), float(i % 7)) for i in range(4000)] + \
           [(k, 4000 + i, t0 + dt.timedelta(seconds=rng.randint(0, 30 * 86400)), 1.0) for i, k in enumerate(["a", None] * 50)]
    df = spark.createDataFrame(rows, "key string, id long, time timestamp_ntz, v double")
    group = f"burst-{rng.random()}"
    spark.sparkContext.setJobGroup(group, "building")
    prev = prev_row(df, ["key"], "time", {"id": "before"}, order_col="id", target_rows=100)
    asof = asof_join(df.where("id % 3 = 0"), df.where("id % 3 = 1").withColumnsRenamed({"time": "rt", "id": "rid", "v": "rv"}), ["key"], "time", "rt",
                     {"rid": "rid"}, right_order="rid", matched_time=None, target_rows=100)
    last = asof_last_values(df, df.withColumn("odd", F.when(F.col("id") % 2 == 1, F.col("id"))), ["key"], "time", "time", {"odd": "odd"},
                            right_order="id", target_rows=100)
    total = running_sum(df, ["key"], "time", {"v": "sum"}, target_rows=100)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("tests", "tests")
    timed = df.withColumn("__t", epoch_us("time"))
    pieces = [r["count"] for r in _bucketing([timed], ["key"], None, 100)(timed).groupBy("key", "__b").count().collect()]
    assert max(pieces) < 250 and len(pieces) > 30
    w = Window.partitionBy("key").orderBy("time", "id")
    want = {r.id: (r.p, r.s) for r in df.withColumn("p", F.lag("id").over(w)).withColumn(
        "s", F.sum("v").over(Window.partitionBy("key").orderBy("time"))).collect()}
    assert {r.id: r.before for r in prev.collect()} == {i: p for i, (p, _) in want.items()}
    assert {r.id: r.sum for r in total.collect()} == {i: s for i, (_, s) in want.items()}
    by_key = {}
    for k, i, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(k, []).append((t, i))
    for found, pick, name in ((asof, lambda j: j % 3 == 1, "rid"), (last, lambda j: j % 2 == 1, "odd")):
        got = {r.id: r[name] for r in found.collect()}
        for k, i, t, _ in rows:
            if i in got:
                assert got[i] == next((j for s, j in reversed(by_key[k]) if s <= t and pick(j)), None)


def test_order_keys_beyond_2_53(spark):
    t, big = dt.datetime(2024, 1, 1), 1 << 53
    rows = spark.createDataFrame([("k", big + i, t, f"v{i}") for i in (2, 0, 3, 1)], "key string, id long, time timestamp_ntz, v string")
    assert [r.v for r in asof_join(rows.limit(1).select("key", "time"), rows.withColumnRenamed("time", "rt"), ["key"], "time", "rt", {"v": "v"},
                                   right_order="id", matched_time=None).collect()] == ["v3"]
    for direction, want in (("prev", {0: None, 1: "v0", 2: "v1", 3: "v2"}), ("next", {0: "v1", 1: "v2", 2: "v3", 3: None})):
        got = prev_row(rows, ["key"], "time", {"v": "other"}, order_col="id", direction=direction).collect()
        assert {r.id - big: r.other for r in got} == want
