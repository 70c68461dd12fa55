"""Greedy minimum-gap selection (``keep a request only if it comes at least
``gap`` after the last kept one``), exact and parallel.

The greedy rule is sequential per key, and a plain grouped scan would put a
hot key's whole history into one task.  Instead:

1. A request that comes at least ``gap`` after the one before it is kept
   whatever was kept earlier, so it begins an independent piece.  Pieces are
   numbered by a lag and a running sum, both on (key, bucket) partitions.
2. A piece of up to ``PIECE_ROWS`` requests is one row with a sorted array,
   scanned once by an aggregate over it.
3. Longer pieces (requests that never pause for ``gap``) go by pointer
   doubling: ``next(r)`` = first request at or after ``r.time + gap``; the
   kept requests are the chain ``head, next(head), ...``.  ``next^(2^k)`` for
   k = 0..K by self-joins, then ``S := S u next^(2^k)(S)`` for k = K..0 from
   the heads, every step an equi-join on (key, id).

Lineage is cut with ``checkpoint()`` (shared folder from the session): once
for the numbered requests; the doubling, if there is any, cuts its levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.latest import latest_per_key
from canopy.operators.sequence import asof_join, epoch_us, prev_row, running_sum


PIECE_ROWS = 1000      # longest piece that is scanned as one array
BUCKET_S = 7 * 86400.0


def greedy_min_gap(df: DataFrame, by: Sequence[str], time_col: str, id_col: str, gap_s: float, span_s: float, *,
                   bucket_s: float = BUCKET_S, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows of ``df`` kept by the greedy spacing rule (ordered by time, then id)."""
    by, columns, gap_us = list(by), df.columns, int(round(gap_s * 1_000_000))
    after = prev_row(df, by, time_col, {time_col: "__before"}, order_col=id_col, bucket_s=bucket_s)
    begins = F.col("__before").isNull() | (epoch_us(time_col) - epoch_us("__before") >= gap_us)
    rows = running_sum(after.withColumn("__head", begins.cast("long")), by, time_col, {"__head": "__piece"}, bucket_s=bucket_s)
    rows = rows.drop("__before", "__head").checkpoint()
    keys = [*by, "__piece"]
    long = rows.groupBy(*keys).count().where(F.col("count") > piece_rows).drop("count")
    runs_on = not long.isEmpty()
    short = rows.join(long, keys, "left_anti") if runs_on else rows
    whole = F.struct(epoch_us(time_col).alias("__us"), F.col(id_col).alias("__id"), F.struct(*columns).alias("__r"))
    kept = short.groupBy(*keys).agg(F.sort_array(F.collect_list(whole)).alias("__rows")).select(F.explode(_scan(F.col("__rows"), gap_us)).alias("__k"))
    kept = kept.select("__k.__r.*")
    if runs_on:
        kept = kept.unionByName(_by_doubling(rows.join(long, keys, "left_semi"), keys, time_col, id_col, gap_s, span_s, bucket_s).select(*columns))
    return kept


def _scan(rows: Column, gap_us: int) -> Column:
    """The kept ones of a piece's requests, in order of time."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, i: Column) -> Column:
        t = F.get(rows, i)["__us"]
        keeps = acc["last"].isNull() | (t - acc["last"] >= gap_us)
        return F.when(keeps, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc)

    places = F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), start, step, lambda acc: acc["kept"])
    return F.transform(places, lambda i: F.get(rows, i))


def _by_doubling(df: DataFrame, by: Sequence[str], time_col: str, id_col: str, gap_s: float, span_s: float, bucket_s: float) -> DataFrame:
    """The same by pointer doubling, for keys of any length."""
    by = list(by)
    req = df.select(*by, id_col, time_col)
    probe = req.withColumn("__probe", F.col(time_col) + F.make_dt_interval(secs=F.lit(float(gap_s))))
    nxt = asof_join(probe, req.withColumnRenamed(id_col, "__nid").withColumnRenamed(time_col, "__nt"),
                    by, "__probe", "__nt", {"__nid": "nid"}, right_order="__nid",
                    matched_time=None, direction="forward", bucket_s=bucket_s)
    jump = nxt.select(*by, F.col(id_col).alias("id"), "nid")
    levels = [jump.checkpoint()]
    hottest = req.groupBy(*by).count().agg(F.max("count")).first()[0] or 1  # one scalar
    bound = min(span_s / gap_s + 1, hottest)
    k_max = max(0, math.ceil(math.log2(bound + 1)))
    for _ in range(k_max):
        j = levels[-1]
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [F.col("a.nid") == F.col("b.id")]
        nj = j.alias("a").join(j.alias("b"), cond, "left") \
              .select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.id").alias("id"),
                      F.col("b.nid").alias("nid"))
        levels.append(nj.checkpoint())
    heads = latest_per_key(req, by, [F.col(time_col), F.col(id_col)]).select(*by, F.col(id_col).alias("id"))
    kept = heads
    for i, j in enumerate(reversed(levels)):
        # S := S u next^(2^k)(S): one left join, both ids exploded -- S is referenced once,
        # so the plan grows linearly and a checkpoint every few steps keeps it short
        cond = [F.col(f"s.{k}") == F.col(f"j.{k}") for k in by] + [F.col("s.id") == F.col("j.id")]
        both = F.explode(F.array(F.col("s.id"), F.col("j.nid")))
        kept = (kept.alias("s").join(j.alias("j"), cond, "left")
                .select(*[F.col(f"s.{k}").alias(k) for k in by], both.alias("id"))
                .filter(F.col("id").isNotNull()))
        if i % 4 == 3:
            kept = kept.checkpoint()
    return df.join(kept.withColumnRenamed("id", id_col), [*by, id_col], "left_semi")
