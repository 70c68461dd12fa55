"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import shared_dir

BATCH_BYTES = 2 << 20  # of an Arrow batch that a task turns into Python objects or arrays at once


@dataclass
class LlmQuery:
    """A registered query: Spark builder and DuckDB SQL (None where SQL can't express it)."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    shared_dir(df.sparkSession)
    gc.collect()  # frozen references to earlier plans would keep their shuffles and broadcasts on the driver
    return df.checkpoint(eager=True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per ``key``.

    Both sides join on a hash derived from the key as well, so neither side's
    earlier partitioning is reused: each gets a plain exchange, and adaptive
    execution can split the partition of a key that holds many rows.
    """
    g = groups.withColumnRenamed(key, "_gk").withColumn("_gh", F.xxhash64("_gk"))
    r = rows.withColumn("_rh", F.xxhash64(key))
    return r.join(g, (F.col("_rh") == F.col("_gh")) & F.col(key).eqNullSafe(F.col("_gk")), how).drop("_rh", "_gh", "_gk")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, though lambdas inside refer to it again and again."""
    return F.transform(F.array(value), use)[0]


# --- fixed-size Bloom filter as one array<bigint>, built and probed by built-in functions ----------

def _positions(key: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 + j)), F.lit(bits)) for j in range(hashes)]


def bloom_bits(keys: int, per_key: int = 10) -> int:
    """Bits of a filter of that many keys: ``per_key`` each, from 2^12 to 2^25 (4 MB); a fuller filter lets more rows pass."""
    return 1 << min(25, max(12, (max(keys, 1) * per_key - 1).bit_length()))


def bloom_words(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """One row, one column ``words``: the filter of all keys; ``bits`` fixes its size."""
    n = bits // 64
    set_bits = (keys.select(F.explode(F.array(*_positions(F.col(key), bits, hashes))).alias("p"))
                .groupBy(F.expr("p div 64").alias("i"))
                .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("w")))
    zeros = keys.sparkSession.range(0, n, 1, 1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    dense = set_bits.unionByName(zeros).groupBy("i").agg(F.expr("bit_or(w)").alias("w"))
    return (dense.agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("a"))
            .select(F.transform("a", lambda x: x["w"]).alias("words")))


def bloom_hit(words: Column, key: Column, bits: int, hashes: int) -> Column:
    """True for every key in the filter (and for a few others)."""
    hit = F.lit(True)
    for p in _positions(key, bits, hashes):
        word = F.get(words, (F.floor(p / F.lit(64))).cast("int"))
        hit = hit & (F.getbit(word, (p % F.lit(64)).cast("int")) == 1)
    return hit


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_rows(rows: DataFrame, key: Column, dropped: DataFrame, hashes: int = 3) -> DataFrame:
    """Rows whose key isn't in ``dropped`` (one column ``key``).

    Rows that miss a Bloom filter of the dropped keys stay where they are; only
    the others are shuffled for the exact answer.
    """
    row_key, dropped_key = free_name(rows, "_row_key"), free_name(rows, "_dropped_key")
    dropped = cut(dropped.select(F.col("key").alias(dropped_key)).distinct())
    bits = bloom_bits(dropped.count())
    words = cut(bloom_words(dropped.select(F.xxhash64(dropped_key).alias("h")), "h", bits, hashes))
    keyed = rows.withColumn(row_key, key)
    hit = bloom_hit(words.scalar(), F.xxhash64(row_key), bits, hashes)
    gone = keyed.where(hit).join(dropped, F.col(row_key).eqNullSafe(F.col(dropped_key)), "left_anti")
    return keyed.where(~hit).unionByName(gone).drop(row_key)


# --- components ------------------------------------------------------------------------------------

def _contract(batches):
    """Each task's edges as stars around the smallest node of their components within the task."""
    up: dict[int, int] = {}

    def root(x):
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b[0].to_pylist(), b[1].to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = [x for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([up[x] for x in nodes], pa.int64())], ["u", "v"])


def _stars(e: DataFrame) -> DataFrame:
    """(node, up, mixed): a node's smallest parent, and whether it has several parents or is a parent as well."""
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(False).alias("top")).union(
        e.select("v", F.lit(None).cast("long"), F.lit(True)))
    return ends.groupBy("node").agg(
        F.min("up").alias("up"),
        (F.coalesce(F.min("up") < F.max("up"), F.lit(False)) | (F.bool_or("top") & F.min("up").isNotNull())).alias("mixed"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node (a long) of the undirected ``edges``; component = smallest node.

    Tasks first contract the edges they hold; then large-star and small-star
    rounds in turn until every component is one star.  Each round keeps at most
    as many edges as it was given, and a node with many neighbours is met by
    partial aggregation and a skew-splitting join only.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
            .mapInArrow(_contract, "u long, v long"))
    while not (stars := cut(_stars(e))).where("mixed").isEmpty():
        # large star: every node's larger neighbours move to its smallest neighbour (itself included)
        both = e.union(e.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("lo"))
        large = (join_groups(both.where("m > n"), least, "n").select(F.col("m").alias("u"), F.col("lo").alias("v"))
                 .where("u <> v").distinct())
        # small star: every node's smaller neighbours (and itself) move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = (join_groups(large, low, "u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
                 .union(low.select("u", F.col("lo").alias("v"))).where("u <> v"))
        e = cut(small.mapInArrow(_contract, "u long, v long"))
    return stars.select("node", F.coalesce("up", "node").alias("component"))


# --- Arrow helpers ---------------------------------------------------------------------------------

def list_column(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array from row lengths and flat values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def byte_texts(col: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for v in col.cast(pa.binary()).to_pylist():
        yield v or b""


def small_batches(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about ``size`` bytes, so a task's Python objects and results stay small at any length of the rows."""
    for b in batches:
        rows = max(1, b.num_rows * size // max(size, b.nbytes))
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
