"""Rows of a stream packed into blocks, so that a stream-stream join keeps blocks in its state instead of rows.

Putting a row into the join's state and removing it costs some 50 us of CPU time,
whatever the row's length.  Here a micro-batch's rows are dealt by (bucket of the
key, slot of time) and packed: a block holds some ``BLOCK_BYTES`` of rows of one
bucket and slot, each of its columns as one binary value.  A slot is at least as
long as the join looks ahead, so a left row's matches lie in its own slot or the
next one; left blocks go to both.  Spark joins blocks of equal bucket and slot,
with watermarks as for rows, and the rows of two blocks that meet are compared
in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256            # part of the state's keys: a query's checkpoint holds for this number only
PACK_TASKS = 32          # tasks, or four a core if that's more, that pack a micro-batch's small blocks again
PACK_ROWS = 1 << 21      # rows, or bytes, that a task holds at most before it packs them
PACK_BYTES = 64 << 20
BLOCK_BYTES = 1 << 18    # a block's bytes, to within a row
OUT_ROWS = 1 << 16       # rows in the blocks handed to Spark at once, to within a block
MATCH_IN = 1 << 15       # rows of pairs of blocks compared at once, to within a pair: look-ups stay in the processor's cache
MATCH_ROWS = 1 << 18     # pairs of rows of one key held at once, to within a block

# For a query's start: batches for Python end by their rows (256 pairs of blocks: 128 MB), not by their bytes,
# which Spark adds up anew at every row (14.4 million rows of 4 columns to 8 workers: 7.3 s, without 2.6 s).
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}

ID_KINDS = ("bigint", "string")
Batches = Iterator[pa.RecordBatch]


# --- columns as binary values ------------------------------------------------------------------------

def _parts(name: str, kind: str) -> list[str]:
    """Names of the binary columns that hold a column's values: numbers; or lengths (-1 for null) and texts."""
    return [name] if kind == "bigint" else [name, f"{name}_text"]


def _binary(data, at: np.ndarray) -> pa.Array:
    """The bytes between one position and the next, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _cut(values: pa.Array, at: np.ndarray) -> list[pa.Array]:
    """Values between one row and the next as binary columns (see ``_parts``)."""
    if pa.types.is_integer(values.type):
        return [_binary(values.to_numpy(), at * 8)]
    none = values.is_null().to_numpy(zero_copy_only=False)
    texts = values.cast(pa.string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return [_binary(np.where(none, -1, np.diff(ends)).astype(np.int32), at * 4), _binary(texts.buffers()[2] or b"", ends[at])]


def _bytes(column: pa.Array):
    """All bytes of a binary column, and each value's length."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return (column.buffers()[2] or pa.py_buffer(b""))[int(ends[0]):int(ends[-1])], np.diff(ends)


def _values(b: pa.RecordBatch, name: str, kind: str) -> pa.Array:
    """The values of all blocks of a column, one after the other."""
    first = _bytes(b[name])[0]
    if kind == "bigint":
        return pa.array(np.frombuffer(first, np.int64))
    lengths = np.frombuffer(first, np.int32)
    ends = np.r_[0, np.cumsum(np.maximum(lengths, 0))].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), _bytes(b[f"{name}_text"])[0])
    return pc.if_else(pa.array(lengths < 0), pa.scalar(None, pa.string()), texts) if (lengths < 0).any() else texts


# --- rows to blocks, pairs of blocks to pairs of rows ------------------------------------------------

def _opened(b: pa.RecordBatch, kinds: dict[str, str]) -> pa.RecordBatch:
    """Blocks -> their rows."""
    rows = _bytes(b["t_us"])[1] // 8
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(b["bucket"].to_numpy(), rows)), *(_values(b, c, kind) for c, kind in kinds.items())],
                                      names=["bucket", *kinds])


def _sizes(rows: pa.RecordBatch, kinds: dict[str, str]) -> np.ndarray:
    """Bytes of a block's columns in all rows before a row."""
    size = np.full(rows.num_rows, 8 * len(kinds), np.int64)
    for c, kind in kinds.items():
        if kind == "string":
            size += pc.binary_length(rows[c]).fill_null(0).to_numpy()
    return np.cumsum(size) - size


def _packer(slot_us: int, kinds: dict[str, str], again: bool) -> Callable[[Batches], Batches]:
    """Rows, or the blocks of other tasks (``again``), to blocks."""
    def packed(held: list[pa.RecordBatch]) -> Batches:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        slot = rows["t_us"].to_numpy() // slot_us
        key = (slot - slot.min()) * BUCKETS + rows["bucket"].to_numpy()
        order = np.argsort(key, kind="stable")
        rows, slot, key, n = rows.take(pa.array(order)), slot[order], key[order], len(order)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = _sizes(rows, kinds)
        part = (before - np.repeat(before[first], np.diff(np.r_[first, n]))) // BLOCK_BYTES
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        at = np.r_[start, n]
        out = pa.RecordBatch.from_arrays(
            [rows["bucket"].take(pa.array(start)), pa.array(slot[start]), pa.array(np.maximum.reduceat(rows["t_us"].to_numpy(), start)),
             *(x for c in kinds for x in _cut(rows[c], at))],
            names=["bucket", "slot", "last_us", *(x for c, kind in kinds.items() for x in _parts(c, kind))])
        cuts = np.flatnonzero(np.r_[True, np.diff(start // OUT_ROWS) > 0])
        for i, j in zip(cuts, np.r_[cuts[1:], len(start)]):
            yield out.slice(i, j - i)

    def pack(batches: Batches) -> Batches:
        held, rows, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(_opened(b, kinds) if again else b)
                rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows >= PACK_ROWS or size >= PACK_BYTES:
                yield from packed(held)
                held, rows, size = [], 0, 0
        if held:
            yield from packed(held)
    return pack


def _matcher(reach_us: int, id_kind: str, l_kind: str, r_kind: str) -> Callable[[Batches], Batches]:
    def side(b: pa.RecordBatch, s: str, kind: str):
        """(number of the pair of blocks, key, time, value) of each row of a side."""
        t_us, size = _bytes(b[f"{s}_t_us"])
        return (np.repeat(np.arange(b.num_rows), size // 8), _values(b, f"{s}_id", id_kind), np.frombuffer(t_us, np.int64),
                _values(b, f"{s}_value", kind))

    def match(b: pa.RecordBatch) -> Batches:
        l_pair, l_id, l_us, l_value = side(b, "l", l_kind)
        r_pair, r_id, r_us, r_value = side(b, "r", r_kind)
        code = pa.concat_arrays([l_id, r_id]).dictionary_encode().indices.to_numpy()
        l_code, r_code = code[:len(l_id)], code[len(l_id):]
        known = int(l_code.max(initial=-1)) + 1  # codes are given in order of appearance, the left side's first
        r_row = np.flatnonzero(r_code < known)
        l_key, r_key = l_pair * known + l_code, r_pair[r_row] * known + r_code[r_row]
        order = np.argsort(l_key, kind="stable")
        l_key = l_key[order]
        low = np.searchsorted(l_key, r_key, "left")
        many = np.searchsorted(l_key, r_key, "right") - low
        r_row, low, many = r_row[many > 0], low[many > 0], many[many > 0]
        cuts = np.flatnonzero(np.r_[True, np.diff(np.cumsum(many) // MATCH_ROWS) > 0]) if len(many) else np.zeros(0, int)
        for i, j in zip(cuts, np.r_[cuts[1:], len(many)]):
            n = many[i:j]
            r = np.repeat(r_row[i:j], n)
            le = order[np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ahead = r_us[r] - l_us[le]
            near = (ahead >= 0) & (ahead <= reach_us)
            r, le = r[near], le[near]
            if len(r):
                at = pa.array(le)
                yield pa.RecordBatch.from_arrays([l_id.take(at), l_value.take(at), pa.array(l_us[le]), pa.array(r_us[r]),
                                                  r_value.take(pa.array(r))], names=["id", "l_value", "l_us", "r_us", "r_value"])

    def run(batches: Batches) -> Batches:
        for b in batches:
            upto = np.cumsum(_bytes(b["l_t_us"])[1] // 8 + _bytes(b["r_t_us"])[1] // 8) if b.num_rows else np.zeros(0, int)
            cuts = np.flatnonzero(np.r_[True, np.diff(upto // MATCH_IN) > 0]) if b.num_rows else upto
            for i, j in zip(cuts, np.r_[cuts[1:], b.num_rows]):
                yield from match(b.slice(i, j - i))
    return run


# --- the join ---------------------------------------------------------------------------------------

def _pack_tasks(spark: SparkSession) -> int:
    try:
        return max(PACK_TASKS, 4 * spark.sparkContext.defaultParallelism)
    except Exception:  # no SparkContext (remote session)
        return PACK_TASKS


def _blocks(rows: DataFrame, slot_us: int) -> tuple[DataFrame, list[str], dict[str, str]]:
    """(id, t_us, value) -> blocks (bucket, slot, last_us and binary columns), the binary columns, the rows' types.

    Each task packs what it reads, so small blocks are dealt by bucket and slot, not rows; then they are packed again.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "t_us", "value")}
    lists = [x for c, kind in kinds.items() for x in _parts(c, kind)]
    schema = "bucket int, slot long, last_us long, " + ", ".join(f"{c} binary" for c in lists)
    kept = rows.where("id is not null and t_us is not null")  # others match nothing
    small = kept.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), *kinds).mapInArrow(_packer(slot_us, kinds, False), schema)
    return small.repartition(_pack_tasks(rows.sparkSession), "bucket", "slot").mapInArrow(_packer(slot_us, kinds, True), schema), lists, kinds


def join_ahead(left: DataFrame, right: DataFrame, reach_us: int, watermark: str) -> DataFrame:
    """Pairs of stream rows (id, t_us, value) of equal id, the right one at most ``reach_us`` later than the left one.

    Ids are of one of ``ID_KINDS``, values are texts.  The watermark is that of
    rows: a block counts as its latest row.  Rows come too late only if their
    whole block does.  Blocks leave the state once no row that is in time can
    match them, a slot later than rows would.
    """
    slot_us = max(reach_us, 3_600_000_000)
    le, l_lists, l_kinds = _blocks(left, slot_us)
    r, r_lists, r_kinds = _blocks(right, slot_us)
    le = le.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))
    le, r = (df.withColumn("time", F.timestamp_micros("last_us")).withWatermark("time", watermark).select(
                 *(F.col(c).alias(f"{s}_{c}") for c in ("bucket", "slot", "time", *lists)))
             for s, df, lists in (("l", le, l_lists), ("r", r, r_lists)))
    # true of all blocks of one slot: these bounds only tell Spark when a block may leave the state
    met = le.join(r, F.expr(f"l_bucket = r_bucket AND l_slot = r_slot AND r_time >= l_time - INTERVAL {slot_us} MICROSECONDS "
                            f"AND r_time <= l_time + INTERVAL {2 * slot_us} MICROSECONDS"))
    return met.select(*(f"l_{c}" for c in l_lists), *(f"r_{c}" for c in r_lists)).mapInArrow(
        _matcher(reach_us, l_kinds["id"], l_kinds["value"], r_kinds["value"]),
        f"id {l_kinds['id']}, l_value {l_kinds['value']}, l_us long, r_us long, r_value {r_kinds['value']}")
