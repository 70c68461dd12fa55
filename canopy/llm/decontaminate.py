"""Benchmark decontamination by spaced seeds.

A document is contaminated by a benchmark item if, laid over the item at some
offset, a window of ``WINDOW`` (13) tokens differs in at most ``SUBSTITUTIONS``
(2) tokens.  An item shorter than the window must occur as a whole, unchanged.
Tokens are runs of lower-cased characters between white space and ASCII
punctuation.

Each mask hashes the tokens at its own positions of a window and ignores the
others.  The three masks below are lossless: however two substitutions lie in
13 tokens, one mask fits somewhere between them (tests try all cases).

1. one pass hashes every position of every text with every mask; a Bloom
   filter of the benchmark's seeds, of fixed size, drops nearly all positions,
   and what is left travels with short slices of the text around it;
2. the remaining hashes join the benchmark's seeds; a hit fixes the offset
   between document and item, and hits are reduced to one per offset and slice;
3. slice and item are laid over each other and windows are counted.

Defined cases: null texts and texts without a token are kept; repeated rows
are judged alike; null ids are allowed; with an empty benchmark everything is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import cut, list_column, mix64, small_batches, table

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 2, 4, 7, 8, 9), (0, 1, 3, 6, 8, 11, 12))
FILTER_BITS = 1 << 23     # 1 MB
PROBES = 4
SLICE = 256               # positions whose hits share a slice of text
CACHE_WORDS = 1 << 15     # word hashes that a task remembers
ODD = np.uint64(0x9E3779B97F4A7C15)
TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def tokens_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").translate(TO_SPACE).split()
    return np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)


def seeds_of(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, hash_of_mask(mask), dtype=np.uint64)
    for j in mask:
        h = h * ODD + tokens[j:j + n]
    return mix64(h)


def hash_of_mask(mask: tuple[int, ...]) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(mask).encode()))


def _probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(13 * j)) ^ (h << np.uint64(7 * j))) & np.uint64(bits - 1)


def in_filter(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of h whose hash may be a seed; each probe looks at what the last one left."""
    at = np.arange(len(h))
    for j in range(PROBES):
        p = _probe(h[at], j, bits)
        at = at[(words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def _benchmark(bench: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[tuple[int, ...]]]:
    """Items (item, tokens), their seeds (hash, item, ipos), and the masks in use."""

    def items(batches):
        hashes = WordHashes()
        for b in batches:
            toks = [tokens_of(t, hashes) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array([t.tobytes() for t in toks], pa.binary()),
                                              pa.array([len(t) for t in toks], pa.int64())], ["item", "tokens", "n"])

    rows = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col))
    item_rows = cut(rows.mapInArrow(items, "item long, tokens binary, n long").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in item_rows.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most WINDOW - 1 lengths
    exact = {n: tuple(range(n)) for n in short}

    def seeds(batches):
        for b in batches:
            for row, raw in zip(b[0].to_pylist(), b[1].to_pylist()):
                t = np.frombuffer(raw, np.uint64)
                for m in MASKS if len(t) >= WINDOW else [exact[len(t)]]:
                    h = seeds_of(t, m)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), row)),
                                                      pa.array(np.arange(len(h)))], ["hash", "irow", "ipos"])

    return (item_rows, cut(item_rows.select("row", "tokens").mapInArrow(seeds, "hash long, irow long, ipos long")),
            [*MASKS, *exact.values()])


def _filter_words(seeds: DataFrame, bits: int) -> np.ndarray:
    """The seeds' Bloom filter; its size is fixed, and tasks build it by words."""

    def places(batches):
        for b in batches:
            h = np.unique(b[0].to_numpy().view(np.uint64))
            p = np.concatenate([_probe(h, j, bits) for j in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)),
                                              pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["i", "w"])

    words = np.zeros(bits // 64, dtype=np.uint64)
    got = seeds.select("hash").mapInArrow(places, "i long, w long").groupBy("i").agg(F.expr("bit_or(w)").alias("w")).toPandas()
    words[got["i"].to_numpy()] = got["w"].to_numpy().view(np.uint64)
    return words


def contaminated_pairs(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): rows (_id, row) for every input row; pairs (row, item, matched): most equal tokens in a window."""
    items, seeds, masks = _benchmark(bench, item_col, item_text_col)
    sent = df.sparkSession.sparkContext.broadcast(_filter_words(seeds, filter_bits))  # filter_bits / 8 bytes

    def scan(batches):
        hashes, words = WordHashes(), sent.value
        for b in small_batches(batches):
            counts, flat = [], {"start": [], "tokens": [], "pos": [], "hash": []}
            for text in b[1].to_pylist():
                t = tokens_of(text, hashes)
                hit_at, hit_hash = [], []
                for m in masks:
                    h = seeds_of(t, m)
                    at = in_filter(h, words, filter_bits)
                    if len(at):
                        hit_at.append(at)
                        hit_hash.append(h[at])
                slices = 0
                if hit_at:
                    at, h = np.concatenate(hit_at), np.concatenate(hit_hash)
                    part = at // SLICE
                    for s in np.unique(part):
                        own = part == s
                        lo = max(0, int(s) * SLICE - WINDOW)
                        flat["start"].append(lo)
                        flat["tokens"].append(t[lo:(int(s) + 1) * SLICE + 2 * WINDOW].tobytes())
                        flat["pos"].append(at[own])
                        flat["hash"].append(h[own].view(np.int64))
                        slices += 1
                counts.append(slices)
            sizes = np.array([len(x) for x in flat["pos"]], np.int32)
            many = lambda xs: list_column(sizes, pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64)))
            one = pa.StructArray.from_arrays([pa.array(flat["start"], pa.int64()), pa.array(flat["tokens"], pa.binary()),
                                              many(flat["pos"]), many(flat["hash"])], ["start", "tokens", "pos", "hash"])
            yield pa.RecordBatch.from_arrays([b[0], list_column(np.array(counts, np.int32), one)], ["_id", "slices"])

    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col))
    kind = dict(docs.dtypes)["_id"]
    rows = cut(docs.mapInArrow(scan, f"_id {kind}, slices array<struct<start:long,tokens:binary,pos:array<long>,hash:array<long>>>")
               .withColumn("row", F.monotonically_increasing_id()))
    slices = rows.where(F.size("slices") > 0).select("row", F.explode("slices").alias("s")).select("row", "s.*")
    hits = slices.select("row", "start", F.explode(F.arrays_zip("pos", "hash")).alias("h")).select(
        "row", "start", F.col("h.pos").alias("pos"), F.col("h.hash").alias("hash"))
    lays = hits.join(seeds, "hash").select("row", "start", "irow", (F.col("pos") - F.col("ipos")).alias("offset")).distinct()
    text = items.select(F.col("row").alias("irow"), "item", F.col("tokens").alias("itokens"))
    laid = lays.join(slices.select("row", "start", "tokens"), ["row", "start"]).join(text, "irow")

    def check(batches):
        for b in batches:
            c = b.to_pydict()
            best = []
            for start, offset, raw, iraw in zip(c["start"], c["offset"], c["tokens"], c["itokens"]):
                t, i = np.frombuffer(raw, np.uint64), np.frombuffer(iraw, np.uint64)
                lo, hi = max(start, offset), min(start + len(t), offset + len(i))
                same = t[lo - start:hi - start] == i[lo - offset:hi - offset]
                w = min(WINDOW, len(i))
                runs = np.convolve(same, np.ones(w, np.int64), "valid") if len(same) >= w else np.zeros(1, np.int64)
                top = int(runs.max())
                best.append(top if top >= (w - SUBSTITUTIONS if len(i) >= WINDOW else w) else 0)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("item"), pa.array(best, pa.int64())], ["row", "item", "matched"])

    pairs = (laid.select("row", "item", "start", "offset", "tokens", "itokens").mapInArrow(check, "row long, item long, matched long")
             .where("matched > 0").groupBy("row", "item").agg(F.max("matched").alias("matched")))
    return rows.select("_id", "row"), pairs


def decontaminate(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """One row per input row: id, kept, item_ids (items found, in order), matched (most equal tokens in a window)."""
    rows, pairs = contaminated_pairs(df, bench, id_col, text_col, **names)
    found = pairs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("matched").alias("matched"))
    return rows.join(found, "row", "left").select(
        F.col("_id").alias(id_col), F.col("matched").isNull().alias("kept"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("matched", F.lit(0)).alias("matched"))


def op6_decontaminate(spark, sf_dir):
    """Every document with the benchmark items that it holds."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
