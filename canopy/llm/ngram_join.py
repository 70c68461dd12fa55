"""Jaccard join of shingle sets by parity sketches.

A document's set holds its distinct shingles of ``width`` words (the whole
text as one shingle if it is shorter).  Two documents link when
100 * |A & B| >= percent * |A | B|.

Sketch.  Sizes fall into bands.  In a band whose sizes are at most h, linked
sets differ in at most d = floor((100 - percent) * 2h / (100 + percent))
shingles.  The hash space is cut into k = d + 1 + c blocks and each block's
shingle hashes are XOR-ed, so a shingle in one set only changes one block, and
the number of blocks in which two sketches differ is a lower bound of the
symmetric difference.  By the pigeonhole principle linked sets agree in
k - d = c + 1 blocks or more.  ``c`` allows for blocks without a shingle: they
say nothing, so a set leaves its empty blocks out unless it has more than c.
A set takes part in its own band and, if it is close enough below it, in the
next one, where the larger partner may be.

Join.  Sets that are equal are one node.  Nodes with an equal block in common
are candidates.  A first count finds the blocks that several nodes hold; a
Bloom filter of them, sized by their number, picks each node's shared blocks
where they lie.  As linked sets agree in c + 1 blocks, a node with fewer shared
blocks in a band has no link there and leaves it, and one with h shared blocks
needs h - c of them only: with all blocks in one order, the first block that
two linked nodes share has c others behind it in each node.  The order puts
blocks that many nodes hold last, so common passages bring few candidates.
Of blocks that the same nodes hold one is kept.  Sketches and sets are fetched for candidate pairs only.
Only components are wanted, so a block shared by many nodes
doesn't yield all its pairs: each round compares the nodes of a block with a
few pivots, unites what links, and goes on with the blocks that still hold
several components.  Once at most ``OPEN_PAIRS`` comparisons a row are left, or
a round no longer halves them, or ``rounds`` are over, all pairs of different
components that are still open are compared, so no link that matters to a
component is lost.  Their sketches are compared within tasks, each of which
gets groups of at most two blocks of a key's nodes, and only pairs that may
link become rows: near copies that just miss a link, or texts with a common
passage, cost comparisons but no shuffle.  A comparison first takes the Hamming distance of two
sketches of ``BITS`` parity bits (more for long sets), which can't exceed the difference of the
sets, and intersects the full sets only if that leaves a link possible.

Texts are compared by 64-bit shingle hashes (128 bits for equal sets).

Defined cases: null texts are empty; a document without words has an empty set
and links with nothing; repeated rows and null ids are allowed (a component of
null ids only has a null id); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import (bloom_bits, bloom_hit, bloom_words, byte_texts, connected_components, cut, drop_rows, join_groups,
                               list_column, mix64, small_batches, table)

FILTER_HASHES = 3
KEY_SHIFTS = (0, 11, 23)  # a key's places in the filter of shared keys: its bits from there on, up to 25 of 48
CROWDED = (4, 64)       # keys of more nodes than that come later in the order of keys
KEY_MASK = np.uint64((1 << 48) - 1)  # equal blocks keep equal keys; shorter keys make a smaller shuffle
ROUNDS = 6
PIVOTS = 3              # nodes of a block that a round compares with the others
OPEN_PAIRS = 4          # all open pairs are compared once they are at most so many a row
BLOCK_NODES = 2048      # of a key, about: a task compares a block with itself or another one
PAIRS_AT_ONCE = 1 << 15 # sketches that a task compares in one step
BAND_RATIO = 1.5
BITS = 1024             # of the sketch that candidates are compared by first
CACHE_WORDS = 1 << 15   # word hashes that a task remembers: the first ones, so the frequent ones
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and \\x20 \\x09-\\x0D only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    span = min(width, len(w))
    h = np.full(len(w) - span + 1, span, dtype=np.uint64)
    for j in range(span):
        h = h * ODD + w[j:len(w) - span + 1 + j]
    return np.unique(mix64(h))


@lru_cache(maxsize=None)
def band_limits(percent: int) -> list[tuple[int, int, int, int]]:
    """(lowest size, highest size, d, k) of each band up to sizes of 2^40."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, math.floor(lo * BAND_RATIO))
        d = (100 - percent) * 2 * hi // (100 + percent)
        k = d + 1
        if d:
            for _ in range(20):
                empty = k * math.exp(-lo / k)
                k = d + 1 + min(d, math.ceil(empty + 3 * math.sqrt(empty)))
        out.append((lo, hi, d, k))
        lo = hi + 1
    return out


def block_keys(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For each band of a set: how many keys a linked set shares at least, and the keys.

    A key is band, block number and XOR of the block, hashed to 48 bits.  Linked
    sets agree in c + 1 blocks, of which at most the set's own empty ones are left
    out; a set that keeps its empty blocks may meet one that doesn't, so it
    shares one key at least.
    """
    n, out = len(s), []
    for b, (lo, hi, d, k) in enumerate(band_limits(percent)):
        if hi < n:
            continue
        if 100 * n < percent * lo:
            break
        if not d:
            continue  # only equal sets link here
        step = (1 << 64) // k + 1
        cuts = np.searchsorted(s, np.array([i * step for i in range(k)], dtype=np.uint64))
        full = np.append(cuts[1:], n) > cuts
        words = np.zeros(k, dtype=np.uint64)
        words[full] = np.bitwise_xor.reduceat(mix64(s ^ ODD), cuts[full])
        ids = mix64(np.arange(k, dtype=np.uint64) + np.uint64((b + 1) << 32))
        key = mix64(words ^ ids) & KEY_MASK
        spare = k - d - int(k - full.sum())
        out.append((spare, key[full]) if spare > 0 else (1, key))
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    a, b = mix64(s ^ np.uint64(0x5555555555555555)), mix64(s + np.uint64(0x123456789ABCDEF))
    return a.sum(dtype=np.uint64).tobytes() + b.sum(dtype=np.uint64).tobytes()


def parity_bits(s: np.ndarray) -> bytes:
    """Bit sketch: each shingle flips one bit, so the Hamming distance of two of one length is at most the sets' difference.

    Sets of more than BITS shingles get 16 * BITS bits, as short sketches of long sets are random.
    """
    size = BITS if len(s) <= BITS else 16 * BITS
    flips = np.bincount((mix64(s + ODD) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(_id, _t) -> (_id, n, sig, bits, bands): bands as of ``block_keys``."""

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            n, sig, bits, bands = [], [], [], []
            for text in byte_texts(b.column("_t")):
                s = shingle_set(text, width, hashes)
                n.append(len(s))
                sig.append(signature(s))
                bits.append(np.frombuffer(parity_bits(s), np.int64))
                bands.append(block_keys(s, percent))
            each = [band for row in bands for band in row]
            flat = np.concatenate([k for _, k in each]).view(np.int64) if each else np.zeros(0, np.int64)
            structs = pa.StructArray.from_arrays([pa.array([need for need, _ in each], pa.int32()),
                                                  list_column(np.array([len(k) for _, k in each], np.int32), pa.array(flat))], ["need", "keys"])
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 list_column(np.array([len(x) for x in bits], np.int32), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))),
                 list_column(np.array([len(row) for row in bands], np.int32), structs)], ["_id", "n", "sig", "bits", "bands"])

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInArrow(run, f"_id {kind}, n long, sig binary, bits array<long>, bands array<struct<need:int,keys:array<long>>>")


def _key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the keys as 64-bit words: ``bits`` is at most 2^25, so the driver and each task hold 4 MB."""
    words = np.zeros(bits // 64, np.int64)
    places = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) for s in KEY_SHIFTS]))
    got = (keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("i"))
           .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("w")).toArrow())
    words[got["i"].to_numpy()] = got["w"].to_numpy()
    return words.view(np.uint64)


def _hits(docs: DataFrame, shared: tuple[np.ndarray, int], crowded: list[tuple[np.ndarray, int]]) -> DataFrame:
    """(node, n, bands) -> (node, n, key): the first keys in the filter ``shared`` of bands with as many of them as a link needs.

    Of h keys in the filter the first h - need + 1 are kept, those in fewest
    filters of ``crowded`` first, then by key: linked nodes keep one in common.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((shared, crowded))

    def inside(key, words, bits):
        hit = np.ones(len(key), bool)
        for s in KEY_SHIFTS:
            p = (key >> s) & (bits - 1)
            hit &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit

    def run(batches):
        shared, crowded = shipped.value
        for b in small_batches(batches):
            bands = b.column("bands")
            each = bands.flatten()
            need, lists = each.field("need").to_numpy(), each.field("keys")
            key, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            band = np.repeat(np.arange(len(each)), lengths)
            hit = inside(key, *shared)
            found = np.bincount(band[hit], minlength=len(each))
            at = np.flatnonzero(hit & (found >= need)[band])
            level = sum((inside(key[at], *f).astype(np.int8) for f in crowded), np.zeros(len(at), np.int8))
            at = at[np.lexsort((key[at], level, band[at]))]
            place = np.arange(len(at)) - np.searchsorted(band[at], band[at])
            at = at[place < (found - need + 1)[band[at]]]
            row = np.repeat(np.arange(len(b)), bands.value_lengths().to_numpy())[band[at]]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(key[at])],
                                             ["node", "n", "key"])

    return docs.mapInArrow(run, "node long, n long, key long")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _t) -> (sig, shingles): shingles as bytes of sorted uint64."""

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            sets = [shingle_set(t, width, hashes) for t in byte_texts(b.column("_t"))]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "shingles"])

    return docs.mapInArrow(run, "sig binary, shingles binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> (a, b, linked) by intersecting the full sets."""

    def run(batches):
        for b in small_batches(batches):
            linked = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    # later rounds ask for few sets: only those that may be asked for are shuffled
    pairs = cut(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = bloom_bits(sets.count())
    words = cut(bloom_words(nodes, "node", bits, FILTER_HASHES))
    sets = sets.where(bloom_hit(words.scalar(), F.col("node"), bits, FILTER_HASHES))
    x = pairs.join(sets.toDF("a", "x"), "a")
    return x.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _open(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, comp) of the keys that hold more than one component."""
    several = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    return cut(join_groups(rows, several, "key"))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches' Hamming distance leaves a link possible; ``sketches``: (node, n, bits)."""
    both = pairs.join(sketches.toDF("a", "an", "abits"), "a").join(sketches.toDF("b", "bn", "bbits"), "b")
    apart = F.aggregate(F.zip_with("abits", "bbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    may = (F.size("abits") != F.size("bbits")) | ((100 + percent) * apart <= (100 - percent) * (F.col("an") + F.col("bn")))
    return both.where(may).select("a", "b")


def _compare(group: pa.Table, percent: int):
    """Batches of pairs (a, b) that may link, of whole groups (key, lo, hi) sorted by these and ``own``."""
    key, lo, hi, own, node, n, comp = (group[c].to_numpy() for c in ("key", "lo", "hi", "own", "node", "n", "comp"))
    lists = group["bits"].combine_chunks()
    flat, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
    at, long = np.cumsum(sizes) - sizes, sizes > BITS // 64
    short = np.empty((len(n), BITS // 64), np.uint64)
    short[~long] = flat[at[~long, None] + np.arange(BITS // 64)]
    wide = flat[at[long, None] + np.arange(BITS // 4)]
    short[long] = np.bitwise_xor.reduce(wide.reshape(-1, 16, BITS // 64), axis=1)  # folded: the sketch of BITS bits
    wide_at = np.cumsum(long) - 1

    def may(x, y, bits):
        apart = np.bitwise_count(bits[0][bits[1][x]] ^ bits[0][bits[1][y]]).sum(axis=1, dtype=np.int64)
        return (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])

    place = np.arange(len(n))
    starts = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)))
    lengths = np.diff(np.append(starts, len(n)))
    end = np.repeat(starts + lengths, lengths)
    second = np.repeat(starts + np.add.reduceat((own == lo).astype(np.int64), starts), lengths)
    first = np.where(lo == hi, place + 1, np.where(own == lo, second, end))
    ends = np.cumsum(end - first)  # of each row's pairs
    r = 0
    while r < len(n):
        done = ends[r - 1] if r else 0
        to = max(r + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        count = end[r:to] - first[r:to]
        x = np.repeat(place[r:to], count)
        y = first[x] + np.arange(len(x)) - np.repeat(ends[r:to] - count - done, count)
        r = to
        keep = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[keep], y[keep]
        keep = may(x, y, (short, place))
        x, y = x[keep], y[keep]
        both = np.flatnonzero(long[x] & long[y])
        keep = np.ones(len(x), bool)
        keep[both] = may(x[both], y[both], (wide, wide_at))
        a, b = node[x[keep]], node[y[keep]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _open_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with a key in common, of different components, whose sketches leave a link possible.

    A key's nodes are dealt into blocks of about ``BLOCK_NODES``, and every two
    blocks are a group; pairs are built and dropped within tasks, a few at a time.
    """
    crowds = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK_NODES)).alias("blocks")).where("blocks > 1")
    dealt = (join_groups(rows, crowds, "key", "left").join(sketches.select("node", "bits"), "node")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "comp", "bits"))

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            # the last group may go on in the next batch
            key, lo, hi = (t[c].to_numpy() for c in ("key", "lo", "hi"))
            whole = int(np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1])).max(initial=-1)) + 1
            if whole:
                yield from _compare(t.slice(0, whole), percent)
            held = t.slice(whole)
        if held is not None:
            yield from _compare(held, percent)

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own").mapInArrow(run, "a long, b long")


def _components(multi: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(node, component) of the nodes that link; ``multi``: (key, node, n) of keys with several nodes."""
    spark = multi.sparkSession
    rows = multi.withColumn("comp", F.col("node"))
    close = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    before = None
    apart_pairs = comps = None  # pairs without a link; those with one are in one component from then on
    for r in range(rounds + 1):
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
        left, n = (sizes.groupBy("key").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("p"), F.sum("m").alias("n"))
                   .agg(F.sum("p") / 2, F.sum("n")).first())
        if not n:
            break
        last = left <= OPEN_PAIRS * n or r == rounds or (before is not None and 2 * left > before)
        before = left
        if last:
            pairs = _open_pairs(rows, sketches, percent).distinct()
        else:
            orders = [F.col("node") if r + j == 0 else F.xxhash64("node", F.lit(r * PIVOTS + j)) for j in range(PIVOTS)]
            pivots = rows.groupBy("key").agg(*[F.min(F.struct(o.alias("o"), "node", "n", "comp")).alias(f"p{j}") for j, o in enumerate(orders)])
            pairs = (join_groups(rows, pivots, "key").withColumn("p", F.explode(F.array(*[f"p{j}" for j in range(PIVOTS)])))
                     .where("comp <> p.comp").select("node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")).where(close)
                     .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
            pairs = _near(pairs, sketches, percent)
        if apart_pairs is not None:
            pairs = pairs.join(apart_pairs, ["a", "b"], "left_anti")
        judged = cut(_verify(pairs, sets, percent))
        links = judged.where("linked").select("a", "b")
        comps = connected_components(links if comps is None else links.union(comps))
        if last:
            break
        unlinked = judged.where("not linked").select("a", "b")
        apart_pairs = unlinked if apart_pairs is None else apart_pairs.union(unlinked)
        rows = _open(rows.drop("comp").join(comps, "node", "left").select(
            "key", "node", "n", F.coalesce("component", "node").alias("comp")))
    return comps if comps is not None else spark.createDataFrame([], "node long, component long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
                       rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, first (true for one row of each component)."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    rows = cut(_sketches(docs, width, percent).withColumn("_row", F.monotonically_increasing_id()))
    # equal sets are one node, the first of their rows; empty sets stay out
    whole = cut(rows.where("n > 0").groupBy("sig").agg(F.min("_row").alias("node"), F.min("_id").alias("id"), F.first("n").alias("n"),
                                                       F.first("bits").alias("bits")))
    copies = join_groups(rows.where("n > 0").select("_row", "sig"), whole.select("sig", "node"), "sig").where("_row <> node")
    firsts = drop_rows(rows.where("n > 0").select("_row", "n", "bands"), F.col("_row"), copies.select(F.col("_row").alias("key")))
    bands_of = firsts.withColumnRenamed("_row", "node")
    shared = cut(bands_of.select(F.explode(F.flatten("bands.keys")).alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    filters = []
    for least in (1, *CROWDED):
        keys = shared.where(F.col("m") > least)
        bits = bloom_bits(keys.count())
        filters.append((_key_filter(keys, bits), bits))
    hits = _hits(bands_of, filters[0], filters[1:])
    # keys that the same nodes hold lead to the same pairs: one of them is enough
    members = hits.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("h0"),
                                      F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h1")).where("m > 1")
    chosen = cut(members.groupBy("m", "lo", "h0", "h1").agg(F.min("key").alias("key")).select("key"))
    multi = cut(join_groups(hits, chosen, "key").select("key", "node", "n"))
    asked = cut(whole.join(multi.select("node").distinct(), "node", "left_semi"))
    # second reading: only documents that may be candidates are cut into shingles again
    asked_bits = bloom_bits(asked.count())
    asked_words = cut(bloom_words(asked.select(F.xxhash64("id").alias("h")), "h", asked_bits, FILTER_HASHES))
    again = docs.where(bloom_hit(asked_words.scalar(), F.xxhash64("_id"), asked_bits, FILTER_HASHES))
    sets = cut(_full_sets(again, width).join(asked.select("sig", "node"), "sig").groupBy("node").agg(F.first("shingles").alias("shingles")))
    comps = _components(multi, asked.select("node", "n", "bits"), sets, percent, rounds)
    named = (whole.select("sig", "node", "id").join(comps, "node", "left")
             .select("sig", "id", F.col("node"), F.coalesce("component", "node").alias("comp")))
    heads = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_set = join_groups(named, heads, "comp").select("sig", "component_id", F.col("comp"))
    out = join_groups(rows.where("n > 0").drop("bands", "bits"), by_set, "sig")
    # the row that stands for the component: its smallest id, and of repeated rows the first
    head = out.groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_row")).alias("h"))
    out = join_groups(out, head, "comp").select("_id", "n", "component_id", (F.col("_row") == F.col("h._row")).alias("first"))
    empty = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(empty).withColumnsRenamed({"_id": id_col, "n": "n_shingles"})


def op2_ngram_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("first")
