"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of at least ``max(MIN_WORDS, 2 * q)`` words, that no
neighbouring word extends keeping period q.

1. Distances are searched at dyadic scales: blocks of B = 2, 4, 8, ... words at
   every multiple of B, for distances 2B to 4B - 1 (and blocks of 4 for the
   distances 1 to 3).  Each run of period q holds a block of its scale together
   with the block's copy q words on.
2. The sum of squared differences between a block and every place of its
   window is the sum of two prefix sums less twice a correlation, which a
   number-theoretic transform gives exactly, as integers modulo a prime.  Where
   the sum is zero the block may occur again; the places are then compared
   word by word, as a sum could be zero by the modulus alone.
3. Neighbouring blocks with the same distance make one seed, which is extended
   to both sides while words q apart agree.  Of seeds with the same extent the
   smallest distance is the period.

Two kinds of blocks need no transform: those with a word that isn't repeated
within the window, and those whose window lies in a run already found with a
period of at most B words (a copy there is a multiple of that period, by the
theorem of Fine and Wilf, and belongs to the same run).

Texts are worked on a few megabytes at a time, all of their blocks of a scale
together; a transform is as long as four blocks, in slices of bounded size.

Defined cases: a null text counts as empty, a text without words has no runs;
null ids are allowed; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import byte_texts, let, list_column, table

MIN_WORDS = 12
SLAB_BYTES = 2 << 20     # bytes of text worked on together
SLICE = 1 << 20          # numbers of a transform held at once
PRIME = np.uint64(998244353)         # 119 * 2^23 + 1
GENERATOR, TWO_POWER = 3, 23
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


# --- number-theoretic transform, a row at a time of a matrix -----------------------------------------

_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a * b
    return c - c // PRIME * PRIME


def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half - 1 of a root of unity of order 2 * half."""
    if (half, inverse) not in _ROOTS:
        p = int(PRIME)
        w = pow(GENERATOR, (p - 1) // (2 * half), p)
        step = np.uint64(pow(w, p - 2, p) if inverse else w)
        r = np.ones(1, dtype=np.uint64)
        while len(r) < half:  # r holds the powers below len(r); step is the root to the power len(r)
            r = np.concatenate([r, _times(r, step)])
            step = _times(step, step)
        _ROOTS[half, inverse] = r
    return _ROOTS[half, inverse]


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of each row; the result is in bit-reversed order."""
    rows, n = a.shape
    half = n // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        x, y = v[:, :, 0], v[:, :, 1]
        out = np.empty_like(v)
        s = x + y
        np.minimum(s, s - PRIME, out=out[:, :, 0])  # unsigned: s - PRIME is huge for s below PRIME
        out[:, :, 1] = _times(x + PRIME - y, _roots(half, False))
        a, half = out.reshape(rows, n), half // 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    rows, n = a.shape
    half = 1
    while half < n:
        v = a.reshape(rows, -1, 2, half)
        x, y = v[:, :, 0], _times(v[:, :, 1], _roots(half, True))
        out = np.empty_like(v)
        s, d = x + y, x + PRIME - y
        np.minimum(s, s - PRIME, out=out[:, :, 0])
        np.minimum(d, d - PRIME, out=out[:, :, 1])
        a, half = out.reshape(rows, n), half * 2
    return _times(a, np.uint64(pow(n, int(PRIME) - 2, int(PRIME))))


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row, modulo PRIME: sums of squared differences of a block and each place of its window."""
    b, w = blocks.shape[1], windows.shape[1]
    n = 1 << (b + w - 2).bit_length()
    if n > 1 << TWO_POWER:
        if w - b + 1 > b:  # half of the places at a time
            h = (w - b + 1) // 2
            return np.concatenate([squared_differences(blocks, windows[:, :h + b - 1]), squared_differences(blocks, windows[:, h:])], axis=1)
        h = b // 2  # the sum over a block is the sum over its halves
        s = squared_differences(blocks[:, :h], windows[:, :w - b + h]) + squared_differences(blocks[:, h:], windows[:, h:])
        return np.minimum(s, s - PRIME)
    pad = np.zeros((2 * len(blocks), n), dtype=np.uint64)
    pad[:len(blocks), :b] = blocks[:, ::-1]
    pad[len(blocks):, :w] = windows
    f = transform(pad)
    cross = inverse(_times(f[:len(blocks)], f[len(blocks):]))[:, b - 1:w]
    own = _times(blocks, blocks).sum(axis=1, keepdims=True) % PRIME
    sums = np.zeros((len(windows), w + 1), dtype=np.uint64)
    np.cumsum(_times(windows, windows), axis=1, out=sums[:, 1:])  # below 2^64 for any window of fewer than 2^34 words
    there = (sums[:, b:] - sums[:, :-b]) % PRIME
    return (own + there + 2 * (PRIME - cross)) % PRIME


# --- seeds and runs -----------------------------------------------------------------------------------

def scales(longest: int) -> list[tuple[int, int, int]]:
    """(block, smallest distance, number of distances) for periods up to half of ``longest`` words."""
    out, b = [(4, 1, 3)], 2
    while 2 * b <= longest // 2:
        out.append((b, 2 * b, 2 * b))
        b *= 2
    return out


def _next_same(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distance to the next occurrence of the same word in the same text; huge if there is none."""
    far = np.full(len(codes), np.iinfo(np.int64).max, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    a, b = order[:-1], order[1:]
    same = (codes[a] == codes[b]) & (doc[a] == doc[b])
    far[a[same]] = (b - a)[same]
    return far


class _Found:
    """Runs found so far; which of them reaches furthest from a place."""

    def __init__(self):
        self.rows: dict[tuple[int, int], int] = {}

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
            if q < self.rows.get((s, e), q + 1):
                self.rows[s, e] = q

    def cover(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End and period of the run that begins at or before x and reaches furthest (end 0: none)."""
        if not self.rows:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int64)
        t = np.array(sorted((s, e, q) for (s, e), q in self.rows.items()), dtype=np.int64)
        end = np.maximum.accumulate(t[:, 1])
        period = t[:, 2][np.maximum.accumulate(np.where(t[:, 1] == end, np.arange(len(t)), 0))]
        at = np.searchsorted(t[:, 0], x, side="right") - 1
        return np.where(at < 0, 0, end[at]), period[at]


def _equal(codes: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from x on are those from y on."""
    ok = np.ones(len(x), dtype=bool)
    step = max(1, SLICE // n)
    for i in range(0, len(x), step):
        span = np.arange(n)
        ok[i:i + step] = (codes[x[i:i + step, None] + span] == codes[y[i:i + step, None] + span]).all(axis=1)
    return ok


def _extend(codes: np.ndarray, at: np.ndarray, q: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``at`` on (sign 1) or back (sign -1) equal those q words on, up to ``room``."""
    got, live, width = np.zeros(len(at), dtype=np.int64), np.flatnonzero(room > 0), 4
    while len(live):
        grown = []
        for part in np.array_split(live, len(live) * width // SLICE + 1):
            step = np.arange(width)
            i = at[part, None] + sign * (got[part, None] + step)
            inside = got[part, None] + step < room[part, None]
            i = np.where(inside, i, at[part, None])
            same = inside & (codes[i] == codes[i + q[part, None]])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            got[part] += n
            grown.append(part[(n == width) & (got[part] < room[part])])
        live, width = np.concatenate(grown), min(2 * width, SLICE)
    return got


def runs_of(codes: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of every run; texts follow one another in ``codes``."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    last = first + lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    again = _next_same(codes, doc)
    values = codes.astype(np.uint64) + np.uint64(1)
    found = _Found()
    for b, low, wide in scales(int(lengths.max(initial=0))):
        n = np.maximum((lengths - low) // b, 0)  # blocks with room for the smallest distance
        if not n.any():
            continue
        x = np.repeat(first - b * (np.cumsum(n) - n), n) + b * np.arange(n.sum())
        alone = np.concatenate([[0], np.cumsum(again >= low + wide)])
        x = x[alone[x + b] == alone[x]]
        end, period = found.cover(x)
        x = x[(end < x + low + wide - 1 + b) | (period > b)]
        if not len(x):
            continue
        seeds = []
        reach = wide + b - 1
        step = max(1, SLICE // (1 << (reach + b - 2).bit_length()))
        for i in range(0, len(x), step):
            part = x[i:i + step, None]
            there = values[np.minimum(part + low + np.arange(reach), len(codes) - 1)]
            at, q = np.nonzero(squared_differences(values[part + np.arange(b)], there) == 0)
            seeds.append(np.stack([part[at, 0], q + low]))
        at, q = np.concatenate(seeds, axis=1)
        keep = at + q + b <= last[doc[at]]
        at, q = at[keep], q[keep]
        end, period = found.cover(at)
        keep = (end < at + q + b) | (q % period != 0)
        at, q = at[keep], q[keep]
        keep = _equal(codes, at, at + q, b)
        at, q = at[keep], q[keep]
        if not len(at):
            continue
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        head = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(at) != b) | (np.diff(doc[at]) != 0)])
        tail = np.concatenate([head[1:], [True]])
        start, stop, q = at[head], at[tail] + b, q[head]
        start = start - _extend(codes, start - 1, q, start - first[doc[start]], -1)
        stop = stop + _extend(codes, stop, q, last[doc[start]] - stop - q, 1) + q
        keep = stop - start >= np.maximum(MIN_WORDS, 2 * q)
        found.add(start[keep], stop[keep], q[keep])
    return found.rows


def _slab(texts: list[bytes]):
    """(number of words, runs, collapsed text) of each text."""
    words = [t.split() for t in texts]  # bytes split at the six ASCII blanks
    code = defaultdict(itertools.count().__next__)
    codes = np.fromiter(map(code.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=sum(map(len, words)))
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for (s, e), q in runs_of(codes, lengths).items():
        d = int(np.searchsorted(first, s, side="right")) - 1
        by_text[d].append((s - int(first[d]), e - s, q))
    for d, w in enumerate(words):
        runs = sorted(by_text.get(d, ()), key=lambda r: (r[0], r[2]))
        if runs:
            edge = np.zeros(len(w) + 1, dtype=np.int64)
            for s, n, q in runs:
                edge[s + q] += 1
                edge[s + n] -= 1
            w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield int(lengths[d]), runs, b" ".join(w)


def _batch(batches):
    for b in batches:
        texts, ids = byte_texts(b[1]), b[0]
        done = 0
        while done < b.num_rows:
            slab, size = [], 0
            while size < SLAB_BYTES and done + len(slab) < b.num_rows:
                slab.append(next(texts))
                size += len(slab[-1])
            n, runs, collapsed = zip(*_slab(slab))
            flat = np.array([r for one in runs for r in one], dtype=np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(done, len(slab)), pa.array(n, pa.int64()), list_column(np.array([len(r) for r in runs]), items),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
            done += len(slab)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` joins by one space the words that no run holds after its first period.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
            .mapInArrow(_batch, f"id {kind}, {RUNS}").withColumnRenamed("id", id_col))


# --- the registered query -------------------------------------------------------------------------------

def _with_planted_runs(id_col: Column, text: Column) -> Column:
    """The contract's damage: of ids whose crc32 ends in 0, words from g % n on repeat with period p."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(a, lambda a: let(p, lambda p: F.array_join(
            F.transform(words, lambda w, i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, repeated)).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    """Runs of every document's words, a tenth of the documents with planted ones, and the collapsed texts' digests."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", _with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                  r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.q")).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
