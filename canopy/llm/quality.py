"""Quality classifier by co-training of two views.

The text view sees a document's words (hashed) and the shape of its text; the
metadata view sees its source, language and length.  Both are logistic
regressions.  In each round each view, calibrated on labelled rows that neither
is fitted on, labels the unlabelled documents it is sure of, and these join
the other view's training rows.  At the end a regression over the two views'
calibrated log-odds combines them, and every document is scored.

There are two such classifiers, one for the quality label and one for the
toxic label; ``score`` is the probability of good quality times that of not
being toxic.  A document is kept unless one of them speaks against it; the
thresholds keep at least ``KEEP_GOOD`` of the held-back rows without fault.

The labelled rows are a bounded sample: of the documents with a label, the
``MAX_LABELLED`` whose hashed ids are smallest; the words used are those that
tell its labels apart.  Unlabelled documents are all used: every round labels
each of them anew, and those that are sure enter as sums of gradients, one from
each task.  Scoring reads every text as a whole.

Defined cases: null texts score as empty ones, null metadata as a value of its
own; labels that are null or of no document are left out, of several labels for one document the
worst counts; documents with a null id are unlabelled; a classifier with no labels, or labels of one kind,
says 0.5 for everything and rejects nothing; repeated rows and null ids are scored alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import cut, join_groups, list_column, small_batches, table

MAX_LABELLED = 6_000
ROUNDS = 4
CONFIDENT = 0.95        # calibrated probability that a pseudo-label needs
PSEUDO_WEIGHT = 0.5     # of a pseudo-label, and the most that all of a kind weigh by one labelled row of that kind
KEEP_GOOD = 0.995
BITS = 20
MIN_Z = 4.0             # words whose share differs by so many standard errors between the labels are used
MIN_ROWS = 5
WORD_SLOTS = 1 << BITS
SHAPES = 14
META_SLOTS = 1 << 12
META = 5                # values of a document's metadata
STEPS, MORE_STEPS = 150, 40
REFRESH = 4             # steps between two passes over the unlabelled documents
FIXED = 2.0 ** 32       # sums of tasks are added up as whole numbers, in whatever order they come
CACHE_WORDS = 1 << 15   # words whose places a task remembers
WORD = re.compile(r"[^\W\d_]+")


class Slots(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace")) & (WORD_SLOTS - 1)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def text_features(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): hashed words, then measures of the text's shape."""
    t = text or ""
    words = WORD.findall(t.lower())
    counts = Counter(words)
    at = np.unique(np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts)))
    n, lines = max(1, len(t)), t.split("\n")
    letters = sum(map(len, words))
    marks = sum(map(t.count, "&#$%*|!"))
    upper = sum(1 for w in t.split() if len(w) > 1 and w.isupper())
    tokens = max(1, t.count(" ") + t.count("\n") + 1)
    shape = np.array([
        letters / n, 10 * marks / n, upper / tokens, 5 * sum(map(t.count, "0123456789")) / n, np.log1p(len(words)) / 8,
        len(counts) / max(1, len(words)), 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 5, letters / max(1, len(words)) / 10,
        10 * t.count("|") / n, 10 * t.count("!") / n, 10 * (t.count("\\") + t.count("{") + t.count("<")) / n,
        float(len(words) < 20), 1.0])
    return np.concatenate([at, WORD_SLOTS + np.arange(SHAPES)]), np.concatenate([np.ones(len(at)), shape])


def meta_features(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the metadata, each value and the pairs of source and language hashed."""
    size = "null" if n_chars is None else str(int(n_chars).bit_length())
    keys = [f"s={source}", f"l={lang}", f"n={size}", f"sl={source}|{lang}", "1"]
    return np.array([zlib.crc32(k.encode()) & (META_SLOTS - 1) for k in keys]), np.ones(len(keys))


class Rows:
    """Sparse rows for the regression."""

    def __init__(self, row: np.ndarray, at: np.ndarray, v: np.ndarray, n: int, size: int):
        self.row, self.at, self.v, self.n, self.size = row, at, v, n, size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.v * w[self.at], minlength=self.n)

    def only(self, columns: np.ndarray) -> Rows:
        place = np.full(self.size, -1)
        place[columns] = np.arange(len(columns))
        keep = place[self.at] >= 0
        return Rows(self.row[keep], place[self.at[keep]], self.v[keep], self.n, len(columns))


def telling(x: Rows, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Columns of words that tell the labels apart, and all columns of the shape."""
    n1, n0 = max(1, (rows & (y == 1)).sum()), max(1, (rows & (y == 0)).sum())
    c1 = np.bincount(x.at[(rows & (y == 1))[x.row]], minlength=x.size)
    c0 = np.bincount(x.at[(rows & (y == 0))[x.row]], minlength=x.size)
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    use = (z >= MIN_Z) & (c1 + c0 >= MIN_ROWS)
    use[WORD_SLOTS:] = True
    return np.flatnonzero(use)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(x: Rows, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by full-gradient steps with momentum and per-weight scaling."""
    w, adam = np.zeros(x.size), Steps(x.size)
    for _ in range(STEPS):
        w = adam.step(w, gradient(x, y, weight, w) / weight.sum() + l2 * w)
    return w


def gradient(x: Rows, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.bincount(x.at, x.v * ((sigmoid(x.dot(w)) - y) * weight)[x.row], minlength=x.size)


class Steps:
    """Steps with momentum and per-weight scaling."""

    def __init__(self, size: int):
        self.m, self.s, self.k = np.zeros(size), np.zeros(size), 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.k += 1
        self.m, self.s = 0.9 * self.m + 0.1 * g, 0.99 * self.s + 0.01 * g * g
        return w - 0.1 * (self.m / (1 - 0.9 ** self.k)) / (np.sqrt(self.s / (1 - 0.99 ** self.k)) + 1e-6)


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Small logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(y) + l2 * w)
    return w


class Head:
    """One classifier while it is fitted: labelled rows on the driver, sums over the unlabelled ones from outside.

    ``y``: 1, 0 or -1 (label not known) by row; ``held``: rows kept for calibration.
    """

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray, held: np.ndarray):
        self.train, self.cal = (y >= 0) & ~held, (y >= 0) & held
        self.ok = len(set(y[self.train])) == 2 and len(set(y[self.cal])) == 2
        if not self.ok:
            return
        self.columns, self.y = telling(text, y, self.train), y
        self.views = (text.only(self.columns), meta)
        self.count = np.array([(self.train & (y == c)).sum() for c in (0, 1)])
        self.balance = (self.train.sum() / 2) / self.count
        self.label = np.where(self.train, y, 0)
        self.mass = self.train * self.balance[self.label]
        self.weights = [fit_rows(x, self.label, self.mass) for x in self.views]
        self.calibrate()

    def calibrate(self) -> None:
        self.odds = np.column_stack([x.dot(w) for x, w in zip(self.views, self.weights)])
        self.platt = [fit_dense(self.odds[self.cal, i:i + 1], self.y[self.cal]) for i in (0, 1)]
        self.adam = [Steps(x.size) for x in self.views]

    def steps(self, sums: list, l2: float = 1e-3) -> None:
        """``REFRESH`` steps of each view; ``sums``: by view and kind, the number of pseudo-labels and their gradient."""
        for i, x in enumerate(self.views):
            share = [self.balance[c] * PSEUDO_WEIGHT * min(1.0, self.count[c] / max(1, sums[i][c][0])) for c in (0, 1)]
            pseudo = share[0] * sums[i][0][1] + share[1] * sums[i][1][1]
            total = self.mass.sum() + sum(share[c] * sums[i][c][0] for c in (0, 1))
            for _ in range(REFRESH):
                w = self.weights[i]
                self.weights[i] = self.adam[i].step(w, (gradient(x, self.label, self.mass, w) + pseudo) / total + l2 * w)

    def model(self) -> dict:
        calibrated = np.column_stack([self.odds[:, i] * p[0] + p[1] for i, p in enumerate(self.platt)])
        mix = fit_dense(calibrated[self.cal], self.y[self.cal])
        whole = np.zeros(WORD_SLOTS + SHAPES, np.float32)
        whole[self.columns] = self.weights[0]
        return {"weights": (whole, self.weights[1]), "platt": self.platt, "mix": mix, "score": sigmoid(calibrated @ mix[:2] + mix[2])}


def pool_rows(docs: DataFrame, known: DataFrame, columns: np.ndarray) -> DataFrame:
    """q, t (null where not known), at, shape, meta of every document without one of the labels; ``columns``: the words used."""
    sent = docs.sparkSession.sparkContext.broadcast(columns)

    def features(batches):
        slots, place = Slots(), np.full(WORD_SLOTS, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value))
        for b in small_batches(batches):
            c, at, shape, meta = b.to_pydict(), [], [], []
            for text, *m in zip(c["text"], c["source"], c["lang"], c["n_chars"]):
                a, v = text_features(text, slots)
                a = place[a[:-SHAPES]]
                at.append(a[a >= 0])
                shape.append(v[-SHAPES:])
                meta.append(meta_features(*m)[0])
            n = len(at)
            flat = [np.concatenate(x or [np.zeros(0)]) for x in (at, shape, meta)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), list_column(np.array([len(a) for a in at], np.int32), pa.array(flat[0].astype(np.int32))),
                 list_column(np.full(n, SHAPES), pa.array(flat[1].astype(np.float32))), list_column(np.full(n, META), pa.array(flat[2].astype(np.int32)))],
                ["doc_id", "at", "shape", "meta"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
            .mapInArrow(features, "doc_id long, at array<int>, shape array<float>, meta array<int>"))
    return join_groups(rows, known, "doc_id", "left").where("q is null or q < 0 or t is null or t < 0").drop("doc_id")


def pseudo_sums(pool: DataFrame, heads: list[Head | None], judges: list, columns: np.ndarray) -> list:
    """By head, view and kind: the number of documents of which the other view is sure, and their gradient.

    ``judges``: each head's (weights, platt) at the start of the round.  A task
    sends one vector, however many documents it reads.
    """
    d = len(columns) + SHAPES
    spread = []  # both views' weights, in the judge's state and as they are, on the words of all heads
    for h, judge in zip(heads, judges):
        if h is None:
            spread.append(None)
            continue
        at = np.concatenate([np.searchsorted(columns, h.columns[:-SHAPES]), len(columns) + np.arange(SHAPES)])
        wide = [np.zeros(d), np.zeros(d)]
        for to, w in zip(wide, (judge[0][0], h.weights[0])):
            to[at] = w
        spread.append((wide, (judge[0][1], h.weights[1]), judge[1], at))
    width = [d, META_SLOTS]
    sc = pool.sparkSession.sparkContext
    sent = sc.broadcast([x and x[:3] for x in spread])

    def run(batches):
        out = [x and [[np.zeros(1 + n) for _ in (0, 1)] for n in width] for x in sent.value]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            column = {x: b.column(b.schema.get_field_index(x)) for x in ("q", "t", "at", "shape", "meta")}
            lists, shape = column["at"], column["shape"].flatten().to_numpy().astype(float).reshape(n, SHAPES)
            at, row = lists.flatten().to_numpy(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            meta = column["meta"].flatten().to_numpy().reshape(n, META)

            def text_dot(w):
                return np.bincount(row, w[at], minlength=n) + shape @ w[-SHAPES:]

            for x, label, sums in zip(sent.value, ("q", "t"), out):
                if x is None:
                    continue
                text, side, platt = x
                free = np.array([y is None or y < 0 for y in column[label].to_pylist()], dtype=bool)
                p = [sigmoid(o * k[0] + k[1]) for o, k in zip((text_dot(text[0]), side[0][meta].sum(axis=1)), platt)]
                now = (sigmoid(text_dot(text[1])), sigmoid(side[1][meta].sum(axis=1)))
                for i in (0, 1):
                    for c in (0, 1):
                        sure = free & ((p[1 - i] if c else 1 - p[1 - i]) >= CONFIDENT)
                        e = np.where(sure, now[i] - c, 0.0)
                        sums[i][c][0] += sure.sum()
                        if i:
                            sums[i][c][1:] += np.bincount(meta.ravel(), np.repeat(e, META), minlength=META_SLOTS)
                        else:
                            sums[i][c][1:d - SHAPES + 1] += np.bincount(at, e[row], minlength=d - SHAPES)
                            sums[i][c][d - SHAPES + 1:] += e @ shape
        flat = np.concatenate([v for x in out if x for view in x for v in view])
        yield pa.RecordBatch.from_arrays([pa.array([np.round(flat * FIXED).astype(np.int64).tobytes()], pa.binary())], ["sums"])

    total = np.zeros(2 * sum(x is not None for x in spread) * sum(1 + n for n in width), np.int64)
    for r in pool.mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r[0], np.int64)
    total = total / FIXED
    sent.destroy()
    found, k = [], 0
    for x in spread:
        if x is None:
            found.append(None)
            continue
        views = []
        for i, n in enumerate(width):
            parts = [total[k + j * (n + 1):k + (j + 1) * (n + 1)] for j in (0, 1)]
            views.append([(v[0], v[1:][x[3]] if i == 0 else v[1:]) for v in parts])
            k += 2 * (n + 1)
        found.append(views)
    return found


def co_train(heads: list[Head | None], docs: DataFrame, known: DataFrame) -> None:
    """The rounds, over every document without a label."""
    if not any(heads):
        return
    columns = np.unique(np.concatenate([h.columns[:-SHAPES] for h in heads if h]))
    pool = cut(pool_rows(docs, known, columns))
    pool = pool.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)  # as many sums as tasks run, at any size
    for _ in range(ROUNDS):
        judges = [h and ([w.copy() for w in h.weights], h.platt) for h in heads]
        for _ in range(MORE_STEPS // REFRESH):
            for h, sums in zip(heads, pseudo_sums(pool, heads, judges, columns)):
                if h:
                    h.steps(sums)
        for h in heads:
            if h:
                h.calibrate()


def probability(head: dict | None, at: np.ndarray, v: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
    """Combined probability and those of the two views."""
    if head is None:
        return 0.5, 0.5, 0.5
    odds = (float(head["weights"][0][at] @ v), float(head["weights"][1][meta].sum()))
    a, b = (o * p[0] + p[1] for o, p in zip(odds, head["platt"]))
    m = head["mix"]
    return float(sigmoid(a * m[0] + b * m[1] + m[2])), float(sigmoid(a)), float(sigmoid(b))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The two classifiers and their thresholds."""
    known = (labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
             .agg(F.coalesce(F.min("quality"), F.lit(-1)).cast("int").alias("q"), F.coalesce(F.max("toxic"), F.lit(-1)).cast("int").alias("t")))
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id", F.lit(11))).limit(max_labelled))  # at most max_labelled ids
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(sample, "doc_id")

    def features(batches):
        slots = Slots()
        for b in batches:
            c = b.to_pydict()
            t = [text_features(x, slots) for x in c["text"]]
            m = [meta_features(*x)[0] for x in zip(c["source"], c["lang"], c["n_chars"])]
            sizes = np.array([len(a) for a, _ in t], np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("q"), b.column("t"), list_column(sizes, pa.array(np.concatenate([a for a, _ in t]).astype(np.int32))),
                 list_column(sizes, pa.array(np.concatenate([v for _, v in t]).astype(np.float32))), pa.array(m, pa.list_(pa.int32()))],
                ["doc_id", "q", "t", "at", "v", "meta"])

    got = rows.mapInArrow(features, "doc_id long, q int, t int, at array<int>, v array<float>, meta array<int>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")  # whatever order tasks end in
    n = len(order)

    def sparse(at: pa.ChunkedArray, v: np.ndarray | None, size: int) -> Rows:
        at = at.combine_chunks()
        lengths, flat = np.diff(at.offsets.to_numpy()), at.flatten().to_numpy().astype(np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return Rows(np.repeat(place, lengths), flat, np.ones(len(flat)) if v is None else v, n, size)

    if not n:
        return {"quality": None, "toxic": None}
    text = sparse(got["at"], got["v"].combine_chunks().flatten().to_numpy().astype(np.float64), WORD_SLOTS + SHAPES)
    side = sparse(got["meta"], None, META_SLOTS)
    q, t = (got[x].to_numpy()[order] for x in ("q", "t"))
    held = np.array([zlib.crc32(str(x).encode()) % 3 == 0 for x in got["doc_id"].to_numpy()[order]], dtype=bool)
    heads = [h if (h := Head(text, side, y, held)).ok else None for y in (q, t)]
    co_train(heads, docs, known)
    model = {k: h and h.model() for k, h in zip(("quality", "toxic"), heads)}
    if model["quality"]:
        fine = np.sort(model["quality"].pop("score")[held & (q == 1) & (t != 1)])
        model["quality"]["least"] = float(min(0.5, fine[int(len(fine) * (1 - KEEP_GOOD))])) if len(fine) else 0.0
    if model["toxic"]:
        fine = np.sort(model["toxic"].pop("score")[held & (t == 0)])
        model["toxic"]["most"] = float(max(0.5, fine[min(len(fine) - 1, int(len(fine) * KEEP_GOOD))])) if len(fine) else 1.0
    return model


def score(docs: DataFrame, model: dict, keep: list[str] = ()) -> DataFrame:
    """Columns of ``keep``, then score, p_quality, p_text, p_meta, p_toxic, kept for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * (WORD_SLOTS + SHAPES + META_SLOTS) numbers
    rows = docs.select(*keep, F.col("text").alias("_t"), F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("n_chars").alias("_n"))

    def run(batches):
        slots, good, bad = Slots(), sent.value["quality"], sent.value["toxic"]
        for b in small_batches(batches):
            out = []
            for t, s, lang, n in zip(*(b.column(x).to_pylist() for x in ("_t", "_s", "_l", "_n"))):
                at, v = text_features(t, slots)
                meta, _ = meta_features(s, lang, n)
                p, p_text, p_meta = probability(good, at, v, meta)
                toxic = probability(bad, at, v, meta)[0]
                out.append((p * (1 - toxic), p, p_text, p_meta, toxic,
                            (good is None or p >= good["least"]) and (bad is None or toxic <= bad["most"])))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *(pa.array(c, k) for c, k in zip(cols, [pa.float64()] * 5 + [pa.bool_()]))],
                                             [*keep, "score", "p_quality", "p_text", "p_meta", "p_toxic", "kept"])

    fields = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:len(keep)])
    return rows.mapInArrow(run, f"{fields}score double, p_quality double, p_text double, p_meta double, p_toxic double, kept boolean")


def op4_quality(spark, sf_dir):
    """Quality score of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
