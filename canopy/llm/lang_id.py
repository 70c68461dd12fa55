"""Language identification by words, backing off to shorter and shorter character n-grams.

A word known to the model scores, in each language, the log of its relative
frequency there.  An unseen word is covered by the longest known n-grams of
its characters: n-grams of 4, then 3, 2 and 1 characters.  A text's language
is the one with the largest summed score plus log prior.

Counts are taken over every training text, and every counted word and n-gram is
known, with its share in each language.  Tasks hold the words that make up at
least ``min_share`` of a language, so at most 1 / min_share a language at any
corpus size.  Other words are numbered within a block of documents and looked
up by a join, once a block; the n-grams of those that are unseen by another,
once a word.  The answers meet the documents block by block, and a block's size
is bounded.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is everything when there is no training row; ties go to the first language
in alphabetical order; repeated rows count as often as they occur; rows with a
null id are training rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import cut, join_groups, table

MIN_SHARE = 1e-5
ORDERS = (4, 3, 2, 1)
FLOOR = math.log(1e-7)      # score of what a language has not shown, or that of half an occurrence if this is less
UNIT = float(1 << 24)       # scores of joined words are added up in whole numbers; none is below -128, so each fits an int
FLUSH = 200_000             # entries of a task's counter before it is passed on
CHUNK = 100_000             # words of a text that are scored at once
BLOCK_WORDS, BLOCK_ENTRIES, BLOCK_ROWS = 1 << 20, 1 << 22, 1 << 16  # a block of documents ends with the text that reaches one of them
SPLITS = 4                  # input partitions that a task scores, if enough tasks are left
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")   # letters, and marks behind one; no other number or sign is a letter
ASCII_WORD = re.compile(r"[a-z]+")             # the same in lower-cased ASCII, found sooner


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i:i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def pack(ids: np.ndarray) -> bytes:
    """Numbers in any order, repeats included, as their count and sorted differences: 2 bytes each, 6 if above 65,534."""
    steps = np.diff(np.sort(ids), prepend=0)
    far = steps >= 0xFFFF
    return b"".join([np.uint32(len(ids)).tobytes(), np.where(far, 0xFFFF, steps).astype("<u2").tobytes(), steps[far].astype("<u4").tobytes()])


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of :func:`pack`, sorted."""
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    steps = np.frombuffer(packed, "<u2", n, 4).astype(np.int64)
    steps[steps == 0xFFFF] = np.frombuffer(packed, "<u4", -1, 4 + 2 * n)
    return np.cumsum(steps)


def release(spark) -> None:
    """Let Spark remove the shuffles and checkpoints of frames that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def count_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all texts; each task adds up before it shuffles."""

    def count(batches):
        seen: dict[str, Counter] = {}

        def rows():
            out = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))],
                                              ["lang", "word", "n"])
        for b in batches:
            for text, lang in zip(b[0].to_pylist(), b[1].to_pylist()):
                if text:
                    seen.setdefault(lang, Counter()).update(words_of(text))
                    if sum(map(len, seen.values())) > FLUSH:
                        yield rows()
        if any(seen.values()):
            yield rows()

    return (docs.select(text_col, lang_col).mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> dict:
    """The model: languages, priors, the frequent words with their log frequencies by language, and all entries as a DataFrame."""
    docs = docs.where(F.col(lang_col).isNotNull())
    n_docs = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    langs = sorted(n_docs)
    total = sum(n_docs.values())
    if not langs:
        return {"langs": []}
    counts = cut(count_words(docs, text_col, lang_col))

    def split(batches):
        seen: dict[str, list] = {}

        def rows():
            for lang, tables in seen.items():
                for k, c in zip(ORDERS, tables):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(np.full(len(c), k, np.int32)),
                                                      pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                                                     ["lang", "k", "entry", "n"])
            seen.clear()

        for b in batches:
            for lang, word, n in zip(*(x.to_pylist() for x in b.columns)):
                tables = seen.get(lang)
                if tables is None:
                    tables = seen[lang] = [defaultdict(int) for _ in ORDERS]
                for k, c in zip(ORDERS, tables):
                    for g in grams(word, k):
                        c[g] += n
            if sum(len(c) for tables in seen.values() for c in tables) > FLUSH:
                yield from rows()
        yield from rows()

    parts = (counts.select("lang", "word", "n").mapInArrow(split, "lang string, k int, entry string, n long")
             .unionByName(counts.select("lang", F.lit(0).alias("k"), F.col("word").alias("entry"), "n")))
    wide = cut(parts.groupBy("k", "entry").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"c{i}") for i, x in enumerate(langs)]))
    del counts, parts
    release(docs.sparkSession)
    sums = {r["k"]: [r[f"c{i}"] or 0 for i in range(len(langs))]
            for r in wide.groupBy("k").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(langs))]).collect()}
    sums = {k: sums.get(k, [0] * len(langs)) for k in (0, *ORDERS)}
    floors = {k: [min(FLOOR, math.log(0.5 / n)) if n else FLOOR for n in ns] for k, ns in sums.items()}

    def by_order(values, i):
        return F.create_map(*[F.lit(x) for k, ns in values.items() for x in (k, float(ns[i]))])[F.col("k")]

    share = [F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") / by_order(sums, i)) for i in range(len(langs))]
    entries = wide.select("k", "entry", F.array(*[F.coalesce(F.ln(x), by_order(floors, i)) for i, x in enumerate(share)]).alias("scores"),
                          (F.array_max(F.array(*share)) >= min_share).alias("frequent"))
    known, scores = [], []
    for entry, x in entries.where("k = 0 and frequent").select("entry", "scores").repartition(8).toLocalIterator():  # bounded by min_share
        known.append(entry)
        scores.append(x)
    return {"langs": langs, "prior": np.log([n_docs[x] / total for x in langs]), "known": known, "scores": np.array(scores).reshape(-1, len(langs)),
            "entries": entries, "floor": floors[ORDERS[-1]]}


def unseen_scores(words: DataFrame, model: dict) -> DataFrame:
    """(word, scores) of distinct ``words``: the mean over the longest known n-grams that cover a word."""
    found = []
    for k in ORDERS:
        def split(batches, k=k):
            for b in batches:
                lists = [grams(w, k) for w in b[0].to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                yield pa.RecordBatch.from_arrays([b[0].take(pa.array(np.repeat(np.arange(len(lists)), sizes))),
                                                  pa.array([g for x in lists for g in x], pa.string())], ["word", "gram"])

        table_k = model["entries"].where(F.col("k") == k).select(F.col("entry").alias("gram"), "scores")
        got = cut(join_groups(words.mapInArrow(split, "word string, gram string"), table_k, "gram")
                  .groupBy("word").agg(F.array(*[F.avg(F.col("scores")[i]) for i in range(len(model["langs"]))]).alias("scores")))
        found.append(got)
        words = cut(words.join(got.select("word"), "word", "left_anti"))
        release(words.sparkSession)
    found.append(words.select("word", F.array(*[F.lit(float(x)) for x in model["floor"]]).alias("scores")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """id, the columns of ``keep``, lang_pred, score for every row."""
    langs = model["langs"]
    rows = df.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    if not langs:
        return rows.drop("_text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = df.sparkSession.sparkContext.broadcast((model["prior"], model["known"], model["scores"]))

    def score(batches):
        prior, known, scores = sent.value
        place = dict(zip(known, range(len(known))))
        task, names, ended = TaskContext.get().partitionId() << 32, None, 0
        number: dict[str, int] = {}     # the block's other words, numbered
        entries = n_rows = 0

        def documents(b, sums, ids):
            n = len(sums)
            return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.list_(pa.float64())), pa.array(ids, pa.binary()),
                                               pa.array([task + ended] * n, pa.int64()), pa.nulls(n, pa.string())], names)

        def block(fields):
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in fields], pa.nulls(1, pa.list_(pa.float64())),
                                               pa.nulls(1, pa.binary()), pa.array([task + ended], pa.int64()),
                                               pa.array([" ".join(number)], pa.string())], names)

        fields = ()
        for b in batches:
            fields = [b.schema.field(i) for i in range(b.num_columns - 1)]
            names = [*b.schema.names[:-1], "_sums", "_ids", "_block", "_words"]
            start, sums, ids = 0, [], []
            for i, text in enumerate(b.column(b.num_columns - 1)):
                words = words_of(text.as_py() or "")
                total, rest = prior.copy() if words else None, []
                for j in range(0, len(words), CHUNK):
                    part = words[j:j + CHUNK]
                    at = np.fromiter(map(place.get, part, repeat(-1)), np.int64, len(part))
                    rest += [number.setdefault(part[k], len(number)) for k in np.flatnonzero(at < 0).tolist()]
                    total += scores[at[at >= 0]].sum(axis=0)
                sums.append(total)
                ids.append(pack(np.array(rest, np.int64)))
                entries, n_rows = entries + len(rest), n_rows + 1
                if len(number) >= BLOCK_WORDS or entries >= BLOCK_ENTRIES or n_rows >= BLOCK_ROWS:
                    yield documents(b.slice(start, len(sums)), sums, ids)
                    yield block(fields)
                    start, sums, ids = i + 1, [], []
                    number, entries, n_rows, ended = {}, 0, 0, ended + 1
            if sums:
                yield documents(b.slice(start, len(sums)), sums, ids)
        if number:
            yield block(fields)

    # several files or splits make a block: a word that many of them hold is asked for less often
    parts, running = rows.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(2 * running, parts // SPLITS))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    base = cut(rows.mapInArrow(score, f"{fields}, _sums array<double>, _ids binary, _block long, _words string"))
    # the other words are looked up once a block of documents
    others = base.where("_words is not null").select("_block", F.posexplode(F.split("_words", " ")).alias("_place", "word"))
    words = others.select("word").distinct()
    rare = model["entries"].where("k = 0 and not frequent").select(F.col("entry").alias("word"), "scores")
    words = cut(words.join(rare, "word", "left"))
    release(df.sparkSession)
    scored = words.where("scores is not null").unionByName(unseen_scores(words.where("scores is null").select("word"), model))
    scored = scored.select("word", F.transform("scores", lambda x: F.round(x * UNIT).cast("int")).alias("scores"))
    scored = cut(scored)
    del words
    release(df.sparkSession)
    answers = join_groups(others, scored, "word").select(F.col("_block").alias("_of"), "_place", "scores")

    def choose(documents: pa.Table, found: pa.Table) -> pa.Table:
        by_place = np.zeros((found.num_rows, len(langs)), np.int64)
        if found.num_rows:
            flat = pa.concat_arrays(found["scores"].chunks).flatten().to_numpy(zero_copy_only=False)
            by_place[found["_place"].to_numpy()] = flat.reshape(-1, len(langs))
        out = []
        for part in documents.to_batches():
            for sums, ids in zip(part.column("_sums").to_pylist(), part.column("_ids").to_pylist()):
                if sums is None:
                    out.append(("und", 0.0))
                    continue
                total = np.array(sums) + by_place[unpack(ids)].sum(axis=0) / UNIT
                best = int(np.argmax(total))
                p = np.exp(np.clip(total - total[best], -700, 0))
                out.append((langs[best], float(p[best] / p.sum())))
        kept = documents.select(documents.column_names[:n_fields])
        return (kept.append_column("lang_pred", pa.array([x[0] for x in out], pa.string()))
                .append_column("score", pa.array([x[1] for x in out], pa.float64())))

    n_fields = len(rows.columns) - 1
    documents = base.where("_words is null").drop("_words")
    return (documents.groupBy("_block").cogroup(answers.groupBy("_of"))
            .applyInArrow(choose, f"{fields}, lang_pred string, score double"))


def op10_lang_id(spark, sf_dir):
    """Predicted language of every document; a quarter is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    out = predict(docs, model, keep=[held.alias("held_out")])
    del model
    release(spark)  # the entries aren't needed any more
    return out
