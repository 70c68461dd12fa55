"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The best encoding of a text has the largest sum of piece scores (Viterbi over
the model's pieces; the model file is only read, its path is a parameter).
Text is taken as the model's identity normaliser takes it: a space in front,
spaces as U+2581.  A character that no piece covers becomes byte pieces.  Of
equally good paths the one whose last piece starts first wins, at every place.

A document longer than ``chunk_chars`` is cut into chunks anywhere, also inside
words.  A state at a boundary is the number of characters by which the piece
across it reaches into the next chunk (fewer than the longest piece has).

1. each chunk yields its transfer matrix: T[i][j] is the best score from
   entering it at state i to leaving it at state j (up to a constant of the
   chunk, which no choice depends on);
2. matrices are multiplied in (max, +), which is associative: products of
   blocks of chunks, then the blocks' entry scores, then each chunk's;
3. with its entry scores each chunk is traced back on its own, once for each
   state it may be left in;
4. from the last chunk on, the state a chunk is entered in tells which trace of
   the one before belongs to the result.

If no piece has U+2581 behind another character, a path always stops before
U+2581; the parts between are encoded once and remembered.

Defined cases: null and empty texts have no ids; repeated rows are encoded
each; null ids are allowed; an empty table gives an empty result; other
columns are ignored.  A text that holds U+2581 itself decodes to spaces there,
which ``round_trip`` tells.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import cut, list_column, small_batches, table

CHUNK_CHARS = 32_768
BLOCK = 64              # matrices multiplied in one task
CHUNK_BYTES = 1 << 18   # of a batch of chunks that a task works on at once: each makes a matrix or several paths
CACHE_PARTS = 300_000   # encoded parts that a task remembers
CACHE_CHARS = 32        # longer ones are encoded again
UNK_PENALTY = 10.0      # as the library has it: below the lowest score
SPACE = "▁"
NEG = float("-inf")


class Pieces:
    """What the encoder needs of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unk = n, sp.unk_id()
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        scores: dict[str, tuple[int, float]] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                scores[p] = (i, sp.get_score(i))
                self.raw.append(p.replace(SPACE, " ").encode())
        real = [s for _, s in scores.values() if s > -1e8]  # lower ones mark pieces to be avoided
        self.unk_score = min(real, default=0.0) - UNK_PENALTY
        self.longest = max(map(len, scores), default=1)
        # one dictionary a prefix: next character -> longer prefix; a piece's own has its id and score under ""
        self.trie: dict = {}
        for p, entry in scores.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = entry
        self.space_starts = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.newline_alone = not any("\n" in p for p in scores)
        self._encoder = None

    def encoder(self) -> Encoder:
        """One encoder for all tasks of a worker: what it remembers serves the next task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


class PartIds(dict):
    """Ids of parts, encoded when first asked for; ``front`` stands before each key."""

    def __init__(self, enc: Encoder, front: str):
        super().__init__()
        self.enc, self.front = enc, front

    def __missing__(self, key: str) -> tuple[int, ...]:
        s = self.front + key
        _, back = self.enc.forward(s, len(s), {0: 0.0})
        got = tuple(self.enc.trace(s, back, len(s))[1])
        if len(self) < CACHE_PARTS and len(key) <= CACHE_CHARS:
            self[key] = got
        return got


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.words, self.bare = PartIds(self, SPACE), PartIds(self, "")

    def forward(self, s: str, n: int, start: dict[int, float]) -> tuple[list[float], list]:
        """Best score at each place when pieces start before n; ``start``: scores to begin with."""
        size, trie, unk = len(s), self.p.trie, self.p.unk_score
        best, back = [NEG] * (size + 1), [None] * (size + 1)
        for i, v in start.items():
            if i <= size:
                best[i] = v
        for a in range(n):
            v = best[a]
            if v == NEG:
                continue
            node, b, single = trie, a, False
            while b < size:
                node = node.get(s[b])
                if node is None:
                    break
                b += 1
                got = node.get("")
                if got is not None:
                    if b == a + 1:
                        single = True
                    if v + got[1] > best[b]:
                        best[b], back[b] = v + got[1], (a, got[0])
            if not single and v + unk > best[a + 1]:
                best[a + 1], back[a + 1] = v + unk, (a, -1)
        return best, back

    def trace(self, s: str, back: list, end: int) -> tuple[int, list[int]]:
        """(place where the path begins, ids)."""
        out = []
        while back[end] is not None:
            start, i = back[end]
            out.append([i] if i >= 0 else [self.p.bytes.get(x, self.p.unk) for x in s[start:end].encode()])
            end = start
        return end, list(chain.from_iterable(reversed(out)))

    def whole(self, s: str) -> list[int]:
        """Ids of a text; parts between places where every path stops are encoded on their own."""
        if not self.p.space_starts:
            return list(self.bare[s])
        out: list[int] = []
        for k, line in enumerate(s.split("\n") if self.p.newline_alone else [s]):
            if k:
                out += self.bare["\n"]
            if SPACE + SPACE in line:  # pieces of several spaces may reach over parts
                parts = map(self.bare.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line))
            else:
                first, *rest = line.split(SPACE)
                if first:
                    out += self.bare[first]
                parts = map(self.words.__getitem__, rest)
            out.extend(chain.from_iterable(parts))
        return out

    # --- chunks: s holds n characters of the chunk and up to longest - 1 of what follows

    def cuts(self, s: str, n: int) -> tuple[int, int] | None:
        """First and last place in 1..n where every path stops."""
        if not self.p.space_starts:
            return None
        stops = [f"(?<=[^{SPACE}])(?={SPACE})"] + ([r"(?<=\n)", r"(?<=.)(?=\n)"] if self.p.newline_alone else [])
        mark = re.compile("|".join(stops), re.DOTALL)
        first = next((m.start() for m in mark.finditer(s) if m.start() > 0), n + 1)
        if first > n:
            return None
        reach = 64
        while True:  # the last one is near the end, as a rule
            lo = max(first, n - reach)
            last = [m.start() for m in mark.finditer(s, max(0, lo - 1)) if lo <= m.start() <= n]
            if last:
                return first, last[-1]
            reach *= 8

    def transfer(self, s: str, n: int) -> np.ndarray:
        """Transfer matrix, less the score between the first and the last stop: every path has it, so no choice needs it."""
        size = self.p.longest
        t, ends = np.full((size, size), NEG), self.cuts(s, n)
        stop = ends[0] if ends else n
        if ends:
            f1, f2 = ends
            best, _ = self.forward(s[f2:], n - f2, {0: 0.0})
            tail = best[n - f2:n - f2 + size]
        for i in range(min(size - 1, stop) + 1):
            if ends:
                head = self.forward(s[:f1], f1, {i: 0.0})[0][f1]
                t[i, :len(tail)] = head + np.array(tail)
            else:
                best, _ = self.forward(s, n, {i: 0.0})
                t[i, :len(best[n:n + size])] = best[n:n + size]
        return t

    def traces(self, s: str, n: int, entry: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(state it is left in, state it was entered in, ids) for every state that can be."""
        start = {i: float(v) for i, v in enumerate(entry) if v > NEG}
        ends = self.cuts(s, n)
        if not ends:
            best, back = self.forward(s, n, start)
            return [(j, *self.trace(s, back, n + j)) for j in range(min(self.p.longest, len(s) - n + 1)) if best[n + j] > NEG]
        f1, f2 = ends
        _, back = self.forward(s[:f1], f1, start)
        i, ids = self.trace(s[:f1], back, f1)
        ids += self.whole(s[f1:f2])
        best, back = self.forward(s[f2:], n - f2, {0: 0.0})
        return [(j, i, ids + self.trace(s[f2:], back, n - f2 + j)[1])
                for j in range(min(self.p.longest, len(s) - n + 1)) if best[n - f2 + j] > NEG]


def normal(text: str) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def decode(ids: list[int], pieces: Pieces) -> str:
    return b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _giants(docs: DataFrame, sent, chunk: int) -> DataFrame:
    """(row, _t) -> (row, ids) for texts of more than one chunk."""

    def split(batches):
        more = sent.value.longest - 1
        for b in batches:
            for row, text in zip(b[0].to_pylist(), b[1].to_pylist()):
                s = normal(text)
                at = list(range(0, len(s), chunk))
                for lo in range(0, len(at), 64):
                    own = at[lo:lo + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(own), pa.int64()), pa.array([x // chunk for x in own], pa.int64()),
                         pa.array([min(chunk, len(s) - x) for x in own], pa.int64()),
                         pa.array([s[x:x + chunk + more] for x in own])], ["row", "k", "n", "s"])

    def matrices(batches):
        enc = sent.value.encoder()
        for b in small_batches(batches, CHUNK_BYTES):
            c = b.to_pydict()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(
                [enc.transfer(s, n).tobytes() for s, n in zip(c["s"], c["n"])], pa.binary())], ["row", "k", "t"])

    as_matrix = lambda raw: np.frombuffer(raw).reshape(sent.value.longest, -1)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for raw in pdf.sort_values("k")["t"]:
            out = as_matrix(raw) if out is None else combine(out, as_matrix(raw))
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "t": [out.tobytes()]})

    def entries(pdf: pd.DataFrame, first: np.ndarray, name: str) -> pd.DataFrame:
        v, out = first, []
        pdf = pdf.sort_values(name)
        for raw in pdf["t"]:
            out.append(v.tobytes())
            v = (v[:, None] + as_matrix(raw)).max(axis=0)
        return pd.DataFrame({"row": pdf["row"], name: pdf[name], "v": out})

    def of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        first = np.full(sent.value.longest, NEG)
        first[0] = 0.0
        return entries(pdf, first, "block")

    def of_chunks(key, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        return entries(pdf, np.frombuffer(at["v"].iloc[0]), "k")

    def trace(batches):
        enc = sent.value.encoder()
        for b in small_batches(batches, CHUNK_BYTES):
            c = b.to_pydict()
            got = [[{"j": j, "i": i, "ids": ids} for j, i, ids in enc.traces(s, n, np.frombuffer(v))] for s, n, v in zip(c["s"], c["n"], c["v"])]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(got, pa.list_(pa.struct(
                [("j", pa.int32()), ("i", pa.int32()), ("ids", pa.list_(pa.int32()))])))], ["row", "k", "ways"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for ways in pdf.sort_values("k", ascending=False)["ways"]:
            way = next(w for w in ways if w["j"] == state)
            out.append(way["ids"])
            state = way["i"]
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "ids": [np.concatenate(out[::-1])]})

    chunks = cut(docs.mapInArrow(split, "row long, k long, n long, s string").repartition("row", "k"))
    t = cut(chunks.mapInArrow(matrices, "row long, k long, t binary").withColumn("block", F.expr(f"k div {BLOCK}")))
    blocks = t.groupBy("row", "block").applyInPandas(product, "row long, block long, t binary")
    at = blocks.groupBy("row").applyInPandas(of_blocks, "row long, block long, v binary")
    v = t.groupBy("row", "block").cogroup(at.groupBy("row", "block")).applyInPandas(of_chunks, "row long, k long, v binary")
    ways = chunks.join(v, ["row", "k"]).mapInArrow(trace, "row long, k long, ways array<struct<j:int,i:int,ids:array<int>>>")
    return ways.groupBy("row").applyInPandas(join, "row long, ids array<int>")


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per input row: id, n_tokens, ids, round_trip (the ids decode to the text)."""
    sent = df.sparkSession.sparkContext.broadcast(Pieces(model_path))  # as large as the vocabulary
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    giant = F.length("_t") >= chunk_chars
    kind = dict(docs.dtypes)["_id"]

    def batch(head, all_ids, texts):
        p = sent.value
        return pa.RecordBatch.from_arrays(
            [head, pa.array([len(x) for x in all_ids], pa.int64()),
             list_column(np.array([len(x) for x in all_ids], np.int32), pa.array(np.concatenate(
                 [np.array(x, np.int32) for x in all_ids] or [np.zeros(0, np.int32)]))),
             pa.array([decode(x, p) == t for x, t in zip(all_ids, texts)], pa.bool_())], ["_id", "n_tokens", "ids", "round_trip"])

    def short(batches):
        enc = sent.value.encoder()
        for b in small_batches(batches):
            texts = b[1].to_pylist()
            yield batch(b[0], [enc.whole(normal(t)) for t in texts], texts)

    def check(batches):
        for b in small_batches(batches):
            yield batch(b[0], b[2].to_pylist(), b[1].to_pylist())

    schema = f"_id {kind}, n_tokens long, ids array<int>, round_trip boolean"
    long_docs = cut(docs.where(giant).withColumn("row", F.monotonically_increasing_id()))
    done = long_docs.join(_giants(long_docs.select("row", "_t"), sent, chunk_chars), "row").select("_id", "_t", "ids")
    return (docs.where(~giant).mapInArrow(short, schema).unionByName(done.mapInArrow(check, schema))
            .withColumnRenamed("_id", id_col))


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text that each row's ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(Pieces(model_path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode(list(x), sent.value))

    return df.withColumn(out_col, text(F.col(ids_col)))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir):
    """Piece ids of every document, decoded again as a check."""
    return encode(table(spark, sf_dir, "documents"), default_model())
