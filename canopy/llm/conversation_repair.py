"""Repair of conversations' structure by Four-Russians block tables.

A conversation is a list of turns.  Each turn has at most one fault (the first
that fits): blank (no character but blanks), duplicate (role and text seen
earlier), truncated (the last character is none of ``.!?``).  A repair keeps
(K, cost 0), re-roles to user or assistant (R, 1) or deletes (D, 2) each turn
and inserts empty user or assistant turns (I, 5), so that the roles' initials
read ``(s?(ua)+)?``.  Blank and duplicate turns must be deleted, a truncated
turn that stays costs 5 more.  The cheapest edits are wanted; of several the
ASCII-least string of edits.

1. Four automaton states (begin, after s, after u, after a) give a vector of
   the least costs to the end.  Less its minimum it is one of few vectors, and
   a turn is one of nine symbols (four initials, truncated or not, or to be
   deleted): ``TABLES`` holds, for every vector and every block of ``BLOCK``
   symbols, the vector before the block, the cost added and where the best
   edits lead from each state.
2. Turns are range-partitioned by conversation and turn and processed in one
   sorted stream a partition.  From the last block to the first a look-up
   gives the vectors at the borders of blocks; from the first block on, each
   one is expanded backward to the vectors between its turns, and the least
   edit letter that keeps the least cost is taken.
3. A conversation that meets a partition's border, or is longer than
   ``PIECE_ROWS``, is cut into pieces.  A piece's effect is a table over all
   vectors and states, so a few hundred bytes a piece are composed per
   conversation, and the pieces are then expanded in parallel.  No task holds
   more of a conversation's text than one piece.

Turns are taken by turn number (nulls first), then role, then the SHA-256 of
the text.  Defined cases: a null role or text counts as one space; null
conversation ids are one conversation; repeated rows are duplicates but for
the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from canopy.llm.common import bloom_hit, bloom_words, cut, join_groups, table

BLOCK = 4
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
FORWARD = {BEGIN: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}   # a user or an assistant turn comes
ROLE_INTO = {AFTER_U: "user", AFTER_A: "assistant"}
INITIALS = "sua"          # symbols 0 to 2; 3 is any other initial, 4 to 7 the same truncated
GONE, SYMBOLS = 8, 9
LEGAL = ("su", "ua", "au")
DIGESTS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# --- tables -----------------------------------------------------------------------------------------

def _kept(state: int, symbol: int) -> int | None:
    """State after keeping a turn, None if its initial doesn't fit."""
    initial = (INITIALS + "-")[symbol % 4]
    if initial == "s":
        return AFTER_S if state == BEGIN else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    """Least costs before a turn from those after it."""
    out = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol != GONE:
            more = TRUNCATED * (symbol >= 4)
            ways.append(REROLE + more + after[FORWARD[state]])
            if (kept := _kept(state, symbol)) is not None:
                ways.append(KEEP + more + after[kept])
        out.append(min(ways))
    return _with_inserts(out)


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FORWARD[s]]) for s, c in enumerate(costs)]
    return costs


def _edits(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """ASCII-least best edits from ``state`` up to and with this turn, and the state they lead to."""
    before, letters = _before(after, symbol), ""
    more = TRUNCATED * (symbol >= 4)
    while True:
        cost = before[state]
        if cost == DELETE + after[state]:
            return letters + "D", state
        if cost == INSERT + before[FORWARD[state]]:
            letters, state = letters + "I", FORWARD[state]
            continue
        kept = _kept(state, symbol)
        if kept is not None and cost == KEEP + more + after[kept]:
            return letters + "K", kept
        return letters + "R", FORWARD[state]


@dataclass
class Tables:
    vectors: list[tuple[int, ...]]   # normalised vectors; the first is that after the last turn
    step: np.ndarray                 # [vector after, symbol] -> vector before
    cost: np.ndarray                 # ... -> cost added
    edits: list                      # [vector after][symbol][state] -> (letters, state)
    block_step: np.ndarray           # [vector after, block] -> vector before
    block_cost: np.ndarray
    block_end: np.ndarray            # [vector after, block, state] -> state


@cache
def tables() -> Tables:
    big = 10 * INSERT
    last = tuple(_with_inserts([0, big, big, 0]))
    vectors, rows = [last], []
    for v in vectors:  # grows while it is walked
        row = []
        for symbol in range(SYMBOLS):
            costs = _before(v, symbol)
            low = min(costs)
            normal = tuple(c - low for c in costs)
            if normal not in vectors:
                vectors.append(normal)
            row.append((vectors.index(normal), low))
        rows.append(row)
    step, cost = (np.array([[x[k] for x in row] for row in rows]) for k in (0, 1))
    edits = [[[_edits(v, symbol, s) for s in range(4)] for symbol in range(SYMBOLS)] for v in vectors]
    one_end = np.array([[[e[1] for e in row] for row in symbols] for symbols in edits])
    some = np.arange(len(vectors))
    b_step, b_cost, b_end = some[:, None], np.zeros((len(vectors), 1), dtype=np.int64), np.tile(np.arange(4), (len(vectors), 1, 1))
    for _ in range(BLOCK):  # one more symbol in front
        n = b_step.shape[1]
        b_cost = (b_cost[:, None, :] + cost[b_step].transpose(0, 2, 1)).reshape(len(vectors), -1)
        moved = one_end[b_step].transpose(0, 2, 1, 3)                   # [vector, symbol, rest, state] -> state after the symbol
        b_end = np.take_along_axis(np.broadcast_to(b_end[:, None], (len(vectors), SYMBOLS, n, 4)), moved, axis=3).reshape(len(vectors), -1, 4)
        b_step = step[b_step].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, step, cost, edits, b_step, b_cost, b_end)


def _blocks(symbols: bytes) -> tuple[np.ndarray, int]:
    """Numbers of the full blocks, and how many symbols stand before the first of them."""
    s = np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
    odd = len(s) % BLOCK
    return s[odd:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1)), odd


def borders(symbols: bytes, after: int) -> tuple[list[int], int, int]:
    """Vectors after each block (the odd symbols in front count as one), the vector before all, and the cost added."""
    t, (blocks, odd) = tables(), _blocks(symbols)
    out, cost, v = [], 0, after
    for b in reversed(blocks.tolist()):
        out.append(v)
        cost += int(t.block_cost[v, b])
        v = int(t.block_step[v, b])
    out.append(v)
    for x in reversed(symbols[:odd]):
        cost += int(t.cost[v, x])
        v = int(t.step[v, x])
    return out[::-1], v, cost


def effect(symbols: bytes) -> tuple[bytes, list[int], bytes]:
    """A piece's effect: for every vector after it the vector before it, the cost added, and each state's end."""
    t, (blocks, odd) = tables(), _blocks(symbols)
    v = np.arange(len(t.vectors))
    cost, end = np.zeros(len(v), dtype=np.int64), np.tile(np.arange(4), (len(v), 1))
    one_end = np.array([[[e[1] for e in row] for row in some] for some in t.edits])
    for b in reversed(blocks.tolist()):
        end = np.take_along_axis(end, t.block_end[v, b], axis=1)
        cost, v = cost + t.block_cost[v, b], t.block_step[v, b]
    for x in reversed(symbols[:odd]):
        end = np.take_along_axis(end, one_end[v, x], axis=1)
        cost, v = cost + t.cost[v, x], t.step[v, x]
    return v.astype(np.uint16).tobytes(), cost.tolist(), end.astype(np.uint8).tobytes()


def walk(symbols: bytes, after: int, state: int) -> tuple[list[str], int]:
    """Edit letters of each turn (those of inserts before it in front), and the state in the end."""
    t, odd = tables(), len(symbols) % BLOCK
    right, _, _ = borders(symbols, after)
    letters = []
    for k, v in enumerate(right):
        part = symbols[:odd] if k == 0 else symbols[odd + (k - 1) * BLOCK:odd + k * BLOCK]
        inner = []
        for x in reversed(part):  # the block is expanded backward
            inner.append(v)
            v = int(t.step[v, x])
        for x, after_x in zip(part, reversed(inner)):
            got, state = t.edits[after_x][x][state]
            letters.append(got)
    return letters, state


CLOSING = {BEGIN: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


def repaired(letters: list[str], state: int, turns: list[tuple[str, str]]):
    """(edit, role, text) of the turns that edits leave, from ``state`` on."""
    for edits, (role, text) in zip(letters, turns):
        for e in edits:
            if e == "I":
                state = FORWARD[state]
                yield e, ROLE_INTO[state], ""
            elif e == "R":
                state = FORWARD[state]
                yield e, ROLE_INTO[state], text
            elif e == "K":
                state = AFTER_S if role[:1] == "s" else FORWARD[state]
                yield e, role, text


def _closing(state: int):
    for _ in CLOSING[state]:
        state = FORWARD[state]
        yield "I", ROLE_INTO[state], ""


# --- one sorted stream a partition ---------------------------------------------------------------------

class _Piece:
    """Consecutive turns of one conversation."""

    def __init__(self, conv):
        self.conv, self.symbols, self.turns, self.size = conv, bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.low = self.high = self.first = None

    def add(self, turn, role, text, blank, cut_off, seen):
        if self.turns and self.turns[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        initial = INITIALS.find(role[:1]) if role else -1
        self.symbols.append(GONE if blank or seen else (initial if initial >= 0 else 3) + 4 * cut_off)
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut_off and not seen and not blank
        if turn is not None and turn != self.high:   # turns come in order
            self.low, self.high, self.numbers = turn if self.low is None else self.low, turn, self.numbers + 1
        self.turns.append((role, text))
        self.size += len(text)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<edit:string,role:string,text:string>>"
ROW_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _finish(p: _Piece, with_rows: bool) -> dict:
    letters, state = walk(bytes(p.symbols), 0, BEGIN)
    _, before, cost = borders(bytes(p.symbols), 0)
    rows = [*repaired(letters, BEGIN, p.turns), *_closing(state)]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in rows).encode()).hexdigest()
    return {"gaps": 0 if p.low is None else p.high - p.low + 1 - p.numbers, "blank": p.blank, "duplicate": p.duplicate,
            "truncated": p.truncated, "illegal": p.illegal, "cost": cost + tables().vectors[before][BEGIN],
            "audit": "".join(letters) + CLOSING[state], "repaired_sha256": digest,
            "rows": [dict(zip(("edit", "role", "text"), r)) for r in rows] if with_rows else []}


def _stream(with_rows: bool, conv_type: pa.DataType, piece_rows: int):
    def run(batches):
        place, number, piece, opened, before = TaskContext.get().partitionId() << 32, 0, None, True, None
        whole, parts = [], []

        def flush(ended: bool):
            """ended: all of the conversation's turns are in this piece and no other partition."""
            nonlocal number
            if ended:
                whole.append({"conv": piece.conv, "piece": None} | _finish(piece, with_rows))
            else:
                step, cost, end = effect(bytes(piece.symbols))
                parts.append({"conv": piece.conv, "piece": place + number, "symbols": bytes(piece.symbols), "step": step, "added": cost, "end": end,
                              "low": piece.low, "high": piece.high, "numbers": piece.numbers,
                              "first": piece.turns[0][0][:1] if piece.turns else None, "last": piece.turns[-1][0][:1] if piece.turns else None,
                              "blank": piece.blank, "duplicate": piece.duplicate, "truncated": piece.truncated, "illegal": piece.illegal,
                              "turns": [{"role": r, "text": t} for r, t in piece.turns]})
                number += 1

        def batch():
            rows = [*whole, *parts]
            whole.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_schema(conv_type))

        for b in batches:
            for conv, turn, role, text, sha, gone, blank, cut_off, seen in zip(*[c.to_pylist() for c in b.columns]):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        flush(not opened)
                        opened = False  # the partition's first conversation may have begun in another one
                    piece = _Piece(conv)
                elif len(piece.turns) >= piece_rows or piece.size >= PIECE_BYTES:
                    flush(False)
                    opened, piece = True, _Piece(conv)
                if not gone:
                    piece.add(turn, role, text, blank, cut_off, seen or before == (conv, turn, role, sha))
                    before = (conv, turn, role, sha)
                if len(whole) >= 1000 or parts:
                    yield batch()
        if piece is not None:
            flush(False)  # it may go on in the next partition
        if whole or parts:
            yield batch()

    return run


def _schema(conv_type: pa.DataType) -> pa.Schema:
    whole = [(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in DIGESTS[1:]]
    return pa.schema([("conv", conv_type), ("piece", pa.int64()), *whole, ("rows", ROW_TYPE), ("symbols", pa.binary()),
                      ("step", pa.binary()), ("added", pa.list_(pa.int64())), ("end", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
                      ("numbers", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("turns", TURN_TYPE)])


def _compose(pieces: pd.DataFrame) -> pd.DataFrame:
    """Vector after and state before each piece of one conversation, and the conversation's counts."""
    p = pieces.sort_values("piece").reset_index(drop=True)
    v, cost, after = 0, 0, [0] * len(p)
    for i in reversed(range(len(p))):
        after[i] = v
        cost += int(p["added"][i][v])
        v = int(np.frombuffer(p["step"][i], np.uint16)[v])
    state, states = BEGIN, []
    for i in range(len(p)):
        states.append(state)
        state = int(np.frombuffer(p["end"][i], np.uint8).reshape(-1, 4)[after[i], state])
    # gaps: pieces in order, each turn number counted once; the pairs of turns at the borders
    seen = p[p["low"].notna()]
    numbers = int(seen["numbers"].sum()) - int((seen["low"].to_numpy()[1:] == seen["high"].to_numpy()[:-1]).sum())
    ends = p[p["first"].notna()]
    pairs = [a + b for a, b in zip(ends["last"].to_numpy()[:-1], ends["first"].to_numpy()[1:])]
    out = p[["conv", "piece"]].copy()
    out["after"], out["state"] = after, states
    out["gaps"] = 0 if seen.empty else int(seen["high"].max() - seen["low"].min()) + 1 - numbers
    for c in ("blank", "duplicate", "truncated"):
        out[c] = int(p[c].sum())
    out["illegal"] = int(p["illegal"].sum()) + sum(x not in LEGAL for x in pairs)
    out["cost"] = cost + tables().vectors[v][BEGIN]
    out["ends"] = np.arange(len(p)) == len(p) - 1
    return out


def _expand(batches):
    """Edits and repaired turns of each piece."""
    for b in batches:
        for r in b.to_pylist():
            turns = [(t["role"], t["text"]) for t in r["turns"] or []]
            letters, state = walk(r["symbols"], r["after"], r["state"])
            rows = list(repaired(letters, r["state"], turns))
            if r["ends"]:
                rows += _closing(state)
            audit = "".join(letters) + (CLOSING[state] if r["ends"] else "")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv"]], b.schema.field("conv").type), *[pa.array([r[c]], pa.int64()) for c in ("piece", *DIGESTS[1:7])],
                 pa.array([audit]), pa.array([[dict(zip(("edit", "role", "text"), x)) for x in rows]], ROW_TYPE)],
                ["conv", "piece", *DIGESTS[1:8], "rows"])


def _digest(batches):
    """One row a conversation from its pieces in order; holds the edit letters and a running hash."""
    now, hasher, audit, empty, kind = None, None, [], True, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now["conv"]], kind), *[pa.array([now[c]], pa.int64()) for c in DIGESTS[1:7]],
             pa.array(["".join(audit)]), pa.array([hasher.hexdigest()])], DIGESTS)

    for b in batches:
        kind = b.schema.field("conv").type
        for r in b.to_pylist():
            if now is None or r["conv"] != now["conv"]:
                if now is not None:
                    yield row()
                now, hasher, audit, empty = r, hashlib.sha256(), [], True
            audit.append(r["audit"])
            for x in r["rows"]:
                hasher.update(f"{'' if empty else chr(10)}{x['role']}:{x['text']}".encode())
                empty = False
    if now is not None:
        yield row()


def _pieces(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column, with_rows: bool,
            piece_rows: int) -> DataFrame:
    """Whole conversations with their results, and pieces of the others."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    body = F.rtrim("text", F.lit(BLANKS))
    rows = (rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("blank", body == "")
            .withColumn("cut_off", ~F.right(body, F.lit(1)).isin(".", "!", "?")))
    # turns with an earlier equal one: few, found without moving the texts
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    repeated = (rows.where("not gone and not blank").groupBy("conv", "role", "sha").agg(F.min(at).alias("first"), F.max(at).alias("latest"))
                .where("first < latest").select(F.struct("conv", "role", "sha").alias("key"), "first"))
    repeated = cut(repeated)
    bits = 1024
    while bits < 12 * repeated.count() and bits < 1 << 27:
        bits *= 2
    words = cut(bloom_words(repeated.select(F.xxhash64("key").alias("h")), "h", bits, 4)).scalar()
    key = F.struct("conv", "role", "sha")
    hit = bloom_hit(words, F.xxhash64(key), bits, 4)
    known = join_groups(rows.where(hit).withColumn("key", key), repeated, "key", "left")
    marked = (rows.where(~hit).withColumn("seen", F.lit(False))
              .unionByName(known.withColumn("seen", F.coalesce(at > F.col("first"), F.lit(False))).drop("key", "first")))
    # the keys decide a row's partition, so equal rows meet, and order is the same within and between partitions
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "sha"]
    dealt = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = df.schema[conv_col].dataType
    out = (f"conv {kind.simpleString()}, piece long, {RESULT}, rows {ROWS}, symbols binary, step binary, added array<long>, end binary, "
           "low long, high long, numbers long, first string, last string, turns array<struct<role:string,text:string>>")
    return dealt.select("conv", "turn", "role", "text", "sha", "gone", "blank", "cut_off", "seen").mapInArrow(
        _stream(with_rows, to_arrow_type(kind), piece_rows), out)


def _resolved(pieces: DataFrame) -> DataFrame:
    """Pieces of cut conversations with their edits and repaired turns."""
    kind = pieces.schema["conv"].dataType.simpleString()
    parts = pieces.where("piece is not null")
    heads = parts.select("conv", "piece", "step", "added", "end", "low", "high", "numbers", "first", "last", "blank", "duplicate", "truncated", "illegal")
    plan = heads.groupBy("conv").applyInPandas(_compose, f"conv {kind}, piece long, after int, state int, gaps long, blank long, duplicate long, "
                                               "truncated long, illegal long, cost long, ends boolean").withColumnRenamed("conv", "c")
    each = parts.select("conv", "piece", "symbols", "turns").join(plan.drop("c"), "piece")  # piece numbers are unique
    return each.mapInArrow(_expand, f"conv {kind}, piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                           f"audit string, rows {ROWS}")


def repair_report(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  gone: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gone`` marks rows that only name their conversation; they are no turns of it.
    """
    pieces = cut(_pieces(df, conv_col, turn_col, role_col, text_col, F.lit(False) if gone is None else gone, False, piece_rows))
    kind = pieces.schema["conv"].dataType.simpleString()
    # a digest is sequential: a conversation's pieces pass one task in order, which holds one of them at a time
    rest = (_resolved(pieces).repartition("conv").sortWithinPartitions("conv", "piece")
            .mapInArrow(_digest, f"conv {kind}, {RESULT}"))
    return pieces.where("piece is null").select(*DIGESTS).unionByName(rest).withColumnRenamed("conv", conv_col)


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The repaired turns: conversation, piece and at (their order), edit (K, R or I), role, text."""
    pieces = cut(_pieces(df, conv_col, turn_col, role_col, text_col, F.lit(False), True, piece_rows))
    whole = pieces.where("piece is null").select("conv", F.lit(0).cast("long").alias("piece"), "rows")
    return (whole.unionByName(_resolved(pieces).select("conv", "piece", "rows"))
            .select(F.col("conv").alias(conv_col), "piece", F.posexplode("rows").alias("at", "r"))
            .select(conv_col, "piece", "at", "r.edit", "r.role", "r.text"))


# --- the registered query -------------------------------------------------------------------------------

def _damaged(conv: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``; dropped rows stay as ``gone``."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    done = conv.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, F.lit("user")).otherwise(text["role"]).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"]).alias("text"))
    return (done.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .withColumn("gone", F.col("kind") == 0).drop("copy", "kind"))


def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired text's digest of every damaged conversation."""
    return repair_report(_damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))
