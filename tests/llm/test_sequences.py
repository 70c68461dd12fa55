"""Periodic runs, order MinHash and conversation repair against brute force, with edge rows."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("canopy.llm")
from canopy.llm import conversation_repair as cr, order_minhash as om, periodic_runs as pr  # noqa: E402

SF001 = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, n_chars long, id string, runs string, fingerprint string"


def edge_rows(spark):
    long_text = "A  b\nc　d " * 3000
    return spark.createDataFrame([(1, None, 0, "x", "y", "z"), (2, "", 0, None, "y", "z"), (3, "one", 3, "x", None, "z"), (4, "a b " * 9, 0, "x", "y", "z"),
                                  (4, "a b " * 9, 0, "x", "y", "z"), (None, "a b " * 9, 0, "x", "y", "z"), (5, long_text, 0, "x", "y", "z"),
                                  (6, "w" * 500 + " \t " + "漢" * 40, 0, "x", "y", "z")], EDGE)


# --- runs ---------------------------------------------------------------------------------------------

def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return out


def test_runs_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 12, 40, 150]))]
            for _ in range(rng.randint(0, 3)):
                if len(w) > 3:
                    a, p = rng.randrange(len(w)), rng.randint(1, len(w) // 3)
                    for i in range(a, rng.randint(a, len(w))):
                        w[i] = w[a + (i - a) % p]
            docs.append(w)
        codes, want, at = np.array([x for d in docs for x in d], dtype=np.int64), {}, 0
        for d in docs:
            want |= {(s + at, e + at): q for (s, e), q in brute_runs(d).items()}
            at += len(d)
        assert pr.runs_of(codes, np.array([len(d) for d in docs])) == want


@pytest.mark.parametrize("power", [23, 4, 3])
def test_squared_differences_are_exact(power, monkeypatch):
    monkeypatch.setattr(pr, "TWO_POWER", power)  # small: long transforms are split
    rng = np.random.default_rng(0)
    for b, w in ((1, 3), (2, 5), (4, 11), (16, 47), (5, 40)):
        x, y = rng.integers(0, 9, (6, b)).astype(np.uint64), rng.integers(0, 9, (6, w)).astype(np.uint64)
        want = [[((x[r].astype(int) - y[r, k:k + b].astype(int)) ** 2).sum() for k in range(w - b + 1)] for r in range(6)]
        assert pr.squared_differences(x, y).astype(int).tolist() == [[int(v) for v in r] for r in want]


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for (s, e), q in brute_runs(w).items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_op12_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 8000]
    got = {r[0]: tuple(r)[1:] for r in pr.op12_periodic_runs(spark, SF001).collect()}
    assert len(rows) > 150 and all(got[r.doc_id] == expected_runs(r.doc_id, r.text) for r in rows)
    assert any(g[0] for g in got.values())


def test_runs_edges(spark):
    got = pr.periodic_runs(edge_rows(spark)).collect()
    assert len(got) == 8 and {r.doc_id: r.n_words for r in got if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 1}
    assert all([tuple(x) for x in r.runs] == [(0, 18, 2)] and r.collapsed == "a b" for r in got if r.doc_id in (4, None))
    assert [tuple(x) for r in got if r.doc_id == 5 for x in r.runs] == [(0, 9000, 3)]
    assert pr.periodic_runs(edge_rows(spark).limit(0)).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------

def brute_likeness(a, b, k=om.K, size=om.TUPLE, m=om.SKETCHES):
    """Order MinHash by its definition: m random orders of occurrence-numbered k-mers, minimal ones in text order."""
    def sketch(text, j):
        w = text.split()
        grams = [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
        seen, items = {}, []
        for i, g in enumerate(grams):
            seen[g] = seen.get(g, -1) + 1
            items.append((hashlib.md5(f"{j}{g}{seen[g]}".encode()).digest(), i, g))
        return tuple(g for _, _, g in sorted(sorted(items)[:size], key=lambda x: x[1]))
    return sum(sketch(a, j) == sketch(b, j) for j in range(m)) / m


def test_likeness_follows_edits(spark):
    rng, words = random.Random(2), [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    swapped = base[150:] + base[:150]
    edits = {"same": base, "one": base[:100] + ["new"] + base[101:], "tail": base[:200] + [f"n{i}" for i in range(100)],
             "shuffled": rng.sample(base, 300), "other": [f"z{i}" for i in range(300)], "swapped": swapped}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(edits.values())], "doc_id long, text string")
    s = om.with_sketches(df, "text", "s").select("doc_id", "s")
    near = {r.doc_id: r.l for r in s.join(s.where("doc_id = 0").select(F.col("s").alias("b"))).select("doc_id", om.likeness(F.col("s"), F.col("b")).alias("l")).collect()}
    got = {name: near[i] for i, name in enumerate(edits)}
    assert got["same"] == 1 and got["one"] > 0.9 and got["other"] == 0 and got["shuffled"] < 0.1
    assert 0.1 < got["tail"] < got["swapped"] < got["one"]  # the same words in another order are less like than the text itself
    for name in ("one", "tail", "swapped"):
        assert abs(got[name] - brute_likeness(" ".join(base), " ".join(edits[name]))) < 0.25


def test_fingerprint_edges(spark):
    got = om.fingerprints(edge_rows(spark)).collect()
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert len(got) == 8 and by_id[1] == by_id[2] == "" and all(len(f) == om.SKETCHES * om.HEX for i, f in by_id.items() if i not in (1, 2))
    assert len({r.fingerprint for r in got if r.doc_id in (4, None)}) == 1 and by_id[3] != by_id[4]
    assert om.fingerprints(edge_rows(spark).limit(0)).count() == 0


def test_op11_edited_texts(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in om.op11_fingerprints(spark, SF001).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        c = len(text) // 3
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[:len(text) - c] + after[:c]).encode()).hexdigest()
    near = [r.near_edited for r in got.values()]
    assert 0.15 < sum(near) / len(near) < 0.4 and sum(r.near_next for r in got.values()) / len(near) < 0.01


def test_next_row_of_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(None if rng.random() < .1 else (7 if rng.random() < .4 else rng.randint(0, 30)), rng.choice(["a", "b", "c"]) * rng.randint(1, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text", F.lit(7)).alias("h")).distinct().collect()}
    got = om.with_next(df, "id", "text", {"after": "text", "after_id": "id"}).collect()
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]]))
    follows = {a: b for a, b in zip(order, order[1:] + order[:1])}
    assert sorted(map(str, ((r.id, r.text) for r in got))) == sorted(map(str, rows))
    assert all((r.after_id, r.after) == follows[r.id, r.text] for r in got)
    one = om.with_next(df.limit(1), "id", "text", {"after": "text"}).collect()
    assert len(one) == 1 and one[0].after == one[0].text and om.with_next(df.limit(0), "id", "text", {"after": "text"}).count() == 0


# --- conversations ----------------------------------------------------------------------------------------

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(turns):
    """(cost, audit) of (initial, fault) turns: Dijkstra for costs to the end, then all ties by letters."""
    n, best = len(turns), {}

    def ways(i, s):
        yield "I", 5, i, NEXT[s]
        if i < n:
            role, fault = turns[i]
            yield "D", 2, i + 1, s
            if fault != "gone":
                more = 5 * (fault == "cut")
                yield "R", 1 + more, i + 1, NEXT[s]
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                if to:
                    yield "K", more, i + 1, to
    back = {}
    for i in range(n + 1):
        for s in range(4):
            for _, c, j, t in ways(i, s):
                back.setdefault((j, t), []).append((c, i, s))
    heap = [(0, n, 0), (0, n, 3)]
    while heap:
        c, i, s = heapq.heappop(heap)
        if (i, s) in best:
            continue
        best[i, s] = c
        for more, j, t in back.get((i, s), ()):
            heapq.heappush(heap, (c + more, j, t))
    i, s, audit = 0, 0, ""
    while not (i == n and s in (0, 3)):
        letter, i, s = min((x, j, t) for x, c, j, t in ways(i, s) if best[i, s] == c + best[j, t])
        audit += letter
    return best[0, 0], audit


def test_tables_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        turns = [(rng.choice("ssuuuaaao"), rng.choice(["ok", "ok", "cut", "gone"])) for _ in range(rng.randint(0, 14))]
        symbols = bytes(8 if f == "gone" else "suao".index(r) + 4 * (f == "cut") for r, f in turns)
        letters, state = cr.walk(symbols, 0, cr.BEGIN)
        _, before, cost = cr.borders(symbols, 0)
        assert (cost + cr.tables().vectors[before][0], "".join(letters) + cr.CLOSING[state]) == cheapest(turns)
        # the piece's effect is the same walk
        step, added, end = cr.effect(symbols)
        assert np.frombuffer(step, np.uint16)[0] == before and added[0] == cost and np.frombuffer(end, np.uint8)[cr.BEGIN] == state


def brute_report(rows):
    convs, out = {}, {}
    for c, turn, role, text, gone in rows:
        convs.setdefault(c, [])
        if not gone:
            convs[c].append((turn, " " if role is None else role, " " if text is None else text))
    for c, v in convs.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, turns, faults = set(), [], []
        for _, role, text in v:
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "ok"
            seen.add((role, text))
            faults.append(fault)
            turns.append((role[:1] if role[:1] in ("s", "u", "a") and role else "o", "gone" if fault in ("blank", "dup") else fault))
        numbers = [r[0] for r in v if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit = cheapest(turns)
        lines, i, s = [], 0, 0
        for x in audit:
            if x == "I":
                s = NEXT[s]
                lines.append(("user:", "assistant:")[s - 2])
                continue
            if x == "R":
                s = NEXT[s]
                lines.append(("user:", "assistant:")[s - 2] + v[i][2])
            if x == "K":
                s = 1 if v[i][1][0] == "s" else NEXT[s]
                lines.append(f"{v[i][1]}:{v[i][2]}")
            i += 1
        out[c] = (gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece_rows", [cr.PIECE_ROWS, 50])
def test_repair_brute_force(spark, piece_rows):
    rng = random.Random(6)
    rows = [(None if rng.random() < .02 else 7 if rng.random() < .5 else rng.randint(0, 25), None if rng.random() < .05 else rng.randint(0, 900),
             rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
             rng.choice(["a.", "b", "c!", "", None, " \n", f"number {rng.randint(0, 200)}."]), "x", rng.random() < .05) for _ in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, gone boolean")
    got = {r[0]: tuple(r)[1:] for r in cr.repair_report(df, gone=F.col("gone"), piece_rows=piece_rows).collect()}
    assert got == brute_report([(*r[:4], r[5]) for r in rows])


def test_op13_damage(spark):
    damaged = []
    for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect():
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        row = (r.conv_id, r.turn, "user" if k == 4 else r.role, "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text, k == 0)
        damaged += [row] * (1 + (k == 3))
    got = {r[0]: tuple(r)[1:] for r in cr.op13_conversation_repair(spark, SF001).collect()}
    assert got == brute_report(damaged) and len({g[6] for g in got.values()}) > 5


def test_repaired_turns_and_edges(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "And?"), (2, None, None, None)],
                               "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.piece, r.at, r.edit, r.role, r.text) for r in cr.repaired_turns(df).collect())
    assert [g[3:] for g in got if g[0] == 1] == [("K", "user", "Hi."), ("R", "assistant", "And?")] and not [g for g in got if g[0] == 2]
    report = {r.conv_id: (r.blank, r.cost, r.audit) for r in cr.repair_report(df).collect()}
    assert report == {1: (0, 3, "KDR"), 2: (1, 2, "D")}
    assert cr.repair_report(df.limit(0)).count() == 0 and cr.repaired_turns(df.limit(0)).count() == 0
