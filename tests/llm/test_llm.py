"""Training-data operators against SQL, brute force, round trips and held-out rows, with edge rows."""

import collections
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("canopy.llm")
import corpus_pipeline  # noqa: E402
from canopy.llm import (decontaminate as dc, exact_dedup, lang_id, ngram_join, pii, quality, sentencepiece_scan as sp,  # noqa: E402
                        sharding, url_filter, warc)
from canopy.llm.common import connected_components, drop_rows, list_column, small_batches  # noqa: E402
from canopy.llm.queries import LLM_QUERIES  # noqa: E402
from oracle import compare  # noqa: E402

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long"
BASE = " ".join(f"w{i}" for i in range(60))
EDGE = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, BASE, "en", "s", 1, None, 2), (4, BASE, "en", "s", 1, "x", 2),
        (4, BASE, "en", "s", 1, "x", 2), (5, BASE + " tail", "en", None, 1, "x", 3), (None, "alone here", None, "s", 9, "x", 4),
        (6, "one", "en", "s", 3, "x", 5), (7, "A  b\nc　d " * 9000, "en", "s", 3, "x", 6)]


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, sf=SF001):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(n for n, q in LLM_QUERIES.items() if q.sql))
def test_sql(spark, duck, name):
    q = LLM_QUERIES[name]
    r = compare(spark, duck, name, type("Q", (), {"build": staticmethod(q.build), "sql": q.sql}), SF01)
    assert "error" not in r and r["rows"], r


def test_exact_dedup_edges(edge, none):
    rows = exact_dedup.exact_dedup(edge).collect()
    assert len(rows) == len(EDGE) and exact_dedup.exact_dedup(none).count() == 0
    base = [r for r in rows if r.doc_id in (3, 4)]
    assert [r.keep_id for r in base] == [4] * 3 and sum(r.kept for r in base) == 1
    assert {r.doc_id: r.kept for r in rows if r.doc_id in (1, 2)} == {1: False, 2: True}
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "7", "None"]


def brute_components(rows, width, percent):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[j:j + width]) for j in range(len(w) - width + 1)}
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        c = len(sets[a] & sets[b])
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark, edge, none):
    rng, base = random.Random(3), [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > p else f"z{rng.random()}" for w in base)) for i, p in enumerate([0.0, .003, .01, .02, .03] * 20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 90)
    out = ngram_join.jaccard_components(edge).collect()
    assert len(out) == len(EDGE) and {r.component_id for r in out if r.doc_id in (3, 4, 5)} == {3}
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id in (1, 2, 6)} == {1: 0, 2: 0, 6: 1}
    assert ngram_join.jaccard_components(none).count() == 0


def test_jaccard_join_of_families(spark):
    rng, rows = random.Random(11), []
    common = [f"c{i}" for i in range(25)]  # a passage that all families share
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(rng.choice([6, 14, 40, 75]))] + common[:rng.choice([0, 25])]
        for _ in range(50):
            share = rng.choice([0.0, 0.01, 0.03, 0.06, 0.1])
            rows.append((len(rows), " ".join(w if rng.random() > share else f"z{rng.randrange(40)}" for w in base)))
    for width, percent in [(5, 80), (3, 90), (1, 60)]:
        got = {r.doc_id: (r.n_shingles, r.component_id)
               for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
        assert got == brute_components(rows, width, percent)


def test_jaccard_join_of_long_sets(spark):
    rng = random.Random(2)
    rows = []
    for n in (1015, 1040, 2500):  # sketches of both lengths meet at the first two
        base = [f"l{n}x{i}" for i in range(n)]
        rows += [(len(rows) + j, " ".join(w if rng.random() > share else f"z{rng.random()}" for w in base)) for j, share in enumerate([0, .01, .015, .02, .05])]
        rows.append((len(rows), " ".join(base[:-20])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 90)


def test_open_pairs_that_may_link(spark, monkeypatch):
    """Pairs are dropped where they are built: only those whose sketches leave a link possible become rows, at any size of a block."""
    rng = np.random.default_rng(7)
    draw = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    near = [np.unique(np.concatenate([base[:len(base) - cut], draw(cut)])) for base in (draw(60), draw(1000), draw(1030), draw(1500))
            for cut in (len(base) // 100, len(base) // 8) * 7]
    nodes = [(i, len(s), i % 5 if i % 3 else i + 100, np.frombuffer(ngram_join.parity_bits(s), np.int64).tolist()) for i, s in enumerate(near)]
    rows = spark.createDataFrame([(k, i, n, c) for i, n, c, _ in nodes for k in (1, 2 + i % 4, 50 + i // 2)], "key long, node long, n long, comp long")
    sketches = spark.createDataFrame([(i, n, b) for i, n, _, b in nodes], "node long, n long, bits array<long>")
    folded = [np.bitwise_xor.reduce(np.array(b).reshape(-1, 16), axis=0) for *_, b in nodes]
    want = set()
    for (i, n, c, x), (j, m, d, y) in itertools.combinations(nodes, 2):
        x, y = (np.array(x), np.array(y)) if len(x) == len(y) else (folded[i], folded[j])
        if c != d and 190 * int(np.bitwise_count(x ^ y).sum()) <= 10 * (n + m) and 100 * min(n, m) >= 90 * max(n, m):
            want.add((i, j))
    assert 30 < len(want) < 400
    for size in (2048, 6):
        monkeypatch.setattr(ngram_join, "BLOCK_NODES", size)
        got = ngram_join._open_pairs(rows, sketches, 90)
        assert {tuple(r) for r in got.collect()} == want
    far = rows.where("node % 2 = 1 and node < 14")  # a key's nodes that miss a link: no row at all
    assert far.where("key = 1").count() == 7 and ngram_join._open_pairs(far.withColumn("comp", far.node), sketches, 90).count() == 0


class Tasks:
    """Stands for a DataFrame of which only ``mapInArrow`` is used: keeps the task's function."""

    def __init__(self, batch):
        self.batch, self.dtypes = batch, [("_id", "bigint"), ("_t", "string")]

    def mapInArrow(self, run, schema):  # noqa: N802
        tracemalloc.start()
        self.rows = sum(b.num_rows for b in run([self.batch]))
        self.peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return self


def test_tasks_hold_little_of_a_batch():
    """What a near-copy task holds at once doesn't grow with its batches' rows or the corpus' words."""
    texts = [" ".join(f"w{i}x{j}" for j in range(700)) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"_id": list(range(2000)), "_t": texts})
    assert batch.nbytes > 12 << 20
    tasks = Tasks(batch)
    ngram_join._sketches(tasks, 5, 80)
    assert tasks.rows == 2000 and tasks.peak < 40 << 20, tasks.peak
    rng = np.random.default_rng(3)
    n = 700
    bits = list_column(np.full(n, 16, np.int32), pa.array(rng.integers(0, 1 << 62, 16 * n)))
    group = pa.table({"key": [1] * n, "lo": [0] * n, "hi": [0] * n, "own": [0] * n, "node": list(range(n)), "n": [900] * n, "comp": list(range(n)), "bits": bits})
    tracemalloc.start()
    assert not list(ngram_join._compare(group, 90))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak


def test_small_batches_keep_rows_in_order():
    whole = pa.RecordBatch.from_pydict({"a": list(range(1000)), "t": ["x" * (i % 90) for i in range(1000)]})
    parts = list(small_batches([whole, whole.slice(0, 0), whole.slice(10, 5)], 1000))
    assert [x for p in parts for x in p["a"].to_pylist()] == [*range(1000), *range(10, 15)]
    assert len(parts) > 50 and max(p.nbytes for p in parts) < 2500 and any(p.num_rows == 0 for p in parts)


def test_shared_blocks_of_a_link():
    rng = np.random.default_rng(3)
    for n in (12, 25, 60, 200, 700):
        for percent in (60, 80, 90):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[:len(a) - len(a) * (100 - percent) // 250], rng.integers(0, 1 << 64, n * (100 - percent) // 300, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            for x, y in ((a, b), (b, a)):
                other = np.concatenate([np.zeros(0, np.uint64)] + [k for _, k in ngram_join.block_keys(y, percent)])
                enough = [np.isin(k, other).sum() >= need for need, k in ngram_join.block_keys(x, percent)]
                assert any(enough) or len(a) == len(b) == len(np.intersect1d(a, b))


def test_linked_nodes_keep_their_first_shared_key(spark):
    """A node keeps h - need + 1 of its h shared keys, crowded ones last, and two nodes that share ``need`` keys one in common."""
    import numpy as np
    from canopy.llm.common import mix64
    from canopy.llm.ngram_join import KEY_MASK, _hits, _key_filter
    keys = (mix64(np.arange(1, 41, dtype=np.uint64)) & KEY_MASK).astype(np.int64).tolist()
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key long")
    bands = {1: (4, keys[:10]), 2: (4, keys[:4] + keys[20:26]), 3: (4, keys[:3] + keys[30:33]), 4: (1, keys[:2])}
    docs = spark.createDataFrame([(n, 50, [b]) for n, b in bands.items()], "node long, n long, bands array<struct<need:int,keys:array<long>>>")
    size = 1 << 16
    got = {}
    for r in _hits(docs, (_key_filter(frame(keys[:30]), size), size), [(_key_filter(frame(keys[:3]), size), size)]).collect():
        got.setdefault(r.node, set()).add(r.key)
    assert got[1] == set(keys[3:10])                    # 7 of 10: the three crowded ones go
    assert len(got[2]) == 7 and not got[2] & set(keys[:3])
    assert keys[3] in got[1] & got[2]                   # they share four keys: the first that isn't crowded joins them
    assert 3 not in got                                 # three shared keys, a link needs four
    assert got[4] == set(keys[:2])


def test_connected_components(spark):
    rng = random.Random(5)
    path = list(range(1000, 1400))
    rng.shuffle(path)
    edges = (list(zip(path, path[1:])) + [(7, 7)] + [(2000, i) for i in range(2001, 2300)] * 2
             + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(180)])
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(13)
    got = connected_components(df).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}  # a node that only links with itself is left out
    assert len(got) == len(linked) and dict(map(tuple, got)) == {x: root(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        x, y = (np.frombuffer(ngram_join.parity_bits(s), np.uint8) for s in (a, b))
        assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_pii(spark, edge, none):
    texts = ["card 4111111111111111, 4111 1111 1111 1111; bad 4111111111111112", "call +1 (017) 555-7713", "ip 10.0.0.1. not 256.1.1.1",
             "on 2020-02-29, never 2021-02-29", "ssn 123-45-6789 and 000-12-3456", "mail für.12@mail7.example.com"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    card = out[0].split()[1].strip(",")
    assert len(card) == 16 and card != "4111111111111111" and out[0].endswith("bad 4111111111111112")
    assert out[0].split(";")[0].replace(",", "").replace(" ", "").count(card) == 2  # one pseudonym in both formats
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(card))))
    assert total % 10 == 0
    assert "555-7713" not in out[1] and "10.0.0.1." not in out[2] and "256.1.1.1" in out[2]
    assert "2021-02-29" in out[3] and "2020-02-29" not in out[3] and "000-12-3456" in out[4] and "123-45" not in out[4]
    assert "für.12" not in out[5] and out[5].endswith("@mail7.example.com")
    got = pii.pseudonymise(edge)
    assert got.count() == len(EDGE) and pii.pseudonymise(none).count() == 0
    assert got.where("doc_id = 1").first().text is None


def test_feistel_permutes(spark):
    from pyspark.sql import functions as F
    p = spark.range(189 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(189), F.lit(7), "t", "k").alias("p")).distinct()
    assert p.where("p.l between 0 and 188 and p.r between 0 and 6").count() == 189 * 7


def test_quality(spark, edge, none):
    d, lab = docs(spark, "/root/testdata/sf0.01"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality.fit(d, lab.where("doc_id % 3 <> 1"))
    truth = {r.doc_id: (r.quality, r.toxic) for r in lab.where("doc_id % 3 = 1").collect()}
    rows = [r for r in quality.score(d, model, ["doc_id"]).collect() if r.doc_id in truth]
    good = [r.kept for r in rows if truth[r.doc_id] == (1, 0)]
    bad = [r.kept for r in rows if truth[r.doc_id][0] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.4
    assert quality.score(edge, model, ["doc_id"]).count() == len(EDGE)
    empty = quality.fit(none, lab.limit(0))
    assert all(r.kept for r in quality.score(edge, empty).collect()) and quality.score(none, empty).count() == 0


def test_quality_uses_every_unlabelled_row(spark, monkeypatch):
    """Each view's sums count every document the other view is sure of, past 4,000 of them, and labels of no document take no place."""
    words = {1: "calm river garden stone", 0: "spam casino bonus click"}
    rows = [(i, " ".join([words[i % 2]] * 3 + [f"n{i % 7}"]), "en", "good" if i % 2 else "bad", 60) for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, i % 2, 0 if i % 4 else 1) for i in range(600)], "doc_id long, quality int, toxic int")
    lost = spark.range(100_000, 160_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    seen, whole = [], quality.pseudo_sums
    monkeypatch.setattr(quality, "pseudo_sums", lambda *a: seen.append(whole(*a)) or seen[-1])
    model = quality.fit(d, lab.union(lost))
    assert [[c[0] for c in view] for view in seen[-1][0]] == [[4200, 4200], [4200, 4200]]
    assert all(0.9 < r.p_quality if r.doc_id % 2 else r.p_quality < 0.1 for r in quality.score(d, model, ["doc_id"]).collect())


def test_sentencepiece(spark, edge, none):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    p = sp.Pieces(sp.default_model())
    enc = sp.Encoder(p)
    m = pb.ModelProto()
    m.ParseFromString(open(sp.default_model(), "rb").read())
    m.trainer_spec.model_type = 1  # the library's own search for the best score
    for x in m.pieces:
        x.score = x.score if x.score > -1e8 else -31740
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [r.text for r in docs(spark).limit(60).collect()]
    for t in texts:
        for line in t.split("\n")[:4]:
            assert enc.whole(sp.normal(line[:300])) == lib.encode(line[:300])
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0].replace(" ", "").replace("\n", "")[:900])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in sp.encode(d, sp.default_model(), chunk_chars=1 << 20).collect()}
    for r in sp.encode(d, sp.default_model(), chunk_chars=37).collect():
        assert r.ids == whole[r.doc_id] and r.round_trip and r.n_tokens == len(r.ids)
    out = {r.doc_id: r for r in sp.encode(edge, sp.default_model()).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[7].round_trip and len(out) == len({e[0] for e in EDGE})
    assert sp.encode(none, sp.default_model()).count() == 0


def test_chunks_in_small_batches_change_nothing(spark, monkeypatch):
    text = "Some words, and more words of a long text. " * 40
    rows = spark.createDataFrame([(i, text[i:] + "x" * i) for i in range(6)], "doc_id long, text string")
    want = {r.doc_id: r.ids for r in sp.encode(rows, sp.default_model()).collect()}
    for size in (sp.CHUNK_BYTES, 1):  # one chunk at a time
        monkeypatch.setattr(sp, "CHUNK_BYTES", size)
        got = sp.encode(rows, sp.default_model(), chunk_chars=100)
        assert {r.doc_id: r.ids for r in got.collect()} == want and got.where("not round_trip").isEmpty()


def test_masks_are_lossless():
    for e in itertools.combinations(range(dc.WINDOW), dc.SUBSTITUTIONS):
        assert any(not {s + j for j in m} & set(e) for m in dc.MASKS for s in range(dc.WINDOW - m[-1]))


def test_decontaminate(spark, edge, none):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    words = items[0].split()
    words[3] = "other"
    rows = [(1, "clean words only"), (2, f"before {' '.join(words)} after"), (3, "x " * 300 + items[1].upper()), (4, " ".join(words[:8])), (5, None)]
    got = {r.doc_id: (r.kept, r.item_ids) for r in dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1] == (True, []) and got[4] == (True, []) and got[5] == (True, [])
    assert not got[2][0] and 0 in got[2][1] and not got[3][0] and 1 in got[3][1]
    assert dc.decontaminate(edge, bench).count() == len(EDGE) and dc.decontaminate(none, bench).count() == 0
    assert all(r.kept for r in dc.decontaminate(edge, bench.limit(0)).collect())
    short = spark.createDataFrame([(9, "w1 w2 w3")], "item_id long, text string")
    assert {r.doc_id for r in dc.decontaminate(edge, short).where("not kept").collect()} == {3, 4, 5}


def test_url_filter_edges(spark):
    urls = [(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.Example.NET/en/x?y", "h"), (4, "https://x.net", None), (5, "ftp://cheap-pills.example.com/a", "h"),
            (6, "http://badnet/a", "h"), (7, "http://example.com/de/1#z", "h"), (7, "http://example.com/de/1#z", "h"), (8, "http://x.org/fr/", "h")]
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string, host string")).orderBy("page_id").collect()]
    assert out == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
                   (4, "x.net", "", None, "allow"), (5, "cheap-pills.example.com", "/a", None, "block"), (6, "badnet", "/a", None, "allow"),
                   (7, "example.com", "/de/1", "example.com/de/", "block"), (7, "example.com", "/de/1", "example.com/de/", "block"),
                   (8, "x.org", "/fr/", "org/fr/", "allow")]


def test_sharding(spark, edge, none):
    # a bucket of 10 groups balances eight shards coarsely; the default holds all 200 in one
    for d, n, bucket, spread in ((docs(spark), 200, sharding.BUCKET_GROUPS, 1.002), (docs(spark), 200, 10, 1.1), (edge, len(EDGE), 2, None)):
        rows = sharding.shard_documents(d, bucket_groups=bucket, slot_rows=7).collect()
        assert len(rows) == n
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        if spread:
            sizes = collections.Counter()
            for r in rows:
                sizes[r.shard] += r.size
            assert len(by) == 8 and max(sizes.values()) <= spread * min(sizes.values())
    home = collections.defaultdict(set)
    for r in rows:
        home[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in home.values()) and sharding.shard_documents(none).count() == 0


def test_arc_versions(spark):
    pages = spark.createDataFrame([(1, "http://a b/", "<p>é\n\r\n\r\nx</p>", 1), (2, None, None, 1), (3, "u", "<p>é\n\r\n\r\nx</p>", 1)],
                                  "page_id long, url string, html string, payload long")
    for version in (1, 2):
        rows = {r.page_id: r for r in warc.arc_to_warc(warc.pages_to_arc(pages, version=version)).collect()}
        assert bytes(rows[1].payload).decode() == "<p>é\n\r\n\r\nx</p>" and rows[2].payload_bytes == 0
        assert rows[1].target_uri == "http://a%20b/" and rows[2].target_uri == "unknown:" and rows[1].date == "2000-01-01T00:00:00Z"
    linked = warc.link_revisits(warc.arc_to_warc(warc.pages_to_arc(pages))).collect()
    assert {r.page_id: r.refers_to_id is not None for r in linked} == {1: True, 2: False, 3: False}
    assert list(warc.parse_arc(b"")) == [] and warc.pages_to_arc(pages.limit(0)).count() == 0
    cut = warc.arc_head("a") + warc.arc_record("u", b"12345", "a", 0)[:-4]
    assert [(c, short) for _, c, short in warc.parse_arc(cut)] == [(b"12", True)]


def test_warc_edge_rows(spark, tmp_path):
    """Null html, null and repeated ids, equal payloads and an empty table go through the archive and back."""
    schema = "page_id long, url string, html string, record_id string"
    rows = [(1, "http://a/", "same", "x"), (2, "http://b/", "same", "x"), (2, "http://b/", "same", "x"), (3, None, None, None),
            (None, "http://c/", "alone", "x"), (4, "http://d/", "é" * 3_000_000, "x")]
    for name, given in (("rows", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        out = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.digest_ok)
                     for r in warc.op9_warc(spark, f"{tmp_path}/{name}").collect())
        assert out == ([] if not given else [
            (0, 5, "response", None, True), (1, 4, "revisit", 2, True), (2, 4, "response", None, True), (2, 4, "response", None, True),
            (3, 0, "response", None, True), (4, 6_000_000, "response", None, True)])


def test_pii_long_unbroken_texts(spark):
    """E-mail addresses are found in linear time and without recursion."""
    texts = ["x@" + "a." * 8000 + "1", "b" * 200_000 + " 1", "x@" + "a." * 50_000 + "com", "x@y." * 20_000, "to a@b.c1.de-f.x9, 1.2.3.4z@q.org"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_email for r in rows] == [0, 0, 1, 0, 2]
    assert [r.text == t for r, t in zip(rows, texts)] == [True, True, False, True, False]
    assert rows[4].text.startswith("to u") and "@b.c1.de-f.x9, u" in rows[4].text and rows[4].text.endswith("@q.org")


def test_dropped_rows_take_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "c", 9)], "doc_id long, _dropped_key string, _ROW_KEY long")
    left = drop_rows(rows, F.col("doc_id"), spark.createDataFrame([(2,), (2,), (5,)], "key long"))
    assert left.columns == rows.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]


def test_only_letters_make_words():
    assert lang_id.words_of("½ ² Ⅷ ७ 12 _ —") == [] and lang_id.words_of("x²y हिन्दी e\u0301te\u0301") == ["x", "y", "हिन्दी", "e\u0301te\u0301"]
    # the short way through texts that are ASCII once lower-cased finds the same words
    plain = ["Don't STOP_now 3rd x2y", "\u212aelvin a\x7fb\x00c", "".join(map(chr, range(128))), ""]
    assert all(t.lower().isascii() and lang_id.words_of(t) == lang_id.WORD.findall(t.lower()) for t in plain)
    assert lang_id.ASCII_WORD.findall("a1b") == ["a", "b"]


def test_lang_id_packs_numbers():
    """A document's word numbers take half of an int each, come back whole, and steps beyond two bytes are kept."""
    import numpy as np
    from canopy.llm.lang_id import pack, unpack
    rng = np.random.default_rng(3)
    for ids in ([], [0], [0, 0, 0], [65534], [65535, 0], [1 << 31, 5, 5, 70000], rng.integers(0, 1 << 18, 500), rng.integers(0, 1 << 30, 500)):
        ids = np.array(ids, np.int64)
        assert unpack(pack(ids)).tolist() == sorted(ids.tolist())
    assert len(pack(np.arange(1000))) < 2100


def test_language(spark, edge, none):
    rows = LLM_QUERIES["op10_lang_id"].build(spark, SF01).collect()
    truth = {r.doc_id: r.lang for r in docs(spark, SF01).collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    model = lang_id.fit(docs(spark))
    out = {r.doc_id: r.lang_pred for r in lang_id.predict(edge, model).collect()}
    assert out[1] == out[2] == "und" and out[6] in model["langs"] and lang_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in lang_id.predict(edge, lang_id.fit(none)).collect()} == {"und"}


def test_language_blocks_change_nothing(spark, monkeypatch):
    model = lang_id.fit(docs(spark), min_share=0.01)
    whole = sorted(lang_id.predict(docs(spark), model).collect())
    for name, bound in (("BLOCK_ENTRIES", 300), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(lang_id, name, bound)
        assert sorted(lang_id.predict(docs(spark), model).collect()) == whole


def test_language_knows_every_counted_word(spark):
    """Scores equal those of all counts held in one place: rare words, words rare in one language only, unseen words."""
    langs, train = ["aa", "bb"], []
    for i in range(40):
        train.append((i, "common " * 300 + f"rareword{'qxyz'[i % 4]} other" + " only" * (i % 2), "aa"))
        train.append((100 + i, "gemein " * 300 + " other" * 20 + ("common rarewordq" if i == 0 else " zeldzaam"), "bb"))
    tests = ["rarewordx rarewordy common", "zeldzaam other only", "rarewordq gemein", "unseenword zeld", "only", "中文"]
    schema = "doc_id long, text string, lang string"
    model = lang_id.fit(spark.createDataFrame(train, schema), min_share=0.05)
    assert set(model["known"]) == {"common", "gemein", "other"}
    out = lang_id.predict(spark.createDataFrame([(i, t, None) for i, t in enumerate(tests)], schema), model).collect()
    words = {x: collections.Counter() for x in langs}
    for _, t, x in train:
        words[x].update(lang_id.words_of(t))
    tables = {0: words}
    for k in lang_id.ORDERS:
        tables[k] = {x: collections.Counter() for x in langs}
        for x in langs:
            for w, n in words[x].items():
                for g in lang_id.grams(w, k):
                    tables[k][x][g] += n

    def entry(k, e):
        if not any(tables[k][x][e] for x in langs):
            return None
        return np.array([np.log(tables[k][x][e] / tables[k][x].total()) if tables[k][x][e] else lang_id.FLOOR for x in langs])

    def word(w):
        if entry(0, w) is not None:
            return entry(0, w)
        for k in lang_id.ORDERS:
            if got := [y for g in lang_id.grams(w, k) if (y := entry(k, g)) is not None]:
                return np.mean(got, axis=0)
        return np.full(2, lang_id.FLOOR)

    for r in out:
        total = np.log([0.5, 0.5]) + sum(word(w) for w in lang_id.words_of(tests[r.doc_id]))
        p = np.exp(total - total.max())
        assert r.lang_pred == langs[int(np.argmax(total))] and abs(r.score - 1 / p.sum()) < 1e-5, tests[r.doc_id]


def test_pipeline(spark):
    """Every stage on what the one before it kept: exact and near copies by brute force, encoding by its round trip."""
    all_docs = docs(spark)
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.quality(spark, all_docs, SF001).collect()}
    good = quality.score(all_docs, quality.fit(all_docs, spark.read.parquet(f"{SF001}/labels.parquet")), keep=["doc_id"])
    assert set(kept) == {r.doc_id for r in good.where("kept").collect()}
    largest = {}
    for i, t in kept.items():
        largest[t] = max(i, largest.get(t, i))
    single = {i: t for t, i in largest.items()}
    stay = {i for i, (_, c) in brute_components(list(single.items()), 5, 80).items() if i == c}
    rest = all_docs.where(F.col("doc_id").isin(*stay))
    clean = {r.doc_id for r in dc.decontaminate(rest.select("doc_id", "text"), spark.read.parquet(f"{SF001}/benchmark.parquet"), "doc_id").collect() if r.kept}
    rows = corpus_pipeline.run(spark, SF001).collect()
    assert len(rows) == len(clean) and {r.doc_id for r in rows} == clean and all(r.round_trip for r in rows)


def test_stages_take_clashing_names(spark, edge):
    """The stages quality, near and leaks keep columns that are called like the operators' own."""
    named = edge.withColumns({n: F.lit(n) for n in ("key", "_key", "score", "p_quality")})
    for stage in (corpus_pipeline.quality, corpus_pipeline.near, corpus_pipeline.leaks):
        rows = stage(spark, named, SF001).collect()
        assert rows and rows[0].asDict().keys() == dict.fromkeys(named.columns).keys()
        assert all((r.key, r._key, r.score, r.p_quality) == ("key", "_key", "score", "p_quality") for r in rows)
