"""Order MinHash fingerprints, in DataFrame operations only.

1. A text's tokens are its words between white space; of a word of more than
   ``WORD_CHARS`` characters (scripts without spaces, encoded data) each
   character is a token.  ``K`` tokens in a row make a k-mer (a shorter text is
   one k-mer), and equal k-mers are numbered by occurrence, so repeats count.
2. A hash of k-mer and occurrence number puts each of them on a ring of 2^64
   places.  Sketch j of ``SKETCHES`` orders them from place j / SKETCHES of the
   ring on, and selects the ``TUPLE`` minimal ones.
3. The selected k-mers are put back in the order of the text, and a hash of
   that tuple is the sketch's value.  Two texts share it if they share the
   minimal k-mers and their order, which an edit near either one breaks: the
   share of equal values is a likeness that falls with edit distance, where
   plain MinHash doesn't see order.

Everything is one chain of array functions per row: no shuffle, and time that
grows with the text's length times its logarithm.  K-mers are sorted as longs
that hold hash and position, so occurrence numbers come from runs of equal
hashes in one sorted array.

Defined cases: a null text counts as empty; a text without tokens has an empty
fingerprint, which is like itself (1) and unlike any other (0); repeated rows
get equal fingerprints; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import bloom_hit, bloom_words, cut, let, table

K, TUPLE, SKETCHES = 2, 2, 64
WORD_CHARS = 24
HEX = 8                      # hex digits of a sketch's value in the text form
BUCKETS = 8                  # order buckets for each shuffle partition
NULL_BUCKETS = 16            # and for rows without an id


def _at(array: Column, i: Column) -> Column:
    """Element i of an array of longs without nulls, typed as never null."""
    return F.coalesce(F.get(array, i), F.lit(0).cast("long"))


def _range(n: Column) -> Column:
    """0 .. n - 1, none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _steps(n: Column) -> Column:
    """Powers of two from n's highest bit down to 1: the steps of a search among n places."""
    return F.reverse(F.transform(_range(F.length(F.bin(n.cast("long")))), lambda b: F.pow(F.lit(2), b).cast("int")))


def _places_before(steps: Column, n: Column, fits) -> Column:
    """How many of n places, from the first on, fit; ``fits`` tells it of one place."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & F.coalesce(fits(at + step - 1), F.lit(False)), at + step).otherwise(at))


def with_sketches(df: DataFrame, text: str, name: str, k: int = K, tuple_size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """``df`` with the array column ``name``: the sketches of the string column ``text`` (not null); empty without tokens."""
    made = []

    def stage(part: str, value: Column) -> Column:
        nonlocal df
        made.append(f"_{name}_{part}")
        df = df.withColumn(made[-1], value)
        return F.col(made[-1])

    words = stage("words", F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    tokens = stage("tokens", F.when(F.exists(words, lambda w: F.length(w) > WORD_CHARS), F.flatten(F.transform(
        words, lambda w: F.when(F.length(w) > WORD_CHARS, F.split(w, "")).otherwise(F.array(w))))).otherwise(words))
    n = F.when(F.size(tokens) > 0, F.greatest(F.size(tokens) - (k - 1), F.lit(1))).otherwise(0)
    n = stage("n", n)
    low_bits = stage("low", (F.pow(F.lit(2.0), F.length(F.bin(n.cast("long")))) - 1).cast("long"))  # they hold a position
    high_bits = stage("high", F.bitwise_not(low_bits))

    def kmer(i: Column) -> Column:
        return F.xxhash64(*[F.get(tokens, i + j if j else i) for j in range(k)])

    # sorted by hash, then position: equal k-mers stand together in the order of the text
    ranked = stage("ranked", F.sort_array(F.transform(_range(n), lambda i: kmer(i).bitwiseAND(high_bits).bitwiseOR(i.cast("long")))))
    once = stage("once", F.filter(ranked, lambda x, i: (i == 0) | (x.bitwiseAND(high_bits) != _at(ranked, i - 1).bitwiseAND(high_bits))))
    # a k-mer's first occurrence has the hash itself as its place, the others one that depends on their number
    more = stage("more", F.array_except(ranked, once))
    heads = stage("heads", F.filter(_range(F.size(more)), lambda i: (i == 0) | (
        _at(more, i).bitwiseAND(high_bits) != _at(more, i - 1).bitwiseAND(high_bits))))
    number = F.flatten(F.transform(heads, lambda s, j: F.sequence(F.lit(1), F.coalesce(F.get(heads, j + 1), F.size(more)) - s)))
    placed = F.zip_with(more, number, lambda x, o: F.xxhash64(x.bitwiseAND(high_bits), o).bitwiseAND(high_bits).bitwiseOR(x.bitwiseAND(low_bits)))
    ring = stage("ring", F.when(F.size(more) > 0, F.sort_array(F.concat(once, placed))).otherwise(ranked))

    # a sketch's elements are the next ones from its start on; after the last the ring begins again
    starts = F.array(*[F.lit((j << 64) // sketches - (1 << 63)).cast("long") for j in range(sketches)])
    starts = F.when(n > 0, starts).otherwise(F.array().cast("array<long>"))
    first = stage("first", let(_steps(n), lambda steps: F.transform(
        starts, lambda start: _places_before(steps, n, lambda i: F.get(ring, i) < start))))
    picked = stage("picked", F.transform(first, lambda at: F.sort_array(F.array(*[
        F.when(F.lit(j) < n, _at(ring, (at + j) % n).bitwiseAND(low_bits)).otherwise(F.lit(-1).cast("long")) for j in range(tuple_size)]))))
    df = df.withColumn(name, F.transform(picked, lambda p: F.xxhash64(*[  # nulls don't enter a hash
        F.when(p[j] >= 0, kmer(p[j].cast("int"))) for j in range(tuple_size)])))
    return df.drop(*made)


def as_text(sketches: Column) -> Column:
    """Fingerprint as one string, ``HEX`` digits a sketch."""
    return F.array_join(F.transform(sketches, lambda v: F.substring(F.lpad(F.hex(v), 16, "0"), 1, HEX)), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches (0 to 1); of two texts without tokens 1, of one and another 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(same / F.greatest(F.size(a), F.size(b), F.lit(1)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint."""
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    return with_sketches(texts, "_t", "s").select(F.col("_id").alias(id_col), as_text(F.col("s")).alias("fingerprint"))


# --- the next row of a total order, without one task that sorts all ---------------------------------------

def _bucket(id_: Column, h: Column, bounds: Column, steps: Column) -> Column:
    """Place of a row among ``bounds`` (ids, descending); ids that fill several buckets, and nulls, are split by hash."""
    def part(wide: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((F.lit(0.5) - h / F.lit(2.0 ** 64)) * wide).cast("int"), wide - 1))

    before, upto = (_places_before(steps, F.size(bounds), fits) for fits in
                    (lambda i: F.get(bounds, i) > id_, lambda i: F.get(bounds, i) >= id_))
    return F.when(id_.isNull(), F.size(bounds) + 1 + part(F.lit(NULL_BUCKETS))).otherwise(before + part(upto - before + 1))


def with_next(rows: DataFrame, id_col: str, text_col: str, values: dict[str, str]) -> DataFrame:
    """``rows`` with further columns: ``values`` (new name -> column) of the next row by descending id (a number).

    After the last row comes the first; null ids come last; rows of one id go
    by a hash of the text.  Rows that repeat id and text count as one row, and
    each of them is returned.  Texts are shuffled once: order buckets come from
    quantiles of the ids, and the first row of each bucket goes to the bucket
    before it as well.
    """
    spark, columns = rows.sparkSession, rows.columns
    h = F.xxhash64(text_col, F.lit(7))
    keys = cut(rows.select(F.col(id_col).alias("id"), h.alias("h")).groupBy("id", "h").agg(F.count("*").alias("n")))
    # rows that repeat id and text are few; a filter finds them, and they are counted and reduced to one
    repeated = cut(keys.where("n > 1").select(F.xxhash64("id", "h").alias("key")))
    bits = 1024
    while bits < 12 * repeated.count() and bits < 1 << 27:
        bits *= 2
    rows = rows.select(F.struct(*columns).alias("r"), F.col(id_col).alias("id"), h.alias("h"))
    twice = bloom_hit(cut(bloom_words(repeated, "key", bits, 4)).scalar(), F.xxhash64("id", "h"), bits, 4)
    merged = rows.where(twice).groupBy("id", "h").agg(F.any_value("r").alias("r"), F.count("*").alias("n"))
    rows = rows.where(~twice).withColumn("n", F.lit(1).cast("long")).unionByName(merged)

    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    bounds = cut(keys.agg(F.coalesce(F.sort_array(F.percentile_approx("id", shares, max(10000, 4 * n_buckets)), asc=False),
                                     F.array().cast("array<long>")).alias("bounds"))).scalar()
    place = _bucket(F.col("id"), F.col("h"), F.col("bounds"), F.array(*[F.lit(1 << b) for b in reversed(range(n_buckets.bit_length()))]))
    # one entry a bucket: its first row, and the bucket before it that has rows (of the first one: the last)
    order = F.struct(F.col("id").isNotNull().alias("some"), "id", "h")
    firsts = keys.withColumn("bounds", bounds).withColumn("bucket", place).groupBy("bucket").agg(F.max(order).alias("first"))
    in_order = Window.orderBy("bucket")  # as many rows as buckets
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    every = spark.range(0, n_buckets + NULL_BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    edges = cut(every.join(firsts, "bucket", "left").agg(F.sort_array(F.collect_list(F.struct("bucket", "first", "before"))).alias("edges"))).scalar()

    dealt = rows.withColumn("bounds", bounds).withColumn("bucket", place).withColumn("edge", F.get(edges, F.col("bucket")))
    own = F.struct(F.lit(False).alias("guest"), F.col("bucket"))
    is_first = F.col("edge.first.h").eqNullSafe(F.col("h")) & F.col("edge.first.id").eqNullSafe(F.col("id"))
    to = F.when(is_first, F.array(own, F.struct(F.lit(True).alias("guest"), F.col("edge.before").alias("bucket")))).otherwise(F.array(own))
    dealt = dealt.select("r", "n", "id", "h", F.explode(to).alias("to")).select("r", "n", "id", "h", "to.guest", "to.bucket")
    w = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("h").desc())
    ahead = dealt.select("r", "n", "guest", *[F.lead(f"r.{c}").over(w).alias(new) for new, c in values.items()]).where("not guest")
    return (ahead.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("r.*", *values))


# --- the registered query -------------------------------------------------------------------------------

def op11_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, with their likeness to each other and to the next document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_sketches(docs, "text", "own"), "doc_id", "text", {"next_text": "text", "next": "own"})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substr("next_text", F.lit(1), tail))
    docs = with_sketches(docs.withColumn("edited", edited).drop("text", "next_text"), "edited", "changed")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
