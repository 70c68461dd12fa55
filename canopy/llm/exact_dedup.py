"""Exact dedup by progressive refinement, in DataFrame operations only.

1. one scan gives (byte length, prefix hash) of every text; lengths met once
   are done, and of the others those (length, prefix hash) pairs met once;
2. the pairs met more than once go into a Bloom filter of fixed size;
3. a second scan hashes the full content (SHA-256) of rows that hit the filter
   only, and these rows alone are grouped by it.

Rows that miss the filter are singletons for certain; a false hit costs one
hash and cannot change the result, because the full hash decides.  No text is
shuffled, and a hot group meets only partial aggregation and a join whose
large partitions adaptive execution can split.

Defined cases: a null text counts as empty; null ids count as smaller than
any other id; of repeated rows with the same id and text exactly one stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import bloom_hit, bloom_words, cut, join_groups, table

PREFIX_CHARS = 64      # characters of the prefix hash
FILTER_BITS = 1 << 22  # size of the survivor filter: 512 KB at any corpus size
FILTER_HASHES = 3


def surviving_pairs(df: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``pair``: hashes of the (length, prefix) pairs that more than one row has."""
    keys = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("h"))
    by_pair = keys.groupBy("n", "h").agg(F.count("*").alias("rows"))
    # a length met once has one pair met once, so the counts by length follow from those by pair
    by_length = by_pair.groupBy("n").agg(F.sum("rows").alias("same_length")).where("same_length > 1")
    return by_pair.where("rows > 1").join(by_length, "n", "left_semi").select(_pair("n", "h").alias("pair"))


def _pair(n, h):
    return F.xxhash64(F.col(n).cast("long") if isinstance(n, str) else n.cast("long"), h)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False,
                prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  ``text_sha256`` is null
    for rows that needed no full hash, unless ``digest_all`` asks for it.
    """
    words = bloom_words(surviving_pairs(df, text_col, prefix_chars), "pair", filter_bits, FILTER_HASHES)
    t = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    pair = _pair(F.octet_length("_t"), F.xxhash64(F.substring("_t", 1, prefix_chars)))
    t = t.withColumn("_shared", bloom_hit(words.scalar(), pair, filter_bits, FILTER_HASHES))
    digest = F.sha2(F.col("_t"), 256)
    rows = cut(t.select("_id", "_shared", (digest if digest_all else F.when(F.col("_shared"), digest)).alias("_sha"),
                        F.monotonically_increasing_id().alias("_row")))
    shared = rows.where("_shared")
    groups = shared.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    dup = join_groups(shared, groups, "_sha").select(
        "_id", F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "_sha")
    single = rows.where("not _shared").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    return dup.unionByName(single).withColumnsRenamed({"_id": id_col, "_sha": "text_sha256"})


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """The input's rows without copies: of equal texts the row with the largest id stays, with all its columns.

    Singletons are passed on as they are read; the others meet in a partial
    aggregation by full hash, so a group's copies go before the shuffle.
    """
    words = cut(bloom_words(surviving_pairs(df, text_col, prefix_chars), "pair", filter_bits, FILTER_HASHES))
    t = F.coalesce(F.col(text_col), F.lit(""))
    pair = _pair(F.octet_length(t), F.xxhash64(F.substring(t, 1, prefix_chars)))
    shared = bloom_hit(words.scalar(), pair, filter_bits, FILTER_HASHES)
    whole = F.struct(*[F.col(c) for c in df.columns])
    stays = (df.where(shared).select(F.sha2(t, 256).alias("_sha"), whole.alias("_r"))
             .groupBy("_sha").agg(F.max_by("_r", F.struct(F.col(f"_r.{id_col}").isNotNull(), F.col(f"_r.{id_col}"))).alias("_r")))
    return df.where(~shared).unionByName(stays.select("_r.*"))


def op1_exact_dedup(spark, sf_dir):
    """Every document with the row that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
