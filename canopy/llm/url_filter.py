"""URL rules and host lists by Bloom filter cascades, in DataFrame operations only.

A cascade stores a list of keys for exact membership over one corpus.  Level 1
is a Bloom filter of the listed keys; level 2 holds the corpus keys that hit
level 1 without being listed; level 3 the listed keys that hit level 2; and so
on until a level has no false hit.  The key universe is every key that the
corpus can ask for, so the answer is exact for each of its rows, and a row is
judged by array look-ups alone: no join touches the pages.

Keys of a url are made from the shapes of the list: for a rule with h host
labels and p path characters, the last h labels of the host followed by the
first p characters of the path.  A rule fits exactly when one of these keys is
the rule itself.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored.  A rule listed with both
verdicts blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import bloom_hit, bloom_words, cut, table

BITS_PER_KEY = 12
HASHES = 4
MAX_LEVEL_BITS = 1 << 27     # 16 MB: largest filter that is shipped to the tasks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED_HOSTS = ("cheap-pills.example.com", "spam-farm.example.org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def shapes(rules: list[str]) -> list[tuple[int, int]]:
    """(host labels, path characters) of each kind of rule."""
    return sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in rules})


def keys_of(host: Column, path: Column, kinds: list[tuple[int, int]]) -> list[Column]:
    return [F.concat(F.substring_index(host, ".", -h), F.substring(path, 1, p)) for h, p in kinds]


class BloomCascade:
    """Exact membership of ``listed`` (one string column ``key``) among the keys of ``universe``."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = cut(listed.distinct())
        outside = cut(universe.distinct().join(inside, "key", "left_anti"))
        self.levels: list[tuple[Column, int]] = []
        members, others, left = inside, outside, inside.count()
        while left:
            bits = 1024
            while bits < left * BITS_PER_KEY:
                bits *= 2
            if bits > MAX_LEVEL_BITS:
                raise ValueError(f"{left} keys need a filter of more than {MAX_LEVEL_BITS} bits")
            salt = len(self.levels)
            words = cut(bloom_words(members.select(_salted(F.col("key"), salt).alias("key")), "key", bits, HASHES)).scalar()
            self.levels.append((words, bits))
            false_hits = cut(others.where(bloom_hit(words, _salted(F.col("key"), salt), bits, HASHES)))
            members, others, left = false_hits, members, false_hits.count()

    def __contains__(self, key):
        raise TypeError("use has(column)")

    def has(self, key: Column) -> Column:
        found = F.lit(False)
        for salt in reversed(range(len(self.levels))):
            words, bits = self.levels[salt]
            found = bloom_hit(words, _salted(key, salt), bits, HASHES) & ~found
        return found


def _salted(key: Column, salt: int) -> Column:
    return F.xxhash64(key, F.lit(salt))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: tuple[tuple[str, str], ...] = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    The longest rule that fits gives the verdict; without one, hosts in
    ``blocked_hosts`` and their subdomains are blocked and the rest allowed.
    """
    spark = df.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule_kinds, host_kinds = shapes([r for r, _ in rules]), shapes(list(blocked_hosts))
    rule_keys = keys_of(F.col("host"), F.col("path"), rule_kinds)
    host_keys = keys_of(F.col("host"), F.col("path"), host_kinds)

    def cascade(keys: list[str], asked: list[Column]) -> BloomCascade:
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        universe = urls.select(F.explode(F.array(*asked)).alias("key")) if asked else listed
        return BloomCascade(listed, universe)

    block = cascade([r for r, v in rules if v == "block"], rule_keys)
    allow = cascade([r for r, v in rules if v == "allow"], rule_keys)
    hosts = cascade(list(blocked_hosts), host_keys)
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = [F.when(block.has(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit("block").alias("verdict")))
            .when(allow.has(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit("allow").alias("verdict")))
            for k in rule_keys]
    listed_host = F.lit(False)
    for k in host_keys:
        listed_host = listed_host | hosts.has(k)
    return (urls.withColumn("_fit", F.array_max(F.array_compact(F.array(none, *fits)))).withColumn("_listed", listed_host)
            .select(F.col("_id").alias(id_col), "host", "path", F.col("_fit.rule").alias("rule"),
                    F.coalesce("_fit.verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict")))


def op7_url_filter(spark, sf_dir):
    """Host, path, longest rule and verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))


SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN ends_with('.' || host, '.cheap-pills.example.com') OR ends_with('.' || host, '.spam-farm.example.org') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""
