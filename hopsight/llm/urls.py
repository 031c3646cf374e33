"""URL filters by a Bloom filter cascade: exact list membership without a join at the time of judging.

A key is a host suffix with a path prefix. The key universe is every key of the corpus that has as
many labels and as long a path as some listed key. Level 1 encodes the listed keys, level 2 the
universe's false positives of level 1, level 3 the listed keys that level 2 lets through, and so on
until none is left; the first level that a key fails then tells whether it is listed. A list too
long for one bitmap is dealt by hash into shards, each with its own cascade.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, lower_ascii, read

BITS_PER_KEY, HASHES = 10, 4
#: Bits of one bitmap at most; it travels as a literal of the plan.
MAX_BITS = 1 << 22

#: The rules of the registered query as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Array of (size, host_size, key): host suffixes of `labels` labels with path prefixes of `lengths` characters."""
    part = F.split(host, r"\.")
    found = []
    for n in labels:
        suffix = F.concat_ws(".", F.slice(part, -n, n)) if n else F.lit("")
        for k in lengths:
            key = F.struct((F.length(suffix) + k).alias("size"), F.length(suffix).alias("host_size"),
                           F.concat(suffix, F.substring(path, 1, k)).alias("key"))
            found.append(F.when((F.size(part) >= n) & (F.length(host) > 0) & (F.length(path) >= k), key))
    return F.array_compact(F.array(*found))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Exact membership of universe keys in a list; `build` runs the jobs, `contains` is an expression."""

    def __init__(self, shards: list[list[tuple[int, list[int]]]]):
        self.shards = shards

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
        """`listed` and `universe` hold a column key each; null keys are left out."""
        listed, universe = listed.filter("key IS NOT NULL").distinct(), universe.filter("key IS NOT NULL").distinct()
        n = max(1, -(-listed.count() * BITS_PER_KEY // max_bits))
        shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(n))
        return cls([cls._levels(listed.filter(shard == s), universe.filter(shard == s)) for s in range(n)])

    @staticmethod
    def _levels(listed: DataFrame, universe: DataFrame) -> list[tuple[int, list[int]]]:
        levels: list[tuple[int, list[int]]] = []
        encoded, other = listed, universe.join(listed, "key", "left_anti")
        while count := encoded.count():
            level, bits = len(levels) + 1, 64 * -(-count * BITS_PER_KEY // 64)
            words = (encoded.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
                     .groupBy(F.expr("p div 64").alias("word"))
                     .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set")).collect())
            bitmap = [0] * (bits // 64)
            for r in words:
                bitmap[r["word"]] = r["set"]
            levels.append((bits, bitmap))
            wrong = other.filter(Cascade._passes(F.col("key"), level, bits, bitmap))
            encoded, other = cut(wrong), encoded
        return levels

    @staticmethod
    def _passes(key: Column, level: int, bits: int, bitmap: list[int]) -> Column:
        words = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
                 for p in _positions(key, level, bits)]
        return reduce(and_, tests)

    def contains(self, key: Column) -> Column:
        def of(levels: list[tuple[int, list[int]]]) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for level in range(len(levels), 0, -1):
                out = F.when(self._passes(key, level, *levels[level - 1]), out).otherwise(F.lit(level % 2 == 0))
            return out
        if len(self.shards) == 1:
            return of(self.shards[0])
        shard, out = F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(len(self.shards))), F.lit(False)
        for s, levels in enumerate(self.shards):
            out = F.when(shard == s, of(levels)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: its id, host, path, rule and verdict.

    `rules` holds (verdict 'allow' or 'block', host, path). A rule fits its host and all subdomains if
    the path starts with the rule's; the longest rule wins, of equally long ones that with the longer
    host, and block if both lists hold it. A url that no list holds gets `default` and a null rule.
    Host and path of a null url, or one without ://, are empty, which fits no rule. Repeated rows are
    judged alike, an empty table gives no rows, other columns are not looked at.
    """
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")).distinct().collect()
    labels, lengths = sorted({r["n"] for r in shapes}), sorted({r["k"] for r in shapes})
    parted = pages.select(F.col(id_column), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if not shapes:
        return parted.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parted = parted.withColumn("_keys", keys(F.col("host"), F.col("path"), labels, lengths))
    universe = cut(parted.select(F.explode("_keys.key").alias("key")).distinct())
    rule_key = F.concat("host", "path").alias("key")
    cascades = {v: Cascade.build(rules.filter(F.col("verdict") == v).select(rule_key), universe)
                for v in ("allow", "block")}
    best = F.array_max(F.filter("_keys", lambda k: cascades["block"].contains(k["key"])
                                | cascades["allow"].contains(k["key"])))["key"]
    judged = parted.withColumn("rule", best)
    return judged.select(id_column, "host", "path", "rule", F.when(F.col("rule").isNull(), default)
                         .when(cascades["block"].contains(F.col("rule")), "block").otherwise("allow").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "verdict string, host string, path string"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
SQL = (r"WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), "
       r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, "
       r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path FROM pages), "
       "r AS (SELECT *, CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST) + " END rule FROM p) "
       "SELECT *, CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " ELSE 'allow' END verdict FROM r")
