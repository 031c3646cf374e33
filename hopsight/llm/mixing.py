"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 60-bit hash of its id and text. Sizes are summed by source and leading hash bits,
the running sum shows the bucket in which a source's budget ends, and only the rows of that bucket
are summed again by their next bits, until one hash is left. Rows below the threshold are taken;
nothing is sorted. A larger budget has a larger threshold, so mixes are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, read, word_count

HASH_BITS, LEVEL_BITS = 60, 12
#: The weights are set per source on the driver; more sources than this is an error.
MAX_SOURCES = 1_000_000
#: Thresholds of so many sources are broadcast; more are joined.
BROADCAST_SOURCES = 20_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text (null: empty), so that rows without an id differ by their text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], most: int) -> dict[str | None, float]:
    """The total size dealt by weight; no source gets above `most` times its own, the excess goes to the others.

    Sources are in code point order, null last, and take the weights in turn.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(most * size / weights[i % len(weights)], i, source, size, weights[i % len(weights)])
            for i, (source, size) in enumerate(ordered)]
    left, weight, level, out = sum(size for _, size in ordered), sum(r[4] for r in rows), 0.0, {}
    for ratio, _, source, size, w in sorted(rows, key=lambda r: r[:2]):
        if level == 0.0 and left / weight > ratio:
            out[source] = float(most * size)
            left, weight = left - most * size, weight - w
        else:
            level = level or left / weight
            out[source] = level * w
    return out


def thresholds(rows: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, copies, threshold) from `rows` (source, size, h).

    Every row of the source is taken `copies` times, those with a hash below `threshold` once more.
    The hash at which the budget ends is taken if that brings the sum nearer.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r["source"]: r["size"] for r in sums}
    target = targets(list(size.items()), weights, most) if sum(size.values()) else dict.fromkeys(size, 0.0)
    copies = {s: int(target[s] // n) if n else 0 for s, n in size.items()}
    rest = {s: target[s] - copies[s] * n for s, n in size.items()}
    threshold, shift = dict.fromkeys(size, 0), HASH_BITS
    open_ = {s: (0, 0) for s, n in size.items() if n}  # source: prefix of the open bucket, sum before it
    while open_:
        state = spark.createDataFrame([(s, p, b, rest[s]) for s, (p, b) in open_.items()],
                                      "o_source string, o_prefix long, o_before long, o_rest double")
        state = F.broadcast(state) if len(open_) <= BROADCAST_SOURCES else state
        within = F.expr(f"shiftright(h, {shift})") if shift < HASH_BITS else F.lit(0).cast("long")
        shift -= LEVEL_BITS
        buckets = (rows.withColumn("o_p", within)
                   .join(state, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("o_p") == F.col("o_prefix")))
                   .groupBy("source", F.expr(f"shiftright(h, {shift})").alias("prefix"), "o_before", "o_rest")
                   .agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        running = F.sum("n").over(W.partitionBy("source").orderBy("prefix"))
        ends = (buckets.withColumn("before", F.col("o_before") + running - F.col("n"))
                .filter("before + n > o_rest").groupBy("source")
                .agg(F.min_by(F.struct("prefix", "before", "n", "lo", "hi"), "prefix").alias("b")).collect())
        open_ = {}
        for source, b in ends:
            if b["lo"] == b["hi"]:
                threshold[source] = b["lo"] + (2 * (rest[source] - b["before"]) >= b["n"])
            else:
                open_[source] = (b["prefix"], b["before"])
    return spark.createDataFrame([(s, n, float(target[s]), copies[s], threshold[s]) for s, n in size.items()],
                                 "source string, source_size long, target double, copies int, threshold long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def _with_copies(df: DataFrame, found: DataFrame) -> DataFrame:
    """`df` (source, h, and what it is to keep) with the columns of its source's row of `found`, and `copies`, the times it is taken."""
    side = found.select(F.col("source").alias("of"), *[c for c in found.columns if c != "source"]).withColumnRenamed("copies", "whole")
    side = F.broadcast(side) if found.count() <= BROADCAST_SOURCES else side
    return df.join(side, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "copies", F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken (copies * size).

    Null text has size 0; a null source is a source of its own; rows equal in id and text share a
    hash and are taken together; an empty table gives no rows; other columns are not looked at.
    """
    rows = cut(sized(docs))
    return _with_copies(rows, thresholds(rows, weights, most)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of `docs` (doc_id, text, source) that the mix takes, with `copies`, the times it takes them; thresholds as in `mix`.

    Other columns stay whatever their names, but for `copies`, which is replaced. Rows without words are not taken; rows
    equal in id and text are taken alike; a null source is a source of its own; an empty table gives no rows.
    """
    found = thresholds(cut(sized(docs)), weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("r"), "source",
                       row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    return _with_copies(rows, found).filter("copies > 0").select("r.*", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) k FROM s),
c AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE remaining,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE weight
  FROM r WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) k FROM c WHERE remaining / weight <= 3 * source_size / w),
t AS (SELECT c.source, c.source_size, CASE WHEN c.k < coalesce(f.k, 9e9) THEN 3.0::DOUBLE * c.source_size
    ELSE (SELECT remaining / weight FROM c JOIN f USING (k)) * c.w END target FROM c, f),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END whole FROM t),
u AS (SELECT source, h, sum(size) n FROM d GROUP BY ALL),
v AS (SELECT u.*, sum(n) OVER (PARTITION BY source ORDER BY h) - n seen FROM u)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN seen + n <= target - whole * source_size
    OR (seen <= target - whole * source_size AND 2 * (target - whole * source_size - seen) >= n) THEN 1 ELSE 0 END) taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN v ON d.source IS NOT DISTINCT FROM v.source AND d.h = v.h
"""
