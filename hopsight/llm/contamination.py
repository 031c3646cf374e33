"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words that a fixed mask keeps of a few words in a row; the positions it ignores
may differ. Seeds of the benchmark are joined with those of every place of every document. A hit gives an
alignment of a document with an item; every alignment that was hit is compared place by place, and its best
stretch is reported if enough of its words are equal.

No stretch is lost. Let a stretch of n >= 10 words have m changes, so at least 4m equal words in m + 1 runs.
If no run has 4 words, the runs have at most 3(m + 1), so 4m <= 3m + 3 and m <= 3; for m = 3 all four runs have
3 words, for m = 2 the 8 or 9 equal words are 3 + 3 + 2 in some order or 3 + 3 + 3, and for m = 1 one of two runs has
5. So either four words in a row are equal, or two runs of at least two words with one changed word between: the
masks 1111 and 11011. Items of 6 to 9 words allow one change, which leaves the same; those of 5 need two masks more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, read

MASKS, MASKS_OF_FIVE = ("1111", "11011"), ("10111", "11101")
#: Words of the shortest stretch (shorter items count whole) and of the shortest item, and percent of equal words.
SPAN, SHORTEST, PERCENT = 10, 5, 80
#: Benchmark seeds that are broadcast at most; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000

_GAP = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Hashes of the words: lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), _GAP), lambda x: x != "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, words: str, masks: tuple[str, ...]) -> DataFrame:
    """`rows` without `words`, a row for each place and mask that fits: at, seed."""
    others, span = [c for c in rows.columns if c != words], max(map(len, masks))
    shifted = [F.slice(words, k + 1, F.size(words)) for k in range(span)]
    places = rows.filter(F.size(words) > 0).select(*others, F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    word = [F.col("z").getField(str(k)) for k in range(span)]

    def seed(number: int, mask: str) -> Column:
        kept = [word[k] for k, c in enumerate(mask) if c == "1"]
        return F.when(word[len(mask) - 1].isNotNull(), F.xxhash64(F.lit(number), *kept))
    seeds = F.array(*[seed(i, mask) for i, mask in enumerate(masks)])
    return places.select(*others, "at", F.explode(seeds).alias("seed")).filter("seed IS NOT NULL")


def _aligned(keyed: DataFrame, bench: DataFrame) -> DataFrame:
    """(row_key, item_key, shift): alignments of documents with items in which a seed hits; shift is the place of the item's first word."""
    five = bench.filter(F.size("iw") == SHORTEST).limit(1).count()
    masks = (*MASKS, *MASKS_OF_FIVE) if five else MASKS
    probes = cut(_seeds(bench.select("item_key", "iw"), "iw", masks).withColumnRenamed("at", "item_at"))
    probes = F.broadcast(probes) if probes.count() <= BROADCAST_SEEDS else probes
    placed = _seeds(keyed.select("row_key", _words(F.col("text")).alias("w")), "w", masks)
    return placed.join(probes, "seed").select("row_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _best(aligned: DataFrame) -> DataFrame:
    """The best stretch of each alignment (key columns, span, equal: whether each place is): first, words, matched; none if no stretch counts."""
    key = [c for c in aligned.columns if c not in ("span", "equal")]
    line = W.partitionBy(*key)
    steps = aligned.select(*key, "span", F.posexplode(F.concat(F.array(F.lit(None).cast("int")), "equal")).alias("at", "e"))
    upto = line.orderBy("at")
    # a stretch from i to j keeps PERCENT if balance(j) >= balance(i)
    steps = steps.select(*key, "span", "at", F.coalesce(F.sum("e").over(upto), F.lit(0)).alias("matched"),
                         F.coalesce(F.sum(F.col("e") * 100 - PERCENT).over(upto), F.lit(0)).alias("balance"))
    steps = steps.withColumn("last", F.max("at").over(W.partitionBy(*key, "matched")))
    begin = F.min(F.struct("at", "matched", "last")).over(line.orderBy("balance").rangeBetween(W.unboundedPreceding, 0))
    ends = steps.withColumn("b", begin).filter(F.col("at") - F.col("b.at") >= F.col("span"))
    # the fewest words with as many equal ones
    first = F.least(F.col("b.last"), F.col("at") - F.col("span"))
    best = F.min(F.struct((F.col("b.matched") - F.col("matched")).alias("m"), (F.col("at") - first).alias("words"), first.alias("first")))
    return ends.groupBy(*key).agg(best.alias("x")).select(*key, "x.first", "x.words", (-F.col("x.m")).alias("matched"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, doc_id, item_id, start, words, matched): the best overlap of each document with each item.

    `docs` has doc_id and text, `items` item_id and text. An overlap is a stretch of at least SPAN words
    (the whole item, if it has SHORTEST to SPAN - 1) of which PERCENT are equal, place by place; the best has the
    most equal words, then the fewest words, then the first start. start and words are the document's, matched
    counts equal words. Every such overlap is found, whatever words are changed. Items of
    the same words are one, under their smallest id; items of fewer than SHORTEST words, null or empty,
    match nothing, nor does a null text. Rows that repeat share a row_key and are reported once; empty
    tables give no rows; other columns are not looked at. Texts and items are compared whole, whatever their length.
    """
    bench = (items.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("iw"))
             .filter(F.size("iw") >= SHORTEST).groupBy("iw").agg(F.min("item_id").alias("item_id"))
             .withColumn("item_key", F.xxhash64("iw")))
    bench = cut(bench)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    hits = cut(_aligned(keyed, bench).groupBy("row_key").agg(F.collect_list(F.struct("item_key", "shift")).alias("hits")))
    x = F.col("h")
    own, items_ = F.slice("w", F.greatest(x.shift, F.lit(0)) + 1, F.size("iw")), F.slice("iw", F.greatest(-x.shift, F.lit(0)) + 1, F.size("iw"))
    n = F.least(F.size("x"), F.size("y"))
    equal = F.zip_with(F.slice("x", 1, n), F.slice("y", 1, n), lambda a, b: (a == b).cast("int"))
    aligned = (keyed.join(hits, "row_key").dropDuplicates(["row_key"])
               .select("row_key", "doc_id", _words(F.col("text")).alias("w"), "hits").select("row_key", "doc_id", "w", F.explode("hits").alias("h"))
               .join(bench.withColumnRenamed("item_key", "_key"), F.col("h.item_key") == F.col("_key"))
               .select("row_key", "doc_id", "item_id", x.shift.alias("shift"), F.least(F.size("iw"), F.lit(SPAN)).alias("span"), own.alias("x"), items_.alias("y"))
               .withColumn("equal", equal))
    # most seeds meet by chance: fewer equal words than any stretch needs
    enough = F.aggregate("equal", F.lit(0), lambda a, e: a + e) * 100 >= F.col("span") * PERCENT
    found = _best(aligned.filter(enough & (F.size("equal") >= F.col("span"))).drop("x", "y"))
    found = found.withColumn("start", F.greatest(F.col("shift"), F.lit(0)) + F.col("first"))
    best = F.struct((-F.col("matched")).alias("m"), F.col("words").alias("w"), F.col("start").alias("s"))
    return (found.groupBy("row_key", "doc_id", "item_id").agg(F.min(best).alias("x"))
            .select("row_key", "doc_id", "item_id", F.col("x.s").alias("start"), F.col("x.w").alias("words"), (-F.col("x.m")).alias("matched")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text) that overlap with no item; columns unchanged, whatever their names.

    Null, empty and repeated texts as in `overlaps`: a null or empty text stays, and repeated rows stay or go together.
    """
    bad = overlaps(docs, items).select(F.col("row_key").alias("k")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.join(bad, F.col("row_key") == F.col("k"), "left_anti").select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "words", "matched")


#: Without seeds: every pair of equal words votes for its alignment, and all stretches of the alignments left are tried.
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(text), '{_GAP}'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (SELECT min(item_id) item_id, w FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '{_GAP}'), lambda x: x <> '') w FROM benchmark)
    WHERE len(w) >= {SHORTEST} GROUP BY w),
dw AS (SELECT doc_id, unnest(w) x, unnest(range(len(w))) i FROM d),
bw AS (SELECT item_id, least(len(w), {SPAN}) span, unnest(w) x, unnest(range(len(w))) i FROM b),
a AS (SELECT doc_id, item_id, any_value(span) span, dw.i - bw.i shift FROM dw JOIN bw USING (x) GROUP BY doc_id, item_id, shift
    HAVING count(*) * 100 >= any_value(span) * {PERCENT}),
e AS (SELECT a.*, greatest(shift, 0) off, range(greatest(shift, 0), least(len(d.w), shift + len(b.w))) r, d.w dw, b.w bw FROM a JOIN d USING (doc_id) JOIN b USING (item_id)),
p AS (SELECT doc_id, item_id, span, shift, off, list_transform(r, lambda k: CASE WHEN dw[k + 1] = bw[k - shift + 1] THEN 1 ELSE 0 END) q FROM e),
c AS (SELECT doc_id, item_id, span, shift, off, q, i, unnest(range(i + span, len(q) + 1)) j FROM (SELECT *, unnest(range(len(q))) i FROM p)),
s AS (SELECT doc_id, item_id, off + i AS start, j - i AS words, CAST(list_sum(q[i + 1:j]) AS INTEGER) matched FROM c)
SELECT doc_id, item_id, CAST(start AS INTEGER) start, CAST(words AS INTEGER) words, matched FROM s WHERE matched * 100 >= words * {PERCENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, words, start) = 1
"""
