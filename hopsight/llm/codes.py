"""Compression of vectors to short codes: a codebook per part, parts assigned by LAESA.

A few fixed pivots per part position are chosen once, and every part's distance to them is computed
once and stored. In each round the distances from pivots to entries give, by the triangle inequality,
a lower bound for every entry; entries are evaluated in the order of their bounds, in whole numbers,
until no bound is below the best distance found. A round is one scan that returns sums per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read
from .vectors import by_dimension, finite, scaled, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Pivots per part position; rows handled at once.
PIVOTS, ROWS = 4, 4096
#: Bounds are lowered by this share of the distances they come from, above the rounding of single precision.
SLACK = 1e-6
#: A label with more than one in this many rows is joined by broadcast: there are no more such labels than this.
HOT_SHARE = 1000


def bounds(dim: int) -> list[tuple[int, int]]:
    """Begin and end of each part: equal lengths where PARTS divides `dim`."""
    return [(p * dim // PARTS, (p + 1) * dim // PARTS) for p in range(PARTS)]


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(rows of x, rows of to): Euclidean distances of integer rows."""
    return np.sqrt(((x[:, None, :] - to[None]) ** 2).sum(axis=2).astype(np.float64))


def choose_pivots(entries: np.ndarray) -> np.ndarray:
    """Up to PIVOTS of the first entries, each the farthest from those before it."""
    picked = [0]
    while len(picked) < min(PIVOTS, len(entries)):
        picked.append(int(_distances(entries, entries[picked]).min(axis=1).argmax()))
    return entries[picked]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (ties to the lower index), its squared distance, and the number of distances evaluated."""
    low = np.zeros((len(x), len(entries)))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p, None].astype(np.float64), entry_pivots[None, :, p]
        np.maximum(low, np.abs(a - b) - SLACK * (a + b), out=low)
    low *= low
    order = np.argsort(low, axis=1, kind="stable")
    at, best, least, seen = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    for rank in range(len(entries)):
        entry = order[at, rank]
        open_ = low[at, entry] <= least[at]
        at, entry = at[open_], entry[open_]
        if not len(at):
            break
        seen += len(at)
        d = ((x[at] - entries[entry]) ** 2).sum(axis=1)
        better = (d < least[at]) | ((d == least[at]) & (entry < best[at]))
        best[at[better]], least[at[better]] = entry[better], d[better]
    return best, least, seen


def _assigned(batches: Iterator[pa.RecordBatch], dim: int, books: list[np.ndarray], pivots: list[np.ndarray]) -> Iterator[tuple]:
    """For each run of rows: the batch, its integers, codes (rows, PARTS) and squared distances (rows, PARTS)."""
    n_pivots, to_entries = len(pivots[0]), [_distances(b, p) for b, p in zip(books, pivots, strict=True)]
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            x = unpacked(batch.column("ints"), np.int32, dim).astype(np.int64)
            near = unpacked(batch.column("more"), np.float32, PARTS * n_pivots).reshape(-1, PARTS, n_pivots)
            found = [nearest(x[:, a:b], near[:, p], books[p], to_entries[p]) for p, (a, b) in enumerate(bounds(dim))]
            yield batch, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(dim: int, books: list[np.ndarray], pivots: list[np.ndarray]) -> Callable:
    """Rows (place, x) of a partition: for entry e the sums at e * (dim + PARTS) + component, then the counts by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books[0]), dim + PARTS), np.int64)
        for _, x, codes, _ in _assigned(batches, dim, books, pivots):
            for p, (a, b) in enumerate(bounds(dim)):
                np.add.at(total[:, a:b], codes[:, p], x[:, a:b])
                total[:, dim + p] += np.bincount(codes[:, p], minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["place", "x"])
    return run


def _coded(dim: int, books: list[np.ndarray], pivots: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, squares in _assigned(batches, dim, books, pivots):
            text = codes.astype(np.uint8).tobytes().hex()
            text = [text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()),
                                              pa.array(squares.sum(axis=1))], names=["vec_id", "label", "code", "error"])
    return run


def _fit(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of vectors of one dimension."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))))
    start = np.array([[np.floor(SCALE * float(x)) for x in r["embedding"]] for r in first.limit(ENTRIES).collect()]).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in bounds(dim)]
    pivots = [choose_pivots(b) for b in books]

    def to_pivots(ints: np.ndarray) -> np.ndarray:
        return np.concatenate([_distances(ints[:, a:b], pivots[p]) for p, (a, b) in enumerate(bounds(dim))], axis=1)
    table = scaled(rows, ["vec_id", "label"], SCALE, to_pivots)
    for _ in range(ROUNDS):
        # at most ENTRIES * (dim + PARTS) rows come back
        sums = table.mapInArrow(_sums(dim, books, pivots), "place int, x long").groupBy("place").agg(F.sum("x").alias("x")).collect()
        total = np.zeros((len(start), dim + PARTS), np.int64)
        for r in sums:
            total.flat[r["place"]] = r["x"]
        for p, (a, b) in enumerate(bounds(dim)):
            used = total[:, dim + p] > 0
            books[p][used] = total[used, a:b] // total[used, dim + p, None]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = table.mapInArrow(_coded(dim, books, pivots), f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels. Labels of many rows are joined apart, so no task gets one whole."""
    totals = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")))
    n = totals.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hot = F.broadcast(totals.filter(F.col("_rows") > n // HOT_SHARE).select(
        F.col("_label").alias("_hot"), F.col("label_error").alias("_hot_error"), F.lit(True).alias("_is_hot")))
    marked = coded.join(hot, F.col("label").eqNullSafe(F.col("_hot")), "left")
    rest = marked.filter("_is_hot IS NULL").drop("_hot", "_hot_error", "_is_hot").join(
        totals.drop("_rows"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return marked.filter("_is_hot").drop("_hot", "_is_hot").withColumnRenamed("_hot_error", "label_error").unionByName(rest)


def encode(vectors: DataFrame) -> DataFrame:
    """One row per finite vector of `vectors` (vec_id, embedding, label): vec_id, label, code, error, label_error, codebooks_sha256.

    Components become floor(4096 * x), and vectors eight consecutive parts (lengths as equal as can be, if eight
    does not divide the dimension). Each position's codebook starts as the parts of the 16 smallest ids (null
    ids last, rows of one id by their components; all rows if there are fewer), and has six rounds of
    assignment and componentwise floored means; unused entries stay. The code has an entry's index in two hex digits per
    part, the error is the sum of the squared distances. Null vectors and those with a null or non-finite
    component are left out; a component beyond 2^27 after scaling raises, since its distances leave a long.
    Vectors of different dimension have codebooks of their own; an empty vector has code 0 and error 0. Null
    labels are equal. Repeated rows are coded each; an empty table gives no rows; other columns are not looked at.
    """
    rows = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    shape = f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long, codebooks_sha256 string"
    return _with_label_error(cut(by_dimension(rows, _fit, lambda: rows.sparkSession.createDataFrame([], shape))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    w = f"(len(v) // {PARTS})"
    out = [f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, p, v[p * {w} + 1:(p + 1) * {w}] AS v FROM kept, range({PARTS}) t(p)),
    firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
    book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN firsts USING (vec_id))"""]
    for k in range(ROUNDS + 1):
        out.append(f"""near{k} AS MATERIALIZED (SELECT x.vec_id, x.p, any_value(x.v) AS v,
            min(CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {ENTRIES} + b.e) AS m
        FROM parts x JOIN book{k} b USING (p) GROUP BY x.vec_id, x.p)""")
        if k < ROUNDS:
            out.append(f"""sums{k} AS (SELECT p, m % {ENTRIES} AS e, i, sum(v[i]) AS s, count(*) AS n FROM near{k}, generate_series(1, len(v)) t(i) GROUP BY ALL),
    new{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{k} GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN new{k} n USING (p, e))""")
    out.append(f"""flat AS (SELECT p, e, i, v[i] AS x FROM book{ROUNDS}, generate_series(1, len(v)) t(i)),
    digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat),
    coded AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
        FROM near{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest""")
    return ",\n    ".join(out[:-1]) + ",\n    " + out[-1]


SQL = _sql()
