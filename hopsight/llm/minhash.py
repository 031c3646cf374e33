"""Near-duplicates of word shingles: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives every element a random rank in one slot after another of its own random
permutation; a slot keeps its least rank. All elements of a piece of documents take a step at once,
and a document stops as soon as its slots are full, which more elements make sooner.

Documents with equal sets are one node. Nodes that share a band's bucket are candidates. A bucket is
not expanded into pairs: in each round every node is verified against one leader of its bucket
unless both are already connected, so a group of copies collapses in a few rounds. What then is
still unconnected within a bucket is compared in full: small buckets by pairs, large ones in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import words as w
from .common import components, cut, measured, read

BANDS, ROWS = 24, 5
PIECE = 4 << 20
#: Rounds against leaders; each tells apart only what a full comparison would, later.
ROUNDS = 4
#: Nodes of a bucket that is compared by pairs, nodes on either side of a block, pairs on one copy of a leader's set.
FEW, BLOCK, SALT = 32, 256, 1000

_U = np.uint64


def signatures(elements: np.ndarray, row: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """SuperMinHash of `docs` sets: (docs, slots), each slot step << 32 | rank. Sets without elements stay at the maximum."""
    full = np.iinfo(_U).max
    out = np.full(docs * slots, full, _U)
    before: list[np.ndarray] = []
    for step in range(slots):
        random = w.mix(elements + _U((2 * step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((random & _U(0xFFFFFFFF)) * _U(slots - step) >> _U(32)).astype(np.int16)
        slot = pick.copy()
        for i in range(step - 1, -1, -1):  # where the permutation's swaps took this slot from
            slot[slot == before[i]] = i
        np.minimum.at(out, row * slots + slot, (random >> _U(32)) | _U(step << 32))
        open_ = (out.reshape(docs, slots) == full).any(axis=1)[row]
        if not open_.any():
            break
        elements, row = elements[open_], row[open_]
        before = [b[open_] for b in before] + [pick[open_]]
    return out.reshape(docs, slots)


def _shingles(piece: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in order, their document's row, and their number by document."""
    words, offsets = w.hashed(*w.texts(piece.column("text")), lower=True)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(n, n) - (np.arange(len(words)) - np.repeat(offsets[:-1], n))
    at = np.flatnonzero(left >= k)
    hashes, row = [w.runs(words, k)[at]], [row[at]]
    for short in range(1, k):
        docs = np.flatnonzero(n == short)
        if len(docs):
            hashes.append(w.runs(words, short)[offsets[docs]])
            row.append(docs)
    hashes, row = np.concatenate(hashes), np.concatenate(row)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new], np.bincount(row[new], minlength=len(n))


def _per_doc(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), _U)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(n) - n)[full])
    return out


def _set_key(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    return w.mix(_per_doc(w.mix(hashes), n) ^ w.mix(_per_doc(w.mix(hashes ^ _U(0x5851F42D4C957F2D)), n) + n.astype(_U)))


def _features(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in w.pieces(batches, "text", PIECE):
            hashes, row, n = _shingles(piece, k)
            slots = signatures(hashes, row, len(n), BANDS * ROWS).reshape(len(n), BANDS, ROWS)
            bands = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(n), BANDS))
            for r in range(ROWS):
                bands = w.mix(bands * _U(0x2545F4914F6CDD1D) + slots[:, :, r])
            kept = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), bands[n > 0].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([piece.column("row_key"), piece.column("doc_id"), pa.array(n, pa.int64()),
                                              pa.array(_set_key(hashes, n).view(np.int64)), lists],
                                             names=["row_key", "doc_id", "n", "sid", "bands"])
    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in w.pieces(batches, "text", PIECE):
            hashes, _, n = _shingles(piece, k)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(_set_key(hashes, n).view(np.int64)), lists], names=["sid", "elements"])
    return run


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, as (u, v). A b of many pairs is dealt to several tasks."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    leaders = (sets.join(salts, F.col("sid") == F.col("b"))
               .select("b", F.col("elements").alias("eb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    both = dealt.join(leaders, ["b", "salt"]).join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("ea")), "a")
    inter = F.size(F.array_intersect("ea", "eb"))
    return (both.select("a", "b", inter.alias("i"), (F.size("ea") + F.size("eb") - inter).alias("u"))
            .filter(F.col("i").cast("long") * 100 >= F.col("u").cast("long") * percent)
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def _blocks(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sid, label = table.column("sid").to_numpy(), table.column("label").to_numpy()
        lists = table.column("elements").combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(at)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        values = values[at[0]:at[-1]]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        vocabulary = np.intersect1d(values[side[owner] == 0], values[side[owner] == 1])
        place = np.searchsorted(vocabulary, values)
        known = place < len(vocabulary)
        known[known] = vocabulary[place[known]] == values[known]
        place, owner = place[known], owner[known]
        index = np.empty(len(side), np.int64)
        index[a], index[b] = np.arange(len(a)), np.arange(len(b))
        inter = np.zeros((len(a), len(b)))
        for lo in range(0, len(vocabulary), 4096):
            now = (place >= lo) & (place < lo + 4096)
            width = min(4096, len(vocabulary) - lo)
            parts = []
            for s, rows in ((0, a), (1, b)):
                m = np.zeros((len(rows), width), np.float32)
                mine = now & (side[owner] == s)
                m[index[owner[mine]], place[mine] - lo] = 1
                parts.append(m)
            inter += parts[0] @ parts[1].T
        union = sizes[a][:, None] + sizes[b][None, :] - inter
        linked = (100 * inter >= percent * union) & (label[a][:, None] != label[b][None, :])
        i, j = np.nonzero(linked)
        _, first = np.unique(np.stack([i, label[b][j]]), axis=1, return_index=True)
        return pa.table({"u": pa.array(sid[a][i[first]], pa.int64()), "v": pa.array(sid[b][j[first]], pa.int64())})
    return run


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of buckets that still hold more than one component, with their label."""
    if labels is None:
        return shared.withColumn("label", F.col("sid"))
    rows = shared.join(labels, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("label"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(open_, "key")


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the same bucket, by full comparison."""
    buckets = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("same"))
    buckets = buckets.groupBy("members", "same").agg(F.min("key").alias("key"))
    main = (rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
            .agg(F.max(F.struct("c", "label")).alias("main")).select("key", F.col("main.label").alias("main"), F.col("main.c").alias("c")))
    rows = cut(rows.join(buckets.select("key", "members"), "key").join(main, "key"))
    few = rows.filter(F.col("members") <= FEW)
    other = few.select("key", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = cut(few.join(other, "key").filter((F.col("sid") < F.col("b")) & (F.col("label") != F.col("lb")))
                .filter(_sizes_allow(F.col("n"), F.col("nb"), percent)).select(F.col("sid").alias("a"), "b").distinct())
    links = _verified(pairs, sets, percent)
    many = rows.filter(F.col("members") > FEW)
    down, across = F.ceil((F.col("members") - F.col("c")) / BLOCK), F.ceil(F.col("members") / BLOCK)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    own = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    left = many.filter("label <> main").select("key", own(down).alias("i"), all_of(across).alias("j"), F.lit(0).alias("side"), "sid", "label")
    right = many.select("key", own(across).alias("j"), all_of(down).alias("i"), F.lit(1).alias("side"), "sid", "label")
    blocks = left.unionByName(right).join(sets, "sid")
    return links.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(_blocks(percent), "u long, v long"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: row_key (hash of id and text), doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of `k` lower-cased words, or all its words as one if they
    are fewer. Documents are linked if 100 * intersection >= percent * union. Null or blank text has an
    empty set and is linked with nothing. Rows may repeat an id: equal rows are linked as any equal sets;
    kept holds for the rows with the component's smallest id, and where no row of a component has an id,
    for the one with the smallest row_key. Empty tables give no rows; other columns are not looked at.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    base = cut(keyed.select("row_key", "doc_id", "text").mapInArrow(_features(k), "row_key long, doc_id long, n long, sid long, bands array<long>"))
    nodes = base.filter("n > 0").select("sid", "n", "bands").dropDuplicates(["sid"])
    rows = nodes.select("sid", "n", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("sid").alias("leader")).filter("members > 1")
    shared = cut(rows.join(buckets, "key").select("key", "sid", "n", "leader"))
    heads = (base.join(shared.select("sid").distinct(), "sid").groupBy("sid").agg(F.min("row_key").alias("row_key")).select("row_key"))
    sets = cut(keyed.select("row_key", "text").join(heads, "row_key", "left_semi").select("text")
               .mapInArrow(_sets(k), "sid long, elements array<long>").dropDuplicates(["sid"]))

    size = shared.select("sid", "n").distinct()
    by_leader = shared.join(size.select(F.col("sid").alias("leader"), F.col("n").alias("nl")), "leader")
    shared = shared.select("key", "sid", "n")
    labels = tested = None
    open_, turn = by_leader.withColumn("label", F.col("sid")).withColumn("ll", F.col("leader")), 0
    while True:
        pairs = (open_.filter((F.col("label") != F.col("ll")) & _sizes_allow(F.col("n"), F.col("nl"), percent))
                 .select(F.greatest("sid", "leader").alias("a"), F.least("sid", "leader").alias("b")).distinct())
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links, new = measured(_verified(pairs, sets, percent))
        if labels is None or new["rows"]:  # else all is as it was
            labels = components(links, labels)
            rows, left = measured(_labelled(shared, labels))
        turn += 1
        if turn >= ROUNDS or not new["rows"] or not left["rows"]:
            break
        order = F.xxhash64("key", "sid", F.lit(turn))
        leader = rows.groupBy("key").agg(F.min_by(F.struct("sid", "n", "label"), order).alias("x"))
        leader = leader.select("key", F.col("x.sid").alias("leader"), F.col("x.n").alias("nl"), F.col("x.label").alias("ll"))
        open_ = rows.join(leader, "key")
    if left["rows"]:
        labels = components(_rest(rows, sets, percent), labels)
    marked = (base.select("row_key", "doc_id", "n", "sid").join(labels, F.col("sid") == F.col("node"), "left")
              .withColumn("label", F.when(F.col("n") > 0, F.coalesce("component", "sid"))))
    linked = marked.filter("n > 0")
    first = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("row_key").alias("least"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row_key") == F.col("least")))
    columns = ("row_key", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return (linked.join(first, "label").select(*columns, kept.alias("kept"))
            .unionByName(marked.filter("n = 0").withColumn("component_id", F.col("doc_id")).select(*columns, F.lit(True).alias("kept"))))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id, text) without near-duplicates: one row of each group, that of the smallest id; columns unchanged, whatever their names.

    Of rows equal in id and text one stays; of rows that share the kept id, the one with the smallest row_key. Null and blank
    texts are in no group and all stay; an empty table gives no rows.
    """
    found = cut(groups(docs, k, percent))
    twice = found.filter("kept AND n_shingles > 0 AND component_id IS NOT NULL").groupBy("component_id").agg(
        F.count("*").alias("c"), F.min("row_key").alias("row_key"), F.max("row_key").alias("other")).filter("c > 1")
    dropped = found.filter("NOT kept").select("row_key")
    repeated = bool(twice.limit(1).count())
    if repeated:
        extra = found.filter("kept").join(twice.select("component_id", F.col("row_key").alias("first")), "component_id").filter("row_key <> first")
        dropped = dropped.unionByName(extra.select("row_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.xxhash64("doc_id", "text").alias("row_key"))
    left = rows.join(dropped.select(F.col("row_key").alias("k")).distinct(), F.col("row_key") == F.col("k"), "left_anti")
    if repeated:
        left = left.dropDuplicates(["row_key"])
    return left.select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
