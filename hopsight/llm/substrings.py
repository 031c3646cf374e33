"""Substring dedup by fixed-block anchors.

Every window of `window` words holds a whole block of `window // 2` words that starts at a multiple
of that length, wherever the window starts. So the blocks of all documents are the index, every
rolling run of a block's length is a probe, and a window that repeats has a probe that hits another
document's (or another place's) indexed block. Round one finds the hits; round two extends them:
the windows around hits are compared as a whole and all but the earliest of equal ones are marked;
marked windows that overlap join to maximal repeats.

Both rounds send, for each piece of some MB of text and each bucket of hashes, one row of packed
entries. Runs that repeat within a piece are settled there and send one entry, so a run that a third
of all documents share is as many entries as there are pieces. Rows go back to their piece by its
key. Pieces are the same in every attempt, as rows are dealt and sorted by a hash of id and text first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as w
from .common import read

#: Bytes of text in a piece, and in the documents behind one bucket. Raise both together at a size where
#: buckets outnumber the entries of a piece.
PIECE, BUCKET = 8 << 20, 4 << 20

_LAST = np.int64(2**63 - 1)
_ROWS = "bucket int, piece long, kind int, body binary"
_MARKS = "row_key long, n int, marks binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes: slowly growing values become runs of equal bytes."""
    parts = [np.array([len(arrays[0])], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return b"".join(parts)


def _unpack(body: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for t in types:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * width
    return out


def _gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as int64; null counts as the largest."""
    return column.cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    for i, piece in enumerate(w.pieces(batches, "text", size)):
        yield (part << 32) + i, piece


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a piece: its document's row, its place there, the words left from there on."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return row, place, np.repeat(n, n) - place


def _rows(key: int, buckets: int, row_keys: np.ndarray, offsets: np.ndarray, settled: np.ndarray, hashes: np.ndarray,
          entry: Callable[[np.ndarray], list[np.ndarray]]) -> pa.RecordBatch:
    """One row per bucket with its entries of `hashes`; one with the piece's documents, one with the places settled here."""
    bucket = (w.mix(hashes) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    bodies = [_pack(*entry(by[cuts[b]:cuts[b + 1]])) for b in full]
    home = _pack(row_keys, np.diff(offsets))
    return pa.RecordBatch.from_arrays([
        pa.array([*full, key % buckets, key % buckets], pa.int32()), pa.array([key] * (len(full) + 2), pa.int64()),
        pa.array([0] * len(full) + [1, 2], pa.int32()), pa.array([*bodies, home, _pack(_gaps(settled))], pa.binary())],
        names=["bucket", "piece", "kind", "body"])


def _probe(buckets: int, window: int, size: int) -> Callable:
    """Round one, sending: the first 4 bytes of each run's hash, its word index, whether some copy in the piece is indexed."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, piece in _pieces(batches, size):
            words, offsets = w.hashed(*w.texts(piece.column("text")))
            _, place, left = _places(offsets)
            whole = np.repeat(np.diff(offsets), np.diff(offsets)) >= window
            at = np.flatnonzero((left >= block) & whole)
            if not len(at):
                continue
            hashes = w.runs(words, block)[at]
            order = np.argsort(hashes, kind="stable")
            new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
            start = np.flatnonzero(new)
            count = np.diff(start, append=len(order))
            indexed = np.maximum.reduceat((place[at][order] % block == 0).astype(np.uint8), start)
            settled = np.sort(at[order[np.repeat(count > 1, count)]])
            one = order[start]
            back = np.argsort(one)
            one, indexed = one[back], indexed[back]
            h, idx = hashes[one], at[one]

            def entry(rows, h=h, idx=idx, indexed=indexed):
                return [(h[rows] >> np.uint64(32)).astype(np.uint32), _gaps(idx[rows].astype(np.uint32)), indexed[rows]]
            yield _rows(key, buckets, piece.column("row_key").to_numpy(), offsets, settled, h, entry)
    return run


def _hits(table: pa.Table) -> pa.Table:
    """Round one, in a bucket: entries whose hash another piece has too, if one of the equal ones is indexed."""
    def find(bodies):
        parts = [_unpack(b, np.uint32, np.uint32, np.uint8) for b in bodies]
        h, indexed = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        idx = np.concatenate([np.cumsum(p[1], dtype=np.uint32) for p in parts])
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        count = np.diff(start, append=len(order))
        hit = (count > 1) & (np.maximum.reduceat(indexed[order], start) > 0)
        return idx, order[np.repeat(hit, count)]
    return _answer(table, find)


def _candidates(buckets: int, window: int, size: int) -> Callable:
    """Round two, sending: hash, word index and document of the windows around hits; copies in the piece but the earliest are settled."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, piece in _pieces(batches, size):
            words, offsets = w.hashed(*w.texts(piece.column("text")))
            _, place, left = _places(offsets)
            near = np.zeros(len(words) + 1, np.int32)
            for begin, marks in zip(offsets[:-1], piece.column("marks").to_pylist(), strict=True):
                hits = begin + np.cumsum(_unpack(marks, np.int64)[0])
                np.add.at(near, np.maximum(hits - (window - block), begin), 1)
                np.add.at(near, hits + 1, -1)
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= window))
            if not len(at):
                continue
            hashes, ids = w.runs(words, window)[at], _ids(piece.column("doc_id"))
            doc, pos = np.repeat(ids, np.diff(offsets))[at], place[at]
            order = np.lexsort((pos, doc, hashes))
            start = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0)
            count = np.diff(start, append=len(order))
            least = np.repeat(order[start], count)
            later = (doc[order] != doc[least]) | (pos[order] != pos[least])
            settled, one = np.sort(at[order[later]]), np.sort(order[~later])
            h, idx, doc, pos = hashes[one], at[one], doc[one], pos[one].astype(np.uint32)

            def entry(rows, h=h, idx=idx, doc=doc, pos=pos):
                return [h[rows], _gaps(idx[rows].astype(np.uint32)), _gaps(doc[rows]), pos[rows]]
            yield _rows(key, buckets, piece.column("row_key").to_numpy(), offsets, settled, h, entry)
    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Round two, in a bucket: entries that are not the earliest of their hash."""
    def find(bodies):
        parts = [_unpack(b, np.uint64, np.uint32, np.int64, np.uint32) for b in bodies]
        h, pos = np.concatenate([p[0] for p in parts]), np.concatenate([p[3] for p in parts])
        idx = np.concatenate([np.cumsum(p[1], dtype=np.uint32) for p in parts])
        doc = np.concatenate([np.cumsum(p[2]) for p in parts])
        order = np.lexsort((pos, doc, h))
        start = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        least = np.repeat(order[start], np.diff(start, append=len(order)))
        return idx, order[(doc[order] != doc[least]) | (pos[order] != pos[least])]
    return _answer(table, find)


def _answer(table: pa.Table, find: Callable) -> pa.Table:
    """What a bucket sends back: for each piece the word indexes found; what stays at home goes through."""
    kinds, bodies = table.column("kind").to_numpy(), table.column("body").to_pylist()
    keys = table.column("piece").to_numpy()
    sent = np.flatnonzero(kinds == 0)
    sent = sent[np.argsort(keys[sent], kind="stable")]
    home = np.flatnonzero(kinds != 0)
    out = [(int(keys[i]), int(kinds[i]), bodies[i]) for i in home]
    if len(sent):
        lists = [bodies[i] for i in sent]
        sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in lists]
        idx, found = find(lists)
        owner = np.repeat(np.arange(len(lists)), sizes)
        found = np.sort(found)
        cuts = np.searchsorted(owner[found], np.arange(len(lists) + 1))
        out += [(int(keys[i]), 0, _pack(_gaps(idx[found[a:b]].astype(np.int64))))
                for i, a, b in zip(sent, cuts[:-1], cuts[1:], strict=True) if b > a]
    return pa.table({"piece": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()),
                     "body": pa.array([x[2] for x in out], pa.binary())})


def _at_home(table: pa.Table) -> pa.Table:
    """Of one piece: its documents with the places found in each, packed."""
    kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
    row_keys, n = _unpack(bodies[kinds.index(1)], np.int64, np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    found = np.sort(np.concatenate([np.cumsum(_unpack(b, np.int64)[0]) for k, b in zip(kinds, bodies, strict=True) if k != 1]))
    cuts = np.searchsorted(found, offsets)
    rows = np.flatnonzero(np.diff(cuts))
    marks = [_pack(_gaps(found[cuts[r]:cuts[r + 1]] - offsets[r])) for r in rows]
    return pa.table({"row_key": pa.array(row_keys[rows], pa.int64()), "n": pa.array(np.diff(cuts)[rows], pa.int32()),
                     "marks": pa.array(marks, pa.binary())})


def _settle(window: int) -> Callable:
    """Remove the words that marked windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in w.pieces(batches, "text", PIECE):
            out = []
            for text, marks in zip(piece.column("text").to_pylist(), piece.column("marks").to_pylist(), strict=True):
                words = (text or "").encode().split()
                starts = ends = np.empty(0, np.int32)
                if marks:
                    at = np.cumsum(_unpack(marks, np.int64)[0])
                    open_ = np.diff(at, prepend=-window - 1) > window
                    starts, ends = at[open_].astype(np.int32), (at[np.append(open_[1:], True)] + window).astype(np.int32)
                kept, last = [], 0
                for a, b in zip(starts, ends, strict=True):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), starts, ends))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "n_removed", "text", "starts", "ends"])
    return run


def dedup(docs: DataFrame, window: int = 20, piece: int = PIECE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, text (kept words joined by one space), and the
    word spans [starts[i], ends[i]) removed, each a maximal run of repeats.

    A word is removed if a window of `window` words that covers it also starts earlier, in a document
    with a smaller id or before in the same one, judged on the whole input. Null text has no words; a
    null doc_id ranks last; rows of equal doc_id are versions of one document, none earlier than the
    other at the same place. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the joins below take, so that they reuse the exchange
    buckets = max(parts, size // BUCKET + 1)
    dealt = (docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
             .repartition(parts, "row_key").sortWithinPartitions("row_key"))

    def exchange(rows: DataFrame, find: Callable) -> DataFrame:
        """Marked places by row; of rows that repeat, one has them all."""
        found = rows.groupBy("bucket").applyInArrow(find, "piece long, kind int, body binary")
        home = found.groupBy("piece").applyInArrow(_at_home, _MARKS)
        return home.groupBy("row_key").agg(F.max_by("marks", "n").alias("marks"))

    hits = exchange(dealt.mapInArrow(_probe(buckets, window, piece), _ROWS), _hits)
    marks = exchange(dealt.join(hits, "row_key").mapInArrow(_candidates(buckets, window, piece), _ROWS), _repeats)
    return dealt.join(marks, "row_key", "left").mapInArrow(
        _settle(window), "doc_id long, n_words long, n_removed long, text string, starts array<int>, ends array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
