"""Answers about all paths of a graph without listing them, by dynamic programming in topological order.

For graphs whose reachable part has no cycle, a walk from the start is a path, and every walk to a dead end
is an orphan path, since its last edge lies on no path to a final node. So counts, longest paths, covered
edges, the first path through each edge and the heaviest path follow node by node. Spark deals the graphs: a
row is one distinct graph (or one key), with its few edges as an array; numbers are whole and unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopsight.schema import KEY

_PATH = "struct<path_idx: bigint, path_type: string, labels: array<string>, edge_ords: array<int>, first_for: array<int>>"
ANSWERS = f"topology_id string, acyclic boolean, path_count decimal(38,0), max_path_length int, covered array<int>, deciding array<{_PATH}>"
MOST = 10 ** 38 - 1


@dataclass
class Shape:
    """The part of a graph that walks from its first user node reach; `order` is None if it has a cycle."""

    kinds: list[str]
    links: list[str]
    start: int | None = None
    order: list[int] | None = None
    out: dict[int, list[tuple[int, int]]] = field(default_factory=dict)    # node: (edge, target), by edge
    into: dict[int, list[tuple[int, int]]] = field(default_factory=dict)   # node: (edge, source), by edge
    ends: dict[int, tuple[int, int]] = field(default_factory=dict)         # node: (0 final or 1 dead end, node)

    def __post_init__(self) -> None:
        self.start = next((i for i, k in enumerate(self.kinds) if k == "user"), None)
        if self.start is None:
            self.order = []
            return
        pairs = [tuple(map(int, x.split(">"))) for x in self.links]
        goes_on = {s for s, _ in pairs}
        forward: dict[int, list[tuple[int, int]]] = {}
        for e, (s, t) in enumerate(pairs):
            if s != t and t != self.start:
                forward.setdefault(s, []).append((e, t))
        reached, todo = {self.start}, [self.start]
        while todo:
            for _, t in forward.get(todo.pop(), []):
                if t not in reached:
                    reached.add(t)
                    todo.append(t)
        self.out = {v: forward.get(v, []) for v in reached}
        self.into = {v: [] for v in reached}
        for v, edges in self.out.items():
            for e, t in edges:
                self.into[t].append((e, v))
        for edges in self.into.values():
            edges.sort()
        waits = {v: len(edges) for v, edges in self.into.items()}
        order, ready = [], [self.start]
        while ready:
            v = ready.pop()
            order.append(v)
            for _, t in self.out[v]:
                waits[t] -= 1
                if not waits[t]:
                    ready.append(t)
        self.order = order if len(order) == len(reached) else None
        self.ends = {v: (0 if self.kinds[v] == "final" else 1, v) for v in reached
                     if v != self.start and (self.kinds[v] == "final" or v not in goes_on)}

    def counts(self) -> dict[int, int]:
        """Walks from the start to each node."""
        n = {self.start: 1}
        for v in self.order[1:]:
            n[v] = sum(n[s] for _, s in self.into[v])
        return n

    def longest(self) -> int:
        far = {self.start: 0}
        for v in self.order[1:]:
            far[v] = 1 + max(far[s] for _, s in self.into[v])
        return max((far[v] for v in self.ends), default=0)

    def first_end(self) -> dict[int, tuple[int, int]]:
        """The first end that walks from each node reach; nodes that reach none are missing."""
        best = dict(self.ends)
        for v in reversed(self.order):
            for _, t in self.out[v]:
                if t in best and (v not in best or best[t] < best[v]):
                    best[v] = best[t]
        return best

    def heaviest(self, weights: list[int]) -> list[int] | None:
        """The edges of the path of the largest weight, the first of those in path order."""
        best = {self.start: (0, [])}
        for v in self.order[1:]:
            best[v] = min((best[s][0] - weights[e], [*best[s][1], e]) for e, s in self.into[v])
        return min(((best[v][0], end, best[v][1]) for v, end in self.ends.items()), default=(0, 0, None))[2]

    def deciding(self) -> list[dict]:
        """The first path through each edge, with its place among all paths and the edges it is first for."""
        first, walks = self.first_end(), self.counts()
        prefix = {self.start: []}
        for v in self.order[1:]:
            prefix[v] = min([*prefix[s], e] for e, s in self.into[v])
        before, below = {}, 0
        for end in sorted(self.ends.values()):
            before[end], below = below, below + walks[end[1]]
        to_end: dict[tuple[int, int], dict[int, int]] = {}
        for end in set(first.values()):
            n = {v: 0 for v in self.order}
            for v in reversed(self.order):
                n[v] = 1 if v == end[1] else sum(n[t] for _, t in self.out[v])
            to_end[end] = n
        found: dict[tuple, dict] = {}
        for u in self.order:
            for e, v in self.out[u]:
                if v not in first:
                    continue
                end, edges, at = first[v], [*prefix[u], e], v
                n = to_end[end]
                while at != end[1]:
                    e_next, at = next((x, t) for x, t in self.out[at] if n[t])
                    edges.append(e_next)
                path = found.get(tuple(edges))
                if path is None:
                    place, at, labels = before[end], self.start, [self.start]
                    for step in edges:
                        place += sum(n[t] for x, t in self.out[at] if x < step)
                        at = next(t for x, t in self.out[at] if x == step)
                        labels.append(at)
                    path = found[tuple(edges)] = {
                        "path_idx": place, "path_type": "orphan_branch" if end[0] else "final",
                        "labels": [str(x) for x in labels], "edge_ords": edges, "first_for": []}
                path["first_for"].append(e)
        return list(found.values())


def answers(shapes: DataFrame, more_paths_than: int) -> DataFrame:
    """ANSWERS of each distinct graph (topology_id, kinds, links). Graphs with a cycle have no counts; `deciding` is filled for graphs with more paths than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal, getcontext
        getcontext().prec = 40
        kinds = pa.schema([("topology_id", pa.string()), ("acyclic", pa.bool_()), ("path_count", pa.decimal128(38, 0)), ("max_path_length", pa.int32()),
                           ("covered", pa.list_(pa.int32())), ("deciding", pa.list_(pa.struct([
                               ("path_idx", pa.int64()), ("path_type", pa.string()), ("labels", pa.list_(pa.string())),
                               ("edge_ords", pa.list_(pa.int32())), ("first_for", pa.list_(pa.int32()))])))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shape = Shape(row["kinds"], row["links"])
                answer = {"topology_id": row["topology_id"], "acyclic": shape.order is not None, "covered": [], "deciding": []}
                if shape.order:
                    walks, first = shape.counts(), shape.first_end()
                    n = sum(walks[v] for v in shape.ends)
                    answer |= {"path_count": Decimal(min(n, MOST)), "max_path_length": shape.longest(),
                               "covered": sorted(e for v in shape.order for e, t in shape.out[v] if t in first)}
                    if more_paths_than < n < 1 << 63:
                        answer["deciding"] = shape.deciding()
                elif shape.order is not None:
                    answer |= {"path_count": Decimal(0), "max_path_length": 0}
                out.append(answer)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
    return shapes.select("topology_id", "kinds", "links").mapInArrow(run, ANSWERS)


def busiest(keys: DataFrame) -> DataFrame:
    """(key, labels) of the heaviest path of keys (kinds, links, extra) without a cycle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for row in batch.to_pylist():
                shape = Shape(row["kinds"], row["links"])
                edges, at = shape.heaviest(row["extra"]) if shape.order else None, shape.start
                path = None if edges is None else [str(at)]
                for step in edges or []:
                    at = next(t for x, t in shape.out[at] if x == step)
                    path.append(str(at))
                labels.append(path)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.array(labels, pa.list_(pa.string()))], names=[*KEY, "labels"])
    fields = ", ".join(f"{c} {dict(keys.dtypes)[c]}" for c in KEY)
    return keys.select(*KEY, "kinds", "links", "extra").mapInArrow(run, f"{fields}, labels array<string>").filter(F.col("labels").isNotNull())
