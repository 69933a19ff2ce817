"""Label voting over a graph that needn't fit in memory: packed neighbour lists in a temporary file, labels in memory."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SWEEPS = 20
#: Edges of a block at most (a node's edges stay together), bytes that are kept in memory instead of a file.
BLOCK_EDGES, IN_MEMORY = 1 << 21, 32 << 20
PLACE = np.int32
BLOCK = "nodes binary, ids binary, counts binary, near binary, weight binary"
#: source places, target places, weights -> which edges count. It must hold for both directions of an edge or for none.
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, whole numbers as differences; equal places of the items' bytes lie together."""
    if values.dtype.kind in "iu":
        values = np.concatenate((values[:1], values[1:] - values[:-1]))
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def opened(held: bytes, count: int, kind: type) -> np.ndarray:
    """What `packed` got."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held, count * width, codec="zstd"), np.uint8).reshape(width, count)
    values = np.ascontiguousarray(planes.T).view(kind).reshape(count)
    return np.cumsum(values, dtype=kind) if np.dtype(kind).kind in "iu" else values


def block(nodes: np.ndarray, ids: np.ndarray, source: np.ndarray, near: np.ndarray, weight: np.ndarray) -> pa.RecordBatch | None:
    """A row of BLOCK: ascending nodes and their ids, edges by source (a place in nodes) and target (PLACE, or ids); None without edges."""
    counts = np.bincount(source, minlength=len(nodes))
    some = counts > 0
    if not some.any():
        return None
    columns = nodes[some].astype(np.int64).tobytes(), ids[some].astype(np.int64).tobytes(), counts[some].astype(np.int64).tobytes(), packed(near), packed(weight.astype(np.float64))
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], [f.split()[0] for f in BLOCK.split(", ")])


class Graph:
    """Neighbour lists of ascending nodes. Nodes are in memory, edges in a temporary file once they are more than IN_MEMORY.

    Targets are places, as nodes are; with `by_id` both are ids, and a node's place is its rank.
    """

    def __init__(self, blocks: Iterator[pa.RecordBatch], by_id: bool = False):
        self.file, self.by_id, held, at = tempfile.SpooledTemporaryFile(IN_MEMORY), by_id, [], 0
        for b in blocks:
            for k in range(b.num_rows):
                nodes, ids, counts = (np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in range(3))
                near, weight = (b.column(c)[k].as_py() for c in (3, 4))
                self.file.write(near)
                self.file.write(weight)
                held.append((nodes, ids, counts, at, len(near), len(weight)))
                at += len(near) + len(weight)
        held.sort(key=lambda x: x[0][0])
        nodes, ids = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in held)]) for c in (0, 1))
        self.ids = ids
        if not by_id:
            self.ids = np.zeros(nodes[-1] + 1 if len(nodes) else 0, np.int64)
            self.ids[nodes] = ids
        ends = np.cumsum([0, *(len(x[0]) for x in held)])
        self.blocks = [(np.arange(i, j) if by_id else x[0], *x[2:]) for x, i, j in zip(held, ends[:-1], ends[1:], strict=True)]

    def edges(self, of: tuple, keep: Keep | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each node's edges begin and end, their targets and weights."""
        nodes, counts, at, near, weight = of
        self.file.seek(at)
        target = opened(self.file.read(near), counts.sum(), np.int64 if self.by_id else PLACE)
        if self.by_id:
            target = np.searchsorted(self.ids, target)
        weights = opened(self.file.read(weight), len(target), np.float64)
        if keep:
            source = np.repeat(np.arange(len(nodes)), counts)
            kept = keep(nodes[source], target, weights)
            counts, target, weights = np.bincount(source[kept], minlength=len(nodes)), target[kept], weights[kept]
        return np.concatenate(([0], np.cumsum(counts))), target, weights


def voted(graph: Graph, keep: Keep | None = None) -> np.ndarray:
    """Each place's label by weighted voting, nodes in ascending order; -1 where no edge counts.

    A node takes the label whose neighbours weigh most; its vote counts at once for those after
    it, ties go to the lowest label. SWEEPS rounds at most, fewer once nothing changes. A node
    is asked again only if a neighbour's label changed, and a block without such nodes isn't read.
    """
    count = len(graph.ids)
    label, asked, alone = np.arange(count), np.zeros(count, bool), np.ones(count, bool)
    for of in graph.blocks:
        asked[of[0]] = True
    called = label  # labels are ranks among those that are left, in the same order; what they are called
    for _ in range(SWEEPS):
        left, label = np.unique(label, return_inverse=True)
        called, tally, moved = called[left], np.zeros(len(left)), False
        for of in graph.blocks:
            if not asked[of[0]].any():
                continue
            ends, target, weight = graph.edges(of, keep)
            for n, i, j in zip(of[0].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if not asked[n]:
                    continue
                asked[n] = False
                if i == j:
                    continue
                alone[n] = False
                near = target[i:j]
                names, best = label[near], -1
                if len(tally) <= j - i:
                    sums = np.round(np.bincount(names, weight[i:j], len(tally)), 12)
                    best = sums.argmax()
                if best < 0 or not sums[best] > 0:  # many labels, or one that no neighbour has might win with 0
                    np.add.at(tally, names, weight[i:j])
                    sums = np.round(tally[names], 12)
                    tally[names] = 0
                    most = sums.max()
                    best = names[sums == most if most == most else np.isnan(sums)].min()  # NaN is above all others
                if best != label[n]:
                    label[n], moved = best, True
                    asked[near] = True
        if not moved:
            break
    return np.where(alone, -1, called[label])


def agreed(graph: Graph, keeps: list[Keep | None], whole: int) -> np.ndarray:
    """`voted` over the edges whose ends most of the labelings put together: one labeling for each of `keeps`, and `whole` that part no edge's ends."""
    labelings = [voted(graph, k) for k in keeps]
    return voted(graph, lambda a, b, _: 2 * (sum((x[a] == x[b]) & (x[a] >= 0) for x in labelings) + whole) > len(labelings) + whole)


def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows a, b, weight, which come ordered by a and b."""

    def cut(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        a = t["a"].to_numpy()
        n = len(a) if last else int(np.searchsorted(a, a[-1]))  # the last node may go on
        nodes, source = np.unique(a[:n], return_inverse=True)
        return block(nodes, nodes, source, t["b"].to_numpy()[:n], t["weight"].to_numpy()[:n]), t.slice(n)

    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK_EDGES:
            made, rest = cut(pa.Table.from_batches(held), False)
            held, rows = rest.to_batches(), rest.num_rows
            if made:
                yield made
    if rows:
        yield cut(pa.Table.from_batches(held), True)[0]
