"""Exact n-gram Jaccard join with signature trees, as components of the similarity graph or as links.

Documents are sets of word shingles; two link when their Jaccard similarity is at least 3/4.

1. Documents with equal sets are one; the rest of the work is done on one of each.
2. In any fixed order of shingles, a linked pair shares more than a quarter of the larger set
   among the first half of both. Documents that share too few of these, in the order of the
   hashes, with any others are out (`sharing`).
3. Of the others, every shingle's frequency among them is counted. A linked document has at
   most a quarter of shingles that no other has; the rest of them go. In the order of
   frequency, rare ones first, a linked pair shares one of the first quarter (and one) of both
   sets: documents that do, and so on, are a group, and no link crosses groups. Common passages
   come last in that order, so they don't tie groups together. Groups come from one edge per
   document and shingle, not from pairs.
4. The sets of a group meet in one task and are joined by a signature tree. Its leaves hold
   bitmaps of the sets, its nodes OR-combined bitmaps and size ranges; two nodes are followed
   down together unless their sizes or the largest overlap that their bitmaps allow rule out
   a link, or all they hold is connected already. Sets are taken in bands of size, each with
   the next, and bitmaps are as wide as their band's sets ask for.
5. A group too large for a task is cut by a min-hash, so that near copies mostly lie together.
   Each cut is joined for itself, then one document of each component of each cut by another
   min-hash; last, what isn't in the group's largest component is joined with those cuts, and
   those of their documents, that share a rare shingle with it. A pair that wasn't compared is
   then in one component, or can't link.
6. Components of all links found.

`links_of` leaves out what rests on connection: it returns every link between different sets.

Defined results: null, empty and blank texts have an empty set and link with nothing; null
ids are one node with a null id, larger than all others; rows that repeat an id are one node
of the graph and each get a row; an empty table gives an empty result; further columns are
ignored by `components_of` and returned untouched by `representatives`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, materialise, mix, shingle_sets, table
from .components import components
from .sharing import binaries, buckets_for, dealt, grouped, keyed, reduced, shared, starts_of, values_of

WIDTH = 5
#: Two sets link when OVER * intersection >= UNDER * union.
OVER, UNDER = 4, 3
#: Of n shingles, those after the first quarter that count in the order's beginning: n // MORE.
MORE = 4
BLOCK_BYTES = 32 << 20
HASH_BYTES = 16 << 20
#: Bytes of sets whose shingles are counted together before they travel.
SET_BATCH = 2 << 20
LEAF, FAN = 16, 8


def links(a: int, b: int, overlap: int) -> bool:
    return OVER * overlap >= UNDER * (a + b - overlap)


def needed(total: np.ndarray) -> np.ndarray:
    """Least overlap of a linked pair whose sizes sum to `total`."""
    return -(-UNDER * total // (OVER + UNDER))


# -- signature trees ------------------------------------------------------------


def bitmap(found: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Bitmap of a set, and how many of its members fell on a bit already set."""
    at = np.unique(found % np.uint64(bits)).astype(np.int64)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out, len(found) - len(at)


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def bands(size: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, end of the next) of each band of the ascending sizes; linked sizes lie in one band or in neighbours."""
    edges, top = [1], int(size[-1]) if len(size) else 0
    while edges[-1] <= top:
        edges.append(OVER * edges[-1] // UNDER + 1)
    at = [*np.searchsorted(size, edges).tolist(), len(size)]
    return [(at[k], at[k + 1], at[k + 2]) for k in range(len(edges) - 1) if at[k + 1] > at[k]]


class SignatureTree:
    """Joins the sets of one block; `found` gets the links that connected something, or with `every` all links.

    known: sets with equal numbers are connected from the start.
    """

    def __init__(self, sets: list[np.ndarray], known: np.ndarray | None = None, every: bool = False) -> None:
        self.order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (len(sets[i]), int(sets[i][0]), i))
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.every = every
        self.union = Union(len(self.sets))
        self.found: list[tuple[int, int]] = []
        if known is not None:
            first: dict[int, int] = {}
            for k, i in enumerate(self.order):
                self.union.join(first.setdefault(int(known[i]), k), k)

    def join(self) -> list[tuple[int, int]]:
        for begin, middle, end in bands(self.size):
            self._grow(begin, middle, end)
            self._pair(len(self.levels) - 1, 0, 0)
        return self.found

    def _grow(self, begin: int, middle: int, end: int) -> None:
        """The tree of sets begin to end, of which one of a pair must lie before `middle`."""
        self.middle, bits = middle, 256
        while bits < 2 * int(self.size[end - 1]) and bits < 1 << 16:
            bits *= 2
        maps = [bitmap(s, bits) for s in self.sets[begin:end]]
        self.first, self.bits = begin, np.stack([m for m, _ in maps])
        self.excess = np.array([e for _, e in maps], np.int64)
        # Levels of first set, set after the last, OR of bitmaps, sizes from and to, most excess.
        self.levels = [self._level(np.arange(begin, end, LEAF), end)]
        while len(self.levels[-1]["begin"]) > 1:
            self.levels.append(self._level(self.levels[-1]["begin"][::FAN], end))

    def _level(self, begin: np.ndarray, end: int) -> dict:
        own, size = begin - self.first, self.size[self.first : end]
        return {
            "begin": begin, "end": np.append(begin[1:], end), "or": np.bitwise_or.reduceat(self.bits, own, 0),
            "least": np.minimum.reduceat(size, own), "most": np.maximum.reduceat(size, own), "excess": np.maximum.reduceat(self.excess, own),
        }

    def _possible(self, level: dict, x: range, y: range) -> np.ndarray:
        """Whether sizes and bitmaps of each node of x and each of y allow a link."""
        a, b = slice(x.start, x.stop), slice(y.start, y.stop)
        least, most = level["least"], level["most"]
        common = np.bitwise_count(level["or"][a][:, None, :] & level["or"][b][None, :, :]).sum(2).astype(np.int64)
        common += np.minimum(level["excess"][a][:, None], level["excess"][b][None, :])
        fit = common >= needed(least[a][:, None] + least[b][None, :])
        fit &= (OVER * most[a][:, None] >= UNDER * least[b][None, :]) & (OVER * most[b][None, :] >= UNDER * least[a][:, None])
        return fit & ((level["begin"][a] < self.middle)[:, None] | (level["begin"][b] < self.middle)[None, :])

    def _one(self, level: dict, x: int, y: int) -> bool:
        """Whether all documents of both nodes are connected already."""
        root = self.union.root(int(level["begin"][x]))
        return all(self.union.root(i) == root for z in (x, y) for i in range(int(level["begin"][z]), int(level["end"][z])))

    def _pair(self, depth: int, x: int, y: int) -> None:
        level = self.levels[depth]
        if not self.every and self._one(level, x, y):
            return
        if depth == 0:
            self._documents(level, x, y)
            return
        n = len(self.levels[depth - 1]["begin"])
        left, right = (range(z * FAN, min(n, (z + 1) * FAN)) for z in (x, y))
        fit = self._possible(self.levels[depth - 1], left, right)
        pairs = [(left[i], right[j]) for i, j in np.argwhere(fit).tolist()]
        # Nodes with themselves first: what they connect needs no second look.
        for i, j in sorted((p for p in pairs if x != y or p[0] <= p[1]), key=lambda p: p[0] != p[1]):
            self._pair(depth - 1, i, j)

    def _documents(self, level: dict, x: int, y: int) -> None:
        a, b = (np.arange(level["begin"][z], level["end"][z]) for z in (x, y))
        own, other = a - self.first, b - self.first
        common = np.bitwise_count(self.bits[own][:, None, :] & self.bits[other][None, :, :]).sum(2).astype(np.int64)
        common += np.minimum(self.excess[own][:, None], self.excess[other][None, :])
        sa, sb = self.size[a][:, None], self.size[b][None, :]
        fit = (common >= needed(sa + sb)) & (OVER * np.minimum(sa, sb) >= UNDER * np.maximum(sa, sb)) & (a[:, None] < b[None, :])
        fit &= (a < self.middle)[:, None]
        for i, j in np.argwhere(fit).tolist():
            i, j = int(a[i]), int(b[j])
            if (self.every or self.union.root(i) != self.union.root(j)) and self._linked(i, j):
                self.union.join(i, j)
                self.found.append((self.order[i], self.order[j]))

    def _linked(self, i: int, j: int) -> bool:
        return links(len(self.sets[i]), len(self.sets[j]), overlap(self.sets[i], self.sets[j]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


# -- steps ----------------------------------------------------------------------


def sizes_of(rows: DataFrame) -> DataFrame:
    """doc_id, rid, size and two sums of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, one, two = (np.zeros(b.num_rows, k) for k in (np.int64, np.uint64, np.uint64))
            for i, found in shingle_sets(b["text"], WIDTH):
                size[i] = len(found)
                one[i], two[i] = mix(found + np.uint64(1)).sum(dtype=np.uint64), mix(found * np.uint64(3) + np.uint64(7)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rid"], pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "rid", "n", "one", "two"])

    return rows.mapInArrow(run, "doc_id long, rid long, n long, one long, two long")


def beginning(n: np.ndarray | int) -> np.ndarray | int:
    """Of n shingles in any order, how many a linked set must share one of: the first quarter and one."""
    return n - -(-UNDER * n // OVER) + 1


def full_sets(found: DataFrame) -> DataFrame:
    """batch, doc_id, set of rows doc_id, text; a batch holds some SET_BATCH bytes of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), int.from_bytes(os.urandom(8), "little", signed=True))), pa.array([i for i, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["batch", "doc_id", "set"])

        out, held = [], 0
        for b in batches:
            ids = b["doc_id"].to_pylist()
            for i, s in shingle_sets(b["text"], WIDTH):
                if len(s):
                    out.append((ids[i], s.tobytes()))
                    held += s.nbytes
                if held >= SET_BATCH:
                    yield done()
                    out, held = [], 0
        if out:
            yield done()

    return found.select("doc_id", "text").mapInArrow(run, "batch long, doc_id long, set binary")


def ranks(sets: DataFrame, buckets: int) -> DataFrame:
    """batch, part, hashes, ranks: of each batch's hashes, those that are seen again, and how often on a log scale.

    A batch counts its own sets first, so a hash of a third of all sets travels once a batch.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = b["batch"].to_numpy()
            edge = np.append(starts_of(batch), b.num_rows)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                keys, count = np.unique(reduced(values_of(b["set"].slice(i, j - i), "<u8")[0], buckets), return_counts=True)
                cut = starts_of(keys >> np.uint64(32))
                part, cuts = (keys[cut] >> np.uint64(32)).astype(np.int32), np.append(cut, len(keys))
                count = np.minimum(count, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(cut), batch[i])), binaries((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts), binaries(count, cuts)], ["part", "batch", "hashes", "ranks"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        values, size = values_of(rows["hashes"], "<u4")
        counts, _ = values_of(rows["ranks"], "u1")
        order = np.argsort(values, kind="stable")
        begin = starts_of(values[order])
        total = np.add.reduceat(counts[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        often = np.empty(len(values), np.int64)
        often[order] = np.repeat(total, np.diff(np.append(begin, len(values))))
        keep = often >= 2
        rank = np.minimum(255, 8 * np.log2(often[keep])).astype(np.uint8)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size)))))
        return pa.Table.from_arrays([rows["batch"], rows["part"], binaries(values[keep], cuts), binaries(rank, cuts)], ["batch", "part", "hashes", "ranks"])

    counted = sets.select("batch", "set").mapInArrow(emit, "part int, batch long, hashes binary, ranks binary")
    return dealt(counted, buckets).groupBy("part").applyInArrow(meet, "batch long, part int, hashes binary, ranks binary")


def likely(sets: DataFrame, buckets: int) -> DataFrame:
    """doc_id, set, hashes, low, next: sets with enough shingles that others have.

    hashes: reduced hashes of the rarest quarter; low, next: two min-hashes.
    """

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        values, size = values_of(rows["set"], "<u8")
        known, each = values_of(told["hashes"], "<u4")
        known = known.astype(np.uint64) | np.repeat(told["part"].to_numpy().astype(np.uint64), each) << np.uint64(32)
        rank, _ = values_of(told["ranks"], "u1")
        order = np.argsort(known)
        known, rank = known[order], rank[order].astype(np.int64)
        keys, own = reduced(values, buckets), np.zeros(len(values), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            own = np.where(known[place] == keys, rank[place], 0)
        row, at = np.repeat(np.arange(len(size)), size), np.concatenate(([0], np.cumsum(size)))
        alone = np.bincount(row[own == 0], minlength=len(size))
        # A set's values ascend, so a stable sort by rank breaks ties by value.
        order = np.argsort(row * 256 + own, kind="stable")
        first = np.arange(len(values)) - np.repeat(at[:-1], size) < np.repeat(beginning(size), size)
        first &= (own[order] > 0) & np.repeat(alone <= size - -(-UNDER * size // OVER), size)
        chosen, who = keys[order][first], row[first]
        rows_in = np.unique(who)
        cuts = np.append(starts_of(who), len(who))
        low = [np.minimum.reduceat(mix(values ^ np.uint64(x)), at[:-1]).view(np.int64)[rows_in] for x in (0x5DEECE66D, 0xB5026F5AA96619E9)] if len(size) else [np.zeros(0, np.int64)] * 2
        taken = rows.take(pa.array(rows_in))
        return pa.Table.from_arrays([taken["doc_id"], taken["set"], binaries(chosen, cuts), pa.array(low[0]), pa.array(low[1])], ["doc_id", "set", "hashes", "low", "next"])

    return sets.groupBy("batch").cogroup(ranks(sets, buckets).groupBy("batch")).applyInArrow(run, "doc_id long, set binary, hashes binary, low long, next long")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(sets: DataFrame, parts: int) -> DataFrame:
    """a, b: for each of the `hashes`, edges that tie the documents which have it to the smallest one.

    Inside a batch first: only a hash's smallest document goes on to meet those of other batches.
    """

    def edges(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, keys))
        ids, keys = ids[order], keys[order]
        begin = starts_of(keys)
        least = np.repeat(ids[begin], np.diff(np.append(begin, len(keys))))
        return ids[begin], keys[begin], np.unique(np.stack((ids, least), 1)[ids != least], axis=0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size = values_of(b["hashes"], "<u8")
            ids, keys, pairs = edges(np.repeat(b["doc_id"].to_numpy(), size), keys)
            part = (keys >> np.uint64(32)).astype(np.int64) % parts
            order = np.lexsort((ids, part))
            ids, keys, part = ids[order], keys[order], part[order]
            cut = starts_of(part, ids)
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(ids[cut]), pa.nulls(len(cut), pa.int64()), binaries(keys, np.append(cut, len(keys)))], ["part", "doc_id", "least", "hashes"])
            yield pa.RecordBatch.from_arrays([pa.array((parts + pairs[:, 0] % parts).astype(np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.binary())], ["part", "doc_id", "least", "hashes"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= parts:
            return rows.select(["doc_id", "least"]).rename_columns(["a", "b"])
        keys, size = values_of(rows["hashes"], "<u8")
        _, _, pairs = edges(np.repeat(rows["doc_id"].to_numpy(), size), keys)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=LINKS)

    spread_out = sets.select("doc_id", "hashes").mapInArrow(spread, "part int, doc_id long, least long, hashes binary")
    return dealt(spread_out, 2 * parts).groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def join_blocks(members: DataFrame, sets: DataFrame, parts: int, every: bool = False) -> DataFrame:
    """Links inside blocks. members: part (0 to parts), block (long), doc_id, component; a part holds whole blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, block, component = (rows[c].to_numpy() for c in ("doc_id", "block", "component"))
        values, size = values_of(rows["set"], "<u8")
        at = np.concatenate(([0], np.cumsum(size)))
        order = np.lexsort((ids, block))
        begin = starts_of(block[order])
        out: list[tuple[int, int]] = []
        for i, j in zip(begin.tolist(), np.append(begin[1:], len(order)).tolist(), strict=True):
            own = order[i:j]
            out += [(int(ids[own[a]]), int(ids[own[b]])) for a, b in SignatureTree([values[at[x] : at[x + 1]] for x in own], component[own], every).join()]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=LINKS)

    sent = members.select("part", "block", "doc_id", "component").join(sets.select("doc_id", "set"), "doc_id")
    return dealt(sent, parts).groupBy("part").applyInArrow(run, "a long, b long")


def postings(rows: DataFrame) -> DataFrame:
    """group, hash, doc_id, cut, share: a row for each of the `hashes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size = values_of(b["hashes"], "<u8")
            row = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([b["group"].take(row), pa.array(keys.view(np.int64)), *(b[c].take(row) for c in ("doc_id", "cut", "share"))], ["group", "hash", "doc_id", "cut", "share"])

    return rows.select("group", "doc_id", "cut", "share", "hashes").mapInArrow(run, "group long, hash long, doc_id long, cut long, share long")


def group_links(groups: DataFrame, sets: DataFrame, every: bool = False) -> DataFrame:
    """Links that connect each group's components; with `every`, all links. groups: doc_id, group."""
    weights = groups.join(sets.select("doc_id", "low", "next", F.octet_length("set").alias("bytes")), "doc_id")
    info = weights.groupBy("group").agg(F.sum("bytes").alias("bytes"))
    info = materialise(info.select("group", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("cuts"), "bytes"), "join-groups")
    total, most = info.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.max("cuts")).first()
    parts = int(max(16, 2 * total // BLOCK_BYTES))

    def blocks(rows: DataFrame, seed: int, *key: str) -> DataFrame:
        """Rows with the block that `key` names, and the part that the block is in."""
        block = F.xxhash64(F.lit(seed), *key)
        return rows.withColumn("block", block).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))

    placed = weights.drop("bytes").join(info.select("group", "cuts"), "group").withColumn("cut", F.pmod("low", "cuts")).withColumn("component", F.col("doc_id"))
    first = placed.where("cuts = 1") if every else placed
    links = materialise(join_blocks(blocks(first, 1, "group", "cut"), sets, parts, every), "join-links")
    if (most or 1) <= 1:
        return links
    large = materialise(placed.where("cuts > 1").drop("component"), "join-large")
    if every:
        asking = large.withColumn("component", F.col("doc_id")).withColumn("share", F.col("cut"))
        return links.unionAll(materialise(join_blocks(blocks(tiles(asking, asking, sets), 3, "group", "cut", "share"), sets, parts, True).distinct(), "join-links"))

    def labelled(links: DataFrame) -> DataFrame:
        return large.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    # One document of each component of each cut, cut anew by the other min-hash if they are still many.
    one = labelled(links).where("doc_id = component").withColumn("cut", F.pmod("next", "cuts"))
    links = materialise(links.unionAll(join_blocks(blocks(one, 2, "group", "cut"), sets, parts)), "join-links")
    now = materialise(labelled(links), "join-labels")
    largest = now.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    asking = now.join(largest, "group").where("component <> largest")
    asks = asking.join(sets.select("doc_id", F.octet_length("set").alias("bytes")), "doc_id").groupBy("group").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("shares"))
    asking = materialise(asking.join(materialise(asks, "join-asks"), "group").withColumn("share", F.pmod("low", "shares")), "join-asking")
    return materialise(links.unionAll(join_blocks(blocks(tiles(asking, now, sets), 3, "group", "cut", "share"), sets, parts)), "join-links")


def tiles(asking: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """group, cut, share, doc_id, component: an asking document meets the cuts, and of them the documents, that have one of its rare hashes.

    asking: group, doc_id, cut, share; homes: group, doc_id, cut.
    """
    hashes = sets.select("doc_id", "hashes")
    asked = materialise(postings(asking.join(hashes, "doc_id")), "join-asked")
    held = materialise(postings(homes.withColumn("share", F.lit(None).cast("long")).join(hashes, "doc_id")), "join-held").drop("share")
    go = asked.drop("cut").join(held.select("group", "hash", "cut").distinct(), ["group", "hash"]).select("group", "cut", "share", "doc_id").distinct()
    stay = held.join(asked.select("group", "hash", "share").distinct(), ["group", "hash"]).select("group", "cut", "share", "doc_id").distinct()
    names = homes.select("doc_id", "component").distinct()
    return go.unionByName(stay).distinct().join(names, "doc_id")


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sizes (doc_id, rid, n), equal (doc_id, first_id), groups (doc_id, group), sets of `docs` (doc_id, text)."""
    rows = keyed(docs)
    sizes = materialise(sizes_of(rows), "shingle-sizes")

    # Equal sets are one: all but the first of a class are linked to it and go no further.
    classes = sizes.where("n > 0").groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    equal = grouped(sizes, materialise(classes, "set-classes"), ["n", "one", "two"], "members").select("doc_id", "rid", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    equal = materialise(equal.where("doc_id <> first_id or rid <> first_rid").distinct(), "equal-sets")

    def prefixes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for i, found in shingle_sets(column, WIDTH):
            if len(found):
                yield i, found[: beginning(len(found)) + len(found) // MORE]

    buckets = buckets_for(input_bytes(docs), HASH_BYTES)
    hits = shared(rows, prefixes, buckets).join(equal, ["doc_id", "rid"], "left_anti")
    hits = hits.groupBy("doc_id", "rid").agg(F.sum(F.octet_length("hashes") / 8).alias("shared"))
    # Of the first half of its set, a linked document shares a quarter of the set at least. One
    # less than that is asked for: two shingles of a document may have one reduced hash.
    enough = F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / MORE) - 1)
    candidates = materialise(hits.join(sizes.select("doc_id", "rid", "n").distinct(), ["doc_id", "rid"]).where(enough).drop("n", "shared"), "join-candidates")
    sets = materialise(full_sets(rows.join(candidates, ["doc_id", "rid"])), "join-sets")
    sets = materialise(likely(sets, buckets), "join-likely")
    groups = materialise(components(stars(sets, buckets)).select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "join-members")
    return sizes, equal, groups, sets


def real(c: Column) -> Column:
    """An id, null again where `keyed` numbered it."""
    return F.when(c < 2**63 - 1, c)


def links_of(docs: DataFrame) -> DataFrame:
    """a, b (a < b): every linked pair of documents with different sets.

    Of documents with equal sets the one with the smallest id stands for all. An exact answer
    of a dense group is as large as its pairs; `components_of` is not.
    """
    _, _, groups, sets = prepared(docs)
    found = group_links(groups, sets, every=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().select("a", real(F.col("b")).alias("b"))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text)."""
    sizes, equal, groups, sets = prepared(docs)
    labels = components(group_links(groups, sets).unionAll(equal.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))))
    joined = sizes.join(labels, sizes["doc_id"] == labels["node"], "left")
    return joined.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is the smallest of its component.

    Texts without an id are nodes of their own here, so that one of them neither links nor
    drops another; they are numbered from 2**62, above the ids.
    """
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit((1 << 62) - 1)))
    found = components_of(docs.select(node.alias("doc_id"), "text"))
    dropped = found.where("component_id < doc_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, node == F.col("dropped_id"), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))
