"""Which of its 64-bit hashes does a document share with another document?

Only hashes travel. A map task compares its own documents first: a hash that two of them
have is known to be shared there and then, and one mark of it goes on, so a hash of a third
of all documents arrives once per map batch and not once per document. The marks and the
unshared rest meet by ranges of the hash; the number of ranges follows the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Bytes of text whose documents are compared within a map task.
BATCH_BYTES = 24 << 20
#: Groups that are broadcast, at most: those of this share of all rows.
HOT_GROUPS = 1000
#: Tasks of a step that meets by part, at most; with more parts, a task has several, one after the other.
MOST_TASKS = 20_000
ROWS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("mark", pa.bool_()), ("hashes", pa.binary())])
FOUND = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("hashes", pa.binary())])


def grouped(rows: DataFrame, groups: DataFrame, keys: list[str], members: str) -> DataFrame:
    """`rows` joined with `groups` on `keys`; groups of a HOT_GROUPS-th of all rows or more, HOT_GROUPS at most, are broadcast.

    So no partition holds a hot group's rows. Both tables are read several times.
    """
    bound = max(2, -(-rows.count() // HOT_GROUPS))
    hot, cold = groups.where(F.col(members) >= bound), groups.where(F.col(members) < bound)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid, text: null ids count as larger than all others; rid tells texts of one id apart, 0 if ids are unique."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id")
    twice = docs.select(ids).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rid = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(ids, rid.alias("rid"), "text")


def buckets_for(size: int, per: int) -> int:
    return int(min(1 << 22, max(16, size // per)))


def dealt(rows: DataFrame, parts: int, per: int = 1) -> DataFrame:
    """Rows by their `part` (0 to parts): `per` parts, or more if there are very many, are one task's."""
    return rows.repartitionById(min(MOST_TASKS, -(-parts // per)), "part")


def reduced(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper and 32 bits of the hash in the lower half."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary array whose i-th value is the bytes of values[cut[i]:cut[i+1]]."""
    offsets = (cut * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after the other, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    width = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return values, np.diff(at) // width


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins, over several columns of one length."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shared(rows: DataFrame, hashes_of: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]], buckets: int) -> DataFrame:
    """doc_id, rid, hashes (reduced, as uint64 bytes) of the hashes that another row has too.

    rows: doc_id, rid, text. hashes_of: yields a row's place in the column and its distinct
    hashes. A row may come back several times, each time with other hashes.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rids = (np.asarray(b[c].to_numpy(zero_copy_only=False), np.int64) for c in ("doc_id", "rid"))
            for first, last, _, _ in pieces(b["text"], BATCH_BYTES):
                own, who = [], []
                for i, found in hashes_of(b["text"].slice(first, last - first)):
                    own.append(found)
                    who.append(np.full(len(found), first + i, np.int32))
                if not own:
                    continue
                keys, who = reduced(np.concatenate(own), buckets), np.concatenate(who)
                order = np.lexsort((who, keys))
                keys, who = keys[order], who[order]
                one = starts_of(keys, who)  # two hashes of a row may fall on one reduced hash
                keys, who = keys[one], who[one]
                begin = starts_of(keys)
                size = np.diff(np.append(begin, len(keys)))
                several = np.repeat(size >= 2, size)
                marks = keys[begin[size >= 2]]
                out = []
                for part_of, k, w in ((0, keys[~several], who[~several]), (buckets, keys[several], who[several])):
                    part = (k >> np.uint64(32)).astype(np.int32) if part_of == 0 else (buckets + ((ids[w] ^ rids[w]) % buckets)).astype(np.int32)
                    order = np.lexsort((k, w, part))
                    k, w, part = k[order], w[order], part[order]
                    cut = starts_of(part, w)
                    values = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32) if part_of == 0 else k
                    out.append(pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(ids[w[cut]]), pa.array(rids[w[cut]]), pa.array(np.zeros(len(cut), bool)), binaries(values, np.append(cut, len(k)))], schema=ROWS))
                part = (marks >> np.uint64(32)).astype(np.int32)
                cut = starts_of(part)
                nothing = np.zeros(len(cut), np.int64)
                out.append(pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(nothing), pa.array(nothing), pa.array(np.ones(len(cut), bool)), binaries((marks & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.append(cut, len(marks)))], schema=ROWS))
                yield from out

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= buckets:
            return rows.select(FOUND.names)
        values, size = values_of(rows["hashes"], "<u4")
        who = np.repeat(np.arange(len(size)), size)
        mark = rows["mark"].to_numpy(zero_copy_only=False)[who]
        order = np.argsort(values, kind="stable")
        values, who, mark = values[order], who[order], mark[order]
        begin = starts_of(values)
        runs = np.diff(np.append(begin, len(values)))
        keep = np.repeat(runs >= 2, runs) & ~mark
        values, who = values[keep], who[keep]
        order = np.argsort(who, kind="stable")
        values, who = values[order], who[order]
        cut = starts_of(who)
        full = values.astype(np.uint64) | np.uint64(part << 32)
        chosen = pa.array(who[cut])
        return pa.Table.from_arrays([rows["doc_id"].take(chosen), rows["rid"].take(chosen), binaries(full, np.append(cut, len(full)))], schema=FOUND)

    ddl = "part int, doc_id long, rid long, mark boolean, hashes binary"
    return dealt(rows.select("doc_id", "rid", "text").mapInArrow(emit, ddl), 2 * buckets).groupBy("part").applyInArrow(meet, "doc_id long, rid long, hashes binary")
