"""Repeated passages by a distributed difference-cover suffix sort.

A byte goes if it is covered by a string of `length` bytes that also starts in a document of
smaller id. Strings that could repeat are found first, without loss: every string of `length`
bytes has a minimizer, the least hash of its grams, so equal strings have equal minimizers,
and a minimizer that one document alone has can't lie in a repeated string (see `sharing`).
Around the shared ones, the stretch of text whose strings they represent is cut out; equal
stretches are combined, all but the smallest document's being covered by it: in a map batch,
and again where they meet by minimizer. Stretches that have a minimizer to themselves then
repeat nothing. A minimizer of very many documents, as at the edge of a common passage, would
bring all their stretches to one place; its strings go apart and meet by a hash of all their
bytes. Of the others, each meeting place sorts the suffixes:

1. sampled positions (those not divisible by 3) are sorted by triples of 8-byte words,
2. their ranks are names, and triples of names are sorted again, three times as long, until
   the names are distinct or longer than `length`,
3. the other suffixes are sorted by first byte and the next one's rank, and merged in,
4. neighbours with a common prefix of `length` bytes are one string; its smallest document keeps it.

Whole texts that equal a smaller document's go without sorting.

Defined results: null text has no bytes; strings are bytes of UTF-8 and may begin inside a
character; null ids are larger than all others; rows that repeat an id are never smaller than
one another, and rows that repeat id and text have equal results; texts under `length` bytes
stay whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, materialise, mix, pieces, same_spans, span_hashes, table
from .sharing import binaries, buckets_for, dealt, grouped, keyed, reduced, shared, starts_of, values_of

LENGTH = 50
GRAM = 24
#: Strings of a long text that are scanned at once.
SCAN = 1 << 20
#: Input bytes per range of minimizers, and per meeting place of stretches.
HASH_BYTES, SORT_BYTES = 16 << 20, 768 << 10
#: Meeting places that one task sorts, one after the other.
PLACES = 8
#: Documents from which on a minimizer is hot, and hot ones at most.
HOT, HOT_MOST = 20_000, 1 << 20
#: Bytes of text whose stretches a map task compares.
BATCH_BYTES = 24 << 20
STRETCH_DDL = "part int, doc_id long, rid long, solved boolean, spots binary, body binary"
STRETCHES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("solved", pa.bool_()), ("spots", pa.binary()), ("body", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("spans", pa.binary())])
SPANS_DDL = "doc_id long, rid long, spans binary"


# -- minimizers -----------------------------------------------------------------


def words8(data: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes at every position as one number; zeros follow the end."""
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(held, (len(data), 8), (1, 1)).copy().view(kind).reshape(-1).astype(np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    words, n = words8(data, "<u8"), len(data) - gram + 1
    out = mix(words[:n])
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        out = mix(out + words[at : at + n] * np.uint64(0x9FB21C651E98DF25))
    return out


def minimizers(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, string after the last and hash of each run of strings with one least gram hash.

    A long text is scanned in windows of SCAN strings; a run ends where its window does.
    """
    if len(at) == 2 and len(data) > SCAN + length:
        found = []
        for i in range(0, len(data) - length + 1, SCAN):
            own = data[i : i + SCAN + length - 1]
            begin, end, hashes = minimizers(own, np.array([0, len(own)]), length, gram)
            found.append((begin + i, end + i, hashes))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    n, window = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, span = gram_hashes(data, gram), 1
    while span * 2 <= window:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < window:
        least = np.minimum(least[: -(window - span)], least[window - span :])
    least = least[:n]
    inside = np.zeros(n + 1, np.int64)
    begin, end = at[:-1], at[1:] - length + 1
    full = end > begin
    np.add.at(inside, begin[full], 1)
    np.add.at(inside, end[full], -1)
    where = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    least = least[where]
    row = np.searchsorted(at, where, "right")
    cut = starts_of(least, row)
    last = np.append(cut[1:], len(where)) - 1
    return where[cut], where[last] + 1 if len(where) else where, least[cut]


def row_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, data, at in pieces(column):
        begin, _, hashes = minimizers(data, at)
        cut = np.searchsorted(begin, at)
        for i in range(last - first):
            if cut[i + 1] > cut[i]:
                yield first + i, np.unique(hashes[cut[i] : cut[i + 1]])


# -- sorting --------------------------------------------------------------------


def named(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys; order sorts the keys."""
    new = np.zeros(len(order), np.int64)
    new[starts_of(*[k[order] for k in keys])] = 1
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by at least the first `length` bytes from each, by difference cover."""
    n = len(data)
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.concatenate((words8(data, ">u8"), np.zeros(16 + 8, np.uint64)))
    every = np.arange(n)
    sample, others = every[every % 3 != 0], every[every % 3 == 0]
    keys = word[sample], word[sample + 8], word[sample + 16]
    order = np.lexsort(keys[::-1])
    names, covers = named(order, *keys), 24
    while len(sample) and names.max() < len(sample) and covers < length:
        at = np.zeros(n + 2 * covers + 3, np.int64)
        at[sample] = names
        keys = names, at[sample + covers], at[sample + 2 * covers]
        if names.max() < 1 << 21:
            order = np.argsort(keys[0] << 42 | keys[1] << 21 | keys[2], kind="stable")
        else:
            order = np.lexsort(keys[::-1])
        names, covers = named(order, *keys), covers * 3
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    one = held[:-6].astype(np.int64)

    def by_one(i: np.ndarray) -> np.ndarray:
        return one[i] << 40 | rank[i + 1]

    def by_two(i: np.ndarray) -> np.ndarray:
        return one[i] << 48 | one[i + 1] << 40 | rank[i + 2]

    others = others[np.lexsort((by_two(others), by_one(others)))]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(np.sort(by_one(first)), by_one(others)) + np.searchsorted(np.sort(by_two(second)), by_two(others))
    out = np.full(n, -1, np.int64)
    out[before + np.arange(len(others))] = others
    out[out < 0] = sample[order]
    return out


def smallest_holder(data: np.ndarray, spots: np.ndarray, holder: np.ndarray, length: int) -> np.ndarray:
    """For the string of `length` bytes at each of `spots`, the smallest `holder` of an equal string."""
    if not len(spots):
        return holder
    place = np.full(len(data), -1, np.int64)
    place[spots] = np.arange(len(spots))
    order = place[suffix_order(data, length)]
    order = order[order >= 0]
    word, at = np.concatenate((words8(data, "<u8"), np.zeros(8, np.uint64))), spots[order]
    new = np.zeros(len(at), bool)
    new[0] = True
    for shift in [*range(0, length - 7, 8), length - 8]:
        w = word[at + shift]
        new[1:] |= w[1:] != w[:-1]
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(holder[order], begin)
    out = np.empty(len(spots), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(begin, len(at))))
    return out


# -- the operator ---------------------------------------------------------------


def hot_ones(candidates: DataFrame) -> np.ndarray:
    """Shared minimizers of so many documents that their stretches mustn't meet in one place; HOT_MOST at most.

    A document counts once for each of its batches of hashes. More than HOT_MOST minimizers
    can't each have a HOT_MOST-th of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, _ = values_of(pa.array(b["hashes"].flatten()), "<u8")
            keys, count = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count)], ["hash", "n"])

    counts = candidates.select("hashes").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= HOT), "suffix-hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    told = counts.where(F.col("n") >= max(HOT, total // HOT_MOST)).select("hash").toArrow()
    return np.sort(told["hash"].to_numpy().view(np.uint64))


def split(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with those in `hot` (a mask) cut into their single strings, which meet by a hash of all their bytes."""
    if not hot.any():
        return begin, end, hashes
    strings = (end - begin - length + 1)[hot]
    one = np.repeat(begin[hot], strings) + np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    own = span_hashes(data, one, one + length)
    begin, end, hashes = (np.concatenate((x[~hot], y)) for x, y in ((begin, one), (end, one + length), (hashes, own)))
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order], hashes[order]


def stretches(found: DataFrame, buckets: int, parts: int, length: int, hot: np.ndarray) -> DataFrame:
    """STRETCH_DDL rows around the shared minimizers. found: doc_id, rid, text, hashes (list of binaries).

    Strings with a minimizer in `hot` are stretches of their own. Solved rows carry spans of strings that a smaller document of the same batch holds; others
    carry the stretches of one document that meet in one part, with their first places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rids = (np.asarray(b[c].to_numpy(zero_copy_only=False), np.int64) for c in ("doc_id", "rid"))
            for low, high, _, _ in pieces(b["text"], BATCH_BYTES):
                spots, sizes, keys, rows, bodies = [], [], [], [], []
                for first, last, data, at in pieces(b["text"].slice(low, high - low)):
                    first, last = first + low, last + low
                    begin, end, hashes = minimizers(data, at, length)
                    key, row = reduced(hashes, buckets), np.searchsorted(at, begin, "right") - 1
                    cut = np.searchsorted(begin, at)
                    keep = np.zeros(len(begin), bool)
                    for i in range(last - first):
                        if cut[i + 1] > cut[i]:
                            own = np.frombuffer(b"".join(b["hashes"][first + i].as_py()), np.uint64)
                            keep[cut[i] : cut[i + 1]] = np.isin(key[cut[i] : cut[i + 1]], own)
                    begin, end, hashes = split(data, begin[keep], end[keep] + length - 1, hashes[keep], np.isin(key[keep], hot), length)
                    row = np.searchsorted(at, begin, "right") - 1
                    raw = data.tobytes()
                    bodies += [raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                    spots.append(begin - at[row])
                    sizes.append(end - begin)
                    keys.append(hashes)
                    rows.append(row + first)
                if not bodies:
                    continue
                spot, size, hashes, row = (np.concatenate(x) for x in (spots, sizes, keys, rows))
                doc, rid = ids[row], rids[row]
                smallest: dict[bytes, int] = {}
                for d, body in zip(doc.tolist(), bodies, strict=True):
                    if smallest.get(body, d) >= d:
                        smallest[body] = d
                covered = np.array([smallest[body] < d for d, body in zip(doc.tolist(), bodies, strict=True)], bool)
                out = []
                for solved in (True, False):
                    pick = np.flatnonzero(covered == solved)
                    if not len(pick):
                        continue
                    part = (hashes[pick] % np.uint64(parts)).astype(np.int32) if not solved else (parts + (doc[pick] ^ rid[pick]) % parts).astype(np.int32)
                    order = np.lexsort((spot[pick], row[pick], part))
                    pick, part = pick[order], part[order]
                    groups = starts_of(part, row[pick])
                    edges = np.append(groups, len(pick))
                    spots = np.stack((spot[pick], size[pick]), 1).astype(np.int64).reshape(-1)
                    body = pa.nulls(len(groups), pa.binary()) if solved else pa.array([b"".join(bodies[x] for x in pick[i:j].tolist()) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
                    out.append(pa.RecordBatch.from_arrays([pa.array(part[groups]), pa.array(doc[pick[groups]]), pa.array(rid[pick[groups]]), pa.array(np.full(len(groups), solved)), binaries(spots, edges * 2), body], schema=STRETCHES))
                yield from out

    return found.select("doc_id", "rid", "text", "hashes").mapInArrow(run, STRETCH_DDL)


def _classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each stretch data[at[i]:at[i + 1]], equal for equal bytes: met by hash, then compared."""
    hashes, size = span_hashes(data, at[:-1], at[1:]), np.diff(at)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    if np.array_equal(size[first[back]], size) and same_spans(data, at[:-1], data, at[first[back]], size).all():
        return back
    raw, names = data.tobytes(), {}
    return np.array([names.setdefault(raw[i:j], len(names)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def _repeated(solved: tuple[np.ndarray, np.ndarray], again: np.ndarray, first: np.ndarray, two: tuple[np.ndarray, np.ndarray], strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`solved` (stretch, place) also for the stretches `again` that equal one of `first` in the same document."""
    order = np.lexsort((two[1][first], two[0][first]))
    by = {(a, b): f for a, b, f in zip(two[0][first[order]].tolist(), two[1][first[order]].tolist(), first[order].tolist(), strict=True)}
    order = np.lexsort((solved[1], solved[0]))
    stretch, inner = solved[0][order], solved[1][order]
    more, places = [stretch], [inner]
    for x in again.tolist():
        f = by[(int(two[0][x]), int(two[1][x]))]
        i, j = np.searchsorted(stretch, (f, f + 1))
        more.append(np.full(j - i, x))
        places.append(inner[i:j])
    return np.concatenate(more), np.concatenate(places)


def spans_of(found: DataFrame, parts: int, length: int) -> DataFrame:
    """SPANS rows: start and end of strings that a smaller document holds. found: STRETCH_DDL rows."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        solved = rows["solved"].to_numpy(zero_copy_only=False)
        out = []
        done = rows.filter(pa.array(solved))
        if done.num_rows:
            spots, size = values_of(done["spots"], "<i8")
            pairs = spots.reshape(-1, 2).copy()
            pairs[:, 1] += pairs[:, 0]
            out.append(pa.Table.from_arrays([done["doc_id"], done["rid"], binaries(pairs.reshape(-1), np.concatenate(([0], np.cumsum(size))))], schema=SPANS))
        rows = rows.filter(pa.array(~solved))
        if rows.num_rows:
            spots, size = values_of(rows["spots"], "<i8")
            pairs = spots.reshape(-1, 2)
            data, _ = values_of(rows["body"], "u1")
            owner = np.repeat(np.arange(rows.num_rows), size // 2)
            at = np.concatenate(([0], np.cumsum(pairs[:, 1])))
            strings = pairs[:, 1] - length + 1
            ids = rows["doc_id"].to_numpy()[owner]
            # Equal stretches: the smallest document's stands for them, all strings of larger ones' go.
            two = _classes(data, at), pairs[:, 1]
            order = np.lexsort((ids, *two))
            begin = starts_of(two[0][order], two[1][order])
            size = np.diff(np.append(begin, len(order)))
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(ids[order[begin]], size)
            whole = least < ids
            first = order[begin]
            # Of stretches with one minimizer, two different ones at least are sorted.
            gram = np.minimum.reduceat(np.append(gram_hashes(data, GRAM), np.zeros(GRAM, np.uint64)), np.stack((at[:-1], at[1:] - GRAM + 1), 1).reshape(-1))[::2]
            order = np.argsort(gram[first], kind="stable")
            begin = starts_of(gram[first][order])
            several = np.repeat(np.diff(np.append(begin, len(order))) >= 2, np.diff(np.append(begin, len(order))))
            sorted_ones = np.sort(first[order[several]])
            chosen = np.zeros(len(pairs), bool)
            chosen[sorted_ones] = True
            part = data[np.repeat(chosen, pairs[:, 1])]
            place = np.concatenate(([0], np.cumsum(pairs[sorted_ones, 1])))[:-1]
            stretch = np.repeat(np.arange(len(sorted_ones)), strings[sorted_ones])
            inner = np.arange(len(stretch)) - np.repeat(np.cumsum(strings[sorted_ones]) - strings[sorted_ones], strings[sorted_ones])
            holder = ids[sorted_ones[stretch]]
            gone = smallest_holder(part, place[stretch] + inner, holder, length) < holder
            # Solved strings of a stretch hold for all equal stretches of that document.
            solved_at = sorted_ones[stretch[gone]], inner[gone]
            same = least == ids
            again = np.flatnonzero(same & ~np.isin(np.arange(len(pairs)), first))
            if len(again):
                solved_at = _repeated(solved_at, again, first, two, strings)
            full = np.flatnonzero(whole)
            stretch = np.concatenate((solved_at[0], np.repeat(full, strings[full])))
            inner = np.concatenate((solved_at[1], np.arange(int(strings[full].sum())) - np.repeat(np.cumsum(strings[full]) - strings[full], strings[full])))
            order = np.lexsort((inner, stretch))
            stretch, inner = stretch[order], inner[order]
            new = np.zeros(len(stretch), bool)
            if len(stretch):
                new[0] = True
                new[1:] = (stretch[1:] != stretch[:-1]) | (inner[1:] != inner[:-1] + 1)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(stretch)) - 1
            start = pairs[stretch[begin], 0] + inner[begin]
            end = pairs[stretch[begin], 0] + inner[last] + length if len(begin) else start
            who = owner[stretch[begin]]
            cut = starts_of(who)
            chosen = pa.array(who[cut])
            spans = np.stack((start, end), 1).astype(np.int64).reshape(-1)
            out.append(pa.Table.from_arrays([rows["doc_id"].take(chosen), rows["rid"].take(chosen), binaries(spans, np.append(cut, len(who)) * 2)], schema=SPANS))
        return pa.concat_tables(out)

    return dealt(found, 2 * parts, PLACES).groupBy("part").applyInArrow(run, SPANS_DDL)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) that overlap or touch, as one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begin = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]), 1)


def cut_out(rows: DataFrame, length: int) -> DataFrame:
    """Results of rows doc_id, text, copy (a smaller document has the whole text), spans (list of binaries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, x, copy, spans in zip(b["doc_id"].to_pylist(), b["text"], b["copy"].to_pylist(), b["spans"], strict=True):
                text = (x.as_py() or "").encode()
                pairs = np.frombuffer(b"".join(spans.as_py() or ()), np.int64).reshape(-1, 2)
                if copy and len(text) >= length:
                    pairs = np.array([[0, len(text)]], np.int64)
                gone = merged(pairs)
                kept = b"".join(text[i:j] for i, j in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(text)], strict=True)) if len(gone) else text
                out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return rows.select("doc_id", "text", "copy", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text)."""
    size, rows = input_bytes(docs), keyed(docs)
    digests = materialise(rows.where(F.octet_length("text") >= length).select("doc_id", "rid", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "suffix-digests")
    classes = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    copies = materialise(grouped(digests, materialise(classes, "suffix-classes"), ["digest"], "n").where("doc_id > least").select("doc_id", "rid").distinct(), "suffix-copies")
    buckets, parts = buckets_for(size, HASH_BYTES), buckets_for(size, SORT_BYTES)
    candidates = shared(rows, row_hashes, buckets).join(copies, ["doc_id", "rid"], "left_anti")
    candidates = materialise(candidates.groupBy("doc_id", "rid").agg(F.collect_list("hashes").alias("hashes")), "suffix-candidates")
    cut = stretches(rows.join(candidates, ["doc_id", "rid"]), buckets, parts, length, hot_ones(candidates))
    spans = materialise(spans_of(cut, parts, length), "suffix-spans")
    per = spans.groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("spans"))
    marked = copies.withColumn("copy", F.lit(True)).join(per, ["doc_id", "rid"], "full")
    joined = rows.join(marked, ["doc_id", "rid"], "left")
    found = cut_out(joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans"), length)
    return found.withColumn("doc_id", F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
