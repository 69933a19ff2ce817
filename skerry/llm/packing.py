"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities.

Documents become token ids and one end id, cut into full sequences and a rest. Pieces are
dealt to randomised groups by a hash of document, start and the row's place in its task, so a
group's size doesn't depend on ids, order or sources, and rows without an id spread as well. Each group is packed for itself: longest first, each piece into the
first bin that still holds it. The bins' free capacities are the leaves of a tournament tree
whose inner nodes keep the larger of their two children; the first fitting bin is found by
one walk from the root.

Token ids equal those of the tokenizer file for every text. Texts are split by its own rule
on arrays of code points; each distinct word of a batch is encoded once, and a worker keeps
the words it has seen. Words meet by hash and are compared.

Defined results: null text is empty, hence one piece with the end id alone; rows that repeat
an id are packed one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, same_spans, span_hashes, table

LENGTH = 4096
END = 2
#: Pieces that one group packs; groups follow the input's size.
GROUP_PIECES = 20_000
VOCABULARY = "word_bpe_49k.json"
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"
#: Words kept by a worker; with more, it starts anew.
KEPT_WORDS = 250_000
#: Code points scanned at once.
SCAN = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- token ids ------------------------------------------------------------------


class WordEncoder:
    """Token ids of a word-splitting BPE file with a word-end mark, a batch of texts at a time."""

    mark = "\x01"

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        unit = self._units()
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            word = token.endswith(model["end_of_word_suffix"])
            body = token.removesuffix(model["end_of_word_suffix"]) if word else token
            if body and all(c in unit for c in body):
                ranks[bytes(unit[c] for c in body) + (b"\x01" if word else b"")] = i
        # The mark's own byte needs a rank of its own; the word \x01 never reaches it (see encode).
        own = ranks.get(b"\x01")
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        assert own is not None
        ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        for raw, i in ranks.items():
            ends[i] = len(raw) > 1 and raw.endswith(b"\x01")
        self.ends = ends
        kinds = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, rule in ((1, r"\s"), (2, r"\p{L}"), (3, r"\p{N}")):
            kinds[[ord(c) for c in regex.findall(rule, everything)]] = kind
        self.kinds = kinds
        self.slow = None
        self.path = path
        self.forget()

    @staticmethod
    def _units() -> dict[str, int]:
        """The byte that each printable stand-in of a byte-level vocabulary means."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain}
        rest = [b for b in range(256) if b not in plain]
        return shown | {chr(256 + i): b for i, b in enumerate(rest)}

    def forget(self) -> None:
        self.words = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.held = np.zeros(0, np.uint32)  # the words themselves, one after the other
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def plainly(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def split(self, points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of lower-cased text; edge: where texts begin."""
        kind = self.kinds[points]
        n = len(points)
        begin = np.ones(n + 1, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        begin |= edge
        starts = np.flatnonzero(begin[:n])
        # A run of other signs that starts with an apostrophe gives 's 't 'm 'd 're 've 'll with what follows.
        quote = starts[points[starts] == 0x27]
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == 2) & ~edge[quote + 1]]
        if len(quote):
            one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
            two_ok = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
            a, b = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
            two = two_ok & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            two &= ~one
            begin[quote[one | two] + 1] = False
            after = np.concatenate((quote[one] + 2, quote[two] + 3))
            after = after[after <= n]
            begin[after] = True
            starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        keep = kind[starts] != 1
        return starts[keep], ends[keep]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = np.array(self.bpe.encode_ordinary(self.mark.join(words) + self.mark), np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise AssertionError("a word's end was lost")
        first = np.concatenate(([0], stops[:-1])) + len(self.ids)
        count = np.diff(np.concatenate(([0], stops)))
        at = np.searchsorted(self.words, hashes)
        size = np.array([len(w) for w in words], np.int64)
        self.at = np.insert(self.at, at, np.cumsum(size) - size + len(self.held))
        self.size = np.insert(self.size, at, size)
        self.held = np.concatenate((self.held, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)))
        self.words = np.insert(self.words, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a long one is encoded in windows cut before white space, which no piece holds."""
        cut = [list(text_windows(x)) for x in texts]
        whole = [x for own in cut for x in own]
        if len(whole) == len(texts):
            return self._encode(texts)
        found = iter([y for i, j in batches_of(whole) for y in self._encode(whole[i:j])])
        return [np.concatenate([next(found) for _ in own]) for own in cut]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        usable = []
        for i, text in enumerate(texts):
            if self.mark in text:
                out[i] = self.plainly(text)
            else:
                usable.append(i)
        if not usable:
            return out
        # Every capital sigma becomes the same small one: the file's rule looks at single letters.
        lowered = [(texts[i] if texts[i].isascii() else unicodedata.normalize("NFC", texts[i]).replace("\u03a3", "\u03c3")).lower() for i in usable]
        sizes = np.array([len(x) for x in lowered])
        joined = "".join(lowered)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate(([0], np.cumsum(sizes)))
        edge = np.zeros(len(points) + 1, bool)
        edge[at] = True
        starts, ends = self.split(points, edge) if len(points) else (np.zeros(0, np.int64),) * 2
        hashes = span_hashes(points, starts, ends)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.words, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.words)
        known[inside] = self.words[place[inside]] == distinct[inside]
        if not known.all():
            if len(self.words) + np.count_nonzero(~known) > KEPT_WORDS:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(distinct[new], [joined[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            place = np.searchsorted(self.words, distinct)
        mine = place[back]
        # Where hashes meet, the words are compared: one that only has another's hash sends the batch to the file's own encoder.
        if not (np.array_equal(self.size[mine], ends - starts) and same_spans(points, starts, self.held, self.at[mine], ends - starts).all()):
            self.forget()
            for i in usable:
                out[i] = self.plainly(texts[i])
            return out
        counts = self.count[place][back]
        firsts = self.first[place][back]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        index = np.arange(total) + np.repeat(firsts - (stops - counts), counts)
        ids = self.ids[index]
        row = np.searchsorted(starts, at)
        cut = np.concatenate(([0], stops))[row]
        for k, i in enumerate(usable):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out


def text_windows(text: str, most: int = 0) -> Iterator[str]:
    """The text in stretches of about `most` code points that each begin with white space (but the first)."""
    most = most or SCAN
    if len(text) <= most or WordEncoder.mark in text:
        yield text
        return
    begin = 0
    for m in _SPACE.finditer(text):
        if m.start() - begin >= most:
            yield text[begin : m.start()]
            begin = m.start()
    yield text[begin:]


_SPACE = re.compile(r"\s+")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def batches_of(texts: list[str], most: int = SCAN) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= most):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def cut_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """PIECES_DDL rows of every row of `docs` (doc_id, text)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task, seen = TaskContext.get(), 0
        origin = task.partitionId() if task else 0
        for b in batches:
            ids, texts = b["doc_id"], [x.as_py() or "" for x in b["text"]]
            for i, j in batches_of(texts):
                rows: list[tuple] = []
                for k, tokens in zip(range(i, j), encode(texts[i:j]), strict=True):
                    seen += 1
                    tokens = np.append(tokens, np.uint32(END)).astype("<u4")
                    doc = ids[k].as_py()
                    for start in range(0, len(tokens), length):
                        part = tokens[start : start + length]
                        crc = zlib.crc32(part)
                        rows.append((doc, start, len(part), crc, len(tokens), zlib.crc32(f"{doc}/{start}/{origin}/{seen}".encode(), crc)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES_DDL)


# -- packing --------------------------------------------------------------------


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the descending `lengths`, by a walk down the tournament tree."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k, need in enumerate(lengths.tolist()):
        node = 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        free = tree[node]
        bins[k], offsets[k] = node - size, capacity - free
        tree[node] = free - need
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """sequence_id and offset for rows of PIECES_DDL, in randomised groups of about `group_pieces`."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(group["length"].to_numpy(), length)
        group["sequence_id"] = group["group"].to_numpy(np.int64) * (1 << 32) + bins
        group["offset"] = offsets
        return group.drop(columns=["group", "spread"])

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.withColumn("group", F.pmod("spread", F.lit(groups))).groupBy("group").applyInPandas(run, ddl)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of every row of `docs` (doc_id, text) with their places in sequences of `length`."""
    return pack_pieces(materialise(cut_pieces(docs, path, length), "pieces"), length)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
