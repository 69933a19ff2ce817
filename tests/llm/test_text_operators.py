"""Each operator on awkward rows and empty tables, and against a brute-force version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import common, components, exact_dedup, media, mixing, ngram_join, packing, quality, sharing, suffix_dedup, toxicity
from skerry.llm.common import same_spans, shingle_sets, span_hashes, word_spans

from .conftest import AWKWARD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed, n=60):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 7))) for _ in range(300)]
    base = [[pick.choice(vocabulary) for _ in range(pick.randrange(3, 120))] for _ in range(8)]
    common = [pick.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(pick.choice(base))
        for _ in range(pick.randrange(0, 6)):
            w[pick.randrange(len(w))] = pick.choice(vocabulary)
        if pick.random() < 0.3:
            w += common
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


# -- scanning --------------------------------------------------------------------


def test_words_and_hashes():
    data = np.frombuffer("a bb\ta\x0bbb é".encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["a", "bb", "a", "bb", "é"]
    h = span_hashes(data, starts, ends)
    assert h[0] == h[2]
    assert h[1] == h[3]
    assert len(set(h.tolist())) == 3


def test_shingle_sets_by_force():
    texts = [t for _, t in AWKWARD] + [t for _, t in near_copies(5)]
    got = {i: len(s) for i, s in shingle_sets(pa.array(texts))}
    assert [got[i] for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_shared_hashes_by_force(spark):
    pick = random.Random(2)
    sets = {i: sorted({pick.randrange(400) for _ in range(20)}) for i in range(50)}
    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    rows = sharing.keyed(spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in sets.items()], "doc_id long, text string").repartition(5))

    def hashes(column):
        for i, x in enumerate(column):
            yield i, np.unique(np.array([int(w) * 0x9E3779B97F4A7C15 % 2**64 for w in x.as_py().split()], np.uint64))

    found = defaultdict(int)
    for r in sharing.shared(rows, hashes, 16).collect():
        found[r.doc_id] += len(r.hashes) // 8
    assert found == {i: sum(len(held[x]) > 1 for x in s) for i, s in sets.items() if any(len(held[x]) > 1 for x in s)}


def doubled(n):
    """A word of n letters by doubling and its complement: polynomials of both agree at any odd base, modulo 2**64."""
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_doubled_words_have_hashes_of_their_own(n):
    one, two = doubled(n)
    sets = [s for _, s in shingle_sets(pa.array([f"{one} x y z w", f"{two} x y z w", one, two]))]
    assert [len(s) for s in sets] == [1, 1, 1, 1]
    assert len({int(s[0]) for s in sets}) == 4


def test_same_spans():
    pick = random.Random(3)
    data = np.frombuffer(bytes(pick.choice(b"ab") for _ in range(3000)), np.uint8)
    starts, others = (np.array([pick.randrange(1500) for _ in range(3000)]) for _ in range(2))
    size = np.array([pick.choice([0, 1, 2, 3, 7, 8, 9, 17, 600]) for _ in range(3000)])
    others[::7] = starts[::7]
    raw = data.tobytes()
    want = [raw[a : a + n] == raw[b : b + n] for a, b, n in zip(starts, others, size, strict=True)]
    assert same_spans(data, starts, data, others, size).tolist() == want


def test_long_texts_are_scanned_in_windows(monkeypatch):
    texts = [t for _, t in AWKWARD if t] + [t for _, t in near_copies(5)] + ["x" * 700 + " " + "y " * 50]
    want = [s.tolist() for _, s in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(common, "PIECE", 60)
    assert [s.tolist() for _, s in shingle_sets(pa.array(texts))] == want
    for most in (1, 7, 60):
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            cut = [w.tobytes() for w in common.windows(data, most)]
            assert b"".join(cut) == t.encode()
            assert [w for c in cut for w in WORD.findall(c)] == WORD.findall(t.encode())


# -- exact dedup -----------------------------------------------------------------


def test_exact_dedup_awkward(awkward, no_rows):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(awkward).collect()]
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for i, t in AWKWARD:
        g = groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        least = min((x for x in g if x is not None), default=None)
        want.append((i, least, len(g), i == least))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.verdicts(no_rows).count() == 0
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    one = {(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for (i, t), (_, _, _, k) in zip(AWKWARD, want, strict=True) if k}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in one), key=str)


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_hot_groups_have_the_same_verdicts(spark, awkward, monkeypatch, hot):
    """Also where every group of two is hot, and where only one that holds all rows would be."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
    rows = [(i, "hot" if i % 2 else f"t{i % 30}") for i in range(400)] + [(None, "hot"), (None, "n"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = defaultdict(list)
    for i, t in rows:
        held[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in held.items()}
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(docs).collect()), key=str)
    assert got == sorted([(i, least[t], len(held[t]), i == least[t]) for i, t in rows], key=str)
    assert exact_dedup.deduplicate(docs).count() == len(held)


def test_one_row_of_each_group_stays(spark):
    rows = [(7, "same"), (7, "same"), (None, "x y"), (None, "x y"), (None, "x  y"), (None, "x y"), (8, "same"), (9, "y"), (None, "y"), (7, "other"), (7, "other ")]
    docs = spark.createDataFrame([(i, t, {"a": 1}, "z") for i, t in rows], "doc_id long, text string, digest map<string, int>, body string").repartition(3)
    for digest in (exact_dedup.sha256, lambda c: F.lit("same")):
        kept = exact_dedup.deduplicate(docs, digest)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, " ".join(r.text.split()) + " " * r.text.endswith(" ")) for r in kept.collect()), key=str) == sorted([(7, "same"), (None, "x y"), (9, "y"), (7, "other"), (7, "other ")], key=str)


def test_exact_dedup_compares_texts(awkward):
    """With a digest that is the same for every text, texts still make the groups."""
    good = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.verdicts(awkward).collect()}
    weak = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.verdicts(awkward, digest=lambda c: F.lit("same")).collect()}
    assert weak == good


# -- mixing ----------------------------------------------------------------------


def levels(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, budget = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (budget - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, awkward, no_rows):
    pick = random.Random(4)
    rows = [(i, " ".join("w" * pick.randrange(1, 30))[: pick.randrange(1, 60)], pick.choice(["b", "a", "Z", "é", None, "c"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1]))
        sizes[r.source] += r.size
    want = levels(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(9)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.remix(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in got)
    bare = spark.createDataFrame([(None, "w " * (1 + k % 7) + str(k), "a") for k in range(400)] + [(k, "w w", "b") for k in range(300)], "doc_id long, text string, source string")
    told = mixing.mix(bare).where("source = 'a'").selectExpr("sum(taken) as t", "max(target) as g").first()
    assert abs(told.t - told.g) < 20  # rows without an id are taken apart too
    assert mixing.mix(awkward).count() == len(AWKWARD)
    assert mixing.remix(awkward).columns == awkward.columns
    assert mixing.mix(no_rows).count() == 0


# -- packing -----------------------------------------------------------------------


def test_token_ids_equal_the_file():
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(packing.vocabulary_path())
    file.encode_special_tokens = True
    pick = random.Random(6)
    signs = "abz'sremtdlv ,.!é中9½́ß   İΣﬁ\U0001f600-"
    texts = [t or "" for _, t in AWKWARD] + ["".join(pick.choice(signs) for _ in range(pick.randrange(60))) for _ in range(400)]
    got = packing.WordEncoder(packing.vocabulary_path()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == file.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """Also where a hash names many words, and for words that a polynomial hash can't part."""
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(packing.vocabulary_path())
    texts = [*doubled(1024), *doubled(2048), "one two six", "two one", "three"]
    want = [file.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.WordEncoder(packing.vocabulary_path()).encode(texts)] == want
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    encode = packing.WordEncoder(packing.vocabulary_path()).encode
    assert [x.tolist() for x in encode(texts)] == want
    assert [x.tolist() for t in texts for x in encode([t])] == want


def test_long_texts_are_encoded_in_windows(monkeypatch):
    monkeypatch.setattr(packing, "SCAN", 50)
    texts = [t or "" for _, t in AWKWARD if len(t or "") < 20_000] + ["a  b\n\n" * 40, "don't we'll " * 30, " \u0301é" * 40]
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(packing.vocabulary_path())
    file.encode_special_tokens = True
    for text, ids in zip(texts, packing.WordEncoder(packing.vocabulary_path()).encode(texts), strict=True):
        assert ids.tolist() == file.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_rows_without_id_spread_over_groups(spark):
    rows = packing.cut_pieces(spark.range(20_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text").repartition(3))
    assert rows.selectExpr("count(distinct spread)").first()[0] > 19_000
    assert rows.selectExpr("pmod(spread, 8) as g").groupBy("g").count().selectExpr("max(count) / 20000").first()[0] < 0.2


def test_first_fit_by_force():
    pick = random.Random(1)
    lengths = sorted((pick.randrange(1, 101) for _ in range(500)), reverse=True)
    bins, offsets = packing.first_fit(np.array(lengths), 100)
    used = []
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        first = next((i for i, u in enumerate(used) if u + n <= 100), len(used))
        if first == len(used):
            used.append(0)
        assert (b, o) == (first, used[first])
        used[first] += n


def test_packing_covers_every_id(awkward, no_rows):
    got = packing.pack(awkward).collect()
    encode = packing.WordEncoder(packing.vocabulary_path()).encode
    want = sorted((str(i), len(ids) + 1) for (i, _), ids in zip(AWKWARD, encode([t or "" for _, t in AWKWARD]), strict=True))
    per, places = defaultdict(int), defaultdict(list)
    for r in got:
        per[str(r.doc_id), r.doc_tokens] += r.length
        places[r.sequence_id].append((r.offset, r.length))
        assert r.length <= 4096
    assert sum(per.values()) == sum(n for _, n in want)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    ids = np.append(encode([AWKWARD[0][1]])[0], 2).astype("<u4")
    assert {r.ids_crc32 for r in got if r.doc_id == 1} == {zlib.crc32(ids)}
    assert packing.pack(no_rows).count() == 0


# -- n-gram Jaccard join -------------------------------------------------------------


def test_signature_tree_by_force():
    for seed in range(4):
        rows = near_copies(seed, 90)
        column = pa.array([t for _, t in rows])
        sets = [s for _, s in shingle_sets(column)]
        tree = ngram_join.SignatureTree(sets)
        tree.join()
        want = components_by_force(list(enumerate(t for _, t in rows)))
        root = [0] * len(sets)
        for k, i in enumerate(tree.order):
            root[i] = tree.union.root(k)
        groups = defaultdict(set)
        for i, r in enumerate(root):
            groups[r].add(i)
        expected = defaultdict(set)
        for i, (_, c) in want.items():
            expected[c].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("block_bytes", [12 << 20, 3000])
def test_join_by_force(spark, monkeypatch, block_bytes):
    """Also with groups cut into blocks so small that links cross them."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(sharing, "HOT_GROUPS", 1000 if block_bytes == 3000 else 10)
    rows = [(5000 + i, "one more text that many rows have word for word") for i in range(12)] + near_copies(11, 80) + [(1000 + i, t) for i, t in enumerate(["", None, " ", "one two", "one  TWO", "one two three"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components_of(docs).collect()}
    assert got == components_by_force(rows)


@pytest.mark.parametrize("block_bytes", [12 << 20, 3000])
def test_every_link_by_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    rows = near_copies(12, 90)
    want, first = set(), {}
    for i, t in rows:
        first.setdefault(frozenset(shingles(t)), i)
    for (x, a), (y, b) in itertools.combinations(first.items(), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            want.add((min(a, b), max(a, b)))
    got = [(r.a, r.b) for r in ngram_join.links_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len(want) > 10
    assert sorted(got) == sorted(want)


def test_a_common_passage_ties_no_groups(spark):
    """Texts that share a passage but are a half their own fall into no group together."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(0, 60, 2):
        own = [word() for _ in range(40)]
        rows += [(i, " ".join(own + passage)), (i + 1, " ".join([word(), *own, *passage]))]
    _, _, groups, _ = ngram_join.prepared(spark.createDataFrame(rows, "doc_id long, text string"))
    assert groups.groupBy("group").count().where("count <> 2").count() == 0
    assert groups.count() == 60


def test_bands_hold_every_linked_pair():
    size = np.sort(np.random.default_rng(1).integers(1, 400, 500))
    pairs = set()
    for begin, middle, end in ngram_join.bands(size):
        pairs |= {(i, j) for i in range(begin, middle) for j in range(begin, end)}
    for i in range(500):
        for j in range(i, 500):
            assert 4 * size[i] < 3 * size[j] or (i, j) in pairs


def test_tree_of_small_sets_beside_a_large_one():
    """The bitmaps of many small sets don't take the width of the largest."""
    sets = [np.arange(k * 7, k * 7 + 3, dtype=np.uint64) for k in range(3000)] + [np.arange(200_000, dtype=np.uint64)]
    tree = ngram_join.SignatureTree(sets)
    widths = []
    grow = tree._grow
    tree._grow = lambda *a: (grow(*a), widths.append(tree.bits.nbytes))
    tree.join()
    assert max(widths) < 1 << 18


def test_join_awkward(awkward, no_rows):
    got = ngram_join.components_of(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (4, 5, 6)} == {(4, 4), (5, 5), (6, 6)}
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in got if r.doc_id in (7, 8)} == {(7, 7, 1), (8, 7, 1)}
    assert ngram_join.components_of(no_rows).count() == 0
    kept = ngram_join.representatives(awkward)
    assert kept.columns == awkward.columns
    assert {2, 3, 8} & {r.doc_id for r in kept.collect()} == set()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 98 for i in (98, 99, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- suffix dedup ----------------------------------------------------------------------


def removed_by_force(rows, length=50):
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - length + 1):
            f = first[raw[k : k + length]]
            if f is not None and (i is None or f < i):
                gone[k + 1 : k + 1 + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
        out.append((i, len(raw), len(raw) - len(kept), int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order():
    pick = np.random.default_rng(0)
    for n, letters in itertools.product((1, 2, 3, 4, 60, 700), (1, 2, 5)):
        data = pick.integers(0, letters, n).astype(np.uint8)
        raw = data.tobytes()
        order = suffix_dedup.suffix_order(data, 50)
        assert sorted(order.tolist()) == list(range(n))
        heads = [raw[i : i + 50].ljust(50, b"\0") for i in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_suffix_dedup_by_force(spark, monkeypatch, hot):
    """Also with minimizers that count as hot, whose strings go apart."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(sharing, "HOT_GROUPS", 1000 if hot > 1 else 20)
    pick = random.Random(9)
    passages = ["".join(pick.choice("abcé \n") for _ in range(pick.randrange(40, 200))) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [pick.choice(passages)[pick.randrange(5) :] if pick.random() < 0.6 else "".join(pick.choice("xyzw ") for _ in range(pick.randrange(80))) for _ in range(pick.randrange(6))]
        rows.append((i * 2, "".join(parts)))
    rows += [(500, rows[3][1]), (501, "q" * 300), (502, "q" * 50), (503, "q" * 49), (504, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()), key=str)
    assert got == removed_by_force(rows)


def test_stretches_with_one_hash_are_compared(spark, monkeypatch):
    data = np.frombuffer("".join([*doubled(1024), *doubled(1024)]).encode(), np.uint8)
    at = np.array([0, 1024, 2048, 3072, 4096])
    for hashes in (suffix_dedup.span_hashes, lambda data, starts, ends: (ends - starts).astype(np.uint64)):
        monkeypatch.setattr(suffix_dedup, "span_hashes", hashes)
        found = suffix_dedup._classes(data, at).tolist()
        assert found[0] == found[2] != found[1] == found[3]
    one, two = doubled(1024)
    rows = [(1, one), (2, two), (3, "x" + one), (4, two + "y")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == removed_by_force(rows)


def test_long_texts_have_the_same_minimizers(monkeypatch):
    pick = random.Random(8)
    data = np.frombuffer("".join(pick.choice("abc ") for _ in range(5000)).encode(), np.uint8)
    at = np.array([0, 5000])

    def strings():
        begin, end, hashes = suffix_dedup.minimizers(data, at)
        return {(k, int(h)) for i, j, h in zip(begin.tolist(), end.tolist(), hashes.tolist(), strict=True) for k in range(i, j)}

    want = strings()
    monkeypatch.setattr(suffix_dedup, "SCAN", 700)
    assert strings() == want
    assert len(want) == 5000 - 49


def test_spans_merge():
    assert suffix_dedup.merged(np.array([[5, 9], [0, 3], [3, 4], [6, 7], [20, 30]])).tolist() == [[0, 4], [5, 9], [20, 30]]


def test_suffix_dedup_awkward(awkward, no_rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(awkward).collect()), key=str)
    assert got == removed_by_force(AWKWARD)
    assert suffix_dedup.deduplicate(no_rows).count() == 0


# -- media ---------------------------------------------------------------------------------


def test_sequences_stay_aligned():
    page = '<p>One &amp; <b>two</b></p><script>no</script><figure><img src="sha256:AB" alt="old"><figcaption>new <i>one</i></figcaption></figure>three<img src="sha256:cd"><img src="http://x">'
    got = media.sequence(page)
    assert [(x["kind"], x["text"], x["digest"], x["caption"]) for x in got] == [("text", "One & two", None, None), ("media", None, "ab", "new one"), ("text", "three", None, None), ("media", None, "cd", None)]
    assert media.sequence(None) == []
    assert media.sequence("<p></p>") == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<figure><figcaption>first</figcaption><img src="sha256:a" alt="alt"></figure>', [("a", "first")]),
        ('<figure><img src="sha256:a"><figcaption>cap<p>x</p></figure><p>after</p>tail', [("a", "cap x"), "after", "tail"]),
        ("<figcaption>stray</figcaption><p>more</p>", ["stray", "more"]),
        ('<p>one</p><noscript><img src="sha256:a">no</noscript>two', ["one", "two"]),
        ('<div><noscript><img src="sha256:a">no</div>after', ["after"]),
        ("<p>one</p><noscript>two<p>three", ["one", "two", "three"]),
        ('<template><p>no</p></template><img src="sha256:a" alt="alt">', [("a", "alt")]),
        ("one<script>if (a < b) { no }", ["one"]),
        ('<figure><img src="sha256:a"><figure><img src="sha256:b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>', [("a", "out"), ("b", "in")]),
        ('<figure><img src="sha256:a"><figcaption>open', [("a", "open")]),
        ('<figure><img src="sha256:a" alt="alt"><figcaption> </figcaption></figure>', [("a", "alt")]),
    ],
)
def test_captions_and_skipped_elements(page, want):
    assert [x["text"] if x["kind"] == "text" else (x["digest"], x["caption"]) for x in media.sequence(page)] == want


def test_features_follow_the_stored_width(spark):
    payload = np.arange(64, dtype=np.uint8)
    for width in (8, 16):
        row = pa.RecordBatch.from_pylist([{"digest": "d", "stored": media.to_png(payload, width)}])
        feature = next(media.feature_rows([row]))["feature"][0].as_py()
        assert feature.endswith(f"{1 / 255:.4f}")
        assert media.from_png(media.to_png(payload, width)).shape == (64 // width, width)


def test_images_round_trip():
    for n in (1, 3, 40):
        payload = np.random.default_rng(n).integers(0, 256, 192 * n).astype(np.uint8)
        assert media.from_png(media.to_png(payload)).tobytes() == payload.tobytes()
    with pytest.raises(ValueError, match="damaged"):
        stored = bytearray(media.to_png(np.zeros(192, np.uint8)))
        stored[50] ^= 1
        media.from_png(bytes(stored))


def test_media_store(spark, awkward, no_rows, tmp_path):
    folder = f"file://{tmp_path}/store"
    media.write_store(awkward, folder)
    pages = awkward.select("doc_id", "text").mapInArrow(media.as_page, "doc_id long, n_bytes long, html string")
    refs = media.references(media.parse(pages, ("doc_id", "n_bytes")), ("doc_id", "n_bytes"))
    got = media.resolve(refs, media.read_store(spark, folder)).collect()
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in AWKWARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in got) == want
    assert all(r.caption == f"{r.n_bytes} bytes" for r in got)
    lost = spark.createDataFrame([(1, "00")], "doc_id long, digest string")
    assert media.resolve(lost, media.read_store(spark, folder)).first().feature is None
    assert media.references(media.parse(no_rows.select(F.col("doc_id").alias("id"), F.col("text").alias("html")))).count() == 0


# -- classifiers -----------------------------------------------------------------------------


def labelled(spark, seed=3, n=400):
    pick = random.Random(seed)
    plain = ["".join(pick.choice("aeiourstln") for _ in range(pick.randrange(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [pick.choice(plain) for _ in range(pick.randrange(10, 120))]
        toxic, good = pick.random() < 0.2, pick.random() < 0.75
        if toxic:
            for _ in range(3):
                w.insert(pick.randrange(len(w)), pick.choice(["idiot", "moron", "snarfle", "snarflish", "clown"]))
        if not good:
            w = [x + pick.choice(["%%%", "###", "&&&"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_held_out(spark, awkward, no_rows):
    docs, labels, told = labelled(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert auc([(got[i], t) for i, _, t in told if i % 3 == 1]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    kept = toxicity.accepted(awkward, model)
    assert kept.columns == awkward.columns
    assert kept.count() == len(AWKWARD)
    assert toxicity.score(no_rows, model).count() == 0
    blank = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(awkward, blank).count() == len(AWKWARD)
    assert toxicity.accepted(spark.createDataFrame([(1, "you stupid idiot scum moron"), (2, "a fine day")], "doc_id long, text string"), blank).collect()[0].doc_id == 2


def test_label_model_finds_accuracies_and_a_copy():
    pick = np.random.default_rng(5)
    n, prior = 60_000, 0.2
    y = pick.random(n) < prior
    rates = [(0.6, 0.02), (0.5, 0.05), (0.7, 0.01), (0.4, 0.03), (0.3, 0.3)]
    votes = np.stack([np.where(y, pick.random(n) < a, pick.random(n) < b) for a, b in rates], 1).astype(float)
    votes = np.concatenate((votes, votes[:, :1]), 1)
    x = np.concatenate((votes, np.ones((n, 1))), 1)
    model = toxicity.label_model(n, x.T @ x, prior)
    assert (5, 0) in model.correlated
    assert model.toxic[2] == pytest.approx(0.7, abs=0.08)
    assert model.weight[0] < 0.8
    assert abs(model.toxic[4] - model.clean[4]) < 0.1


def test_quality_held_out(spark, awkward, no_rows):
    docs, labels, told = labelled(spark, 8)
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert auc([(got[i], q) for i, q, _ in told if i % 5 == 0]) >= 0.9
    assert quality.score(awkward, model).count() == len(AWKWARD)
    assert quality.score(no_rows, model).count() == 0
    assert {r.score for r in quality.score(awkward, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
