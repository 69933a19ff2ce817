"""The pipeline's dropping of copies and near copies, by force."""

from collections import Counter

import hashlib
import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np

from skerry.llm import packing

from .plain import toxic_scores
from .test_text_operators import components_by_force, labelled, levels, near_copies, words


def test_run_drops_copies_by_force(spark, tmp_path, monkeypatch):
    """run() with the stages that drop copies, on rows with and without an id."""
    base = near_copies(5, 60)
    long = lambda word: " ".join(f"{word}{k}" for k in range(40))
    named = base + [(1000 + k, base[k][1]) for k in range(8)] + [(2000, long("p")), (2001, long("q"))]
    # Near copies of rows with an id, one of each of two that aren't alike; alike only among themselves; a copy; alone.
    bare = [base[0][1] + " z", long("p") + " z", long("q") + " z", long("r"), long("r") + " z", base[3][1], long("s")]
    rows = named + [(None, t) for t in bare]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[1:3], ("all", lambda spark, docs, sf_dir: docs)])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text").collect())

    first = {}
    for i, t in sorted((10**6 + k if i is None else i, t) for k, (i, t) in enumerate(rows)):
        first.setdefault(t, i)
    kept = components_by_force([(i, t) for t, i in first.items()])
    want = Counter((i if i < 10**6 else None, t) for t, i in first.items() if kept[i][1] == i)
    alike = {(None, long("r")), (None, long("r") + " z")}  # either may stay for the other
    assert sum(got[x] for x in alike) == sum(want[x] for x in alike) == 1
    assert {x: n for x, n in got.items() if x not in alike} == {x: n for x, n in want.items() if x not in alike}
    assert (None, long("s")) in got


def test_run_by_force(spark, tmp_path):
    """All five stages: toxic rows go, one of equal texts and of near copies stays, the mix is met, every id is packed once."""
    docs, labels, told = labelled(spark, 21, 240)
    pick = random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in near_copies(9, 60)]
    rows += [(2000 + k, rows[k][1]) for k in range(0, 300, 7)] + [(3000, None), (3001, ""), (3002, "  ")]
    rows = [(i, t, pick.choice(["a", "b", "c", "d", None])) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    scores = toxic_scores([(i, t) for i, t, _ in rows], {i: y for i, _, y in told if zlib.crc32(str(i).encode()) % 3 != 1})
    kept = [r for r in rows if scores[r[0]] < 0.7]
    assert len(kept) < len(rows) - 20
    first = {}
    for i, t, _ in sorted(kept, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = [r for r in kept if r[0] in set(first.values())]
    parts = components_by_force([(i, t) for i, t, _ in kept])
    kept = [r for r in kept if parts[r[0]][1] == r[0]]

    size, of, text_of = defaultdict(int), {}, {i: t for i, t, _ in kept}
    for i, t, s in kept:
        of[i] = len(words(t))
        size[s] += of[i]
    target, times = levels(size), {}
    for s in size:
        copies = int(target[s] // size[s]) if size[s] else 0
        left, under, open_ = target[s] - copies * size[s], 0, copies < 2
        for i in sorted((i for i, _, x in kept if x == s), key=lambda i: hashlib.md5(f"{i}|{text_of[i] or ''}".encode()).hexdigest()[:9]):
            open_ = open_ and under + of[i] / 2 <= left
            times[i] = copies + open_
            under += of[i]
    encode = packing.WordEncoder(packing.vocabulary_path()).plainly
    want = Counter()
    for i, t, _ in kept:
        ids = np.append(encode(t or ""), 2).astype("<u4")
        for start in range(0, len(ids), 4096):
            piece = ids[start : start + 4096]
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += times[i]
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == +want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
