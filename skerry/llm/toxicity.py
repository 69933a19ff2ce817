"""Toxicity by weak supervision.

Many voters say toxic or nothing about a document: lexicons (a fixed list of insults, and word
and word-beginning lists mined from the labelled sample) and patterns (shouting, runs of
exclamation marks, masked words). A generative label model takes the first and second moments
of all votes over all documents and estimates, without looking at labels, each voter's hit
rates in both classes from the rank-one part of the votes' covariance; pairs whose covariance
exceeds it are correlated and count less. Its posteriors are the targets on which a linear
classifier over word and word-beginning features is trained; a logistic fit on the labelled
sample calibrates its margin. Only the classifier scores documents.

Bounds: `fitting.SAMPLE_ROWS` labelled rows for mining, training and calibration, VOCABULARY
features. The votes' moments cover all documents.

Defined results: null and empty texts have no features and get the score of the intercept;
without mined features the fixed list alone votes and trains; rows that repeat an id each get
a score; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ASCII_LOWER, materialise, pieces, span_hashes, table, windows, word_spans
from .fitting import SAMPLE_ROWS, labelled_sample, platt, remainder, sigmoid, without_copies

INSULTS = ("idiot", "moron", "stupid", "dumb", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "clown", "vermin", "filth")
VOCABULARY = 768
LEXICONS = 9
#: A mined entry is this much likelier in toxic text (log odds) and this clear (standard errors).
ODDS, CLEAR, SEEN = 2.5, 3.0, 3
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
HELD_OUT_PARTS = 3
#: Bytes of a long text whose features are held at once.
WINDOW = 1 << 20

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TAGS = {n: np.uint64(0x5851F42D4C957F2D ^ (n * 0x9E3779B9)) for n in BEGINNINGS}


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word and word beginning, A-Z lower-cased, with repeats."""
    data = _ASCII_LOWER[data]
    starts, ends, row = word_spans(data, at, _GAP)
    found, rows = [span_hashes(data, starts, ends)], [row]
    for n in BEGINNINGS:
        long = ends - starts > n
        found.append(span_hashes(data, starts[long], starts[long] + n) ^ _TAGS[n])
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(found)


def feature_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


class Lookup:
    """Which of a few features each of many hashes is."""

    def __init__(self, known: np.ndarray) -> None:
        self.order = np.argsort(known)
        self.known = known[self.order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positions in `known` of the distinct known features."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        right = self.known[place] == hashes
        pairs = np.unique(rows[right] * len(self.known) + self.order[place[right]])
        return pairs // len(self.known), pairs % len(self.known)


def known(look: Lookup, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of the distinct features that `look` knows; a long text is scanned window by window."""
    if len(at) > 2 or len(data) <= WINDOW:
        return look(*features(data, at))
    which = [look(*features(w, np.array([0, len(w)])))[1] for w in windows(data, WINDOW, _GAP)]
    which = np.unique(np.concatenate(which))
    return np.zeros(len(which), np.int64), which


@dataclass
class Voters:
    """known: features of all lexicons; lexicon: which one each belongs to."""

    known: np.ndarray
    lexicon: np.ndarray
    lexicons: int

    @property
    def names(self) -> list[str]:
        return [*[f"lexicon{i}" for i in range(self.lexicons)], "shouting", "exclaiming", "masked"]

    def votes(self, data: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """0 or 1 of each row and voter."""
        n = len(at) - 1
        out = np.zeros((n, self.lexicons + 3), np.float64)
        look = Lookup(self.known)
        rows, which = look(*found) if found else known(look, data, at)
        out[rows, self.lexicon[which]] = 1

        def count(mask: np.ndarray) -> np.ndarray:
            if n == 1:
                return np.array([np.count_nonzero(mask)])
            sums = np.concatenate(([0], np.cumsum(mask)))
            return sums[at[1:]] - sums[at[:-1]]

        upper = count((data >= 65) & (data <= 90))
        lower = count((data >= 97) & (data <= 122))
        out[:, -3] = (upper > 20) & (upper > lower)
        out[:, -2] = count(data == 33) >= 3
        star = data == 42
        masked = np.zeros(len(data), bool)
        letter = ~_GAP[data]
        if len(data) > 2:
            masked[1:-1] = star[1:-1] & letter[:-2] & letter[2:]
        out[:, -1] = count(masked) >= 1
        return out


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, Voters]:
    """Vocabulary, its log odds, and the voters; from doc_id, text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.asarray(b["label"].to_numpy(zero_copy_only=False), np.int64)
            for first, _, data, at in pieces(b["text"], 1 << 20):
                rows, found = features(data, at)
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                one = np.ones(len(rows), bool)
                one[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
                y = label[first + rows[one]]
                found = found[one]
                order = np.argsort(found, kind="stable")
                found, y = found[order], y[order]
                begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(y, begin) if len(found) else y
                total = np.diff(np.append(begin, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(found[begin].view(np.int64)), pa.array(toxic), pa.array(total - toxic)], ["feature", "toxic", "clean"])

    size = sample.groupBy("label").count().collect()
    n1, n0 = (sum(r["count"] for r in size if r["label"] == k) for k in (1, 0))
    counts = sample.select("label", "text").mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = counts.where(F.col("a") + F.col("b") >= SEEN).select("feature", "a", odds.alias("odds"), (odds / error).alias("z")).orderBy(F.abs("z").desc(), "feature").limit(VOCABULARY)
    rows = top.collect()
    fixed = np.array([feature_of(w) for w in INSULTS], np.uint64)
    mined = [np.uint64(r.feature & (2**64 - 1)) for r in rows if r.odds >= ODDS and r.z >= CLEAR and r.a >= SEEN]
    mined = [x for x in mined if x not in set(fixed)]
    known = np.concatenate((fixed, np.array(mined, np.uint64)))
    # Dealt round, so that every lexicon has entries of every kind and language.
    lexicon = np.arange(len(known)) % LEXICONS
    vocabulary = np.unique(np.concatenate((fixed, np.array([r.feature & (2**64 - 1) for r in rows], np.uint64))))
    share = np.array([n1, n0], float)
    return vocabulary, share, Voters(known, lexicon, LEXICONS)


def moments(docs: DataFrame, voters: Voters) -> tuple[float, np.ndarray]:
    """Documents, and the sums of products of votes, over all of `docs`; the last row and column are single votes."""
    size = len(voters.names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, size))
        for b in batches:
            for _, _, data, at in pieces(b["text"]):
                x = np.concatenate((voters.votes(data, at), np.ones((len(at) - 1, 1))), 1)
                sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(sums.reshape(-1))], ["cell", "value"])

    got = np.zeros(size * size)
    for r in docs.select("text").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        got[r.cell] = r.value
    got = got.reshape(size, size)
    return got[-1, -1], got


@dataclass
class LabelModel:
    """Hit rates in toxic and clean text, and how much each voter counts beside those it is correlated with."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    correlated: list[tuple[int, int]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        hit = np.log(self.toxic / self.clean) * self.weight
        miss = np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ hit + (1 - votes) @ miss)


def label_model(n: float, sums: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """From the votes' moments: covariance = d d' off the diagonal, but for correlated pairs."""
    n, prior = max(n, 1.0), min(max(prior, 1e-3), 0.5)
    mean = sums[-1, :-1] / n
    cov = sums[:-1, :-1] / n - np.outer(mean, mean)
    m = len(mean)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    use = ~np.eye(m, dtype=bool)
    live = mean > 0
    use &= live[:, None] & live[None, :]
    # A triplet of independent voters gives d_i^2 = c_ij c_ik / c_jk; the median bears a few correlated pairs.
    d = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if use[i, j]]
        seen = [cov[i, j] * cov[i, k] / cov[j, k] for j in others for k in others if j < k and cov[j, k] > 1e-9]
        d[i] = np.sqrt(max(0.0, float(np.median(seen)))) if seen else np.sqrt(max(0.0, cov[i, others].mean())) if others else 0.0
    linked = np.zeros((m, m), bool)
    rest = (cov - np.outer(d, d)) / np.outer(spread, spread)
    for _ in range(2):
        linked = use & (np.abs(rest) > 0.2)
        for _ in range(rounds):
            for i in range(m):
                others = use[i] & ~linked[i]
                weight = (d[others] ** 2).sum()
                d[i] = max(0.0, (cov[i, others] * d[others]).sum() / weight) if weight > 0 else 0.0
        rest = (cov - np.outer(d, d)) / np.outer(spread, spread)
    toxic = np.clip(mean + d * np.sqrt((1 - prior) / prior), 1e-4, 1 - 1e-4)
    clean = np.clip(mean - d * np.sqrt(prior / (1 - prior)), 1e-4, 1 - 1e-4)
    toxic = np.maximum(toxic, clean)
    weight = 1 / (1 + np.where(linked, np.clip(rest, 0, 1), 0).sum(1))
    return LabelModel(prior, toxic, clean, weight, [(i, j) for i in range(m) for j in range(i) if linked[i, j]])


def train_linear(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, size: int, steps: int = 12, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic fit of posteriors on binary features, by Newton's method.

    rows ascend. The curvature is summed over blocks of rows, so memory follows the vocabulary.
    """
    w, n = np.zeros(size + 1), len(target)
    hold = np.append(np.full(size, ridge), 1e-6)

    def cost(w: np.ndarray) -> float:
        m = np.bincount(rows, w[columns], minlength=n) + w[-1]
        return float(np.sum(np.logaddexp(0, m) - target * m) + (hold * w * w).sum() / 2)

    for _ in range(steps if n else 0):
        gradient, curve = hold * w, np.diag(hold)
        for begin in range(0, n, 4096):
            end = min(n, begin + 4096)
            i, j = np.searchsorted(rows, (begin, end))
            x = np.zeros((end - begin, size + 1), np.float32)
            x[rows[i:j] - begin, columns[i:j]] = 1
            x[:, -1] = 1
            p = sigmoid(x @ w)
            gradient += x.T @ (p - target[begin:end])
            curve += (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x
        step, before, share = np.linalg.solve(curve + 1e-6 * np.eye(size + 1), gradient), cost(w), 1.0
        while share > 1e-4 and cost(w - share * step) > before:
            share /= 2
        w = w - share * step
        if share * np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, which = known(Lookup(self.vocabulary), data, at)
        return np.bincount(rows, self.weights[which], minlength=len(at) - 1) + self.intercept

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(data, at) * self.slope + self.shift)


def fit(docs: DataFrame, labels: DataFrame, train=None, rows: int = SAMPLE_ROWS, label: str = "toxic") -> Model:
    sample = materialise(without_copies(labelled_sample(docs, labels, label, F.lit(True) if train is None else train, rows)), "toxic-sample")
    vocabulary, (n1, n0), voters = mine(sample)
    prior = (n1 + 1) / (n1 + n0 + 2)
    model = label_model(*moments(docs, voters), prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(vocabulary)
        for b in batches:
            label = b["label"].to_pylist()
            for first, last, data, at in pieces(b["text"], 1 << 20):
                found = features(data, at)
                posterior = model.posterior(voters.votes(data, at, found))
                rows, which = look(*found)
                cut = np.searchsorted(rows, np.arange(last - first + 1))
                yield pa.RecordBatch.from_pylist([{"label": label[first + i], "posterior": float(posterior[i]), "which": which[cut[i] : cut[i + 1]].tolist()} for i in range(last - first)], pa.schema([("label", pa.int32()), ("posterior", pa.float64()), ("which", pa.list_(pa.int32()))]))

    told = sample.orderBy("doc_id").select("label", "text").mapInArrow(run, "label int, posterior double, which array<int>").toPandas()
    if told.empty:
        told = told.assign(which=[])
    rows = np.repeat(np.arange(len(told)), [len(x) for x in told["which"]]).astype(np.int64)
    columns = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in told["which"]]])
    y, target = told["label"].to_numpy(float), told["posterior"].to_numpy(float)
    weights, intercept = train_linear(rows, columns, target, len(vocabulary))
    if not len(told):
        weights = np.where(np.isin(vocabulary, voters.known), 4.0, 0.0)
        return Model(vocabulary, weights, -2.0, 1.0, 0.0)
    margin = np.bincount(rows, weights[columns], minlength=len(told)) + intercept
    slope, shift = platt(margin, y if len(set(y)) == 2 else target)
    return Model(vocabulary, weights, intercept, slope, shift)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `score` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.scores(data, at) for _, _, data, at in pieces(b["text"])]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(np.concatenate([np.zeros(0), *out]))], [*keep, "score"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, f"{fields}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that score under `threshold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.scores(data, at) for _, _, data, at in pieces(b["text"])]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *out]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), HELD_OUT_PARTS) == 1
    found = score(docs, fit(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
