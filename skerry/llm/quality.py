"""Quality by compression: two zstandard dictionaries, one built from good and one from bad text.

A text is cut into blocks and each block is compressed with both dictionaries; the normalised
difference of the summed sizes, (bad - good) / (bad + good), tells which kind it resembles.
A logistic fit on the labelled sample turns the difference into the probability of label 1.

The dictionaries are built from at most `SAMPLE_ROWS` labelled rows, from the whole text of
each, cut into chunks; the calibration and every score compress whole texts. Where the trainer
finds too little text for a dictionary, the text itself, or its end, is the dictionary.

Defined results: null and empty texts have difference 0; without labels of both kinds every
score is the share of label 1 (0.5 without any label); rows that repeat an id each get a
score; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pieces, table
from .fitting import labelled_sample, platt, remainder, without_copies

#: Labelled rows used at most.
SAMPLE_ROWS = 6000
DICTIONARY_BYTES = 65_536
CHUNK = 512
LEVEL = 3
BLOCK = 4096
THRESHOLD = 0.3
HELD_OUT_PARTS = 5


def train_dictionary(chunks: list[bytes]) -> bytes:
    """A dictionary's bytes; samples that the trainer refuses become the dictionary themselves."""
    import zstandard

    chunks = [c for c in chunks if len(c) >= 8]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, chunks)) // 8))
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:]


class Meter:
    """Differences of whole texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self.both = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            if own:
                own.precompute_compress(level=LEVEL)
            settings = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, **settings) if own else zstandard.ZstdCompressor(level=LEVEL, **settings))

    def difference(self, text: bytes) -> float:
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.both)
        return (bad - good) / (bad + good) if text else 0.0


def measured(docs: DataFrame, good: bytes, bad: bytes, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns and `difference` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(good, bad)
        for b in batches:
            out = np.zeros(b.num_rows)
            for first, last, data, at in pieces(b["text"]):
                whole = data.tobytes()
                for i in range(last - first):
                    out[first + i] = meter.difference(whole[at[i] : at[i + 1]])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(out)], [*keep, "difference"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, difference double")


def sample_chunks(sample: DataFrame) -> list[tuple[int, bytes]]:
    """Label and bytes of every chunk of every sampled text, in an order that mixes documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, label, x in zip(b["doc_id"].to_pylist(), b["label"].to_pylist(), b["text"], strict=True):
                raw = (x.as_py() or "").encode()
                rows = [{"doc_id": doc, "label": label, "chunk": raw[i : i + CHUNK]} for i in range(0, len(raw), CHUNK)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("chunk", pa.binary())]))

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, chunk binary").toArrow()
    rows = zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), found["chunk"].to_pylist(), strict=True)
    return [(label, chunk) for _, _, chunk, label in sorted((doc * 2654435761 % 2**31, doc, chunk, label) for doc, label, chunk in rows)]


def fit(docs: DataFrame, labels: DataFrame, train=None, rows: int = SAMPLE_ROWS, label: str = "quality") -> tuple[bytes, bytes, float, float]:
    """Good and bad dictionary, slope and intercept."""
    sample = materialise(without_copies(labelled_sample(docs, labels, label, F.lit(True) if train is None else train, rows)), "quality-sample")
    chunks = sample_chunks(sample)
    good, bad = (train_dictionary([c for y, c in chunks if y == kind]) for kind in (1, 0))
    told = measured(sample, good, bad, ("label",)).toPandas()
    y = told["label"].to_numpy(float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return good, bad, 0.0, float(np.log(share / (1 - share)))
    return good, bad, *platt(told["difference"].to_numpy(), y)


def score(docs: DataFrame, model: tuple[bytes, bytes, float, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    good, bad, slope, intercept = model
    found = measured(docs, good, bad, keep)
    return found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("difference") * slope + intercept))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), HELD_OUT_PARTS) == 0
    found = score(docs, fit(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
