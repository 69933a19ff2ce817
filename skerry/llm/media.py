"""Interleaved documents: ordered text and media references, resolved by digest.

`parse` turns HTML into one ordered sequence per document. Text runs and media references
are structs of one array; an element's place in the array is its position, and an image's
caption (its `figcaption`, else its `alt`) travels in the image's own struct, so neither can
shift against the other. `resolve` joins the references to a content-addressed media store by
digest. What is wanted of a payload is computed where the payload is read, and only that
crosses the network; payloads themselves are never shuffled.

A store keeps 8-bit grey images as PNG, `WIDTH` samples a row; `write_store` packs any bytes
as such an image without loss (one filter byte a row, deflate). Tasks write their own distinct
payloads; a payload that several tasks hold is stored more than once under one digest and
counts once when read.

Defined results: null or empty HTML gives an empty sequence; a reference whose digest isn't
in the store stays, with null features; a figure without caption has a null caption; the same
reference twice is two elements; null text is an empty payload, hence one row of spaces; rows
that repeat an id each return a row; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as markup
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, pieces, table

WIDTH = 192
SCHEME = "sha256:"
ELEMENTS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
ELEMENTS_DDL = "array<struct<kind: string, text: string, digest: string, caption: string>>"
SKIPPED = ("script", "style", "template", "noscript")
BLOCKS = ("p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "section", "article", "blockquote", "figure")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
STORE_DDL = "digest string, width int, height int, stored binary"


class Interleaver(HTMLParser):
    """Collects text and media in document order; a figure's caption goes to all media in it.

    A figcaption may stand before or behind its media and ends with its figure at the latest;
    outside a figure it is text like any other. What stands in a skipped element is left out:
    up to its end tag, or the end of an element around it. A noscript or template that nothing
    ends is taken as text, so that a missing tag doesn't swallow the rest of a page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.text: list[str] = []
        #: Open figures: place of the first element, caption texts, and whether its figcaption is open.
        self.figures: list[dict] = []
        self.open: list[str] = []
        #: Of the outermost skipped element: its depth, and what there was before it.
        self.skipped: tuple | None = None

    def flush(self) -> None:
        run = "".join(self.text).strip("\x20\t\n\x0b\x0c\r")
        self.text = []
        if run:
            self.found.append({"kind": "text", "text": run, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in VOID:
            self.open.append(tag)
        if tag in SKIPPED:
            if self.skipped is None:
                self.skipped = (len(self.open), len(self.found), list(self.text), [x | {"said": list(x["said"])} for x in self.figures])
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1]["open"] = True
        elif tag in ("img", "video", "audio", "source"):
            own = dict(attrs)
            if (own.get("src") or "").startswith(SCHEME):
                self.flush()
                self.found.append({"kind": "media", "text": None, "digest": own["src"].removeprefix(SCHEME).lower(), "caption": own.get("alt")})
        elif tag in BLOCKS:
            self.flush()
            self.handle_data(" ")
            if tag == "figure":
                self.figures.append({"at": len(self.found), "said": [], "open": False})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if self.skipped and len(self.open) < self.skipped[0]:
                self.discard()
        if tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1]["open"] = False
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()

    def end_figure(self) -> None:
        figure = self.figures.pop()
        said = " ".join("".join(figure["said"]).split())
        for x in self.found[figure["at"] :]:
            if said and x["kind"] == "media" and not x.get("told"):
                x["caption"], x["told"] = said, True

    def discard(self) -> None:
        _, n, self.text, self.figures = self.skipped
        self.skipped = None
        del self.found[n:]

    def handle_data(self, data: str) -> None:
        if any(x in ("script", "style") for x in self.open[-1:]):
            return
        figure = next((x for x in reversed(self.figures) if x["open"]), None)
        (figure["said"] if figure else self.text).append(data)

    def close(self) -> None:
        super().close()
        self.flush()
        while self.figures:
            self.end_figure()
        for x in self.found:
            x.pop("told", None)


def sequence(source: str | None) -> list[dict]:
    """A document's ordered elements."""
    reader = Interleaver()
    reader.feed(source or "")
    reader.close()
    return reader.found


def parse(docs: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """`keep` columns and `elements` of every row of `docs` (…, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = pa.array([sequence(x.as_py()) for x in b["html"]], ELEMENTS)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], seen], [*keep, "elements"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "html").mapInArrow(run, f"{fields}, elements {ELEMENTS_DDL}")


def references(parsed: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per media element: `keep`, its position in the sequence, digest and caption."""
    spread = parsed.select(*keep, F.posexplode("elements").alias("position", "e"))
    return spread.where("e.kind = 'media'").select(*keep, "position", "e.digest", "e.caption")


# -- the store ------------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: np.ndarray, width: int = WIDTH) -> bytes:
    """An 8-bit grey image whose samples are `payload`, a positive multiple of `width`."""
    rows = payload.reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 5)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The rows of samples of an 8-bit grey image that to_png wrote; checks every chunk's sum."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit grey images without interlacing are kept")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are kept")
    return raw[:, 1:]


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


def write_store(texts: DataFrame, folder: str, width: int = WIDTH) -> None:
    """Store the padded text of every row of `texts` (text) under its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for _, _, data, at in pieces(b["text"]):
                out = []
                for i in range(len(at) - 1):
                    payload = padded(data[at[i] : at[i + 1]].tobytes(), width)
                    digest = hashlib.sha256(payload)
                    if digest.digest() in seen:
                        continue
                    if len(seen) >= 200_000:  # forgetting only stores a payload again
                        seen.clear()
                    seen.add(digest.digest())
                    out.append({"digest": digest.hexdigest(), "width": width, "height": len(payload) // width, "stored": to_png(np.frombuffer(payload, np.uint8), width)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("stored", pa.binary())]))

    texts.select("text").mapInArrow(run, STORE_DDL).write.mode("append").option("compression", "uncompressed").parquet(folder)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STORE_DDL).parquet(folder)


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored payload: lengths, digests, and a feature of 16 histogram shares, mean and row contrast."""
    for b in batches:
        out = []
        for digest, stored in zip(b["digest"].to_pylist(), b["stored"], strict=True):
            stored = stored.as_py()
            rows = from_png(stored)
            x = np.ascontiguousarray(rows).reshape(-1)
            shares = np.bincount(x >> 4, minlength=16) / len(x)
            contrast = float(np.abs(np.diff(rows.astype(np.int16), axis=1)).mean()) if rows.shape[1] > 1 else 0.0
            feature = ",".join(f"{v:.4f}" for v in [*shares, float(x.mean()) / 255, contrast / 255])
            out.append({"digest": digest, "payload_bytes": len(x), "payload_sha256": hashlib.sha256(x).hexdigest(), "tail_crc32": zlib.crc32(x[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature})
        yield pa.RecordBatch.from_pylist(out, FEATURES)


FEATURES = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_DDL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def resolve(refs: DataFrame, store: DataFrame, measure: Callable = feature_rows, ddl: str = FEATURES_DDL) -> DataFrame:
    """`refs` (digest, …) with what `measure` finds in the payload of each reference's digest."""
    measured = store.select("digest", "stored").mapInArrow(measure, ddl).dropDuplicates(["digest"])
    return refs.join(measured, "digest", "left")


def as_page(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page for each text: the whole text, then a figure that holds it as media."""
    for b in batches:
        pages, sizes = [], []
        for x in b["text"]:
            text = x.as_py() or ""
            raw = text.encode()
            digest = hashlib.sha256(padded(raw)).hexdigest()
            pages.append(f'<article><p>{markup.escape(text, quote=False)}</p><figure><img src="{SCHEME}{digest}" alt="text"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "media")
    write_store(docs, folder)
    pages = docs.mapInArrow(as_page, "doc_id long, n_bytes long, html string")
    refs = references(parse(pages, ("doc_id", "n_bytes")), ("doc_id", "n_bytes"))
    refs = materialise(refs, "media-refs")
    found = resolve(refs, read_store(spark, folder))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
