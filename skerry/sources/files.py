"""Files as a source: kind by suffix, format by the first bytes, a walk with content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind.
KINDS = {
    "image": "png jpg jpeg jpe jfif jif webp bmp dib tif tiff avif jxl heic heif hif heics heifs jp2 j2k jpf jpx mpo psd"
    " 3fr arw cap cr2 cr3 crw dcr dng erf fff iiq k25 kdc mrw nef nrw orf ori pef raf rw2 rwl sr2 srf srw",
    "animated_image": "gif apng",
    "video": "mp4 m4v mov qt mkv webm avi divx mpg mpeg mpe m2v mjpeg mjpg ogv ogm vob ts mts m2ts m2t 3gp 3gpp wmv asf flv f4v mxf rm rmvb",
    "audio": "mp3 mp2 wav flac m4a ogg oga mka weba caf au opus aac wma aiff aif",
    "document": "pdf",
}
#: Bytes of a file's beginning that are looked at.
HEAD = 512
#: Fixed values: (format, kind, regular expression over the beginning's hex digits); the first that fits counts.
MAGIC = (
    ("png", "image", "^89504E470D0A1A0A"),
    ("jpeg", "image", "^FFD8FF"),
    ("gif", "image", "^47494638(37|39)61"),
    ("bmp", "image", "^424D"),
    ("webp", "image", "^52494646.{8}57454250.{4}"),
    ("avi", "video", "^52494646.{8}41564920.{4}"),
    ("wav", "audio", "^52494646.{8}57415645.{4}"),
    ("tiff", "image", "^(49492A00|4D4D002A)"),
    ("jxl", "image", "^(FF0A|0000000C4A584C200D0A870A)"),
    ("psd", "image", "^38425053"),
    ("jp2", "image", "^(0000000C6A502020|FF4FFF51)"),
    # The container of films, by its first brand: avif avis; heic heix hevc hevx heif mif1 msf1; crx; M4A M4B M4P F4A F4B; qt; 3gp.
    ("avif", "image", "^.{8}66747970(61766966|61766973)"),
    ("heif", "image", "^.{8}66747970(68656963|68656978|68657663|68657678|68656966|6D696631|6D736631|63727820)"),
    ("m4a", "audio", "^.{8}66747970(4D3441|4D3442|4D3450|463441|463442)20"),
    ("mov", "video", "^.{8}667479707174"),
    ("3gp", "video", "^.{8}66747970336770"),
    ("mp4", "video", "^.{8}66747970.{8}"),
    ("matroska", "video", "^1A45DFA3"),
    ("flv", "video", "^464C56"),
    ("rm", "video", "^2E524D46"),
    ("mpeg-ps", "video", "^000001BA"),
    ("mpeg-ts", "video", "^47.{374}47"),
    ("mxf", "video", "^060E2B34020501010D0102010102"),
    ("asf", "video", "^3026B2758E66CF11A6D900AA0062CE6C"),
    ("ogg", "audio", "^4F676753"),
    ("flac", "audio", "^664C6143"),
    # A tag, or a frame: eleven sync bits, a layer, and a bit rate that is neither free nor bad.
    ("mp3", "audio", "^(494433|FF[EF][2-7A-F][1-9A-E].{3})"),
    ("aiff", "audio", "^464F524D.{8}(41494646|41494643)"),
    ("aac-adts", "audio", "^FF(F1|F9)"),
    ("pdf", "document", "^255044462D"),
)
#: Content type of each format.
MIME = {
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff",
    "jxl": "image/jxl", "psd": "image/vnd.adobe.photoshop", "jp2": "image/jp2", "avif": "image/avif", "heif": "image/heif",
    "mp4": "video/mp4", "mov": "video/quicktime", "3gp": "video/3gpp", "matroska": "video/x-matroska", "flv": "video/x-flv",
    "rm": "application/vnd.rn-realmedia", "mpeg-ps": "video/mpeg", "mpeg-ts": "video/mp2t", "mxf": "application/mxf",
    "asf": "video/x-ms-asf", "avi": "video/x-msvideo", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac",
    "mp3": "audio/mpeg", "aiff": "audio/aiff", "aac-adts": "audio/aac", "pdf": "application/pdf",
}
UNKNOWN = "application/octet-stream"


def kind_of_name(name: Column) -> Column:
    """Kind by the name's last suffix, or null."""
    pairs = [F.lit(x) for kind, all_of in KINDS.items() for s in all_of.split() for x in (s, kind)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index(name, ".", -1)))


def sniffed(content: Column) -> Column:
    """Struct of format and kind by the first bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, HEAD))
    out = F.lit(None).cast("struct<format: string, kind: string>")
    for name, kind, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), F.struct(F.lit(name).alias("format"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def content_type(format: Column) -> Column:
    """The type to serve a sniffed format with."""
    pairs = [F.lit(x) for pair in MIME.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), format), F.lit(UNKNOWN))


def observed(spark: SparkSession, roots: dict[str, str], pattern: str = "*") -> DataFrame:
    """root, path (under its root), size, modified, format, kind, sha256 of the files of several roots, as one observation."""
    parts = [walk(spark, at, pattern).withColumn("root", F.lit(name)).withColumn("path", F.regexp_extract("path", r"(?s)" + _quoted(at.rstrip("/")) + r"/(.*)$", 1)) for name, at in sorted(roots.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(text: str) -> str:
    import re

    return re.escape(text.removeprefix("file://"))


def walk(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, format, kind, sha256 of all files under `folder` that have bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    known = sniffed(F.col("content"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), known["format"].alias("format"), F.coalesce(known["kind"], kind_of_name(F.col("path"))).alias("kind"), F.sha2("content", 256).alias("sha256"))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are left out."""
    df.write.mode("errorifexists").json(path)


def sidecar(text: Column) -> Column:
    """Map from dotted key to value of all leaves of a JSON object; null for what is none. Array places count from 0."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def leaves(value: object, at: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        elif value is not None:
            yield at, value if isinstance(value, str) else json.dumps(value)

    def read(raw: str | None) -> dict[str, str] | None:
        try:
            value = json.loads(raw) if raw else None
        except ValueError:
            return None
        return dict(leaves(value, "")) if isinstance(value, dict) else None

    # Nesting of any depth is beyond from_json, which wants a schema.
    return F.pandas_udf(lambda rows: pd.Series([read(x) for x in rows], dtype=object), "map<string,string>")(text)
