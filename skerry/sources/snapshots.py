"""Snapshots of tables and vector spaces that are only read back by what made them, and column-wise exports."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_space"


@dataclass(frozen=True)
class Space:
    """What a vector means: who made it, and how. Two spaces are one if all of this is equal."""

    name: str
    dimensions: int
    metric: str
    producer: str
    version: str
    representation: str = "float"
    preprocess: str = ""

    @property
    def identity(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def registered(spaces: DataFrame, space: Space) -> tuple[DataFrame, int]:
    """The registry (space_id, identity, spec) with this space in it, and its id: the one it has, else the next."""
    known = spaces.where(F.col("identity") == space.identity).select("space_id").limit(1).collect()
    if known:
        return spaces, known[0].space_id
    last = spaces.agg(F.coalesce(F.max("space_id"), F.lit(0))).first()[0]
    row = spaces.sparkSession.createDataFrame([(last + 1, space.identity, json.dumps(asdict(space), sort_keys=True))], spaces.schema)
    return spaces.unionByName(row), last + 1


def write(rows: DataFrame, path: str, space: Space) -> None:
    """Rows as Parquet; what made them, and how many they are, is written last, so half a snapshot has no mark."""
    rows.write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    n = spark.read.schema(rows.schema).parquet(f"{path}/rows").count()
    spark.createDataFrame([(space.identity, n, rows.schema.json())], "identity string, n long, schema string").coalesce(1).write.json(f"{path}/{MARK}")


def restore(spark: SparkSession, path: str, space: Space) -> DataFrame | None:
    """The rows of a snapshot, or None: no mark, another maker, other columns, or another number of rows."""
    from pyspark.sql.types import StructType

    try:
        mark = spark.read.schema("identity string, n long, schema string").json(f"{path}/{MARK}").first()
    except AnalysisException:
        return None
    if mark is None or mark.identity != space.identity:
        return None
    rows = spark.read.schema(StructType.fromJson(json.loads(mark.schema))).parquet(f"{path}/rows")
    return rows if rows.count() == mark.n else None


def included(rows: DataFrame, always: tuple[str, ...], optional: tuple[str, ...], asked: tuple[str, ...]) -> DataFrame:
    """`rows` with the optional columns that weren't asked for set to null."""
    return rows.select(*always, *[F.when(F.lit(c in asked), F.col(c)).alias(c) for c in optional])
