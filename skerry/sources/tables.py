"""Tables by name, and what role a table's columns play in a question."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class TableSpec:
    """A table as a library of items: its id, its moment, its kind, and its sortable columns."""

    name: str
    id: str
    kind: str | None = None
    moment: str | None = None
    sorts: tuple[str, ...] = field(default=())

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, self.name)


DOCUMENTS = TableSpec("documents", "doc_id", kind="lang", sorts=("n_chars", "lang", "source"))
EVENTS = TableSpec("events", "event_id", kind="event_type", moment="ts", sorts=("value", "user_id"))
ORDERS = TableSpec("orders", "o_orderkey", kind="o_orderstatus", moment="o_orderdate", sorts=("o_totalprice", "o_orderpriority"))
SPECS = {s.name: s for s in (DOCUMENTS, EVENTS, ORDERS)}


def seconds(moment: Column) -> Column:
    """A moment without zone as epoch seconds, fraction kept; the session's zone is UTC."""
    return moment.cast("timestamp").cast("double")


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))
