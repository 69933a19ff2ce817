"""The SQL of the text operators, on the test tables and on awkward rows."""

import os

import duckdb
import pytest

from skerry.llm import registry

from .conftest import AWKWARD


def plain(rows):
    return sorted(tuple(f"{float(v):.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def both(spark, folder, name):
    found = registry.QUERIES[name](spark, folder)
    names = sorted(found.columns)
    duck = duckdb.connect()
    for file in os.listdir(folder):
        at = f"{folder}/{file}" + ("/*.parquet" if os.path.isdir(f"{folder}/{file}") else "")
        duck.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{at}')")
    sql = duck.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return plain(tuple(r) for r in found.select(*names).collect()), plain(sql)


@pytest.fixture(scope="module")
def awkward_dir(spark, awkward, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    pages = [(i, u, t) for i, (u, (_, t)) in enumerate(zip(["http://A.net/x", None, "", "no", "://", "http://", "https://w.example.net/en/q?r", "http://example.com/de/#f", "x://org/fr/", "y://b.org/fr", "z://é.net/", "http://n.net?q", "u", "v"], AWKWARD, strict=True))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, awkward_dir, name):
    for folder in (sf_dir, awkward_dir):
        got, want = both(spark, folder, name)
        assert got == want
        assert got
