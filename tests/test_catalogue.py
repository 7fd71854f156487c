"""Every catalogue query that has SQL, held against DuckDB over the same tables."""

import duckdb
import pytest

from quarrystone.plans import admin, catalogue
from quarrystone.sources.adapters import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    expected_columns = [c[0] for c in found.description]
    expected = found.fetchall()
    assert sorted(expected_columns) == columns
    place = [expected_columns.index(c) for c in columns]
    assert canonical([tuple(r) for r in df.select(*columns).collect()]) == canonical([tuple(r[i] for i in place) for r in expected])


def test_every_query_has_sql_but_chunks():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"component_links", "component_texts", "document_chunks", "page_sections", "section_chunks"}


def test_coverage_gaps_take_all_types(spark, monkeypatch):
    tables = {"product": spark.createDataFrame([("B1", f"t{i}") for i in range(1200)] + [("B1", None)], "bank_code string, product_type string"), "bank": spark.createDataFrame([("B1", "C"), ("B2", "C")], "bank_code string, country_code string")}
    monkeypatch.setattr(admin, "read", lambda spark, sf_dir, name: tables[name])
    got = {(r.bank_code, r.product_type) for r in catalogue.queries()["coverage_gaps"](spark, "").collect()}
    assert got == {("B2", f"t{i}") for i in range(1200)} | {("B1", None), ("B2", None)}
