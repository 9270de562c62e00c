"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from palimpsest import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    answer = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert columns == sorted(names)
    assert ours == sorted(([plain(r[names.index(c)]) for c in columns] for r in answer.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_report_of_documents_reads_numbers_of_all_regions(spark, tmp_path):
    docs = spark.createDataFrame([(3, "call 8 4951234567 or 74951234567 or +1 (212) 555-0199"), (5, "74951234567"), (6, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["report_of_documents"](spark, str(tmp_path)).collect()
    assert {(r.kind, r.value, r.sightings) for r in rows} == {("phone", "+74951234567", 2), ("phone", "+12125550199", 1)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[:2] for r in con.execute(catalogue.ORACLES["report_of_documents"]).fetchall()} == {("phone", "+74951234567"), ("phone", "+12125550199")}
