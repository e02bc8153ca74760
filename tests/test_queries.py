"""Every sheet query against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from sheetframe import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted((tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert cols == sorted(names)
    expected = norm(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == expected


@pytest.mark.parametrize(("sf", "name", "key", "text", "longest"), [("sf0.01", "documents", "doc_id", "text", 33_047), ("sf0.1", "pages", "page_id", "html", 60_113)])
def test_whole_texts(spark, sf, name, key, text, longest):
    """Texts longer than a cell of Excel are written and read to their ends."""
    place = f"/root/testdata/{sf}"
    want = {r[key]: r[text] for r in spark.read.parquet(f"{place}/{name}.parquet").collect()}
    rows = Q.queries()[f"scan_{name}"](spark, place).collect()
    assert max(map(len, want.values())) == longest and len(rows) == len(want) and {r[key]: r[text] for r in rows} == want
