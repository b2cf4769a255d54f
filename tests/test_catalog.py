"""Every registered query with SQL equals that SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sievelake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if x is None or x is pd.NA or x != x else round(float(x), 9) if isinstance(x, float) else str(x) for x in df[c]]
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if sql := catalog.ORACLE_SQL.get(name):
        pd.testing.assert_frame_equal(normal(got), normal(con.sql(sql).df()))
    assert len(got)


def test_greedy_query(spark):
    """The query without SQL against the rule by hand."""
    events = duckdb.sql(f"SELECT user_id, event_type, event_id FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall()
    stand, marked = {}, set()
    for found in (0, 1):
        for u, t, i in events:
            if i % 2 == found:
                mine = stand.setdefault((u, t), [])
                hit = next((s for s in mine if abs(s % 997 - i % 997) <= 5), None) if found else None
                marked.add(hit) if hit is not None else mine.append(i)
    alive = {i for ids in stand.values() for i in ids}
    for r in catalog.QUERIES["correlate_greedy"](spark, DATA).collect():
        assert (r.keep, r.marked) == (r.event_id in alive, r.event_id in marked)
