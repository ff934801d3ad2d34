"""The driver's contract, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None or v != v else f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in table)


def own():
    return sorted(entry._own()[1])


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def stages_once(spark):
    """The stages of the pose chain are computed once for all queries that end in different ones."""
    from plumbline.plans import pose, pose_queries

    with pytest.MonkeyPatch.context() as patch:
        drawn = pose_queries.keypoints(spark, SF).cache()
        cleaned = pose.clean(drawn).cache()
        clean = pose.clean
        patch.setattr(pose_queries, "keypoints", lambda spark, sf_dir: drawn)
        patch.setattr(pose, "clean", lambda rows: cleaned if rows is drawn else clean(rows))
        measured = pose_queries.measured(spark, SF).cache()
        patch.setattr(pose_queries, "measured", lambda spark, sf_dir: measured)
        yield
        for df in (measured, cleaned, drawn):
            df.unpersist()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).collect()


@pytest.mark.parametrize("name", own())
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
