"""Every named query against its SQL on the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from leafline.plans.oracles import oracle_sql
from leafline.plans.queries import ALL

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, duck, name):
    got, want = ALL[name](spark, small).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_but_custom_have_sql():
    assert set(ALL) - set(ORACLES) == {"hull_rect", "det_boxes", "managed_queue"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_region_counters_in_rounds(spark, small, duck, monkeypatch):
    """Rounds give the same rows as one; of each only its counters stay, and no round writes half of all boxes at once."""
    from leafline import session
    from leafline.plans import queries

    made = []

    def cut(df, what, f=session.cut):
        out = f(df, what)
        made.append((what, out.count()))
        return out

    monkeypatch.setattr(queries, "ROUND_PAGES", 15)
    monkeypatch.setattr(queries, "cut", cut)
    before = len(session._MADE)
    got, want = ALL["region_counters"](spark, small), duck.sql(ORACLES["region_counters"]).df()
    assert rows(got.toPandas()) == rows(want)
    assert len(session._MADE) - before == queries.ROUNDS
    boxes = [n for what, n in made if what == "counters-boxes"]
    assert len(boxes) == queries.ROUNDS and sum(boxes) == duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0] and 2 * max(boxes) < sum(boxes)
    assert spark.conf.get(session._FREE, None) is None


def test_freed_puts_the_setting_back(spark):
    from leafline import session

    spark.conf.set(session._FREE, "false")
    with session.freed(spark):
        assert spark.conf.get(session._FREE) == "true"
    assert spark.conf.get(session._FREE) == "false"
    spark.conf.unset(session._FREE)
