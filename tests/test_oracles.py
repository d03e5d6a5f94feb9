"""Every query that has SQL against DuckDB on the smallest tables; the others by their shape and what must hold."""

import os

import duckdb
import pytest

from sparkomics.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    shown = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(shown(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalogue.ORACLES[name]).df())
    assert len(got)


@pytest.mark.parametrize("name", ["fs_pls", "fs_plsvip_2", "fs_rfe", "plslda_predict", "svm_cv", "tune_plsc", "cor_hcl", "mds_manhattan", "smooth_line", "stats_mat_rounded"])
def test_query_without_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if "fs_rank" in got:
        assert sorted(got["fs_rank"]) == list(range(1, len(got) + 1))
        ordered = got.sort_values("fs_rank")["stat"]
        assert (ordered.diff().dropna() <= 1e-9).all()
    for c in ("acc", "err", "pval", "p_max"):
        if c in got:
            assert got[c].dropna().between(0, 1).all()


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
