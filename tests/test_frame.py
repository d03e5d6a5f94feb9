"""Long frames: missing values, ties, empty tables, clashing names, hot keys; distributed totals against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.functions import lists
from sparkomics.operators import evaluate, frame, plotdata, prep, rank, resample, summary
from sparkomics.sources import tables

LONG = "sample_id long, cls string, feature string, feature_idx int, value double"


def hot(spark, n=3000, share=3):
    """Values of which a third are one value, with ties elsewhere."""
    rng = np.random.default_rng(1)
    values = [0.0 if i % share == 0 else float(rng.integers(0, 500)) / 7 for i in range(n)]
    return values, spark.createDataFrame([(i, "ab"[i % 2], v) for i, v in enumerate(values)], "id long, k string, v double")


def test_running_totals_with_ties_and_a_hot_value(spark):
    values, df = hot(spark)
    got = {r.id: r.before_one for r in frame.running_totals(df.withColumn("one", F.lit(1)), ["k"], "v", ["one"], tie="id", buckets=8).collect()}
    for k in (0, 1):
        for place, i in enumerate(sorted((i for i in range(len(values)) if i % 2 == k), key=lambda i: (values[i], i))):
            assert got[i] == place


def test_running_totals_on_an_empty_table(spark):
    _, df = hot(spark, 10)
    assert frame.running_totals(df.where("id < 0").withColumn("one", F.lit(1)), ["k"], "v", ["one"], tie="id").collect() == []


def test_attach_falls_back_beyond_the_bound(spark, monkeypatch):
    _, df = hot(spark, 200)
    means = df.groupBy("k").agg(F.avg("v").alias("m"))
    want = sorted(map(tuple, frame.attach(df, means, ["k"]).collect()))
    monkeypatch.setattr(frame, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, frame.attach(df, means, ["k"]).collect())) == want


def test_auc_with_ties_follows_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 4)), int(rng.integers(0, 2))) for i in range(400)]
    got = evaluate.auc(spark.createDataFrame(rows, "sample_id long, stat double, positive int")).first()
    seen, above = 0, []
    for _, _, p in sorted(rows, key=lambda r: (-r[1], r[0])):
        seen += p
        if not p:
            above.append(seen)
    want = np.mean(above) / seen
    assert abs(got.raw_auc - want) < 1e-12 and abs(got.auc - max(want, 1 - want)) < 1e-12


def test_nulls_constant_features_and_single_rows(spark):
    rows = [(1, "a", "x", 0, 1.0), (2, "a", "x", 0, None), (3, "b", "x", 0, 5.0), (4, None, "x", 0, 2.0), (1, "a", "c", 1, 3.0), (2, "a", "c", 1, 3.0), (3, "b", "c", 1, 3.0), (4, "b", "c", 1, 3.0), (1, "a", "n", 2, None)]
    long = spark.createDataFrame(rows, LONG)
    welch = {r.feature: r for r in rank.fs_welch(long).collect()}
    assert welch["c"].stat is None and welch["x"].stat is None
    assert {r.feature for r in prep.preproc_const(long.where("feature <> 'n'")).collect()} <= {"x"}
    assert [r.value for r in prep.preproc(long, "auto").where("feature = 'c'").collect()] == [None] * 4
    filled = {(r.sample_id, r.feature): r.value for r in prep.mv_fill(long).collect()}
    assert filled[2, "x"] == 8 / 3 and filled[1, "n"] is None
    for f in (rank.fs_anova, rank.fs_kruskal, rank.fs_auc, rank.fs_wilcox, rank.fs_bw, rank.fs_snr):
        f(long).collect()
        assert f(long.limit(0)).collect() == []
    assert summary.vec_summ_1(long).where("feature = 'n'").first().mean is None


def test_kruskal_and_wilcoxon_on_small_data(spark):
    rows = [(i, "ab"[i >= 4], "x", 0, v) for i, v in enumerate([1.1, 2.2, 3.3, 4.4, 5.5, 6.6, 7.7, 8.8, 9.9])]
    long = spark.createDataFrame(rows, LONG)
    w = summary.wilcoxon(long).first()
    assert w.stat == 0 and abs(w.pval - 2 / 126) < 1e-12
    assert abs(summary.kruskal(long).first().stat - 6.0) < 1e-9


def test_fold_changes(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (3.0, 3.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(prep.fold_change(F.col("a"), F.col("b"))).collect()] == [2.0, -2.0, 1.0, None]


def test_pairs_and_ladders():
    assert frame.class_pairs(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert frame.class_pairs(["a", "b", "c"], "b") == [("a", "b"), ("b", "c")]
    assert frame.class_pairs(["a", "b", "c"], [["c", "a"], "b"]) == [("a", "c"), ("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        frame.class_pairs(["a", "b"], "z")
    assert rank.feature_ladder(10, [1, 5, 3, 11.2, 7.8, 23, 1, 0]) == [1, 3, 5, 7, 10]
    assert rank.feature_ladder(1) == [1] and rank.feature_ladder(8) == [1, 2, 4, 8]


@pytest.mark.parametrize("plan", [resample.Plan("cv", 2, 3), resample.Plan("cv", 1, 4, strat=True), resample.Plan("rand", 1, 2, strat=True), resample.Plan("boot", 1, 3), resample.Plan("boot", 1, 2, strat=True)])
def test_plans(spark, plan):
    rows = [(i, "abc"[i % 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "sample_id long, cls string")
    got = sorted(map(tuple, resample.checked_splits(df, plan).collect()))
    again = sorted(map(tuple, resample.checked_splits(df.repartition(5), plan).collect()))
    assert got == again and len(got) == 50 * plan.niter * plan.nreps
    by = {}
    for i, r, s, m in got:
        by.setdefault((i, r), {})[s] = m
    for (i, _), mult in by.items():
        if plan.sampling == "cv":
            assert set(mult.values()) == {0, 1}
            assert [sum(by[i, r][s] == 0 for r in range(1, plan.nreps + 1)) for s in range(50)] == [1] * 50
        if plan.sampling == "boot":
            assert sum(mult.values()) == 50
            if plan.strat:
                assert [sum(m for s, m in mult.items() if s % 3 == k) for k in range(3)] == [17, 17, 16]
        if plan.sampling == "rand":
            assert [sum(m for s, m in mult.items() if s % 3 == k) for k in range(3)] == [11, 11, 10]


def test_plan_checks(spark):
    with pytest.raises(ValueError):
        resample.Plan("cv", 1, 1)
    with pytest.raises(ValueError):
        resample.Plan("other")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "sample_id long, cls string")
    with pytest.raises(ValueError):
        resample.checked_splits(df, resample.Plan("cv", 1, 2))


def test_rates_of_tiny_vectors(spark):
    obs, pre = "12" * 5, "2221121212"
    df = spark.createDataFrame(list(zip(obs, pre, strict=True)), "obs string, pred string")
    assert abs(evaluate.cl_rate(df).first().acc - 0.7) < 1e-12
    none = spark.createDataFrame([(o, "1") for o in obs], "obs string, pred string")
    got = evaluate.cl_perf(none, "2").first()
    assert got.acc == 0.5 and got.tpr == 0 and got.tp == 0


def test_lists_tables_and_colours(spark, tmp_path):
    assert lists.flatten_list({"a": {"b": 1, "c": [2, 3]}, "d": None}) == {"a_b": 1, "a_c_1": 2, "a_c_2": 3, "d": None}
    assert lists.shrink_list({"x": 1, "y": float("nan"), "z": None}) == {"x": 1}
    assert [tuple(r) for r in lists.list_to_frame(spark, {"a": [1, 2], "b": [3]}).collect()] == [(0, 1.0, 3.0), (1, 2.0, None)]
    df = spark.createDataFrame([(1, [1, 2], [3])], "id int, a array<int>, b array<int>")
    assert [tuple(r) for r in lists.arrays_to_rows(df, ["a", "b"]).collect()] == [(1, 0, 1, 3), (1, 1, 2, None)]
    tables.save_tab({"one": spark.createDataFrame([(1, None)], "a int, b string")}, str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text() == "\n\none\n,a,b\n1,1,\n"
    assert plotdata.color_ramp("white", "black", 3) == ["#FFFFFF", "#808080", "#000000"]
