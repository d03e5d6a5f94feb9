"""Steps that once took a sample, raised above a bound, or gathered a group in one task, on data where that shows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.operators import bounded, correlation, frame, multirank, neighbours, plotdata, rank, resample, summary, validate
from sparkomics.operators.resample import Plan

SCHEMA = "sample_id long, cls string, features array<double>"


def late_class(spark, n, most):
    """The class "b" has only rows beyond the first ``most`` by the hash of the id; feature 0 tells it."""
    ids = [r[0] for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    late, rng = set(ids[most:]), np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, "b" if i in late else "a", [float(x[i, 0] + 4 * (i in late)), float(x[i, 1]), float(x[i, 2])]) for i in range(n)], SCHEMA)


def test_elimination_sees_all_rows(spark):
    best = multirank.fs_rfe(late_class(spark, 4_300, 4_000), ["u", "v", "w"]).orderBy("fs_rank").first()
    assert best.feature == "u"


def test_linear_machine_is_that_of_the_dual():
    rng = np.random.default_rng(1)
    y = np.where(rng.integers(0, 2, 240) > 0, 1.0, -1.0)
    z = rng.normal(size=(240, 6)) + 0.4 * y[:, None]
    dual = bounded.smo(z @ z.T, y, 1.0, 1e-7)[0]
    assert np.allclose(bounded.linear_weights(z, y, np.ones(240)), (dual * y) @ z, atol=1e-5)
    times = rng.integers(0, 4, 240)
    drawn, some = np.repeat(np.arange(240), times), times > 0
    assert np.allclose(bounded.linear_weights(z[drawn], y[drawn], np.ones(len(drawn))), bounded.linear_weights(z[some], y[some], times[some].astype(float)), atol=1e-5)


def test_nearest_by_bounds_are_the_nearest(monkeypatch):
    """Copies, a large offset, an unlucky order and small blocks: votes and neighbours are those of all exact distances."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(neighbours, "BLOCK", 600)
    for p, shift in ((3, 0.0), (20, 1e4)):
        base = rng.normal(size=(150, p)) + shift
        base = np.concatenate([base, base[:40]])
        query = np.concatenate([base[::7], rng.normal(size=(9, p)) + shift])
        d = np.einsum("qbp,qbp->qb", query[:, None] - base, query[:, None] - base)
        far_first = np.argsort(-d[0], kind="stable")
        marks, weights = rng.integers(0, 3, 190), rng.integers(1, 3, 190)
        near, by_id = neighbours.Near(query, 4), neighbours.Near(query, 4, by_id=True)
        for a in range(0, 190, 32):
            some = far_first[a : a + 32]
            near.add(base[some], marks[some], weights[some])
            by_id.add(base[some], some, np.ones(len(some), dtype=np.int64), 0, (np.full(len(query), -1), some))
        votes, first = np.zeros((len(query), 3)), [[] for _ in query]
        key, _, mark, weight = near.settle()
        np.add.at(votes, (key, mark), weight)
        key, _, mark, _ = by_id.settle()
        for q, j in zip(key.tolist(), mark.tolist(), strict=True):
            first[q].append(j)
        for q in range(len(query)):
            last = np.sort(np.repeat(d[q], weights))[3]
            assert np.array_equal(votes[q], np.bincount(marks, weights * (d[q] <= last), 3))
            assert first[q] == np.lexsort((np.arange(190), d[q]))[:4].tolist()


def test_pairs_of_classes_in_one_plan_are_each_pair_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = np.arange(60) % 3
    x = rng.normal(size=(60, 3)) + 1.2 * np.eye(3)[y]
    rows = spark.createDataFrame([(i, "pqr"[y[i]], [float(v) for v in x[i]]) for i in range(60)], SCHEMA)
    plan = Plan("boot", 1, 2)
    accest = validate.accest
    monkeypatch.setattr(validate, "accest", None)  # no plan for each pair
    got = {r.pair: r for r in validate.mbinest(rows, ["plsc"], plan=plan).collect()}
    assert sorted(got) == ["p~q", "p~r", "q~r"]
    monkeypatch.setattr(validate, "accest", accest)
    for pair in ("p~q", "q~r"):
        want = validate.accest(rows.where(F.col("cls").isin(*pair.split("~"))), "plsc", plan).summary.first()
        assert np.allclose([got[pair].acc, got[pair].auc, got[pair].margin], [want.acc, want.auc, want.margin])


def test_forest_of_all_rows_votes_as_one(spark):
    """Trees in several tasks vote as the forest of all training rows in one, in the order of the ids' hashes."""
    rng = np.random.default_rng(6)
    y, order = np.array(list("ab"))[np.arange(90) % 2], [r[0] for r in spark.range(90).orderBy(F.xxhash64("id"), "id").collect()]
    x = rng.normal(size=(90, 4)) + (y == "b")[:, None]
    rows = spark.createDataFrame([(i, str(y[i]), [float(v) for v in x[i]]) for i in range(90)], SCHEMA)
    splits = rows.selectExpr("sample_id", "1 as iter", "1 as rep", "if(sample_id % 3 = 0, 0, cast(1 + sample_id % 2 as int)) as mult")
    got = {r.sample_id: r for r in validate.predictions(rows, "randomForest", splits, trees=12)[0].collect()}
    train = np.repeat([i for i in order if i % 3], [1 + i % 2 for i in order if i % 3])
    forest = bounded.fit_forest(x[train], y[train], 12)
    test = np.arange(0, 90, 3)
    want = forest.posterior(x[test])
    assert sorted(got) == test.tolist() and np.allclose([got[i].posterior for i in test], want)
    assert [got[i].pred for i in test] == list(np.array(["a", "b"])[want.argmax(axis=1)])


def test_own_functions_get_all_rows(spark):
    """Above the 50,000 rows that once were the limit."""
    rows = spark.range(50_100).selectExpr("id as sample_id", "if(id % 2 = 0, 'a', 'b') as cls", "array(double(id), double(id % 2)) as features")
    splits = rows.selectExpr("sample_id", "1 as iter", "1 as rep", "if(sample_id = 7, 0, 1) as mult")
    found = rank.rank_resampled(frame.long_from_arrays(rows, "sample_id", "features", "cls"), splits, lambda x, y: np.array([len(x), x[:, 1].sum()]))
    assert {r.feature_idx: r.stat for r in found.collect()} == {0: 50_099.0, 1: 25_049.0}
    told = validate.predictions(rows, validate.Classifier("n", lambda x, y: len(x), lambda n, z: np.full(len(z), str(n))), splits)[0].collect()
    assert [(r.sample_id, r.pred) for r in told] == [(7, "50099")]


def test_kendall_by_buckets(spark, monkeypatch):
    """Ties, a frequent value, missing cells and several buckets: as in one task."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(correlation, "BUCKET_ROWS", 40)
    monkeypatch.setattr(correlation, "MOST_PAIR", 100)  # the old limit, made small
    x = np.stack([rng.normal(size=500), rng.integers(0, 40, 500), np.where(rng.random(500) < 0.4, 7.0, rng.integers(0, 100, 500))], axis=1)
    x[:, 2] += x[:, 1]
    gone = rng.random((500, 3)) < 0.1
    rows = [(i, "a", f"f{j}", j, None if gone[i, j] else float(x[i, j])) for i in range(500) for j in range(3)]
    long = spark.createDataFrame(rows, "sample_id long, cls string, feature string, feature_idx int, value double")
    got = {(r.idx_1, r.idx_2): r for r in correlation.correlations(long, "kendall").collect()}
    for (i, j), r in got.items():
        ok = ~(gone[:, i] | gone[:, j])
        a, b = x[ok, i], x[ok, j]
        sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        assert r.n == ok.sum() and abs(r.cor - (sa * sb).sum() / np.sqrt((sa != 0).sum() * float((sb != 0).sum()))) < 1e-12
    assert len(got) == 3


def test_quantiles_in_buckets(spark):
    """Medians and quartiles by feature and class, one of them null, without a percentile that gathers a group."""
    rng = np.random.default_rng(9)
    rows = [(i, [None, "a", "b"][i % 3], "f", 0, None if i == 5 else float(v)) for i, v in enumerate(np.where(rng.random(301) < 0.4, 3.0, rng.integers(0, 900, 301) / 7))]
    long = spark.createDataFrame(rows, "sample_id long, cls string, feature string, feature_idx int, value double")
    found = summary.vec_summ(long, ["cls"])
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString() and "median(" not in found._jdf.queryExecution().optimizedPlan().toString()
    half, more = {r.cls: r for r in found.collect()}, {r.cls: r for r in summary.vec_summ_1(long, ["cls"]).collect()}
    for c in (None, "a", "b"):
        v = np.array([r[4] for r in rows if r[1] == c and r[4] is not None])
        assert half[c].n == len(v) and half[c].median == np.median(v) and abs(more[c].iqr - np.subtract(*np.percentile(v, [75, 25]))) < 1e-12


@pytest.mark.parametrize("metric", ["manhattan", "maximum"])
def test_scaling_without_a_matrix(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) * [4, 2, 1, 0.5, 0.5]
    rows = spark.createDataFrame([(i, "a", [float(v) for v in x[i]]) for i in range(90)], SCHEMA)
    want = [(r.x, r.y) for r in plotdata.mds(rows, metric).orderBy("sample_id").collect()]
    monkeypatch.setattr(plotdata, "MOST_POINTS", 30)
    got = [(r.x, r.y) for r in plotdata.mds(rows, metric).orderBy("sample_id").collect()]
    assert len(got) == 90 and np.allclose(got, want, atol=1e-6)


def test_leave_one_out_is_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "sample_id long, cls string")
    assert resample.splits(rows, Plan("loocv")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
