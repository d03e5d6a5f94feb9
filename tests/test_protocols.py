"""Rankers, classifiers, tests, centres and fills that a user brings; ladders of features in one plan; reports and plot
data of results.  Against numpy, or against the same operator run one set at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.operators import frame, models, multirank, plotdata, prep, rank, report, resample, summary, validate
from sparkomics.operators.resample import Plan
from sparkomics.plans.modelling import centroids, class_mean_range, nearest_centroid

NAMES = [f"f{j:02d}" for j in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    y = np.arange(48) % 3
    x = rng.normal(size=(48, 5)) + np.eye(3, 5)[y] * [2.5, 1.5, 1.0, 0, 0]
    rows = spark.createDataFrame([(i, str(y[i]), [float(v) for v in x[i]]) for i in range(48)], "sample_id long, cls string, features array<double>")
    long = frame.long_from_arrays(rows, "sample_id", "features", "cls")
    plan = Plan("boot", 1, 3)
    splits = resample.checked_splits(rows, plan).persist()
    table = {}
    for r in splits.collect():
        table.setdefault((r.iter, r.rep), {})[r.sample_id] = r.mult
    return x, y.astype(str), rows, long, plan, splits, table


def train(x, y, mults):
    at = np.repeat(np.arange(len(y)), [mults[i] for i in range(len(y))])
    return x[at], y[at]


def test_own_ranker_with_drawn_rows(data):
    x, y, rows, long, plan, splits, table = data
    got = {(r.iter, r.rep, r.feature): (r.stat, r.fs_rank) for r in rank.rank_resampled(long, splits, class_mean_range).collect()}
    for (i, r), mults in table.items():
        want = class_mean_range(*train(x, y, mults))
        assert np.allclose([got[i, r, n][0] for n in NAMES], want)
        assert [got[i, r, n][1] for n in NAMES] == list(1 + np.argsort(np.argsort(-want)))
    with pytest.raises(ValueError):
        rank.rank_resampled(long, splits, class_mean_range, most_rows=10)
    with pytest.raises(ValueError):
        rank.rank_resampled(long, splits, "fs.none")


@pytest.mark.parametrize("method", ["fs.pca", "fs.pls", "fs.plsvip", "fs.plsvip.1", "fs.plsvip.2", "fs.rfe", "fs.relief"])
def test_named_rankers_on_a_resample_are_those_of_its_rows(spark, data, method):
    x, y, rows, long, plan, splits, table = data
    (i, r), mults = next(iter(table.items()))
    tx, ty = train(x, y, mults)
    alone = spark.createDataFrame([(k, str(c), [float(v) for v in t]) for k, (t, c) in enumerate(zip(tx, ty))], rows.schema)
    one = {"fs.relief": multirank.fs_relief}.get(method) or getattr(multirank, method.replace(".", "_"))
    want = {t.feature: t.stat for t in one(alone, NAMES).collect()}
    got = {t.feature: t.stat for t in rank.rank_resampled(long, splits, method).where((F.col("iter") == i) & (F.col("rep") == r)).collect()}
    if method == "fs.relief":  # copies of a row tie, so the order of ids decides
        assert set(got) == set(want)
    else:
        assert all(abs(got[n] - want[n]) < 1e-8 for n in NAMES)


def test_several_rankers_and_their_stability(data):
    x, y, rows, long, plan, splits, table = data
    methods = ["fs.anova", "fs.rf", class_mean_range]
    own = {"fs.rf": {"trees": 10}}
    found = rank.feat_mfs(long, methods, splits, own).collect()
    assert sorted((r.method, r.fs_rank) for r in found) == sorted((m, k) for m in ("fs.anova", "fs.rf", "class_mean_range") for k in range(1, 6))
    whole = {r.feature: r.stat for r in rank.feat_mfs(long, [class_mean_range]).collect()}
    assert np.allclose([whole[n] for n in NAMES], class_mean_range(x, y))
    stab = rank.feat_mfs_stab(long, methods, splits, 2, 0.5, own)
    tops = [set(np.argsort(-class_mean_range(*train(x, y, m)))[:2]) for m in table.values()]
    want = {NAMES[j]: np.mean([j in t for t in tops]) for j in range(5)}
    got = {r.feature: r.freq for r in stab["freq"].where("method = 'class_mean_range'").collect()}
    assert got == {n: f for n, f in want.items() if f}
    assert "class_mean_range" in stab["consensus"].columns and stab["stability"].count() == 3


def test_feature_without_variation_is_last(spark, data):
    x, y, rows, long, plan, splits, table = data
    flat = long.withColumn("value", F.when(F.col("feature_idx") == 1, 3.0).otherwise(F.col("value")))
    for method in ("fs.pls", "fs.rfe", class_mean_range):
        got = rank.rank_resampled(flat, splits, method).where("feature_idx = 1").collect()
        assert {(r.stat, r.fs_rank) for r in got} == {(None, 5)}


def test_own_classifier(data):
    x, y, rows, long, plan, splits, table = data
    found = validate.accest(rows, validate.Classifier("centroid", centroids, nearest_centroid), plan, splits)
    got = {(r.rep, r.sample_id): r.pred for r in found.preds.collect()}
    want = {}
    for (_, r), mults in table.items():
        out = [i for i in range(48) if not mults[i]]
        want |= {(r, i): c for i, c in zip(out, nearest_centroid(centroids(*train(x, y, mults)), x[out]))}
    assert got == want
    s = found.summary.first()
    assert s.method == "centroid" and s.margin is None and s.auc is None
    assert found.boot.count() == 1

    def posterior(model, z):
        d = np.exp(-((z[:, None] - model[1][None]) ** 2).sum(axis=2))
        return d / d.sum(axis=1, keepdims=True)

    both = validate.maccest(rows, ["lda", validate.Classifier("soft", centroids, posterior)], plan)
    lines = {r.method: r for r in both.summary.collect()}
    assert set(lines) == {"lda", "soft"} and lines["soft"].margin is not None
    with pytest.raises(ValueError):
        validate.accest(rows, validate.Classifier("small", centroids, posterior, most_rows=9), plan, splits)


@pytest.mark.parametrize("method", ["lda", "knn", "svm", validate.Classifier("centroid", centroids, nearest_centroid)])
def test_ladder_in_one_plan_is_each_length_alone(data, method):
    x, y, rows, long, plan, splits, table = data
    orders = {k: list(np.random.default_rng(k[1]).permutation(5)) for k in table}
    got = {(r.len, r.iter, r.rep): r.err for r in validate.frank_err(rows, {k: [int(v) for v in o] for k, o in orders.items()}, [2, 5], method, splits).collect()}
    for (i, r), order in orders.items():
        own = splits.where((F.col("iter") == i) & (F.col("rep") == r))
        for k in (2, 5):
            preds = validate.predictions(validate.project(rows, [int(v) for v in order[:k]]), method, own)[0]
            assert abs(got[k, i, r] - preds.select(F.avg((F.col("obs") != F.col("pred")).cast("double"))).first()[0]) < 1e-9
    assert len(got) == 6


def test_prefixes_single_features_and_results(data):
    x, y, rows, long, *_ = data
    plan = Plan("cv", 1, 4)
    one = {r.len: r for r in validate.fs_cl_1(rows, [2, 0], "lda", plan).collect()}
    grow = {r.len: r for r in validate.fs_cl(rows, [2, 0, 1], [1, 2, 3], "lda", plan).collect()}
    assert set(one) == {1, 2} and set(grow) == {1, 2}
    results = validate.fs_cl_2(rows, [2, 0], "lda", plan)
    for k, r in enumerate(results, 1):
        s = r.summary.first()
        assert (one[k].acc, one[k].mar) == (round(s.acc, 3), round(s.margin, 3))
    assert grow[1].acc == one[1].acc


def test_ranking_validation_and_what_is_shown_of_it(data):
    x, y, rows, long, *_ = data
    plan = Plan("cv", 2, 4)
    found = validate.frankvali(rows, long, "lda", "fs.rfe", plan, [1, 2])
    assert {(r.len, r.iter, r.rep) for r in found.err_all.collect()} == {(k, i, r) for k in (1, 2, 5) for i in (1, 2) for r in (1, 2, 3, 4)}
    boxes = {r.len: r for r in plotdata.error_boxes(found).collect()}
    means = {}
    for r in found.err_iter.collect():
        means.setdefault(r.len, []).append(r.err)
    assert all(abs(boxes[k].median - np.median(v)) < 1e-9 for k, v in means.items())
    text = report.frankvali(found, full=True)
    lines = text.split("\n")
    assert lines[0] == "Classifier: lda" and lines[1] == "Ranking: fs.rfe" and lines[2] == "Sampling: cv, 2 x 4"
    shown = {r.len: f"{r.err:.3f}" for r in found.err_avg.collect()}
    assert all(f"  {e}" in next(row for row in lines[5:] if row.split()[:1] == [str(k)]) for k, e in shown.items())


def test_several_classifiers_and_what_is_shown_of_them(data):
    x, y, rows, long, *_ = data
    plan = Plan("cv", 3, 4)
    found = validate.maccest(rows, ["lda", "plsc"], plan)
    iters = {}
    for r in found.iters.collect():
        iters.setdefault(r.method, []).append(r.acc)
    bars = {r.method: r for r in plotdata.accuracy_by_method(found).collect()}
    boxes = {r.method: r for r in plotdata.accuracy_boxes(found).collect()}
    for m, a in iters.items():
        assert abs(bars[m].acc - np.mean(a)) < 1e-9 and abs(bars[m].sd - np.std(a, ddof=1)) < 1e-9
        assert abs(boxes[m].median - np.median(a)) < 1e-9
    assert sorted(r.acc for r in plotdata.accuracy_by_iteration(found.results["lda"]).collect()) == sorted(iters["lda"])
    text = report.maccest(found, full=True)
    assert all(f"{np.mean(a):.3f}" in text and f"{max(a):.3f}" in text for a in iters.values())
    with pytest.raises(ValueError):
        plotdata.accuracy_by_iteration(validate.accest(rows, "lda", Plan("cv", 1, 4)))
    table = {r.method: r for r in validate.aam(rows, ["lda", "plsc"], plan).collect()}
    assert {m: t.acc for m, t in table.items()} == {m: round(np.mean(a), 3) for m, a in iters.items()}
    pairs = validate.mbinest(rows, ["lda"], plan=Plan("cv", 1, 4)).collect()
    assert [r.pair for r in sorted(pairs)] == ["0~1", "0~2", "1~2"] and all(0 <= r.acc <= 1 and r.auc is not None for r in pairs)


def test_axes_of_models_and_panels(data):
    x, y, rows, *_ = data
    model = models.fit(rows, "plslda", ncomp=2)
    points, labels = plotdata.axis_table(rows, model)
    assert len(labels) == 2 and points.count() == 96
    panels = plotdata.wrap({"all": rows}, "mds")[0]
    assert panels.count() == 48


def test_own_test_centre_and_fill(spark, data):
    x, y, rows, long, *_ = data
    two = long.where("cls in ('0', '1')")

    def sign(rows, by):
        return rows.groupBy(*(by or []), "feature", "feature_idx").agg(F.avg((F.col("value") > 0).cast("double")).alias("pval"))

    got = {r.feature: r.pval for r in summary.pval_test(two, sign).collect()}
    at = np.isin(y, ["0", "1"])
    assert np.allclose([got[n] for n in NAMES], (x[at] > 0).mean(axis=0))
    mat = {r.feature: r for r in summary.stats_mat(two, F.max, sign, "none").collect()}
    assert np.allclose([mat[n].center_2 for n in NAMES], x[y == "1"].max(axis=0)) and np.allclose([mat[n].pval for n in NAMES], [got[n] for n in NAMES])
    holes = long.withColumn("value", F.when(F.col("sample_id") != 5, F.col("value")))
    filled = {r.feature: r.value for r in prep.mv_fill(holes, {"f00": 9.0, "f03": -1.0}).where("sample_id = 5").collect()}
    assert filled == {"f00": 9.0, "f01": None, "f02": None, "f03": -1.0, "f04": None}
