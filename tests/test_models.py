"""Models from cross-products against the same models computed on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.operators import bounded, compare, correlation, models, moments, multirank, neighbours, plotdata, report, validate
from sparkomics.operators.resample import Plan

SCHEMA = "sample_id long, cls string, features array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 8)) @ rng.normal(size=(8, 8)) + 100
    x[:, 0] += 2.5 * y
    x[:, 3] -= 1.5 * (y == 1)
    labels = np.array(list("abc"))[y]
    df = spark.createDataFrame([(i, str(labels[i]), [float(v) for v in x[i]]) for i in range(240)], SCHEMA).repartition(5)
    return x, labels, df, moments.gather(df, ["a", "b", "c"])[0]


def collect(df, column):
    return np.array([r[column] for r in df.orderBy("sample_id").collect()])


def test_moments(data):
    x, labels, df, m = data
    c = x - x.mean(axis=0)
    assert m.n == 240 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.total(), c.T @ c)
    by = moments.gather(df, ["a", "b", "c"], by_class=True)[0]
    for k, name in enumerate("abc"):
        assert np.allclose(by.within[k], np.cov(x[labels == name].T) * ((labels == name).sum() - 1))


def test_states_meet_in_a_tree(data, monkeypatch):
    """With a fan-in of 4 and 70 tasks no group above the last holds more, and the sums stay the same."""
    x, _, df, m = data
    monkeypatch.setattr(moments, "FAN_IN", 4)
    spread = moments.gather(df.repartition(70), ["a", "b", "c"])[0]
    assert spread.n == m.n and np.allclose(spread.mean, m.mean) and np.allclose(spread.total(), m.total())
    cells = df.sparkSession.range(0, 70, 1, 70).selectExpr("0 as k", "id as state")

    def most(frame):
        n = frame["state"].max() if "seen" in frame else len(frame)
        return frame.iloc[:1].assign(state=n)[["k", "part", "state"]]

    assert moments.merge_tree(cells, most, "k int, part long, state long").first().state == 5  # 70 -> 18 -> 5


def test_long_reports_raise(spark):
    with pytest.raises(ValueError, match="at most"):
        report._table(spark.range(report.MOST_ROWS + 1))


def test_missing_values_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", [1.0, None]), (2, "b", [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="without nulls"):
        moments.gather(df, ["a", "b"])


def test_pca(data):
    x, _, df, m = data
    pca = models.PCA.fit(m, scale=True)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(pca.sdev, s / np.sqrt(239))
    got = collect(models.scores(df, pca), "scores")
    assert np.allclose(np.abs(got), np.abs(z @ vt.T)) and np.allclose(got.mean(axis=0), 0, atol=1e-8)
    points, share = plotdata.pca_comp(df, True)
    assert points.count() == 480 and abs(share.first().pct_var - pca.share()[0]) < 0.01


def direct_nipals(x, y, k):
    """Orthogonal-scores PLS on centred rows."""
    x, y, t_, w_, p_, q_ = x.copy(), y.copy(), [], [], [], []
    for _ in range(k):
        w = np.linalg.svd(x.T @ y, full_matrices=False)[0][:, 0]
        t = x @ w
        p, q = x.T @ t / (t @ t), y.T @ t / (t @ t)
        x, y = x - np.outer(t, p), y - np.outer(t, q)
        for a, b in ((t_, t), (w_, w), (p_, p), (q_, q)):
            a.append(b)
    w, p, q = np.array(w_).T, np.array(p_).T, np.array(q_).T
    return np.array(t_).T, w @ np.linalg.inv(p.T @ w) @ q.T


def test_pls(data):
    x, labels, df, m = data
    xc = x - x.mean(axis=0)
    y = np.stack([(labels == c).astype(float) for c in "abc"], axis=1)
    t, b = direct_nipals(xc, y - y.mean(axis=0), 4)
    for algorithm in ("kernelpls", "oscorespls"):
        pls = models.PLS.of_classes(m, 4, algorithm)
        assert np.allclose(pls.coefficients(), b) and np.allclose(np.abs(pls.scores(x)), np.abs(t))
    simpls = models.PLS.of_classes(m, 4)
    s = simpls.scores(x)
    assert np.allclose(s.T @ s, np.eye(4), atol=1e-8)
    full = models.PLS.of_classes(m, 8).coefficients()
    assert np.allclose(full, np.linalg.lstsq(xc, y - y.mean(axis=0), rcond=None)[0])
    assert np.isclose(models.PLS.of_classes(m, 8, "oscorespls").xvar.sum(), (xc**2).sum())
    assert np.isclose((models.PLS.of_classes(m, 5, "oscorespls").vip() ** 2).mean(), 1)


def test_lda_and_its_relatives(data):
    x, labels, df, m = data
    lda = models.LDA.fit(m)
    cov = m.pooled / (240 - 3)
    d = x[:, None, :] - m.means
    direct = models.softmax(np.log(m.counts / 240) - 0.5 * np.einsum("ngp,pq,ngq->ng", d, np.linalg.inv(cov), d))
    assert np.allclose(lda.posterior(x), direct)
    for method, options in (("lda", {}), ("qda", {}), ("pcalda", {"ncomp": 6}), ("plsc", {"ncomp": 4}), ("plslda", {"ncomp": 4})):
        preds = models.predict(df, models.fit(df, method, **options))
        post = collect(preds, "posterior")
        assert np.allclose(post.sum(axis=1), 1)
        assert (collect(preds, "pred") == collect(preds, "obs")).mean() > 0.55, method
    assert "Accuracy" in report.model(models.fit(df, "pcalda"), df, full=True)
    assert "Confusion" in report.model(models.fit(df, "plsc"), df)


@pytest.mark.parametrize("method", ["wold", "sjoblom", "wise"])
def test_osc(data, method):
    x, labels, df, m = data
    osc = models.OSC.fit(m, method, osc_ncomp=2, pls_ncomp=8, tol=1e-8, iters=200)
    y = np.stack([(labels == c).astype(float) for c in "abc"], axis=1)
    removed = (x - osc.center) @ osc.w
    assert osc.w.shape == (8, 2) and 0 < osc.r2 < 100
    t = removed[:, 0]
    cos = np.abs(y.T @ (t - t.mean())) / np.sqrt(((t - t.mean()) ** 2).sum() * y.sum(axis=0))
    assert cos.max() < 0.6 and all(80 < a < 100 for a in osc.angles)
    rows, q2 = models.osc_predict(df, osc)
    assert np.allclose(collect(rows, "features"), osc.correct(x)) and abs(q2 - osc.r2) < 1e-6
    assert "R2" in report.osc(osc, True)


def test_resampled_fit_is_the_fit_of_the_training_rows(data, spark):
    x, labels, df, _ = data
    plan = Plan("cv", 1, 4)
    found = validate.accest(df, "lda", plan)
    splits = {(r.rep, r.sample_id): r.mult for r in validate.checked_splits(df, plan).collect()}
    preds = {(r.rep, r.sample_id): r.pred for r in found.preds.collect()}
    assert len(preds) == 240
    for rep in range(1, 5):
        train = np.array([splits[rep, i] > 0 for i in range(240)])
        m = moments.Moments.empty(["a", "b", "c"], 8)
        for k, c in enumerate("abc"):
            m.add(k, x[train & (labels == c)])
        want = np.array(list("abc"))[models.LDA.fit(m).posterior(x[~train]).argmax(axis=1)]
        assert [preds[rep, i] for i in np.flatnonzero(~train)] == list(want)
    line = found.summary.first()
    assert abs(line.acc + line.err - 1) < 1e-12 and line.margin is not None
    assert "Accuracy" in report.accest(found, full=True)


def test_knn_with_tiles(data, monkeypatch):
    x, labels, df, _ = data
    plan = Plan("cv", 1, 3)
    monkeypatch.setattr(neighbours, "TILE", 100)
    preds = {(r.rep, r.sample_id): r.pred for r in validate.accest(df, "knn", plan, k=5).preds.collect()}
    splits = {(r.rep, r.sample_id): r.mult for r in validate.checked_splits(df, plan).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for (rep, i), p in preds.items():
        train = [j for j in range(240) if splits[rep, j]]
        near = labels[sorted(train, key=lambda j: d[i, j])[:5]]
        best = max(sorted(set(near)), key=list(near).count)
        assert p == best


def test_support_vectors_and_forest(data, spark):
    x, labels, df, _ = data
    svm = bounded.SVM.fit(x, labels)
    post = svm.posterior(x)
    assert np.allclose(post.sum(axis=1), 1) and (np.array(svm.labels)[post.argmax(axis=1)] == labels).mean() > 0.7
    two = bounded.SVM.fit(x[labels != "c"], labels[labels != "c"], "linear")
    assert (np.array(two.labels)[two.posterior(x[labels != "c"]).argmax(axis=1)] == labels[labels != "c"]).mean() > 0.7
    forest = bounded.fit_forest(x, labels, 20)
    assert (np.array(forest.labels)[forest.posterior(x).argmax(axis=1)] == labels).mean() > 0.9
    names = [f"v{i}" for i in range(8)]
    top = multirank.fs_rf(df, names, 40).orderBy("fs_rank").first()
    assert top.stat > 0
    assert multirank.fs_rfe(df, names).count() == 8


def test_tuning(data):
    _, _, df, _ = data
    found = validate.tune_plslda(df, 5, Plan("rand", 1, 3))
    table = {r.ncomp: r.acc for r in found.table.collect()}
    assert found.ncomp == min(k for k, v in table.items() if v == max(table.values())) and len(table) == 5


def test_comparisons(spark):
    rng = np.random.default_rng(1)
    rows = [(m, i, float(v)) for m, shift in (("a", 0.0), ("b", 0.0), ("c", 0.3)) for i, v in enumerate(0.5 + shift + rng.normal(0, 0.05, 12))]
    acc = spark.createDataFrame(rows, "method string, iter int, acc double")
    anova = compare.mc_anova(acc)
    assert anova["pval"] < 1e-6 and {(r.method_1, r.method_2) for r in anova["pairs"].where("pval < 0.01").collect()} == {("a", "c"), ("b", "c")}
    fried = compare.mc_fried(acc)
    assert fried["pval"] < 0.01 and fried["df"] == 2
    assert compare.mc_norm(acc).count() == 3


def test_linkage_and_kendall():
    d = np.array([[0, 1, 5, 6], [1, 0, 4, 7], [5, 4, 0, 2], [6, 7, 2, 0]], dtype=float)
    merges, order = correlation.complete_linkage(d)
    assert [m[2] for m in merges] == [1, 2, 7] and sorted(order) == [0, 1, 2, 3]
    assert correlation.cut_tree(merges, 4, 3) == [1, 1, 2, 2]
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    s = [(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]), x[i] != x[j], y[i] != y[j]) for i in range(60) for j in range(i)]
    want = sum(v[0] for v in s) / np.sqrt(sum(v[1] for v in s) * sum(v[2] for v in s))
    assert abs(correlation.kendall(x.astype(float), y.astype(float)) - want) < 1e-12


def test_mds_of_euclidean_distances_and_others(data):
    x, _, df, _ = data
    small = df.where("sample_id < 40")
    flat = collect(plotdata.mds(small, "manhattan"), "x")
    assert len(flat) == 40
    d = plotdata.distance_matrix(x[:5], "minkowski", 2)
    assert np.allclose(d, np.sqrt(((x[:5, None] - x[None, :5]) ** 2).sum(axis=2)))
    with pytest.raises(ValueError):
        plotdata.mds(df, "m")
    assert df.where(F.col("sample_id") < 0).count() == 0


def test_normality_query_reads_the_whole_table(spark, tmp_path):
    from sparkomics.plans import catalogue

    spark.range(9000).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id % 7 as user_id", "case when id < 6000 then 'often' when id < 8998 then 'seldom' else 'few' end as event_type", "cast(pmod(hash(id), 1000) as double) as value", "'{}' as props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.method: r for r in catalogue.QUERIES["mc_norm"](spark, str(tmp_path)).collect()}
    assert {m: r.n for m, r in got.items()} == {"often": 6000, "seldom": 2998, "few": 2}
    assert got["often"].w is None and got["often"].pval is None and 0 < got["seldom"].w < 1 and got["few"].pval is None
