"""Queries over all rows, classes and dimensions of the embeddings, against brute force on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.operators import resample, validate
from sparkomics.plans import catalogue, fixtures, modelling


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    y = np.arange(72) % 4
    x = rng.normal(size=(72, 64)).astype(np.float32)
    x[:, 40:] += 1.5 * np.eye(4)[y][:, np.arange(24) % 4]  # only dimensions beyond the first 40 tell the classes
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(72)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path + "/embeddings.parquet")
    return x.astype(float), y.astype(str), path


def test_leave_one_out_of_all_rows(spark, world):
    out = [r for r in catalogue.QUERIES["split_loocv"](spark, world[2]).where("mult = 0").collect()]
    assert sorted(r.sample_id for r in out) == list(range(72)) and len({r.rep for r in out}) == 72


def test_neighbours_in_all_dimensions(spark, world):
    x, y, path = world
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    held = {(r.rep, r.sample_id) for r in resample.splits(fixtures.vectors(spark, path), modelling._KPLAN).where("mult = 0").collect()}
    got = {(r.rep, r.sample_id): r.pred for r in catalogue.QUERIES["knn_cv_preds"](spark, path).collect()}
    assert set(got) == held and len(held) == 72
    for rep, i in held:
        rest = [j for j in np.argsort(d[i]) if (rep, j) not in held][:3]
        votes = [(-sum(y[j] == c for j in rest), c) for c in sorted(set(y))]
        assert got[rep, i] == min(votes)[1]
    folds = [np.mean([got[k] == y[k[1]] for k in held if k[0] == rep]) for rep in sorted({k[0] for k in held})]
    assert abs(catalogue.QUERIES["knn_cv_accest"](spark, path).first().acc - np.mean(folds)) < 1e-6


def test_relief_of_all_features(spark, world):
    x, y, path = world
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    span, want = x.max(axis=0) - x.min(axis=0), np.zeros(64)
    for i in range(72):
        for c in set(y):
            same = np.flatnonzero((y == c) & (np.arange(72) != i))
            near = same[np.argsort(d[i][same])][:10]
            share = np.mean(y == c) / (1 - np.mean(y == y[i]))
            want += (-1 if c == y[i] else share) * np.abs(x[near] - x[i]).mean(axis=0) / span / 72
    got = {r.feature: r.stat for r in catalogue.QUERIES["fs_relief"](spark, path).collect()}
    assert np.allclose([got[f"f{j:02d}"] for j in range(64)], want, atol=2e-6)


def test_forest_and_qda_see_everything(spark, world):
    _, y, path = world
    assert catalogue.QUERIES["fs_rf"](spark, path).count() == 64
    assert {r.obs for r in catalogue.QUERIES["qda_predict"](spark, path).select("obs").distinct().collect()} == set(y)
    assert catalogue.QUERIES["fs_cl_1_lda"](spark, path).count() == 3


def test_calls_read_all_classes_and_dimensions(spark, world, monkeypatch):
    path, seen = world[2], {}

    class Seen(Exception):
        pass

    def caught(vectors, *args, **options):
        seen["classes"] = vectors.select("cls").distinct().count()
        seen["width"] = vectors.select(F.max(F.size("features"))).first()[0]
        raise Seen

    for f in ("accest", "maccest", "binest", "frankvali", "fs_cl", "fs_cl_1"):
        monkeypatch.setattr(validate, f, caught)
    for f in ("fs_rf", "fs_rf_1"):
        monkeypatch.setattr(modelling.multirank, f, caught)
    for name in "svm_cv rf_cv boot_lda maccest_anova maccest_friedman binest_lda fs_cl_lda fs_cl_1_lda fs_rf fs_rf_1 frankvali_knn".split():
        with pytest.raises(Seen):
            catalogue.QUERIES[name](spark, path)
        assert seen == {"classes": 2 if name == "frankvali_knn" else 4, "width": 64}, name
