"""Queries on resampling, rank aggregation, neighbours, correlation, models and plot data, with SQL where it says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bounded, compare, correlation, evaluate, frame, models, multirank, neighbours, plotdata, rank, resample, summary, validate
from ..operators.resample import Plan
from .fixtures import EM, EM2, EMBEDDING_NAMES, EV, embeddings, event_vectors, events, events_wide, vectors
from .tabular import ORACLES as TABULAR_SQL, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# resampling plans

_S = "s AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS cls FROM embeddings)"


def _h(salt: str, rep: str, key: str = "sample_id") -> str:
    return f"('0x' || substr(md5('1:{salt}:' || iter || ':' || {rep} || ':' || {key}), 1, 15))::BIGINT"


def _cv(strat: bool, niter: int = 2, reps: int = 5, source: str = _S) -> str:
    part = "iter, cls" if strat else "iter"
    return (
        f"{source}, h AS (SELECT *, {_h('c', '0')} AS h FROM s, range(1, {niter + 1}) AS r(iter)), n AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY h, sample_id) - 1 AS place, count(*) OVER (PARTITION BY {part}) AS size FROM h), "
        f"f AS (SELECT iter, sample_id, CASE WHEN place < (size % {reps}) * (size // {reps} + 1) THEN place // (size // {reps} + 1) ELSE size % {reps} + (place - (size % {reps}) * (size // {reps} + 1)) // greatest(size // {reps}, 1) END AS fold FROM n), "
        f"splits AS (SELECT iter, rep, sample_id, CASE WHEN fold <> rep - 1 THEN 1 ELSE 0 END AS mult FROM f, range(1, {reps + 1}) AS q(rep))"
    )


_OUT = " SELECT CAST(iter AS BIGINT) AS iter, CAST(rep AS BIGINT) AS rep, sample_id, CAST(mult AS BIGINT) AS mult FROM splits"


def _splits(plan: Plan):
    return lambda spark, sf: rounded(resample.splits(vectors(spark, sf), plan))


query("split_cv", f"WITH {_cv(False)}{_OUT}")(_splits(Plan("cv", 2, 5)))
query("split_cv_strat", f"WITH {_cv(True)}{_OUT}")(_splits(Plan("cv", 2, 5, strat=True)))
for _name, _part in (("split_rand", ""), ("split_rand_strat", ", cls")):
    query(
        _name,
        f"WITH {_S}, h AS (SELECT *, {_h('r', 'rep')} AS h FROM s, range(1, 3) AS r(iter), range(1, 4) AS q(rep)), n AS (SELECT *, row_number() OVER (PARTITION BY iter, rep{_part} ORDER BY h, sample_id) - 1 AS place, count(*) OVER (PARTITION BY iter, rep{_part}) AS size FROM h), "
        f"splits AS (SELECT iter, rep, sample_id, CASE WHEN place < floor(size * (2.0::DOUBLE / 3)) THEN 1 ELSE 0 END AS mult FROM n){_OUT}",
    )(_splits(Plan("rand", 2, 3, strat=bool(_part))))
for _name, _part, _key in (("split_boot", "", "place"), ("split_boot_strat", ", cls", "cls || ':' || place")):
    query(
        _name,
        f"WITH {_S}, h AS (SELECT *, {_h('b', 'rep')} AS h FROM s, range(1, 3) AS r(iter), range(1, 4) AS q(rep)), n AS (SELECT *, row_number() OVER (PARTITION BY iter, rep{_part} ORDER BY h, sample_id) - 1 AS place, count(*) OVER (PARTITION BY iter, rep{_part}) AS size FROM h), "
        f"d AS (SELECT iter, rep{_part}, {_h('d', 'rep', _key)} % size AS place, count(*) AS mult FROM n GROUP BY ALL), splits AS (SELECT n.iter, n.rep, sample_id, coalesce(mult, 0) AS mult FROM n LEFT JOIN d ON n.iter = d.iter AND n.rep = d.rep AND n.place = d.place{' AND n.cls = d.cls' if _part else ''}){_OUT}",
    )(_splits(Plan("boot", 2, 3, strat=bool(_part))))


@query(
    "split_loocv",
    f"WITH {_S}, h AS (SELECT *, {_h('l', '0').replace('iter', '1')} AS h FROM s), n AS (SELECT sample_id, row_number() OVER (ORDER BY h, sample_id) AS place FROM h) "
    "SELECT CAST(1 AS BIGINT) AS iter, CAST(r.place AS BIGINT) AS rep, n.sample_id, CAST(CASE WHEN n.place <> r.place THEN 1 ELSE 0 END AS BIGINT) AS mult FROM n, n AS r",
)
def split_loocv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.splits(vectors(spark, sf), Plan("loocv")))


# rankings over resamples

_LADDERS = {"power2": [1, 2, 4, 8, 10], "half": [1, 2, 5, 10], "full": list(range(1, 11)), "numbers": [1, 3, 5, 7, 10]}


@query("fs_len_ladder", "SELECT kind, CAST(len AS BIGINT) AS len FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, v in _LADDERS.items() for n in v) + ") AS t(kind, len)")
def fs_len_ladder(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"power2": "power2", "half": "half", "full": "full", "numbers": [1, 5, 3, 11.2, 7.8, 23, 1, 0]}
    return spark.createDataFrame([(k, n) for k, v in asked.items() for n in rank.feature_ladder(10, v)], "kind string, len long")


_PLAN = Plan("cv", 2, 5)
_RERANK = (
    f"{_cv(False, source=_S.replace('FROM embeddings', 'FROM embeddings WHERE label IN (0, 1)'))}, {EM2}, c AS (SELECT iter, rep, feature, feature_idx, cls, avg(value) AS m, stddev_samp(value) AS s FROM em JOIN splits USING (sample_id) WHERE mult > 0 GROUP BY ALL), "
    "t AS (SELECT a.iter, a.rep, a.feature, a.feature_idx, abs(a.m - b.m) / (a.s + b.s) AS stat FROM c a JOIN c b ON a.iter = b.iter AND a.rep = b.rep AND a.feature = b.feature WHERE a.cls = '0' AND b.cls = '1'), k AS (SELECT *, row_number() OVER (PARTITION BY iter, rep ORDER BY stat DESC, feature_idx) AS fs_rank FROM t)"
)


def resampled(spark: SparkSession, sf: str, method: str = "fs.snr") -> DataFrame:
    long = embeddings(spark, sf, ["0", "1"])
    return rank.rank_resampled(long, resample.splits(vectors(spark, sf, ["0", "1"]), _PLAN), method)


@query("rank_re_cv", f"WITH {_RERANK} SELECT CAST(iter AS BIGINT) AS iter, CAST(rep AS BIGINT) AS rep, feature, round(stat, 6) AS stat, fs_rank FROM k")
def rank_re_cv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resampled(spark, sf).select("iter", "rep", "feature", "stat", "fs_rank"))


@query("borda", f"WITH {_RERANK}, b AS (SELECT feature, feature_idx, CAST(sum(fs_rank) AS BIGINT) AS score, avg(stat) AS stat FROM k GROUP BY ALL) SELECT feature, score, round(stat, 6) AS stat, row_number() OVER (ORDER BY score, feature_idx) AS fs_rank FROM b")
def borda(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.borda(resampled(spark, sf)).select("feature", "score", "stat", "fs_rank"))


_FREQ = f"{_RERANK}, fq AS (SELECT feature, count(*) / 10.0 AS freq FROM k WHERE fs_rank <= 20 GROUP BY feature)"


@query("feat_freq", f"WITH {_FREQ} SELECT feature, round(freq, 6)::DOUBLE AS freq, freq >= 0.5 AS kept FROM fq")
def feat_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.feat_freq(resampled(spark, sf), 20).select("feature", "freq", "kept"))


@query("feat_stability", f"WITH {_FREQ} SELECT 'fs.snr' AS method, round(avg(freq), 6)::DOUBLE AS stability FROM fq")
def feat_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.stability(rank.feat_freq(resampled(spark, sf), 20)))


@query("feat_cons", f"WITH {_FREQ} SELECT feature, CAST(freq AS DOUBLE) AS \"fs.snr\", CAST(1 AS BIGINT) AS n_methods FROM fq WHERE freq >= 0.5")
def feat_cons(spark: SparkSession, sf: str) -> DataFrame:
    return rank.feat_cons(rank.feat_freq(resampled(spark, sf), 20), ["fs.snr"]).drop("feature_idx")


@query(
    "mfs_stats_cumshare",
    f"WITH {EV}, c AS (SELECT feature, feature_idx, cls, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL), o AS (SELECT feature, avg(value) AS mean FROM ev GROUP BY feature), t AS (SELECT feature, feature_idx, sum(n * pow(m - mean, 2)) / sum((n - 1) * v) AS stat FROM c JOIN o USING (feature) GROUP BY ALL), "
    "i AS (SELECT *, row_number() OVER (ORDER BY stat DESC, feature_idx) AS idx FROM t) SELECT 'fs.bw' AS method, idx, feature, round(sum(stat) OVER (ORDER BY idx) / sum(stat) OVER (), 6) AS value FROM i",
)
def mfs_stats_cumshare(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.feat_mfs_stats(rank.feat_mfs(events(spark, sf), ["fs.bw"]), cumulative=True))


_ORDERED = ["fs.welch", "fs.snr", "fs.auc"]


@query(
    "feat_mfs_orders",
    "WITH " + ", ".join(f"r{i} AS ({TABULAR_SQL[m.replace('.', '_')]})" for i, m in enumerate(_ORDERED)) + " SELECT r0.fs_rank, " + ", ".join(f'r{i}.feature AS "{m}"' for i, m in enumerate(_ORDERED)) + " FROM r0 JOIN r1 ON r1.fs_rank = r0.fs_rank JOIN r2 ON r2.fs_rank = r0.fs_rank",
)
def feat_mfs_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rank.order_table(rank.feat_mfs(embeddings(spark, sf, ["0", "1"]), _ORDERED), _ORDERED)


# neighbours

# distances are taken inside one expression for each pair, so that equal vectors are at equal distances
_PAIRS = "d AS (SELECT a.vec_id AS q, a.label AS own, b.vec_id AS id, b.label AS cls, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
_KNN = (
    f"{_cv(False, 1, 5)}, {_PAIRS}, m AS (SELECT iter, rep, q, id, CAST(d.cls AS VARCHAR) AS cls, d FROM d JOIN splits x ON x.sample_id = q AND x.mult = 0 JOIN splits y USING (iter, rep) WHERE y.sample_id = id AND y.mult = 1), "
    "nn AS (SELECT *, rank() OVER (PARTITION BY iter, rep, q ORDER BY d) AS place FROM m), w AS (SELECT iter, rep, q, cls, count(*) AS votes FROM nn WHERE place <= 3 GROUP BY ALL), p AS (SELECT iter, rep, q AS sample_id, arg_min(cls, (-votes, cls)) AS pred FROM w GROUP BY ALL), pr AS (SELECT p.*, s.cls AS obs FROM p JOIN s USING (sample_id))"
)
_KPLAN = Plan("cv", 1, 5)


def knn(spark: SparkSession, sf: str) -> validate.Accest:
    v = vectors(spark, sf)
    return validate.accest(v, "knn", _KPLAN, resample.splits(v, _KPLAN), k=3)


@query("knn_cv_preds", f"WITH {_KNN} SELECT CAST(rep AS BIGINT) AS rep, sample_id, obs, pred FROM pr")
def knn_cv_preds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(knn(spark, sf).preds.select("rep", "sample_id", "obs", "pred"))


@query("knn_cv_accest", f"WITH {_KNN}, fa AS (SELECT iter, rep, avg(CAST(obs = pred AS INTEGER)) AS acc FROM pr GROUP BY ALL) SELECT CAST(iter AS BIGINT) AS iter, round(avg(acc), 6) AS acc, round(1 - avg(acc), 6) AS err FROM fa GROUP BY iter")
def knn_cv_accest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(knn(spark, sf).iters.select("iter", "acc", "err"))


@query(
    "fs_relief",
    f"WITH {_PAIRS}, v AS (SELECT vec_id AS id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY q, cls ORDER BY d, id) AS place FROM d), k AS (SELECT *, count(*) OVER (PARTITION BY q, cls) AS kk FROM n WHERE place <= 10), c AS (SELECT label AS cls, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS prior FROM embeddings GROUP BY label), "
    "w AS (SELECT q, id, CASE WHEN own = k.cls THEN -1.0 ELSE o.prior / (1 - m.prior) END / kk / (SELECT count(*) FROM embeddings) AS w FROM k JOIN c o ON o.cls = k.cls JOIN c m ON m.cls = own), r AS (SELECT j, max(x) - min(x) AS r FROM v GROUP BY j), "
    "t AS (SELECT a.j, sum(w * abs(a.x - b.x)) AS s FROM w JOIN v a ON a.id = q JOIN v b ON b.id = w.id AND b.j = a.j GROUP BY a.j) SELECT 'f' || lpad(CAST(j AS VARCHAR), 2, '0') AS feature, round(s / r, 6) AS stat, row_number() OVER (ORDER BY s / r DESC, j) AS fs_rank FROM t JOIN r USING (j)",
)
def fs_relief(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbours.fs_relief(vectors(spark, sf), EMBEDDING_NAMES).select("feature", "stat", "fs_rank"))


# correlation

_COR = f"{EM}, r AS (SELECT a.feature AS feature_1, b.feature AS feature_2, corr(a.value, b.value) AS cor FROM em a JOIN em b USING (sample_id) WHERE a.feature_idx < b.feature_idx GROUP BY ALL)"


@query("correlations", f"WITH {_COR} SELECT feature_1, feature_2, round(cor, 6) AS cor FROM r")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlations(embeddings(spark, sf)).select("feature_1", "feature_2", "cor"))


@query("cor_cut", f"WITH {_COR} SELECT feature_2 AS com1, feature_1 AS com2, round(cor, 6) AS cor FROM r WHERE abs(cor) >= 0.05")
def cor_cut(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.cor_cut(embeddings(spark, sf), 0.05, absolute=True))


_MID = "rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0"


@query("cor_spearman", f"WITH {EV}, k AS (SELECT sample_id, feature, feature_idx, {_MID} AS r FROM ev) SELECT a.feature AS feature_1, b.feature AS feature_2, round(corr(a.r, b.r), 6) AS cor FROM k a JOIN k b USING (sample_id) WHERE a.feature_idx < b.feature_idx GROUP BY ALL")
def cor_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlations(events(spark, sf), "spearman").select("feature_1", "feature_2", "cor"))


@query("cor_pairwise_missing", f"WITH {EV}, z AS (SELECT sample_id, feature, feature_idx, CASE WHEN feature_idx = 0 AND sample_id % 5 = 0 OR feature_idx = 1 AND sample_id % 7 = 0 THEN NULL ELSE value END AS value FROM ev) SELECT a.feature AS feature_1, b.feature AS feature_2, count(a.value + b.value) AS n, round(corr(a.value, b.value), 6) AS cor FROM z a JOIN z b USING (sample_id) WHERE a.feature_idx < b.feature_idx GROUP BY ALL")
def cor_pairwise_missing(spark: SparkSession, sf: str) -> DataFrame:
    gone = ((F.col("feature_idx") == 0) & (F.col("sample_id") % 5 == 0)) | ((F.col("feature_idx") == 1) & (F.col("sample_id") % 7 == 0))
    return rounded(correlation.correlations(events(spark, sf).withColumn("value", F.when(~gone, F.col("value")))).select("feature_1", "feature_2", "n", "cor"))


@query("cor_kendall")
def cor_kendall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlations(events(spark, sf, ("value", "k", "user")), "kendall").select("feature_1", "feature_2", "cor"))


@query("cor_cross", f"WITH {EM} SELECT a.feature AS feature_1, b.feature AS feature_2, round(corr(a.value, b.value), 6) AS cor FROM em a JOIN em b USING (sample_id) WHERE a.feature_idx < 32 AND b.feature_idx >= 32 GROUP BY ALL")
def cor_cross(spark: SparkSession, sf: str) -> DataFrame:
    long = embeddings(spark, sf)
    return rounded(correlation.cross_correlations(long.where("feature_idx < 32"), long.where("feature_idx >= 32").withColumn("feature_idx", F.col("feature_idx") - 32)))


@query("cor_hcl")
def cor_hcl(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.cor_hcl(embeddings(spark, sf), 0.05)


@query("cor_heat")
def cor_heat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.cor_heat(embeddings(spark, sf))[0])


@query("cor_heat_gram")
def cor_heat_gram(spark: SparkSession, sf: str) -> DataFrame:
    long = embeddings(spark, sf)
    return rounded(correlation.cor_heat_gram(long.where("feature_idx < 32"), long.where("feature_idx >= 32").withColumn("feature_idx", F.col("feature_idx") - 32)))


# models

_COV = "m AS (SELECT avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b, var_samp(user_id) AS c FROM events), e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m)"


@query("pca_variance", f"WITH {_COV} SELECT pc, round(100 * l / (l1 + l2), 2) AS pct_var FROM (SELECT CAST(1 AS BIGINT) AS pc, l1 AS l, l1, l2 FROM e UNION ALL SELECT 2, l2, l1, l2 FROM e)")
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    return plotdata.pca_comp(event_vectors(spark, sf, ["value", "user"]))[1].select("pc", "pct_var")


@query(
    "pca_scores",
    f"WITH {_COV}, v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS ux, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS uy FROM e), w AS (SELECT *, CASE WHEN abs(ux) >= abs(uy) THEN sign(ux) ELSE sign(uy) END AS s1 FROM v) SELECT event_id AS sample_id, round(s1 * ((value - mx) * ux + (user_id - my) * uy), 4) AS score FROM events, w",
)
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    points = plotdata.pca_comp(event_vectors(spark, sf, ["value", "user"]))[0]
    return rounded(points.where("pc = 1").select("sample_id", "score"), 4)


@query(
    "pca_outlier",
    "WITH m AS (SELECT avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b, var_samp(user_id) AS c FROM events), d AS (SELECT event_id AS sample_id, sqrt((pow(value - mx, 2) * c - 2 * (value - mx) * (user_id - my) * b + pow(user_id - my, 2) * a) / (a * c - b * b)) AS d FROM events, m) SELECT sample_id, round(d, 6) AS dist, d > sqrt(-2 * ln(0.025)) AS outlier FROM d",
)
def pca_outlier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.pca_outlier(event_vectors(spark, sf, ["value", "user"])).select("sample_id", "dist", "outlier"))


def lda_sql() -> str:
    """Two-class LDA of two features has a closed form."""
    return (
        "WITH v AS (SELECT event_id AS sample_id, event_type AS cls, value AS x, CAST(user_id AS DOUBLE) AS y FROM events WHERE event_type IN ('click', 'view')), c AS (SELECT cls, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) * (count(*) - 1) AS sxx, covar_samp(x, y) * (count(*) - 1) AS sxy, var_samp(y) * (count(*) - 1) AS syy FROM v GROUP BY cls), "
        "w AS (SELECT sum(n) AS n, sum(sxx) / (sum(n) - 2) AS a, sum(sxy) / (sum(n) - 2) AS b, sum(syy) / (sum(n) - 2) AS d FROM c), t AS (SELECT sample_id, v.cls AS obs, c.cls, ((x - mx) * (x - mx) * d - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a) / (a * d - b * b) - 2 * ln(c.n / w.n) AS q FROM v, c, w), "
        "p AS (SELECT sample_id, obs, max(q) FILTER (cls = 'click') AS q0, max(q) FILTER (cls = 'view') AS q1 FROM t GROUP BY ALL) SELECT sample_id, obs, CASE WHEN q0 <= q1 THEN 'click' ELSE 'view' END AS pred, round(1 / (1 + exp((q0 - q1) / 2)), 6) AS p_click FROM p"
    )


@query("lda_posterior", lda_sql())
def lda_posterior(spark: SparkSession, sf: str) -> DataFrame:
    v = event_vectors(spark, sf, ["value", "user"]).where(F.col("cls").isin("click", "view"))
    p = models.predict(v, models.fit(v, "lda"))
    return rounded(p.select("sample_id", "obs", "pred", F.get("posterior", F.lit(0)).alias("p_click")))


def _model(name: str, method: str, **options) -> None:
    def preds(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        p = models.predict(v, models.fit(v, method, **options))
        return rounded(p.select("sample_id", "obs", "pred", F.round(F.array_max("posterior"), 6).alias("p_max")))

    def scored(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        s = models.scores(v, models.fit(v, method, **options)).select("sample_id", F.posexplode("scores").alias("axis", "score"))
        return rounded(s)

    query(f"{name}_predict")(preds)
    if method != "qda":
        query(f"{name}_scores")(scored)


_model("lda", "lda")
_model("pcalda", "pcalda", ncomp=20)
_model("plsc", "plsc")
_model("plsc_kernel", "plsc", pls="kernelpls")
_model("plslda", "plslda")


@query("qda_predict")
def qda_predict(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    # a covariance for each class needs more rows than dimensions: all 64 wherever the least class has 65 rows
    least = v.groupBy("cls").count().agg(F.min("count")).first()[0]
    if least <= len(EMBEDDING_NAMES):
        v = vectors(spark, sf, features=least - 1)
    p = models.predict(v, models.fit(v, "qda"))
    return rounded(p.select("sample_id", "obs", "pred", F.array_max("posterior").alias("p_max")))


for _m in ("wold", "sjoblom", "wise"):

    @query(f"osc_{_m}")
    def osc(spark: SparkSession, sf: str, m: str = _m) -> DataFrame:
        v = vectors(spark, sf)
        states = models.gather(v, frame.levels(v))[0]
        model = models.OSC.fit(states, m, osc_ncomp=2)
        rows, _ = models.osc_predict(v, model)
        return rounded(rows.select("sample_id", F.posexplode("features").alias("feature_idx", "value")))


_RANK = {"fs_pca": multirank.fs_pca, "fs_pls": multirank.fs_pls, "fs_plsvip": multirank.fs_plsvip, "fs_plsvip_1": multirank.fs_plsvip_1, "fs_plsvip_2": multirank.fs_plsvip_2, "fs_rfe": multirank.fs_rfe}
for _name, _f in _RANK.items():
    query(_name)(lambda spark, sf, f=_f: rounded(f(vectors(spark, sf), EMBEDDING_NAMES).select("feature", "stat", "fs_rank")))


@query("fs_rf")
def fs_rf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multirank.fs_rf(vectors(spark, sf), EMBEDDING_NAMES, trees=100).select("feature", "stat", "fs_rank"))


@query("fs_rf_1")
def fs_rf_1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multirank.fs_rf_1(vectors(spark, sf), EMBEDDING_NAMES, trees=50).select("feature", "stat", "fs_rank"))


def _cv_query(name: str, method: str, labels: list[str] | None = None, plan: Plan = Plan("cv", 2, 5), **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(validate.accest(vectors(spark, sf, labels), method, plan, **options).summary)

    query(name)(run)


_cv_query("lda_cv", "lda")
_cv_query("pcalda_cv", "pcalda", ncomp=20)
_cv_query("plsc_cv", "plsc")
_cv_query("plslda_cv", "plslda")
_cv_query("svm_cv", "svm")
_cv_query("rf_cv", "randomForest", plan=Plan("cv", 1, 3), trees=30)
_cv_query("lda_two_class_cv", "lda", ["0", "1"])


@query("boot_lda")
def boot_lda(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.accest(vectors(spark, sf), "lda", Plan("boot", 2, 5)).boot)


@query("maccest_anova")
def maccest_anova(spark: SparkSession, sf: str) -> DataFrame:
    found = validate.maccest(vectors(spark, sf), ["lda", "plsc", "knn"], Plan("cv", 3, 5))
    return rounded(found.tests["pairs"])


@query("maccest_friedman")
def maccest_friedman(spark: SparkSession, sf: str) -> DataFrame:
    found = validate.maccest(vectors(spark, sf), ["lda", "plsc"], Plan("cv", 4, 3), comp="fried")
    return rounded(found.tests["pairs"])


@query("mc_norm")
def mc_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.mc_norm(events_wide(spark, sf).select(F.col("event_type").alias("method"), F.log1p("value").alias("acc"))))


@query("binest_lda")
def binest_lda(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.binest(vectors(spark, sf), "lda", plan=Plan("cv", 1, 5)))


@query("frankvali_knn")
def frankvali_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf, ["0", "1"])  # fs.auc ranks for two classes
    return rounded(validate.frankvali(v, embeddings(spark, sf, ["0", "1"]), "knn", "fs.auc", Plan("cv", 1, 3)).err_avg)


@query("fs_cl_lda")
def fs_cl_lda(spark: SparkSession, sf: str) -> DataFrame:
    return validate.fs_cl(vectors(spark, sf), list(range(64)), [2, 4, 8, 16], "lda", Plan("cv", 1, 5))


@query("fs_cl_1_lda")
def fs_cl_1_lda(spark: SparkSession, sf: str) -> DataFrame:
    return validate.fs_cl_1(vectors(spark, sf), [3, 1, 2], "lda", Plan("cv", 1, 5))


# what a user brings, with resampling


def class_mean_range(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A ranker: the range of a feature's class means."""
    means = np.array([x[y == c].mean(axis=0) for c in np.unique(y)])
    return means.max(axis=0) - means.min(axis=0)


def centroids(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    labels = np.unique(y)
    return labels, np.array([x[y == c].mean(axis=0) for c in labels])


def nearest_centroid(model: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    labels, means = model
    return labels[((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)]


_MEANS = f"{_cv(False)}, {EM}, c AS (SELECT iter, rep, feature, feature_idx, em.cls, avg(value) AS m FROM em JOIN splits USING (sample_id) WHERE mult = 1 GROUP BY ALL)"


@query(
    "own_ranker_cv",
    f"WITH {_MEANS}, g AS (SELECT iter, rep, feature, feature_idx, max(m) - min(m) AS stat FROM c GROUP BY ALL) SELECT CAST(iter AS BIGINT) AS iter, CAST(rep AS BIGINT) AS rep, feature, round(stat, 6) AS stat, row_number() OVER (PARTITION BY iter, rep ORDER BY stat DESC, feature_idx) AS fs_rank FROM g",
)
def own_ranker_cv(spark: SparkSession, sf: str) -> DataFrame:
    found = rank.rank_resampled(embeddings(spark, sf), resample.splits(vectors(spark, sf), _PLAN), class_mean_range)
    return rounded(found.select("iter", "rep", "feature", "stat", "fs_rank"))


@query(
    "own_classifier_cv",
    f"WITH {_MEANS}, d AS (SELECT c.iter, c.rep, em.sample_id, em.cls AS obs, c.cls, sum((value - m) * (value - m)) AS d FROM em JOIN splits x ON x.sample_id = em.sample_id AND x.mult = 0 JOIN c ON c.iter = x.iter AND c.rep = x.rep AND c.feature = em.feature GROUP BY ALL) "
    "SELECT CAST(iter AS BIGINT) AS iter, CAST(rep AS BIGINT) AS rep, sample_id, obs, arg_min(cls, d) AS pred FROM d GROUP BY iter, rep, sample_id, obs",
)
def own_classifier_cv(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    own = validate.Classifier("centroid", centroids, nearest_centroid)
    return rounded(validate.accest(v, own, _PLAN, resample.splits(v, _PLAN)).preds.select("iter", "rep", "sample_id", "obs", "pred"))


@query("feat_mfs_mixed")
def feat_mfs_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Univariate, forest and elimination rankings of the same resamples."""
    splits = resample.checked_splits(vectors(spark, sf), Plan("cv", 1, 5))
    return rounded(rank.feat_mfs(embeddings(spark, sf), ["fs.anova", "fs.rf", "fs.rfe", "fs.plsvip"], splits, {"fs.rf": {"trees": 20}}).select("method", "feature", "stat", "fs_rank"))


@query("feat_mfs_stab")
def feat_mfs_stab(spark: SparkSession, sf: str) -> DataFrame:
    splits = resample.checked_splits(vectors(spark, sf), Plan("cv", 2, 5))
    return rounded(rank.feat_mfs_stab(embeddings(spark, sf), ["fs.bw", "fs.pls", "fs.pca"], splits)["freq"].select("method", "feature", "freq", "kept"))


@query("frankvali_rfe")
def frankvali_rfe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.frankvali(vectors(spark, sf), embeddings(spark, sf), "lda", "fs.rfe", Plan("boot", 2, 4), [1, 2, 3, 5, 8, 13, 21, 34]).err_all)


@query("aam")
def aam(spark: SparkSession, sf: str) -> DataFrame:
    return validate.aam(vectors(spark, sf), ["lda", "plsc", "pcalda"], Plan("cv", 2, 5), {"pcalda": {"ncomp": 20}})


@query("tune_plsc")
def tune_plsc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.tune_plsc(vectors(spark, sf), 6).table)


@query("tune_plslda")
def tune_plslda(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.tune_plslda(vectors(spark, sf), 6).table)


@query("tune_pcalda")
def tune_pcalda(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.tune_pcalda(vectors(spark, sf), [5, 10, 20, 40]).table)


@query("tune_pcalda_2")
def tune_pcalda_2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.tune_pcalda_scores(vectors(spark, sf), 12).table)


# plot data


@query(
    "box_stats",
    f"WITH {EV}, q AS (SELECT feature, cls, count(*) AS n, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM ev GROUP BY ALL), e AS (SELECT ev.feature, ev.cls, min(value) AS lo, max(value) AS hi FROM ev JOIN q ON ev.feature = q.feature AND ev.cls = q.cls WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY ALL) "
    "SELECT q.feature, q.cls, n, round(lo, 6) AS whisker_low, round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, round(hi, 6) AS whisker_high FROM q JOIN e ON q.feature = e.feature AND q.cls = e.cls",
)
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.grpplot(events(spark, sf), "box").drop("feature_idx"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return events_wide(spark, sf).select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("cls"), F.col("value").alias("x"), F.col("user").alias("y"))


@query(
    "ellipse_points",
    "WITH s AS (SELECT event_type AS cls, avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b, var_samp(user_id) AS c FROM events GROUP BY event_type) SELECT cls, k, round(mx + sqrt(-2 * ln(0.025)) * sqrt(a) * cos(k * 2 * pi() / 99), 4) AS x, round(my + sqrt(-2 * ln(0.025)) * (b / sqrt(a) * cos(k * 2 * pi() / 99) + sqrt(a * c - b * b) / sqrt(a) * sin(k * 2 * pi() / 99)), 4) AS y FROM s, range(0, 100) AS r(k)",
)
def ellipse_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.ellipses(points(spark, sf), ["cls"]), 4)


@query("regression_line", "SELECT event_type AS cls, count(*) AS n, round(regr_slope(user_id, value), 6) AS slope, round(regr_intercept(user_id, value), 6) AS intercept FROM events GROUP BY event_type")
def regression_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.regression_line(points(spark, sf), ["cls"]))


@query("smooth_line")
def smooth_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.smooth_line(points(spark, sf), ["cls"]))


@query("group_outliers", "WITH s AS (SELECT event_type AS cls, avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b, var_samp(user_id) AS c FROM events GROUP BY event_type) SELECT event_id AS sample_id, cls, round(sqrt((pow(value - mx, 2) * c - 2 * (value - mx) * (user_id - my) * b + pow(user_id - my, 2) * a) / (a * c - b * b)), 6) AS dist FROM events JOIN s ON cls = event_type")
def group_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.outliers(points(spark, sf), ["cls"]).select("sample_id", "cls", "dist"))


@query("density")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.density(events(spark, sf, ("value",)), ["feature", "cls"]), 9)


@query("pairs_plot")
def pairs_plot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.grpplot(events(spark, sf, ("value", "k", "user")), "pairs"))


for _metric in ("euclidean", "manhattan"):
    query(f"mds_{_metric}")(lambda spark, sf, m=_metric: rounded(plotdata.mds(vectors(spark, sf), m)))


for _kind, _opt in (("pca", {}), ("lda", {"ncomp": 20}), ("pls", {})):
    query(f"{_kind}_panels")(lambda spark, sf, k=_kind, o=_opt: rounded(plotdata.wrap({"even": vectors(spark, sf, list("02468")), "odd": vectors(spark, sf, list("13579"))}, k, **o)[0]))


@query("corrgram_ellipse")
def corrgram_ellipse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.corrgram(correlation.correlations(embeddings(spark, sf)).select("feature_1", "feature_2", "cor")))


@query("class_means_by_moments", f"WITH {EM} SELECT cls, count(DISTINCT sample_id) AS n, round(avg(value) FILTER (feature = 'f00'), 6) AS f00 FROM em GROUP BY cls")
def class_means_by_moments(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    m = models.gather(v, frame.levels(v))[0]
    return rounded(spark.createDataFrame([(c, int(n), float(x[0])) for c, n, x in zip(m.labels, m.counts, m.means, strict=True)], "cls string, n long, f00 double"))
