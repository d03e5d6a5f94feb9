"""Queries on the long frame with their SQL: reshaping, missing values, scaling, summaries, tests, rankings, adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, frame, prep, rank, summary
from .fixtures import CU, EM2, EV, EV2, LI, LINE_FEATURES, customers, embeddings, events, events_wide, lines

QUERIES: dict = {}
ORACLES: dict = {}
EPS = "2.220446049250313e-16"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, whole numbers as long: what both engines print alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns])


def cells(df: DataFrame, places: int = 6) -> DataFrame:
    return rounded(df.select("sample_id", "feature", "value"), places)


CELLS = "SELECT sample_id, feature, round(value, 6) AS value FROM"


@query("long_unpivot", f"WITH {EV} SELECT sample_id, cls, feature, CAST(feature_idx AS BIGINT) AS feature_idx, round(value, 6) AS value FROM ev")
def long_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf))


@query("wide_pivot", 'SELECT event_id AS sample_id, event_type AS cls, value, CAST(user_id AS DOUBLE) AS "user" FROM events')
def wide_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return frame.to_wide(events(spark, sf, ("value", "user")), ["value", "user"])


@query("class_indicator", "SELECT event_id AS sample_id, " + ", ".join(f"CAST(event_type = '{c}' AS INTEGER) AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def class_indicator(spark: SparkSession, sf: str) -> DataFrame:
    return frame.indicator(events(spark, sf, ("value",)), ["click", "error", "purchase", "signup", "view"])


@query("melt_wide", f"WITH {LI}, m AS (SELECT cls, feature, avg(value) AS v FROM li GROUP BY cls, feature) SELECT cls AS \"row\", feature AS \"column\", round(v, 6) AS value FROM m")
def melt_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = lines(spark, sf).groupBy("cls").pivot("feature", LINE_FEATURES).agg(F.avg("value"))
    return rounded(frame.melt(wide, "cls", LINE_FEATURES))


@query("formula_frame", "SELECT c_custkey AS sample_id, c_mktsegment AS cls, round(c_acctbal, 6) AS a, CAST(c_nationkey AS DOUBLE) AS b, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER)::DOUBLE AS s{i}" for i, s in enumerate(("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))) + " FROM customer")
def formula_frame(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import read_table

    v = frame.model_frame(read_table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey")
    return v.select("sample_id", "cls", F.round(F.get("features", F.lit(0)), 6).alias("a"), F.get("features", F.lit(1)).alias("b"), *[F.get("features", F.lit(2 + i)).alias(f"s{i}") for i in range(4)])


# missing values


@query("mv_zene", f"WITH {CU} SELECT sample_id, feature, round(CASE WHEN value >= {EPS} THEN value END, 6) AS value FROM cu")
def mv_zene(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.mv_zene(customers(spark, sf)))


for _method, _sql in (("mean", "avg"), ("median", "median")):
    query(
        f"mv_fill_{_method}",
        f"WITH {CU}, z AS (SELECT sample_id, feature, CASE WHEN value >= {EPS} THEN value END AS value FROM cu), m AS (SELECT feature, {_sql}(value) AS f FROM z GROUP BY feature) "
        "SELECT sample_id, feature, round(coalesce(value, f), 6) AS value FROM z JOIN m USING (feature)",
    )(lambda spark, sf, m=_method: cells(prep.mv_fill(customers(spark, sf), m, ze_ne=True)))


@query(
    "mv_stats",
    f"WITH {LI}, z AS (SELECT feature, cls, CASE WHEN value >= {EPS} THEN 0 ELSE 1 END AS miss FROM li), g AS (SELECT feature, cls, GROUPING(feature) + GROUPING(cls) AS g, avg(miss) AS rate FROM z GROUP BY GROUPING SETS ((), (feature), (feature, cls))) "
    "SELECT CASE g WHEN 2 THEN 'overall' WHEN 1 THEN 'feature' ELSE 'class' END AS level, feature, cls, round(rate, 6) AS rate FROM g",
)
def mv_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.mv_stats(prep.mv_zene(lines(spark, sf))))


@query(
    "mv_pattern",
    f"WITH {CU}, p AS (SELECT sample_id, string_agg(CASE WHEN value >= {EPS} THEN '1' ELSE '0' END, '' ORDER BY feature_idx) AS pattern FROM cu GROUP BY sample_id) "
    "SELECT pattern, count(*) AS n, CAST(length(replace(pattern, '1', '')) AS BIGINT) AS n_missing FROM p GROUP BY pattern",
)
def mv_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return prep.mv_pattern(prep.mv_zene(customers(spark, sf)))


@query(
    "mv_filter_rate",
    f"WITH {CU}, z AS (SELECT sample_id, feature, CASE WHEN value >= {EPS} THEN value END AS value FROM cu), k AS (SELECT feature FROM z GROUP BY feature HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) < 0.06) {CELLS} z WHERE feature IN (SELECT feature FROM k)",
)
def mv_filter_rate(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.mv_filter(prep.mv_zene(customers(spark, sf)), 0.06))


# scaling and transformation

_STATS = f"WITH {EV2}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, max(value) AS hi, min(value) AS lo FROM ev GROUP BY feature) SELECT sample_id, feature, round("
_FORMS = {
    "center": "value - m",
    "auto": "(value - m) / nullif(s, 0)",
    "range": "(value - m) / nullif(hi - lo, 0)",
    "pareto": "(value - m) / sqrt(nullif(s, 0))",
    "vast": "(value - m) * m / (nullif(s, 0) * s)",
    "level": "(value - m) / nullif(m, 0)",
    "log": "CASE WHEN value + 1 > 0 THEN ln(value + 1) END",
    "log10": "CASE WHEN value + 1 > 0 THEN log10(value + 1) END",
    "sqrt": "CASE WHEN value >= 0 THEN sqrt(value) END",
    "asinh": "ln(value + sqrt(value * value + 1))",
}
for _name, _form in _FORMS.items():
    query(f"prep_{_name}", f"{_STATS}{_form}, 6) AS value FROM ev JOIN s USING (feature)")(lambda spark, sf, m=_name: cells(prep.preproc(events(spark, sf, ("value", "k")), m)))


@query("prep_tic", f"WITH {EV}, t AS (SELECT sample_id, sum(value) AS t FROM ev GROUP BY sample_id) SELECT sample_id, feature, round(value / nullif(t, 0), 6) AS value FROM ev JOIN t USING (sample_id)")
def prep_tic(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.preproc(events(spark, sf), "TICnorm"))


@query(
    "prep_tic_grouped",
    f"WITH {EV}, t AS (SELECT sample_id, cls, sum(value) AS t FROM ev GROUP BY sample_id, cls), c AS (SELECT cls, avg(t) AS cm FROM t GROUP BY cls), a AS (SELECT avg(t) AS am FROM t) "
    "SELECT sample_id, feature, round(value / nullif(t - (cm - am), 0), 6) AS value FROM ev JOIN t USING (sample_id, cls) JOIN c USING (cls), a",
)
def prep_tic_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.preproc(events(spark, sf), "TICnorm", grouped=True))


@query(
    "prep_chain_log_auto",
    f"WITH {EV2}, l AS (SELECT sample_id, feature, ln(value + 1) AS value FROM ev), s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY feature) SELECT sample_id, feature, round((value - m) / nullif(s, 0), 6) AS value FROM l JOIN s USING (feature)",
)
def prep_chain(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.preproc(events(spark, sf, ("value", "k")), ["log", "auto"]))


@query("prep_sd", f"WITH {LI}, s AS (SELECT feature, cls, stddev_samp(value) AS s FROM li GROUP BY feature, cls), k AS (SELECT feature FROM s GROUP BY feature HAVING min(s) > {EPS}) SELECT feature, count(*) AS n, round(avg(value), 8) AS mean FROM li WHERE feature IN (SELECT feature FROM k) GROUP BY feature")
def prep_sd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.preproc_sd(lines(spark, sf), True).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 8)


@query(
    "prep_const",
    f"WITH {LI}, r AS (SELECT feature, value - avg(value) OVER (PARTITION BY feature, cls) AS e FROM li), k AS (SELECT feature FROM r GROUP BY feature HAVING stddev_samp(e) >= 0.03) SELECT feature, count(*) AS n, round(avg(value), 8) AS mean FROM li WHERE feature IN (SELECT feature FROM k) GROUP BY feature",
)
def prep_const(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.preproc_const(lines(spark, sf), 0.03).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 8)


@query(
    "fold_change",
    f"WITH {LI}, m AS (SELECT feature, avg(value) FILTER (cls = 'A') AS a, avg(value) FILTER (cls = 'R') AS b FROM li GROUP BY feature), f AS (SELECT feature, CASE WHEN b >= a THEN b / nullif(a, 0) ELSE -a / nullif(b, 0) END AS fc FROM m) "
    "SELECT feature, round(fc, 6) AS fc, round(log2(CASE WHEN fc < 0 THEN -1 / fc ELSE fc END), 6) AS lfc, round(fc, 6) AS back FROM f",
)
def fold_change(spark: SparkSession, sf: str) -> DataFrame:
    m = lines(spark, sf).groupBy("feature").agg(F.avg(F.when(F.col("cls") == "A", F.col("value"))).alias("a"), F.avg(F.when(F.col("cls") == "R", F.col("value"))).alias("b"))
    f = m.select("feature", prep.fold_change(F.col("b"), F.col("a")).alias("fc"))
    f = f.withColumn("lfc", prep.fold_change_to_log(F.col("fc")))
    return rounded(f.withColumn("back", prep.log_to_fold_change(F.col("lfc"))))


# summaries

_SUMM = "count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(stddev_samp(value), 6) AS std"


@query("vec_summ", f"WITH {LI} SELECT feature, {_SUMM} FROM li GROUP BY feature")
def vec_summ(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.vec_summ(lines(spark, sf)).drop("feature_idx"))


@query("df_summ_by_class", f"WITH {LI} SELECT feature, cls, {_SUMM} FROM li GROUP BY feature, cls")
def df_summ_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.df_summ(lines(spark, sf), ["cls"]).drop("feature_idx"))


@query("vec_summ_1", f"WITH {LI} SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_samp(value), 6) AS std FROM li GROUP BY feature")
def vec_summ_1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.vec_summ_1(lines(spark, sf)).select("feature", "n", "mean", "median", "iqr", "std"))


@query("vec_summ_1_interval")
def vec_summ_1_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.vec_summ_1(lines(spark, sf)).select("feature", "n", "mean", "ci_low", "ci_high"))


# tests and rankings

_MOM = f"{EM2}, c AS (SELECT feature, feature_idx, cls, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM em GROUP BY ALL), t AS (SELECT a.feature, a.feature_idx, a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM c a JOIN c b USING (feature) WHERE a.cls = '0' AND b.cls = '1')"
_WELCH = f"{_MOM}, w AS (SELECT feature, feature_idx, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM t)"
_T_P = (
    ", g AS (SELECT *, atan(abs(stat) / sqrt(df)) AS top FROM w), s AS (SELECT feature, sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(top * i / 2000.0), df - 1)) * top AS part, "
    "sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(pi() / 2 * i / 2000.0), df - 1)) * pi() / 2 AS whole FROM g, range(0, 2001) AS r(i) GROUP BY feature, top), p AS (SELECT w.*, 1 - part / whole AS pval FROM w JOIN s USING (feature))"
)
RANK = "row_number() OVER (ORDER BY {key}, feature_idx) AS fs_rank"


def two(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf, ["0", "1"])


@query("fs_welch", f"WITH {_WELCH}{_T_P} SELECT feature, round(abs(stat), 6) AS stat, round(df, 6) AS df, round(pval, 6) AS pval, {RANK.format(key='abs(stat) DESC')} FROM p")
def fs_welch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_welch(two(spark, sf)).select("feature", "stat", "df", "pval", "fs_rank"))


@query("fs_welch_1", f"WITH {_WELCH}{_T_P} SELECT feature, round(stat, 6) AS stat, round(pval, 6) AS pval, {RANK.format(key='round(pval, 12)')} FROM p")
def fs_welch_1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_welch_1(two(spark, sf)).select("feature", "stat", "pval", "fs_rank"))


@query("fs_snr", f"WITH {_MOM} SELECT feature, round(abs(m1 - m2) / (sqrt(v1) + sqrt(v2)), 6) AS stat, {RANK.format(key='abs(m1 - m2) / (sqrt(v1) + sqrt(v2)) DESC')} FROM t")
def fs_snr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_snr(two(spark, sf)).select("feature", "stat", "fs_rank"))


_EVM = f"{EV}, c AS (SELECT feature, feature_idx, cls, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL), o AS (SELECT feature, avg(value) AS mean FROM ev GROUP BY feature), b AS (SELECT feature, feature_idx, count(*) AS k, sum(n) AS n, sum(n * pow(m - mean, 2)) AS bss, sum((n - 1) * v) AS wss FROM c JOIN o USING (feature) GROUP BY feature, feature_idx)"


@query("fs_bw", f"WITH {_EVM} SELECT feature, round(bss / wss, 9) AS stat, {RANK.format(key='bss / wss DESC')} FROM b")
def fs_bw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_bw(events(spark, sf)).select("feature", "stat", "fs_rank"), 9)


@query(
    "fs_anova",
    f"WITH {_EVM}, f AS (SELECT *, (bss / (k - 1)) / (wss / (n - k)) AS stat, (n - k) / 2.0 AS hb FROM b), x AS (SELECT *, (k - 1) * stat / ((k - 1) * stat + (n - k)) AS x FROM f) "
    f"SELECT feature, round(stat, 6) AS stat, round(pow(1 - x, hb) * (1 + hb * x), 6) AS pval, {RANK.format(key='stat DESC')} FROM x",
)
def fs_anova(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_anova(events(spark, sf)).select("feature", "stat", "pval", "fs_rank"))


_RANKS = "r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY feature, value) AS ties FROM {t})"


@query(
    "fs_kruskal",
    f"WITH {EV}, {_RANKS.format(t='ev')}, c AS (SELECT feature, feature_idx, cls, count(*) AS n, sum(mid) AS rs FROM r GROUP BY ALL), h AS (SELECT feature, feature_idx, sum(n) AS n, sum(rs * rs / n) AS q FROM c GROUP BY feature, feature_idx), t AS (SELECT feature, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY feature), "
    "s AS (SELECT h.feature, feature_idx, (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3.0 * (n + 1)) / (1 - tie / (pow(n, 3) - n)) AS stat FROM h JOIN t USING (feature)) "
    f"SELECT feature, round(stat, 6) AS stat, round(exp(-stat / 2) * (1 + stat / 2), 6) AS pval, {RANK.format(key='stat DESC')} FROM s",
)
def fs_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_kruskal(events(spark, sf)).select("feature", "stat", "pval", "fs_rank"))


@query("fs_wilcox", f"WITH {EM2}, {_RANKS.format(t='em')}, s AS (SELECT feature, feature_idx, sum(mid) FILTER (cls = '0') - count(*) FILTER (cls = '0') * (count(*) FILTER (cls = '0') + 1) / 2.0 AS stat FROM r GROUP BY feature, feature_idx) SELECT feature, round(stat, 6) AS stat, {RANK.format(key='stat DESC')} FROM s")
def fs_wilcox(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_wilcox(two(spark, sf)).select("feature", "stat", "fs_rank"))


@query("wilcox_pvalue")
def wilcox_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.wilcoxon(two(spark, sf)).select("feature", "stat", "pval"))


_AUC = "a AS (SELECT *, coalesce(sum(CASE WHEN {pos} THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY value DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM {t}), u AS (SELECT feature, feature_idx, sum(CASE WHEN {pos} THEN 0 ELSE above END) / (CAST(sum(CASE WHEN {pos} THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN {pos} THEN 0 ELSE 1 END)) AS raw FROM a GROUP BY feature, feature_idx)"


@query("fs_auc", f"WITH {EM2}, {_AUC.format(t='em', pos=chr(99) + 'ls = ' + repr('1'))} SELECT feature, round(greatest(raw, 1 - raw), 6) AS stat, round(raw, 6) AS raw_auc, {RANK.format(key='greatest(raw, 1 - raw) DESC')} FROM u")
def fs_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_auc(two(spark, sf)).select("feature", "stat", "raw_auc", "fs_rank"))


@query("fs_auc_ties", f"WITH ev AS (SELECT * FROM ({EV[7:-1]}) WHERE cls IN ('click', 'view')), {_AUC.format(t='ev', pos=chr(99) + 'ls = ' + repr('view'))} SELECT feature, round(greatest(raw, 1 - raw), 6) AS stat FROM u")
def fs_auc_ties(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank.fs_auc(events(spark, sf).where(F.col("cls").isin("click", "view"))).select("feature", "stat"))


_ONEWAY = (
    f"{EV}, c AS (SELECT feature, feature_idx, cls, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL), w AS (SELECT *, n / v AS w, sum(n / v) OVER (PARTITION BY feature) AS w_all, sum(n / v * m) OVER (PARTITION BY feature) / sum(n / v) OVER (PARTITION BY feature) AS mm, count(*) OVER (PARTITION BY feature) AS k FROM c), "
    "q AS (SELECT feature, feature_idx, max(k) AS k, sum(w * pow(m - mm, 2)) AS top, sum(pow(1 - w / w_all, 2) / (n - 1)) / (pow(max(k), 2) - 1) AS t FROM w GROUP BY feature, feature_idx), f AS (SELECT *, top / ((k - 1) * (1 + 2 * (k - 2) * t)) AS stat, 1 / (3 * t) AS df2 FROM q), "
    "p AS (SELECT *, pow(1 - (k - 1) * stat / ((k - 1) * stat + df2), df2 / 2) * (1 + df2 / 2 * ((k - 1) * stat / ((k - 1) * stat + df2))) AS pval FROM f)"
)


@query("pval_oneway", f"WITH {_ONEWAY} SELECT feature, round(pval, 6) AS pval FROM p")
def pval_oneway(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.pval_test(events(spark, sf)).select("feature", "pval"))


_N = "n AS (SELECT *, row_number() OVER (ORDER BY pval, feature_idx) AS i, count(*) OVER () AS m FROM p)"
_ADJ = {
    "bh": ("BH", "min(m / CAST(i AS DOUBLE) * pval) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "hochberg": ("hochberg", "min((m - i + 1) * pval) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "holm": ("holm", "max((m - i + 1) * pval) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "bonferroni": ("bonferroni", "m * pval"),
    "by": ("BY", "min(m / CAST(i AS DOUBLE) * pval * (SELECT sum(1.0 / j) FROM range(1, 65) AS r(j))) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
}
for _short, (_long, _form) in _ADJ.items():
    query(f"padj_{_short}", f"WITH {_WELCH}{_T_P}, {_N} SELECT feature, round(least(1.0, {_form}), 6) AS padj FROM n")(lambda spark, sf, m=_long: rounded(summary.p_adjust(summary.welch(two(spark, sf)), m).select("feature", "padj")))


@query("padj_hommel")
def padj_hommel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.p_adjust(summary.welch(two(spark, sf)), "hommel").select("feature", "pval", "padj"))


@query("pval_reject", f"WITH {_WELCH}{_T_P}, {_N}, a AS (SELECT least(1.0, {_ADJ['bh'][1]}) AS padj FROM n) SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(count(*) FILTER (padj <= alpha) AS BIGINT) AS n_reject FROM a, (VALUES (0.01), (0.05), (0.5)) AS v(alpha) GROUP BY alpha")
def pval_reject(spark: SparkSession, sf: str) -> DataFrame:
    return summary.pval_reject(summary.p_adjust(summary.welch(two(spark, sf)), "BH"), [0.01, 0.05, 0.5])


@query(
    "stats_mat",
    f"WITH ev AS (SELECT * FROM ({EV[7:-1]}) WHERE cls IN ('click', 'view')), {_AUC.format(t='ev', pos=chr(99) + 'ls = ' + repr('view'))}, m AS (SELECT feature, avg(value) AS center, avg(value) FILTER (cls = 'click') AS c1, avg(value) FILTER (cls = 'view') AS c2 FROM ev GROUP BY feature), "
    "f AS (SELECT *, CASE WHEN c2 >= c1 THEN c2 / nullif(c1, 0) ELSE -c1 / nullif(c2, 0) END AS fc FROM m) SELECT f.feature, round(center, 6) AS center, round(c1, 6) AS center_1, round(c2, 6) AS center_2, round(fc, 6) AS fc, round(log2(CASE WHEN fc < 0 THEN -1 / fc ELSE fc END), 6) AS lfc, round(greatest(raw, 1 - raw), 6) AS auc FROM f JOIN u USING (feature)",
)
def stats_mat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.stats_mat(events(spark, sf).where(F.col("cls").isin("click", "view"))).select("feature", "center", "center_1", "center_2", "fc", "lfc", "auc"))


@query("stats_mat_rounded")
def stats_mat_rounded(spark: SparkSession, sf: str) -> DataFrame:
    return summary.stats_mat(events(spark, sf).where(F.col("cls").isin("click", "view")), rounded=True)


# pairs


@query("combn_pw", "SELECT e.event_id AS sample_id, cls, a || '~' || b AS pair, cls IN (a, b) AS member FROM (SELECT event_id, event_type AS cls FROM events) e, (VALUES ('click', 'error'), ('click', 'purchase'), ('click', 'signup'), ('click', 'view')) AS p(a, b)")
def combn_pw(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf, ("value",))
    return frame.pair_membership(rows, frame.class_pairs(frame.levels(rows), "click"))


@query("dat_sel_pairs", f"WITH {EV}, c AS (SELECT DISTINCT cls FROM ev), p AS (SELECT x.cls AS a, y.cls AS b FROM c x JOIN c y ON x.cls < y.cls) SELECT a || '~' || b AS pair, cls, feature, count(*) AS n, round(avg(value), 6) AS mean FROM ev JOIN p ON cls = a OR cls = b GROUP BY ALL")
def dat_sel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    return rounded(frame.select_pairs(rows, frame.class_pairs(frame.levels(rows))).groupBy("pair", "cls", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("pair_welch", f"WITH {EV}, c AS (SELECT feature, cls, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL) SELECT a.cls || '~' || b.cls AS pair, a.feature, round(abs((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)), 6) AS stat FROM c a JOIN c b ON a.feature = b.feature AND a.cls < b.cls")
def pair_welch(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    return rounded(rank.fs_welch(frame.select_pairs(rows, frame.class_pairs(frame.levels(rows))), ["pair"]).select("pair", "feature", "stat"))


# metrics on a threshold rule


def threshold_preds(spark: SparkSession, sf: str) -> DataFrame:
    e = events_wide(spark, sf)
    return e.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("obs"), F.when(F.col("value") >= 60, "view").otherwise("click").alias("pred"), "value")


_PRED = "p AS (SELECT event_id AS sample_id, event_type AS obs, CASE WHEN value >= 60 THEN 'view' ELSE 'click' END AS pred, value FROM events WHERE event_type IN ('click', 'view'))"


@query("confusion", f"WITH {_PRED} SELECT obs, pred, count(*) AS n FROM p GROUP BY obs, pred")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(threshold_preds(spark, sf))


@query(
    "cl_rate",
    f"WITH {_PRED}, o AS (SELECT obs AS c, count(*) AS r FROM p GROUP BY obs), q AS (SELECT pred AS c, count(*) AS s FROM p GROUP BY pred), a AS (SELECT count(*) AS n, avg(CAST(obs = pred AS INTEGER)) AS acc FROM p), e AS (SELECT sum(CAST(r AS DOUBLE) * s) AS x FROM o JOIN q USING (c)) "
    "SELECT n, round(acc, 6) AS acc, round(1 - acc, 6) AS err, round((acc - x / (CAST(n AS DOUBLE) * n)) / (1 - x / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM a, e",
)
def cl_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.cl_rate(threshold_preds(spark, sf)))


@query("class_rate", f"WITH {_PRED} SELECT obs, count(*) AS n, round(avg(CAST(obs = pred AS INTEGER)), 6) AS acc FROM p GROUP BY obs")
def class_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.class_rate(threshold_preds(spark, sf)))


@query(
    "cl_perf",
    f"WITH {_PRED}, t AS (SELECT count(*) FILTER (obs = 'view' AND pred = 'view') AS tp, count(*) FILTER (obs <> 'view' AND pred = 'view') AS fp, count(*) FILTER (obs = 'view' AND pred <> 'view') AS fn, count(*) FILTER (obs <> 'view' AND pred <> 'view') AS tn FROM p) "
    "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS acc, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fn), 6) AS sens, round(tn / (tn + fp), 6) AS spec FROM t",
)
def cl_perf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.cl_perf(threshold_preds(spark, sf), "view"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_preds(spark, sf).select("sample_id", F.col("value").alias("stat"), (F.col("obs") == "view").cast("int").alias("positive"))


@query("cl_auc", f"WITH {_PRED}, a AS (SELECT *, coalesce(sum(CAST(obs = 'view' AS INTEGER)) OVER (ORDER BY value DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM p), r AS (SELECT sum(CASE WHEN obs = 'view' THEN 0 ELSE above END) / (CAST(count(*) FILTER (obs = 'view') AS DOUBLE) * count(*) FILTER (obs <> 'view')) AS raw FROM a) SELECT round(raw, 6) AS raw_auc, round(greatest(raw, 1 - raw), 6) AS auc FROM r")
def cl_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.auc(scores(spark, sf)).select("raw_auc", "auc"))


@query(
    "cl_roc",
    f"WITH {_PRED}, v AS (SELECT value, count(*) FILTER (obs = 'view') AS p, count(*) FILTER (obs <> 'view') AS q FROM p GROUP BY value), c AS (SELECT value, sum(p) OVER (ORDER BY value DESC) AS tp, sum(q) OVER (ORDER BY value DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM v) "
    "SELECT round(value, 6) AS cutoff, round((tp + nq - fp) / (np + nq), 6) AS acc, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr, round(tp / np, 6) AS sens, round(1 - fp / nq, 6) AS spec FROM c",
)
def cl_roc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.roc(scores(spark, sf)))


_TYPES = ["click", "error", "purchase", "signup", "view"]
_POST = {"click": "1 + value", "error": "1 + user_id % 7", "purchase": "1 + event_id % 11", "signup": "1 + event_id % 13", "view": "1 + user_id % 5"}


@query(
    "margin",
    "WITH s AS (SELECT event_id AS sample_id, list_position(" + str(_TYPES) + ", event_type) AS own, [" + ", ".join(f"({_POST[t]})::DOUBLE" for t in _TYPES) + "] AS p FROM events), "
    "n AS (SELECT sample_id, p[own] AS mine, list_max(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN i = own THEN NULL ELSE p[i] END), lambda x: x IS NOT NULL)) AS other, list_sum(p) AS t FROM s) SELECT sample_id, round((mine - other) / t, 6) AS margin FROM n",
)
def margin(spark: SparkSession, sf: str) -> DataFrame:
    e = events_wide(spark, sf)
    post = F.array(*[F.expr(_POST[t].replace("user_id", "user")).cast("double") for t in _TYPES])
    preds = e.select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("obs"), F.lit("click").alias("pred"), post.alias("posterior"))
    return rounded(evaluate.margin(preds, _TYPES).select("sample_id", "margin"))


@query(
    "boot_632",
    f"WITH {_PRED}, b AS (SELECT 1 - avg(CAST(obs = pred AS INTEGER)) AS e FROM p WHERE sample_id % 3 = 0), a AS (SELECT count(*) AS n, 1 - avg(CAST(obs = pred AS INTEGER)) AS a FROM p), o AS (SELECT obs AS c, count(*) AS r FROM p GROUP BY obs), q AS (SELECT pred AS c, count(*) AS s FROM p GROUP BY pred), "
    "g AS (SELECT e, a, 1 - (SELECT sum(CAST(r AS DOUBLE) * s) FROM o JOIN q USING (c)) / (CAST(n AS DOUBLE) * n) AS g FROM a, b), r AS (SELECT *, CASE WHEN e > a AND g > a THEN (e - a) / (g - a) ELSE 0 END AS r, 0.368 * a + 0.632 * e AS m FROM g) "
    "SELECT round(a, 6) AS ae, round(e, 6) AS boot, round(g, 6) AS gamma, round(m, 6) AS b632, round(m + (least(e, g) - a) * (0.368 * 0.632 * r) / (1 - 0.368 * r), 6) AS b632p FROM r",
)
def boot_632(spark: SparkSession, sf: str) -> DataFrame:
    preds = threshold_preds(spark, sf)
    return rounded(evaluate.boot_err(preds.where(F.col("sample_id") % 3 == 0), preds))
