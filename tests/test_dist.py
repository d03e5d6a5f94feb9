"""Distribution functions against published values and by their own identities."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkomics.functions import dist


def close(a, b, tol=1e-6):
    return abs(float(a) - b) < tol


def test_known_values():
    assert close(dist.norm_sf(1.959963984540054), 0.025, 1e-12)
    assert close(dist.t_two_sided(2.2281388519649385, 10), 0.05, 1e-9)
    assert close(dist.t_ppf(0.975, 10), 2.2281388519649385, 1e-6)
    assert close(dist.f_sf(4.102821, 2, 10), 0.05)
    assert close(dist.chi2_sf(5.991464547107979, 2), 0.05, 1e-10)
    assert close(dist.chi2_sf(18.307038, 10), 0.05)
    assert close(dist.tukey_sf(3.877676, 3, 10), 0.05, 2e-4)
    assert close(dist.tukey_sf(3.314493, 3, 1e9), 0.05, 1e-4)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.1, 30), st.floats(0.1, 30), st.floats(0.001, 0.999))
def test_beta_symmetry(a, b, x):
    assert close(dist.beta_inc(a, b, x) + dist.beta_inc(b, a, 1 - x), 1, 1e-9)


def test_wilcoxon_exact_by_enumeration():
    n1, n2 = 4, 5
    ws = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for w in range(n1 * n2 + 1):
        low, high = np.mean([v <= w for v in ws]), np.mean([v >= w for v in ws])
        assert close(dist.wilcoxon_exact(w, n1, n2), min(1, 2 * min(low, high)), 1e-12)
    assert math.isnan(dist.wilcoxon_p(0, 0, 3, 0))
    assert 0.9 < dist.wilcoxon_p(1250, 50, 50, 0) <= 1


def test_shapiro():
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = dist.shapiro(np.array(x, dtype=float))
    assert close(w, 0.79, 0.005) and p < 0.01
    assert all(math.isnan(v) for v in dist.shapiro(np.ones(5)))
    assert dist.shapiro(np.random.default_rng(1).normal(size=200))[1] > 0.01


def test_adjust():
    p = np.array([0.01, 0.02, 0.03, np.nan, 0.04])
    assert np.allclose(dist.adjust(p, "bonferroni"), [0.04, 0.08, 0.12, np.nan, 0.16], equal_nan=True)
    assert np.allclose(dist.adjust(p, "BH"), [0.04, 0.04, 0.04, np.nan, 0.04], equal_nan=True)
    assert np.allclose(dist.adjust(p, "holm"), [0.04, 0.06, 0.06, np.nan, 0.06], equal_nan=True)
    assert np.allclose(dist.adjust(p, "hommel"), [0.04, 0.04, 0.04, np.nan, 0.04], equal_nan=True)
    with pytest.raises(ValueError):
        dist.adjust(p, "other")


def test_columns_give_null_outside_their_domain(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (1.0, 0.0), (1.0, None)], "t double, df double")
    got = [r[0] for r in df.select(dist.t_pvalue("t", "df"), F.col("t")).collect()]
    assert close(got[0], float(dist.t_two_sided(1, 5)), 1e-12) and got[1:] == [None] * 3
