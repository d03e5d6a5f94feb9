"""PCA, LDA, QDA, PCA-LDA, PLS-DA, PLS-LDA and OSC, fitted from ``moments.Moments`` and applied by one map over the rows.

Nothing here sees the samples: scores are linear in the features, so their inner products follow from cross-products.
Signs of axes are arbitrary; the largest loading of each is made positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frame import levels
from .moments import Moments, gather, matrix_of

TOL = 1e-9


def signs(loadings: np.ndarray) -> np.ndarray:
    """+-1 for each column, so that its entry of largest size becomes positive."""
    if not loadings.size:
        return np.ones(loadings.shape[1])
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return np.where(top < 0, -1.0, 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class PCA:
    center: np.ndarray
    loadings: np.ndarray  # (p, k), scaled features' divisors folded in
    rotation: np.ndarray  # (p, k), orthonormal
    sdev: np.ndarray

    @classmethod
    def fit(cls, m: Moments, scale: bool = False, ncomp: int | None = None, center: bool = True) -> PCA:
        cross, c = m.total(), m.mean
        if not center:
            cross, c = cross + m.n * np.outer(c, c), np.zeros_like(c)
        cov = cross / max(m.n - 1, 1)
        sd = np.sqrt(np.diag(cov)) if scale else np.ones(len(c))
        if scale and (sd <= 0).any():
            raise ValueError("a constant feature can't be scaled")
        value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
        k = int(min(len(value), max(1, m.n - 1), ncomp or len(value)))
        value, vector = np.clip(value[::-1][:k], 0, None), vector[:, ::-1][:, :k]
        vector = vector * signs(vector)
        return cls(c, vector / sd[:, None], vector, np.sqrt(value))

    def share(self) -> np.ndarray:
        """Per cent of variance of each component (of all, when all are kept)."""
        return 100 * self.sdev**2 / max((self.sdev**2).sum(), 1e-300)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.loadings


@dataclass
class LDA:
    """Priors are class shares; the pooled within-class covariance has divisor n - g."""

    labels: list[str]
    prior: np.ndarray
    means: np.ndarray
    scaling: np.ndarray  # (p, r)
    svd: np.ndarray

    @classmethod
    def fit(cls, m: Moments) -> LDA:
        some = m.counts > 0
        if some.sum() < 2:
            raise ValueError("at least two classes are needed")
        labels, counts, means = [c for c, ok in zip(m.labels, some, strict=True) if ok], m.counts[some], m.means[some]
        g, n = len(labels), m.n
        prior = counts / n
        sd = np.sqrt(np.diag(m.pooled) / max(n - g, 1))
        if (sd < 1e-12).any():
            raise ValueError("a feature is constant within classes")
        scaled = m.pooled / max(n - g, 1) / np.outer(sd, sd)
        value, vector = np.linalg.eigh(scaled)
        keep = value > TOL * max(value.max(), 1.0)
        white = (vector[:, keep] / np.sqrt(value[keep])) / sd[:, None]
        xbar = prior @ means
        between = np.sqrt(n * prior / (g - 1))[:, None] * (means - xbar) @ white
        _, d, vt = np.linalg.svd(between, full_matrices=False)
        r = max(1, int((d > 1e-4 * max(d[0], 1e-300)).sum()))
        scaling = white @ vt[:r].T
        return cls(labels, prior, means, scaling * signs(scaling), d[:r])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.prior @ self.means) @ self.scaling

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z, c = self.scores(x), self.scores(self.means)
        return softmax(z @ c.T - 0.5 * (c**2).sum(axis=1) + np.log(self.prior))


@dataclass
class QDA:
    labels: list[str]
    prior: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray

    @classmethod
    def fit(cls, m: Moments) -> QDA:
        if m.within.ndim != 3:
            raise ValueError("moments by class are needed")
        some = np.flatnonzero(m.counts > 0)
        if (m.counts[some] <= m.means.shape[1]).any():
            raise ValueError("some class has fewer rows than features and one")
        cov = m.within[some] / (m.counts[some] - 1)[:, None, None]
        return cls([m.labels[i] for i in some], m.counts[some] / m.n, m.means[some], np.linalg.inv(cov), np.linalg.slogdet(cov)[1])

    def posterior(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means
        return softmax(np.log(self.prior) - 0.5 * self.logdet - 0.5 * np.einsum("ngp,gpq,ngq->ng", d, self.inverse, d))


@dataclass
class PLS:
    """Of the 0/1 class indicators on centred features; ``algorithm``: simpls, kernelpls or oscorespls."""

    xmean: np.ndarray
    ymean: np.ndarray
    weights: np.ndarray  # (p, k)
    loadings: np.ndarray
    yloadings: np.ndarray  # (g, k)
    projection: np.ndarray
    score_ss: np.ndarray
    xvar: np.ndarray
    xtotvar: float

    @classmethod
    def fit(cls, cross: np.ndarray, xy: np.ndarray, xmean: np.ndarray, ymean: np.ndarray, ncomp: int, algorithm: str = "simpls") -> PLS:
        if algorithm not in ("simpls", "kernelpls", "oscorespls"):
            raise ValueError(f"unknown algorithm: {algorithm}")
        p = len(xmean)
        w_, p_, q_, r_, ss = [], [], [], [], []
        start, left = xy, xy.copy()
        basis = np.zeros((p, 0))
        for _ in range(ncomp):
            u, d, _ = np.linalg.svd(left, full_matrices=False)
            if d[0] <= TOL * max(np.linalg.norm(start), 1e-300):
                break
            w = u[:, 0] * signs(u[:, :1])[0]
            r = w.copy()
            if algorithm != "simpls":
                for pj, rj in zip(p_, r_, strict=True):
                    r -= (pj @ w) * rj
            tt = r @ cross @ r
            if tt <= TOL * max(np.trace(cross), 1e-300):
                break
            if algorithm == "simpls":  # scores of unit length
                r, tt = r / np.sqrt(tt), 1.0
            load, q = cross @ r / tt, start.T @ r / tt
            if algorithm == "simpls":
                v = load - basis @ (basis.T @ load)
                v /= max(np.linalg.norm(v), 1e-300)
                basis = np.column_stack([basis, v])
                left = left - np.outer(v, v @ left)
                left = left - basis @ (basis.T @ left)
            else:
                left = left - np.outer(load, q) * tt
            for held, item in ((w_, w), (p_, load), (q_, q), (r_, r), (ss, tt)):
                held.append(item)
        stack = lambda v, rows: np.column_stack(v) if v else np.zeros((rows, 0))
        loads = stack(p_, p)
        return cls(xmean, ymean, stack(w_, p), loads, stack(q_, xy.shape[1]), stack(r_, p), np.array(ss), (loads**2).sum(axis=0) * np.array(ss), float(np.trace(cross)))

    @classmethod
    def of_classes(cls, m: Moments, ncomp: int, algorithm: str = "simpls") -> PLS:
        xy = (m.means - m.mean).T * m.counts
        return cls.fit(m.total(), xy, m.mean, m.counts / m.n, cap_components(m, ncomp), algorithm)

    @property
    def k(self) -> int:
        return self.weights.shape[1]

    def coefficients(self, k: int | None = None) -> np.ndarray:
        k = self.k if k is None else min(k, self.k)
        return self.projection[:, :k] @ self.yloadings[:, :k].T

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.xmean) @ self.projection

    def vip(self) -> np.ndarray:
        """(p, g): importance of each feature for each response over all components."""
        ss = self.yloadings**2 * self.score_ss  # (g, k)
        w = self.weights**2 / np.maximum((self.weights**2).sum(axis=0), 1e-300)
        return np.sqrt(len(self.xmean) * (w @ ss.T) / np.maximum(ss.sum(axis=1), 1e-300))


def cap_components(m: Moments, ncomp: int) -> int:
    most = int(min(m.n - 1, m.means.shape[1]))
    return ncomp if 1 <= ncomp <= most else most


@dataclass
class PCALDA:
    pca: PCA
    keep: np.ndarray
    lda: LDA

    @classmethod
    def fit(cls, m: Moments, ncomp: int | None = None, center: bool = True, scale: bool = False) -> PCALDA:
        """ncomp: max(g, round(n / 2)) unless given; out of range it is max(g, n - g), at most the number of features.
        Components that are constant within classes are dropped."""
        g, n, p = int((m.counts > 0).sum()), int(m.n), m.means.shape[1]
        k = max(g, round(n / 2)) if ncomp is None else ncomp
        if k < 1 or k > max(g, n - g):
            k = max(g, n - g)
        pca = PCA.fit(m, scale, min(k, p), center)
        z = m.project(pca.center, pca.loadings)
        keep = np.flatnonzero(np.sqrt(np.diag(z.pooled) / max(n - 1, 1)) >= 1e-4)
        if not len(keep):
            raise ValueError("every component is constant within classes")
        return cls(pca, keep, LDA.fit(z.select(keep)))

    labels = property(lambda self: self.lda.labels)

    def inner(self, x: np.ndarray) -> np.ndarray:
        return self.pca.scores(x)[:, self.keep]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Centred on the unweighted mean of the class means."""
        c = self.lda.means.mean(axis=0)
        return (self.inner(x) - c) @ self.lda.scaling

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self.lda.posterior(self.inner(x))


@dataclass
class PLSC:
    labels: list[str]
    pls: PLS

    @classmethod
    def fit(cls, m: Moments, ncomp: int = 10, pls: str = "simpls") -> PLSC:
        return cls(m.labels, PLS.of_classes(m, ncomp, pls))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.pls.scores(x)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Softmax of the fitted indicators; the first of tied classes wins."""
        return softmax(self.pls.ymean + (x - self.pls.xmean) @ self.pls.coefficients())


@dataclass
class PLSLDA:
    pls: PLS
    lda: LDA

    @classmethod
    def fit(cls, m: Moments, ncomp: int = 10, pls: str = "simpls") -> PLSLDA:
        model = PLS.of_classes(m, ncomp, pls)
        return cls(model, LDA.fit(m.project(model.xmean, model.projection)))

    labels = property(lambda self: self.lda.labels)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.pls.scores(x)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self.lda.posterior(self.pls.scores(x))


LINEAR: dict[str, Callable] = {"lda": LDA.fit, "qda": QDA.fit, "pcalda": PCALDA.fit, "plsc": PLSC.fit, "plslda": PLSLDA.fit}


def fit(vectors: DataFrame, method: str, labels: list[str] | None = None, **options):
    """The model of all rows: one pass for the moments, then algebra on the driver."""
    labels = levels(vectors) if labels is None else labels
    return LINEAR[method](gather(vectors, labels, by_class=method == "qda")[0], **options)


def map_rows(vectors: DataFrame, function: Callable[[np.ndarray], list[np.ndarray]], p: int, names: list[str]) -> DataFrame:
    """``sample_id, cls`` and array<double> columns ``names``, from blocks of rows; no shuffle."""
    kind = dict(vectors.dtypes)["sample_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = function(matrix_of(batch, "features", p)) if batch.num_rows else [np.zeros((0, 1))] * len(names)
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v, dtype=np.float64).ravel())) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["sample_id", "cls", *names])

    return vectors.select("sample_id", "cls", "features").mapInArrow(run, f"sample_id {kind}, cls string, " + ", ".join(f"{n} array<double>" for n in names))


def predict(vectors: DataFrame, model) -> DataFrame:
    """``sample_id, obs, pred, posterior`` (in the order of ``model.labels``) of new rows by a fitted model."""
    from pyspark.sql import functions as F

    p = len(model.means[0]) if hasattr(model, "means") else len((model.pls.xmean if hasattr(model, "pls") else model.pca.center))
    out = map_rows(vectors, lambda x: [model.posterior(x)], p, ["posterior"])
    names = F.array(*[F.lit(c) for c in model.labels])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return out.select("sample_id", F.col("cls").alias("obs"), F.element_at(names, best).alias("pred"), "posterior")


def scores(vectors: DataFrame, model) -> DataFrame:
    """``sample_id, cls, scores`` on the model's axes."""
    p = len(model.center) if hasattr(model, "center") else len(model.means[0]) if hasattr(model, "means") else len(model.pls.xmean if hasattr(model, "pls") else model.pca.center)
    return map_rows(vectors, lambda x: [model.scores(x)], p, ["scores"])


@dataclass
class OSC:
    """Orthogonal signal correction: x - (x - center) W P' has lost ``ncomp`` score directions orthogonal to the classes."""

    method: str
    center: np.ndarray
    w: np.ndarray
    p: np.ndarray
    r2: float
    angle: float
    angles: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, m: Moments, method: str = "wold", center: bool = True, osc_ncomp: int = 4, pls_ncomp: int = 10, tol: float = 1e-3, iters: int = 20) -> OSC:
        """wold: PLS inside the loop; sjoblom: PLS after it, its weights not normalised; wise: loadings inside the loop
        with a tolerance of 1e-5.  Every vector of samples is kept as X a + Y b, so only cross-products are used."""
        if method not in ("wold", "sjoblom", "wise"):
            raise ValueError(f"unknown method: {method}")
        c = m.mean if center else np.zeros(m.means.shape[1])
        some = m.counts > 0
        counts = m.counts[some]
        first = m.total() + m.n * np.outer(m.mean - c, m.mean - c)
        xy = (m.means[some] - c).T * counts
        pls_ncomp = cap_components(m, pls_ncomp)
        limit = 1e-5 if method == "wise" else tol
        deflate = np.eye(len(c))  # X now = X0 @ deflate
        ws, ps, directions = [], [], []
        for _ in range(osc_ncomp):
            xx, s = deflate.T @ first @ deflate, deflate.T @ xy
            value, vector = np.linalg.eigh(xx)
            if value[-1] <= TOL * max(np.trace(first), 1e-300):
                break
            a, b = vector[:, -1] * signs(vector[:, -1:])[0], np.zeros(len(counts))

            def inner(a1, b1, a2, b2, xx=xx, s=s):
                return a1 @ xx @ a2 + a1 @ s @ b2 + b1 @ (s.T @ a2) + b1 @ (counts * b2)

            def free(a1, b1, s=s):  # less its projection on the classes: Y'Y is diagonal
                return a1, b1 - (s.T @ a1 + counts * b1) / counts

            def weights(a1, b1, xx=xx, s=s):  # PLS of the scores on X
                sxy = (xx @ a1 + s @ b1)[:, None]
                model = PLS.fit(xx, sxy, np.zeros(len(a1)), np.zeros(1), min(pls_ncomp, np.linalg.matrix_rank(xx, tol=TOL * max(np.trace(xx), 1e-300)) if method == "wise" else pls_ncomp))
                return model.coefficients()[:, 0]

            w = a
            for _ in range(iters):
                a1, b1 = free(a, b)
                if method == "wold":
                    w = weights(a1, b1)
                    w = w / max(np.linalg.norm(w), 1e-300)
                else:
                    w = (xx @ a1 + s @ b1) / max(inner(a1, b1, a1, b1), 1e-300)
                    w = w / max(np.linalg.norm(w), 1e-300)
                zero = np.zeros_like(b)
                gap = inner(w - a, zero - b, w - a, zero - b) / max(inner(w, zero, w, zero), 1e-300)
                a, b = w, zero
                if np.sqrt(max(gap, 0)) <= limit:
                    break
            if method != "wold":
                w = weights(*free(a, b))
                if method == "wise":
                    w = w / max(np.linalg.norm(w), 1e-300)
            a, b = w, np.zeros_like(b)
            if method != "wold":
                a, b = free(a, b)
            tt = max(inner(a, b, a, b), 1e-300)
            load = (xx @ a + s @ b) / tt
            ws.append(deflate @ w)
            ps.append(load)
            directions.append((deflate @ a, b, tt))
            deflate = deflate - np.outer(deflate @ w, load)
        W = np.column_stack(ws) if ws else np.zeros((len(c), 0))
        P = np.column_stack(ps) if ps else np.zeros((len(c), 0))
        keep = np.eye(len(c)) - W @ P.T
        r2 = 100 * np.trace(keep.T @ first @ keep) / max(np.trace(first), 1e-300)
        ty = np.array([xy.T @ a + counts * b for a, b, _ in directions]).reshape(-1, len(counts))
        v = np.sqrt(np.array([tt for *_, tt in directions]) * counts.sum())
        cos = np.clip((ty * v[:, None]).sum(axis=0) / max((v**2).sum(), 1e-300), -1, 1)
        each = [float(np.degrees(np.arccos(np.clip(ty[i] / np.sqrt(directions[i][2] * counts), -1, 1))).mean()) for i in range(len(directions))]
        return cls(method, c, W, P, float(r2), float(np.degrees(np.arccos(cos)).mean()), each)

    def correct(self, x: np.ndarray, center: np.ndarray | None = None) -> np.ndarray:
        z = x - (self.center if center is None else center)
        return z - z @ self.w @ self.p.T


def osc_predict(vectors: DataFrame, model: OSC, own_means: bool = True) -> tuple[DataFrame, float]:
    """Corrected new rows and Q2, the per cent of their variance that is kept.  Rows are centred by their own means, or
    by the training means with ``own_means=False``."""
    m = gather(vectors.na.fill("", ["cls"]), levels(vectors.na.fill("", ["cls"])))[0]
    c = m.mean if own_means else model.center
    cross = m.total() + m.n * np.outer(m.mean - c, m.mean - c)
    keep = np.eye(len(c)) - model.w @ model.p.T
    q2 = 100 * np.trace(keep.T @ cross @ keep) / max(np.trace(cross), 1e-300)
    return map_rows(vectors, lambda x: [model.correct(x, c)], len(c), ["features"]), float(q2)
