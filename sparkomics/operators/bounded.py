"""Support vector machines and random forests, in numpy.

Forests and the linear machines of recursive elimination see all rows.  The classifier ``svm`` is fitted on at most
``MOST_SVM`` rows, those with the least hash of their id, and predicts every row; it is the only sampling.
Numbers agree with other implementations statistically, not digit by digit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SVM = 4_000
TREES = 500
#: Of the rows that a user's own classifier or ranker gets in one task: what its memory allows for, not a share of the rows.
MOST_OWN = 5_000_000


def sample(vectors: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` rows, in the order of ids' hashes."""
    return vectors.orderBy(F.xxhash64("sample_id"), "sample_id").limit(most).toPandas()


def smo(kernel: np.ndarray, y: np.ndarray, cost: float = 1.0, tol: float = 1e-3, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Dual weights and offset of a two-class machine (y: +-1), by sequential minimal optimisation with second-order
    choice of the working pair (Fan, Chen & Lin 2005)."""
    n = len(y)
    a, grad, diag = np.zeros(n), -np.ones(n), np.diag(kernel)
    up, low = y > 0, y < 0
    for _ in range(most):
        score = -y * grad
        i = int(np.where(up, score, -np.inf).argmax())
        top = score[i]
        gap = top - np.where(low, score, np.inf)
        if gap.max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * kernel[i], 1e-12)
        j = int(np.where(low & (gap > 0), -(gap**2) / curve, np.inf).argmin())
        step = gap[j] / curve[j]
        room_i = cost - a[i] if y[i] > 0 else a[i]
        room_j = a[j] if y[j] > 0 else cost - a[j]
        step = min(step, room_i, room_j)
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += y * step * (kernel[i] - kernel[j])
        for t in (i, j):
            up[t] = a[t] < cost - 1e-12 if y[t] > 0 else a[t] > 1e-12
            low[t] = a[t] > 1e-12 if y[t] > 0 else a[t] < cost - 1e-12
    free = (a > 1e-9) & (a < cost - 1e-9)
    score = -y * grad
    offset = score[free].mean() if free.any() else (np.where(up, score, -np.inf).max() + np.where(low, score, np.inf).min()) / 2
    return a, float(offset)


def linear_weights(z: np.ndarray, y: np.ndarray, most: np.ndarray, tol: float = 1e-9, steps: int = 200) -> np.ndarray:
    """Primal weights of the two-class linear machine (y: +-1) whose dual weights lie between 0 and ``most`` (the cost, times
    how often a row counts), on all rows: primal-dual interior points (Mehrotra 1992; Gertz & Griffin 2010).

    A step costs rows times features squared and holds a few vectors of the rows, so it grows with the rows, not their square.
    """
    n, p = z.shape
    x = np.empty((n, p + 1))
    np.multiply(z, y[:, None], out=x[:, :p])
    x[:, p] = y
    w, ridge = np.zeros(p + 1), np.append(np.ones(p), 0.0)  # the last is the offset, which is free
    a = most / 2  # dual weights; r: what is left of their bound
    r, slack, over = a.copy(), np.full(n, 0.5), np.full(n, 1.5)
    scaled = np.empty_like(x)
    far = lambda v, d: float(np.min(-v[d < 0] / d[d < 0], initial=1e300))
    for _ in range(steps):
        margin = x @ w - 1 + over - slack
        dual = ridge * w - x.T @ a
        gap = float(a @ slack + r @ over)
        size = 1 + 0.5 * float(w[:p] @ w[:p]) + float(most @ over)
        if gap <= tol * size and np.abs(margin).max() <= 1e-7 and np.abs(dual).max() <= 1e-7 * (1 + np.abs(w).max()):
            break
        d = 1 / (over / r + slack / a)
        np.multiply(x, d[:, None], out=scaled)
        left = scaled.T @ x
        left[np.arange(p), np.arange(p)] += 1
        left[p, p] += 1e-14 * left[p, p] + 1e-300

        def move(c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, ...]:
            q = c1 / a - c2 / r - margin
            dw = np.linalg.solve(left, x.T @ (q * d) - dual)
            da = (q - x @ dw) * d
            return dw, da, (c1 - slack * da) / a, (c2 + over * da) / r

        c1, c2, mu = -a * slack, -r * over, gap / (2 * n)
        dw, da, ds, do = move(c1, c2)
        step = min(1.0, far(a, da), far(r, -da), far(slack, ds), far(over, do))
        after = float((a + step * da) @ (slack + step * ds) + (r - step * da) @ (over + step * do)) / (2 * n)
        goal = mu * (after / mu) ** 3
        dw, da, ds, do = move(c1 + goal - da * ds, c2 + goal + da * do)
        step = min(1.0, 0.995 * min(far(a, da), far(r, -da), far(slack, ds), far(over, do)))
        w += step * dw
        a += step * da
        r -= step * da
        slack += step * ds
        over += step * do
    return w[:p]


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid 1 / (1 + exp(a f + b)) by Newton steps with back-tracking (Lin, Lin & Weng 2007)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((neg + 1) / (pos + 1)))
    loss = lambda a, b: float(np.logaddexp(0, a * f + b).sum() - ((1 - t) * (a * f + b)).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(a * f + b, -500, 500)))
        d1, d2 = t - p, p * (1 - p)
        g = np.array([(f * d1).sum(), d1.sum()])
        if np.abs(g).max() < 1e-5:
            break
        h = np.array([[(f * f * d2).sum() + 1e-12, (f * d2).sum()], [(f * d2).sum(), d2.sum() + 1e-12]])
        move, size, now = -np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-10 and loss(a + size * move[0], b + size * move[1]) >= now + 1e-4 * size * (g @ move):
            size /= 2
        a, b = a + size * move[0], b + size * move[1]
    return a, b


def couple(r: np.ndarray) -> np.ndarray:
    """Class shares from pairwise ones r (n, g, g): the second method of Wu, Lin & Weng 2004, as one linear system a row."""
    n, g, _ = r.shape
    q = -np.einsum("nij->nij", r.transpose(0, 2, 1) * r)
    for i in range(g):
        q[:, i, i] = (np.delete(r[:, :, i], i, axis=1) ** 2).sum(axis=1)
    big = np.zeros((n, g + 1, g + 1))
    big[:, :g, :g], big[:, :g, g], big[:, g, :g] = q + 1e-10 * np.eye(g), 1, 1
    side = np.zeros((n, g + 1, 1))
    side[:, g] = 1
    p = np.clip(np.linalg.solve(big, side)[:, :g, 0], 1e-12, None)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class SVM:
    """C-SVC on scaled features, one machine for each pair of classes, radial (gamma 1 / p) or linear kernel."""

    labels: list[str]
    center: np.ndarray
    spread: np.ndarray
    gamma: float
    support: np.ndarray
    machines: list[tuple[int, int, np.ndarray, np.ndarray, float, float, float]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, kernel: str = "radial", cost: float = 1.0, gamma: float | None = None) -> SVM:
        labels = sorted(set(y))
        if len(labels) < 2:
            raise ValueError("at least two classes are needed")
        center, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
        spread = np.where(spread > 0, spread, 1.0)
        z = (x - center) / spread
        model = cls(list(labels), center, spread, 0.0 if kernel == "linear" else gamma or 1 / x.shape[1], z, [])
        full = model.kernel(z)
        used: set[int] = set()
        for i, a in enumerate(labels):
            for j in range(i + 1, len(labels)):
                rows = np.flatnonzero((y == a) | (y == labels[j]))
                sign = np.where(y[rows] == a, 1.0, -1.0)
                weight, offset = smo(full[np.ix_(rows, rows)], sign, cost)
                at = np.flatnonzero(weight > 1e-12)
                f = full[np.ix_(rows, rows[at])] @ (weight * sign)[at] + offset
                model.machines.append((i, j, rows[at], (weight * sign)[at], offset, *_folded(full, rows, sign, cost, f)))
                used.update(rows[at].tolist())
        kept = np.array(sorted(used), dtype=int)
        new = {int(r): k for k, r in enumerate(kept)}
        model.machines = [(i, j, np.array([new[int(r)] for r in rows], dtype=int), w, *rest) for i, j, rows, w, *rest in model.machines]
        model.support = z[kept]
        return model

    def kernel(self, z: np.ndarray) -> np.ndarray:
        dot = z @ self.support.T
        if not self.gamma:
            return dot
        return np.exp(-self.gamma * np.maximum((z**2).sum(axis=1)[:, None] + (self.support**2).sum(axis=1) - 2 * dot, 0))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        k, g = self.kernel((x - self.center) / self.spread), len(self.labels)
        r = np.full((len(x), g, g), 0.5)
        for i, j, rows, w, offset, a, b in self.machines:
            p = np.clip(1 / (1 + np.exp(np.clip(a * (k[:, rows] @ w + offset) + b, -500, 500))), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
        return r[:, 0, [1]].repeat(2, axis=1) * [1, -1] + [0, 1] if g == 2 else couple(r)

    def weights(self) -> np.ndarray:
        """Summed absolute primal weights of the linear kernel, on scaled features."""
        return sum(np.abs(w @ self.support[rows]) for _, _, rows, w, *_ in self.machines)


def _folded(full: np.ndarray, rows: np.ndarray, sign: np.ndarray, cost: float, f: np.ndarray) -> tuple[float, float]:
    """Sigmoid on decision values of three held-out folds, or on the fitted ones where a class is too small for that."""
    if min((sign > 0).sum(), (sign < 0).sum()) < 6:
        return platt(f, sign)
    held, fold = np.empty(len(rows)), np.empty(len(rows), dtype=int)
    for s in (1, -1):
        at = np.flatnonzero(sign == s)
        fold[at] = np.arange(len(at)) % 3
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        weight, offset = smo(full[np.ix_(rows[train], rows[train])], sign[train], cost)
        held[test] = full[np.ix_(rows[test], rows[train])] @ (weight * sign[train]) + offset
    return platt(held, sign)


@dataclass
class Tree:
    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.descend(x.T, np.arange(len(x)))

    def descend(self, columns: np.ndarray, rows: np.ndarray, moved: int = -1, of: np.ndarray | None = None, used: np.ndarray | None = None) -> np.ndarray:
        """Labels of some rows; feature ``moved`` is that of the rows ``of``.  ``used`` gets the features that each row meets."""
        at = np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            f = self.feature[node]
            if used is not None:
                used[f, live] = True
            value = columns[f, rows[live] if of is None else np.where(f == moved, of[live], rows[live])]
            at[live] = np.where(value <= self.cut[node], self.left[node], self.right[node])
            live = live[self.feature[at[live]] >= 0]
        return self.label[at]


EYE = np.eye(64)


def _cuts(v: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``v`` (features, rows): the gain of its best cut, the cut, and whether anything varies."""
    order, m, at = v.argsort(axis=1, kind="stable"), v.shape[1], np.arange(len(v))
    v, own = v[at[:, None], order], y[order]
    k = np.arange(1.0, m)
    if m <= 256:
        left = EYE[own, : len(counts)].cumsum(axis=1)[:, :-1] if len(counts) <= len(EYE) else np.cumsum(own[:, :, None] == np.arange(len(counts)), axis=1)[:, :-1].astype(float)
        l2 = np.einsum("kmg,kmg->km", left, left)
        r2 = l2 + ((counts**2).sum() - 2.0 * (left @ counts))
    else:  # squares of the counts grow by 2 L + 1 where a class has come L times before
        l2, r2 = np.empty((len(v), m - 1), dtype=np.int64), np.empty((len(v), m - 1), dtype=np.int64)
        firsts = np.cumsum(counts) - counts
        for f in at:
            by = np.argsort(own[f], kind="stable")
            before = np.empty(m, dtype=np.int64)
            before[by] = np.arange(m) - np.repeat(firsts, counts)
            l2[f] = np.cumsum(2 * before[:-1] + 1)
            r2[f] = (counts**2).sum() + np.cumsum(1 - 2 * (counts[own[f, :-1]] - before[:-1]))
    gain = l2 / k + r2 / (m - k)
    gain[v[:, 1:] == v[:, :-1]] = -np.inf
    i = gain.argmax(axis=1)
    return gain[at, i], (v[at, i].astype(float) + v[at, i + 1]) / 2, v[:, 0] != v[:, -1]  # exact whole numbers up to the division


def grow(columns: np.ndarray, y: np.ndarray, g: int, rng: np.random.Generator, mtry: int, bag: np.ndarray) -> Tree:
    """An unpruned classification tree by Gini on ``mtry`` random features a node.  ``columns`` has the features as rows;
    the tree sees the samples in ``bag``, which aren't copied."""
    nodes: list[list] = []
    todo = [(bag, -1, False)]
    y = y.astype(np.uint8 if g <= 256 else np.uint16)
    while todo:
        rows, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = me
        counts = np.bincount(y[rows], minlength=g)
        nodes.append([-1, 0.0, -1, -1, int(counts.argmax())])
        if counts.max() == len(rows):
            continue
        best = (-np.inf, -1, 0.0)
        tried = 0
        own, some = y[rows], rng.permutation(len(columns))
        while tried < mtry and len(some):
            now, some = some[: mtry - tried], some[mtry - tried :]
            for part in [now] if len(rows) <= 4096 else now[:, None]:  # features of large nodes one by one
                for f, gain, cut, varies in zip(part.tolist(), *_cuts(columns[part[:, None], rows], own, counts), strict=True):
                    if varies:
                        tried += 1
                        if gain > best[0]:
                            best = (gain, f, float(cut))
        if best[1] < 0:
            continue
        nodes[me][0], nodes[me][1] = best[1], best[2]
        go = columns[best[1], rows] <= np.float64(best[2])
        todo += [(rows[~go], me, True), (rows[go], me, False)]
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


@dataclass
class Forest:
    labels: list[str]
    trees: list[Tree]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.labels)))
        for t in self.trees:
            votes[np.arange(len(x)), t.predict(x)] += 1
        return votes / len(self.trees)


def columns_of(x: np.ndarray) -> np.ndarray:
    """The features as rows, in half the bytes where no value changes by that."""
    small = x.T.astype(np.float32, order="C")
    return small if all(np.array_equal(a, b) for a, b in zip(small, x.T, strict=True)) else np.ascontiguousarray(x.T)


def tree(columns: np.ndarray, y: np.ndarray, g: int, seed: int, t: int) -> tuple[Tree, np.ndarray, np.random.Generator]:
    """Tree ``t`` of a forest on a bootstrap of the rows, the rows that it hasn't seen, and its generator."""
    rng = np.random.default_rng([seed, t])
    bag = rng.integers(0, len(y), len(y))
    found = grow(columns, y, g, rng, max(1, int(np.sqrt(len(columns)))), bag)
    return found, np.setdiff1d(np.arange(len(y)), bag), rng


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 1) -> Forest:
    labels = sorted(set(y))
    code, columns = np.searchsorted(labels, y), columns_of(x)
    return Forest(list(labels), [tree(columns, code, len(labels), seed, t)[0] for t in range(trees)])


def falls(columns: np.ndarray, code: np.ndarray, g: int, seed: int, t: int) -> np.ndarray:
    """Fall in the accuracy of tree ``t`` on its out-of-bag rows under permutation of each feature."""
    grown, out, rng = tree(columns, code, g, seed, t)
    fall = np.zeros(len(columns))
    if len(out):
        used = np.zeros((len(columns), len(out)), dtype=bool)  # by the way of each row down the tree
        right = grown.descend(columns, out, used=used) == code[out]
        for f in set(grown.feature[grown.feature >= 0].tolist()):
            moved, at = out[rng.permutation(len(out))], np.flatnonzero(used[f])
            changed = grown.descend(columns, out[at], f, moved[at]) == code[out[at]]
            fall[f] = right.mean() - (right.sum() + (changed.sum() - right[at].sum())) / len(out)
    return fall


def over_error(mean: np.ndarray, spread: np.ndarray, trees: int) -> np.ndarray:
    error = spread / np.sqrt(trees)
    return np.divide(mean, error, out=np.zeros(len(mean)), where=error > 0)


BOUNDED: dict[str, tuple[int, Callable]] = {"svm": (MOST_SVM, SVM.fit)}
