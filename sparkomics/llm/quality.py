"""Quality rules: gradient-boosted trees over document statistics, held as flat numpy node arrays.

One pass computes the statistics of every whole text; they are written once.  The trees are fitted on the statistics
of at most ``MOST_LABELLED`` labelled rows (least hash of the id) with logistic loss on 64 quantile bins, and score the
rest vectorised: each level is one gather over all rows.  Monotone features: a rise in ``MONOTONE[name] = -1`` never
raises a score (splits against the sign are refused and child bounds meet at the mid value).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, distinct, id_text, map_batches, materialise, shingles, utf8

MOST_LABELLED = 20_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct", "n_text_chars"]
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "digit_share", "mark_rate", "distinct_share", "lower_share"]
MONOTONE = {"symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1}
WINDOW = 8

_words = WordHashes()
_kind = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!\"'()+,-./:;=?@[\\]^_`{}~", bytes(range(0x80, 0xC0))), 1):
    _kind[list(_chars)] = _k


def statistics(text: bytes) -> list[int]:
    """Of one whole text, in the order of ``STATS``."""
    kinds = np.bincount(_kind[np.frombuffer(text, dtype=np.uint8)], minlength=8)
    words = text.split()
    n = len(words)
    points = len(text) - int(kinds[7])
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    h = _words.of(words)
    repeated = 0
    if n > WINDOW:
        grams = shingles(h, WINDOW)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            twice = np.zeros(len(grams), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            edge[at + WINDOW] -= 1
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return [n, points - int(kinds[1]), int(kinds[2]), dup, repeated, lines, int(kinds[3]), int(kinds[4]), int(kinds[5]), int(kinds[6]), len(distinct(h)), points]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` (long) per row.  Null text: all 0."""

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([statistics(t) for t in utf8(batch.column(1))], dtype=np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])

    return map_batches(id_text(docs, id_col, text_col), measure, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(v, dtype=np.float64) for k, v in stats.items()}
    over = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(s["n_words"]), over(s["word_chars"], s["n_words"]), over(s["n_symbols"], s["n_words"]), over(s["n_dup_lines"], s["n_lines"]),
        over(s["n_repeat_words"], s["n_words"]), over(s["n_words"], s["n_lines"]), over(s["n_upper"], s["word_chars"]), over(s["n_digits"], s["word_chars"]),
        over(s["n_marks"], s["n_words"]), over(s["n_distinct"], s["n_words"]), over(s["n_lower"], s["word_chars"]),
    ])


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf points to itself.  ``roots`` has the first node of each tree."""

    base: float = 0.0
    depth: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """``signs``: -1, 0 or 1 for each feature.  Without rows, or with one class alone, every score is that class's prior."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior))) if len(y) else 5.0
    if not len(y) or y.min() == y.max():
        return Trees(base=base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # code <= k: x <= cuts[k]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        k, g, h = node(), grad[rows], hess[rows]
        G, H = g.sum(), h.sum()
        value[k] = rate * float(np.clip(-G / (H + l2), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                sums = [np.cumsum(np.bincount(codes[j][rows], weights=v, minlength=size))[:-1] for v in (g, h, None)]
                gl, hl, nl = sums
                a, b = np.clip(-gl / (hl + l2), low, high), np.clip(-(G - gl) / (H - hl + l2), low, high)
                gain = -(gl * a + 0.5 * (hl + l2) * a * a) - ((G - gl) * b + 0.5 * (H - hl + l2) * b * b)
                bad = (nl < least) | (len(rows) - nl < least) | ((b - a) * signs[j] < 0)
                gain = np.where(bad, -np.inf, gain)
                c = int(np.argmax(gain))
                whole = np.clip(-G / (H + l2), low, high)
                better = gain[c] + (G * whole + 0.5 * (H + l2) * whole * whole)
                if better > best[0]:
                    best = (better, j, c, a[c], b[c])
        if best[1] >= 0:
            _, j, c, a, b = best
            goes = codes[j][rows] <= c
            mid = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[j])]
            feature[k], threshold[k] = j, cuts[j][c]
            left[k] = grow(rows[goes], level + 1, *bounds[0])
            right[k] = grow(rows[~goes], level + 1, *bounds[1])
        return k

    model = Trees(base=base)
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        first = len(feature)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        one = Trees(0.0, depth, np.array(feature, dtype=np.int32), np.array(threshold), np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), np.array(value), np.array([first], dtype=np.int32))
        raw = raw + one.raw(x)
    return Trees(base, depth, one.feature, one.threshold, one.left, one.right, one.value, np.array(roots, dtype=np.int32))


def fit_statistics(stats: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> Trees:
    """From the statistics of at most ``most`` labelled ids.  Ids whose crc32 mod 5 is 0 are left out, to measure on."""
    from .toxicity import held_out

    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = stats.join(F.broadcast(chosen), "doc_id").toPandas().drop_duplicates("doc_id").sort_values("doc_id")  # at most `most` rows of 13 numbers
    signs = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit(feature_matrix({s: found[s].to_numpy() for s in STATS}), found["label"].to_numpy().astype(np.float64), signs)


def judge(stats: DataFrame, model: Trees) -> DataFrame:
    """Adds ``score`` (double) to a table of statistics."""
    names = stats.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix({s: batch.column(names.index(s)).to_numpy() for s in STATS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*names, "score"])

    return stats.mapInArrow(score, ", ".join(f"`{n}` long" for n in names) + ", score double")


def quality_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``score``, ``base_failed`` and ``kept`` for every row.

    Fewer than 20 words, or more than 30 % of the words in repeated 8-word windows, fail outright (so null and empty
    texts do); the others are kept at a score of 0.5 or more.  Null ids and repeated rows are judged each; without
    labels the trees keep all; an empty table gives no row.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judge(stats, fit_statistics(stats, labels)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
