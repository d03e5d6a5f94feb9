"""Masked pseudo-likelihood: a bidirectional window network predicts every token of a text from both sides.

Tokens are words without case.  Words that occur often enough have ids of their own: the threshold is ``LEAST`` or the
root of the corpus's tokens over ``SPREAD``, so the vocabulary grows with the corpus (it has ``NAMED`` words at least).  All
others have the id of their last byte; given that byte, the rest of the word is predicted backward, byte by byte to its
beginning, from the two bytes after it, by the corpus's counts over these words.  So every word, seen or not, has a
probability of its own, and those of all words sum to 1.  The network sums an embedding table for each of the four places
around a token (two left, two right; nothing beyond a text's ends), applies tanh, and predicts the token in two steps,
its block of ids and its place in the block; both softmaxes are exact, so the log-probabilities are normalised.

1. Words are counted over all texts (partial counts per task, then a shuffle); the bytes of unnamed words are counted from
those counts.  2. Every task trains the network from one start (small random embeddings, biases from the counts) on all
tokens of the texts it reads, by Adagrad; the tasks' weights, weighted by their tokens, are averaged in a tree of fan-in
``FAN_IN`` piece by piece, one round.  3. A second pass scores every text: the sum over its tokens of the conditional
log-probability.  Nothing is sampled.  The network has about 80 weights for each id, which is what tasks send and receive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_batches, materialise, runs, utf8

NAMED, ENDS, INNER = 1024, 256, 64
SIZE = NAMED + ENDS
LEAST, SPREAD = 64, 2
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 8192
FAN_IN = 64
PIECE = 1 << 15
MOST_COUNTED, MOST_COUNTED_BYTES = 300_000, 32 << 20
#: Rows of the table of byte counts: pairs of bytes by hash.  A byte that never followed a pair counts as EPSILON.
CONTEXTS, EPSILON = 1 << 12, 0.1
EDGE = 10  # a line feed, which no word has, stands before and after each word
#: Words are bytes other than the six white-space ones; the word's beginning is one more thing to predict.
ALPHABET = 256 - 6 + 1


def inner_size(ids: int) -> int:
    """Ids in a block: at least half as many as there are blocks."""
    size = INNER
    while 2 * size * size < ids:
        size *= 2
    return size


def size_for(named: int) -> int:
    """All ids of a vocabulary of ``named`` words, in whole blocks; the last ``ENDS`` are those of unnamed words."""
    ids = max(NAMED, named) + ENDS
    inner = inner_size(ids)
    return -(-ids // inner) * inner


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words with an edge before and after each, and where the edges stand."""
    line = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", dtype=np.uint8).astype(np.int32)
    return line, np.flatnonzero(line == EDGE)


def backward(line: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``joined`` words: for each byte, its context (itself and what follows it), what stands before it, and where in these
    each word begins."""
    at = np.flatnonzero(line != EDGE)
    context = ((line[at] * 256 + line[at + 1]) * 40_503 >> 4) & (CONTEXTS - 1)
    return context, line[at - 1], edges[:-1] - np.arange(len(edges) - 1)


def byte_logs(counts: np.ndarray) -> np.ndarray:
    """(contexts, 256) log-probabilities; each row's over the bytes of words and the edge sum to 1."""
    return np.log((counts + EPSILON) / (counts.sum(axis=1, keepdims=True) + EPSILON * ALPHABET))


class Ids:
    """Ids of words, and the log-probabilities of unnamed ones given their ids if ``logs`` are given."""

    def __init__(self, named: list[bytes], logs: np.ndarray | None = None) -> None:
        self.named, self.logs = {w: i for i, w in enumerate(named)}, logs
        self.first = size_for(len(named)) - ENDS

    def both(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text's words, and the sum of its unnamed words' log-probabilities."""
        split = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = list(chain.from_iterable(split))
        ids = np.fromiter(map(self.named.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        sums, rest = np.zeros(len(texts)), np.flatnonzero(ids < 0)
        if len(rest):
            line, edges = joined(list(compress(flat, (ids < 0).tolist())))
            ids[rest] = self.first + line[edges[1:] - 1]
            if self.logs is not None:
                context, before, starts = backward(line, edges)
                words = np.add.reduceat(self.logs[context, before], starts, dtype=np.float64)
                sums += np.bincount(np.searchsorted(np.cumsum(sizes), rest, "right"), words, len(texts))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else [], sums

    def of(self, text: bytes) -> np.ndarray:
        return self.both([text])[0][0]


class Network:
    """``tables``: (4, ids + 1, WIDTH), the last row stays 0 for places beyond the ends; blocks and inner places with biases."""

    def __init__(self, tables: np.ndarray, outer: np.ndarray, outer_bias: np.ndarray, inner: np.ndarray, inner_bias: np.ndarray) -> None:
        self.parts = [np.ascontiguousarray(p, dtype=np.float32) for p in (tables, outer, outer_bias, inner, inner_bias)]
        self.tables, self.outer, self.outer_bias, self.inner, self.inner_bias = self.parts
        self.size, self.blocks, self.places = self.tables.shape[1] - 1, *self.inner_bias.shape
        self.squares = [np.full(p.shape, 1e-6, dtype=np.float32) for p in self.parts]

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        size = len(counts)
        share = (counts + 0.5).reshape(-1, inner_size(size))
        blocks, places = share.shape
        tables = rng.normal(0, 0.1, (len(OFFSETS), size + 1, WIDTH))
        tables[:, size] = 0
        inner_bias = np.log(share / share.sum(axis=1, keepdims=True))
        return cls(tables, rng.normal(0, 0.1, (WIDTH, blocks)), np.log(share.sum(axis=1) / share.sum()), rng.normal(0, 0.1, (blocks, WIDTH, places)), inner_bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @classmethod
    def from_flat(cls, flat: np.ndarray, size: int = SIZE) -> Network:
        places = inner_size(size)
        blocks = size // places
        shapes = [(len(OFFSETS), size + 1, WIDTH), (WIDTH, blocks), (blocks,), (blocks, WIDTH, places), (blocks, places)]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*[p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes, strict=True)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        out = self.tables[0][around[0]]
        for k in range(1, len(OFFSETS)):
            out += self.tables[k][around[k]]
        return np.tanh(out, out=out)

    def run(self, tokens: np.ndarray, around: np.ndarray, learn: float = 0.0) -> np.ndarray:
        """Log-probability of each token; with ``learn`` also one Adagrad step on their mean."""
        n = len(tokens)
        block, place = tokens // self.places, tokens % self.places
        order = np.argsort(block.astype(np.uint16), kind="stable")
        block, place, around = block[order], place[order], around[:, order]
        h = self.hidden(around)
        rows, ones = np.arange(n), np.ones(max(n, self.blocks, self.places), dtype=np.float32)
        p = h @ self.outer + self.outer_bias
        p -= p.max(axis=1, keepdims=True)
        picked = p[rows, block]
        np.exp(p, out=p)
        total = p @ ones[: self.blocks, None]  # faster than a sum over short rows
        scores = picked - np.log(total[:, 0])
        ends = np.searchsorted(block, np.arange(self.blocks + 1))
        if learn:
            p /= total
            p[rows, block] -= 1
            p /= n
            back = p @ self.outer.T
            steps = [None, h.T @ p, ones[:n] @ p, np.zeros_like(self.inner), np.zeros_like(self.inner_bias)]
        for b in range(self.blocks):
            i, j = ends[b], ends[b + 1]
            if i == j:
                continue
            q = h[i:j] @ self.inner[b] + self.inner_bias[b]
            q -= q.max(axis=1, keepdims=True)
            at = rows[: j - i]
            picked = q[at, place[i:j]]
            np.exp(q, out=q)
            total = q @ ones[: self.places, None]
            scores[i:j] += picked - np.log(total[:, 0])
            if learn:
                q /= total
                q[at, place[i:j]] -= 1
                q /= n
                steps[3][b], steps[4][b] = h[i:j].T @ q, ones[: j - i] @ q
                back[i:j] += q @ self.inner[b].T
        if learn:
            back *= 1 - h * h
            narrow = np.uint16 if self.size < 1 << 16 else np.uint32
            for k in range(len(OFFSETS)):
                near = np.argsort(around[k].astype(narrow), kind="stable")
                ids = around[k][near]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                ids, grad = ids[first], np.add.reduceat(back[near], first, axis=0)
                grad, ids = grad[ids < self.size], ids[ids < self.size]
                self.squares[0][k][ids] += grad * grad
                self.tables[k][ids] -= learn * grad / np.sqrt(self.squares[0][k][ids])
            for part, square, grad in zip(self.parts[1:], self.squares[1:], steps[1:], strict=True):
                square += grad * grad
                part -= learn * grad / np.sqrt(square)
        out = np.empty(n, dtype=np.float64)
        out[order] = scores
        return out


def windows(texts: list[np.ndarray], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts and, for each offset, the ids around them."""
    reach = max(OFFSETS)
    gap = np.full(reach, size, dtype=np.int64)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * reach + reach, sizes)
    return line[at], np.stack([line[at + o] for o in OFFSETS])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word (binary), n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for text in utf8(batch.column(1)):
                found.update(text.lower().split())
                size += len(text)
                if len(found) > MOST_COUNTED or size > MOST_COUNTED_BYTES:
                    yield part(found)
                    found.clear()
                    size = 0
        yield part(found)

    def part(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.binary()), pa.array(list(found.values()), type=pa.int64())], names=["word", "n"])

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words with ids of their own, most frequent first (ties by their bytes); the counts of all ids; the counts of
    bytes in contexts, (contexts, 256), over the other words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    threshold = max(float(LEAST), total**0.5 / SPREAD)
    held = counts.where(F.col("n") >= threshold).collect()  # words that grow as the root of the tokens
    if len(held) < NAMED:
        held = counts.orderBy(F.desc("n"), "word").limit(NAMED).collect()
    held = sorted(((r.n, bytes(r.word)) for r in held), key=lambda x: (-x[0], x[1]))
    named = [w for _, w in held]
    out = np.zeros(size_for(len(named)))
    out[: len(named)] = [n for n, _ in held]
    first, own, kind = len(out) - ENDS, frozenset(named), "part long, piece long, tokens long, weights binary"

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ends, words = np.zeros(CONTEXTS * 256), np.zeros(ENDS), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = [(w, n) for w, n in zip(*(c.to_pylist() for c in batch.slice(a, 4096).columns), strict=True) if w not in own]
                if rows:
                    n = np.array([n for _, n in rows], dtype=np.float64)
                    line, edges = joined([w for w, _ in rows])
                    context, before, _ = backward(line, edges)
                    np.add.at(table, context * 256 + before, np.repeat(n, np.diff(edges) - 1))
                    ends += np.bincount(line[edges[1:] - 1], n, ENDS)
                    words += len(rows)
        if words:
            yield from _pieces(np.concatenate([table, ends]), words)

    found, _ = tree_sum(counts.select("word", "n").mapInArrow(spell, kind), kind)
    bytes_ = np.zeros(CONTEXTS * 256) if found is None else found[: CONTEXTS * 256]
    if found is not None:
        out[first:] = found[CONTEXTS * 256 :]
    return named, out, bytes_.reshape(CONTEXTS, 256)


def _pieces(flat: np.ndarray, tokens: int) -> Iterator[pa.RecordBatch]:
    """A task's numbers (float64) in pieces of ``PIECE``."""
    part = TaskContext.get().partitionId()
    for piece, a in enumerate(range(0, len(flat), PIECE)):
        yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int64()), pa.array([piece], type=pa.int64()), pa.array([tokens], type=pa.int64()), pa.array([flat[a : a + PIECE].tobytes()], type=pa.binary())], names=["part", "piece", "tokens", "weights"])


def tree_sum(parts: DataFrame, kind: str) -> tuple[np.ndarray | None, int]:
    """The sum of all tasks' numbers and of their tokens, in a tree of fan-in ``FAN_IN``, piece by piece; None without parts."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(w) for w in rows["weights"].to_pylist()], axis=0)
        return pa.table([[rows["part"][0].as_py() // FAN_IN], [rows["piece"][0].as_py()], [sum(rows["tokens"].to_pylist())], [total.tobytes()]], names=["part", "piece", "tokens", "weights"])

    level = materialise(parts, "weights")
    top = level.agg(F.max("part")).first()[0]
    while top is not None:
        up = level.groupBy(F.floor(F.col("part") / FAN_IN).alias("up"), "piece").applyInArrow(add, kind)  # at most FAN_IN rows of 256 KB, whatever the vocabulary
        level = materialise(up, "weights")
        if not top:
            break
        top //= FAN_IN
    done = level.orderBy("piece").collect()  # one set of numbers
    return (np.concatenate([np.frombuffer(r.weights) for r in done]), done[0].tokens) if done else (None, 0)


def train(docs: DataFrame, named: list[bytes], counts: np.ndarray, learn: float = 0.1) -> Network:
    """Local training on every token of each task, then a weighted average of all tasks' weights."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, ids, tokens = Network.start(counts), Ids(named), 0
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in runs(np.array([len(t) for t in texts], dtype=np.int64) + 64, 1 << 20):
                tokens += teach(net, ids.both(texts[a:b])[0], learn)
        if tokens:
            yield from _pieces(net.flat().astype(np.float64) * tokens, tokens)

    kind = "part long, piece long, tokens long, weights binary"
    total, tokens = tree_sum(docs.mapInArrow(local, kind), kind)
    return Network.start(counts) if total is None else Network.from_flat(total / tokens, len(counts))


def teach(net: Network, texts: list[np.ndarray], learn: float) -> int:
    tokens, around = windows(texts, net.size) if texts else (np.empty(0, dtype=np.int64), np.empty((len(OFFSETS), 0), dtype=np.int64))
    for a in range(0, len(tokens), BATCH):
        net.run(tokens[a : a + BATCH], around[:, a : a + BATCH], learn)
    return len(tokens)


def score(docs: DataFrame, net: Network, named: list[bytes], spelling: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood`` of whole texts; ``spelling``: the counts of bytes in contexts."""
    flat, size = net.flat(), net.size
    weights = docs.sparkSession.sparkContext.broadcast((flat, named, byte_logs(spelling).astype(np.float32)))
    held: list[tuple[Network, Ids]] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not held:
            flat, words, logs = weights.value
            held.append((Network.from_flat(flat, size), Ids(words, logs)))
        model, ids = held[0]
        texts, spelled = ids.both(utf8(batch.column(1)))
        tokens, around = windows(texts, size)
        found = np.concatenate([[0.0], *(model.run(tokens[a : a + BATCH], around[:, a : a + BATCH]) for a in range(0, len(tokens), BATCH))])
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        sums = np.array([found[1 + e - n : 1 + e].sum() for e, n in zip(ends, sizes, strict=True)]) + spelled
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sums, type=pa.float64())], names=["doc_id", "n_tokens", "log_likelihood"])

    return map_batches(docs, run, "doc_id long, n_tokens long, log_likelihood double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_tokens, log_likelihood, mean_log_likelihood``, by a network trained on these texts.

    Null and empty texts have no tokens, a log-likelihood of 0 and a null mean.  Null ids stay null; repeated rows are
    trained on and scored each; an empty table gives no row.
    """
    given = id_text(docs, id_col, text_col)
    named, counts, spelling = vocabulary(materialise(word_counts(given), "words"))
    scored = score(given, train(given, named, counts), named, spelling)
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
