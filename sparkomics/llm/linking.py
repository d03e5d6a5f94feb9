"""Candidate search, exact verification and distributed union-find, shared by the near-duplicate operators.

Nodes are classes of equal shingle sets, so copies never meet here.  A bucket is a band value that several nodes share.
No bucket is expanded into its pairs:

1. Every node is compared with a leader of one of its buckets, and what that links is contracted.
2. Buckets of at most ``SMALL`` nodes that still hold several components are compared pair by pair.  The nodes of larger ones
   go through an exact prefix filter (Xiao et al. 2008, 2011).  All shingles are put in one order, rare ones first, by
   counts over these nodes' whole sets.  Sets at the similarity share a shingle within their prefixes in that order, and
   at the first one that they share, what is left of both must still allow the similarity.  No pair of these nodes is lost, whatever the order.
3. For each prefix shingle, its nodes are compared with the most central one (the one whose shingles are least rare), and
   what that links is contracted.  The shingles that a large group has in common lie behind a member's own rare ones, so
   a member that the centre doesn't link has used up its prefix before it comes to them.
4. What still shares a prefix shingle in different components, under the bound of step 2, is compared pair by pair,
   joined by shingle and class of set size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, release, tidy
from .exact_dedup import where_set

#: Places of the table of shingle counts (4 bytes each on every worker), and how many of its parts meet in one task.
SLOTS, PIECES, FAN_IN = 1 << 20, 16, 64
#: A bucket of at most so many nodes is compared pair by pair, unless the caller says otherwise.
SMALL = 8
#: Width of a class of set sizes in the last join, as a ratio.
CLASS = 1.1


class CirculantMinHash:
    """C-MinHash (Li & Li 2022): a first permutation scatters the shingles over ``2**bits`` places, a second one is read
    circularly shifted by 0, 1, 2, ...: coordinate k of a set is the least value of ``second[(place + k) mod 2**bits]``.

    The first permutation is a bijective 64-bit mix whose high bits give the place.  ``bands`` of ``rows`` coordinates
    are hashed to one 64-bit value each.
    """

    def __init__(self, bands: int, rows: int, bits: int = 20, seed: int = 1) -> None:
        self.bands, self.rows, self.size = bands, rows, 1 << bits
        self.shift, self.seed = np.uint64(64 - bits), np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        second = np.random.default_rng(seed).permutation(self.size).astype(np.uint16 if bits <= 16 else np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: bands * rows - 1]]), bands * rows)
        # a window as one item of overlapping bytes: copied whole, out of a table that stays in the cache
        item, step = self.windows.itemsize * bands * rows, self.windows.itemsize
        self.cells = np.ndarray((self.size,), dtype=f"V{item}", buffer=np.append(second, second[: bands * rows - 1]), strides=(step,)) if bits <= 16 else None

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (mix64(hashes ^ self.seed) >> self.shift).view(np.int64)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None, block: int = 64) -> np.ndarray:
        """One row for each run of ``hashes`` that begins at one of ``starts`` (ascending, no run is empty) and has ``counts``
        of them (all up to the next run).  Runs are cut into chunks of ``CHUNK`` places, ``block`` chunks at a time."""
        if counts is None:
            counts = np.diff(np.append(starts, len(hashes)))
        places = self.places(hashes)
        chunks = -(-counts // CHUNK)
        firsts = np.cumsum(chunks) - chunks
        of = np.repeat(np.arange(len(starts)), chunks)
        at = starts[of] + (np.arange(len(of)) - firsts[of]) * CHUNK
        ends = (starts + counts - 1)[of]
        least = np.empty((len(of), self.bands * self.rows), dtype=self.windows.dtype)
        steps = np.arange(CHUNK)[:, None]
        for a in range(0, len(of), block):
            b = min(a + block, len(of))
            if not a % (16 * block):
                some = slice(a, a + 16 * block)
                indexes = places[np.minimum(at[some] + steps, ends[some])]  # the last place of a run fills its last chunk
            index = np.ascontiguousarray(indexes[:, a % (16 * block) :][:, : b - a])
            rows = self.windows[index] if self.cells is None else self.cells[index].view(self.windows.dtype)
            np.minimum.reduce(rows.reshape(CHUNK, -1), axis=0, out=least[a:b].reshape(-1))
        return least if len(of) == len(starts) else np.minimum.reduceat(least, firsts, axis=0)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(sets, bands) int64."""
        cells = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), cells.shape[:2]).copy()
        for r in range(self.rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
        return out.view(np.int64)


CHUNK = 32


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``: the least node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each written to the shared folder.  A step sums
    a node's neighbours before the shuffle and sends every edge once; the join that brings a hub's sum back is one that
    adaptive execution splits.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b")
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        moved = met.where("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    last = None
    while (mark := digest(now)) != last:
        last, old = mark, now
        now = materialise(star(star(now, large=True), large=False), "edges")
        release(old)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs (a, b)`` those with 100 * intersection >= percent * union of their ``sets (node, items)``."""
    both = fetched(pairs, sets)
    n = F.size("items_a").cast("long") + F.size("items_b")
    short, long = F.least(F.size("items_a"), F.size("items_b")), F.greatest(F.size("items_a"), F.size("items_b"))
    both = both.where(100 * short.cast("long") >= percent * long.cast("long"))
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return both.where(100 * common >= percent * (n - common)).select("a", "b")


def fetched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, items_a, items_b``.  The first node's set travels with the pair; a hot node is hot in pairs of two
    numbers only."""
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(first, "a").join(second, "b")


def shared_bands(classes: DataFrame) -> DataFrame:
    """``node, key, leader`` of ``classes (node, bands)`` for every band value that two or more nodes have; leader: the least."""
    dealt = classes.select("node", F.explode("bands").alias("key")).repartition("key")
    least = dealt.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader != most")
    return materialise(dealt.join(least.select("key", "leader"), "key").select("node", "key", "leader").distinct(), "bands")


Hashes = Callable[[pa.Array], list[np.ndarray]]


def array_hashes(items: pa.Array) -> list[np.ndarray]:
    """Of array<long> items."""
    flat, ends = items.flatten().to_numpy().view(np.uint64), items.offsets.to_numpy()
    return np.split(flat, (ends - ends[0])[1:-1]) if len(items) else []


def token_counts(sets: DataFrame, hashes: Hashes) -> np.ndarray:
    """In how many of ``sets (node, items)`` each shingle occurs, by the low bits of its hash: ``SLOTS`` numbers, summed in a
    tree of fan-in ``FAN_IN``, piece by piece and without the places that are 0."""
    width = SLOTS // PIECES
    kind = "part long, piece int, slots binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                found = [h & np.uint64(SLOTS - 1) for h in hashes(batch.column(1).slice(a, 512))]
                slots = np.sort(np.concatenate(found)).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
                table[slots[starts]] += np.diff(np.append(starts, len(slots))).astype(np.uint32)
        part, rows = TaskContext.get().partitionId(), []
        for piece in range(PIECES):
            own = table[piece * width : (piece + 1) * width]
            at = np.flatnonzero(own).astype(np.uint32)
            if len(at):
                rows.append((part, piece, at.tobytes(), own[at].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "piece", "slots", "counts"])

    def dense(slots: list[bytes], counts: list[bytes]) -> np.ndarray:
        table = np.zeros(width, dtype=np.uint32)
        for s, c in zip(slots, counts, strict=True):
            table[np.frombuffer(s, dtype=np.uint32)] += np.frombuffer(c, dtype=np.uint32)
        return table

    def add(rows: pa.Table) -> pa.Table:
        table = dense(rows["slots"].to_pylist(), rows["counts"].to_pylist())
        at = np.flatnonzero(table).astype(np.uint32)
        return pa.table([[rows["part"][0].as_py() // FAN_IN], pa.array([rows["piece"][0].as_py()], type=pa.int32()), [at.tobytes()], [table[at].tobytes()]], names=["part", "piece", "slots", "counts"])

    level = materialise(sets.select("node", "items").mapInArrow(count, kind), "counts")
    top = level.agg(F.max("part")).first()[0]
    while top:
        up = level.groupBy(F.floor(F.col("part") / FAN_IN).alias("up"), "piece").applyInArrow(add, kind)  # FAN_IN rows at most
        level, old = materialise(up, "counts"), level
        release(old)
        top //= FAN_IN
    out = np.zeros(SLOTS, dtype=np.uint32)
    for r in level.collect():  # one table, at most 8 bytes a place
        out[r.piece * width : (r.piece + 1) * width] = dense([r.slots], [r.counts])
    return out


def prefixes(sets: DataFrame, hashes: Hashes, counts: np.ndarray, percent: int) -> DataFrame:
    """``node, token, at, size, rarity`` for the first shingles of each of ``sets (node, items)`` in the order of (count, hash).

    A partner has percent / 100 of the set at least, so one of the first ``size - that + 1`` is shared.  ``at`` is the
    shingle's place in the order.  Shingles that no other set has are left out.  ``rarity`` is the mean of 1 / count.
    """
    table = sets.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers of 4 bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "token", "at", "size", "rarity"]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                nodes, parts = batch.column(0).slice(a, 512).to_numpy(zero_copy_only=False), []
                for node, h in zip(nodes.tolist(), hashes(batch.column(1).slice(a, 512)), strict=True):
                    n = table.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                    first = len(h) - (-(-percent * len(h) // 100)) + 1
                    order = np.lexsort((h, n))[:first]
                    at = np.flatnonzero(n[order] > 1)
                    parts.append((np.full(len(at), node), h[order][at], at, np.full(len(at), len(h)), np.full(len(at), (1 / n).mean())))
                if parts:
                    node, token, at, size, rarity = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.int64()), pa.array(token.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(rarity)], names=names)

    return sets.select("node", "items").mapInArrow(cut, "node long, token long, at int, size int, rarity double")


def most_partner(percent: int) -> Column:
    """The largest set size that a partner may have if ``at`` is the place of the first shared shingle: what is left must hold
    the common part, percent / (100 + percent) of both sizes."""
    return F.floor(((100 + percent) * (F.col("size") - F.col("at")).cast("long") - percent * F.col("size").cast("long")) / percent)


def link(shared: DataFrame, sets: DataFrame, hashes: Hashes = array_hashes, percent: int = 80, verify: Callable[[DataFrame, DataFrame, int], DataFrame] = verified, bands: int = 1, few: int = SMALL) -> DataFrame:
    """``node, component`` of all nodes with a verified link, from ``shared_bands`` and the nodes' exact ``sets (node, items)``,
    whose shingles ``hashes`` gives and which ``verify`` compares.  Candidates are pairs that share ``bands`` band values.
    Buckets of at most ``few`` nodes are compared pair by pair; the others go through the prefix filter."""
    spark = shared.sparkSession
    led = shared.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("n")).where(F.col("n") >= bands)
    pairs = led.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("a")).select("a", F.col("node").alias("b"))
    found = materialise(components(materialise(verify(pairs, sets, percent), "links")), "components")
    named = _with_components(shared.select("node", "key"), found)
    groups = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n")
    mixed = materialise(named.join(groups, "key").select("node", "key", "component", "n"), "mixed")

    small = mixed.where(F.col("n") <= few).select("key", "node", "component")  # few / 2 pairs for each row at most
    other = small.select("key", F.col("node").alias("a"), F.col("component").alias("of"))
    met = small.join(other, "key").where("a < node and component != of").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    met = met.where(F.col("n") >= bands).select("a", "b")  # a pair that shares a larger bucket as well is found below
    found = _united(found, met, sets, percent, verify)

    named = _with_components(mixed.where(F.col("n") > few).select("node", "key"), found)
    asked = materialise(_mixed(named, "key").select("node").distinct(), "asked")
    if asked.isEmpty():
        return found
    tidy(spark)
    held = where_set(sets.select("node", "items"), "node", asked)
    rows = prefixes(held, hashes, token_counts(held, hashes), percent).withColumn("most", most_partner(percent))
    rows = materialise(rows, "tokens")

    now = _with_components(rows, found)
    groups = now.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct("rarity", "node", "component", "size", "most")).alias("c")).where("x != y")
    now = materialise(now.join(groups, "token").select("node", "token", "component", "size", "most", "c"), "rest")
    release(rows)
    tidy(spark)
    met = now.where("component != c.component and size <= c.most and c.size <= most")
    met = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    found = _united(found, met, sets, percent, verify)

    now = _mixed(_with_components(now.select("node", "token", "size", "most"), found), "token")
    # the smaller set (by size, then node) stands in its class of sizes; the larger one asks the classes it may meet
    step = float(np.log(CLASS))
    small = now.where("most >= size").withColumn("class", F.floor(F.log("size") / step))
    least, top = F.ceil(F.col("size") * percent / 100), F.least("size", "most")
    large = now.where(top >= least).withColumn("class", F.explode(F.sequence(F.floor(F.log(least) / step), F.floor(F.log(top) / step))))
    large = large.select("token", "class", *[F.col(c).alias(f"of_{c}") for c in ("node", "component", "size", "most")])
    ordered = (F.col("size") < F.col("of_size")) | ((F.col("size") == F.col("of_size")) & (F.col("node") < F.col("of_node")))
    met = small.join(large, ["token", "class"]).where(ordered & F.expr("component != of_component and size <= of_most and of_size <= most"))
    return _united(found, met.select(F.least("node", "of_node").alias("a"), F.greatest("node", "of_node").alias("b")).distinct(), sets, percent, verify)


def _mixed(rows: DataFrame, by: str) -> DataFrame:
    """The ``rows`` of groups with several components."""
    groups = rows.groupBy(by).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select(by)
    return rows.join(groups, by)


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _united(found: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, verify: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    links = materialise(verify(materialise(pairs, "pairs"), sets, percent), "links")
    return found if links.isEmpty() else materialise(joined(found, links), "components")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found (node, component)`` after further ``links (a, b)``: only the components that they touch are united."""
    ends = links.select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    united = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("now"))
    every = found.unionByName(united.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
    return every.join(united, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
