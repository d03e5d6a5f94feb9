import numpy as np
from pyspark.sql import functions as F

from sparkomics.llm import linking, near_dedup

SCHEMA = "doc_id long, text string, node string, component string, bands string"


def brute(rows, width, percent=80):
    sets = []
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) or rows[a][0] == rows[b][0]:
                    parent[root(a)] = root(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        c = None if i is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and root(j) == root(k))
        out.append((i, len(sets[k]), c, c is None or c == i))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = list(rng.choice(words, int(rng.integers(12, 120))))
        for _ in range(int(rng.integers(1, 9))):
            mine = list(base)
            for _ in range(int(rng.integers(0, 8))):
                mine[int(rng.integers(len(mine)))] = str(rng.choice(words))
            rows.append((" " if g % 2 else "\n").join(mine))
            base = mine if g % 3 == 0 else base  # chains: ends that are not similar
    rows += ["", None, "  \n", "one", "ONE", "one two", "One  two ", "É b c", "é b c", "word " * 20_000, "word " * 20_001 + "end"]
    out = [(i * 3 + 1, t, "x", "y", "z") for i, t in enumerate(rows)]
    order = rng.permutation(len(out))
    return [out[k] for k in order] + [out[0], out[4], (None, "one two", "x", "y", "z"), (None, None, "x", "y", "z")]


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for width in (2, 5):
        got = sorted(map(tuple, near_dedup.near_groups(df, width=width).collect()), key=str)
        assert got == brute(rows, width)
    assert near_dedup.near_groups(df.limit(0)).collect() == []
    unique = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).dropDuplicates(["doc_id"])
    kept = near_dedup.drop_near_copies(unique)
    assert kept.columns == unique.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in brute([tuple(r) for r in unique.collect()], 5) if r[3]}


def test_links_without_the_leader(spark):
    """In one bucket, nodes that the leader doesn't link still find each other."""
    n = 40
    sets = [(i, [100 * i + k for k in range(10)]) for i in range(n)] + [(n + i, [100 * i + k for k in range(9)]) for i in range(n)]
    shared = spark.createDataFrame([(i, 7, 0) for i, _ in sets], "node long, key long, leader long")
    found = linking.link(shared, spark.createDataFrame(sets, "node long, items array<long>"))
    assert sorted(map(tuple, found.collect())) == sorted([(i, i) for i in range(n)] + [(n + i, i) for i in range(n)])


def test_a_group_around_the_threshold(spark):
    """One bucket of variants of one set, many of them just below the similarity: no link of all pairs is lost, and few
    pairs are compared."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 120)
    sets = []
    for i in range(300):
        own = base.copy()
        hit = rng.choice(120, int(rng.integers(4, 24)), replace=False)
        own[hit] = rng.integers(-(2**62), 2**62, len(hit))
        sets.append((i, [int(x) for x in np.unique(np.append(own, rng.integers(-(2**62), 2**62, int(rng.integers(0, 6)))))]))
    compared = []

    def counting(pairs, items, percent):
        compared.append(pairs.count())
        return linking.verified(pairs, items, percent)

    shared = spark.createDataFrame([(i, 7, 0) for i, _ in sets], "node long, key long, leader long")
    found = {r.node: r.component for r in linking.link(shared, spark.createDataFrame(sets, "node long, items array<long>"), verify=counting).collect()}
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = [set(items) for _, items in sets]
    for a in range(len(sets)):
        for b in range(a):
            n = len(every[a] & every[b])
            if 100 * n >= 80 * (len(every[a]) + len(every[b]) - n):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [found.get(i, i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]
    assert sum(compared) < len(sets) ** 2 / 16  # an eighth of all pairs


def test_components_of_paths_and_rings(spark):
    rng = np.random.default_rng(2)
    edges, want = [], {}
    for g in range(6):
        ids = [int(x) for x in rng.permutation(60)[:40] + g * 1000]
        edges += list(zip(ids[:-1], ids[1:], strict=True)) + [(ids[-1], ids[0])] * (g % 2)
        want |= {i: min(ids) for i in ids}
    got = linking.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    maker = linking.CirculantMinHash(32, 5)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.8):
        other = np.concatenate([x[: int(3000 * share)], rng.integers(0, 2**63, 3000 - int(3000 * share)).astype(np.uint64)])
        both = maker.signatures(np.concatenate([x, other]), np.array([0, 3000]))
        assert abs((both[0] == both[1]).mean() - share / (2 - share)) < 0.12
    parts = maker.signatures(x, np.array([0, 10, 2999]), block=3)
    assert (parts.min(axis=0) == maker.signatures(x, np.array([0]))[0]).all()
    brute_force = np.array([[min(maker.windows[:, 0][(p + k) % maker.size] for p in maker.places(x[:10])) for k in range(160)]])
    assert (parts[0] == brute_force[0]).all()
