"""Sharding, exact deduplication and mixing against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkomics.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string, keep string, mix_key string"
TEXTS = ["a b", "ab", " a\tb\n", "", None, " \n", "äö", "b a", "x" * 50_000, "a b", "é", "é"]
ROWS = [(i, t, f"s{i % 3}" if i % 5 else None, "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
EXTRA = [(3, "", "s0", "c", "c", "c"), (None, "ab", "s1", "c", "c", "c"), (None, "solo", "s1", "c", "c", "c")]


def jump_one(key, n):
    b = j = -1
    j = 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_law():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 7, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.tolist() == [jump_one(int(k), n) for k in keys]
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.03


def test_shards(spark):
    rows = ROWS + EXTRA
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), 4).collect()
    sizes = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def exact_brute(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), math.inf if i is None else i, n, i))
    out = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda m: m[:2])
        for m in members:
            out[m[3], best[3], len(members), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out, len(groups)


def test_exact_groups(spark):
    rows = ROWS + EXTRA
    want, n = exact_brute(rows)
    weak = lambda text: F.substring(F.hex(F.md5(text)), 1, 1).cast("binary")  # noqa: E731  nearly every hash collides
    for hashed in (exact_dedup.md5_128, weak):
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), content_hash=hashed).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    unique = exact_dedup.drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert unique.columns == [f.strip().split()[0] for f in SCHEMA.split(",")]
    assert sorted(r.doc_id for r in unique.collect()) == [2, 5, 6, 7, 8, 10]


def poisson(rate, u):
    p = c = math.exp(-rate)
    k = 0
    while c < u and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing_counts(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 == 0 else f"s{i % 4}", "c", "c", "c") for i in range(600)] + EXTRA + [(9000, None, None, "c", "c", "c"), (9001, "q", "", "c", "c", "c")]
    weights = {"hot": 0.2, "s1": 0.7, "": 0.1, "absent": 3.0}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df, weights=weights, epochs=2.0).collect()
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").encode()) + 1
    present = {s: weights.get(s or "", 0.0) for s in sizes}
    total = sum(present.values())
    want = Counter()
    for i, t, s, *_ in rows:
        rate = present[s] / total * 2.0 * sum(sizes.values()) / sizes[s]
        parts = max(1, math.ceil(rate / 500))
        for part in range(1, parts + 1):
            key = ":".join(["17", "n", *([str(i)] if i is not None else []), str(part)])
            want[i, s] += poisson(rate / parts, (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    assert Counter((r.doc_id, r.source) for r in got) == +want
    keys = [r.mix_key for r in got]
    assert keys == sorted(keys)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(df, weights={}).collect() == []


def test_mixing_large_rates_and_many_sources(spark, monkeypatch):
    rows = [(i, "t" * 9, f"s{i}", "c", "c", "c") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = mixing.mix(df, weights={"s7": 1.0}, epochs=30.0)
    assert abs(one.count() - 1200) < 5 * math.sqrt(1200)
    want = sorted(map(tuple, mixing.mix(df).select("doc_id", "mix_copy", "mix_key").collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "mix_copy", "mix_key").collect())) == want


def test_sql_agrees_on_a_fixture(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    a = sorted(map(tuple, exact_dedup.op8_exact_dedup(spark, str(tmp_path)).collect()))
    assert a == sorted(con.sql(exact_dedup.OP8_SQL).fetchall())
