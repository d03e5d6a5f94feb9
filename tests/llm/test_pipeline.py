"""The stages one by one against brute force, on rows that each stage has to act on."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from sparkomics.llm import toxicity
from tests.llm.test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def world(tmp_path, spark):
    rng = np.random.default_rng(6)
    words = [f"term{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = [str(x) for x in rng.choice(words, 60)]
        if i % 10 == 0:
            w[7] = "hateful"
        rows.append((i, " ".join(w), "en", "hot" if i % 3 == 0 else f"s{i % 4}", 1))
    for k in range(12):
        rows.append((300 + k, rows[k * 7 + 1][1], "en", "hot", 1))
        rows.append((320 + k, rows[k * 5 + 2][1] + " term1 extra", "en", None, 1))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "word " * 15_000, "en", "s2", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    labels = [(r[0], 1, int("hateful" in (r[1] or ""))) for r in rows if r[0] % 2]
    labels += [(r[0], 1, int("hateful" in (r[1] or ""))) for r in rows if r[0] % 4 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return rows, path


def test_stages(spark, tmp_path):
    rows, path = world(tmp_path, spark)
    docs = spark.read.parquet(path + "/documents.parquet")
    names, now = docs.columns, {r[0]: r for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        before, docs = docs, spark.read.parquet(f"{path}/{k}")
        got = docs.collect()
        if name != "packing":
            assert docs.columns == names and all(now[r.doc_id] == tuple(r) for r in got)
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            scored = toxicity.score_documents(before, toxicity.fit_documents(toxicity.id_text(before, "doc_id", "text"), spark.read.parquet(path + "/labels.parquet"))).collect()
            assert sorted(ids) == sorted(r.doc_id for r in scored if not r.predicted)
            clean = [i for i, r in now.items() if "hateful" not in (r[1] or "")]
            assert set(clean) <= set(ids) and sum("hateful" in (now[i][1] or "") for i in ids) <= 3
        elif name == "exact_dedup":
            groups = {}
            for r in before.collect():
                groups.setdefault("".join((r.text or "").split()), []).append((-len(r.text or ""), r.doc_id))
            assert sorted(ids) == sorted(min(g)[1] for g in groups.values())
        elif name == "near_dedup":
            assert sorted(ids) == sorted(i for i, _, _, kept in brute([tuple(r) for r in before.collect()], 5) if kept)
        elif name == "mixing":
            held = [tuple(r) for r in before.collect()]
            sizes = Counter()
            for r in held:
                sizes[r[3]] += len((r[1] or "").encode()) + 1
            roots = sum(s**0.5 for s in sizes.values())
            want = Counter()
            for r in held:
                rate = sizes[r[3]] ** 0.5 / roots * sum(sizes.values()) / sizes[r[3]]
                u = (int(hashlib.md5(f"17:n:{r[0]}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                p = c = np.exp(-rate)
                n = 0
                while c < u:
                    n += 1
                    p *= rate / n
                    c += p
                want[r[0]] += n
            assert Counter(ids) == +want
        else:
            copies = Counter(r.doc_id for r in before.collect())
            length, whole = Counter(), {}
            for r in got:
                length[r.doc_id] += r.length
                whole[r.doc_id] = r.doc_tokens
            assert length == Counter({i: n * whole[i] for i, n in copies.items()})
            seqs = Counter()
            for r in got:
                seqs[r.sequence_id] += r.length
            assert all(n == 2048 or n & (n - 1) == 0 for n in seqs.values())


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"term{k}" for k in range(60))
    near, far = text + " extra", " ".join(f"other{k}" for k in range(60))
    full = lambda i, t: (i, t, "en", "s", 1)
    rows = [full(1, text)] * 3 + [full(None, text), full(None, text), full(None, far), full(None, far), full(7, near), full(7, near), full(7, far + " and more"), full(None, None), full(None, "")]
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    exact = corpus_pipeline.remove_copies(spark, d, "")
    got = Counter((r.doc_id, r.text or "") for r in exact.collect())
    assert exact.columns == d.columns and got == Counter([(1, text), (None, far), (7, near), (7, far + " and more"), (None, "")])
    kept = corpus_pipeline.remove_near_copies(spark, d, "")
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    # empty texts are linked with nothing
    assert kept.columns == d.columns and got == Counter([(1, text), (7, far + " and more"), (None, ""), (None, "")])
