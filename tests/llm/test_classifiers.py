"""Toxicity and quality rules: base statistics by brute force, models by what they must satisfy."""

import zlib

import numpy as np

from sparkomics.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string, held_out string, predicted string"
LABELS = "doc_id long, toxic int, quality int"


def world(n=600, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(20, 80))))
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(len(w)))] = "Vile," if i % 8 else "nasty!!"
        if i % 5 == 1:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), "x", "y", "z"))
        labels.append((i, int(bad), int(i % 5 != 1)))
    return docs, labels


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    docs, labels = world()
    extra = [(9001, None, "x", "y", "z"), (9002, "", "x", "y", "z"), (None, "vile", "x", "y", "z"), (5, docs[5][1], "x", "y", "z"), (9003, "fine " * 50_000, "x", "y", "z")]
    d, frame = spark.createDataFrame(docs + extra, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], LABELS)
    base = toxicity.id_text(d, "doc_id", "text")
    model = toxicity.fit_documents(base, frame)
    got = toxicity.score_documents(d, model).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97 and len(held) > 80
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    again = toxicity.fit_documents(base, spark.createDataFrame(flipped, LABELS))
    assert again.bias == model.bias and (again.places == model.places).all() and (again.weights == model.weights).all()
    assert 0 < len(model.places) < 3000
    clean = toxicity.drop_toxic(d, frame)
    assert clean.columns == d.columns and clean.count() == sum(not r.predicted for r in got)
    none = toxicity.fit_documents(base, frame.limit(0))
    assert all(abs(r.score - 1 / 11) < 1e-9 for r in toxicity.score_documents(d, none).collect())
    assert toxicity.score_documents(d.limit(0), model).collect() == []


def brute_statistics(text):
    words = [w.decode() for w in text.encode().split()]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_statistics():
    texts = ["", " \n\t", "a b\na b\n\na b", "é # x$ <b> | ü\x1cq\xa0r", "one two three four five six seven eight " * 3, "a " * 9, "a " * 8, "x y z " * 7000, " a\na\n a\n\r\n\r"]
    for t in texts:
        assert quality.statistics(t.encode())[:5] == brute_statistics(t)


def test_quality_keeps_what_it_should(spark):
    docs, labels = world()
    extra = [(9001, None, "x", "y", "z"), (9002, "too short", "x", "y", "z"), (9003, "a b c d e f g h " * 9, "x", "y", "z"), (None, docs[0][1], "x", "y", "z"), docs[3]]
    d = spark.createDataFrame(docs + extra, SCHEMA)
    got = quality.quality_documents(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: q for i, _, q in labels}
    assert all(r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert all(by[i].base_failed and not by[i].kept for i in (9001, 9002, 9003)) and by[9003].n_repeat_words == 72
    assert quality.quality_documents(d.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-4 * np.sin(5 * x[:, 0]) + 3 * x[:, 1]))).astype(float)
    model = quality.fit(x, y, np.array([-1, 0, 1]))
    grid = np.repeat(rng.random((200, 3)), 50, axis=0)
    for j, sign in ((0, -1), (2, 1)):
        probe = grid.copy()
        probe[:, j] = np.tile(np.linspace(0, 1, 50), 200)
        steps = np.diff(model.raw(probe).reshape(200, 50), axis=1)
        assert (steps * sign >= -1e-12).all()
    free = quality.fit(x, y, np.zeros(3))
    probe = grid.copy()
    probe[:, 0] = np.tile(np.linspace(0, 1, 50), 200)
    steps = np.diff(free.raw(probe).reshape(200, 50), axis=1)
    assert steps.min() < -1e-6 < 1e-6 < steps.max()

    def walk(row):
        total = model.base
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k]
            total += model.value[k]
        return total

    assert np.allclose(model.raw(x[:50]), [walk(r) for r in x[:50]])
    assert quality.fit(x[:0], y[:0], np.zeros(3)).score(x[:2]).min() > 0.9
