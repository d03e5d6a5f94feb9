from collections import Counter

import numpy as np

from sparkomics.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, word string, n_tokens string"


def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(200):
        words = []
        while len(words) < 60:
            k = int(rng.integers(6))
            words += [f"a{k}", f"b{k}", f"c{k}"]
        out.append((i, " ".join(words), "x", "y"))
    return out


def one_by_one(net, ids):
    """log p of each token by the definition, one at a time."""
    padded = [lm.SIZE] * 2 + list(ids) + [lm.SIZE] * 2
    total = 0.0
    for k, t in enumerate(ids):
        h = np.tanh(sum(net.tables[j][padded[k + 2 + o]].astype(float) for j, o in enumerate(lm.OFFSETS)))
        for logits, at in ((h @ net.outer + net.outer_bias, t // lm.INNER), (h @ net.inner[t // lm.INNER] + net.inner_bias[t // lm.INNER], t % lm.INNER)):
            total += logits[at] - np.log(np.exp(logits).sum())
    return total


def test_scores_by_definition_and_order_matters(spark):
    docs = rows()
    extra = [(900, None, "x", "y"), (901, " \n", "x", "y"), (None, docs[0][1], "x", "y"), docs[5], (902, "zz " * 30_000, "x", "y"), (903, "q" * 1000 + " a1", "x", "y")]
    d = spark.createDataFrame(docs + extra, SCHEMA).repartition(3)
    given = lm.id_text(d, "doc_id", "text")
    counts = lm.word_counts(given)
    want = Counter(w for _, t, *_ in docs + extra for w in (t or "").lower().split() )
    assert {bytes(r.word).decode(): r.n for r in counts.collect()} == want
    named, sizes, spelling = lm.vocabulary(counts)
    assert named[:1] == [b"zz"] and abs(sizes.sum() - sum(want.values())) < 1e-6 and not spelling.any()
    net = lm.train(given, named, sizes)
    got = lm.score(given, net, named, spelling).collect()
    assert len(got) == len(docs) + len(extra)
    ids = lm.Ids(named)
    for r in [r for r in got if r.doc_id in (0, 5, 17, 903)]:
        text = next(t for i, t, *_ in docs + extra if i == r.doc_id)
        mine = ids.of(text.encode())
        assert r.n_tokens == len(mine) and abs(r.log_likelihood - one_by_one(net, mine)) < 1e-2
    by = {r.doc_id: r for r in got}
    assert by[900].n_tokens == by[901].n_tokens == 0 and by[900].log_likelihood == 0.0
    shuffled = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), "x", "y") for i, t, *_ in docs[:50]]
    mixed = lm.score(lm.id_text(spark.createDataFrame(shuffled, SCHEMA), "doc_id", "text"), net, named, spelling).collect()
    assert np.mean([by[r.doc_id].log_likelihood > r.log_likelihood for r in mixed]) > 0.9
    final = lm.score_documents(d).collect()
    assert len(final) == len(got) and all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in final)
    assert lm.score_documents(d.limit(0)).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network.start(rng.integers(1, 50, lm.SIZE).astype(float))
    tokens, around = lm.windows([rng.integers(0, lm.SIZE, 30), rng.integers(0, lm.SIZE, 1), np.empty(0, dtype=np.int64)])
    loss = lambda n: -n.run(tokens, around).mean()
    probe = lm.Network.from_flat(net.flat())
    probe.squares = [np.full(p.shape, 1e12, dtype=np.float32) for p in probe.parts]  # a plain, tiny gradient step
    probe.run(tokens, around, 1e6 * 1e-1)
    for a, b, place in [(net.tables, probe.tables, (1, int(around[1][3]), 2)), (net.outer, probe.outer, (3, int(tokens[0] // lm.INNER))), (net.inner, probe.inner, (int(tokens[0] // lm.INNER), 5, int(tokens[0] % lm.INNER))), (net.outer_bias, probe.outer_bias, (int(tokens[1] // lm.INNER),)), (net.inner_bias, probe.inner_bias, (int(tokens[1] // lm.INNER), int(tokens[1] % lm.INNER)))]:
        stepped = (a[place] - b[place]) / 1e-1
        held = float(a[place])
        a[place] = held + 1e-2
        up = loss(net)
        a[place] = held - 1e-2
        down = loss(net)
        a[place] = held
        assert abs((up - down) / 2e-2 - stepped) < 2e-4 + 0.05 * abs(stepped)


def test_tree_of_averages(spark, monkeypatch):
    d = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    given = lm.materialise(lm.id_text(d, "doc_id", "text"), "t")
    named, sizes, _ = lm.vocabulary(lm.word_counts(given))
    whole = lm.train(given, named, sizes).flat()
    monkeypatch.setattr(lm, "FAN_IN", 2)
    assert np.allclose(whole, lm.train(given, named, sizes).flat(), atol=1e-5)


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "SPREAD", 32)  # 2,000 words pass the threshold of a small corpus
    rng = np.random.default_rng(3)
    frequent = [f"w{k}" for k in range(2000)] * lm.LEAST
    rare = [f"r{k}" for k in range(3000)] + [f"r{k}" for k in range(0, 3000, 3)]
    words = rng.permutation(frequent + rare + ["q" * 1000]).tolist()
    docs = [(i, " ".join(words[a : a + 200]), "x", "y") for i, a in enumerate(range(0, len(words), 200))]
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    given = lm.id_text(d, "doc_id", "text")
    named, sizes, spelling = lm.vocabulary(lm.word_counts(given))
    assert set(named) == {f"w{k}".encode() for k in range(2000)}  # more words than NAMED
    logs, held = lm.byte_logs(spelling), Counter(w.encode() for w in words)
    ids, want = lm.Ids(named, logs), np.zeros((lm.CONTEXTS, 256))
    for w, n in held.items():
        if w not in named:
            line = [10, *w[::-1], 10]
            for i in range(2, len(line)):
                want[(line[i - 1] * 256 + line[i - 2]) * 40_503 // 16 % lm.CONTEXTS, line[i]] += n
    assert (spelling == want).all() and sizes.sum() == len(words)
    # given the last byte, the words of one and of two bytes and the beginnings of all longer ones sum to 1
    every = [b for b in range(256) if b not in b" \t\n\x0b\x0c\r"]
    context = lambda y, z: (y * 256 + z) * 40_503 // 16 % lm.CONTEXTS
    for last in b"0zq":
        one = np.exp(logs[context(last, 10)])
        total = one[10] + sum(one[b] * np.exp(logs[context(b, last)])[[10, *every]].sum() for b in every)
        assert abs(total - 1) < 1e-9
    net = lm.train(given, named, sizes)
    got = {r.doc_id: r.log_likelihood for r in lm.score(given, net, named, spelling).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs[:40] + [x for x in docs if "qqq" in x[1]]:
        own, (mine,) = [w.encode() for w in text.split()], ids.both([text.encode()])[0]
        tokens, around = lm.windows([mine], net.size)
        spelled = sum(sum(np.log((want[c, b] + lm.EPSILON) / (want[c].sum() + lm.EPSILON * lm.ALPHABET)) for c, b in zip(*lm.backward(*lm.joined([w]))[:2], strict=True)) for w in own if w not in ids.named)
        assert abs(got[i] - net.run(tokens, around).sum() - spelled) < 0.05
        assert all(t == (named.index(w) if w in ids.named else ids.first + w[-1]) for t, w in zip(mine, own, strict=True))
    every = net.run(np.arange(net.size), np.repeat(around[:, 5:6], net.size, axis=1))
    assert abs(np.exp(every).sum() - 1) < 1e-4
