import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkomics.llm import packing
from sparkomics.llm.packing import Limits, VectorPacker

SCHEMA = "doc_id long, text string, start string, length string"
TEXTS = ["", None, "   \n\t ", "One two, THREE's don't 12 x", "é à ÜBER straße İstanbul ﬁn ① <|endoftext|> a<|startoftext|>b", "\x1c a b c é ́x", "z" * 700, "word " * 9000, "$$$ ###&&& 3.14"]


def test_every_id_once(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y"), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    tok = Tokenizer.from_file(packing.tokenizer_file())
    want = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    got = packing.pack_documents(docs, packing.tokenizer_file()).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at and n > 0
            at += n
        assert at == 2048 or at & (at - 1) == 0
    for (i, _), ids in want.items():
        if i == 3:
            continue
        mine = sorted(parts[i])
        assert [x for _, p, _ in mine for x in p] == ids and {n for *_, n in mine} == {len(ids)}
    assert sum(len(p) for _, p, _ in parts[3]) == 2 * len(want[3, TEXTS[3]])


def test_empty_table_and_query(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert packing.op1_packing(spark, str(tmp_path)).collect() == []


def test_crc(spark, tmp_path):
    spark.createDataFrame([(7, "Hello there", "a", "b")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op1_packing(spark, str(tmp_path)).collect()
    ids = [*Tokenizer.from_file(packing.tokenizer_file()).encode("Hello there", add_special_tokens=False).ids, 1]
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold(spark, cut):
    rng = np.random.default_rng(3)
    rows = [(i, int(n), int(n * s), 1) for i, (n, s) in enumerate(zip(rng.integers(0, 260, 900), rng.random(900), strict=True))] + [(None, 5, None, 1), (1000, None, 3, 1), (1001, -4, 2, 1), (1002, 900, 9999, 1)]
    df = spark.createDataFrame(rows, "example_id long, n long, loss long, sequence_id int").coalesce(1)
    limits = Limits(256, 6, 100)
    got = packing.pack_examples(df, "example_id", "n", "loss", limits, cut).collect()
    seqs, per = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        per[r.example_id].append(r)
    for s in seqs.values():
        assert sum(r.length for r in s) <= 256 and len(s) <= 6 and sum(r.loss_tokens for r in s) <= 100
    for i, n, loss, _ in rows:
        n = max(n or 0, 0)
        assert sum(r.length for r in per.get(i, [])) == n
        assert sum(r.loss_tokens for r in per.get(i, [])) == min(n, n if loss is None else loss)
        if not cut and 0 < n <= 256 and (loss or 0) <= 100 and i is not None:
            assert len(per[i]) == 1


def test_dot_product_rule_mixes_demands():
    # one dimension short: tokens-heavy and loss-heavy examples share bins
    packer = VectorPacker(Limits(100, 10, 50), cut=False, pool=8)
    done = []
    for k, (t, l) in enumerate([(60, 10), (40, 40), (60, 10), (40, 40)]):
        done += packer.add(k, t, l)
    done += packer.end()
    assert [sorted(p.length for p in s) for s in done] == [[40, 60], [40, 60]]
