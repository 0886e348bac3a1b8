import importlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
import oracle_check
from faultlens.llm import fm, secrets
from faultlens.llm.queries import ORACLES, QUERIES
from test_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    r = oracle_check.compare(spark, oracle_check.duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert r["ok"], r


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(importlib.import_module("__spark_entry__").queries()) >= {*QUERIES, "pipeline"}


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version on the rows its predecessor kept."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet")
    machine = fm.train(start, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in fm.score(start, machine).collect() if r.predicted}
    assert {r.doc_id for r in kept[0]} == good and len(kept[0]) == len(good)
    roots = brute([(r.doc_id, r.text) for r in kept[0]], 5, 80, 100)
    assert sorted(r.doc_id for r in kept[1]) == sorted(d for d, (_, root) in roots.items() if d == root)
    text = {r.doc_id: r.text for r in kept[1]}
    for r in kept[2]:
        strong = secrets.strong_spans(text[r.doc_id])
        spans = sorted(strong + secrets.linked_spans(text[r.doc_id], strong))
        assert r.text == secrets.redact(text[r.doc_id], [{"kind": secrets.KINDS[k], "start": a, "end": b} for a, k, b in spans])
        assert r.n_chars == len(r.text) and not secrets.strong_spans(r.text)
    assert {tuple(r) for r in kept[3]} == {tuple(r) for r in kept[2]}
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    times, length = Counter(r.doc_id for r in kept[3]), Counter()
    for r in kept[4]:
        length[r.doc_id] += r.length
    for r in kept[2]:
        assert length[r.doc_id] == times[r.doc_id] * (len(encode.encode(r.text, add_special_tokens=False).ids) + 1)
    assert all(zlib.crc32(b"") != r.ids_crc32 for r in kept[4])
