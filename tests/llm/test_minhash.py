import random
import re

import numpy as np
import pytest

from faultlens.llm import minhash
from faultlens.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, digest int"


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 150))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    for _ in range(40):  # share a passage, differ in the rest: many in one bucket, few linked
        rows.append((n, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Two words"), (n + 4, "two  WORDS"), (n + 5, "É x"), (n + 6, "é x")]
    return rows


@pytest.mark.parametrize("k,num,block", [(3, 85, 2048), (5, 80, 4)])
def test_against_brute_force(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)  # small blocks: buckets are dealt over several
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=k, similarity=(num, 100)).collect()}
    assert got == brute(rows, k, num, 100)


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, None, None), (5, text, None, None), (5, text, None, None), (2, text + " b", None, None),
                                  (9, None, None, None)], SCHEMA)
    got = sorted(minhash.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True), (None, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_signature_is_circulant():
    members = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    least = minhash.signature(members, 6)
    place = minhash._sigma(members)
    for k in range(6):
        shifted = (place.astype(np.int64) - (k + 1)) % (1 << 32)
        assert least[k] == minhash._pi(shifted.astype(np.uint32)).min()


def test_agreement_estimates_jaccard():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1200).astype(np.uint64))
    a, b = x[:1000], x[200:]
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
