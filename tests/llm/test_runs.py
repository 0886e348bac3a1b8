import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import runs
from faultlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=6):
    """Every period by itself: maximal stretches, the smallest period of each."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def numbered(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def found(documents):
    out = [[] for _ in documents]
    for d, s, n, q in runs.find_runs([numbered(w) for w in documents]).tolist():
        out[d].append((s, n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 9)), max_size=6), max_size=5))
def test_runs_of_random_repeats(documents):
    documents = [list("".join(w * k for w, k in d)) for d in documents]
    assert found(documents) == [brute(d, 4) for d in documents]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("seed", range(6))
def test_long_periods_nested_and_touching(seed):
    rng = random.Random(seed)
    documents = []
    for _ in range(4):
        words = []
        while len(words) < 700:
            block = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.3:
                block = block[:3] * 5 + block  # a run inside every period
            words += block * rng.randrange(1, 7) + block[:rng.randrange(len(block))]
        documents.append(words)
    documents += [thue_morse(600), fibonacci(600), [7] * 500, list(range(300)), thue_morse(37) * 9, fibonacci(100) * 5]
    assert found(documents) == [brute(d, 4) for d in documents]


def test_the_set_is_consistent_and_dense():
    """A position's membership depends on its context, and every stretch without
    a member has a small period."""
    rng = random.Random(3)
    seq = np.array([rng.randrange(2) for _ in range(900)] + [1, 0] * 40 + [rng.randrange(2) for _ in range(300)], np.int64)
    t = 8
    names, member = {}, {}
    hashes = np.array([zlib.crc32(str(seq[i:i + t].tolist()).encode()) for i in range(len(seq) - t + 1)], np.uint64)
    covered = np.array([any((seq[i:i + t - p] == seq[i + p:i + t]).all() for p in range(1, t // 4 + 1)) for i in range(len(hashes))])
    places = set(runs.synchronising_set(hashes, t, covered).tolist())
    for i in range(len(seq) - 2 * t + 1):
        assert member.setdefault(tuple(seq[i:i + 2 * t]), i in places) == (i in places)
    for i in range(len(seq) - 3 * t + 2):
        if not places & set(range(i, i + t)):
            part = seq[i:i + 3 * t - 1]
            assert any((part[:-p] == part[p:]).all() for p in range(1, t // 4 + 1))
    assert len(places) < len(seq) / 2 and not names


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    every = brute(words)
    gone = {i for s, n, q in every for i in range(s + q, s + n)}
    best = max(every, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(every), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in every).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).select(*COLUMNS).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d.doc_id]) == expected(d.doc_id, d.text)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "x " * 30, "a"), (1, None, "b"), (2, "", "c"), (3, " \t\n\x0b\x0c\r ", "d"), (4, "a a a a a", "e"), (5, "a a a a a a", "f"),
            (5, "a a a a a a", "g"), (6, "é é " * 9, None), (7, ("lorem ipsum dolor sit amet " * 40_000), "h"), (8, "w" * 300_000, "i")]
    rows += [(k, " ".join(random.Random(k).choice(["x", "y", "zz"]) for _ in range(k % 90)), "r") for k in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    short = [r for r in rows if r[0] != 7]
    assert sorted([r for r in got if r[0] != 7], key=key) == sorted([expected(d, t) for d, t, _ in short], key=key)
    assert [r[:6] for r in got if r[0] == 7] == [(7, 1, 0, 200_000, 5, 40_000_000)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/e").collect() == []
