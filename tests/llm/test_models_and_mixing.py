import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from faultlens.llm import fm, rules
from faultlens.llm.embed_dedup import near_vectors, passes_for
from faultlens.llm.mixing import largest_remainders, mix_documents, mix_sources
from faultlens.llm.words import Powers


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    width = fm.BUCKETS + len(fm.STATS)
    m = fm.Machine(np.zeros(len(fm.STATS)), np.ones(len(fm.STATS)), 0.3, rng.normal(size=width), rng.normal(size=(width, fm.FACTORS)))
    got = np.concatenate([m.margin(*f) for f in fm.features(pa.array(["a b a", None, "One two | three"]), pa.array([5, None, 15]), Powers())])
    for (row, bucket, value, stats), n in ((next(iter(fm.features(pa.array(["a b a", None, "One two | three"]), pa.array([5, None, 15]), Powers()))), 3),):
        r, b, x = m.entries(row, bucket, value, stats)
        for k in range(n):
            i, v = b[r == k], x[r == k]
            pairs = sum(m.factors[i[p]] @ m.factors[i[q]] * v[p] * v[q] for p in range(len(i)) for q in range(p))
            assert math.isclose(got[k], m.bias + m.linear[i] @ v + pairs, rel_tol=1e-9)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = fm.train(docs, labels, sample=2000)
    rows = fm.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", -5, "x"), (1, "a b " * 50000, 3, "x")], "doc_id long, text string, n_chars long, score string")
    got = fm.score(odd, machine).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and not got[0].held_out
    assert fm.score(odd.limit(0), machine).collect() == [] and fm.keep_good(odd, machine).columns == odd.columns
    blank = fm.train(odd, labels.limit(0))
    assert {r.score for r in fm.score(odd, blank).collect()} == {0.5}


def vectors(seed, n_groups, size, dims):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 6)) if g else size):
            rows.append((base + rng.normal(size=dims) * rng.uniform(0, 0.25)).tolist())
    return rows


def test_vectors_against_brute_force(spark):
    rows = [(i, v, i % 2, "x") for i, v in enumerate(vectors(0, 150, 900, 24))]
    n = len(rows)
    rows += [(n, rows[0][1], 0, "x"), (n + 1, [3 * c for c in rows[0][1]], 0, "x"), (n + 2, None, 0, "x"), (n + 3, [0.0] * 24, 0, "x"),
             (n + 4, [None] + rows[0][1][1:], 0, "x"), (n + 5, [float("nan")] * 24, 0, "x"), (n + 6, rows[0][1], None, "x"), (n + 7, rows[0][1][:5], 0, "x"),
             (n + 8, [], 0, "x"), (n + 9, [float("inf")] * 24, 0, "x"), (None, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, size string").repartition(4)
    near, root = defaultdict(set), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    for k, (a, u, la, _) in enumerate(sound):
        for b, v, lb, _ in sound[:k]:
            if la == lb and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                near[a].add(b)
                near[b].add(a)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    right = sum(r.n_links == len(near[r.vec_id]) for r in got if r.vec_id is not None)
    assert right >= len(rows) - 4  # pairs at the very threshold may be missed with a chance of 1e-5
    assert all(r.component_id == find(r.vec_id) and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert near_vectors(df.limit(0)).collect() == [] and passes_for(10 ** 6, 0.93) > passes_for(1000, 0.93)


def mixture(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, block string")
    return df, mix_sources(df, **options).collect()


def test_mixture_meets_entropy_budget_and_spreads(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 10 else f"s{i % 30}") for i in range(4000)]
    _, reads = mixture(spark, rows, target_entropy=0.9, max_repeats=None, block_tokens=4096)
    tokens = defaultdict(int)
    for r in reads:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    budget = sum(len(t.split()) for _, t, _ in rows)
    entropy = -sum(v / total * math.log(v / total) for v in tokens.values()) / math.log(len(tokens))
    assert abs(total - budget) < 15 * len(tokens) and abs(entropy - 0.9) < 0.01
    blocks = defaultdict(lambda: defaultdict(int))
    for r in reads:
        blocks[r.block][r.source] += r.n_tokens
    for b in blocks.values():  # every block has the weights
        assert all(abs(b[s] / sum(b.values()) - v / total) < 0.05 for s, v in tokens.items())
    _, whole = mixture(spark, rows, whole=True, max_repeats=3.0)
    times = defaultdict(int)
    for r in whole:
        times[r.doc_id] += 1
    assert set(times) == set(range(4000)) and max(times.values()) <= 4


def test_mixture_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "s"), (2, None, "s"), (3, "", "empty")]
    df, reads = mixture(spark, rows, whole=True)
    assert {(r.doc_id, r.source) for r in reads} == {(1, None), (None, "s"), (2, "s"), (3, "empty")}
    mixed = mix_documents(df, whole=True)
    assert mixed.columns == df.columns and {(r.doc_id, r.source, r.block) for r in mixed.collect()} == {(d, s, "x") for d, _, s in rows}
    assert mix_sources(df.limit(0)).collect() == []


def test_a_tiny_source_is_read_once_at_natural_weights(spark):
    """Quotas are whole tokens that add up to the budget, so with natural weights
    and a budget of all tokens every document is read exactly once."""
    rows = [(k, "w " * 1500, f"big{k % 2}") for k in range(1800)] + [(9000, "one", "tiny"), (9001, "two words", "small")]
    _, reads = mixture(spark, rows, target_entropy=None, max_repeats=None)
    assert sorted(r.doc_id for r in reads) == sorted(r[0] for r in rows) and {r.copy for r in reads} == {0}


def test_quotas_add_up_to_the_budget(spark):
    df = spark.createDataFrame([("a", 333, 1000), ("b", 333, 1000), ("c", 334, 1000), ("d", 0, 1000)], "source string, weight long, budget long")
    for budget in (0, 1, 7, 1000, 10 ** 13 + 1):
        got = {r.source: r.quota for r in largest_remainders(df.withColumn("budget", F.lit(budget).cast("long"))).collect()}
        assert sum(got.values()) == budget and all(abs(got[s] - budget * w / 1000) < 1 for s, w in (("a", 333), ("b", 333), ("c", 334), ("d", 0)))
    assert {r.source: r.quota for r in largest_remainders(df.withColumn("budget", F.lit(2).cast("long"))).collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}


def test_a_repeated_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(k % 3, f"good words of number {j}" if k % 3 else f"BAD | # {j}", 20) for j in range(400) for k in range(3)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    machine = fm.train(docs, labels)
    again = fm.train(docs.repartition(7), labels)
    assert np.allclose(machine.linear, again.linear) and np.isfinite(machine.linear).all()
    stats = rules.text_statistics(docs)
    assert rules.learn_rules(stats, labels) == rules.learn_rules(rules.text_statistics(docs.repartition(5)), labels)


def test_vectors_that_share_a_direction_are_nearly_all_found(spark):
    """Passes are meant for vectors that point everywhere; with a mean cosine near
    0.8 almost all links are found still."""
    rng = np.random.default_rng(6)
    n, d = 3000, 32
    x = rng.normal(size=(n, d)) * 0.5 + rng.normal(size=d) * 0.95
    x[n // 2:] = x[:n // 2] + rng.normal(size=(n // 2, d)) * 0.28
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, 0)
    want = (c >= 0.93).sum(1)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = np.zeros(n)
    for r in near_vectors(df).collect():
        got[r.vec_id] = r.n_links
    assert (u @ u.mean(0)).mean() > 0.7 and want.sum() > 1000
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
