import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import oracle_check
from faultlens.llm import merkle
from faultlens.llm.queries import ORACLES, QUERIES

NAME = "op12_merkle_manifest"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def climb(tree, k, digest):
    """Siblings of leaf ``k`` and the root that ``digest`` in its place gives."""
    proof = []
    for level in tree[:-1]:
        other = level[k ^ 1:(k ^ 1) + 1]
        proof += other
        digest = sha(*((other + [digest]) if k % 2 else ([digest] + other)))
        k //= 2
    return proof, digest


def brute(rows):
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([leaf_of(r) for r in trees[t]]) for t in names}
    top = levels([built[t][-1][0] for t in names])
    out = []
    for j, t in enumerate(names):
        for k, row in enumerate(trees[t]):
            change = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            offered = leaf_of((*row[:3], row[3] + 1, row[4])) if change else leaf_of(row)
            proof, at = climb(built[t], k, offered)
            above, at = climb(top, j, at)
            out.append((row[0], leaf_of(row), built[t][-1][0], top[-1][0], sha(*proof, *above), at, at == top[-1][0]))
    return sorted(out, key=repr)


def answer(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"idx": F.lit(1), "n": F.lit("x"), "tree": F.lit(None).cast("int")})
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES[NAME](spark, str(folder)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 20 + ["de", "fr", "é", "Z", None, ""]
    return [(k, rng.choice(["s1", None, "s:2"]), rng.choice(langs), rng.choice([None, 5, 12345]), rng.choice([None, "", "é" * 30, f"text {k}"])) for k in range(n)]


@pytest.mark.parametrize("bits", [2, 10])
def test_blocks_and_jumps_of_any_size(spark, tmp_path, monkeypatch, bits):
    """With four nodes to a block there are many passes and copied ancestors."""
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = corpus(700, 1)
    assert answer(spark, rows, tmp_path / "d") == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_trees(spark, tmp_path, n):
    rows = [(k, "s", "en", 1, "t") for k in range(n)]
    assert answer(spark, rows, tmp_path / "d") == brute(rows)


def test_nulls_repeats_and_long_values(spark, tmp_path):
    rows = [(7, "s", "en", 1, "t")] * 40 + [(7, "s", "en", 1, "u")] * 3 + [(None, None, None, None, None)] * 5 + [(None, "x", "en", 2, "")]
    rows += [(9, "s", None, 3, "word " * 200_000), (-4, "", "", 0, "")] + [(k, "s", f"l{k}", k, "t") for k in range(20, 60)]
    assert answer(spark, rows, tmp_path / "d") == brute(rows)


def test_empty_table(spark, tmp_path):
    assert answer(spark, [], tmp_path / "d") == []


def test_general_interface_proves_and_refutes(spark):
    docs = spark.createDataFrame([(k, f"v{k}", "a" if k % 3 else "b") for k in range(50)], "key int, value string, part string")
    rows = merkle.manifest(docs, ["key", "value"], "part", "key", {"key": F.col("key")})
    right = merkle.verified(rows, F.col("leaf")).collect()
    wrong = merkle.verified(rows, merkle.leaf_digest([F.col("key"), F.lit("other")])).collect()
    assert len(right) == 50 and all(r.verified for r in right) and not any(r.verified for r in wrong)
    assert len({r.root for r in right}) == 1 and len({r.subroot for r in right}) == 2


def test_oracle_at_several_blocks(spark):
    sf = "/root/testdata/sf0.1"  # English alone fills several blocks
    r = oracle_check.compare(spark, oracle_check.duck(sf), NAME, QUERIES[NAME], ORACLES[NAME], sf)
    assert r["ok"], r
