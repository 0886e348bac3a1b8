import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultlens.llm.packing import differencing, pack, pack_documents
from faultlens.llm.tokens import TokenIds
from faultlens.llm.words import Powers, word_hashes, text_slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " a", "a ", "b", " ", "", None, "\n x", "a \nb", "<|endoftext|> c's 'S  \t  x", "　 x  y", "a　 　b", "😀 é́ x", "x" * 5000]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tabc'é1. 　 the and s ") for _ in range(rng.randrange(200))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_ids_equal_the_tokenizer(reference):
    texts = ODD + random_texts(800, 1)
    got = TokenIds(PATH)
    for _ in range(2):  # fresh, and from the table of known units
        assert [x.tolist() for x in got.rows(pa.array(texts))] == [reference(t) for t in texts]


def test_word_fingerprints_tell_words_apart():
    texts = ODD + random_texts(200, 2)
    seen = {}
    for first, data, offsets in text_slices(pa.array(texts)):
        hashes, at = word_hashes(data, offsets, Powers())
        for k in range(len(offsets) - 1):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[first + k] or ""))
            assert at[k + 1] - at[k] == len(words)
            for w, h in zip(words, hashes[at[k]:at[k + 1]].tolist()):
                assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_differencing_is_a_balanced_partition():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 129) for _ in range(300)]
    parts = differencing(sizes, 20)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 2


def test_window_count_rises_until_all_fit():
    assert sorted(sorted(p) for p in pack([6, 6, 6], 10)) == [[0], [1], [2]]  # 2 windows would do by size alone
    assert pack([], 10) == []


def check_packing(rows, reference, capacity, documents):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for window in by_window.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    for doc_id, text in documents:
        ids, at = np.array([*reference(text), 0], "<u4"), 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return by_window


def test_packing_round_trip(spark, reference):
    texts = ODD + random_texts(300, 3) + [" ".join(random_texts(60, 4))]
    documents = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in documents], "doc_id long, text string, start int, length string").repartition(3)
    windows = check_packing(pack_documents(docs, PATH).collect(), reference, 1024, documents)
    total = sum(len(reference(t)) + 1 for t in texts)
    assert len(windows) <= total // 1024 + 3 + 3  # at most a window more in each partition


def test_packing_of_corpus_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) / (1024 * len(fill)) > 0.985


def test_null_ids_repeats_and_empty_table(spark, reference):
    docs = spark.createDataFrame([(None, "x y"), (1, None), (2, "same"), (2, "same")], "doc_id long, text string")
    rows = pack_documents(docs, PATH).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows) == {(None, 3): 1, (1, 1): 1, (2, 2): 2}
    assert pack_documents(docs.limit(0), PATH).collect() == []
