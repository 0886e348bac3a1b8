import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from faultlens.llm import bpe, tokens
from faultlens.llm.queries import QUERIES, multi_bpe

PATH, PATTERN = multi_bpe()
RANKS = bpe.read_ranks(PATH)
ODD = ["", None, " ", "  ", "a  b ", "\n x", "a \n\n b\t", "don't I'll we've", "<|endoftext|> c", "　 　x  y", "1234567 89,5", "😀🇩🇪 é́ 漢字かな",
       "\x1c\x1d x\x85y z", "a" * 3000, "ab" * 2000, "\x00\x01", "الْعَرَبِيَّة हिन्दी", " " * 700 + "x", "=" * 90 + "->", "'S 'T're"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = " \n\tabcdeinst'é1.　ñßА漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(n)]


def plain(piece, ranks):
    """The rule itself: merge the leftmost pair of lowest rank, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k:k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_segment_tree_against_the_plain_rule():
    rng = random.Random(1)
    small = {bytes([b]): b for b in range(256)}
    for token in ("aa", "ab", "ba", "aab", "abab", "bb", "aaaa", "abb"):
        small[token.encode()] = len(small)
    for _ in range(2000):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40)))
        assert bpe.merge_piece(piece, small) == plain(piece, small)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(80))) for _ in range(6000)]  # side by side
    assert bpe.Merger(small)(pieces) == [tuple(plain(p, small)) if p else () for p in pieces]
    for text in random_texts(60, 2):
        assert bpe.merge_piece(text.encode(), RANKS) == (plain(text.encode(), RANKS) if text else [])


def test_ids_equal_the_library(library, monkeypatch):
    texts = [t or "" for t in ODD] + random_texts(400, 3)
    for space_led in (True, False):
        encode = bpe.TextIds(PATH, PATTERN, space_led)
        for _ in range(2):  # fresh, and from what is known
            assert [x.tolist() for x in encode.rows(bpe.pa.array(texts))] == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "PIECES", 50)  # long texts in parts, and a table of units that fills up
    monkeypatch.setattr(tokens, "KNOWN_UNITS", 40)
    encode = bpe.TextIds(PATH, PATTERN)
    assert [x.tolist() for x in encode.rows(bpe.pa.array(texts))] == [library.encode_ordinary(t) for t in texts]


def test_one_very_long_piece(library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefé漢") for _ in range(60_000))
    assert next(bpe.TextIds(PATH, PATTERN).rows(bpe.pa.array([text]))).tolist() == library.encode_ordinary(text)


def test_every_token_decodes():
    ids = sorted(RANKS.values())
    data, ends = bpe.Decoder(PATH)(bpe.np.array(ids))
    assert data == b"".join(t for t, _ in sorted(RANKS.items(), key=lambda x: x[1])) and ends[-1] == len(data)


def test_round_trip_of_odd_rows(spark, library):
    rows = [(None, "x y", 1), (5, "same", 2), (5, "same", 2), *((100 + k, t, k) for k, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    ids = bpe.encode_documents(docs, PATH, PATTERN)
    got = bpe.decode_documents(ids, PATH).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0), PATH, PATTERN), PATH).collect() == []


def test_ids_that_are_no_tokens(spark):
    rows = [("a", [72, 73]), ("b", [72, 60000]), ("c", [-1]), ("d", None), ("e", []), ("f", [72, None])]
    got = dict((r.decoded, r.out) for r in bpe.decode_documents(
        spark.createDataFrame(rows, "decoded string, n array<int>").selectExpr("decoded AS k", "n"), PATH, "n").selectExpr("k AS decoded", "decoded AS out").collect())
    back = {v: k for k, v in RANKS.items()}
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == {"a": back[72] + back[73], "b": None, "c": None, "d": None, "e": b"", "f": None}


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_bpe_encoding"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and public_tokenizers.path("byte_bpe_multi_50k.tiktoken") == PATH
    for d in docs:
        ids, r = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
