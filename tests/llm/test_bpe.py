import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tracewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    alphabet = "abcdefghij ABC  \n\t.,'é漢字🙂0123456789"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 200))) for _ in range(300)]
    return made + ["", " ", "\n\n\n   x", "a" * 3000, "ab" * 1500, "thethethe" * 400, "<|endoftext|>", "it's we'll", "\u0000\u0001", "!" * 700]


def test_ids_equal_the_library_and_decode_back(reference):
    coder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rows = texts()
    ids, bounds = coder.encode(rows)
    for t, a, b, raw in zip(rows, bounds[:-1], bounds[1:], coder.decode(ids, bounds), strict=True):
        assert ids[a:b].tolist() == reference.encode_ordinary(t)
        assert raw == t.encode()


def test_matrix_and_heap_agree():
    coder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rnd = random.Random(3)
    made = ["".join(rnd.choice("thein rga") for _ in range(rnd.randrange(2, 200))).encode() for _ in range(200)]
    for ids, m in zip(coder._merge_matrix(made), made, strict=True):
        assert ids.tolist() == coder._merge_long(m).tolist()


def test_query_rows(spark, reference):
    rows = [(1, "the cat"), (2, None), (3, ""), (3, ""), (None, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'a' AS n_tokens")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.raw) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_match_is_not_quadratic():
    coder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    began = time.time()
    coder.encode(["ab" * 50_000])
    assert time.time() - began < 20


def test_flat_merges_equal_the_heap():
    coder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rnd = random.Random(4)
    made = [bytes(rnd.choice(b"thein rga\xc3\xa9") for _ in range(n)) for n in [*range(300), 256, 257, 1, 2, 3]]
    ids, length = coder.merge_flat(made)
    want = [[coder.ranks[m]] if m in coder.ranks else coder._merge_long(m).tolist() for m in made]
    assert ids.tolist() == [i for x in want for i in x] and length.tolist() == [len(x) for x in want]
