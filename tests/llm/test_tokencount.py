"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
import sentencepiece

from tracewright.llm import tokencount
from tracewright.llm.tokencount import Splitter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_split_adds_up(model):
    split, rng = Splitter(PATH), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "é", "日本", "▁", "<s>", "</s>", "<0x0A>", "0", "42", "\x00", "\U0001f600", "　", "\xa0", ".", "Zürich", "ing", "tion", "ﬁ", "    "]
    texts = ["", " ", "\n", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(2000))]
    for text in texts:
        tokens = [t for window in split.tokens(text) for t in window]
        assert sum(split.lengths(tokens)) == len(model.encode(text)), repr(text)


def test_windows_end_where_pretokens_do(model, monkeypatch):
    monkeypatch.setattr(tokencount, "WINDOW", 7)
    split, rng = Splitter(PATH), random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab ▁\n1é日", k=rng.randrange(60)))
        assert sum(sum(split.lengths(w)) for w in split.tokens(text)) == len(model.encode(text)), repr(text)


@pytest.mark.parametrize("frequent", [50_000, 3, 0])
def test_counts_equal_library(spark, model, frequent):
    rng = random.Random(5)
    words = ["alpha", "beta", "of", "<s>", "straße", "été", "12", "\n", "日本語", ""]
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=rng.randrange(200))) for _ in range(80)), "x" * 3000, "long words " * 30_000]
    rows = [(i if i != 5 else None, t, "z", 1) for i, t in enumerate(texts)] + [(7, texts[7], "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, n int").repartition(3)
    found = sorted(map(tuple, count_tokens(df, PATH, 100, frequent=frequent).collect()), key=str)
    expected = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t, _, _ in rows), key=str)
    assert found == expected


def test_empty_table_and_bounded_counting(spark, model, monkeypatch):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert count_tokens(empty, PATH).collect() == []
    assert dict(count_tokens(empty, PATH).dtypes)["doc_id"] == "string"
    monkeypatch.setattr(tokencount, "CACHED", 4)
    monkeypatch.setattr(tokencount, "COUNTED", 8)
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(50)) + " the the the" * 40, "the cat the dog"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["doc_id", "text"])
    best = next(tokencount._report(PATH)(iter([batch])))
    assert best.column("token")[0].as_py() == "▁the"

    class Held:
        value = tokencount._pack(["▁the"], tokencount.splitter(PATH))

    out = next(tokencount._count(PATH, Held, 4096)(iter([batch])))
    assert out.column("n_tokens").to_pylist() == [len(model.encode(t)) for t in texts]
    assert len(tokencount._CACHES[PATH]) <= 200
