"""Words, parts, chunks and shingles are told apart by bytes: structured words, and a hash of few values."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnwick.llm import lm_scores, near_dups, packing, pieces, subwords, textbuf


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def spans(texts):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return raw, ends - np.array([len(t) for t in texts]), ends


@pytest.fixture
def few_hashes(monkeypatch):
    """Every hash of a span is one of four."""
    whole = textbuf._hash
    monkeypatch.setattr(textbuf, "_hash", lambda *a: whole(*a) & np.uint64(3))


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_words_hash_apart(n):
    a, b = thue_morse(n)
    raw, start, end = spans([a.encode(), b.encode(), a.encode(), (a[8:] + a[:8]).encode(), b"\0" * n, b"\0" * (n - 8)])
    for second in (False, True):
        h = textbuf.hashes(raw, start, end, second=second)
        assert h[0] == h[2] and len(set(h.tolist())) == 5
        assert (h == textbuf.hashes(raw, start, end, at_once=100, second=second)).all()


def test_spans_by_bytes(few_hashes):
    r = np.random.default_rng(0)
    texts = [bytes(r.choice(list(b"ab\0"), int(k))) for k in r.integers(1, 20, 3000)]
    kind = r.integers(0, 2, 3000).astype(bool)
    for kinds in (None, kind):
        for at_once in (1 << 22, 256):
            one, number, times = textbuf.distinct(*spans(texts), kinds, at_once=at_once)
            key = [(t, k) for t, k in zip(texts, kind.tolist() if kinds is not None else [0] * 3000)]
            assert len(one) == len(set(key)) and [key[one[n]] for n in number] == key
            assert times.tolist() == np.bincount(number).tolist()


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_on_structured_words(spark, n):
    a, b = thue_morse(n)
    table = docs(spark, [a, b, f"{a} {b}", f"{b} {a}"])
    near = near_dups.near_duplicates(table).toPandas().set_index("doc_id")
    assert near.component_id.to_dict() == {1: 1, 2: 2, 3: 3, 4: 4}
    tok = Tokenizer.from_file(subwords.tokenizer_path())
    packed = packing.pack_documents(table).toPandas().set_index("doc_id")
    want = [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in (a, b, f"{a} {b}", f"{b} {a}")]
    assert [packed.ids_crc32[i] for i in (1, 2, 3, 4)] == want and want[0] != want[1]
    back = pieces.decode(pieces.encode(table, keep=("doc_id", "text"))).toPandas()
    assert (back.text.str.encode("utf-8") == back.decoded.map(bytes)).all()
    corpus = lm_scores.read_corpus(docs(spark, [a] * 3 + [b], 1)).cache()
    kinds = corpus.where(f"kind = {lm_scores.WORD}").select("word").distinct().count()
    assert kinds == 2


def test_kernels_with_few_hashes(few_hashes):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdeé.,"), int(k))) for k in r.integers(1, 12, 400)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(40)]
    tok = Tokenizer.from_file(subwords.tokenizer_path())
    encoder = subwords.Encoder()
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.texts([t.encode() for t in texts])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    model = pieces.Model()
    for dropout in (0.0, 0.3):
        one = pieces.Encoder(model, dropout, 7)
        for part in (texts[:20], texts[20:], texts):  # chunks of earlier calls are found by their bytes
            for t, ids in zip(part, one.texts([t.encode() for t in part], list(range(len(part)))), strict=True):
                assert model.decode(np.frombuffer(ids, "<u4").tolist()).decode() == t


def test_blocks_of_words_with_few_hashes(few_hashes):
    block = lm_scores._Block()
    texts = ["a bb a ccc", "bb d e f g h a", "i j k l m n o a"]
    for text in texts:
        raw, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        block.add(pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "held_out": pa.array([False]), "learn": pa.array([True])}), raw, off)
    rows = [r for batch in block.close(0) for r in batch.to_pylist()]
    words = {r["number"]: (r["word"], r["n"]) for r in rows if r["kind"] == lm_scores.WORD}
    back = [b" ".join(words[k][0] for k in lm_scores._numbers(r["numbers"]).tolist()).decode() for r in rows if r["kind"] == lm_scores.TEXT]
    assert back == texts and words[0] == (b"a", 4)
