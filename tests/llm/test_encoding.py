import base64
import random
from pathlib import Path

import pytest
import tiktoken

from gridloom.llm.encoding import PRE_TOKEN, TOKENIZERS, ByteBpe, count_tokens, decode_corpus, encode_corpus, read_ranks, serialise_model

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no vocabularies")

TEXTS = [None, "", " ", "\n\n  \n", "a", "It's  we'll see\tthe end. \r\n", "Straße 12½ — «été»", "日本語のテキスト", "😀😀 é", "x" * 30_000, " \x1c; \x1f ", "<|endoftext|>", "�​"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("oracle", pat_str=PRE_TOKEN, mergeable_ranks=read_ranks(), special_tokens={})


def test_ids_equal_the_public_encoder(oracle):
    bpe = ByteBpe(serialise_model(read_ranks()))
    rng = random.Random(0)
    letters = list("ab \n\t\r \xa0\x1c\x85　'sll12½é漢😀�ß́-_.,¬") + ["'s", "  ", "\n\n"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode_batch(texts)):
        assert ids == oracle.encode_ordinary(text)
        assert bpe.decode(ids) == text
    assert bpe.count_batch(texts) == [len(oracle.encode_ordinary(t)) for t in texts]


def test_memory_is_bounded(monkeypatch, oracle):
    monkeypatch.setattr("gridloom.llm.encoding.REMEMBERED", 3)
    bpe = ByteBpe(serialise_model(read_ranks()))
    for k in range(20):
        assert bpe.encode(f"word{k} other{k} x") == oracle.encode_ordinary(f"word{k} other{k} x")
    assert len(bpe._ids) < 10


def test_corpus(spark, oracle):
    rows = [(None if k == 3 else k % 11, t, "clash", 1) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(3)
    out = encode_corpus(docs).collect()
    want = sorted(((r[0] is None, r[0] or 0, oracle.encode_ordinary(r[1] or "")) for r in rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in out) == want
    assert sorted(r["text"] for r in decode_corpus(encode_corpus(docs)).collect()) == sorted(t or "" for t in TEXTS)
    assert sum(r["n_tokens"] for r in count_tokens(docs).collect()) == sum(len(w[2]) for w in want)
    assert encode_corpus(docs.limit(0)).count() == 0


def test_ranks_need_to_be_whole(tmp_path):
    (tmp_path / "v.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ((b"a", 0), (b"b", 2))))
    with pytest.raises(ValueError):
        serialise_model(read_ranks("v", str(tmp_path)))
