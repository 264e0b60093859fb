import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe, token_counts
from riskloom.llm.queries import Q

from ..conftest import SF_SMALL
from .data import odd_docs, read

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
rnd = random.Random(11)
ODD = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaaaaaaaa", "  \n\n  x \x85   y\x1c\x1dz　  ok", "é İ ΣΑΣ ß ǅ",
       "=" * 5001 + " " * 77 + "\t" * 9, "can't I'LL we've 'S", "\x00\x01"] + \
      ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x300, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(120)) for _ in range(60)]


def lib(path):
    return Tokenizer.from_file(path)


def test_bpe_matches_the_library_on_odd_texts():
    mine, theirs = bpe.ByteBPE(BYTE), lib(BYTE)
    for got, want in zip(mine.encode(ODD), theirs.encode_batch(ODD, add_special_tokens=False)):
        assert got.tolist() == want.ids
        assert mine.decode(got) == theirs.decode(want.ids, skip_special_tokens=False)
    for _ in range(50):  # ids that are no valid UTF-8
        ids = [rnd.randrange(50257) for _ in range(30)]
        assert mine.decode(np.array(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_store_can_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    mine, theirs = bpe.ByteBPE(BYTE), lib(BYTE)
    for text in ("some words here and there", "other words in another text", "some words again"):
        assert mine.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_counter_matches_the_library_on_odd_texts():
    assert token_counts.Counter(WORD)(ODD) == [len(e) for e in lib(WORD).encode_batch(ODD, add_special_tokens=False)]
    assert token_counts.Counter(BYTE)(ODD) == [len(e) for e in lib(BYTE).encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["op2_token_counts", "op3_bpe"])
def test_queries(spark, name):
    docs = read(SF_SMALL, "documents")
    path = WORD if name == "op2_token_counts" else BYTE
    tok = lib(path)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in zip(docs.doc_id, docs.text)}
    text = dict(zip(docs.doc_id, docs.text))
    rows = Q[name](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(want[r.doc_id])
        if name == "op2_token_counts":
            assert r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)
        else:
            assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    texts = sorted((t or "" for _, t in ((r.doc_id, r.text) for r in docs.collect())))
    counts = sorted(len(e) for e in lib(WORD).encode_batch(texts, add_special_tokens=False))
    got = token_counts.count_tokens(docs, WORD).collect()
    assert sorted(r.n_tokens for r in got) == counts and sorted(r.n_bytes for r in got) == sorted(len(t.encode()) for t in texts)
    ids = bpe.encode_documents(docs, BYTE).collect()
    assert sorted(r.ids for r in ids) == sorted(e.ids for e in lib(BYTE).encode_batch(texts, add_special_tokens=False))
    assert bpe.round_trip_digests(docs, BYTE).count() == docs.count()
    for f in (lambda d: token_counts.count_tokens(d, WORD), lambda d: bpe.encode_documents(d, BYTE), lambda d: bpe.round_trip_digests(d, BYTE)):
        assert f(odd_docs(spark, [])).count() == 0


def test_the_cache_is_used_extended_and_shared(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = odd_docs(spark, [(1, "some words"), (2, "some  \n words"), (3, None)])
    token_counts.count_tokens(first, WORD, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2  # one for both spellings of the same content, one for the empty text
    both = odd_docs(spark, [(1, "some words"), (4, "new words")])
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(both, WORD, cache).collect()} == {1: 2, 4: 2}
    assert spark.read.parquet(cache).count() == 3
    token_counts.count_tokens(both, BYTE, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    # what is stored is what is returned
    path = str(tmp_path / "other")
    key = both.where("doc_id = 1").select(token_counts.text_digest(token_counts.one_space(both["text"])).alias("key")).first()["key"]
    spark.createDataFrame([(key, token_counts.tokenizer_version(WORD), 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(both, WORD, path).collect()} == {1: 77, 4: 2}
