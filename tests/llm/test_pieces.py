import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from riskloom.llm import pieces
from riskloom.llm.queries import Q

from ..conftest import SF_SMALL
from .data import odd_docs, read
from .test_tokens import ODD as ODD_TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*ODD_TEXTS, "<s>a</s> <unk> <0x41>", "▁▁a▁ ▁b", " " * 33 + "x" + " " * 400, "y" * 9000, "ab" * 3000 + " " + "a" * 65 + " " + "a" * 64, " 　 ﻿", "a\nb\n\n c"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_encodes_and_decodes_as_the_library(library):
    model = pieces.PieceBPE(PATH)
    for got, want in zip(model.encode(ODD), library.encode(ODD)):
        assert got.tolist() == want
        assert model.decode(got) == library.decode(want)


def test_decodes_any_ids(library):
    """Bytes that are no UTF-8, unknown and control pieces."""
    model, rnd = pieces.PieceBPE(PATH), random.Random(5)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randrange(12))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_long_chunks_merge_as_short_ones(monkeypatch):
    model, rnd = pieces.PieceBPE(PATH), random.Random(6)
    words = ["▁" * rnd.randrange(3) + "".join(rnd.choice("aeinrst▁"[:-1]) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    ids, count = model.segment(words)
    monkeypatch.setattr(pieces, "SHORT", 3)
    again, same = model.segment(words)
    assert ids.tolist() == again.tolist() and count.tolist() == same.tolist()


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    model, asked = pieces.PieceBPE(PATH), []
    segment = model.segment
    monkeypatch.setattr(model, "segment", lambda chunks: asked.extend(chunks) or segment(chunks))
    model.encode(["one two two", "two one  three"])
    model.encode(["three four one"])
    assert sorted(asked) == sorted(set(asked)) and set(asked) == {"▁one", "▁two", "▁▁three", "▁three", "▁four"}
    monkeypatch.setattr(pieces, "CHUNKS_KEPT", 1)  # the table starts anew
    assert model.encode(["one two"])[0].tolist() == model.library.encode("one two")
    assert len(model.row) == 2


def test_odd_rows(spark, library):
    docs = odd_docs(spark)
    want = sorted(library.encode(r.text or "") for r in docs.collect())
    ids = pieces.encode_documents(docs, PATH)
    assert ids.columns == ["doc_id", "ids"] and sorted(r.ids for r in ids.collect()) == want
    back = pieces.decode_documents(ids, PATH)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.collect())
    assert pieces.round_trip_digests(docs, PATH).count() == docs.count()
    for f in (pieces.encode_documents, pieces.round_trip_digests):
        assert f(odd_docs(spark, []), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [450, None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_documents(nulls, PATH).collect()} == {1: "", None: library.decode([450])}


def test_query(spark, library):
    docs = read(SF_SMALL, "documents")
    rows = {r.doc_id: r for r in Q["op13_sentencepiece"](spark, SF_SMALL).collect()}
    assert len(rows) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
