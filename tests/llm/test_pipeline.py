"""The pipeline's stages against brute force, and its handling of odd rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import quality

from ..conftest import SF_SMALL
from .data import odd_docs, read
from .test_line_dedup import brute as brute_lines
from .test_passages import brute_passages
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    out, docs = {}, spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()))


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    columns = stages["quality"][0].columns
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "bpe")


def test_quality_drops_what_it_rejects(spark, stages):
    before, after = stages["quality"]
    votes = quality.fit(before, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    scores = {r.id: r.score for r in quality.score(before, votes).collect()}
    assert {r[0] for r in rows(after)} == {i for i, s in scores.items() if s >= 0.5}
    assert set(rows(after)) <= set(rows(before))
    labels = read(SF_SMALL, "labels").set_index("doc_id").quality
    kept = {r[0] for r in rows(after)}
    assert np.mean([i in kept for i in labels.index[labels == 1]]) > 0.97


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    assert rows(after) == sorted((i, t) for i, t, _, _ in brute_lines(rows(before)))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    own = rows(before)
    least = brute_components([i for i, _ in own], [brute_fingerprint(t) for _, t in own])
    assert rows(after) == [r for r, c in zip(own, least) if r[0] == c]


def test_decontaminate(stages):
    before, after = stages["decontaminate"]
    items = read(SF_SMALL, "benchmark")
    found = brute_passages(rows(before), list(zip(items.item_id, items.text)), 10)
    hit = {i for i, _, n, _ in found if n}
    assert hit and rows(after) == [r for r in rows(before) if r[0] not in hit]


def test_bpe(stages):
    before, after = stages["bpe"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows(before):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()} == want


def test_run_is_all_stages(spark, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect()))
    assert got == sorted(map(tuple, stages["bpe"][1].collect()))


def test_written_run_leaves_no_tables(spark, stages, tmp_path):
    import os

    from riskloom.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.write(spark, SF_SMALL, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, stages["bpe"][1].collect()))
    assert not [n for n in set(os.listdir(folder)) - before if n.startswith("run-")]


def test_empty_tables(spark):
    docs = odd_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0


def test_odd_rows(spark):
    """Each stage on rows with null and repeated ids, null and empty texts, repeated rows and clashing columns."""
    docs = odd_docs(spark)
    own = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_SMALL)
        if name != "bpe":
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        out[name] = after.collect()
    pairs = {n: sorted(((r.doc_id, r.text) for r in rs), key=str) for n, rs in out.items() if n != "bpe"}
    votes = quality.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    assert pairs["quality"] == sorted(((r.row.doc_id, r.text) for r in quality.score(docs, votes).collect() if r.score >= 0.5), key=str)
    assert pairs["line_dedup"] == sorted(((i, t) for i, t, _, _ in brute_lines(own)), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out["line_dedup"])
    fps = [brute_fingerprint(t) for _, t in own]
    label = brute_components(range(len(own)), fps)
    least = [min((((-(1 << 63) if own[k][0] is None else own[k][0]), own[k][1] or "") for k in range(len(own)) if label[k] == c)) for c in set(label)]
    assert sorted((-(1 << 63) if i is None else i, t or "") for i, t in pairs["near_dedup"]) == sorted(least)
    items = read(SF_SMALL, "benchmark")
    hit = {t for t in {t for _, t in own} for _, _, n, _ in brute_passages([(0, t)], list(zip(items.item_id, items.text)), 10) if n}
    assert pairs["decontaminate"] == [r for r in own if r[1] not in hit]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((str(r.doc_id), r.n_tokens) for r in out["bpe"]) == sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in own)
