import hashlib
import random

import numpy as np
import pyarrow as pa

from riskloom.llm import fingerprints
from riskloom.llm.fingerprints import edit_fingerprints, likeness, near_duplicate_classes, signatures
from riskloom.llm.queries import Q

from ..conftest import SF_SMALL
from .data import ASCII_LOWER, odd_docs, order, plain_docs, read, words


def jaccard(a, b, k=5):
    def sets(t):
        w = words((t or "").translate(ASCII_LOWER))
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(texts):
    return [t[:len(t) - len(t) // 4] + u[:len(t) // 4] for t, u in zip(texts, texts[1:] + texts[:1])]


def test_query_on_documents(spark, monkeypatch):
    docs = read(SF_SMALL, "documents").sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    for batch in (2_000, 13):
        monkeypatch.setattr(fingerprints, "ROWS_PER_BATCH", batch)
        got = Q["op6_document_fingerprints"](spark, SF_SMALL).toPandas().sort_values("doc_id")
        assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_chars.tolist() == [len(t) for t in texts]
        edited = edits(texts)
        assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        for column, others in (("near_edited", edited), ("near_next", texts[1:] + texts[:1])):
            error = got[column].to_numpy() - np.array([jaccard(a, b) for a, b in zip(texts, others)])
            assert abs(error).max() < 0.25 and abs(error.mean()) < 0.02
        assert got.groupby(texts).fingerprint.nunique().max() == 1
        own = dict(zip(texts, got.fingerprint))
        assert all(own[e] == f for e, f in zip(edited, got.edited_fingerprint) if e in own)


def test_odd_rows_and_tiny_batches(spark, monkeypatch):
    for batch in (2_000, 2):
        monkeypatch.setattr(fingerprints, "ROWS_PER_BATCH", batch)
        docs = odd_docs(spark)
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (order(r[0]), r[1]))
        want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(rows, edits([t for _, t in rows])))
        got = edit_fingerprints(docs).collect()
        assert sorted((str(r.row.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edit_fingerprints(odd_docs(spark, [])).count() == 0
    (alone,) = edit_fingerprints(odd_docs(spark, [(1, "just one text of a few words more")])).collect()
    assert alone.near_next == 1.0


def test_signatures():
    s = signatures(pa.array(["a b c d e f", "A B c d e f", "a b", "a b", "b a", "", None, "x"]))
    assert (s[0] == s[1]).all() and (s[2] == s[3]).all() and likeness(s[2:3], s[4:5])[0] < 0.1
    assert (s[5] == 0xFFFF).all() and (s[6] == 0xFFFF).all()


def brute_classes(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d, key=order) if find(i) in least else d
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited_copies(n):
    """Chains of texts of 60 words, each a few words from the last."""
    rnd = random.Random(4)
    out = []
    for c in range(n):
        w = [f"w{rnd.randrange(10 ** 6)}" for _ in range(60)]
        for i in range(rnd.choice([1, 2, 12])):
            out.append((c * 100 + i, " ".join(w)))
            w[rnd.randrange(60)] = f"e{rnd.randrange(10 ** 6)}"
    return out


def test_near_duplicate_classes(spark, monkeypatch):
    rows = edited_copies(14) + [(9000, ""), (9001, None), (9002, "  "), (9003, "two words"), (9004, "Two WORDS"), (9003, "two words"), (None, "two words")]
    for block in (4_000, 3):
        monkeypatch.setattr(fingerprints, "BUCKET_BLOCK", block)
        got = near_duplicate_classes(plain_docs(spark, rows)).collect()
        null = -(1 << 63)
        assert sorted(((None if r.id == null else r.id, None if r.class_id == null else r.class_id) for r in got), key=str) == brute_classes(rows)
    assert near_duplicate_classes(odd_docs(spark, [])).count() == 0
