import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import spelling as S

from .data import ASCII_LOWER, odd_docs, plain_docs


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts, ratio=5):
    """word -> (n, n_near, form, form_n, root)."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] is not None else None, root)
    return out


def brute_counts(rows, every, least_length=6, least_count=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def grouped(spark, counts):
    df = spark.createDataFrame([(w, n, 0, 0) for w, n in counts.items()], "word string, n long, key long, root int").repartition(3)
    rows = S.group_variants(df).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def vocabulary(seed, letters="abcdé", n=150):
    rnd, out = random.Random(seed), {}
    while len(out) < n:
        out["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7)))] = rnd.choice([1, 5, 5, 25, 130, 700])
    return out


@pytest.mark.parametrize("hot", [1000, 1, 3])
def test_groups_match_brute_force(spark, monkeypatch, hot):
    """With hot reduced words, their words take the finer alphabet."""
    monkeypatch.setattr(S, "HOT_WORDS", hot)
    counts = vocabulary(7)
    want = brute_groups(counts)
    assert sum(v[2] is not None for v in want.values()) > 20 and any(want[v[2]][2] for v in want.values() if v[2])  # chains too
    assert grouped(spark, counts) == want


def test_long_and_odd_words(spark):
    long = "kangaroo" * 700
    counts = {long: 100, long[:3000] + long[3001:]: 10, long + "x": 1, "": 9, "a": 60, "ab": 2, "\U0001d4b3ab": 1, "\U0001d4b3b": 40, "word\u0000": 5, "word": 30}
    assert grouped(spark, counts) == brute_groups(counts)
    assert grouped(spark, {}) == {}


def test_counts_match_brute_force(spark):
    rnd = random.Random(2)
    words = ["elephant", "Elephant", "ELEPHANTS", "élan", "Äpfelchen", "äpfelchen", "don't", "giraffes", "œuvres", "naïveté", "x" * 40, "short"]
    rows = [(i if i % 7 else None, " ".join(rnd.choice(words) for _ in range(30))) for i in range(120)] + [(500, None), (501, ""), (501, "elephant")]
    got = S.count_words(plain_docs(spark, rows), S.drop_letter(3))
    assert {r.word: r.n for r in got.collect()} == brute_counts(rows, 3)
    plain = S.count_words(plain_docs(spark, rows), least_length=4, least_count=2)
    assert {r.word: r.n for r in plain.collect()} == brute_counts(rows, 1 << 40, 4, 2)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = S.count_words(docs, S.drop_letter(2), 3, 1)
    want = brute_counts(rows, 2, 3, 1)
    assert {r.word: r.n for r in words.collect()} == want
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.group_variants(words).collect()} == brute_groups(want)
    assert S.group_variants(S.count_words(odd_docs(spark, []))).count() == 0


def test_neighbourhoods_are_full_and_distinct():
    rnd = random.Random(3)
    for alphabet in (S.COARSE, S.FINE):
        for n in (0, 1, 2, 6):
            s = np.array([[rnd.randrange(3 if rnd.random() < 0.5 else alphabet) for _ in range(n)] for _ in range(6)], np.uint64).reshape(6, n)
            row, near = S.neighbours(s, alphabet)
            for i in range(6):
                r = tuple(s[i].tolist())
                want = {r} | {r[:j] + r[j + 1:] for j in range(n)} | {r[:j] + (x,) + r[j + 1:] for j in range(n) for x in range(alphabet)} | \
                    {r[:j] + (x,) + r[j:] for j in range(n + 1) for x in range(alphabet)}
                want = {int(S.keys(np.array([w], np.uint64).reshape(1, len(w)))[0]) for w in want}
                got = near[row == i].tolist()
                assert len(got) == len(want) and set(got) == want
