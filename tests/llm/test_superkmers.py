"""Removal of repeated word windows against a brute-force version."""

import hashlib
import re

import numpy as np
import pytest

from swipewatch.llm import queries, superkmers

FOLDER = "/root/testdata/sf0.001"


def brute(texts, width):
    """``{doc: (n words, n removed, kept)}`` for texts in the order of their ids."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts}
    first, out = {}, {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i:i + width]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] != (d, i):
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    expected = {d: (n, g, hashlib.sha256(k.encode()).hexdigest())
                for d, (n, g, k) in brute([(r.doc_id, r.text) for r in rows], 20).items()}
    found = queries.op3_substring_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected and len(found) == len(rows)
    assert sum(g for _, g, _ in expected.values()) > 0


@pytest.mark.parametrize("chunk", [1, 1 << 24])
def test_random_texts(spark, chunk, monkeypatch):
    monkeypatch.setattr(superkmers, "_CHUNK", chunk)
    rng = np.random.default_rng(5)
    texts = []
    for d in range(40):  # few words, so that windows repeat within and across texts
        kind = ["ab", "abc", "abcdefghij"][d % 3]
        texts.append((d, "\n ".join(rng.choice(list(kind), rng.integers(0, 60)))))
    texts += [(40, "é x y " * 40), (41, "a " * 500), (42, texts[5][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = {r.doc: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in superkmers.drop_repeats(docs, 6, 3).collect()}
    assert found == brute(texts, 6)


def test_edge_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame(
        [(None, "a b c d e", "x", "y", 1), (1, None, None, None, None), (2, "", "x", "y", 2), (3, long_text, "x", "y", 3),
         (3, long_text, "x", "y", 3), (4, "z " + long_text, "x", "y", 4), (5, "a b c d e", "x", "y", 5)],
        "doc_id long, text string, kept string, runs string, n long")
    rows = sorted(((r.doc, r.n_words, r.n_removed) for r in superkmers.drop_repeats(docs, 4, 2).collect()))
    low = -2 ** 63
    assert rows == [(low, 5, 0), (1, 0, 0), (2, 0, 0), (3, 30_000, 0), (3, 30_000, 0), (4, 30_001, 30_000), (5, 5, 5)]
    assert superkmers.drop_repeats(docs.limit(0)).count() == 0
