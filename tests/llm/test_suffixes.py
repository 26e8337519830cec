"""Suffix arrays against plain sorting, and removal of repeated byte strings against a brute-force version."""

import hashlib

import numpy as np
import pytest

from swipewatch.llm import queries, suffixes

FOLDER = "/root/testdata/sf0.001"


def brute(texts, width):
    first, out = {}, {}
    bodies = {d: (t or "").encode() for d, t in texts}
    for d, b in bodies.items():
        for i in range(len(b) - width + 1):
            first.setdefault(b[i:i + width], (d, i))
    for d, b in bodies.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] != (d, i):
                gone[i:i + width] = b"\x01" * width
        out[d] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_suffix_array(wide, monkeypatch):
    if wide:
        monkeypatch.setattr(suffixes, "_keys", lambda *a: None)
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 50, 200]:
        for letters in (1, 2, 5, 250):
            values = rng.integers(1, letters + 1, n)
            plain = sorted(range(n), key=lambda i: values[i:].tolist())
            assert suffixes.suffix_array(values).tolist() == plain


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    expected = {d: (n, g, s, hashlib.sha256(k).hexdigest()) for d, (n, g, s, k) in brute([(r.doc_id, r.text) for r in rows], 100).items()}
    found = queries.op9_suffix_array_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected and len(found) == len(rows)
    assert sum(g for _, g, _, _ in expected.values()) > 0


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    texts = [(d, "".join(rng.choice(list("abé"[:2 + d % 2]), rng.integers(0, 80)))) for d in range(40)]
    texts += [(40, "a" * 300), (41, "ab" * 99), (42, texts[7][1]), (43, texts[7][1] + texts[9][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.drop_repeats(docs, 8, 4).collect()}
    assert found == brute(texts, 8)


def test_edge_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame(
        [(None, "abcde", "x", "y", 1), (1, None, None, None, None), (2, "", "x", "y", 2), (3, long_text, "x", "y", 3),
         (3, long_text, "x", "y", 3), (4, "z" + long_text, "x", "y", 4), (5, "abcde", "x", "y", 5)],
        "doc_id long, text string, kept string, runs string, n long")
    rows = sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.drop_repeats(docs, 5, 3).collect())
    low, n = -2 ** 63, len(long_text)
    assert [r[:2] for r in rows] == [(low, 5), (1, 0), (2, 0), (3, n), (3, n), (4, n + 1), (5, 5)]
    assert rows[3] == rows[4] and rows[5][2:] == (n, 1) and rows[6][2:] == (5, 1) and rows[0][2:] == (0, 0)
    assert suffixes.drop_repeats(docs.limit(0)).count() == 0
