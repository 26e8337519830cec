"""Quality rules: base counts against a plain recount, the trees' constraints and held-out accuracy."""

import re

import numpy as np

from swipewatch.llm import quality, queries

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def recount(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed


def test_query_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
             if len(r.text or "") < 20_000}
    found = {r.doc_id: r for r in queries.op4_quality_rules(spark, FOLDER).collect()}
    for doc, body in texts.items():
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == recount(body)
        assert not (r.kept and r.base_failed)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs, trees).select("row.doc_id", "quality.kept").join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = judged.collect()
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.9


def test_monotone_and_flat_arrays():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    y = ((np.sin(9 * x[:, 0]) + 1.5 * x[:, 0] + rng.normal(0, 0.3, 3000)) > 1).astype(float)  # not monotone itself
    trees = quality.fit(x, y, quality.QualityConfig(), np.array([1, 0]))
    grid = np.linspace(0, 1, 400)
    for other in (0.1, 0.5, 0.9):
        assert (np.diff(trees.score(np.column_stack([grid, np.full(400, other)]))) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    assert trees.feature.shape == (80, 15) and trees.value.shape == (80, 16)


def test_edge_rows(spark):
    long_text = "many words of prose, and then others. " * 4000
    docs = spark.createDataFrame([(None, "a b", "x", 1), (1, None, None, None), (2, "", "x", 2), (2, "", "x", 2),
                                  (3, long_text, "x", 3)], "doc_id long, text string, quality string, score long")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, quality.train(docs, labels)).select("row.*", "quality.n_words", "quality.kept").collect()
    assert sorted((r.n_words, r.kept) for r in rows) == [(0, False)] * 3 + [(2, False), (28_000, False)]
    kept = quality.quality_filter(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.quality_filter(docs.limit(0), labels).count() == 0
