"""The whole pipeline against brute-force versions of its stages."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from test_decontaminate import least_distance
from test_lines import brute_words
from test_packing import check
from test_simhash import brute_groups, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from swipewatch.llm import decontaminate, quality

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    trees = quality.train(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs = {}
    for r in table.orderBy("doc_id").collect():
        base, x = quality.statistics((r.text or "").encode())
        if base[0] >= 50 and 100 * base[4] <= 50 * base[0] and trees.score(np.array([x]))[0] >= 0.5:
            docs[r.doc_id] = r.text
    cut = brute_words([(d, t or "") for d, t in docs.items()], 3, 50)
    docs = {d: (cut[d][2] if cut[d][1] else t) for d, t in docs.items() if not cut[d][1] or cut[d][1] < cut[d][0]}
    roots = brute_groups([brute_print(t) for t in docs.values()])
    docs = {d: t for i, (d, t) in enumerate(docs.items()) if roots[i] == i}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {}
    for d, t in docs.items():
        body = decontaminate.normalise(t)
        if not any(least_distance(i, body) <= int(len(i) * decontaminate.ERROR_RATE) for i in items):
            clean[d] = t
    assert 0 < len(clean) < len(docs)
    encode = Tokenizer.from_file(path("byte_bpe_50k.json")).encode
    expected = set()
    for d, t in clean.items():
        ids = [*encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected |= {(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    check(rows, 1024)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_and_odd_tables(spark, name, stage):
    docs = spark.createDataFrame([(None, "a b c", "x", "y", 5, 1), (1, None, None, None, None, None), (2, "", "x", "y", 0, 2),
                                  (2, "", "x", "y", 0, 2), (3, "many words of prose, and others. " * 3000, "x", "y", 9, 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, quality long")
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, FOLDER)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        assert rows or not table.count() or name == "quality_rules"
