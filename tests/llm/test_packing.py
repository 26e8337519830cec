"""Packing: ids as the tokenizers library gives them, and sequences that are gapless and nearly as few as can be."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from swipewatch.llm import packing, queries

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_ids(spark, library):
    texts = [r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").limit(600).collect()]
    texts += [r.html[:3000] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").limit(40).collect()]
    texts += ["", " ", "a", "a  b", "a   b", " a", "a ", "a\n b", "a \nb", "a\n\nb c", "it's we'll 'tis I'm", "x <|endoftext|> y",
              "1234 ½ ² ٣", "a b c", "a　 b", "tab\tx y", "\x1c a b", "é ñ ß 中文 字", "don 't", "a\r\nb c", "x'S 'S"]
    encoder = packing.Encoder(path("byte_bpe_50k.json"))
    for _ in range(2):
        for body in texts:
            assert np.frombuffer(encoder.encode(body), np.uint32).tolist() == library.encode(body, add_special_tokens=False).ids


def check(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_query(spark, library):
    rows = queries.op7_best_fit_packing(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    expected = {}
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[d.doc_id, i] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert found == expected and len(rows) == len(expected)
    total = sum(n for _, n, _ in expected.values())
    assert check(rows, 1024) <= 1.01 * total / 1024 + 1


def test_rounds_against_item_by_item():
    rng = np.random.default_rng(2)
    for capacity in (10, 64):
        sizes = rng.integers(1, capacity + 1, 3000)
        values, n = np.unique(sizes, return_counts=True)
        moves = packing.rounds(dict(zip(values.tolist(), n.tolist())), capacity)
        assert moves[:, 2].sum() == 3000
        gaps = []
        for size in sorted(sizes.tolist(), reverse=True):  # best-fit decreasing
            fit = min((g for g in gaps if g >= size), default=None)
            if fit is None:
                gaps.append(capacity - size)
            else:
                gaps[gaps.index(fit)] = fit - size
        used = np.zeros(int((moves[:, 3] + moves[:, 2]).max()), np.int64)
        for size, _, taken, first, offset in moves.tolist():
            assert (used[first:first + taken] == offset).all()
            used[first:first + taken] += size
        assert used.max() <= capacity and len(used) <= len(gaps) + 1
        assert packing.rounds({}, capacity).shape == (0, 5)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "x", 1), (1, None, None, None), (2, "", "x", 2), (2, "", "x", 2),
                                  (3, "word " * 30_000, "x", 3)], "doc_id long, text string, ids string, length long")
    rows = packing.pack(docs, path("byte_bpe_50k.json"), 1024, with_ids=True).collect()
    check(rows, 1024)
    assert sorted(r.length for r in rows if r.doc in (1, 2)) == [1, 1, 1]
    assert all(len(r.ids) == 4 * r.length for r in rows) and sum(r.length for r in rows if r.doc == 3) > 30_000
    assert packing.pack(docs.limit(0), path("byte_bpe_50k.json")).count() == 0
