"""Hard negatives against SQL and plain Python: ties, windows that overlap, copies, many blocks, odd rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import negatives, queries, vectors

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, vector array<double>"


def brute(rows, every, scale=256, positives=5, most=3, low=50, high=95):
    kept = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = label, [math.floor(scale * float(x)) for x in v]
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(i, -n) for n, i, own in scored if own != label and low * -s <= 100 * -n <= high * -s][:most]
            out |= {(a, p, rank, i, -s, n) for rank, (i, n) in enumerate(inside, 1)}
    return out


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_sql(spark):
    tables = duckdb.connect()
    tables.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    answer = tables.sql(queries.SQL["op13_hard_negative_mining"])
    result = queries.op13_hard_negative_mining(spark, FOLDER)
    assert result.columns == answer.columns
    assert found(result) == set(answer.fetchall()) and len(answer.fetchall()) > 0


@pytest.mark.parametrize("block_bytes,at_once", [(16 << 20, (4096, 1024)), (800, (7, 3))])
def test_ties_and_copies(spark, monkeypatch, block_bytes, at_once):
    """Few distinct values, so that scores tie and windows overlap; a third of the rows are one copy."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", at_once[0])
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", at_once[1])
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), [1.0, 0.5, 0.25, 0.0] if i % 3 == 0 else rng.integers(-3, 8, 4).astype(float).tolist())
            for i in rng.permutation(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    expected = brute(rows, 10)
    assert found(negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)) == expected and len(expected) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0, 1.0]), (3, 2, [0.5, 2.0]), (4, 1, None), (5, 1, [1.0, None]), (6, 2, [nan, 1.0]),
            (7, 2, [inf, 1.0]), (8, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (10, 3, [1.0, 2.0]), (20, 1, [-1.0, -2.0]), (30, 1, [0.0, 0.0]),
            (40, 1, [0.001, 0.0])]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:3]], SCHEMA + ", rank string, score int")
    expected = brute(rows, 10)
    assert found(negatives.hard_negatives(extra, F.col("vec_id") % 10 == 0)) == expected and expected
    short = [(0, 1, [1.0]), (1, 1, [4.0, 9.0]), (2, 2, [3.0]), (3, 2, [])]  # shorter vectors count as filled up with zeros
    filled = [(i, label, v + [0.0] * (2 - len(v))) for i, label, v in short]
    assert found(negatives.hard_negatives(spark.createDataFrame(short, SCHEMA), F.col("vec_id") == 0)) == brute(filled, 10) != set()
    # of rows that repeat an id the least label counts, then the least packed vector
    twice = [(0, 1, [1.0]), (1, 1, [4.0]), (2, 2, [3.0]), (2, 1, [3.5])]
    assert found(negatives.hard_negatives(spark.createDataFrame(twice, SCHEMA), F.col("vec_id") == 0)) == set()


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], SCHEMA)
    for frame in (empty, alone, alone.where("vec_id = 1")):
        result = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0)
        assert result.collect() == [] and result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for size in (100, 2 ** 24, 2 ** 29, 2 ** 62):
        a, b = (rng.integers(-size, size, (5, 3), dtype=np.int64).astype(float) for _ in range(2))
        exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert vectors.products(a, b).tolist() == [[max(-2 ** 62, min(2 ** 62, x)) for x in row] for row in exact]
    assert negatives.limits(np.array([-101, -100, -1, 0, 1, 99, 101, 2 ** 62]), 95).tolist() == [
        x * 95 // 100 for x in (-101, -100, -1, 0, 1, 99, 101, 2 ** 62)]
