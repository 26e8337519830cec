"""Product codes against SQL and plain Python, Orchard's search against full search, odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from swipewatch.llm import codes, queries

FOLDER = "/root/testdata/sf0.001"


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """``{vec_id: (code, error)}`` and the codebooks, for rows ``(vec_id, vector)`` of one length."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    step = len(kept[0][1]) // parts
    cut = lambda v: [v[i * step:(i + 1) * step] for i in range(parts)]
    firsts = sorted(kept, key=lambda r: r[0])[:entries]
    books = [list(b) for b in zip(*(cut(v) for _, v in firsts))]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [[] for _ in books[p]]
            for _, v in kept:
                of[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(own) for c in zip(*own)] if own else e for own, e in zip(of, books[p])]
    out = {}
    for i, v in kept:
        found = [near(part, book) for part, book in zip(cut(v), books)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    return out, books


def test_query_against_sql(spark):
    tables = duckdb.connect()
    tables.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    answer = tables.sql(queries.SQL["op11_vector_code_compression"])
    result = queries.op11_vector_code_compression(spark, FOLDER)
    assert sorted(result.columns) == sorted(answer.columns)
    rows = sorted(map(tuple, result.select(*answer.columns).collect()))
    assert rows == sorted(answer.fetchall()) and len(rows) == 500


@pytest.mark.parametrize("spread,entries", [(3, 16), (50, 7), (10 ** 12, 16)])
def test_orchard_finds_the_nearest_entry(spread, entries):
    rng = np.random.default_rng(entries)
    points = rng.integers(-spread, spread + 1, (400, 4))
    book = points[:entries].copy()
    book[-1] = book[0]  # equal entries: the lower index wins
    points, book = (codes.big(x) for x in (points, book)) if spread > 10 ** 9 else (points, book)
    search = codes.Orchard(book)
    best, distance = search.nearest(points)
    every = [[int(((p - e) ** 2).sum()) for e in book] for p in points]
    assert best.tolist() == [row.index(min(row)) for row in every] and [int(d) for d in distance] == [min(row) for row in every]


def test_orchard_measures_few_entries_when_clusters_are_apart():
    rng = np.random.default_rng(0)
    book = rng.integers(-10 ** 5, 10 ** 5, (64, 4))
    points = np.repeat(book, 50, axis=0) + rng.integers(-9, 10, (3200, 4))
    search = codes.Orchard(book)
    best, _ = search.nearest(points)
    assert best.tolist() == np.repeat(np.arange(64), 50).tolist() and search.measured < 3200 * 64 / 2


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(2).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    odd = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] + [0.0] * 7, None),
           (104, [0.1] * 8, 2), (105, [0.1] * 8, None)]
    rows = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in vectors + odd],
                                 "vec_id long, vector array<double>, label int, code string, of string")
    coded, books = codes.compress(rows.repartition(5), parts=4, entries=8, rounds=3)
    expected, expected_books = brute([(i, v) for i, v, _ in vectors + odd], parts=4, entries=8, rounds=3)
    found = coded.collect()
    assert {r.vec_id: (r.code, r.error) for r in found} == expected and len(found) == 62
    assert codes.books_digest(books) == hashlib.sha256(",".join(str(x) for b in expected_books for e in b for x in e).encode()).hexdigest()
    errors = {}
    for r in found:
        errors[r.label] = errors.get(r.label, 0) + r.error
    assert all(r.label_error == errors[r.label] for r in found) and None in errors


def test_ids_that_repeat_or_are_missing_and_few_rows(spark):
    schema = "vec_id long, vector array<float>, label string"
    rows = [(1, [0.5] * 8, "a"), (1, [0.25] * 8, "a"), (None, [9.0] * 8, None), (2, [1.0] * 3, "")]
    coded, books = codes.compress(spark.createDataFrame(rows, schema))
    found = sorted((r.vec_id or 0, r.label or "", r.label is None) for r in coded.collect())
    assert found == [(0, "", True), (1, "a", False), (1, "a", False), (2, "", False)]
    assert len(books) == 8 and books[0].shape == (2, 1)  # one entry for each of the ids 1 and 2, zeros where a vector ends
    for few in (spark.createDataFrame([], schema), spark.createDataFrame([(None, [1.0], "a")], schema)):
        coded, books = codes.compress(few)
        assert coded.count() == 0 and books == [] and coded.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(x) * 2.0 ** 30 for x in (i, i * i, -i, 1)], 0) for i in range(40)]
    coded, _ = codes.compress(spark.createDataFrame(rows, "vec_id long, vector array<double>, label int"), parts=2, entries=4, rounds=2)
    expected, _ = brute([(i, v) for i, v, _ in rows], parts=2, entries=4, rounds=2)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {i: (c, min(e, 2 ** 63 - 1)) for i, (c, e) in expected.items()}
    assert {r.label_error for r in coded.collect()} == {min(sum(min(e, 2 ** 63 - 1) for _, e in expected.values()), 2 ** 63 - 1)}
