"""Decontamination against a plain edit-distance search."""

import numpy as np

from swipewatch.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


def least_distance(item, body):
    """Edit distance of the item to the nearest substring, by the plain recurrence, a row of the body at a time."""
    row = np.zeros(len(body) + 1, np.int64)
    letters = np.array([*body], dtype="U1")
    place = np.arange(len(body) + 1)
    for i, c in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    expected = set()
    for d in docs:
        body = decontaminate.normalise(d.text)
        for i in items:
            item = decontaminate.normalise(i.text)
            distance, budget = least_distance(item, body), int(len(item) * decontaminate.ERROR_RATE)
            if distance <= budget:
                expected.add((d.doc_id, i.item_id, distance, budget))
    found = [tuple(r) for r in queries.op6_benchmark_decontamination(spark, FOLDER).collect()]
    assert set(found) == expected and len(found) == len(expected) > 0


def test_edited_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = list("abcdefgh ")
    items = ["".join(rng.choice(letters, rng.integers(40, 200))).strip() for _ in range(30)]
    items = [decontaminate.normalise(x) for x in items]
    docs = []
    for d in range(120):
        item = [*items[d % 30]]
        for _ in range(d % 12):
            at, kind = int(rng.integers(0, len(item))), d % 3
            item[at:at + (kind != 1)] = [] if kind == 0 else ["z"]
        docs.append((d, "".join(rng.choice(letters, 300)) + "".join(item) + "".join(rng.choice(letters, 200))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = set()
    for d, body in docs:
        for i, item in enumerate(items):
            distance = least_distance(item, decontaminate.normalise(body))
            if distance <= int(len(item) * decontaminate.ERROR_RATE):
                expected.add((d, i, distance))
    for block, at_once in ((7, 1 << 20), (3, 2000), (1000, 1)):
        monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
        found = {(r.doc, r.item_id, r.distance) for r in decontaminate.leaks(table, benchmark, block=block).collect()}
        assert found == expected and len(expected) > 30


def test_edge_rows(spark):
    item = "a question that nobody asked before now"
    docs = spark.createDataFrame([(None, f"so {item.upper()} it was", "x", 1), (1, None, None, None), (2, "", "x", 2),
                                  (3, "word " * 40_000 + item, "x", 3), (3, "word " * 40_000 + item, "x", 3), (4, "clean", "x", 4)],
                                 "doc_id long, text string, item_id string, distance long")
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "word"), (None, item)], "item_id long, text string")
    found = sorted((r.doc, r.item_id, r.distance) for r in decontaminate.leaks(docs, benchmark).collect())
    assert found == [(-2 ** 63, 1, 0), (3, 1, 0), (3, 1, 0)]
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == 6
    assert decontaminate.without_leaks(docs.limit(0), benchmark).count() == 0


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "so A question that nobody asked before now it was"), (2, "clean")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "a question that nobody asked before now"), (7, "another one that no text here holds")],
                                      "item_id long, text string")
    assert [(r.doc, r.item_id, r.distance) for r in decontaminate.leaks(docs, benchmark).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()] == [2]


def test_names_of_the_caller_are_kept(spark):
    item = "a passage of the benchmark that is long enough to tell"
    docs = spark.createDataFrame([(1, item, 1, 2), (2, "something else", 3, 4)], "doc_id long, text string, __doc int, __tie int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.without_leaks(docs, benchmark).collect() == [(2, "something else", 3, 4)]


def test_one_pass_whatever_the_number_of_items(spark):
    """A hundred blocks: documents are scanned once, and no item is part of the plan or its closures."""
    items = spark.range(2000).selectExpr("id AS item_id", "concat('the question with the number ', sha2(cast(id AS string), 256)) AS text")
    docs = items.where("item_id % 100 = 7").selectExpr("item_id AS doc_id", "concat('so ', text, ' it is') AS text")
    found = decontaminate.leaks(docs.repartition(2), items, block=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert sorted((r.doc, r.item_id, r.distance) for r in found.collect()) == [(i, i, 0) for i in range(7, 2000, 100)]
