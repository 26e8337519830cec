"""SimHash groups against a brute-force version, and the ball search on planted distances."""

import time

import numpy as np
import pytest
import xxhash

from swipewatch.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_print(body):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    """Root (least position) of each fingerprint's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def brute_groups_of_links(n, links):
    label, changed = list(range(n)), True
    while changed:
        changed = False
        for x, y in links:
            low = min(label[x], label[y])
            changed |= label[x] != low or label[y] != low
            label[x] = label[y] = low
    return label


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_groups(prints)
    expected = {(r.doc_id, f"{p:016x}", rows[g].doc_id) for r, p, g in zip(rows, prints, roots)}
    found = queries.op10_simhash_near_dedup(spark, FOLDER).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == expected and len(found) == len(rows)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
@pytest.mark.parametrize("whole", [False, True])
def test_links_find_every_pair(radius, whole):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)
    for distance in range(1, 7):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in range(150)], np.uint64)
        prints = np.concatenate([prints, prints[:150] ^ flips])
    prints = np.unique(prints)
    roots = brute_groups(prints.tolist(), radius)
    keys, who = [], []
    for keep, mark, flips in simhash.block_masks(radius, 4):
        keys.append((((prints & keep)[:, None] ^ flips) | mark).ravel())
        who.append(np.repeat(prints, len(flips)))
    if whole:  # all in one meeting, as a large group of near copies would be
        a, b = map(np.concatenate, simhash._ball_links(prints, radius, 3))
    else:
        a, b = simhash.meet(np.concatenate(keys), np.concatenate(who), radius)
    place = {p: i for i, p in enumerate(prints.tolist())}
    label = list(range(len(prints)))
    for x, y in zip(a.tolist(), b.tolist()):
        label[place[x]] = place[y]
    if whole:
        label = brute_groups_of_links(len(prints), [(place[x], place[y]) for x, y in zip(a.tolist(), b.tolist())])
    assert label == roots


@pytest.mark.parametrize("spread", [0.3, 1.0])
@pytest.mark.parametrize("most", [40, 1024])
def test_large_meetings_link_every_pair(spread, most, monkeypatch):
    """All meetings through the tables: near copies of one text, dense and sparse, next to texts of their own."""
    monkeypatch.setattr(simhash, "_PAIRWISE", 40)
    monkeypatch.setattr(simhash, "_MATRIX", most)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2 ** 63, dtype=np.uint64)
    bits = rng.random((700, 64)) < spread / 8
    prints = np.unique(np.concatenate([
        centre ^ np.bitwise_or.reduce(bits * (np.uint64(1) << np.arange(64, dtype=np.uint64)), axis=1), rng.integers(0, 2 ** 63, 50, dtype=np.uint64)]))
    roots = brute_groups(prints.tolist())
    place, links = {p: i for i, p in enumerate(prints.tolist())}, []
    for keep, mark, flips in simhash.block_masks(3, 4):
        a, b = simhash.meet((((prints & keep)[:, None] ^ flips) | mark).ravel(), np.repeat(prints, len(flips)), 3, keep)
        links += [(place[x], place[y]) for x, y in zip(a.tolist(), b.tolist())]
    assert brute_groups_of_links(len(prints), links) == roots and len(set(roots)) > 1


def near_copies(n):
    rng = np.random.default_rng(n)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 16, (n, 6)).astype(np.uint64), axis=1)
    kept = np.uint64(1) << rng.integers(16, 64, n).astype(np.uint64)
    return np.unique(np.uint64(2 ** 62 + 12345 * 2 ** 20) ^ flips ^ np.where(rng.random(n) < 0.2, np.uint64(0), kept))


def test_large_meetings_take_linear_time():
    """10,000 and about 100,000 near copies on one key: ten times the members, not a hundred times the time."""
    keep = simhash.block_masks(3, 4)[0][0]
    key = np.uint64(2 ** 62 + 12345 * 2 ** 20) & keep
    taken = []
    for n in (10_000, 140_000):
        members = near_copies(n)
        start = time.process_time()
        a, _ = simhash._block_links(members, key, keep)
        taken.append((time.process_time() - start) / len(members))
    assert len(members) > 90_000 and len(a) > 90_000 and taken[1] < 5 * taken[0] and taken[1] * len(members) < 20


def test_balls_make_every_variant_once():
    members = near_copies(3000)
    start = time.process_time()
    simhash._ball_links(members, 3, 4)
    few = time.process_time() - start
    start = time.process_time()
    simhash._ball_links(members, 3, 64)
    assert time.process_time() - start < 3 * few


def test_emission_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_TASK_BYTES", 1 << 20)
    prints = spark.range(20_000).selectExpr("xxhash64(id) AS fp").coalesce(1)
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(fp#" in plan and ", 60)" in plan


def test_names_of_the_caller_are_kept(spark):
    docs = spark.createDataFrame([(2, "a b c d", 1, 2), (1, "a b c d", 3, 4)], "doc_id long, text string, __doc int, __tie int")
    assert simhash.keep_one(docs).collect() == [(1, "a b c d", 3, 4)]


def test_edge_rows(spark):
    long_text = "word other third " * 4000
    schema = "doc_id long, text string, fp string, doc string, node long"
    docs = spark.createDataFrame([(None, "a b c d", "x", "y", 1), (1, None, None, None, None), (2, "", "x", "y", 2),
                                  (2, "", "x", "y", 2), (3, long_text, "x", "y", 3), (4, long_text, None, None, 4),
                                  (5, "A B c D", "x", "y", 5)], schema)
    groups = {(r.doc, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    low = -2 ** 63
    assert groups == {(low, low), (5, low), (1, 1), (2, 1), (3, 3), (4, 3)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 1), (True, 3)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
