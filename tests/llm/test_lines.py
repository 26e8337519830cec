"""Line dedup against its SQL and a brute-force version."""

import hashlib

import duckdb
import numpy as np

from swipewatch.llm import lines, queries

FOLDER = "/root/testdata/sf0.01"
SPACE = " \t\n\v\f\r"


def brute(texts, width):
    first, out = {}, {}
    split = {d: (t or "").split("\n") for d, t in texts}
    full = {d: [i for i, line in enumerate(parts) if line.strip(SPACE)] for d, parts in split.items()}
    key = lambda d, s: tuple(split[d][i].strip(SPACE) for i in full[d][s:s + width])
    for d in split:
        for s in range(len(full[d]) - width + 1):
            first.setdefault(key(d, s), (d, s))
    for d in split:
        gone = {full[d][i] for s in range(len(full[d]) - width + 1) if first[key(d, s)] != (d, s) for i in range(s, s + width)}
        out[d] = (len(full[d]), len(gone), "\n".join(x for i, x in enumerate(split[d]) if i not in gone))
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    expected = {(d, n, g, hashlib.sha256(k.encode()).hexdigest())
                for d, (n, g, k) in brute_words([(r.doc_id, r.text or "") for r in rows], 3, 50).items()}
    found = [(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op5_line_dedup(spark, FOLDER).collect()]
    assert set(found) == expected and len(found) == len(rows)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    answer = connection.sql(queries.LINES_SQL)
    assert answer.columns == ["doc_id", "n_lines", "n_removed", "kept_sha256"] and set(answer.fetchall()) == expected


def test_random_lines(spark):
    rng = np.random.default_rng(7)
    texts = [(d, "\n".join(rng.choice(["a", " a ", "b", "", "c\t", "é"], rng.integers(0, 25)))) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for width in (1, 2, 4):
        found = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.drop_repeated_lines(docs, width).collect()}
        assert found == brute(texts, width)


def test_edge_rows(spark):
    body = "\n".join(f"line {i}" for i in range(5000))
    docs = spark.createDataFrame([(None, "a\nb\nc", 5, "x", 1), (1, None, 0, None, None), (2, "", 0, "x", 2), (2, "", 0, "x", 2),
                                  (3, body, 9, "x", 3), (3, body, 9, "x", 3), (4, "new\n" + body, 9, "x", 4), (5, "a\nb\nc", 5, "x", 5)],
                                 "doc_id long, text string, n_chars long, starts string, row long")
    kept = lines.line_filter(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0, r.n_chars, len(r.text or "")) for r in rows) == [
        (0, 5, 5), (1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 9, len(body)), (3, 9, len(body)), (4, 3, 3)]
    assert [r.text for r in rows if r.doc_id == 4] == ["new"]
    assert lines.line_filter(docs.limit(0)).count() == 0


def test_columns_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(lines.line_filter(docs).collect()) == [(1, "a\nb\nc"), (2, "d")]
    docs = spark.createDataFrame([(1, "a\nb\nc", "7"), (2, "a\nb\nc\nd", "9")], "doc_id int, text string, n_chars string")
    assert sorted(lines.line_filter(docs).collect()) == [(1, "a\nb\nc", "7"), (2, "d", "1")]


def brute_words(texts, width, words):
    """As ``brute``, with every shorter run of so many words a window too."""
    first, out = {}, {}
    split = {d: t.split("\n") for d, t in texts}
    full = {d: [i for i, line in enumerate(parts) if line.strip(SPACE)] for d, parts in split.items()}
    windows = []
    for d in split:
        for s in range(len(full[d])):
            for n in range(1, width + 1):
                run = tuple(split[d][i].strip(SPACE) for i in full[d][s:s + n])
                if len(run) == n and (n == width or sum(len(line.split()) for line in run) >= words):
                    first.setdefault(run, (d, s))
                    windows.append((d, s, run))
    gone = {(d, full[d][s + k]) for d, s, run in windows if first[run] != (d, s) for k in range(len(run))}
    for d in split:
        n = sum(d == x for x, _ in gone)
        out[d] = (len(full[d]), n, "\n".join(x for i, x in enumerate(split[d]) if (d, i) not in gone))
    return out


def test_long_lines(spark):
    rng = np.random.default_rng(8)
    long, short = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(30))
    texts = [(0, long), (1, f"own\n {long} \nend"), (2, f"{long}\n{short}"), (3, f"x\n{long}\n{short}\ny"), (4, f"{short}\nz"),
             (5, f"{short}\n{short[::-1]}"), (6, f"p\n{short}\n{short[::-1]}")]
    texts += [(d, "\n".join(rng.choice(["a", "b", "c d e", " c d e", "f g", "f g h", "", "é i"], rng.integers(0, 12)))) for d in range(10, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for width, words in ((3, 50), (3, 4), (2, 3)):
        found = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.drop_repeated_lines(docs, width, words).collect()}
        assert found == brute_words(texts, width, words)
    kept = {r.row.doc_id: r.kept for r in lines.drop_repeated_lines(docs, 3, 50).collect()}
    assert (kept[0], kept[1], kept[2], kept[3], kept[6]) == (long, "own\nend", short, "x\ny", "p")
