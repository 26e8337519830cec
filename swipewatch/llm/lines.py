"""Line dedup by winnowing over line hashes.

The lines of a text that hold a word are hashed. In every window of ``min_lines`` consecutive lines the least hash is
selected (the leftmost of equals); the selected lines are the fingerprints. Two texts that share a run of at least
``min_lines`` lines select the same line in it, so a shared run always shares a fingerprint. Fingerprints found once
are done with. No positions are joined and no match is extended line by line: each window that selects one of the
others carries a digest of its lines, windows are grouped by it, and among windows of equal lines all but the earliest
go. Touching windows join, so a repeated run is deleted over its whole length.

With ``min_words``, one line, or two lines in a row, of at least so many words are a window too. So every repeated run
of whole lines is found that has ``min_lines`` lines or ``min_words`` words, in texts of one or two lines as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text
from swipewatch.llm.superkmers import covered


def lines_of(body: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places of those that hold a word."""
    lines = body.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def windows_of(lines: list[bytes], min_lines: int, min_words: int | None) -> list[tuple[int, int]]:
    """``(first line, number of lines)``: all windows of ``min_lines`` lines, and shorter ones of ``min_words`` words."""
    out = [(start, min_lines) for start in range(len(lines) - min_lines + 1)]
    if min_words is not None:
        words = np.cumsum([0, *(len(line.split()) for line in lines)])
        for n in range(1, min_lines):
            out += [(int(start), n) for start in np.flatnonzero(words[n:] - words[:-n] >= min_words)]
    return out


def winnow(hashes: list[int], windows: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(place, windows that select it)`` for every selected place."""
    chosen: dict[int, list[tuple[int, int]]] = {}
    for start, n in windows:
        window = hashes[start:start + n]
        chosen.setdefault(start + window.index(min(window)), []).append((start, n))
    return list(chosen.items())


def fingerprints(docs: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """``(fp, doc, tie, windows)``: selected line hashes, with digest halves, first line and lines of the windows around."""
    window = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("fp", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("windows", pa.list_(window))])

    def scan(batches):
        def rows():
            for doc, tie, body in text.rows_of(batches):
                lines, full = lines_of(body)
                lines = [lines[i].strip() for i in full]
                hashes = [xxhash.xxh64_intdigest(line) for line in lines]
                for place, starts in winnow(hashes, windows_of(lines, min_lines, min_words)):
                    around = []
                    for start, n in starts:
                        digest = hashlib.blake2b(b"\n".join(lines[start:start + n]), digest_size=16).digest()
                        a, b = np.frombuffer(digest, np.int64).tolist()
                        around.append({"a": a, "b": b, "start": start, "n": n})
                    yield hashes[place] - 2 ** 63, doc, tie, around

        yield from text.in_batches(rows(), schema)

    return text.keyed(docs).mapInArrow(
        scan, "fp long, doc long, tie long, windows array<struct<a: long, b: long, start: long, n: long>>")


def repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``(doc, tie, start, n)``: windows of n lines, from the start-th line that holds a word, whose lines also start earlier."""
    found = text.stored(fingerprints(docs, min_lines, min_words), "line-fingerprints")
    again = text.stored(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "repeated-lines")
    windows = text.stored(found.join(again, "fp", "left_semi").select("doc", "tie", F.explode("windows").alias("w"))
                          .select("doc", "tie", "w.*"), "line-windows")
    first = text.stored(windows.groupBy("a", "b").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
                        .where("copies > 1").select("a", "b", "first"), "first-windows")
    text.discard(found, again)
    later = windows.join(first, ["a", "b"]).where(F.struct("doc", "tie", "start") != F.col("first"))
    return later.select("doc", "tie", "start", later["n"])


def drop_repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``(row, kept, n_lines, n_removed)``: the row as it came, the text left, lines that hold a word and how many went.

    A line is compared without white space at its ends. Lines without a word do not count and stay. A null text is
    kept null; without ``min_words`` texts of fewer than ``min_lines`` lines lose none; a row that repeats another one in id and text is
    judged like it. An empty table gives no rows."""
    runs = repeated_lines(docs, min_lines, min_words)
    by_doc = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("starts"))  # at most the lines of one text
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.doc_id().alias("doc"),
                         F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    joined = marked.join(by_doc, ["doc", "tie"], "left").select("row", text_of("row").alias("body"), "starts")
    schema_of = joined.schema["row"].dataType.simpleString()

    def cut(body: bytes | None, starts: list | None) -> tuple[str | None, int, int]:
        if body is None:
            return None, 0, 0
        lines, full = lines_of(body)
        if not starts:
            return body.decode(), len(full), 0
        gone = covered(len(full), np.array([(run["start"], run["n"]) for run in starts], np.int64), 0)
        drop = {i for i, g in zip(full, gone.tolist()) if g}
        return b"\n".join(line for i, line in enumerate(lines) if i not in drop).decode(), len(full), len(drop)

    def apply(batches):
        for batch in batches:
            kept = [cut(body, starts) for body, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            text_out, n, gone = zip(*kept) if kept else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_out, pa.string()), pa.array(n, pa.int64()),
                                              pa.array(gone, pa.int64())], names=["row", "kept", "n_lines", "n_removed"])

    return joined.mapInArrow(apply, f"row {schema_of}, kept string, n_lines long, n_removed long")


def text_of(row: str):
    return F.encode(F.col(f"{row}.text"), "UTF-8")


def line_filter(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text`` and ``n_chars``, where there is one, brought up to date. A
    document that loses all its lines that hold a word goes. Columns as they came."""
    found = drop_repeated_lines(docs, min_lines, min_words).where("n_removed = 0 OR n_removed < n_lines")
    changed = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.col("n_removed") > 0, changed).otherwise(F.col("row")).alias("row")).select("row.*")
