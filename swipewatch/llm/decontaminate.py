"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by ``budget = m * error_rate`` edits. Cut into budget + 1 pieces, at least one
piece is untouched in any such copy. One automaton finds all exact piece hits in a text; around each hit the whole
item is verified with Myers' bit-parallel edit distance, so the answer is exact: every document that holds the item
within its budget is found. Both sides are lower-cased with white space runs as one space.

The items are written to the shared folder in blocks of about ``block``; no item passes through the driver. Documents are
read once: a task takes some megabytes of texts and goes through the blocks with them, one automaton at a time, so neither
what a task holds nor the number of passes grows with the benchmark.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

ERROR_RATE = 0.06
MIN_CHARS = 20
BLOCK = 5_000
AT_ONCE = 16 << 20  # bytes of texts that go through the blocks together


def normalise(body: str | None) -> str:
    return " ".join((body or "").lower().split())


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """``(offset, piece)``: the item in budget + 1 pieces of nearly equal length."""
    borders = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(borders, borders[1:])]


class Pattern:
    """An item for Myers' algorithm: one bit a character."""

    def __init__(self, item: str):
        self.size = len(item)
        self.where: dict[str, int] = {}
        for i, c in enumerate(item):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, window: str) -> tuple[int, int]:
        """Least edit distance of the item to any substring of the window, and where that substring ends."""
        size, where = self.size, self.where
        full, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score = full, 0, size
        least, end = size, 0
        for at, c in enumerate(window, 1):
            equal = where.get(c, 0)
            rows = equal | down
            across = (((equal & up) + up) ^ up) | equal
            plus = down | (~(across | up) & full)
            minus = up & across
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (~(rows | plus) & full), plus & rows
            if score < least:
                least, end = score, at
        return least, end


class Matcher:
    """Finds items within their budgets in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.patterns = [(item_id, Pattern(item), int(len(item) * error_rate)) for item_id, item in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, item) in enumerate(items):
            for offset, piece in cut(item, self.patterns[k][2]):
                pieces[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, body: str):
        """``(item_id, distance, budget, end)`` of the best occurrence of each item that is within its budget."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, where) in self.automaton.iter(body):
            for k, offset in where:
                starts[k].add(last + 1 - length - offset)
        for k, places in starts.items():
            item_id, pattern, budget = self.patterns[k]
            best = None
            low = high = None
            for place in [*sorted(places), None]:  # overlapping windows are verified as one
                if high is not None and (place is None or place - budget > high):
                    distance, end = pattern.best(body[max(0, low):high])
                    if distance <= budget and (best is None or distance < best[0]):
                        best = (distance, max(0, low) + end)
                    low = high = None
                if place is not None:
                    low = place - budget if low is None else low
                    high = place + pattern.size + budget
            if best is not None:
                yield item_id, best[0], budget, best[1]


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
          block: int = BLOCK) -> DataFrame:
    """``(doc, tie, item_id, distance, budget, end)`` for each document and item it holds, the least distance and the
    end of that place in the normalised text.

    Items shorter than ``min_chars`` or with a null text cannot tell a leak and are left out; items that repeat an id
    count as further texts of it. Items with a null id are searched under it, unless one with an id has the same text. Null and empty documents hold nothing; repeated rows give repeated
    results."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()),
                        ("budget", pa.int64()), ("end", pa.int64())])
    path, n = store_blocks(benchmark, block)

    def scan(batches):
        def rows():
            only = matcher_of(path, 0, error_rate, min_chars) if n == 1 else None
            for texts in together(text.rows_of(batches)):
                for i in range(n):
                    matcher = only if n == 1 else matcher_of(path, i, error_rate, min_chars)
                    for doc, tie, body in texts if matcher else ():
                        for hit in matcher.search(body):
                            yield doc, tie, *hit

        yield from text.in_batches(rows(), schema)

    return text.keyed(docs).mapInArrow(scan, "doc long, tie long, item_id long, distance long, budget long, end long")


def together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Normalised texts in lists of about ``AT_ONCE`` bytes."""
    held, size = [], 0
    for doc, tie, body in rows:
        held.append((doc, tie, normalise(body.decode())))
        size += len(body)
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def store_blocks(benchmark: DataFrame, block: int) -> tuple[str, int]:
    """The items in a table of the shared folder, a folder a block; its path and how many blocks there are."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    named = rows.where("item_id IS NOT NULL")
    rows = named.unionAll(rows.where("item_id IS NULL").join(named.select("text"), "text", "left_anti").select("item_id", "text"))
    items = text.stored(rows, "benchmark-items")
    n = max(1, math.ceil(items.count() / block))
    path = text.new_path(benchmark.sparkSession, "benchmark-blocks")
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
    items.select("item_id", "text", number).repartition(n, "block").write.partitionBy("block").parquet(path)
    text.discard(items)
    return path, n


def matcher_of(path: str, block: int, error_rate: float, min_chars: int) -> Matcher | None:
    """The matcher of one block, read by the task; None if no item of the block can tell a leak."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    folder = f"{place}/block={block}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    table = ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=["item_id", "text"])
    items = [(item_id, normalise(body)) for item_id, body in zip(*(column.to_pylist() for column in table.columns))]
    items = sorted(((item_id, item) for item_id, item in items if len(item) >= min_chars), key=lambda i: (i[0] is not None, i[0] or 0, i[1]))
    return Matcher(items, error_rate) if items else None


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item within its budget, columns as they came."""
    found = leaks(docs, benchmark, error_rate).select("doc", "tie").distinct()
    marked = docs.select(F.struct("*").alias("row"), text.doc_id().alias("doc"),
                         F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    return marked.join(found, ["doc", "tie"], "left_anti").select("row.*")
