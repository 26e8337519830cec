"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Pieces are range-sorted by length, so a piece is known by its length and its rank among the pieces of that length.
Open sequences are known by their gap in the same way. A round takes the longest pieces not placed yet, sweeps to the
successor gap (the least one that is long enough), settles who gets which sequence by rank, and updates the gaps;
where no gap is long enough new sequences are opened. All pieces of a length and all sequences of a gap move together
as ranges of ranks, so a round's state is bounded by the sequence length and does not grow with the documents. The
rounds give a table of moves (length, ranks, sequences, offset), and every piece finds its own move by its rank.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text



class Encoder:
    """Token ids of a byte-level BPE file in the format of the ``tokenizers`` library, as unsigned 32-bit numbers.

    The file's vocabulary is run by the faster ``tiktoken`` loop, which gives the same ids. Texts that hold a special
    token's string go through ``tokenizers`` itself, which turns it into that token.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._slow = None

    def slow(self):
        """The library's own tokenizer, loaded only where a text needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, body: str) -> bytes:
        if self.special is not None and self.special.search(body):
            ids = self.slow().encode(body, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(body)
        return np.array(ids, np.uint32).tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """``(doc, tie, piece, start, length, ids_crc32[, ids])``: every document's ids followed by ``end_id``; longer ones
    are cut so that all but the first piece are full."""
    schema = [("doc", pa.int64()), ("tie", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(schema)
    end = np.array([end_id], np.uint32).tobytes()

    def cut(batches):
        encode = encoder(path).encode

        def rows():
            for doc, tie, body in text.rows_of(batches):
                ids = encode(body.decode()) + end
                total = len(ids) // 4
                borders = [0, *range(total % length or length, total + 1, length)]
                for piece, (start, stop) in enumerate(zip(borders, borders[1:])):
                    part = ids[4 * start:4 * stop]
                    row = (doc, tie, piece, start, stop - start, zlib.crc32(part))
                    yield (*row, part) if with_ids else row

        yield from text.in_batches(rows(), schema)

    ddl = "doc long, tie long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return text.keyed(docs).mapInArrow(cut, ddl)


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Moves ``(length, first rank, n, first sequence, offset)`` that place every piece of every length."""
    open_runs: dict[int, list[tuple[int, int]]] = {}
    has = np.zeros(capacity + 1, bool)
    moves, sequences = [], 0
    for size in range(capacity, 0, -1):
        rank, left = 0, counts.get(size, 0)
        while left:
            fits = has[size:].argmax() + size
            if not has[fits]:  # no gap is long enough
                opened = -(-left // (capacity // size))
                open_runs.setdefault(capacity, []).append((sequences, opened))
                sequences += opened
                has[capacity], fits = True, capacity
            first, n = open_runs[fits].pop()
            taken = min(n, left)
            if taken < n:
                open_runs[fits].append((first + taken, n - taken))
            has[fits] = bool(open_runs[fits])
            moves.append((size, rank, taken, first, capacity - fits))
            if fits > size:
                open_runs.setdefault(fits - size, []).append((first, taken))
                has[fits - size] = True
            rank, left = rank + taken, left - taken
    return np.array(moves, np.int64).reshape(-1, 5)


def ranked(cut: DataFrame) -> DataFrame:
    """The pieces range-sorted by length, with their range ``part`` and their rank ``nth`` of their length in it."""
    names = cut.columns
    order = ["length", "doc", "tie", "piece"]
    spread = cut.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            nth = np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                nth[at] = seen.get(size, 0) + np.arange(len(at))
                seen[size] = seen.get(size, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), part)), pa.array(nth)],
                                             names=[*names, "part", "nth"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return spread.mapInArrow(count, f"{ddl}, part long, nth long")


def place(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``. Lengths lie between 1 and ``capacity``; sequences are gapless."""
    cut = text.stored(cut, "pieces")  # range sorting reads its input twice; the texts are tokenised once
    table = text.stored(ranked(cut), "ranked-pieces")
    text.discard(cut)
    # one row for each range and length: ranges are sorted by length, so at most ranges + capacity rows
    sizes = sorted((r.length, r.part, r.n) for r in table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for size, part, n in sizes:
        before[size, part] = counts.get(size, 0)
        counts[size] = counts.get(size, 0) + n
    moves = rounds(counts, capacity)
    starts = {int(size): moves[moves[:, 0] == size] for size in np.unique(moves[:, 0])}
    names = table.columns

    def find(batches):
        for batch in batches:
            lengths, part, nth = (batch.column(c).to_numpy() for c in ("length", "part", "nth"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size, here in {(int(a), int(b)) for a, b in zip(lengths, part)}:
                at = np.flatnonzero((lengths == size) & (part == here))
                rank, own = nth[at] + before[size, here], starts[size]
                move = np.searchsorted(own[:, 1], rank, "right") - 1
                sequence[at] = own[move, 3] + rank - own[move, 1]
                offset[at] = own[move, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(find, f"{ddl}, sequence_id long, offset long").drop("part", "nth")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places. A null text counts as empty and gives the end id alone; repeated
    rows are placed one by one; an empty table gives no rows."""
    return place(pieces(docs, path, capacity, end_id, with_ids), capacity)
