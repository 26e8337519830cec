"""Vector compression by product codes, entries found by Orchard's search.

A vector is cut into equal consecutive parts; each part position has a codebook, and a part is stored as the number of its
nearest entry. Codebooks start as the parts of the first vectors and are improved in rounds, all in whole numbers: a
round assigns every part and replaces each entry by the floored mean of its parts. Tasks add up sums and counts, so a
round sends ``parts * entries`` rows a task, and only the codebooks are on the driver.

Orchard's search keeps for every entry the list of all entries by distance from it. It walks the list of the best entry so
far, measures entries not visited yet, jumps to the list of an entry that is better, and stops where the list is more
than twice the current distance away: nothing beyond can be as near. All parts of a table walk at the same time.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text, vectors

AT_ONCE = 20_000
LONGEST = 2 ** 63 - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


class Orchard:
    """Nearest entry of one codebook, ties to the lower index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.between = np.array([squared(book, entry) for entry in book], book.dtype).reshape(len(book), len(book))
        self.lists = np.argsort(self.between, axis=1, kind="stable")  # every list begins with the entry or one equal to it
        self.measured = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, entries = len(points), len(self.book)
        best = np.zeros(n, np.int64)
        distance = squared(points, self.book[0])
        visited = np.zeros((n, entries), bool)
        visited[:, 0] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        self.measured += n
        while len(walking):
            entry = self.lists[best[walking], place[walking]]
            stop = (self.between[best[walking], entry] > 4 * distance[walking]).astype(bool)  # these distances are squares
            walking, entry = walking[~stop], entry[~stop]
            place[walking] += 1
            new = ~visited[walking, entry]
            who, entry = walking[new], entry[new]
            visited[who, entry] = True
            self.measured += len(who)
            found = squared(points[who], self.book[entry])
            better = ((found < distance[who]) | ((found == distance[who]) & (entry < best[who]))).astype(bool)
            who, entry = who[better], entry[better]
            best[who], distance[who], place[who] = entry, found[better], 0
            walking = walking[place[walking] < entries]
        return best, distance


def assign(body: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, errors, values)``: the entry of every part, the squared distances added up, the vectors as used.

    Machine integers where no squared distance and no sum of a table can leave them, else Python's."""
    step, width = books[0].shape[1], sum(book.shape[1] for book in books)
    most = max([int(np.abs(body).max(initial=0))] + [int(np.abs(book).max(initial=0)) for book in books])
    if 4 * width * most ** 2 < 2 ** 62:
        values, books = body.astype(np.int64), [book.astype(np.int64) for book in books]
    else:
        values = big(body)
    codes, errors = np.zeros((len(body), len(books)), np.int64), np.zeros(len(body), values.dtype)
    for i, book in enumerate(books):
        codes[:, i], distance = Orchard(book).nearest(values[:, i * step:(i + 1) * step])
        errors = errors + distance
    return codes, errors, values


def big(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def first_books(rows: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The parts of the vectors of the ``entries`` smallest ids; of rows that repeat an id the least packed vector."""
    ids = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    longest = rows.agg(F.max(F.octet_length("vector"))).first()[0] or 0
    step = max(1, math.ceil(longest / 8 / parts))
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    if not found:
        return []
    body = vectors.matrix(pa.chunked_array([[bytes(r.vector) for r in found]]), step * parts)
    return [big(body[:, i * step:(i + 1) * step]) for i in range(parts)]


def next_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of its parts, unused entries stay."""
    step = books[0].shape[1]
    number = pa.decimal128(38, 0)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(number))])

    def add(batches):
        counts = [np.zeros(len(book), np.int64) for book in books]
        sums = [np.zeros(book.shape, object) for book in books]
        for table in vectors.in_tables(batches, AT_ONCE):
            codes, _, values = assign(vectors.matrix(table["vector"], step * len(books)), books)
            for i in range(len(books)):
                part = values[:, i * step:(i + 1) * step]
                for entry in np.unique(codes[:, i]).tolist():
                    own = codes[:, i] == entry
                    counts[i][entry] += own.sum()
                    sums[i][entry] += part[own].sum(axis=0).astype(object)
        rows = [(i, entry, int(n), [Decimal(int(x)) for x in sums[i][entry]])
                for i in range(len(books)) for entry, n in enumerate(counts[i].tolist()) if n]
        if rows:
            yield text.batch_of(rows, schema)

    part = rows.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(step)])
    out = [book.copy() for book in books]
    for r in total.collect():
        out[r.part][r.entry] = [int(r[3 + i]) // r.n for i in range(step)]
    return out


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """The codebooks of packed ``rows``, one array (entry, position) a part; none if no row has an id."""
    books = first_books(rows, entries, parts)
    for _ in range(rounds if books else 0):
        books = next_books(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` with their vector replaced by ``code``, two hex digits a part, and ``error``. An error of 2**63 or more
    counts as the largest long."""
    others = [c for c in rows.columns if c != "vector"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    width = sum(book.shape[1] for book in books)

    def write(batches):
        for table in vectors.in_tables(batches, AT_ONCE):
            codes, errors, _ = assign(vectors.matrix(table["vector"], width), books)
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            errors = errors if errors.dtype == np.int64 else np.array([min(int(x), LONGEST) for x in errors], np.int64)
            made = table.select(others).append_column("code", pa.array(digits, pa.string())).append_column("error", pa.array(errors))
            yield from made.combine_chunks().to_batches()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "code string, error long"])
    return rows.select(*[F.col(f"`{c}`") for c in others], "vector").mapInArrow(write, schema)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(rows: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error, label_error)`` for every row of ``rows(vec_id, label, vector)`` that counts, and the
    codebooks. ``label_error`` is the error of all rows of the label together, null labels being one.

    Rows whose vector is null or has a component that is null or not finite are left out. Rows without an id are coded,
    but start no codebook; of rows that repeat an id the least vector does, and all are coded. With fewer ids than
    ``entries`` the codebooks are that much smaller. Vectors are filled up with zeros to the longest one, and that to a
    multiple of ``parts``. At most 256 entries. An empty table gives no rows and no codebooks; so does one without ids.
    """
    spark = rows.sparkSession
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "vector")
    packed = text.stored(vectors.dealt(vectors.packed(named, scale), rows.count()), "vectors")
    books = train(packed, parts, entries, rounds)
    if not books:
        return spark.createDataFrame([], f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long, label_error long"), books
    coded = text.stored(encode(packed, books), "codes")
    # nulls are a group of their own; the flag keeps the key free of nulls
    keyed = coded.withColumn("unlabelled", F.col("label").isNull()).withColumn("of", F.coalesce(F.col("label").cast("string"), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    groups = text.stored(keyed.groupBy("unlabelled", "of").agg(
        F.count(F.lit(1)).alias("n"), F.least(total, F.lit(LONGEST)).cast("long").alias("label_error")), "label-errors")
    return text.join_groups(keyed, groups, ["unlabelled", "of"]).select("vec_id", "label", "code", "error", "label_error"), books
