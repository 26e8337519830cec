"""Helpers shared by the corpus operators: word splitting, intermediate tables, row keys, components.

Rows are judged under a key of two longs, ``(doc_id, hash of the text)``: rows that repeat a
``doc_id`` with another text are ordered by that hash, and rows equal in both are judged alike.
A null ``doc_id`` counts as the smallest id, a null text as the empty one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST = -(2 ** 63)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # the white space of the word pattern
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2 ** 64))


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings of the operators: UTC, and Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- intermediate tables in the shared folder -------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may do without the setting, as in tests; it uses the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-scratch"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: lineage ends here, and no executor holds the only copy."""
    spark, path = frame.sparkSession, new_path(frame.sparkSession, label)
    frame.write.parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "_stored_at", None):
            jvm = frame.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files of finished jobs now rather than at some later collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def input_bytes(frame: DataFrame) -> int:
    """Size of the plan's input as Spark's own statistics give it, without running a job."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(size: float, each: float) -> int:
    return max(8, math.ceil(size / each))


# --- rows and keys ----------------------------------------------------------------------------------

def doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))


def text_bytes() -> Column:
    return F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc, tie, body)``: id, hash of the text, and the text as UTF-8 bytes."""
    return docs.select(doc_id().alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
                       text_bytes().alias("body"))


def shown_id(name: str = "doc") -> Column:
    """The id of a keyed row as the table has it."""
    return F.when(F.col(name) != LOWEST, F.col(name)).alias("doc_id")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per ``keys`` and the number ``n`` of rows behind it.

    A group that holds at least one in ``most`` of all rows is joined by broadcast: there are ``most`` of them at the
    utmost, and their rows stay where they are. No other group can be large, so the rest is an ordinary join.
    ``groups`` should be a stored table, keys without nulls.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * F.lit(most) >= F.lit(total)
    large = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(groups.where(~hot), keys))


# --- words as arrays --------------------------------------------------------------------------------

def word_spans(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words ``[^\\x20\\x09-\\x0D]+``: starts and ends."""
    space = np.ones(len(body) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(body, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        factor = out[done - 1:done] * base
        out[done:done + more] = out[:more] * factor
        done += more
    return out


_POWER = [_powers(_BASE, 1 << 12)]
_UNPOWER = [_powers(_INVERSE, 1 << 12)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER[0]) < n:
        _POWER[0], _UNPOWER[0] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POWER[0], _UNPOWER[0]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values ^ (values >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each span. It steers work only; equality is settled on the values."""
    n = len(values)
    power, unpower = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * unpower[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, unpower = _tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:len(values)], out=total[1:])
    sums = total[width:] - total[:n]
    sums *= unpower[:n]
    sums += np.uint64(width * 0xD6E8FEB86659FD93 & (2 ** 64 - 1))
    return mix(sums)


def word_hashes(body: bytes, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """The hash of every word. Long texts are taken in blocks, so that the sums of few bytes are held at a time."""
    values, out, at = np.frombuffer(body, np.uint8), [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, first + block, "right")))
        out.append(span_hashes(values[first:int(ends[stop - 1])], starts[at:stop] - first, ends[at:stop] - first))
        at = stop
    return np.concatenate(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in about log(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


# --- connected components ---------------------------------------------------------------------------

def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links ``a[i] - b[i]`` reduced to one link from every node to the least node of its group."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        if (label[left] == low).all() and (label[right] == low).all():
            break
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the least node of its component.

    Alternating star contraction: every round points neighbours at the least node they know. Minima combine
    before the shuffle and joins back are plain equi-joins, so a node with very many links is split by
    adaptive execution. Each round ends in a table of the shared folder.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), label)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
                       .distinct(), label)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
                             F.col("low").alias("b"))
        after = stored(small.where("a <> b").distinct(), label)
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(edges, large)
        edges = after
        if tuple(seen) == before:
            break
        before = tuple(seen)
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
