"""Hard negatives by slot-decomposed selection.

For every anchor the best rows of its own label are its positives, and each positive asks for the best rows of other
labels whose score lies in a window below the positive's score. The windows of one anchor overlap. Their upper limits cut
the scores into disjoint slots; a window is what lies above its lower limit in its own slot and all slots below. So every
task keeps the best few rows per anchor and slot, equal slots of all tasks are combined to the best few again, and going
through an anchor's slots from the lowest up, the running best few answer one window after the other.

Anchors are a stated query set that meets all rows in blocks: a block of anchors of at most ``BLOCK_BYTES`` goes to all
tasks, each task goes through its rows a tile at a time, and the next block follows when the block's results are written.
Rows are never shuffled to meet anchors; only the best few of every task are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipewatch.llm import text, vectors

BLOCK_BYTES = 16 << 20
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 1024
NONE = -(2 ** 63)
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


class Best:
    """The first ``k`` rows, by score and then smaller id, of every (anchor, slot) seen so far."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.group, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(anchors * slots, NONE)  # below this score nothing can enter any more

    def add(self, group: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        fresh = score >= self.least[group]
        if not fresh.any():
            return
        group, score, vec = (np.concatenate([own, new[fresh]]) for own, new in
                             ((self.group, group), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, group))
        group = group[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        place = np.arange(len(group)) - np.repeat(starts, sizes)
        kept = order[place < self.k]
        self.group, self.score, self.vec = group[place < self.k], score[kept], vec[kept]
        full = place == self.k - 1
        self.least[group[full]] = score[order[full]]


def own_label(scores, tile, anchors, best: Best) -> None:
    """Candidates for positives: rows of the anchor's label other than the anchor."""
    allowed = (tile["label"][:, None] == anchors["label"]) & (tile["vec"][:, None] != anchors["vec"])
    scores = np.where(allowed, scores, NONE)
    k = min(best.k, len(scores))
    enough = np.maximum(np.partition(scores, len(scores) - k, axis=0)[len(scores) - k], best.least)
    row, anchor = np.nonzero(allowed & (scores >= enough))
    best.add(anchor, scores[row, anchor], tile["vec"][row])


def other_labels(scores, tile, anchors, best: Best) -> None:
    """Candidates for negatives: rows of other labels inside some window, each in the slot of the score."""
    inside = (scores <= anchors["upper"][:, 0]) & (scores >= anchors["lower"]) & (tile["label"][:, None] != anchors["label"])
    row, anchor = np.nonzero(inside)
    score = scores[row, anchor]
    slot = (anchors["upper"][anchor] >= score[:, None]).sum(axis=1) - 1
    best.add(anchor * best.slots + slot, score, tile["vec"][row])


def scan(rows: DataFrame, held: Broadcast, rule, slots: int, k: int) -> DataFrame:
    """The best ``k`` rows of every task per anchor and slot, for one block of anchors held by all tasks."""

    def each(batches):
        anchors = held.value
        n = len(anchors["vec"])
        parts = [slice(at, min(n, at + ANCHORS_AT_ONCE)) for at in range(0, n, ANCHORS_AT_ONCE)]
        pieces = [{name: values[part] for name, values in anchors.items()} for part in parts]
        state = [Best(len(piece["vec"]), slots, k) for piece in pieces]
        for table in vectors.in_tables(batches, ROWS_AT_ONCE):
            tile = {"vec": table["vec_id"].to_numpy(), "label": table["label"].to_numpy()}
            body = vectors.matrix(table["vector"])
            for piece, best in zip(pieces, state):
                rule(vectors.products(body, piece["vector"]), tile, piece, best)
        for piece, best in zip(pieces, state):
            yield pa.RecordBatch.from_arrays([
                pa.array(piece["vec"][best.group // slots]), pa.array((best.group % slots).astype(np.int32)),
                pa.array(best.score), pa.array(best.vec)], schema=FOUND)

    return rows.select("vec_id", "label", "vector").mapInArrow(each, "anchor_id long, slot int, score long, vec_id long")


def best_of_all(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` per anchor and slot over all tasks, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def limits(score: np.ndarray, percent: int) -> np.ndarray:
    """``floor(percent * score / 100)`` without overflow, for percents up to 100."""
    return score // 100 * percent + score % 100 * percent // 100


def answers(positives: list[tuple], slots: list[tuple], negatives: int, low: int) -> list[tuple]:
    """``(positive, rank, negative, positive_score, negative_score)`` of one anchor. ``positives`` are ``(rank, id, score)``,
    ``slots`` the best ``(slot, score, id)`` of every slot; slot ``i`` ends at the window of positive ``i``."""
    out, running = [], []
    for place in range(len(positives) - 1, -1, -1):
        _, positive, score = positives[place]
        running = sorted(running + [(-s, vec) for slot, s, vec in slots if slot == place])[:negatives]
        inside = [(-s, vec) for s, vec in running if 100 * -s >= low * score]
        out += [(positive, rank, vec, score, s) for rank, (s, vec) in enumerate(inside, 1)]
    return out


def hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has ``vec_id``, ``label`` (whole numbers) and ``vector``; ``anchors`` says by ``vec_id`` which rows are anchors.
    Of an anchor's other rows of its label the first ``positives`` count; for each, the first ``negatives`` rows of another
    label with ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned. First means higher
    score, then smaller id. Percents go up to 100.

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Of rows that
    repeat an id one takes part: that of the least label, then the least packed vector. Shorter vectors count as filled
    up with zeros. An empty table, or one without anchors, positives or rows in the windows, gives no rows. Scores
    are exact up to 2**62 and count as that beyond.
    """
    spark = rows.sparkSession
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
    single = (vectors.packed(named.where("vec_id IS NOT NULL AND label IS NOT NULL"), scale)
              .groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*"))
    every = text.stored(vectors.dealt(single, rows.count()), "vectors")
    chosen = every.where(anchors)
    weight = F.sum(F.octet_length("vector") + 128)
    blocks = math.ceil((chosen.agg(weight).first()[0] or 0) / BLOCK_BYTES)
    of_block = lambda frame, name, i: frame.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == i)
    out = None
    for i in range(blocks):
        table = of_block(chosen, "vec_id", i).select("vec_id", "label", "vector").toArrow()
        if not table.num_rows:
            continue
        block = {"vec": table["vec_id"].to_numpy(), "label": table["label"].to_numpy(), "vector": vectors.matrix(table["vector"])}
        held = spark.sparkContext.broadcast(block)
        near = text.stored(best_of_all(scan(every, held, own_label, 1, positives), positives), "positives")
        held.unpersist()
        windows = near.select("anchor_id", "rank", "score").toArrow()
        if not windows.num_rows:
            continue
        order = np.argsort(block["vec"])
        place = order[np.searchsorted(block["vec"], windows["anchor_id"].to_numpy(), sorter=order)]
        score, rank = windows["score"].to_numpy(), windows["rank"].to_numpy() - 1
        upper, lower = np.full((len(order), positives), NONE), np.full(len(order), 2 ** 63 - 1)
        upper[place, rank] = limits(score, high)
        np.minimum.at(lower, place, -limits(-score, low))
        some = upper[:, 0] > NONE
        block = {name: values[some] for name, values in (block | {"upper": upper, "lower": lower}).items()}
        held = spark.sparkContext.broadcast(block)
        slots = best_of_all(scan(every, held, other_labels, positives, negatives), negatives)
        part = text.stored(merged(near, slots, negatives, low), "hard-negatives")
        held.unpersist()
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], RESULT) if out is None else out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def merged(near: DataFrame, slots: DataFrame, negatives: int, low: int) -> DataFrame:
    """The windows of every anchor answered from its positives and the best of its slots, a few rows an anchor."""
    wanted = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    found = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("slots"))
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                        ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def answer(batches):
        rows = ((anchor, *row) for anchor, wants, has in text.rows_of(batches)
                for row in answers([tuple(x.values()) for x in wants], [tuple(x.values()) for x in has], negatives, low))
        yield from text.in_batches(rows, schema)

    return wanted.join(found, "anchor_id").mapInArrow(answer, RESULT)
