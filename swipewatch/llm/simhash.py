"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit per bit of the shingle hashes, set when more than half of the shingles set it.
To find all pairs within ``radius`` bits, every distinct fingerprint emits its variants, each variant is a
shuffle key, and fingerprints that meet on one are verified.

An even radius needs the variants within ``radius / 2``: two balls of half the radius meet exactly when the
centres are within the radius. An odd radius has one bit left over. The 64 bits are cut into ``blocks``; of any
pair that differs, some block holds a differing bit, and leaving that block out leaves at most ``radius - 1``
bits, an even number. So every fingerprint emits, for each block left out, the variants of the rest within
``(radius - 1) / 2``: 196 keys for radius 3 and four blocks, where whole fingerprints would need 2,081.

Large groups of near copies meet on the same keys. Their members differ from the key in at most one bit outside the block,
so for radius 3 the links of a meeting are found by looking up the 16 bits of the block in tables, with a number of
steps in proportion to the members; see ``_block_links``.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_AT_ONCE = 1 << 14  # hashes unpacked to bits at a time
_PAIRWISE = 64      # meetings of up to so many fingerprints are compared directly
_MATRIX = 1024       # and up to so many all at once
_PER_BUCKET = 600_000
_TASK_BYTES = 16 << 20  # of keys and fingerprints that a task emits or reads
_TASKS = 100_000        # as many as a scheduler should be given; beyond, tasks hold more buckets, not larger ones
_SLICE = 4_000_000


def fingerprint(body: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as an unsigned number. No word gives zero."""
    words = body.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[s:e], seed) for s, e in
                       zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at:at + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def with_fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc, tie, fp)``, the fingerprint as a signed long."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("fp", pa.int64())])

    def scan(batches):
        rows = ((doc, tie, fp - (1 << 64) if (fp := fingerprint(body, shingle, seed)) >> 63 else fp)
                for doc, tie, body in text.rows_of(batches))
        yield from text.in_batches(rows, schema)

    return text.keyed(docs).mapInArrow(scan, "doc long, tie long, fp long")


def ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks that flip at most ``radius`` of the bits."""
    return np.array([sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(bits, k)], np.uint64)


def block_masks(radius: int, blocks: int) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """For each way to leave a block out: mask of the bits kept, mark of the block, and the flips to emit."""
    if radius % 2 == 0:
        return [(np.uint64(2 ** 64 - 1), np.uint64(0), ball(list(range(64)), radius // 2))]
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for i in range(blocks):
        own = set(range(edges[i], edges[i + 1]))
        keep = [b for b in range(64) if b not in own]
        # the block's number stands where its bits were; buckets are kept apart by block as well
        out.append((np.uint64(sum(1 << b for b in keep)), np.uint64(i << edges[i]), ball(keep, radius // 2)))
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after joining the groups of ``a[i]`` and ``b[i]``; a group's label is its least member."""
    differ = label[a] != label[b]
    if not differ.any():
        return label
    node, root = text.spanning_links(label[a[differ]], label[b[differ]])
    moved = np.arange(len(label))
    moved[node] = root
    return moved[label]


def _block_links(members: np.ndarray, key: np.uint64, keep: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within 3 bits among the members of one meeting, for keys within one bit of the kept bits.

    A member is central if its kept bits are the key's and else off by one bit. Among members off by one, any two whose
    blocks differ in at most one bit are within the radius, and two that are further apart are within it only if they are
    off by the same bit, in which case they meet again as central members of another key. So it is enough to look up, in
    tables over the block's values: for every value with members off by one, the values one bit away; for every central
    member, members off by one within two bits and central ones within three."""
    block = ~int(keep) & (2 ** 64 - 1)
    shift, bits = (block & -block).bit_length() - 1, block.bit_count()
    value = (members >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    central = np.flatnonzero(((members ^ key) & keep) == 0)
    off = np.flatnonzero(((members ^ key) & keep) != 0)
    of_off, of_central = np.full(1 << bits, -1), np.full(1 << bits, -1)
    of_off[value[off]], of_central[value[central]] = off, central
    label = _union(np.arange(len(members)), off, of_off[value[off]])
    some = of_off[of_off >= 0]
    for who, table, reach in ((some, of_off, 1), (central, of_off, 2), (central, of_central, 3)):
        for flip in ball(list(range(bits)), reach).astype(np.int64).tolist():
            if not label.any():  # all are linked to the first
                break
            other = table[value[who] ^ flip]
            there = other >= 0
            label = _union(label, who[there], other[there])
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _matrix_links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a meeting of medium size, from the table of all its distances."""
    near = _distance(members[:, None], members) <= radius
    label = np.full(len(members), -1)
    for i in range(len(members)):
        edge = np.array([i]) if label[i] < 0 else np.zeros(0, np.int64)
        while len(edge):
            label[edge] = i
            edge = np.flatnonzero(near[edge].any(axis=0) & (label < 0))
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _ball_links(members: np.ndarray, radius: int, slices: int) -> tuple[list, list]:
    """Links of a large meeting for any radius: balls of both halves of the radius over whole fingerprints. A member of
    a near ball and every member of the far ball on the same variant are within the radius, so a link to the least near
    member loses none. Variants are taken in slices by a few parities of their bits: the parities of a variant are those
    of the member and the flip combined, so every slice makes its own variants only, and each is made once."""
    far = ball(list(range(64)), radius - radius // 2)
    n_near = len(ball(list(range(64)), radius // 2))  # the near ball comes first in the far one
    bits = max(0, slices - 1).bit_length()
    parities = text.mix(np.arange(1, bits + 1, dtype=np.uint64))

    def code(values):
        found = np.zeros(len(values), np.int64)
        for i, mask in enumerate(parities):
            found |= (np.bitwise_count(values & mask).astype(np.int64) & 1) << i
        return found

    def by_code(values):
        found = code(values)
        order = np.argsort(found, kind="stable")
        return np.split(order, np.searchsorted(found[order], np.arange(1, 1 << bits)))

    of_member, of_flip = by_code(members), by_code(far)
    left, right = [], []
    for part in range(1 << bits):
        keys, who, is_near = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for q, own in enumerate(of_member):
            flips = of_flip[part ^ q]
            if len(own) and len(flips):
                keys.append((members[own][:, None] ^ far[flips]).ravel())
                who.append(np.repeat(own, len(flips)))
                is_near.append(np.tile(flips < n_near, len(own)))
        keys, who, is_near = np.concatenate(keys), np.concatenate(who), np.concatenate(is_near)
        order = np.lexsort((~is_near, keys))
        keys, who, is_near = keys[order], who[order], is_near[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        head = np.repeat(first, np.diff(np.append(first, len(keys))))
        linked = is_near[head] & (who != who[head])
        a, b = text.spanning_links(members[who[linked]], members[who[head[linked]]])
        left.append(a)
        right.append(b)
    return left, right


def meet(keys: np.ndarray, prints: np.ndarray, radius: int, keep: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints that share a key, reduced to spanning links. ``keep`` are the bits of the keys
    that are of the fingerprints, where a block was left out."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[fresh], prints[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat((sizes > 1) & (sizes <= _PAIRWISE), sizes)
    k, p = keys[small], prints[small]
    for step in range(1, min(_PAIRWISE, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        near = same[_distance(p[same], p[same + step]) <= radius]
        if len(near):
            a, b = text.spanning_links(p[near], p[near + step])
            left.append(a)
            right.append(b)
    for i in np.flatnonzero(sizes > _PAIRWISE).tolist():
        members = prints[starts[i]:starts[i] + sizes[i]]
        if len(members) <= _MATRIX:
            a, b = _matrix_links(members, radius)
            left.append(a)
            right.append(b)
        elif radius == 3 and keep is not None and 64 - int(keep).bit_count() <= 20:
            a, b = _block_links(members, keys[starts[i]], keep)
            left.append(a)
            right.append(b)
        else:
            a, b = _ball_links(members, radius, max(1, len(members) * 2081 // _SLICE))
            left += a
            right += b
    return text.spanning_links(np.concatenate(left), np.concatenate(right))


def links(prints: DataFrame, radius: int = 3, blocks: int = 4, n: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` of the distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    masks = block_masks(radius, blocks)
    emitted = sum(len(flips) for _, _, flips in masks)
    n = prints.count() if n is None else n
    n_buckets = text.buckets_for(n * emitted / len(masks), _PER_BUCKET)
    # keys are 196 times the fingerprints, so neither the scan's tasks nor the usual number of readers would do
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, min(_TASKS, math.ceil(n * emitted * 16 / _TASK_BYTES)))
    packed = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary())])
    at_once = max(1, 500_000 // emitted)

    def emit(batches):
        def packs(fps):
            keys = np.concatenate([(((fps & keep)[:, None] ^ flips) | mark).ravel() for keep, mark, flips in masks])
            who = np.concatenate([np.repeat(fps, len(flips)) for _, _, flips in masks])
            block = np.repeat(np.arange(len(masks)), [len(fps) * len(flips) for _, _, flips in masks])
            bucket = (text.mix(keys) % np.uint64(n_buckets)).astype(np.int64) + block * n_buckets
            order = np.lexsort((keys, bucket))
            keys, who, bucket = keys[order], who[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cuts[1:], len(bucket))
            rows = [(int(bucket[s]), keys[s:e].tobytes(), who[s:e].tobytes()) for s, e in zip(cuts.tolist(), ends.tolist())]
            yield from text.in_batches(iter(rows), packed, 500)

        held, count = [], 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), at_once):
                part = fps[at:at + at_once]
                if count + len(part) > at_once and count:
                    yield from packs(np.concatenate(held))
                    held, count = [], 0
                held.append(part)
                count += len(part)
        if count:
            yield from packs(np.concatenate(held))

    def verify(pack: pa.Table) -> pa.Table:
        read = lambda name: np.concatenate([np.frombuffer(x, np.uint64) for x in pack[name].to_pylist()])
        keep = masks[pack["bucket"][0].as_py() // n_buckets][0] if len(masks) > 1 else None
        a, b = meet(read("keys"), read("prints"), radius, keep)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    pieces = prints.select("fp").repartition(tasks, "fp").mapInArrow(emit, "bucket long, keys binary, prints binary")
    return pieces.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 4, seed: int = 42) -> DataFrame:
    """``(doc, tie, fp, component_id)``: least ``doc`` reachable over links of at most ``radius`` bits.

    Equal fingerprints are merged first, so a group of exact copies costs one fingerprint however large it is.
    Null texts count as empty; all texts without a word share fingerprint zero and are linked by it. A null id is
    the least id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    each = text.stored(with_fingerprint(docs, shingle, seed), "fingerprints")
    prints = text.stored(each.groupBy("fp").agg(F.min("doc").alias("least")), "distinct-fingerprints")
    found = text.components(links(prints, radius, blocks, prints.count()), "fingerprint-links")
    grouped = prints.join(found, prints.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    # written and read again, so that the join below is split where one fingerprint holds very many rows
    of_print = text.stored(grouped.join(lowest, "root").select("fp", "component_id"), "fingerprint-components")
    text.free_shuffles(spark)
    return each.join(of_print, "fp").select("doc", "tie", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document kept of each group: that with the least id (ties: the least text hash,
    then one of the equal rows). Columns as they came; rows with a null id count as the least id."""
    groups = simhash_groups(docs, shingle, radius, blocks)
    rows = groups.groupBy("component_id", "doc", "tie").agg(F.count(F.lit(1)).alias("n"))
    chosen = rows.groupBy("component_id").agg(F.min(F.struct("doc", "tie", "n")).alias("best"))
    chosen = text.stored(chosen.select("best.*"), "kept-documents")
    marked = docs.select(F.struct("*").alias("row"), text.doc_id().alias("doc"),
                         F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    pick = lambda which: marked.join(chosen.where(which), ["doc", "tie"], "left_semi")
    # only where the chosen row itself is repeated do rows have to be compared
    return pick("n = 1").unionAll(pick("n > 1").dropDuplicates(["doc", "tie"])).select("row.*")
