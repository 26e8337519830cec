"""Removal of repeated passages: windows of words, partitioned by minimiser into super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the least hash among its grams of ``gram`` words, so windows
with equal words have equal minimisers, and neighbouring windows mostly share one. Each run of windows with one
minimiser travels as one packed string to the minimiser's bucket; there the windows are unpacked, sorted, and
compared word for word. Grams that hold a large part of all grams are ranked last as minimisers, so common phrases do
not gather in one bucket; and a packed string that occurs again within the same chunk of a task is settled on the
spot and does not travel, so a passage copied without bound costs a bucket one string for each chunk at most.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

_CHUNK = 6 << 20       # bytes of text settled together in a task
_BUCKET = 10 << 20      # bytes of packed strings in a bucket
_HEAVY = 2_000          # a gram with more than one of so many of all grams ranks last
_COMPARED = 16          # strings of one minimiser that are searched for each other's core
_LAST = np.uint64(1 << 63)
_RUN = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


class Words:
    """Windows of ``width`` words; a minimiser is a gram of ``gram`` words."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, min(gram, width)

    def hashes(self, body: bytes) -> np.ndarray:
        """Hashes of all grams, below 2**63."""
        return text.gram_hashes(text.word_hashes(body, *text.word_spans(body)), self.gram) >> np.uint64(1)

    def layout(self, body: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The form in which windows travel, and where each unit starts and ends in it."""
        starts, ends = text.word_spans(body)
        lengths = ends - starts
        ends = np.cumsum(lengths + 1) - 1
        return b" ".join(body.split()), ends - lengths, ends

    def core(self, key: bytes, n: int) -> bytes:
        """What all ``n`` windows of a string hold in the middle; empty if they have no gram in common."""
        return b" ".join(key.split(b" ")[n - 1:self.width]) if n <= self.width - self.gram + 1 else b""

    def after(self, key: bytes, n: int) -> int:
        """Where a second copy of the core could begin at the earliest."""
        return len(b" ".join(key.split(b" ")[:n])) + 1

    def settle(self, places: np.ndarray, sizes: np.ndarray, body: bytes) -> np.ndarray:
        return _settle(places, sizes, body, self.width)


def heavy_grams(docs: DataFrame, windows, share: int = _HEAVY) -> tuple[np.ndarray, int]:
    """Hashes of the likely minimisers (grams in the lowest sixteenth) that make up more than one in ``share`` of all
    such grams, at most ``share`` of them, and the bytes of text. Each task counts chunk by chunk and reports what is
    heavy in a chunk; a gram that is heavy overall is so in some chunk. This steers balance only, never the result."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held, size, total, seen = [], 0, 0, 0

        def report():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            chosen = n * share > size
            yield from text.in_batches(zip(values[chosen].astype(np.int64).tolist(), n[chosen].tolist()), schema)

        for (body,) in text.rows_of(batches):
            found = windows.hashes(body)
            found = found[found < _LAST >> np.uint64(4)]
            total, seen = total + len(body), seen + len(found)
            held.append(found)
            size += len(found)
            if size > 1 << 19:
                yield from report()
                held, size = [], 0
        if size:
            yield from report()
        yield text.batch_of([(-1, total), (-2, seen)], schema)

    counted = text.keyed(docs).select("body").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = text.stored(counted, "heavy-grams")
    size = {r.gram: r.n for r in counted.where("gram < 0").collect()}
    chosen = counted.where(F.col("gram") >= 0).where(F.col("n") * share > size.get(-2, 0)).limit(share).collect()
    text.discard(counted)
    return np.sort(np.array([r.gram for r in chosen], np.uint64)), size.get(-1, 0)


def super_kmers(body: bytes, windows, heavy: np.ndarray):
    """``(minimisers, first window, number of windows, travelling form, unit starts, unit ends)`` of a text."""
    hashes = windows.hashes(body)
    n = len(hashes) + windows.gram - windows.width
    if n <= 0:
        return None
    if len(heavy):
        place = np.searchsorted(heavy, hashes).clip(max=len(heavy) - 1)
        hashes = np.where(heavy[place] == hashes, hashes | _LAST, hashes)
    least = text.sliding_min(hashes, windows.width - windows.gram + 1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return (least[cut], cut, np.diff(np.append(cut, n)), *windows.layout(body))


def merge_runs(runs: np.ndarray) -> np.ndarray:
    """Rows ``(doc, tie, start, n)`` with touching or overlapping runs of a document joined."""
    if not len(runs):
        return runs.reshape(0, 4)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    stop = runs[:, 2] + runs[:, 3]
    fresh = np.ones(len(runs), bool)
    same = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    fresh[1:] = ~same | (runs[1:, 2] > stop[:-1])
    first = np.flatnonzero(fresh)
    out = runs[first]
    out[:, 3] = np.maximum.reduceat(stop, first) - out[:, 2]
    return out


def _pack(keys: list[bytes], places: list[tuple[int, int, int, int, int]]) -> bytes:
    """Strings with ``(doc, tie, start, windows, minimiser)`` of each, column by column. Of a minimiser 32 bits are
    enough: it only tells apart the strings of one bucket that cannot match."""
    doc, tie, start, n, least = np.array(places, np.int64).T
    columns = [np.diff(doc, prepend=0), tie, start, n.astype(np.uint32), (least >> 20).astype(np.uint32),
               np.fromiter(map(len, keys), np.uint32, len(keys))]
    return zstandard.ZstdCompressor(level=6).compress(
        b"".join([np.array([len(keys)], np.int64).tobytes(), *(c.tobytes() for c in columns), *keys]))


def _unpack(blob: bytes) -> tuple[list[tuple], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    columns, at = [], 8
    for kind in (np.int64, np.int64, np.int64, np.uint32, np.uint32, np.uint32):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    doc, tie, start, windows, least, sizes = columns
    ends = at + np.cumsum(sizes, dtype=np.int64)
    places = zip(*(c.tolist() for c in (np.cumsum(doc), tie, start, windows, least)))
    return list(places), [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _shared(blobs: list[bytes], windows) -> tuple[list[tuple], list[bytes], list[tuple]]:
    """The strings of a bucket whose windows may be found again, one of each text, and the runs of the strings that
    repeat another one as a whole.

    A window that is found twice holds the core of both strings it lies in. So a string is done with if its minimiser
    has no other string, or few others and none of them holds its core, unless its core comes twice in itself."""
    places, keys = [], []
    for blob in blobs:
        p, k = _unpack(blob)
        places += p
        keys += k
    counts = Counter(p[4] for p in places)
    first: dict[bytes, tuple] = {}
    settled = []
    for place, key in zip(places, keys):
        if counts[place[4]] == 1 and not _repeats(key, place[3], windows):
            continue
        other = first.get(key)
        if other is None:
            first[key] = place
        elif place[:3] < other[:3]:
            settled.append(other[:4])
            first[key] = place
        elif place[:3] != other[:3]:
            settled.append(place[:4])
    groups: dict[int, list[bytes]] = {}
    for key, place in first.items():
        groups.setdefault(place[4], []).append(key)
    chosen = []
    for group in groups.values():
        if len(group) > _COMPARED:
            chosen += group
            continue
        for key in group:
            core = windows.core(key, first[key][3])
            if not core or any(core in other for other in group if other is not key) or _repeats(key, first[key][3], windows):
                chosen.append(key)
    return [first[k] for k in chosen], chosen, settled


def _repeats(key: bytes, n: int, windows) -> bool:
    core = windows.core(key, n)
    return not core or key.find(core, windows.after(key, n)) >= 0


def _settle(places: np.ndarray, sizes: np.ndarray, body: bytes, width: int) -> np.ndarray:
    """Runs of windows that also start earlier, among packed strings at ``places`` laid out one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first_byte = np.zeros(len(body), bool)
    first_byte[offsets] = True
    space = text._SPACE[np.frombuffer(body, np.uint8)]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & (before | first_byte))  # strings follow each other without a space
    after = np.concatenate([space[1:] | first_byte[1:], [True]])
    ends = np.flatnonzero(~space & after) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = text.word_hashes(body, starts, ends)
    at = np.flatnonzero(owner[width - 1:] == owner[:len(owner) - width + 1])  # words that begin a window
    if not len(at):
        return np.zeros((0, 4), np.int64)
    hashes = text.span_hashes(words, at, at + width)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    again = hashes[1:] == hashes[:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= again
    shared[:-1] |= again
    window, hashes = at[order[shared]], hashes[shared]
    if not len(window):
        return np.zeros((0, 4), np.int64)
    first_word = np.searchsorted(owner, np.arange(len(sizes)))
    owners = owner[window]
    doc, tie = places[owners, 0], places[owners, 1]
    position = places[owners, 2] + window - first_word[owners]
    order = np.lexsort((position, tie, doc, hashes))
    window, hashes, doc, tie, position = (x[order] for x in (window, hashes, doc, tie, position))
    left, right = starts[window].tolist(), ends[window + width - 1].tolist()
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])).tolist()
    later = np.zeros(len(window), bool)
    for h, stop in zip(heads, [*heads[1:], len(window)]):
        content = body[left[h]:right[h]]
        here = (doc[h], tie[h], position[h])
        firsts = {content: here}
        for i in range(h + 1, stop):
            other = body[left[i]:right[i]]
            if other != content:  # same hash, other words
                here_too = firsts.setdefault(other, (doc[i], tie[i], position[i]))
                later[i] = here_too != (doc[i], tie[i], position[i])
            else:
                later[i] = True
        same = np.arange(h + 1, stop)
        same = same[(doc[same] == here[0]) & (tie[same] == here[1]) & (position[same] == here[2])]
        later[same] = False  # a repeated row stands at the same place as its twin
    return merge_runs(np.column_stack([doc, tie, position, np.ones(len(doc), np.int64)])[later])


def repeated_windows(docs: DataFrame, windows) -> DataFrame:
    """``(doc, tie, start, n)``: runs of ``n`` windows from unit ``start`` whose content also starts earlier, in a
    smaller document or earlier in the same one. Runs may touch or overlap."""
    heavy, size = heavy_grams(docs, windows)
    n_buckets = text.buckets_for(3 * size, _BUCKET)
    packed = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("runs", pa.binary())])
    width = windows.width

    def split(batches):
        seen: dict[bytes, tuple] = {}
        settled, held = [], 0

        def flush():
            keys, places = list(seen), list(seen.values())
            minimisers = np.fromiter((p[4] for p in places), np.int64, len(places)).view(np.uint64)
            bucket = (text.mix(minimisers) % np.uint64(n_buckets)).astype(np.int64)
            docs = np.fromiter((p[0] for p in places), np.int64, len(places))
            order = np.lexsort((docs, bucket))  # neighbours by document compress best
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(order)]):
                chosen = order[s:e].tolist()
                yield int(bucket[order[s]]), _pack([keys[i] for i in chosen], [places[i] for i in chosen]), None
            if settled:
                runs = merge_runs(np.array(settled, np.int64))
                yield int(runs[0, 0] % n_buckets), None, runs.tobytes()

        for doc, tie, body in text.rows_of(batches):
            found = super_kmers(body, windows, heavy)
            if found is not None:
                minimisers, first, counts, form, starts, ends = found
                cuts = zip(starts[first].tolist(), ends[first + counts + width - 2].tolist())
                for (a, b), least, start, n in zip(cuts, minimisers.view(np.int64).tolist(), first.tolist(), counts.tolist()):
                    key, place = form[a:b], (doc, tie, start, n, least)
                    other = seen.get(key)
                    if other is None:
                        seen[key] = place
                    elif place[:3] < other[:3]:
                        settled.append(other[:4])
                        seen[key] = place
                    elif place[:3] != other[:3]:
                        settled.append(place[:4])
            held += len(body)
            if held > _CHUNK:
                yield from text.in_batches(flush(), packed, 64)
                seen, settled, held = {}, [], 0
        yield from text.in_batches(flush(), packed, 64)

    def count(pack: pa.Table) -> pa.Table:
        places, keys, settled = _shared([b for b in pack["blob"].to_pylist() if b is not None], windows)
        runs = [np.frombuffer(r, np.int64).reshape(-1, 4) for r in pack["runs"].to_pylist() if r is not None]
        runs.append(np.array(settled, np.int64).reshape(-1, 4))
        if keys:
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            runs.append(windows.settle(np.array(places, np.int64)[:, :3], sizes, b"".join(keys)))
        return pa.Table.from_arrays([pa.array(c) for c in merge_runs(np.concatenate(runs)).T], schema=_RUN)

    pieces = text.keyed(docs).mapInArrow(split, "bucket long, blob binary, runs binary")
    return pieces.groupBy("bucket").applyInArrow(count, "doc long, tie long, start long, n long")


def with_runs(docs: DataFrame, runs: DataFrame, apply, ddl: str) -> DataFrame:
    """``apply(doc, tie, body, runs)`` for every row of ``docs`` with the runs of its document: rows of ``ddl``.

    Texts are compressed before they are shuffled. Runs of a document are at most as many as its words."""
    shape = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("body", pa.binary())])

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=3)
        yield from text.in_batches(((d, t, press.compress(b)) for d, t, b in text.rows_of(batches)), shape, 500)

    by_doc = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    small = text.keyed(docs).mapInArrow(squeeze, "doc long, tie long, body binary")
    joined = small.join(by_doc, ["doc", "tie"], "left").select("doc", "tie", "body", "runs")

    def rows(batches):
        expand = zstandard.ZstdDecompressor()
        for doc, tie, body, found in text.rows_of(batches):
            at = np.array([(r["start"], r["n"]) for r in found or ()], np.int64).reshape(-1, 2)
            yield apply(doc, tie, expand.decompress(body) if body else b"", at)

    names = [part.strip().split(" ") for part in ddl.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in names])
    return joined.mapInArrow(lambda batches: text.in_batches(rows(batches), schema, 500), ddl)


def covered(n: int, runs: np.ndarray, reach: int) -> np.ndarray:
    """Which of ``n`` places lie in ``[start, start + runs + reach)`` of some run."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, np.minimum(runs[:, 0] + runs[:, 1] + reach, n), -1)
    return np.cumsum(steps[:n]) > 0


def drop_repeats(docs: DataFrame, width: int = 20, gram: int = 5) -> DataFrame:
    """``(doc, n_words, n_removed, kept)``: words left after removing each word of a window that also starts earlier.

    ``kept`` holds the words that stay, joined by one space. A null text has no words; texts shorter than a window
    lose none. A row that repeats another one in id and text is judged like it. An empty table gives no rows."""

    def cut(doc, tie, body, runs):
        words = body.split()
        gone = covered(len(words), runs, width - 1)
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
        return doc, len(words), int(gone.sum()), b" ".join(kept)

    return with_runs(docs, repeated_windows(docs, Words(width, gram)), cut, "doc long, n_words long, n_removed long, kept binary")
