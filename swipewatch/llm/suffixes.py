"""Removal of repeated byte strings with suffix arrays built by the difference-cover algorithm.

Equal strings of ``width`` bytes have equal minimisers, so suffixes are first dealt to buckets as super-k-mers (see
``superkmers``): each bucket holds every suffix that can match another one of it, in strings just long enough. A
bucket's suffix array is built with the difference cover {1, 2} modulo 3: the triples at the sampled two thirds of all
positions are sorted and named, the string of names is solved in the same way until names are unique, the remaining
suffixes are sorted by their first byte and the rank behind it, and both orders are merged. Neighbours in the array
whose first ``width`` bytes agree are the repeated strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from swipewatch.llm import text
from swipewatch.llm.superkmers import covered, merge_runs, repeated_windows, with_runs

_ROWS = 1 << 16  # neighbours compared at a time


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers."""
    n = len(values)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: values[i:].tolist()), np.int64)
    kind = np.int32 if n < 2 ** 31 - 8 and values.max() < 2 ** 31 else np.int64  # half the memory to gather from
    s = np.concatenate([values.astype(kind), np.zeros(4, kind)])
    at = np.arange(n + (n % 3 == 1), dtype=kind)  # one sampled triple more, so that every remaining suffix has a rank behind it
    ones, twos = at[1::3], at[2::3]
    sample = np.concatenate([ones, twos])
    order, differs = _order([s[sample + k] for k in range(3)])
    fresh = np.ones(len(order), bool)
    fresh[1:] = differs
    names = np.empty(len(sample), kind)
    names[order] = np.cumsum(fresh)
    solved = order if fresh.all() else suffix_array(names)
    rank = np.zeros(n + 4, kind)
    sampled = sample[solved]
    rank[sampled] = np.arange(1, len(sample) + 1, dtype=kind)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3, dtype=kind)
    rest = rest[_order([s[rest], rank[rest + 1]])[0]]
    # a remaining suffix compares with a sampled one by one or two values and the sampled rank behind them
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = _below([s[first], rank[first + 1]], [s[rest], rank[rest + 1]])
    below += _below([s[second], s[second + 1], rank[second + 2]], [s[rest], s[rest + 1], rank[rest + 2]])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    own = np.arange(len(rest)) + below
    out[own], taken[own] = rest, True
    out[~taken] = sampled
    return out


def _keys(columns: list[np.ndarray], others: list[np.ndarray] | None = None) -> list[np.ndarray] | None:
    """Columns as one integer that sorts like them; None if that takes more than 63 bits."""
    sizes = [int(max(c.max(initial=0), o.max(initial=0))) + 1 for c, o in zip(columns, others or columns)]
    if np.prod([float(x) for x in sizes]) >= 2.0 ** 62:
        return None
    out = []
    for group in (columns, others) if others else (columns,):
        key = group[0].astype(np.int64)
        for column, size in zip(group[1:], sizes[1:]):
            key *= size
            key += column
        out.append(key)
    return out


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows in sorted order, and where a row differs from the one before it."""
    keys = _keys(columns)
    if keys is None:
        order = np.lexsort(columns[::-1])
        return order, np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    order = np.argsort(keys[0])
    key = keys[0][order]
    return order, key[1:] != key[:-1]


def _below(sorted_columns: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """For each row of ``columns``, how many rows of ``sorted_columns`` come before it."""
    keys = _keys(sorted_columns, columns)
    if keys is not None:
        return np.searchsorted(keys[0], keys[1])
    n = len(sorted_columns[0])
    order = np.lexsort([np.concatenate([a, b]) for a, b in zip(sorted_columns, columns)][::-1])
    seen = np.cumsum(order < n)
    out = np.empty(len(order), np.int64)
    out[order] = seen
    return out[n:]


class Bytes:
    """Windows of ``width`` bytes; a minimiser is a gram of ``gram`` bytes."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, min(gram, width)

    def hashes(self, body: bytes) -> np.ndarray:
        return text.gram_hashes(np.frombuffer(body, np.uint8), self.gram) >> np.uint64(1)

    def layout(self, body: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        at = np.arange(len(body) + 1)
        return body, at[:-1], at[1:]

    def core(self, key: bytes, n: int) -> bytes:
        return key[n - 1:self.width] if n <= self.width - self.gram + 1 else b""

    def after(self, key: bytes, n: int) -> int:
        return n

    def settle(self, places: np.ndarray, sizes: np.ndarray, body: bytes) -> np.ndarray:
        """Runs of windows that also start earlier, among strings at ``places`` laid out one after the other."""
        width = self.width
        values = np.frombuffer(body, np.uint8)
        ends = np.cumsum(sizes)
        array = suffix_array(values.astype(np.int64) + 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        array = array[array + width <= ends[owner[array]]]  # suffixes that hold a whole window of their string
        if not len(array):
            return np.zeros((0, 4), np.int64)
        strings = np.lib.stride_tricks.sliding_window_view(values, width)
        same = np.zeros(len(array), bool)
        for i in range(1, len(array), _ROWS):
            j = min(i + _ROWS, len(array))
            same[i:j] = (strings[array[i:j]] == strings[array[i - 1:j - 1]]).all(axis=1)
        group = np.cumsum(~same)
        owner = owner[array]
        doc, tie = places[owner, 0], places[owner, 1]
        start = places[owner, 2] + array - (ends - sizes)[owner]
        order = np.lexsort((start, tie, doc, group))
        group, doc, tie, start = group[order], doc[order], tie[order], start[order]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = np.repeat(heads, np.diff(np.append(heads, len(group))))
        later = (doc != doc[head]) | (tie != tie[head]) | (start != start[head])
        return merge_runs(np.column_stack([doc, tie, start, np.ones(len(doc), np.int64)])[later])


def drop_repeats(docs: DataFrame, width: int = 100, gram: int = 16) -> DataFrame:
    """``(doc, n_bytes, n_removed, n_spans, kept)``: the UTF-8 bytes left after removing each byte of a string of
    ``width`` bytes that also starts earlier, and the number of maximal removed runs.

    A null text has no bytes; texts shorter than ``width`` lose none. A row that repeats another one in id and text is
    judged like it. An empty table gives no rows."""

    def cut(doc, tie, body, runs):
        gone = covered(len(body), runs, width - 1)
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        return doc, len(body), int(gone.sum()), spans, np.frombuffer(body, np.uint8)[~gone].tobytes()

    return with_runs(docs, repeated_windows(docs, Bytes(width, gram)), cut,
                     "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
