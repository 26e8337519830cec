"""Quality rules: gradient-boosted trees over document statistics.

Four base rules are counted for every document, a few ratios are added, and boosted trees fitted to labelled
documents give the verdict. Trees are grown on a bounded sample (``max_labelled`` rows, those with the least hash of
``doc_id``), on statistics cut into at most 32 bins, and flattened into numpy node arrays: every tree is a complete
binary tree, so a batch is scored by ``depth`` gathers per tree. Chosen statistics are monotone: a split whose sides
would run against the constraint is refused, and each side keeps to its half of the allowed range.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics in order, with the direction in which quality may change as they grow (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1,
    "digit_rate": 0, "bang_rate": -1, "comma_stop_rate": 0, "distinct_rate": 0, "top_word_rate": -1,
    "mean_line_words": 0, "short_line_rate": 0, "longest_word": 0, "other_letter_rate": 0,
}


@dataclass(frozen=True)
class QualityConfig:
    max_labelled: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    min_rows: float = 10
    l2: float = 1.0
    threshold: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def statistics(body: bytes) -> tuple[tuple, list[float]]:
    """The base counts and the statistics the trees see."""
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    lines = [line for line in body.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    triples = list(zip(words, words[1:], words[2:]))
    seen = Counter(triples)
    repeated = 0
    if len(seen) < len(triples):
        mark = bytearray(n)
        for i, triple in enumerate(triples):
            if seen[triple] > 1:
                mark[i] = mark[i + 1] = mark[i + 2] = 1
        repeated = sum(mark)
    kinds = Counter(words)
    size, words_or_1, lines_or_1 = max(1, len(joined)), max(1, n), max(1, len(lines))
    code = np.bincount(np.frombuffer(joined, np.uint8), minlength=256) if joined else np.zeros(256, np.int64)
    return (n, chars, symbols, dup_lines, repeated), [
        float(np.log1p(n)), chars / words_or_1, symbols / words_or_1, dup_lines / lines_or_1, repeated / words_or_1,
        float(code[65:91].sum()) / size, float(code[48:58].sum()) / size, float(code[33]) / words_or_1,
        float(code[44] + code[46]) / words_or_1, len(kinds) / words_or_1, max(kinds.values(), default=0) / words_or_1,
        n / lines_or_1, sum(len(line) < 20 for line in lines) / lines_or_1, float(max(map(len, words), default=0)),
        float(code[128:].sum()) / size]


# --- boosted trees ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Node arrays of complete trees: row t, node i has children 2i+1 (at most the cut) and 2i+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray    # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, cfg: QualityConfig, direction: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1 under logistic loss with monotone directions."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    inner, leaves = 2 ** cfg.depth - 1, 2 ** cfg.depth
    features, cuts, values = [], [], []
    total = np.full(len(y), start)
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        nodes = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for node in range(inner):
            rows, low, high = nodes.pop(node)
            best = _split(binned[rows], grad[rows], hess[rows], edges, cfg, direction, low, high) if len(rows) else None
            if best is None:  # everything goes left; the right side stands for no row
                nodes[2 * node + 1], nodes[2 * node + 2] = (rows, low, high), (rows[:0], low, high)
                continue
            f, b, left, right = best
            feature[node], cut[node] = f, edges[f][b]
            goes = binned[rows, f] <= b
            middle = (left + right) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (l_low, l_high), (r_low, r_high) = bounds[int(direction[f])]
            nodes[2 * node + 1], nodes[2 * node + 2] = (rows[goes], l_low, l_high), (rows[~goes], r_low, r_high)
        for node, (rows, low, high) in nodes.items():
            weight = _weight(grad[rows].sum(), hess[rows].sum(), cfg, low, high)
            value[node - inner] = cfg.rate * weight
            total[rows] += cfg.rate * weight
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(start, np.array(features), np.array(cuts), np.array(values))


def _weight(grad, hess, cfg, low, high):
    return np.clip(-grad / (hess + cfg.l2), low, high)


def _split(binned, grad, hess, edges, cfg, direction, low, high):
    """``(feature, bin, left weight, right weight)`` of the best allowed split, or None."""
    gain = lambda w, g, h: -(2 * g * w + (h + cfg.l2) * w * w)
    all_g, all_h = grad.sum(), hess.sum()
    floor = gain(_weight(all_g, all_h, cfg, low, high), all_g, all_h) + 1e-6
    best = None
    for f, e in enumerate(edges):
        if not len(e):
            continue
        size = len(e) + 1
        g = np.cumsum(np.bincount(binned[:, f], grad, size))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], hess, size))[:-1]
        n = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        left, right = _weight(g, h, cfg, low, high), _weight(all_g - g, all_h - h, cfg, low, high)
        allowed = (n >= cfg.min_rows) & (len(grad) - n >= cfg.min_rows) & (direction[f] * (right - left) >= 0)
        score = np.where(allowed, gain(left, g, h) + gain(right, all_g - g, all_h - h), -np.inf)
        b = int(score.argmax())
        if score[b] > floor:
            floor, best = score[b], (f, b, left[b], right[b])
    return best


# --- over DataFrames ----------------------------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> Trees | None:
    """Trees fitted to at most ``cfg.max_labelled`` labelled documents; None if there is no label or no document
    for one. A document labelled several times counts with its highest label; null labels are left out."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.max("quality").alias("__quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_labelled))
    # at most max_labelled rows of two numbers: small enough to broadcast whatever the table's size
    chosen = docs.select("doc_id", text.text_bytes().alias("body")).join(F.broadcast(known), "doc_id")

    def scan(batches):
        rows = ((doc, label, statistics(body)[1]) for doc, body, label in text.rows_of(batches))
        yield from text.in_batches(rows, pa.schema([("doc", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.float64()))]))

    # repeated rows of a labelled id could exceed the bound: one row for each id
    rows = (chosen.select(F.col("doc_id").cast("long"), "body", F.col("__quality").cast("long"))
            .mapInArrow(scan, "doc long, label long, x array<double>")
            .groupBy("doc").agg(F.min(F.struct("x", "label")).alias("row")).select("doc", "row.*").toPandas())
    if not len(rows):
        return None
    rows = rows.sort_values("doc")
    return fit(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(np.float64), cfg, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: Trees | None, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The columns of ``docs`` followed by a struct ``quality`` of the base counts, ``base_failed``, ``score`` and ``kept``.

    A null or empty text has no word and fails the base rules. Without trees the base rules alone decide.
    """
    fields = [*((name, pa.int64()) for name in BASE), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]
    ddl = "struct<" + ", ".join(f"{n}: {'boolean' if k == pa.bool_() else 'double' if k == pa.float64() else 'bigint'}"
                                for n, k in fields) + ">"

    def verdicts(bodies: list) -> pa.StructArray:
        found = [statistics(body or b"") for body in bodies]
        base = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
        failed = (base[:, 0] < cfg.min_words) | (100 * base[:, 4] > cfg.max_repeat_percent * base[:, 0])
        score = trees.score(np.array([f[1] for f in found])) if trees is not None and len(found) else np.ones(len(found))
        kept = ~failed & (score >= cfg.threshold)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(kept)],
                                          names=[n for n, _ in fields])

    # the texts' own column goes along unchanged; names are internal inside, so no column of docs can clash
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.text_bytes().alias("body"))

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), verdicts(batch.column(1).to_pylist())], names=["row", "quality"])

    out = inner.mapInArrow(scan, f"row {inner.schema['row'].dataType.simpleString()}, quality {ddl}")
    return out


def quality_filter(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the trees, columns as they came."""
    return judge(docs, train(docs, labels, cfg), cfg).where("quality.kept").select("row.*")
