"""Secret scans: fixed patterns, and formats learned by grammar inference.

Credentials found by the fixed patterns are labelled by their pattern. For each label a prefix tree of a bounded
sample is built over coarse character classes, statistically compatible states are merged (Hoeffding bound), and the
resulting probabilistic automaton, with the letters the format uses, gives any string a likelihood. Every token of every
text, from 16 characters or the length of the shortest fitted credential on, is then scored against the formats. It is
added as a span of kind ``format`` if some format finds it typical: its likelihood lies where those of credentials lie that
the format was not fitted to, neither below nor above, so that being rare is no evidence. Besides, the format must explain it
better than a model of the corpus' ordinary words, by ``min_gain`` per character; a token shorter than ``full_length``
must gain as much in all as one of that length, since there are more short ones by chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")      # the same spans as HEX of 24 characters or more: runs are maximal
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # likewise
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_CHARS = 6  # of a credential, as in the fixed patterns
KNOWN = 100_000  # tokens whose answer a task remembers
KINDS = ("assign", "access", "hex")
_HAS_WORD = "(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"


@dataclass(frozen=True)
class SecretConfig:
    max_labelled: int = 5_000     # credentials of each kind that the automata are fitted to
    alpha: float = 0.05           # of the compatibility test
    min_gain: float = 0.4         # nats a character by which a format must beat the background
    full_length: int = 16         # characters from which min_gain alone decides
    max_states: int | None = None  # no cap: the sample bounds the tree
    outside: float = 0.005        # share of held-out credentials on either side of what counts as typical


def base_spans(body: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in LONG_ACCESS.finditer(body)]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(body)]
    return found


# --- probabilistic automata -----------------------------------------------------------------------------

_CLASS = {**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
          **{c: "0" for c in "0123456789"}}
_SIZE = {"a": 26, "A": 26, "0": 10}


def symbols(token: str) -> str:
    """The token's characters by class; punctuation stands for itself."""
    return "".join(_CLASS.get(c, c) for c in token)


class Automaton:
    """States with counts: arrivals, ends, and for each symbol the next state and its count."""

    def __init__(self, strings: list[str], alpha: float, max_states: int | None = None):
        self.arrive, self.end, self.next = [0], [0], [{}]
        for s in strings:
            self._add(s)
        self.alpha = alpha
        self._merge(max_states)

    def _new(self) -> int:
        self.arrive.append(0)
        self.end.append(0)
        self.next.append({})
        return len(self.arrive) - 1

    def _add(self, string: str) -> None:
        state = 0
        self.arrive[0] += 1
        for c in string:
            to = self.next[state].get(c)
            if to is None:
                to = self.next[state][c] = self._new()
            state = to
            self.arrive[state] += 1
        self.end[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.arrive[a], self.arrive[b]
            if self._differ(self.end[a], n1, self.end[b], n2):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(self.arrive[x] if x is not None else 0, n1, self.arrive[y] if y is not None else 0, n2):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Adds the tree under ``state`` to the states under ``into``."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.arrive[into] += self.arrive[state]
            self.end[into] += self.end[state]
            for c, to in self.next[state].items():
                if c in self.next[into]:
                    todo.append((self.next[into][c], to))
                else:
                    self.next[into][c] = to

    def _merge(self, max_states: int | None) -> None:
        """Red states are settled; each blue state, nearest and best supported first, joins a compatible red one or
        becomes red. Beyond ``max_states``, if given, it joins the red state it came from, which blurs formats."""
        red = [0]
        while True:
            is_red = set(red)
            blue = [(to, state, c) for state in red for c, to in self.next[state].items() if to not in is_red]
            if not blue:
                break
            to, state, c = max(blue, key=lambda b: (self.arrive[b[0]], b[2]))
            target = next((r for r in red if self._compatible(r, to)), None)
            if target is None and max_states is not None and len(red) >= max_states:
                target = state
            if target is None:
                red.append(to)
            else:
                self.next[state][c] = target
                self._fold(target, to)
        number = {r: i for i, r in enumerate(red)}
        self.arrive, self.end = [self.arrive[r] for r in red], [self.end[r] for r in red]
        self.next = [{c: number[t] for c, t in self.next[r].items()} for r in red]

    def learn(self, strings: list[str]) -> Automaton:
        """Smoothed log-probabilities from the strings' own walks."""
        ends, goes = Counter(), defaultdict(Counter)
        for s in strings:
            state = 0
            for c in s:
                goes[state][c] += 1
                state = self.next[state].get(c, 0)
            ends[state] += 1
        self.flow = []
        for state in range(len(self.next)):
            total = ends[state] + sum(goes[state].values()) + 1
            steps = {c: math.log(n / total) - math.log(_SIZE.get(c, 1)) for c, n in goes[state].items()}
            self.flow.append((steps, math.log((ends[state] + 0.01) / total), math.log(0.01 / total) - math.log(64)))
        return self

    def score(self, shape: str) -> float:
        """Log-likelihood of a string with these classes."""
        state, total = 0, 0.0
        for c in shape:
            steps, _, rare = self.flow[state]
            total += steps.get(c, rare)
            state = self.next[state].get(c, 0)
        return total + self.flow[state][1]


_LETTERS = "^abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"  # ^ stands for all else
_PLACE = np.zeros(256, np.int64)
_PLACE[[ord(c) for c in _LETTERS[1:]]] = np.arange(1, len(_LETTERS))


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]")
_MARKED_HEX = re.compile(r"[0-9A-Fa-f]{1,12}([-_][0-9A-Fa-f]{1,12})+")
_JOIN = math.log(0.1)  # of going on with another piece


def pair_counts(body: bytes) -> np.ndarray:
    """How often each letter follows each other one, by their places in ``_LETTERS``."""
    at = _PLACE[np.frombuffer(b" " + body, np.uint8)]
    return np.bincount(at[:-1] * len(_LETTERS) + at[1:], minlength=len(_LETTERS) ** 2)


def left_out(token: str) -> bool:
    """Long tokens with a digit that are not digits alone: the background does not count them."""
    return len(token) >= 16 and any(c.isdigit() for c in token) and not token.isdigit()


class Background:
    """Letter pairs of the whole corpus: what a token that is no credential looks like. A letter with few pairs of its own
    is taken to be followed by each letter as often as it occurs anywhere, not by all of them alike. A token is judged by
    the pairs of all others: one that was counted itself is taken off, or rare ones would speak for themselves."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(len(_LETTERS), -1).astype(float)
        counts[:, 0] = 0  # a token's inner letters only
        common = counts.sum(axis=0) + 0.5
        common[0] = 0
        self.prior = 0.5 * len(common) * common / common.sum()
        self.counts, self.total = counts.ravel(), counts.sum(axis=1)

    def score(self, token: str) -> float:
        """The best of three explanations: one word; words, numbers and marks put together, as names, slugs and dates are;
        numbers in base 16 with marks between them, as many identifiers are."""
        together = 0.0
        for piece in _PIECE.findall(token):
            together += _JOIN + (self.pairs(piece.lower()) if piece[0].isalpha() else len(piece) * math.log(0.1))
        hexadecimal = len(token) * math.log(1 / 16) + _JOIN if _MARKED_HEX.fullmatch(token) else -math.inf
        return max(self.pairs(token), together, hexadecimal)

    def pairs(self, token: str) -> float:
        at = _PLACE[np.frombuffer(b" " + token.encode(), np.uint8)]
        before, after = at[:-1], at[1:]
        pair = before * len(_LETTERS) + after
        counts, total = self.counts[pair], self.total[before]
        if not left_out(token):
            counts = np.maximum(counts - np.bincount(pair)[pair], 0)
            total = np.maximum(total - np.bincount(before)[before], counts)
        return float(np.log((counts + self.prior[after]) / (total + self.prior.sum())).sum())


class Format:
    """An automaton over classes, the letters used of each class, and where likelihoods of held-out strings lie."""

    def __init__(self, strings: list[str], cfg: SecretConfig, held_out: bool = True):
        shapes = [symbols(s) for s in strings]
        self.automaton = Automaton(shapes, cfg.alpha, cfg.max_states).learn(shapes)
        counts, classes = Counter(c for s in strings for c in s), Counter(c for s in shapes for c in s)
        # against each letter of a class being as frequent as the others, which is what the automaton takes
        self.letters = {c: math.log((counts[c] + 0.1) / (classes[k] + 0.1 * _SIZE[k]) * _SIZE[k]) for c, k in _CLASS.items()}
        if held_out:
            halves = (strings[::2], strings[1::2]) if len(strings) >= 8 else (strings, strings)
            scored = [(other.likelihood(s), len(s)) for other, part in
                      zip((Format(half, cfg, False) for half in halves), halves[::-1]) for s in part]
            self.mean = sum(score for score, _ in scored) / sum(n for _, n in scored)
            places = [self._place(score, n) for score, n in scored]
            self.low, self.high = np.quantile(places, [cfg.outside, 1 - cfg.outside]).tolist()

    def _place(self, score: float, n: int) -> float:
        """How far the likelihood is off the mean, in units in which strings of different lengths spread alike."""
        return (score - self.mean * n) / math.sqrt(n)

    def likelihood(self, token: str) -> float:
        return self.automaton.score(symbols(token)) + sum(self.letters.get(c, 0.0) for c in token)

    def typical(self, token: str, score: float) -> bool:
        return self.low <= self._place(score, len(token)) <= self.high


@dataclass
class Formats:
    formats: dict[str, Format]
    background: Background
    min_gain: float
    full_length: int = 16
    shortest: int = MIN_CHARS

    def __post_init__(self):
        self.token = re.compile(f"[A-Za-z0-9+/_=-]{{{self.shortest},}}")
        self.known: dict[str, bool] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    @property
    def automata(self) -> dict[str, Automaton]:
        return {kind: format.automaton for kind, format in self.formats.items()}

    def gain(self, token: str) -> float:
        """Nats a character by which the best format that finds the token typical beats the background; minus infinity if
        none does."""
        scores = [(f, f.likelihood(token)) for f in self.formats.values()]
        best = max((score for f, score in scores if f.typical(token, score)), default=-math.inf)
        return (best - self.background.score(token)) / len(token) if best > -math.inf else best

    def spans(self, body: str) -> list[tuple[int, int, str]]:
        if not self.formats:
            return []
        return [(m.start(), m.end(), "format") for m in self.token.finditer(body) if self.fits(m[0])]

    def fits(self, token: str) -> bool:
        """Whether the gain is enough; answers for short tokens are kept, as words come again and again."""
        found = self.known.get(token)
        if found is None:
            found = self.gain(token) * min(len(token), self.full_length) >= self.min_gain * self.full_length
            if len(token) <= 32:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[token] = found
        return found


# --- over DataFrames --------------------------------------------------------------------------------------

def _hits(column: pa.Array) -> list[bool]:
    """Which texts may hold a match of a fixed pattern, by one linear-time pass of the Arrow matcher for each pattern."""
    found = pc.match_substring_regex(column, _HAS_WORD)
    return pc.or_(found, pc.match_substring_regex(column, "[A-Za-z0-9+/_=-]{16}")).to_pylist()


def labelled(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> tuple[dict[str, list[str]], np.ndarray]:
    """What the formats are fitted to: for each kind the distinct credentials with the least hashes, at most
    ``cfg.max_labelled``, and the letter pairs of all
    texts without their credentials and credential-shaped tokens, a table of fixed size."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])

    def scan(batches):
        pairs = np.zeros(len(_LETTERS) ** 2, np.int64)
        for batch in batches:
            bodies = batch.column(0)
            values = set()
            for body, hit in zip(bodies, _hits(bodies)):
                body = body.as_py()
                plain = body
                if hit:  # credentials, and long tokens shaped like them, say nothing about ordinary text
                    labelled = [(kind, ASSIGN.match(body, start)[2] if kind == "assign" else body[start:end], end)
                                for start, end, kind in base_spans(body)]
                    values.update((kind, value) for kind, value, _ in labelled)
                    letters = list(body)
                    for _, value, end in labelled:
                        letters[end - len(value):end] = " " * len(value)
                    plain = CANDIDATE.sub(lambda m: " " if left_out(m[0]) else m[0], "".join(letters))
                pairs += pair_counts(plain.encode())
            if values:
                yield from text.in_batches(((k, v, 1) for k, v in values), schema)
        yield from text.in_batches((("pair", str(i), int(pairs[i])) for i in np.flatnonzero(pairs)), schema)

    found = (docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, "kind string, value string, n long")
             .groupBy("kind", "value").agg(F.sum("n").alias("n")))
    found = text.stored(found, "credentials")
    values = {kind: [r.value for r in found.where(F.col("kind") == kind).orderBy(F.md5("value"), "value")
                     .limit(cfg.max_labelled).collect()] for kind in KINDS}
    pairs = np.zeros(len(_LETTERS) ** 2, np.int64)
    for r in found.where("kind = 'pair'").collect():
        pairs[int(r.value)] = r.n
    text.discard(found)
    return values, pairs


def fit(values: dict[str, list[str]], pairs: np.ndarray, cfg: SecretConfig = SecretConfig()) -> Formats:
    formats, shortest = {}, []
    for kind, strings in values.items():
        strings = [s for s in strings if len(s) >= MIN_CHARS]
        if strings:
            shortest.append(min(map(len, strings)))
            formats[kind] = Format(strings, cfg)
    return Formats(formats, Background(pairs), cfg.min_gain, cfg.full_length, min([cfg.full_length, *shortest]))


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """``(doc, tie, spans)`` for every row: all spans ``(start, end, kind)`` in code points, end exclusive, by start and
    kind. A null or empty text has none. Without formats only the fixed patterns are searched."""
    order = {k: i for i, k in enumerate((*KINDS, "format"))}
    ddl = "doc long, tie long, spans array<struct<start: long, end: long, kind: string>>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("spans", pa.list_(span))])

    def spans_of(body: str, hit: bool) -> list[dict]:
        found = base_spans(body) if hit else []
        if formats is not None:
            taken = [(s, e) for s, e, _ in found]
            found += [x for x in formats.spans(body) if not any(s < x[1] and x[0] < e for s, e in taken)]
        return [{"start": s, "end": e, "kind": k} for s, e, k in sorted(found, key=lambda x: (x[0], order[x[2]]))]

    def scan(batches):
        for batch in batches:
            bodies = batch.column(2)
            spans = [spans_of(body.as_py(), hit) for body, hit in zip(bodies, _hits(bodies))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, schema.field(2).type)], schema=schema)

    keyed = docs.select(text.doc_id().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
                        F.coalesce("text", F.lit("")).alias("body"))
    return keyed.mapInArrow(scan, ddl)
