"""Chat formatting by token-level assembly.

Every turn becomes ``TURN role SAYS text END``: role and text are encoded on their own, the three marks are reserved
ids above the vocabulary, so no text can produce one. The loss mask is the prefix sum of +1 where a trained text
begins and -1 where it ends. For the rendered form, control strings inside role or text are escaped: a backslash goes
behind their first character, and strings that already look escaped get one more, so unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text
from swipewatch.llm.packing import encoder

MARKS = ("<|turn|>", "<|says|>", "<|end|>")
CONTROL = (*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")


def _pattern(control: tuple[str, ...], least: str) -> re.Pattern:
    firsts = {c[0] for c in control}
    if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) for c in control):
        raise ValueError("a control string needs two characters, no backslash, and no other's first character inside")
    return re.compile("|".join(f"({re.escape(c[0])}\\\\{least})({re.escape(c[1:])})" for c in control))


def _joined(match: re.Match) -> tuple[str, str]:
    return tuple(g for g in match.groups() if g is not None)


_PLAIN, _ESCAPED = _pattern(CONTROL, "*"), _pattern(CONTROL, "+")


def escape(body: str) -> str:
    return _PLAIN.sub(lambda m: "\\".join(_joined(m)), body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(lambda m: (p := _joined(m))[0][:-1] + p[1], body)


class Template:
    """Assembles turns as ids and reads them back."""

    def __init__(self, path: str):
        self.encode = encoder(path).encode
        fast = encoder(path).fast
        self.size = fast.max_token_value + 2  # one id is the file's own special token
        self.turn, self.says, self.end = range(self.size, self.size + 3)
        self.bytes_of = [b""] * self.size
        for token in fast.token_byte_values():
            self.bytes_of[fast.encode_single_token(token)] = token

    def assemble(self, role: str, body: str, trained: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        head, tail = (np.frombuffer(self.encode(escape(part)), np.uint32) for part in (role, body))
        ids = np.concatenate([[self.turn], head, [self.says], tail, [self.end]]).astype(np.uint32)
        steps = np.zeros(len(ids) + 1, np.int8)
        if trained:
            steps[len(head) + 2] += 1
            steps[len(ids) - 1] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def text_of(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()

    def parse(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """``(role, text)`` as rendered, escapes included, of every turn."""
        starts, says, ends = (np.flatnonzero(ids == mark).tolist() for mark in (self.turn, self.says, self.end))
        return [(self.text_of(ids[a + 1:b]), self.text_of(ids[b + 1:c])) for a, b, c in zip(starts, says, ends)]

    def render(self, ids: np.ndarray) -> str:
        return "".join(MARKS[0] + role + MARKS[1] + body + MARKS[2] for role, body in self.parse(ids))


def format_conversations(conversations: DataFrame, path: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, nth, start, ids, mask)``: the turns of every conversation in order, ``start`` the number of ids
    before the turn, ids as little-endian unsigned 32-bit numbers, one mask byte an id.

    Turns go by ``turn`` (nulls first), ties by role and text; repeated rows are turns of their own. A null role or
    text counts as empty, a null ``conv_id`` is a conversation of its own. Encoding runs before the shuffle, row by
    row; the shuffle only orders turns, and starts are running sums over the sorted stream, so a conversation with
    very many turns never has to be held. An empty table gives no rows."""
    turn = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                      ("ids", pa.binary()), ("mask", pa.binary())])
    chunk = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])

    def encode(batches):
        template = Template(path)

        def rows():
            for conv, at, role, body in text.rows_of(batches):
                ids, mask = template.assemble(role, body, role in trained)
                yield conv, at, role, body, ids.tobytes(), mask.tobytes()

        yield from text.in_batches(rows(), turn, 500)

    def number(batches):
        def rows():
            last, nth, start = object(), 0, 0
            for conv, ids, mask in text.rows_of(batches):
                if conv != last:
                    last, nth, start = conv, 0, 0
                yield conv, nth, start, ids, mask
                nth, start = nth + 1, start + len(ids) // 4

        yield from text.in_batches(rows(), chunk, 500)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    encoded = turns.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids binary, mask binary")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(number, "conv_id long, nth long, start long, ids binary, mask binary")


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """What a reader of ``format_conversations`` finds, one row for each conversation: number of turns, digest of the
    turns, digest and length of the text under the loss mask, length of the rendered form. Rows of a conversation
    must still stand together and in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches):
        template = Template(path)

        def rows():
            last, state = None, None
            for conv, ids, mask in text.rows_of(batches):
                if state is None or conv != last:
                    if state is not None:
                        yield last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(ids, np.uint32), np.frombuffer(mask, np.int8)
                for role, body in template.parse(ids):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    state[4] += len(role) + len(body) + sum(map(len, MARKS))
                loss = unescape(template.text_of(ids[mask > 0]))
                state[2] += len(loss)
                state[3].update(loss.encode())
            if state is not None:
                yield last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from text.in_batches(rows(), schema)

    return formatted.select("conv_id", "ids", "mask").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
