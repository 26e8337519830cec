"""Chat formatting: the round trip, the escapes and the mask."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from swipewatch.llm import chat, queries

FOLDER = "/root/testdata/sf0.001"
FILE = path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|turn|>", "a", " ", "\n", "é", "/s>"]), max_size=12).map("".join)


def test_query(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    answer = connection.sql(queries.CHAT_SQL)
    found = queries.op2_chat_formatting(spark, FOLDER).select(*answer.columns).collect()
    assert sorted(map(tuple, found)) == sorted(answer.fetchall())
    last = next(r for r in found if r.conv_id == -1)
    assert last.n_turns == 2 and last.loss_chars == len("</s>[INST] ok [/INST]")


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_escapes(body):
    escaped = chat.escape(body)
    assert chat.unescape(escaped) == body
    assert not any(c in escaped for c in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(ODD, ODD, st.booleans())
def test_turns(role, body, trained):
    template = chat.Template(FILE)
    ids, mask = template.assemble(role, body, trained)
    (r, b), = template.parse(ids)
    assert (chat.unescape(r), chat.unescape(b)) == (role, body)
    assert chat.unescape(template.text_of(ids[mask > 0])) == (body if trained else "")
    inner = ids[(ids != template.turn) & (ids != template.says) & (ids != template.end)]
    encode = Tokenizer.from_file(FILE).encode
    assert inner.tolist() == [*encode(chat.escape(role)).ids, *encode(chat.escape(body)).ids] and len(inner) == len(ids) - 3
    assert template.render(ids).count("<|turn|>") == 1


def test_edge_rows(spark):
    long_text = "word <s> " * 20_000
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "b", "x", 1), (1, 0, "user", "a", "x", 1), (1, None, None, None, None, None), (1, 1, "assistant", "b", "x", 1),
         (None, 0, "assistant", "", "x", 1), (2, 0, "assistant", long_text, "x", 1)],
        "conv_id long, turn long, role string, text string, ids string, nth long")
    chunks = chat.format_conversations(turns, FILE)
    rows = {r.conv_id: r for r in chat.digests(chunks, FILE).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in rows.items()} == {1: (4, 2), None: (1, 0), 2: (1, len(long_text))}
    for conv in (1, 2):
        at = 0
        for r in sorted((r for r in chunks.collect() if r.conv_id == conv), key=lambda r: r.nth):
            assert r.start == at and len(r.ids) == 4 * len(r.mask)
            at += len(r.mask)
    assert np.frombuffer(chunks.where("conv_id = 2").first().ids, np.uint32).max() == chat.Template(FILE).end
    assert chat.digests(chat.format_conversations(turns.limit(0), FILE), FILE).count() == 0
