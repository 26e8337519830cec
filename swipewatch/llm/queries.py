"""The corpus operators as registered queries: production parameters, whole tables, digest columns."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipewatch.llm import (
    chat, codes, decontaminate, exact, lines, negatives, packing, quality, secrets, simhash, suffixes, superkmers, text, warc,
)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.page_records(text.table(spark, sf_dir, "pages"), least_revisit=100)
    archives = text.stored(warc.write_archives(records, text.new_path(spark, "warc")), "archives")
    return warc.pages_of(warc.read_archives(archives))


WARC_SQL = """
WITH payloads AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                         sha256(coalesce(html, '')) AS payload_digest FROM pages),
     firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = text.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                     "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.digests(chat.format_conversations(turns.unionByName(more), path), path)


_CONTROL = "|".join(re.escape(c[0]).replace("<", "[<]") + "\\\\*" + re.escape(c[1:]) for c in chat.CONTROL)
_ESCAPES = f"CAST(len(regexp_extract_all(text, '{_CONTROL}')) AS BIGINT)"
CHAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({sum(map(len, chat.MARKS))} + length(role) + length(text) + {_ESCAPES}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmers.drop_repeats(text.table(spark, sf_dir, "documents"), width=20)
    return found.select(text.shown_id(), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = text.table(spark, sf_dir, "documents"), text.table(spark, sf_dir, "labels")
    judged = quality.judge(docs.select("doc_id", "text"), quality.train(docs, labels))
    return judged.select("row.doc_id", *[f"quality.{name}" for name in (*quality.BASE, "base_failed", "kept")])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(text.table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=3, min_words=50)
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     every AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
     numbered AS (SELECT doc_id, place, trim(line, {_SPACES}) AS line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
                         row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i
                  FROM every WHERE trim(line, {_SPACES}) <> ''),
     pairs AS (SELECT a.doc_id, a.i, a.words + b.words AS words, a.line || chr(10) || b.line AS lines
               FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
     windows AS (SELECT doc_id, i, 1 AS n, line AS lines FROM numbered WHERE words >= 50
                 UNION ALL SELECT doc_id, i, 2, lines FROM pairs WHERE words >= 50
                 UNION ALL SELECT p.doc_id, p.i, 3, p.lines || chr(10) || c.line
                 FROM pairs p JOIN numbered c ON p.doc_id = c.doc_id AND c.i = p.i + 2),
     ranked AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY lines ORDER BY doc_id, i) AS nth FROM windows),
     gone AS (SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM ranked WHERE nth > 1),
     dropped AS (SELECT n.doc_id, n.place FROM numbered n SEMI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i),
     kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS body
              FROM every e ANTI JOIN dropped d ON e.doc_id = d.doc_id AND e.place = d.place GROUP BY e.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM numbered n WHERE n.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM dropped x WHERE x.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(text.table(spark, sf_dir, "documents"), text.table(spark, sf_dir, "benchmark"))
    return found.select(text.shown_id(), "item_id", "distance", "budget")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(text.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, end_id=2)
    return placed.select(text.shown_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.fit(*secrets.labelled(docs)))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "format")
    return found.select(text.shown_id(), *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeats(text.table(spark, sf_dir, "documents"), width=100)
    return found.select(text.shown_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(text.table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select(text.shown_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         text.shown_id("component_id").alias("component_id"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    coded, books = codes.compress(rows, scale=4096, parts=8, entries=16, rounds=6)
    return coded.withColumn("codebooks_sha256", F.lit(codes.books_digest(books)))


def _codes_sql(rounds: int = 6) -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     parts AS (SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM kept, range(8) AS r(p)),
     firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
     book0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN firsts USING (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"""
     near{i} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := {distance}, e := e)) AS best FROM parts v JOIN book{i} b USING (p) GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""
     sums{i} AS (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
                 FROM (SELECT p, n.best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM parts JOIN near{i} n USING (vec_id, p)) GROUP BY p, e, i),
     means{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{i} GROUP BY p, e),
     book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN means{i} m ON b.p = m.p AND b.e = m.e)""")
    return ",".join(steps) + f""",
     coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(text.table(spark, sf_dir, "documents"))
    return groups.select(text.shown_id(), text.shown_id("keep_doc").alias("keep_id"), "group_size", "kept",
                         F.lower(F.hex("sha")).alias("text_sha256"))


EXACT_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     grouped AS (SELECT *, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size FROM texts WINDOW same AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = text.table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95)


NEGATIVES_SQL = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                       CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
                FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_code_compression": op11_vector_code_compression,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}
SQL = {"op1_warc": WARC_SQL, "op2_chat_formatting": CHAT_SQL, "op5_line_dedup": LINES_SQL,
       "op11_vector_code_compression": _codes_sql(), "op12_exact_dedup": EXACT_SQL, "op13_hard_negative_mining": NEGATIVES_SQL}
