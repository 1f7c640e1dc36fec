"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, hard_negatives, line_dedup, media, mixing, near_dup, packing, pii, quality_model, quality_rules, token_counts, warc
from .common import stage_table, with_text_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, spans in zip(part["doc_id"], part["spans"], strict=True):
                every = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
                base = [x for x in every if x.split(":", 1)[0] in pii.KINDS[:4]]
                n = {k: sum(x.startswith(f"{k}:") for x in base) for k in pii.KINDS[:4]}
                out.append((doc, *n.values(), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every), max((s["score"] for s in spans), default=0.0)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"])

    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return with_text_ids(found, digest, "doc_id", "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_model.train(docs, table(spark, sf_dir, "labels"))
    got = quality_model.score(docs, net).drop("text")
    return got.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_model.CUT).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    shares = F.array_join(F.transform("sections", lambda s: s["tokens"].cast("long").cast("string")), ",")
    return got.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), shares.alias("section_tokens"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.text_statistics(table(spark, sf_dir, "documents")).withColumn("base_failed", quality_rules.base_failed())
    docs = stage_table(docs.select("doc_id", "lang", "source", *quality_rules.STATS, "base_failed"), "rule-documents")
    got = quality_rules.judge(docs, quality_rules.dimensions())
    return got.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.read_media(media.add_media(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", "class_h1", "class_h2", "n_in_class", "exact_copies")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_warc, op2_pii, op3_line_dedup, op4_packing, op5_mixing, op6_quality_model, op7_token_counts, op8_quality_rules, op9_media, op10_near_dup, op11_filter_audit, op12_bpe, op13_hard_negatives)}

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') AS bits FROM m)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, CAST(5*i+1 AS INT), 1)::INT + 8 * substr(bits, CAST(5*i+2 AS INT), 1)::INT + 4 * substr(bits, CAST(5*i+3 AS INT), 1)::INT + 2 * substr(bits, CAST(5*i+4 AS INT), 1)::INT + substr(bits, CAST(5*i+5 AS INT), 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM b""",
    "op3_line_dedup": r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS place FROM raw),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, place)) AS first, length(line) AS n FROM w GROUP BY line),
h AS (SELECT DISTINCT line, first, n, h FROM (SELECT *, unnest([n // 2, (n - 1) // 2]) AS h FROM d)),
c AS (SELECT a.line AS la, b.line AS lb, a.first AS fa, b.first AS fb FROM h a JOIN h b ON a.h = b.h AND left(a.line, a.h) = left(b.line, b.h) WHERE b.first < a.first AND abs(a.n - b.n) <= 1
      UNION SELECT a.line, b.line, a.first, b.first FROM h a JOIN h b ON a.h = b.h AND right(a.line, a.h) = right(b.line, b.h) WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
e AS (SELECT la, min(fb) AS partner FROM c WHERE len(list_filter(range(greatest(length(la), length(lb))), lambda p: left(la, CAST(p AS INT)) = left(lb, CAST(p AS INT)) AND right(la, CAST(greatest(length(la), length(lb)) - p - 1 AS INT)) = right(lb, CAST(greatest(length(la), length(lb)) - p - 1 AS INT)))) > 0 GROUP BY la),
s AS (SELECT d.line, least(d.first, coalesce(e.partner, d.first)) AS source FROM d LEFT JOIN e ON d.line = e.la),
g AS (SELECT w.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.source < (w.doc_id, w.place)) AS n_dropped,
      coalesce(string_agg(w.place, ',' ORDER BY w.place) FILTER (WHERE s.source < (w.doc_id, w.place)), '') AS dropped FROM w JOIN s USING (line) GROUP BY w.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  4 * ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':11'), 1, 15))::BIGINT AS h, md5(coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t AS (SELECT *, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INT)]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
x AS (SELECT *, CASE WHEN level * weight >= cap THEN cap ELSE weight * max(level) FILTER (WHERE level * weight < cap) OVER () END AS target FROM v),
w AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS words, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS id FROM x),
n AS (SELECT CAST(sum(words) AS BIGINT) AS total, sum(target) AS target_sum, greatest(1, least(8192, CAST(sum(words) AS BIGINT) // 16384)) AS block FROM w),
y AS (SELECT w.*, n.block, (sum(target) OVER (ORDER BY id) - target) / target_sum AS lo, sum(target) OVER (ORDER BY id) / target_sum AS hi FROM w, n),
points AS (SELECT t, ((t + 1) * 0.6180339887498949) % 1.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT CAST(ceil(total / block) AS BIGINT) + 64 FROM n))) AS t)),
slots AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS rank FROM points JOIN y ON u >= lo AND u < hi),
blocks AS (SELECT r.id, r.rank, coalesce(slots.t, (SELECT CAST(ceil(total / block) AS BIGINT) + 64 FROM n) + r.rank) AS slot, r.rank * block AS b_from, least((r.rank + 1) * block, words) AS b_to
  FROM (SELECT id, words, block, unnest(range(CAST(ceil(words / block) AS BIGINT))) AS rank FROM y) r LEFT JOIN slots ON slots.id = r.id AND slots.rank = r.rank),
l AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, y.source_size, y.target, y.words, y.id, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.k ROWS UNBOUNDED PRECEDING) - d.size AS pos FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source),
c AS (SELECT row, id, pos + k * source_size AS d_from, least(pos + k * source_size + size, words) AS d_to FROM l, (VALUES (0), (1), (2)) e(k) WHERE size > 0 AND pos + k * source_size < words),
o AS (SELECT row, CAST(sum(least(d_to, b_to) - greatest(d_from, b_from)) AS BIGINT) AS taken, CAST(min(CASE WHEN b_from <= d_from THEN slot END) AS BIGINT) AS first_slot FROM c JOIN blocks ON c.id = blocks.id AND b_from < d_to AND b_to > d_from GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM l LEFT JOIN o USING (row)""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END) || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
abc AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM abc a JOIN abc b ON a.x <> b.x JOIN abc c ON c.x NOT IN (a.x, b.x) JOIN abc d ON d.x NOT IN (a.x, b.x, c.x) JOIN abc e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
f AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS fail, fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, fails = letter AS alone FROM cells, steps),
s AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (WHERE NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE fail AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM f GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.label AS al, b.id AS b, b.label AS bl, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, al, b, score FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND s.bl <> s.al AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5""",
}
