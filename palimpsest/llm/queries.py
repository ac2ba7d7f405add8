"""The registered queries of the training-data operators, with production parameters, and their SQL.

Each derives the columns of its contract from the operator's own output. Tables are read through
Spark only, from any path it can read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hamming, licenses, linededup, packing, quality, semantic, setjoin, urls, warc
from ._util import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RULES = [urls.rule("block", "com/en/"), urls.rule("allow", "example.com/en/7"), urls.rule("allow", "net/de/"), urls.rule("block", "example.net/de/8"), urls.rule("block", "org/es/")]
EVERY = 20
TOP = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "digest", "license_id", F.array_join("contained", ",").alias("contained"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, payloads=False))
    first = F.regexp_extract("refers_to", r"capture:(-?\d+)[:>]", 1)
    return captures.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.when(F.col("refers_to").isNotNull(), first).cast("long").alias("refers_to"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "perspective", "position", "turn", "speaker", "start", "learn_start", "learn_length", F.md5("segment").alias("segment_md5"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), TOP)


QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_quality, op4_jaccard_join, op5_warc, op6_line_dedup, op7_url_filter, op8_decontamination, op9_chat, op10_topk)}


def _known_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())
    return f"SELECT license_id, text FROM (VALUES {quoted}) AS t(license_id, text)"


_PARTS = f"regexp_split_to_array(coalesce(text, ''), '{licenses.PARAGRAPH}')"
OP2_SQL = f"""WITH texts AS ({_known_sql()}),
known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, sha256({licenses.canonical_sql("text")}) AS digest FROM texts) GROUP BY digest),
parts AS (SELECT DISTINCT license_id, sha256(form) AS unit FROM (SELECT license_id, {licenses.canonical_sql("part")} AS form FROM (SELECT license_id, unnest({_PARTS}) AS part FROM texts WHERE license_id IN (SELECT license_id FROM known))) WHERE form <> ''),
rows AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
units AS (SELECT DISTINCT id, sha256(form) AS unit FROM (SELECT id, {licenses.canonical_sql("part")} AS form FROM (SELECT id, unnest(list_concat({_PARTS}, string_split(coalesce(text, ''), chr(10)))) AS part FROM rows)) WHERE form <> ''),
held AS (SELECT id, license_id FROM units JOIN parts USING (unit) GROUP BY id, license_id HAVING count(*) = (SELECT count(*) FROM parts p WHERE p.license_id = parts.license_id)),
contained AS (SELECT id, string_agg(license_id, ',' ORDER BY license_id) AS contained FROM held GROUP BY id),
forms AS (SELECT id, doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM rows)
SELECT doc_id, forms.digest AS digest, license_id, coalesce(contained, '') AS contained FROM forms LEFT JOIN known ON forms.digest = known.digest LEFT JOIN contained ON contained.id = forms.id"""

OP4_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
class AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY md5(CAST(list_sort(s) AS VARCHAR))) AS rep FROM sets),
rep AS (SELECT doc_id, len(s) AS n, s FROM sets WHERE len(s) > 0 AND doc_id IN (SELECT rep FROM class)),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM rep),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 75 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM rep UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT class.doc_id, CAST(class.n AS BIGINT) AS n_shingles, CASE WHEN class.n = 0 THEN class.doc_id ELSE comp.root END AS component_id
FROM class LEFT JOIN comp ON comp.node = class.rep"""

OP5_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT p.*, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

OP9_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
r AS (SELECT c.*, perspective, CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || replace(replace(speaker, '<|', '<\|'), '|>', '|\>') || '|>' END || chr(10) AS head
  FROM c JOIN who ON c.conv_id IS NOT DISTINCT FROM who.conv_id),
s AS (SELECT *, head || replace(replace(text, '<|', '<\|'), '|>', '|\>') || '<|end|>' || chr(10) AS segment FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, position, turn, speaker, CAST(start AS BIGINT) AS start, CAST(length(head) AS BIGINT) AS learn_start,
  CAST(CASE WHEN speaker = perspective THEN length(segment) - length(head) ELSE 0 END AS BIGINT) AS learn_length, md5(segment) AS segment_md5 FROM o"""

OP10_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, o.vec_id AS neighbour_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.code[i] <> o.code[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM p)
SELECT query_id, neighbour_id, distance, rank FROM r WHERE rank <= {TOP}"""

ORACLE_SQL = {"op2_license_scan": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op5_warc": OP5_SQL, "op9_chat": OP9_SQL, "op10_topk": OP10_SQL}
