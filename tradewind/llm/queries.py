"""The corpus operators as named queries over whole tables, with their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import compress_quality, decontaminate, lz_fingerprint, ngram_lm, piece_bpe, set_sketch, sharding, simhash, spelling, suffix_dedup, token_alignment, token_files, toxicity
from tradewind.llm.common import documents
from tradewind.sources.stages import stage_root

Query = Callable[[SparkSession, str], DataFrame]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(documents(spark, sf_dir))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compress_quality.score(docs, compress_quality.fit(docs, labels(spark, sf_dir)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_root(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), f"{stage_root(spark)}/shard-maps-{uuid.uuid4().hex}")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), spelling.TYPO)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffixes, op2_phrases, op3_lm, op4_pieces, op5_quality, op6_simhash, op7_toxicity, op8_token_files, op9_slots, op10_winnowing,
        op11_spelling, op12_alignment, op13_setsketch,
    )
}

OP1_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, unnest(range(n - 199)) AS pos FROM docs WHERE n >= 200),
strings AS (SELECT p.doc_id, p.pos, md5(array_slice(d.b, p.pos + 1, p.pos + 200)) AS s FROM places p JOIN docs d USING (doc_id)),
repeated AS (SELECT doc_id, pos FROM strings QUALIFY count(*) OVER (PARTITION BY s) > 1),
marked AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM repeated),
numbered AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS z FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT s.doc_id, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS first, a AS last FROM spans s
  UNION ALL SELECT d.doc_id, coalesce(max(s.z), 0), max(d.n) FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (
  SELECT g.doc_id, sha256(unhex(string_agg(CASE WHEN g.last > g.first THEN hex(array_slice(d.b, g.first + 1, g.last)) ELSE '' END, '' ORDER BY g.first, g.last))) AS kept_sha256
  FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, k.kept_sha256
FROM docs d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN sums s ON s.doc_id = d.doc_id
"""

OP10_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT item, ws, least(len(ws), 10) AS m FROM items WHERE len(ws) > 0),
item_places AS (SELECT item, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM sized),
wanted AS (SELECT DISTINCT item, m, array_to_string(ws[i : i + m - 1], ' ') AS span FROM item_places),
doc_places AS (SELECT doc_id, m, ws, unnest(range(1, greatest(len(ws) - m + 2, 1)::BIGINT)) AS i FROM docs, (SELECT DISTINCT m FROM wanted)),
hits AS (SELECT p.doc_id, p.i, p.m, w.item FROM (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS span FROM doc_places) p JOIN wanted w ON w.m = p.m AND w.span = p.span),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words w ON w.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id
"""

OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
spelled AS (SELECT *, hex(doc_id::VARCHAR || ':' || run) AS h FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM spelled, crc_table),
cut AS (SELECT times, CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""

OP13_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_suffixes": OP1_SQL, "op10_winnowing": OP10_SQL, "op11_spelling": OP11_SQL, "op13_setsketch": OP13_SQL}
