"""The registered query of each operator, and its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import (
    decontaminate, exact_dedup, html_text, langid, mixing, packing, periodic, pii, quality, secret_scan, simhash, vector_codes, warc,
)
from barspark.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                      F.col("lang_bits").alias("bits"), F.col("lang_rejected").alias("rejected"))


QUERIES["op1_language_id"] = op1_language_id


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES["op2_decontaminate"] = op2_decontaminate
ORACLES["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1:s + 10], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), occ AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d CROSS JOIN sizes)
), hit AS (SELECT doc_id, s, occ.n, item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n
), places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES["op3_packing"] = op3_packing


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLES["op4_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm FROM documents
), best AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, {'p': -points, 'd': doc_id}) AS keep_id FROM plain GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM plain JOIN best USING (norm)
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.detect(docs, pii.fit(docs))
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES["op5_pii"] = op5_pii


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op6_warc"] = op6_warc
ORACLES["op6_warc"] = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), largest AS (SELECT payload_digest, payload_bytes, max(page_id) AS first_id FROM page GROUP BY payload_digest, payload_bytes)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM page JOIN largest USING (payload_digest, payload_bytes)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES["op7_simhash"] = op7_simhash


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES["op8_html_text"] = op8_html_text


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(secret_scan.counted(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]),
                      F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))


QUERIES["op9_secret_scan"] = op9_secret_scan


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES["op10_quality"] = op10_quality


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT z, p, any_value(x) AS x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
    SELECT z, part.p, x, e, list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS d FROM part JOIN c{k} USING (p)
  ) GROUP BY z, p)"""

    def moved(k: int) -> str:
        return f"""u{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
    SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(x)) FROM part) + 1) r(i) GROUP BY p, e, i
  ) GROUP BY p, e
), c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN u{k} USING (p, e))"""

    steps = ",\n".join(f"{nearest(k)}, {moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS z, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT z, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(p)
), c0 AS MATERIALIZED (SELECT p, z - 1 AS e, x AS c FROM part WHERE z <= {entries}),
{steps},
{nearest(rounds)},
coded AS (SELECT z, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY z)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (z)
"""


QUERIES["op12_vector_codes"] = op12_vector_codes
ORACLES["op12_vector_codes"] = _vector_codes_sql()


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "quota")


QUERIES["op13_mixing"] = op13_mixing
ORACLES["op13_mixing"] = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS MATERIALIZED (SELECT *, [5, 2, 1][(sid % 3 + 1)::INTEGER]::BIGINT AS weight FROM s
), o AS (
  -- if all sources before this one, by size for weight, are at their bound: what is left, and the weights that share it
  SELECT *, row_number() OVER fill AS k, sum(source_size) OVER () - {mixing.MOST_REPEATS} * (sum(source_size) OVER fill - source_size) AS free, sum(weight) OVER () - (sum(weight) OVER fill - weight) AS units
  FROM w WINDOW fill AS (ORDER BY source_size / weight, sid ROWS UNBOUNDED PRECEDING)
), price AS MATERIALIZED (SELECT arg_min(free::DOUBLE / units::DOUBLE, k) AS price FROM o WHERE weight * (free::DOUBLE / units::DOUBLE) <= {mixing.MOST_REPEATS} * source_size
), t AS MATERIALIZED (
  SELECT w.*, weight * price > {mixing.MOST_REPEATS} * source_size AS capped, least(weight * price, {mixing.MOST_REPEATS}.0::DOUBLE * source_size) AS target FROM w, price
), seats AS MATERIALIZED (
  SELECT ((2 * (sum(source_size) - coalesce(sum({mixing.MOST_REPEATS} * source_size) FILTER (capped), 0)) + {mixing.BLOCK_WORDS}) // {2 * mixing.BLOCK_WORDS})::BIGINT AS seats FROM t
), blocks AS MATERIALIZED (
  SELECT sid, count(*) AS blocks FROM (
    SELECT sid, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid) AS r FROM (SELECT sid, target, seats, unnest(range(seats)) AS k FROM t, seats WHERE NOT capped)
  ) WHERE r <= seats GROUP BY sid
), x AS MATERIALIZED (
  SELECT d.*, sid, source_size, target, capped, coalesce(blocks, 0) AS blocks,
    ('0x' || substr(h, 1, 8))::BIGINT % greatest(1, (source_size + {mixing.SHARD_WORDS - 1}) // {mixing.SHARD_WORDS}) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN blocks USING (sid)
), sh AS MATERIALIZED (SELECT sid, shard, sum(size)::BIGINT AS words, any_value(capped) AS capped, any_value(blocks) AS blocks FROM x GROUP BY sid, shard
), q AS (
  SELECT sid, shard, count(*) AS quota FROM (
    SELECT sid, shard, blocks, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(blocks)) AS k FROM sh WHERE NOT capped AND words > 0)
  ) WHERE r <= blocks GROUP BY sid, shard
), y AS (
  SELECT sid, shard, words, CASE WHEN NOT capped THEN coalesce(quota, 0) END AS quota,
    CASE WHEN capped THEN {mixing.MOST_REPEATS} * words ELSE least(coalesce(quota, 0) * {mixing.BLOCK_WORDS}, {mixing.MOST_REPEATS} * words) END AS take,
    ('0x' || substr(md5('{mixing.SEED}:' || sid || ':' || shard), 1, 8))::BIGINT % greatest(1, (words + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS}) * {mixing.BLOCK_WORDS} AS first
  FROM sh LEFT JOIN q USING (sid, shard)
), z AS (
  SELECT x.*, quota, words, first, take // greatest(words, 1) AS rounds, first + take % greatest(words, 1) AS last,
    sum(size) OVER (PARTITION BY x.sid, x.shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos
  FROM x JOIN y USING (sid, shard)
)
SELECT doc_id, size, source_size, target, shard, quota, (rounds * size + greatest(0, least(pos + size, last, words) - greatest(pos, first)) + greatest(0, least(pos + size, last - words) - pos))::BIGINT AS taken FROM z
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)
