"""One query for each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import alignment, filter_audit, line_dedup, lm_scoring, media, mixing, ngram_join, packing, quality, secret_scan, substring_dedup, token_store, vector_dedup
from cellwright.llm.common import new_path, table, tokenizer_path


def op1_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seed=11)


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), seed=17, rate_col="rate")
    return mixed.select("doc_id", "source", "copy", "mix_key", F.round("rate", 9).alias("rate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP3_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, CAST(1 AS DOUBLE) / count(*) OVER () * CAST(sum(n) OVER () AS DOUBLE) / n AS rate FROM n),
d AS (SELECT doc_id, d.source, text, rate,
        CAST(CAST('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
RECURSIVE_draws AS (SELECT doc_id, source, text, rate, u,
        list_reduce(list_prepend({'k': CAST(0 AS BIGINT), 'p': exp(-rate), 'c': exp(-rate)},
          list_transform(range(1, 65), lambda i: {'k': i, 'p': CAST(0 AS DOUBLE), 'c': CAST(0 AS DOUBLE)})),
          lambda s, x: CASE WHEN u < s.c THEN s ELSE {'k': x.k, 'p': s.p * rate / x.k, 'c': s.c + s.p * rate / x.k} END).k AS k
      FROM d)
SELECT doc_id, source, copy, md5('17:mix:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS mix_key,
  round(rate, 9) AS rate, sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT doc_id, source, text, rate, unnest(range(0, k)) AS copy FROM RECURSIVE_draws WHERE k > 0) x
""".replace("RECURSIVE_draws", "draws")


def op4_suffix_order_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), length=200, keep_first=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, line, pos, key IN (SELECT key FROM common) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, top=9, bottom=10)


def op8_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), path)
    return media.media_features(media.read_archives(spark, path))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_store.verified(spark, path)


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, (SELECT bit FROM letters WHERE l = substr(filter_order, step, 1)) AS bit,
    coalesce((SELECT sum(bit) FROM letters WHERE position(l IN substr(filter_order, 1, step - 1)) > 0), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step) s),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flagged AS (SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
named AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flagged LEFT JOIN named ON doc_id = id GROUP BY part, mask)
SELECT part, filter_order, step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM m, steps GROUP BY part, filter_order, step
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_attention_scores, op2_importance_resampling, op3_poisson_mix, op4_suffix_order_dedup, op5_line_bitmaps, op6_best_two_fit, op7_ngram_jaccard, op8_media_archives, op9_token_store, op10_collision_counting, op11_filter_audit, op12_secret_scan, op13_token_alignment)}
ORACLE_SQL = {"op3_poisson_mix": OP3_SQL, "op5_line_bitmaps": OP5_SQL, "op11_filter_audit": OP11_SQL}
