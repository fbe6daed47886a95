"""The operators bound to the test tables: ``QUERIES`` by name, ``ORACLE`` SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, lm_score, media, minhash, mixing, quality, substring_dedup, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 by source."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a repeated window of 35 words, removed."""
    out = substring_dedup.repeated_words(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a repeated string of 200 bytes, removed."""
    out = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    archive = warc.write_archive(_table(spark, sf_dir, "pages"), revisit_from=1000)
    out = warc.read_records(spark, archive)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a media member of an archive, read back through the data source, with features."""
    folder = media.write_archives(_table(spark, sf_dir, "documents"))
    return media.features(media.read_archives(spark, folder))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under byte_bpe_50k.json."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the ranks of byte_bpe_50k.tiktoken."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose crc32(doc_id) mod 5 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    out = lm_score.score(docs, train=~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_media_columns": op6_media_columns,
    "op7_token_counts": op7_token_counts,
    "op8_minhash": op8_minhash,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_lm_score": op10_lm_score,
}

ORACLE: dict[str, str] = {
    "op1_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS mark FROM documents
        ), tot AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
        ), wt AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos, sum(source_size) OVER ()::DOUBLE AS total,
                   (source_size * 3)::DOUBLE AS cap FROM tot
        ), ww AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM wt
        ), lev AS (
            SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                   row_number() OVER (ORDER BY cap / weight, pos) AS rk FROM ww
        ), src AS (
            SELECT source, pos, source_size, cap / weight <= level AS capped,
                   CASE WHEN cap / weight <= level THEN cap
                        ELSE weight * arg_min(level, rk) FILTER (WHERE cap / weight > level) OVER () END AS target,
                   greatest(1, ceil(source_size / 1000000.0), ceil(n_docs / 100000.0))::BIGINT AS shards
            FROM lev
        ), seats AS (SELECT round(sum(target) / 64)::BIGINT AS n FROM src WHERE NOT capped
        ), won AS (
            SELECT pos FROM (SELECT pos, target, unnest(range(0, n + 1)) AS k FROM src, seats WHERE NOT capped AND target > 0)
            ORDER BY target / (2 * k + 1) DESC, pos, k LIMIT (SELECT coalesce(n, 0) FROM seats)
        ), blocks AS (SELECT pos, count(*) AS blocks FROM won GROUP BY pos
        ), doc AS (
            SELECT d.*, src.pos, source_size, target, capped, ('0x' || mark[1:8])::BIGINT % shards AS shard
            FROM d JOIN src ON src.source IS NOT DISTINCT FROM d.source
        ), part AS (
            SELECT pos, shard, any_value(capped) AS capped, sum(size)::BIGINT AS shard_size, ceil(sum(size) / 64.0)::BIGINT AS n FROM doc GROUP BY pos, shard
        ), given AS (
            SELECT pos, shard, count(*) AS q FROM (
                SELECT pos, shard, blocks, row_number() OVER (PARTITION BY pos ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r
                FROM (SELECT pos, shard, shard_size, blocks, unnest(range(0, blocks + 1)) AS k FROM part JOIN blocks USING (pos) WHERE NOT capped AND shard_size > 0))
            WHERE r <= blocks GROUP BY pos, shard
        ), quota AS (
            SELECT pos, shard, n, CASE WHEN capped THEN n * 3 ELSE least(coalesce(q, 0), n * 3) END AS q FROM part LEFT JOIN given USING (pos, shard)
        ), placed AS (
            SELECT doc.*, n, q, sum(size) OVER (PARTITION BY pos, shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
            FROM doc JOIN quota USING (pos, shard)
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN n = 0 THEN 0 ELSE (q // n) * size + greatest(0, least(e, (q % n) * 64) - (e - size)) END::BIGINT AS taken
        FROM placed""",
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), win AS (
            SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
            FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
        ), rep AS (
            SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1
        ), word AS (
            SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
        ), cov AS (
            SELECT word.rid, p, word,
                   coalesce(max(CASE WHEN rep.i IS NOT NULL THEN 1 ELSE 0 END)
                            OVER (PARTITION BY word.rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
            FROM word LEFT JOIN rep ON rep.rid = word.rid AND rep.i = word.p
        ), per AS (
            SELECT rid, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
            FROM cov GROUP BY rid
        )
        SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN per USING (rid)""",
    "op4_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), lines AS (
            SELECT rid, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
        ), win AS (
            SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)
        ), rep AS (
            SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
        ), gap AS (
            SELECT rid, least(5, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -5)) AS n FROM rep
        ), repw AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM gap GROUP BY rid), m AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words,
                   length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   length(regexp_replace(d.text, '[^\p{Lu}]', '', 'g')) AS n_capitals,
                   length(regexp_replace(d.text, '[^\p{L}]', '', 'g')) AS n_letters
            FROM d JOIN lines USING (rid) LEFT JOIN repw USING (rid)
        ), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 5 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
                    OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_capitals > n_letters) AS kept
        FROM b""",
    "op5_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM response_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
        FROM r""",
}
