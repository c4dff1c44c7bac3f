"""The subpackage's queries, each over its whole table with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, langid, merkle, mixing, packing, pii, quality, records, sharding, simhash
from .common import table


def op1_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(records.write_records(table(spark, sf_dir, "documents"), byte_bpe(), end_id=0))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), end_id=1)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in pii.KINDS]
    base = F.sha2(pii.digest(F.col("base")).cast("binary"), 256)
    return found.select("row.doc_id", *counts, base.alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_chaining": op1_chaining, "op2_simhash": op2_simhash, "op3_merkle": op3_merkle, "op4_records": op4_records, "op5_langid": op5_langid, "op6_packing": op6_packing, "op7_mix": op7_mix, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_shards": op10_shards}


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws(':', '42', doc_id::VARCHAR)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER + 1] AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM w),
f AS (SELECT arg_min(level, pos) AS level FROM l WHERE cap >= level * weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(f.level * weight, 0.0)) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
e AS (SELECT d.*, source_size, target, floor(ratio) AS whole, (ratio - floor(ratio)) * source_size AS room, sum(size) OVER o AS till, row_number() OVER o AS nth FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WINDOW o AS (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, room > 0 AND till <= room AS fits FROM e),
m AS (SELECT *, room - coalesce(max(CASE WHEN fits THEN till END) OVER (PARTITION BY source), 0) AS missing FROM g),
n AS (SELECT source, arg_min(nth, {'gap': abs(size - missing), 'key': key, 'nth': nth}) AS nth FROM m WHERE NOT fits AND room > 0 AND size < 2 * missing GROUP BY source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN fits OR n.nth IS NOT NULL THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM m LEFT JOIN n ON m.source IS NOT DISTINCT FROM n.source AND m.nth = n.nth
"""

SHARD_SQL = """
WITH z AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i))),
h AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: strpos('0123456789ABCDEF', c) - 1) AS digits FROM documents),
b AS (SELECT doc_id, size, list_transform(range(0, size - 1), lambda i: (digits[2 * i + 1] * 16 + digits[2 * i + 2])::UBIGINT) AS bytes FROM h),
c AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda c, x: xor(c >> 8, crcs[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, z),
p AS (SELECT *, floor((sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT * 16 / (SELECT sum(size) FROM c)::BIGINT)::INTEGER AS shard FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two queries that it can express whole; tests hold the others against brute force."""
    return {"op7_mix": MIX_SQL, "op10_shards": SHARD_SQL}
