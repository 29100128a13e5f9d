"""Proportional stratified interleaving (operator 9), with built-in functions only.

Rows are shuffled within their source by a seeded hash and ranked there; (rank + 1/2) / rows of the source is
a fraction that every source spreads evenly over 0 to 1. Sorted by fraction, any run of rows has
the corpus mixture, so that equal cuts give shards whose counts are at most one apart.

No source is ranked in one piece: the leading bits of the hash cut it into buckets, whose counts
give the first rank of each; the same is done with slices of the fraction for the global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.shared import stored

SHARDS, SEED, BUCKETS = 16, "mix-1", 4096


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of each row of (doc_id, text, source).

    Null texts have size 1 and the CRC of nothing. A null source is a source of its own; rows with a null doc_id
    share one hash and stand in the order of size and CRC. Repeated rows are dealt out like others.
    Columns besides these three are ignored. An empty table gives no rows.
    """
    stratum = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    keyed = docs.select("doc_id", "source", "text", stratum.alias("stratum"), h.alias("h")).withColumn("bucket", F.shiftright("h", 48) % F.lit(buckets))
    # A narrow first pass: only doc_id and source are read.
    counts = keyed.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("stratum")
    counts = counts.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(own).alias("n_stratum"),
    )
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = keyed.select("doc_id", "source", "stratum", "bucket", "h", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = rows.join(counts, ["stratum", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(in_bucket) - 1)
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("n_stratum"))
    ranked = ranked.select("doc_id", "source", "stratum", "size", "text_crc32", "rank", fraction.alias("fraction")).withColumn("slice", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    ranked = stored(ranked, "ranks")
    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    # At most `buckets` rows, whatever the input.
    slices = slices.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("n_rows"))
    in_slice = Window.partitionBy("slice").orderBy("fraction", "stratum", "rank")
    placed = ranked.join(slices, "slice").withColumn("g", F.col("first") + F.row_number().over(in_slice) - 1)
    placed = placed.withColumn("s", F.expr(f"(g * {shards}) div n_rows"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").cast("int").alias("shard"), F.expr(f"g - (s * n_rows + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


ORACLE = f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
rows AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
    CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS h,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, t),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n_stratum FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n_stratum)::DOUBLE, stratum, rank) - 1 AS g, count(*) OVER () AS n_rows FROM ranked)
SELECT doc_id, source, size::BIGINT AS size, text_crc32, 'rows' AS law, ((g * {SHARDS}) // n_rows)::INTEGER AS shard,
  (g - (((g * {SHARDS}) // n_rows) * n_rows + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
