"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws u in (0, 1) from a digest of its id and gets the exponential key -ln(u) / w, where w is its quality weight;
within a source the smallest keys come first. A source's target is met by complete epochs, then by the documents of smallest key
until the rest of the budget is spent; the last document gives only the words that are missing.

A source is never sorted as a whole: u**(1/w) falls into one of `buckets` ranges of equal width, sums per (source, range) give the
words before a range, and rows are ordered only within a range. So a hot source is spread over all tasks. There are about as many ranges
as a range of a whole table in one source has rows: the square root of the number of rows, so neither grows out of a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: The weights of the sources in the order of their names, the share of all words to take, the most epochs of a source,
#: the weights of documents by labels.quality.
WEIGHTS, SHARE, MOST_EPOCHS, QUALITY_WEIGHTS, OTHER_WEIGHT = (3, 1, 2), 1.5, 2, {1: 2.0, 0: 0.5}, 1.0
LEAST_BUCKETS = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 12 hexadecimal digits of the id's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(totals: DataFrame) -> DataFrame:
    """Per source (name, source_size): its target. Targets are min(MOST_EPOCHS * size, level * weight), with the level that makes them
    SHARE of all words: sources are taken in the order of the level at which they fill up, so the level is found in one pass over a
    table of one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    sized = (
        totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * MOST_EPOCHS)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full_at", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = sized.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at"))
    chosen = F.max(F.when(F.col("open"), F.col("level"))).over(everything)  # levels fall from the first open source on, so this is its level
    return levelled.withColumn("chosen", chosen).select(
        "source", "source_size", F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("chosen") * F.col("weight"))).alias("target")
    )


def mix(sizes: DataFrame, buckets: int | None = None) -> DataFrame:
    """sizes: row_key (distinct per row), doc_id, source, size, weight (null or not above 0: 1). Returns them with source_size, target, taken.
    It is read more than once. The number of buckets changes no result.

    Null sources are one source. Documents without words take 0. Rows that repeat share a key and are ordered by row_key."""
    buckets = buckets or max(LEAST_BUCKETS, math.isqrt(sizes.count()))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(OTHER_WEIGHT))
    keyed = (
        sizes.withColumn("_u", uniform(F.col("doc_id")))
        .withColumn("_key", -F.log("_u") / weight)
        .withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.pow("_u", 1 / weight)) * buckets)).cast("int"))
        .withColumn("_source", F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")))
    )
    ranges = keyed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    totals = ranges.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    goals = source_targets(totals.select(F.when(~F.col("_source.no"), F.col("_source.name")).alias("source"), "source_size"))
    goals = goals.select(F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"), "source_size", "target")
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_words")
    starts = starts.join(goals, "_source")
    ordered = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(starts, ["_source", "_bucket"]).withColumn("_prior", F.col("_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_prior")))
    return placed.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("_source", "_bucket", "_before", "_prior", "_key", "_u")


def document_sizes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size, weight, row_key of every document; the weight follows the highest labels.quality of its id."""
    quality = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    weight = F.coalesce(*[F.when(F.col("_q") == q, F.lit(w)) for q, w in QUALITY_WEIGHTS.items()], F.lit(OTHER_WEIGHT))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row_key"))
    return sized.join(quality, sized["doc_id"] == quality["_id"], "left").select("doc_id", "source", "size", weight.alias("weight"), "row_key")


def query(spark, sf_dir: str) -> DataFrame:
    sizes = cut(document_sizes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes out what the mix takes: a row per complete copy, and a row with the first words (blank-separated) of a document taken in part.
    All columns of docs stay, whatever their names; n_chars, where there is one, follows a shortened text."""
    sizes = cut(document_sizes(docs, table(spark, sf_dir, "labels")))
    repeated = sizes.groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count()
    nth = F.row_number().over(Window.partitionBy("_mx_id", "_mx_hash").orderBy(F.desc("_mx_taken")))
    taken = mix(sizes).where(F.col("taken") > 0).select(F.col("doc_id").alias("_mx_id"), F.col("row_key").alias("_mx_hash"), F.col("size").alias("_mx_size"), F.col("taken").alias("_mx_taken")).withColumn("_mx_n", nth)
    whole = docs.select(F.struct(*docs.columns).alias("_mx_doc"), F.col("doc_id").alias("_mx_doc_id"), F.xxhash64("text").alias("_mx_text_hash"), F.monotonically_increasing_id().alias("_mx_row"))
    same = F.col("_mx_doc_id").eqNullSafe(F.col("_mx_id")) & (F.col("_mx_text_hash") == F.col("_mx_hash"))
    if repeated:  # rows that repeat are numbered on both sides, which shuffles texts once more
        whole = whole.withColumn("_mx_nth", F.row_number().over(Window.partitionBy("_mx_doc_id", "_mx_text_hash").orderBy("_mx_row")))
        same = same & (F.col("_mx_nth") == F.col("_mx_n"))
    copies = F.floor(F.col("_mx_taken") / F.col("_mx_size"))
    part = F.col("_mx_taken") - copies * F.col("_mx_size")
    pieces = F.concat(F.array_repeat(F.lit(0).cast("long"), copies.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = whole.join(taken, same).select("_mx_doc", F.explode(pieces).alias("_mx_part"))
    words = F.filter(F.split(F.col("_mx_doc.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_mx_part") == 0, F.col("_mx_doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("_mx_part"), F.lit(1)).cast("int")), " "))
    columns = {c: F.col("_mx_doc")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_mx_part") == 0, F.col("_mx_doc.n_chars")).otherwise(F.length(text).cast("long"))
    return rows.select(*[v.alias(c) for c, v in columns.items()])


ORACLE = rf"""
WITH q AS (SELECT doc_id AS id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(text, '') AS text,
        CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
      FROM documents LEFT JOIN q ON doc_id = id),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight, source_size::DOUBLE * 2 AS cap FROM t),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
c AS (SELECT max(level) FILTER (WHERE level <= full_at) AS chosen FROM l),
g AS (SELECT source, source_size, CASE WHEN chosen IS NULL THEN cap ELSE least(cap, chosen * weight) END AS target FROM l, c),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - prior)))::BIGINT AS taken FROM e
"""
