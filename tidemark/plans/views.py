"""Market views derived from the star-schema tables, each with the same view in SQL.

bars: daily prices of a supplier's parts; signals: one claim per labelled
document; docs: documents as news with an issuer, a tier and a date;
segments: turns of conversations as transcript segments; ledger: orders as
signed credit movements; symbols: parts as a directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out by a key where a scan gives fewer parts than the session has cores twice over, as one small file does; else as they are.

    For rows whose further work costs far more than a shuffle of them.
    """
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, *key) if df.rdd.getNumPartitions() < parts else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, open, high, low, close, volume, vwap): open and close by the order of four fields, as keys repeat."""
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    daily = line.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap")
    )
    return daily.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "day", "open", "high", "low", "close", "volume", "vwap")


BARS = """bars AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day,
  arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ticker, host, tier, published, lang, text)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.concat(F.lit("host"), (F.col("doc_id") % 7).cast("string"), F.lit(".com")).alias("host"),
        (F.col("doc_id") % 4).cast("int").alias("tier"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("published"), "lang", "text",
    )


DOCS = "docs AS (SELECT doc_id AS id, source AS ticker, 'host' || (doc_id % 7) || '.com' AS host, CAST(doc_id % 4 AS INTEGER) AS tier, DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS published, lang, text FROM documents)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ticker, event_type, direction, strength, specificity, event_date, is_boilerplate, tier)."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(y, "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.when(F.col("n_chars") % 3 == 0, "guidance").when(F.col("n_chars") % 3 == 1, "litigation").otherwise("contract").alias("event_type"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("mixed").alias("direction"), ((F.col("n_chars") % 90 + 10) / 100).alias("strength"),
        ((F.col("n_chars") % 50 + 40) / 100).alias("specificity"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("event_date"),
        F.when(F.col("doc_id") % 5 == 0, 1).when(F.col("doc_id") % 5 == 1, 0).alias("is_boilerplate"), F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 4).cast("int")).alias("source_tier"),
    )


SIGNALS = """signals AS (SELECT doc_id AS id, source AS ticker, CASE n_chars % 3 WHEN 0 THEN 'guidance' WHEN 1 THEN 'litigation' ELSE 'contract' END AS event_type,
  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'mixed' END AS direction, (n_chars % 90 + 10) / 100 AS strength, (n_chars % 50 + 40) / 100 AS specificity,
  DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS event_date, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_boilerplate, CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 4 AS INTEGER) END AS source_tier
  FROM documents JOIN labels USING (doc_id))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, seg_index, speaker, text)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seg_index"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("speaker"), "text")


SEGMENTS = "segments AS (SELECT conv_id AS document_id, turn AS seg_index, CASE WHEN turn % 3 = 0 THEN role END AS speaker, text FROM conversations)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, delta, reason, created): whole credits, grants positive and spends negative."""
    o = table(spark, sf_dir, "orders")
    amount = F.floor(F.col("o_totalprice") / 100).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 3 == 0, amount).otherwise(-F.floor(amount / 4)).cast("long").alias("delta"), F.when(F.col("o_orderkey") % 3 == 0, "grant").otherwise("spend").alias("reason"), F.col("o_orderdate").alias("created"))


LEDGER = """ledger AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 100) ELSE -floor(floor(o_totalprice / 100) / 4) END AS BIGINT) AS delta,
  CASE WHEN o_orderkey % 3 = 0 THEN 'grant' ELSE 'spend' END AS reason, o_orderdate AS created FROM orders)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, name, exchange, tradable)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, ("NASDAQ", "NYSE", "OTC"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("exchange"), (F.col("p_partkey") % 11 != 0).alias("tradable"))


SYMBOLS = "symbols AS (SELECT 'P' || p_partkey AS symbol, p_name AS name, ['NASDAQ', 'NYSE', 'OTC'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS exchange, p_partkey % 11 <> 0 AS tradable FROM part)"


def half_up(sql: str) -> str:
    """SQL with round(x, d) spelt as floor(x * 10^d + 0.5) / 10^d, so that both engines round the same way."""
    at = sql.find("round(")
    while at >= 0:
        depth, end = 0, at + 5
        for end in range(at + 5, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if not depth:
                break
        inner, _, digits = sql[at + 6 : end].rpartition(",")
        scale = 10 ** int(digits)
        sql = f"{sql[:at]}(floor(({inner}) * {scale} + 0.5) / {scale}){sql[end + 1 :]}"
        at = sql.find("round(")
    return sql
