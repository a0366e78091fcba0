"""The Parquet tables, and products as a view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part: title, brand, category, price and what its sales say. in_stock stands for an even size."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("sales_count"), F.round(5.0 * (1.0 - F.avg("l_discount")), 6).alias("rating"))
    part = table(spark, sf_dir, "part")
    return part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").select(
        F.col("p_partkey").alias("sku_id"),
        F.concat_ws("|", "p_brand", "p_name").alias("spu_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_type").alias("category_name"),
        F.split("p_name", " ")[0].alias("tags"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("attributes"),
        F.col("p_retailprice").alias("price"),
        "sales_count",
        "rating",
        (F.col("p_size") % 2 == 0).alias("in_stock"),
    )


#: The same view in SQL.
PRODUCTS_SQL = """
products AS (
  SELECT p_partkey AS sku_id, p_brand || '|' || p_name AS spu_id, p_name AS title, p_brand AS brand_name, p_type AS category_name,
    split_part(p_name, ' ', 1) AS tags, 'size ' || CAST(p_size AS VARCHAR) AS attributes, p_retailprice AS price, s.sales_count, s.rating, p_size % 2 = 0 AS in_stock
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS sales_count, round(5.0::DOUBLE * (1.0::DOUBLE - avg(l_discount)), 6) AS rating FROM lineitem GROUP BY l_partkey) s ON s.l_partkey = p_partkey)
"""
