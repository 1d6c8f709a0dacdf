"""Point layers over the driver's tables, and literal cells."""

from __future__ import annotations

from pyspark.sql import functions as F

CELLS = [(1, 0.0, 0.0, 400.0, 500.0), (2, 400.0, 0.0, 1000.0, 500.0), (3, 100.0, 100.0, 300.0, 900.0), (4, 600.0, 400.0, 900.0, 700.0), (5, 650.0, 450.0, 800.0, 600.0)]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    d = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (1000 * e(0)).alias("x"), (1000 * e(1)).alias("y"), F.col("label").alias("grp"), *[e(k + 1).alias(f"w{k}") for k in range(1, 5)])
    return d.withColumn("z", 0.01 * F.col("x") + 0.02 * F.col("y") + 50 * F.col("w1") + 5 * F.col("w2"))


def lineitem_points(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem")
    return d.select(F.col("l_partkey").cast("double").alias("x"), (20 * F.col("l_suppkey")).cast("double").alias("y"), (F.col("l_extendedprice") + 20000 * ((F.floor(F.col("l_partkey") / 200) * 7) % 5)).alias("v"), F.col("l_quantity").alias("q"))


def customer_points(spark, sf_dir):
    d = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return d.select(k.alias("row_id"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1009).cast("double").alias("y"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("z"))


def customer_lonlat(spark, sf_dir):
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(k.alias("row_id"), (-78.9 + ((37 * k) % 600) / 1000).alias("x"), (35.5 + ((53 * k) % 600) / 1000).alias("y"))


def literal_cells(spark):
    d = spark.createDataFrame(CELLS, "cell_id long, xmin double, ymin double, xmax double, ymax double")
    ring = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))])
    return d.withColumn("rings", F.array(ring))


EMB = """emb as (select vec_id as row_id, 1000 * embedding[1]::double as x, 1000 * embedding[2]::double as y, label as grp,
  embedding[3]::double as w1, embedding[4]::double as w2, embedding[5]::double as w3, embedding[6]::double as w4 from embeddings),
pts as (select *, 0.01 * x + 0.02 * y + 50 * w1 + 5 * w2 as z from emb)"""
CUST = """pts as (select c_custkey as row_id, ((c_custkey * 7919) % 1000)::double as x, ((c_custkey * 104729) % 1009)::double as y, c_nationkey as grp, c_acctbal as z from customer)"""
LI = """li as (select l_partkey::double as x, (20 * l_suppkey)::double as y, l_extendedprice + 20000 * ((floor(l_partkey / 200) * 7) % 5) as v, l_quantity as q from lineitem)"""
LL = """pts as (select c_custkey as row_id, -78.9 + ((37 * c_custkey) % 600) / 1000 as lon, 35.5 + ((53 * c_custkey) % 600) / 1000 as lat from customer)"""
BOXES = "boxes(cell_id, xmin, ymin, xmax, ymax) as (values " + ", ".join(f"({i}::bigint, {a}::double, {b}::double, {c}::double, {d}::double)" for i, a, b, c, d in CELLS) + ")"
