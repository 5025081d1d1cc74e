"""Inputs the registered queries share, once for Spark and once as oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import profile, splitting
from kinfold.operators.projection import ProjectionHead
from kinfold.session import materialize

SCORES = ("multiples_score", "indonesian_score")
STDS = ("multiples_score_std", "indonesian_score_std")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem as a listing of its part, with two scores."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("posting_id"),
        F.col("l_partkey").alias("label_group"),
        F.col("l_discount").alias("multiples_score"),
        F.col("l_tax").alias("indonesian_score"),
    )


LISTINGS = """listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS posting_id, l_partkey AS label_group,
         l_discount AS multiples_score, l_tax AS indonesian_score
  FROM lineitem)"""


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a product: families of a label as groups, text as title."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("posting_id"), F.col("text").alias("title"), F.col("source").alias("image")
    )
    component = [F.get("embedding", F.lit(i)).cast("double") for i in range(2)]
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("posting_id"),
        (F.col("label") * 10 + F.col("vec_id") % 10).cast("long").alias("label_group"),
        component[0].alias("multiples_score"),
        component[1].alias("indonesian_score"),
        "embedding",
    )
    return vectors.join(docs, "posting_id", "left")


PRODUCTS = """products AS (
  SELECT e.vec_id AS posting_id, CAST(e.label * 10 + e.vec_id % 10 AS BIGINT) AS label_group,
         CAST(e.embedding[1] AS DOUBLE) AS multiples_score,
         CAST(e.embedding[2] AS DOUBLE) AS indonesian_score,
         CAST(e.embedding AS DOUBLE[]) AS embedding, d.text AS title, d.source AS image
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""


def profile_sql(source: str) -> str:
    """Group profile of ``source`` as CTE ``profile``."""
    return f"""profile AS (
  SELECT label_group, count(posting_id) AS product_count,
         avg(multiples_score) AS multiples_score_mean,
         stddev_samp(multiples_score) AS multiples_score_std,
         avg(indonesian_score) AS indonesian_score_mean,
         stddev_samp(indonesian_score) AS indonesian_score_std
  FROM {source} WHERE label_group IS NOT NULL GROUP BY label_group)"""


# Deviations are rounded before they meet a quartile: the two engines add in
# different orders, and a value at the quartile must not fall on either side.
STRATA = """rounded AS (
  SELECT label_group, product_count, round(multiples_score_std, 9) AS multiples_score_std,
         round(indonesian_score_std, 9) AS indonesian_score_std FROM profile),
cuts AS (
  SELECT quantile_cont(multiples_score_std, 0.75) AS a, quantile_cont(indonesian_score_std, 0.75) AS b,
         quantile_cont(CAST(product_count AS DOUBLE), 0.75) AS c FROM rounded),
strata AS (
  SELECT r.*, CASE WHEN coalesce(multiples_score_std > a, false) OR coalesce(indonesian_score_std > b, false)
                     OR coalesce(product_count > c, false)
              THEN 'higher_variance' ELSE 'lower_variance' END AS stratum
  FROM rounded r CROSS JOIN cuts)"""

SPLITS = """sizes AS (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum),
whole AS (
  SELECT sum(n) AS n, ceil((CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * sum(n)) AS held FROM sizes),
t1 AS (
  SELECT stratum, s.n, w.n - w.held AS total, held,
         CAST(s.n AS DOUBLE) / w.n * (w.n - w.held) AS exact FROM sizes s CROSS JOIN whole w),
t2 AS (
  SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS place,
         total - sum(floor(exact)) OVER () AS spare FROM t1),
t3 AS (
  SELECT stratum, n, held, floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS train FROM t2),
v1 AS (
  SELECT *, held - ceil(held * 0.5) AS total,
         CAST(n - train AS DOUBLE) / held * (held - ceil(held * 0.5)) AS exact FROM t3),
v2 AS (
  SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS place,
         total - sum(floor(exact)) OVER () AS spare FROM v1),
quotas AS (
  SELECT stratum, train, floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS val FROM v2),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42:', label_group))) AS pos
  FROM strata),
splits AS (
  SELECT d.label_group, d.product_count, d.multiples_score_std, d.indonesian_score_std, d.stratum,
         CASE WHEN pos <= train THEN 'train' WHEN pos <= train + val THEN 'val' ELSE 'test' END AS split
  FROM drawn d JOIN quotas USING (stratum))"""

ASSIGNED = """assigned AS (
  SELECT p.*, s.split, s.stratum FROM products p LEFT JOIN splits s USING (label_group))"""

PRODUCT_ASSIGNMENTS = ",\n".join([PRODUCTS, profile_sql("products"), STRATA, SPLITS, ASSIGNED])


def unsigned_zero(value: str) -> str:
    """A rounded value without the sign DuckDB leaves on zero."""
    return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END"


def unit_list(vector: str) -> str:
    """A list of doubles at unit length, through single precision."""
    norm = f"greatest(sqrt(list_dot_product({vector}, {vector})), 1e-12)"
    return f"list_transform({vector}, lambda x: CAST(CAST(x / {norm} AS FLOAT) AS DOUBLE))"


def fixed_head(width: int = 64) -> ProjectionHead:
    """A head whose weights follow a formula the oracle can repeat."""
    j, i = np.mgrid[0:8, 0:width]
    head = ProjectionHead.initial(width, 8)
    head.weight = ((j * 7 + i * 3) % 11 - 5.0) / 10
    head.bias = np.arange(8) / 10
    head.bn_gamma = 1 + np.arange(8) / 8
    head.bn_beta = np.arange(8) / 100
    head.bn_mean = np.arange(8) / 20
    head.bn_var = 1 + np.arange(8) / 4
    return head


def neighbors_sql(source: str, k: int) -> str:
    """Best k of ``source`` for each of its rows as CTE ``neighbors``."""
    return f"""pairs AS (
  SELECT a.posting_id AS q, b.posting_id AS n, a.label_group AS qg, b.label_group AS ng,
         {unsigned_zero("round(list_dot_product(a.embedding, b.embedding), 9)")} AS sim
  FROM {source} a CROSS JOIN {source} b),
neighbors AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rank FROM pairs)
  WHERE rank <= {k})"""


def metrics_sql(source: str, at: str, ks=(5, 10, 50)) -> str:
    """Per-row metrics of ``source`` from ``neighbors`` with ``sim >= at`` as CTE ``metrics``."""
    hits = ", ".join(
        f"coalesce(sum(CASE WHEN ng = qg AND rank <= {k} THEN 1 ELSE 0 END), 0) AS h{k}" for k in ks
    )
    recalls = ", ".join(f'CAST(h{k} AS DOUBLE) / size AS "recall-{k}"' for k in ks)
    carried = ", ".join(f"h{k}" for k in ks)
    return f"""group_sizes AS (
  SELECT label_group, count(*) AS size FROM {source} GROUP BY label_group),
counted AS (
  SELECT s.posting_id, s.label_group, s.stratum, g.size, {at} AS threshold, count(n.n) AS got,
         coalesce(sum(CASE WHEN ng = qg THEN 1 ELSE 0 END), 0) AS hits, {hits}
  FROM {source} s JOIN group_sizes g USING (label_group) CROSS JOIN thresholds t
  LEFT JOIN neighbors n ON n.q = s.posting_id AND n.sim >= {at}
  GROUP BY s.posting_id, s.label_group, s.stratum, g.size, {at}),
pr AS (
  SELECT *, CASE WHEN got > 0 THEN CAST(hits AS DOUBLE) / got ELSE 0 END AS precision,
         CAST(hits AS DOUBLE) / size AS recall FROM counted),
metrics AS (
  SELECT threshold, posting_id, label_group, stratum, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
         {recalls} FROM pr)"""


def one_threshold(value: float) -> str:
    return f"thresholds AS (SELECT CAST({value} AS DOUBLE) AS t)"


def rounded_profile(rows: DataFrame) -> DataFrame:
    """The group table every later job reads, written once."""
    groups = profile.group_profile(rows, score_cols=SCORES)
    return materialize(
        groups.select("label_group", "product_count", *[F.round(c, 9).alias(c) for c in STDS])
    )


def strata(rows: DataFrame) -> DataFrame:
    return splitting.assign_stratum(rounded_profile(rows))


def splits(rows: DataFrame) -> DataFrame:
    return splitting.stratified_group_split(strata(rows))


def assigned_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products with split and stratum, written once as the split job would."""
    rows = products(spark, folder)
    return materialize(splitting.assign_rows(rows, splits(rows)))
