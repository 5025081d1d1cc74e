"""Registered queries: neighbours, retrieval lists, metrics and the threshold grid."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import metrics as mx
from kinfold.operators import neighbors as nb
from kinfold.operators import vector_index
from kinfold.operators.embeddings import attach_embeddings, select_split
from kinfold.plans import retrieval as job
from kinfold.registry.fragments import (
    PRODUCT_ASSIGNMENTS,
    assigned_products,
    fixed_head,
    metrics_sql,
    neighbors_sql,
    one_threshold,
    table,
    unit_list,
    unsigned_zero,
)
from kinfold.session import ensure_checkpoint_dir, materialize

_K = 51
_AT = 0.2


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("posting_id"), F.col("label").cast("long").alias("label_group"), "embedding"
    )


def _rounded(df):
    return df.select(
        *[F.round(F.col(f"`{c}`"), 9).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def knn_topk(spark, folder):
    return _rounded(nb.knn_self_join(_vectors(spark, folder), k=_K))


def knn_topk_blocked(spark, folder):
    """The path of large tables: many blocks that meet pairwise, then a window over their winners."""
    return _rounded(nb.knn_self_join(_vectors(spark, folder), k=_K, block_rows=100))


def similarity_join(spark, folder):
    """Every pair; the operator has rounded them to 9 decimals, and Spark's exact decimals cost more than a score."""
    return nb.similarity_join(_vectors(spark, folder), 0.25).drop("rank")


def knn_above_threshold(spark, folder):
    return _rounded(nb.similarity_join(_vectors(spark, folder), _AT, k=10))


def approx_similarity_join(spark, folder):
    return _rounded(nb.approx_similarity_join(_vectors(spark, folder), 0.5, k=_K))


_LISTS, _PROBES, _NEAR = 8, 3, 10


def index_search(spark, folder):
    """A stored index with centroids by formula, searched by every vector in its three nearest lists."""
    j, i = np.mgrid[0:_LISTS, 0:64]
    vectors = _vectors(spark, folder)
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build_index(vectors, centroids=((j * 7 + i * 3) % 11 - 5.0) / 40).save(path)
    stored = vector_index.VectorIndex.load(spark, path)
    return _rounded(vector_index.search(stored, vectors, vectors, k=_NEAR, probes=_PROBES))


def index_recall(spark, folder):
    """Lists a fitted index needs for nine tenths of the exact neighbours, measured on a sample of rows."""
    vectors = _vectors(spark, folder)
    index = vector_index.build_index(vectors)
    probes, recall = vector_index.probes_for(index, vectors, recall=0.9, k=_NEAR)
    return spark.createDataFrame([(len(index.centroids), probes, recall)], "lists int, probes int, recall double")


def split_vectors(spark, folder):
    """The test split with its vectors, as rounded components."""
    assigned = assigned_products(spark, folder)
    rows = attach_embeddings(
        select_split(assigned.drop("embedding"), "test"), _vectors(spark, folder)
    )
    return rows.select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def retrieval_lists(spark, folder):
    assigned = assigned_products(spark, folder)
    return job.retrieve(
        assigned.drop("embedding"), [_vectors(spark, folder)], split="test", k=_K, threshold=_AT
    )


def retrieval_lists_projected(spark, folder):
    """The retrieval job with a head: vectors projected before the search."""
    assigned = assigned_products(spark, folder)
    return job.retrieve(
        assigned.drop("embedding"), [_vectors(spark, folder)], split="test", k=_K, threshold=_AT, head=fixed_head()
    )


def retrieval_lists_fused(spark, folder):
    """Two modalities by concatenation; a vector and its reverse agree on every similarity."""
    assigned = assigned_products(spark, folder)
    vectors = _vectors(spark, folder).select("posting_id", "embedding")
    reverse = vectors.withColumn("embedding", F.reverse("embedding"))
    return job.retrieve(
        assigned.drop("embedding"), [vectors, reverse], fusion_type="concat", split="test", k=_K, threshold=_AT
    )


def _with_neighbors(spark, folder, threshold=_AT):
    """All products under their label, in two strata, and their neighbours."""
    rows = _vectors(spark, folder).withColumn(
        "stratum", F.when(F.col("label_group") < 5, "lower_variance").otherwise("higher_variance")
    )
    return rows, job.neighbors_of(rows, k=_K, threshold=threshold)


def running_matches(spark, folder):
    _, found = _with_neighbors(spark, folder)
    return mx.running_matches(found)


def _metrics(spark, folder):
    return mx.metrics_from_neighbors(*_with_neighbors(spark, folder))


def retrieval_metrics(spark, folder):
    return _rounded(_metrics(spark, folder))


def metrics_overall(spark, folder):
    return _rounded(mx.summarize_metrics(_metrics(spark, folder)))


def metrics_by_stratum(spark, folder):
    return _rounded(mx.summarize_by_stratum(_metrics(spark, folder)))


def _evaluation(spark, folder):
    rows, found = _with_neighbors(spark, folder)
    lists = job.retrieval_lists(rows, found, columns=("posting_id", "label_group", "stratum"))
    return job.evaluate(materialize(lists))


def evaluate_lists(spark, folder):
    """Metrics the long way: JSON lists decoded and every id looked up."""
    return _rounded(_evaluation(spark, folder).rows)


def evaluate_overall(spark, folder):
    """The evaluation job's means over all lists."""
    return _rounded(_evaluation(spark, folder).overall)


def evaluate_by_stratum(spark, folder):
    return _rounded(_evaluation(spark, folder).by_stratum)


def threshold_grid(spark, folder):
    rows, found = _with_neighbors(spark, folder, min(mx.THRESHOLDS))
    return _rounded(mx.summarize_grid(mx.metrics_by_threshold(rows, found)))


def threshold_rows(spark, folder):
    rows, found = _with_neighbors(spark, folder, min(mx.THRESHOLDS))
    return _rounded(mx.metrics_by_threshold(rows, found))


def best_threshold(spark, folder):
    rows, found = _with_neighbors(spark, folder, min(mx.THRESHOLDS))
    return _rounded(mx.best_threshold(mx.summarize_grid(mx.metrics_by_threshold(rows, found))))


def split_grid(spark, folder):
    """Grid search over the validation split of the product families."""
    rows = select_split(assigned_products(spark, folder), "val")
    return _rounded(job.grid_search(rows, k=_K).summary)


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk,
        knn_topk_blocked,
        similarity_join,
        knn_above_threshold,
        approx_similarity_join,
        index_search,
        index_recall,
        split_vectors,
        retrieval_lists,
        retrieval_lists_projected,
        retrieval_lists_fused,
        running_matches,
        retrieval_metrics,
        metrics_overall,
        metrics_by_stratum,
        evaluate_lists,
        evaluate_overall,
        evaluate_by_stratum,
        threshold_grid,
        threshold_rows,
        best_threshold,
        split_grid,
    )
}

_VECTORS = """vectors AS (
  SELECT vec_id AS posting_id, CAST(label AS BIGINT) AS label_group, CAST(embedding AS DOUBLE[]) AS embedding,
         CASE WHEN label < 5 THEN 'lower_variance' ELSE 'higher_variance' END AS stratum FROM embeddings)"""
_FOUND = f"WITH {_VECTORS},\n{neighbors_sql('vectors', _K)}"
_GRID_AT = "thresholds AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS t)"
_SCORED = f"{_FOUND}, {one_threshold(_AT)},\n{metrics_sql('vectors', 't.t')}"
_GRID = f"{_FOUND}, {_GRID_AT},\n{metrics_sql('vectors', 't.t')}"
_NAMES = ("precision", "recall", "f1", "recall-5", "recall-10", "recall-50")


def _means(prefix: str = "") -> str:
    return ", ".join(f'round(avg("{n}"), 9) AS "{prefix}{n}"' for n in _NAMES)


def _each() -> str:
    return ", ".join(f'round("{n}", 9) AS "{n}"' for n in _NAMES)


_LONG = "q AS query_id, CAST(rank AS INTEGER) AS rank, n AS neighbor_id, sim"
_ROWS = f"SELECT posting_id, label_group, stratum, {_each()} FROM metrics"
_SUMMARY = f"SELECT threshold, {_means('avg_')} FROM metrics GROUP BY threshold"
_TEST = "test AS (SELECT * FROM assigned WHERE split = 'test')"
_VAL = "val AS (SELECT * FROM assigned WHERE split = 'val')"

SQL = {
    "knn_topk": f"{_FOUND} SELECT {_LONG} FROM neighbors",
    "similarity_join": f"{_FOUND} SELECT q AS query_id, n AS neighbor_id, sim FROM pairs WHERE sim >= 0.25",
    "knn_above_threshold": f"""WITH {_VECTORS},\n{neighbors_sql('vectors', 10)}
SELECT {_LONG} FROM neighbors WHERE sim >= {_AT}""",
    "split_vectors": f"""WITH {PRODUCT_ASSIGNMENTS}
SELECT posting_id, pos, {unsigned_zero("value")} AS value FROM (
  SELECT posting_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, round(unnest(embedding), 6) AS value
  FROM assigned WHERE split = 'test')""",
    "retrieval_lists": f"""WITH {PRODUCT_ASSIGNMENTS}, {_TEST},\n{neighbors_sql('test', _K)},
lists AS (
  SELECT q, CAST(to_json(list(CAST(n AS VARCHAR) ORDER BY rank)) AS VARCHAR) AS ids
  FROM neighbors WHERE sim >= {_AT} GROUP BY q)
SELECT posting_id, image, title, label_group, stratum, coalesce(ids, '[]') AS retrieved_products
FROM test LEFT JOIN lists ON q = posting_id""",
    "running_matches": f"""{_FOUND} SELECT q AS query_id, CAST(rank AS INTEGER) AS rank,
CAST(sum(CASE WHEN ng = qg THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank) AS BIGINT) AS matches
FROM neighbors WHERE sim >= {_AT}""",
    "retrieval_metrics": f"{_SCORED} {_ROWS}",
    "metrics_overall": f"{_SCORED} SELECT {_means()} FROM metrics",
    "metrics_by_stratum": f"{_SCORED} SELECT stratum, {_means()} FROM metrics GROUP BY stratum",
    "evaluate_lists": f"{_SCORED} {_ROWS}",
    "threshold_grid": f"{_GRID} {_SUMMARY}",
    "threshold_rows": f"{_GRID} SELECT threshold, posting_id, label_group, stratum, {_each()} FROM metrics",
    "best_threshold": f"{_GRID} {_SUMMARY} ORDER BY avg(f1) DESC, threshold LIMIT 1",
    "split_grid": f"""WITH {PRODUCT_ASSIGNMENTS}, {_VAL},\n{neighbors_sql('val', _K)}, {_GRID_AT},
{metrics_sql('val', 't.t')} {_SUMMARY}""",
}
SQL["evaluate_overall"] = SQL["metrics_overall"]
SQL["evaluate_by_stratum"] = SQL["metrics_by_stratum"]
SQL["index_search"] = f"""WITH {_VECTORS},
centroids AS (
  SELECT j, list(((j * 7 + i * 3) % 11 - 5) / 40.0::DOUBLE ORDER BY i) AS c
  FROM (SELECT unnest(range({_LISTS})) AS j) CROSS JOIN (SELECT unnest(range(64)) AS i) GROUP BY j),
places AS (
  SELECT posting_id, embedding, j, row_number() OVER (
    PARTITION BY posting_id ORDER BY round(0.5 * list_dot_product(c, c) - list_dot_product(embedding, c), 9), j) AS place
  FROM vectors CROSS JOIN centroids),
pairs AS (
  SELECT a.posting_id AS q, b.posting_id AS n,
         {unsigned_zero("round(list_dot_product(a.embedding, b.embedding), 9)")} AS sim
  FROM places a JOIN places b USING (j) WHERE a.place <= {_PROBES} AND b.place = 1)
SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, n AS neighbor_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rank FROM pairs) WHERE rank <= {_NEAR}"""
_HEADED_TEST = f"""test AS (SELECT * REPLACE (projected AS embedding) FROM (
  SELECT a.*, {unit_list("y")} AS projected FROM assigned a
  JOIN (SELECT posting_id, list(y ORDER BY j) AS y FROM (
    SELECT posting_id, j, (sum(x * ((j * 7 + i * 3) % 11 - 5) / 10.0::DOUBLE) + j / 10.0::DOUBLE - j / 20.0::DOUBLE)
             / sqrt(1 + j / 4.0::DOUBLE + 1e-5) * (1 + j / 8.0::DOUBLE) + j / 100.0::DOUBLE AS y
    FROM (SELECT posting_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM assigned)
    CROSS JOIN (SELECT unnest(range(8)) AS j) GROUP BY posting_id, j) GROUP BY posting_id) USING (posting_id)
  WHERE split = 'test'))"""
SQL["retrieval_lists_projected"] = SQL["retrieval_lists"].replace(_TEST, _HEADED_TEST)
SQL["knn_topk_blocked"] = SQL["knn_topk"]
SQL["retrieval_lists_fused"] = SQL["retrieval_lists"]
