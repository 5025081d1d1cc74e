"""Registered queries: vector arithmetic, fusion and prototype classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import vectors as vx
from kinfold.operators import embeddings as emb
from kinfold.operators import prototypes as proto
from kinfold.registry.fragments import table, unsigned_zero

_SCALE = 30.0


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding", "label")


def _second(spark, folder):
    """A second modality: the same vectors read backwards."""
    return _vectors(spark, folder).withColumn("embedding", F.reverse("embedding"))


def _components(df):
    return df.select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def l2_normalize(spark, folder):
    """Vectors stretched by their label, then brought back to unit length."""
    stretched = F.transform("embedding", lambda x: (x * (F.col("label") + 2)).cast("float"))
    return _components(
        _vectors(spark, folder).withColumn("embedding", vx.l2_normalize(stretched))
    )


def _fused(spark, folder, how):
    return emb.combine_modalities([_vectors(spark, folder), _second(spark, folder)], how)


def fuse_concat(spark, folder):
    return _components(_fused(spark, folder, "concat"))


def fuse_sum(spark, folder):
    return _components(_fused(spark, folder, "sum"))


def self_reverse_dot(spark, folder):
    df = _vectors(spark, folder)
    product = vx.dot(F.col("embedding"), F.reverse("embedding"))
    return df.select("posting_id", F.round(product, 6).alias("sim"))


def class_prototypes(spark, folder):
    classes = proto.class_prototypes(_vectors(spark, folder))
    return classes.select("class_id", F.posexplode("embedding").alias("pos", "value")).select(
        "class_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def _classified(spark, folder, **options):
    rows = _vectors(spark, folder)
    return proto.classify_by_prototypes(rows, proto.class_prototypes(rows), scale=_SCALE, **options)


def prototype_scores(spark, folder):
    probs = F.posexplode("probs").alias("class_id", "prob")
    return _classified(spark, folder).select("posting_id", probs).select(
        "posting_id", "class_id", F.round("prob", 4).alias("prob")
    )


def prototype_scores_blocked(spark, folder):
    """The path of many classes: rows and prototypes meet block by block."""
    probs = F.posexplode("probs").alias("class_id", "prob")
    return _classified(spark, folder, broadcast_bytes=0).select("posting_id", probs).select(
        "posting_id", "class_id", F.round("prob", 4).alias("prob")
    )


def multiples_score(spark, folder):
    return _classified(spark, folder).select(
        "posting_id", F.round(proto.pick_class("probs", 1), 4).alias("multiples_score")
    )


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize,
        fuse_concat,
        fuse_sum,
        self_reverse_dot,
        class_prototypes,
        prototype_scores,
        prototype_scores_blocked,
        multiples_score,
    )
}

# DuckDB works in doubles and rounds to float where the vector column does.
_V = "CAST(embedding AS DOUBLE[])"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: CAST(x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12) AS FLOAT))"


def _components_sql(cte: str, key: str = "posting_id") -> str:
    return f"""SELECT {key}, pos, {unsigned_zero("value")} AS value FROM (
  SELECT {key}, CAST(unnest(range(len(v))) AS INTEGER) AS pos, round(CAST(unnest(v) AS DOUBLE), 5) AS value
  FROM ({cte}))"""


PROTOTYPES = """parts AS (
  SELECT label AS class_id, pos, sum(x) AS total FROM (
    SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY label, pos),
prototypes AS (
  SELECT class_id, list_transform(t, lambda x: CAST(CAST(
           x / greatest(sqrt(list_dot_product(t, t)), 1e-12) AS FLOAT) AS DOUBLE)) AS v
  FROM (SELECT class_id, list(total ORDER BY pos) AS t FROM parts GROUP BY class_id)),
sims AS (
  SELECT e.vec_id AS posting_id, p.class_id, 30.0::DOUBLE * list_dot_product(CAST(e.embedding AS DOUBLE[]), p.v) AS s
  FROM embeddings e CROSS JOIN prototypes p),
powers AS (
  SELECT posting_id, class_id, exp(s - max(s) OVER (PARTITION BY posting_id)) AS p FROM sims),
probs AS (
  SELECT posting_id, class_id, round(p / sum(p) OVER (PARTITION BY posting_id), 4) AS prob FROM powers)"""

SQL = {
    "l2_normalize": _components_sql(
        f"SELECT vec_id AS posting_id, {_unit('s')} AS v FROM (SELECT vec_id, "
        "CAST(list_transform(embedding, lambda x: CAST(x * (label + 2) AS FLOAT)) AS DOUBLE[]) AS s FROM embeddings)"
    ),
    "fuse_concat": _components_sql(
        f"SELECT vec_id AS posting_id, {_unit('s')} AS v FROM (SELECT vec_id, "
        f"list_concat({_V}, list_reverse({_V})) AS s FROM embeddings)"
    ),
    "fuse_sum": _components_sql(
        f"SELECT vec_id AS posting_id, {_unit('s')} AS v FROM (SELECT vec_id, list_transform(range(1, len(embedding) + 1), "
        f"lambda i: CAST(CAST({_V}[i] + list_reverse({_V})[i] AS FLOAT) AS DOUBLE)) AS s FROM embeddings)"
    ),
    "self_reverse_dot": f"""SELECT posting_id, {unsigned_zero("sim")} AS sim FROM (
  SELECT vec_id AS posting_id, round(list_dot_product({_V}, list_reverse({_V})), 6) AS sim FROM embeddings)""",
    "class_prototypes": f"WITH {PROTOTYPES} {_components_sql('SELECT class_id, v FROM prototypes', 'class_id')}",
    "prototype_scores": f"WITH {PROTOTYPES} SELECT posting_id, class_id, prob FROM probs",
    "multiples_score": f"""WITH {PROTOTYPES} SELECT posting_id, prob AS multiples_score
FROM probs WHERE class_id = 1""",
}
SQL["prototype_scores_blocked"] = SQL["prototype_scores"]
