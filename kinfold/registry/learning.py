"""Registered queries: languages, encoders, sampling, projection and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.text import SLANG_PHRASES, WORD
from kinfold.operators import encoding, language, projection, sampling, training
from kinfold.operators.embeddings import select_split
from kinfold.operators.prototypes import class_prototypes
from kinfold.plans import profiling, variants
from kinfold.registry.fragments import (
    LISTINGS,
    PRODUCT_ASSIGNMENTS,
    PRODUCTS,
    assigned_products,
    fixed_head,
    listings,
    products,
    profile_sql,
    table,
    unit_list,
    unsigned_zero,
)
from kinfold.registry.text import clean_sql
from kinfold.registry.vectors import PROTOTYPES
from kinfold.session import materialize
from kinfold.sources.tables import run_log as log_rows

_MAX_N = 5
_DIM = 32
_IN = 64


def _model(spark, folder):
    return language.train_language_model(table(spark, folder, "documents"), max_n=_MAX_N)


def language_profile(spark, folder):
    model = _model(spark, folder)
    return model.profile.select("gram", F.posexplode("logp").alias("lang", "logp")).select(
        "gram", "lang", F.round("logp", 6).alias("logp")
    )


def language_scores(spark, folder):
    docs = table(spark, folder, "documents")
    scores = language.language_scores(docs, _model(spark, folder), text_col="text", id_col="doc_id")
    return scores.select("doc_id", F.posexplode("scores").alias("lang", "score")).select(
        "doc_id", "lang", F.round("score", 5).alias("score")
    )


def language_scores_shuffled(spark, folder):
    """The path of large profiles: n-grams counted by row, then joined by n-gram."""
    docs = table(spark, folder, "documents")
    scores = language.language_scores(
        docs, _model(spark, folder), text_col="text", id_col="doc_id", broadcast_grams=0
    )
    return scores.select("doc_id", F.posexplode("scores").alias("lang", "score")).select(
        "doc_id", "lang", F.round("score", 5).alias("score")
    )


def text_embeddings(spark, folder):
    vectors = encoding.encode_texts(
        table(spark, folder, "documents"),
        lambda: encoding.HashedWords(_DIM),
        text_col="text",
        id_col="doc_id",
    )
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).select(
        "doc_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def pictures(spark, folder):
    """Each vector drawn as an 8 x 8 grey picture in Spark's image struct."""
    level = F.transform(
        "embedding",
        lambda x: F.lpad(
            F.hex(F.least(F.greatest(F.floor((x.cast("double") + 1) * 128), F.lit(0)), F.lit(255))), 2, "0"
        ),
    )
    image = F.struct(
        F.lit("").alias("origin"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"),
        F.unhex(F.array_join(level, "")).alias("data"),
    )
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), image.alias("image"))


def image_embeddings(spark, folder):
    vectors = encoding.encode_images(pictures(spark, folder))
    return vectors.select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def class_ids(spark, folder):
    return sampling.class_ids(listings(spark, folder))


def m_per_class_sample(spark, folder):
    rows = listings(spark, folder).select("posting_id", "label_group")
    return sampling.m_per_class_sample(rows)


def random_batches(spark, folder):
    """An epoch of random batches over all listings, classes and rows drawn anew for every batch."""
    rows = listings(spark, folder).select("posting_id", "label_group")
    return sampling.random_batches(rows)


def projection_apply(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")
    stored = fixed_head().to_table(spark)
    projected = projection.apply_head(vectors, projection.ProjectionHead.from_table(stored))
    return projected.select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


# The published configuration of training: scale 20, a margin of 0.2 radians.
_LOSS = {"scale": 20.0, "margin_degrees": 11.459155902616466}


def projection_fit(spark, folder):
    """The log of a training run with early stopping: losses, validation metrics and rates by epoch."""
    rows = assigned_products(spark, folder).select("posting_id", "label_group", "split", "embedding")
    fit = training.fit_head(select_split(rows, "train"), select_split(rows, "val"), **_LOSS)
    return log_rows(spark, "registered", "metric_learning", fit.history)


def _variant_inputs(spark, folder):
    assigned = assigned_products(spark, folder)
    images = assigned.select("posting_id", "embedding")
    titles = materialize(encoding.encode_texts(assigned, lambda: encoding.HashedWords(_IN)))
    return assigned.drop("embedding"), {"images": images, "titles": titles}


def _six(df):
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def variant_matrix(spark, folder):
    """Four variants, frozen and by the head fitted on each, over the grid of val and at the best threshold of test."""
    assigned, modalities = _variant_inputs(spark, folder)
    fits = variants.fit_variants(assigned, modalities, **_LOSS)
    return _six(variants.run_variants(assigned, modalities, heads={name: f.head for name, f in fits.items()}))


def variant_matrix_frozen(spark, folder):
    return _six(variants.run_variants(*_variant_inputs(spark, folder)))


def variant_matrix_fixed_heads(spark, folder):
    """Both halves of the matrix with heads whose weights follow a formula."""
    assigned, modalities = _variant_inputs(spark, folder)
    widths = {"images": _IN, "titles": _IN, "multimodal_concat": 2 * _IN, "multimodal_sum": _IN}
    heads = {name: fixed_head(width) for name, width in widths.items()}
    return _six(variants.run_variants(assigned, modalities, heads=heads))


def profile_job(spark, folder):
    """Group profile of two scores: class from the vector, share of English from the title."""
    rows = materialize(products(spark, folder).drop("multiples_score", "indonesian_score"))
    docs = table(spark, folder, "documents")
    prototypes = class_prototypes(table(spark, folder, "embeddings"))
    model = language.train_language_model(docs, max_n=_MAX_N)
    augmented = profiling.augment(
        rows.drop("embedding"), rows.select("posting_id", "embedding"), prototypes, model, target_language="en"
    )
    groups = profiling.profile(augmented).groups
    return groups.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in groups.dtypes])


QUERIES = {
    f.__name__: f
    for f in (
        language_profile,
        language_scores,
        language_scores_shuffled,
        text_embeddings,
        image_embeddings,
        class_ids,
        m_per_class_sample,
        random_batches,
        projection_apply,
        projection_fit,
        variant_matrix,
        variant_matrix_frozen,
        variant_matrix_fixed_heads,
        profile_job,
    )
}

_LETTERS = "regexp_extract_all(lower(coalesce(text, 'nan')), '\\p{L}+')"
_PROFILE = f"""words AS (SELECT doc_id, lang, unnest({_LETTERS}) AS w FROM documents),
word_counts AS (SELECT doc_id, lang, w, count(*) AS c FROM words GROUP BY doc_id, lang, w),
grams AS (
  SELECT doc_id, lang, c, n, substr(w, i, n) AS gram FROM (
    SELECT doc_id, lang, w, c, n, unnest(range(1, length(w) - n + 2)) AS i
    FROM word_counts CROSS JOIN (SELECT unnest(range(1, {_MAX_N} + 1)) AS n) WHERE length(w) >= n)),
seen AS (SELECT gram, n, lang, sum(c) AS c FROM grams WHERE lang IS NOT NULL GROUP BY gram, n, lang),
langs AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS id
          FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
space AS (
  SELECT n, l.lang, l.id, coalesce(sum(c) FILTER (s.lang = l.lang), 0) + count(DISTINCT gram) + 1 AS total
  FROM seen s CROSS JOIN langs l GROUP BY n, l.lang, l.id),
gram_profile AS (
  SELECT g.gram, t.id AS lang, ln((coalesce(s.c, 0) + 1) / CAST(t.total AS DOUBLE)) AS logp
  FROM (SELECT DISTINCT gram, n FROM seen) g JOIN space t USING (n)
  LEFT JOIN seen s ON s.gram = g.gram AND s.lang = t.lang)"""



def _clean(column: str) -> str:
    return clean_sql(f"coalesce({column}, 'nan')", SLANG_PHRASES)["clean"]


_VARIANTS = f"""{PRODUCT_ASSIGNMENTS},
title_words AS (
  SELECT posting_id, unnest(regexp_extract_all(lower({_clean("title")}), '{WORD}+')) AS w FROM assigned),
title_codes AS (SELECT posting_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM title_words),
title_sums AS (
  SELECT posting_id, h % {_IN} AS pos, sum(CASE WHEN h // {_IN} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v
  FROM title_codes GROUP BY posting_id, pos),
title_filled AS (
  SELECT a.posting_id, list(coalesce(v, 0) ORDER BY p) AS v
  FROM assigned a CROSS JOIN (SELECT unnest(range({_IN})) AS p) r
  LEFT JOIN title_sums t ON t.posting_id = a.posting_id AND t.pos = r.p GROUP BY a.posting_id),
paired AS (
  SELECT a.posting_id, label_group, stratum, split, embedding AS x, {unit_list("v")} AS y
  FROM assigned a JOIN title_filled USING (posting_id) WHERE split IN ('val', 'test')),
joined AS (
  SELECT *, list_concat(x, y) AS xy,
         list_transform(list_zip(x, y), lambda z: CAST(CAST(z[1] + z[2] AS FLOAT) AS DOUBLE)) AS s FROM paired),
vectors AS (
  SELECT 'images' AS variant, posting_id, label_group, split, x AS v FROM joined
  UNION ALL SELECT 'titles', posting_id, label_group, split, y FROM joined
  UNION ALL SELECT 'multimodal_concat', posting_id, label_group, split, {unit_list("xy")} FROM joined
  UNION ALL SELECT 'multimodal_sum', posting_id, label_group, split, {unit_list("s")} FROM joined)"""

# The fixed heads: the linear map, batch normalisation with fixed statistics, unit length.
_HEADED = f""",
coded AS (
  SELECT variant, posting_id, label_group, split, j,
         sum(x * ((j * 7 + i * 3) % 11 - 5) / 10.0::DOUBLE) + j / 10.0::DOUBLE AS z
  FROM (SELECT *, unnest(range(len(v))) AS i, unnest(v) AS x FROM vectors) CROSS JOIN (SELECT unnest(range(8)) AS j)
  GROUP BY variant, posting_id, label_group, split, j),
normed AS (
  SELECT variant, posting_id, label_group, split,
         list((z - j / 20.0::DOUBLE) / sqrt(1 + j / 4.0::DOUBLE + 1e-5) * (1 + j / 8.0::DOUBLE)
              + j / 100.0::DOUBLE ORDER BY j) AS v
  FROM coded GROUP BY variant, posting_id, label_group, split),
sets AS (
  SELECT 'frozen' AS head, * FROM vectors
  UNION ALL SELECT 'projected', variant, posting_id, label_group, split, {unit_list("v")} FROM normed)"""

_MATRIX = """,
pairs AS (
  SELECT a.variant, a.head, a.split, a.posting_id AS q, b.posting_id AS n, a.label_group = b.label_group AS hit,
         round(list_dot_product(a.v, b.v), 9) AS sim
  FROM sets a JOIN sets b USING (variant, head, split)),
found AS (
  SELECT *, row_number() OVER (PARTITION BY variant, head, split, q ORDER BY sim DESC, n) AS rank
  FROM pairs QUALIFY rank <= 51),
groups AS (SELECT variant, head, split, label_group, count(*) AS size FROM sets GROUP BY ALL),
steps AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
counted AS (
  SELECT s.variant, s.head, s.split, s.posting_id, threshold, any_value(g.size) AS size, count(n) AS got,
         count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND rank <= 5) AS h5,
         count(*) FILTER (hit AND rank <= 10) AS h10, count(*) FILTER (hit AND rank <= 50) AS h50
  FROM sets s JOIN groups g USING (variant, head, split, label_group) CROSS JOIN steps
  LEFT JOIN found f ON f.variant = s.variant AND f.head = s.head AND f.split = s.split
    AND f.q = s.posting_id AND sim >= threshold
  GROUP BY s.variant, s.head, s.split, s.posting_id, threshold),
ratios AS (
  SELECT *, CASE WHEN got > 0 THEN hits / CAST(got AS DOUBLE) ELSE 0 END AS p, hits / CAST(size AS DOUBLE) AS r
  FROM counted),
means AS (
  SELECT variant, head, split, threshold, avg(p) AS avg_precision, avg(r) AS avg_recall,
         avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS avg_f1,
         avg(h5 / CAST(size AS DOUBLE)) AS "avg_recall-5", avg(h10 / CAST(size AS DOUBLE)) AS "avg_recall-10",
         avg(h50 / CAST(size AS DOUBLE)) AS "avg_recall-50"
  FROM ratios GROUP BY variant, head, split, threshold),
best AS (
  SELECT variant, head, threshold FROM means WHERE split = 'val'
  QUALIFY row_number() OVER (PARTITION BY variant, head ORDER BY round(avg_f1, 12) DESC, threshold) = 1)
SELECT variant, head, split, threshold, round(avg_precision, 6) AS avg_precision, round(avg_recall, 6) AS avg_recall,
       round(avg_f1, 6) AS avg_f1, round("avg_recall-5", 6) AS "avg_recall-5",
       round("avg_recall-10", 6) AS "avg_recall-10", round("avg_recall-50", 6) AS "avg_recall-50"
FROM means WHERE split = 'val' OR (variant, head, threshold) IN (SELECT variant, head, threshold FROM best)"""

SQL = {
    "variant_matrix_frozen": f"WITH {_VARIANTS},\nsets AS (SELECT 'frozen' AS head, * FROM vectors){_MATRIX}",
    "variant_matrix_fixed_heads": f"WITH {_VARIANTS}{_HEADED}{_MATRIX}",
    "language_profile": f"WITH {_PROFILE} SELECT gram, lang, round(logp, 6) AS logp FROM gram_profile",
    "language_scores": f"""WITH {_PROFILE},
sums AS (
  SELECT doc_id, p.lang, sum(c * logp) AS s FROM grams g JOIN gram_profile p USING (gram)
  GROUP BY doc_id, p.lang),
whole AS (
  SELECT d.doc_id, l.id AS lang, coalesce(s, 0) AS s FROM documents d CROSS JOIN langs l
  LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.lang = l.id),
powers AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) AS p FROM whole)
SELECT doc_id, lang, round(p / sum(p) OVER (PARTITION BY doc_id), 5) AS score FROM powers""",
    "text_embeddings": f"""WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower({_clean("text")}), '{WORD}+')) AS w FROM documents),
coded AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM words),
totals AS (
  SELECT doc_id, h % {_DIM} AS pos, sum(CASE WHEN h // {_DIM} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v
  FROM coded GROUP BY doc_id, pos),
filled AS (
  SELECT d.doc_id, CAST(p AS INTEGER) AS pos, coalesce(t.v, 0) AS v
  FROM documents d CROSS JOIN (SELECT unnest(range({_DIM})) AS p) r
  LEFT JOIN totals t ON t.doc_id = d.doc_id AND t.pos = r.p)
SELECT doc_id, pos, round(CAST(CAST(
  v / greatest(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 1e-12) AS FLOAT) AS DOUBLE), 5) AS value
FROM filled""",
    "image_embeddings": """WITH pixels AS (
  SELECT vec_id, unnest(range(64)) AS i,
         least(greatest(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 128), 0), 255) AS x FROM embeddings),
histogram AS (
  SELECT vec_id, b AS pos, count(*) FILTER (floor(x * 8 / 256) = b) / 64.0::DOUBLE AS v
  FROM pixels CROSS JOIN (SELECT unnest(range(8)) AS b) GROUP BY vec_id, b),
means AS (
  SELECT vec_id, 24 + (i // 8 // 2) * 4 + i % 8 // 2 AS pos, avg(x) / 255 AS v FROM pixels GROUP BY vec_id, pos),
features AS (
  SELECT vec_id, pos + 8 * c AS pos, v FROM histogram CROSS JOIN (SELECT unnest(range(3)) AS c)
  UNION ALL SELECT vec_id, pos + 16 * c, v FROM means CROSS JOIN (SELECT unnest(range(3)) AS c))
SELECT vec_id AS posting_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(
  v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM features""",
    "profile_job": f"""WITH {PRODUCTS}, {PROTOTYPES}, {_PROFILE},
visual AS (
  SELECT posting_id, class_id, p / sum(p) OVER (PARTITION BY posting_id) AS score FROM powers),
title_words AS (
  SELECT posting_id, unnest(regexp_extract_all(lower(coalesce(title, 'nan')), '\\p{{L}}+')) AS w FROM products),
title_grams AS (
  SELECT posting_id, n, substr(w, i, n) AS gram FROM (
    SELECT posting_id, w, n, unnest(range(1, length(w) - n + 2)) AS i
    FROM title_words CROSS JOIN (SELECT unnest(range(1, {_MAX_N} + 1)) AS n) WHERE length(w) >= n)),
title_sums AS (
  SELECT posting_id, s.id AS lang, sum(coalesce(logp, -ln(CAST(s.total AS DOUBLE)))) AS s
  FROM title_grams g JOIN space s USING (n)
  LEFT JOIN gram_profile p ON p.gram = g.gram AND p.lang = s.id GROUP BY posting_id, s.id),
title_powers AS (
  SELECT p.posting_id, l.lang, coalesce(s, 0) AS s FROM products p CROSS JOIN langs l
  LEFT JOIN title_sums t ON t.posting_id = p.posting_id AND t.lang = l.id),
title_shares AS (
  SELECT posting_id, lang, e / sum(e) OVER (PARTITION BY posting_id) AS score FROM (
    SELECT posting_id, lang, exp(s - max(s) OVER (PARTITION BY posting_id)) AS e FROM title_powers)),
augmented AS (
  SELECT p.posting_id, p.label_group, v.score AS multiples_score, t.score AS indonesian_score FROM products p
  JOIN visual v ON v.posting_id = p.posting_id AND v.class_id = 1
  JOIN title_shares t ON t.posting_id = p.posting_id AND t.lang = 'en'),
{profile_sql("augmented")}
SELECT label_group, product_count,
       round(multiples_score_mean, 6) AS multiples_score_mean, round(multiples_score_std, 6) AS multiples_score_std,
       round(indonesian_score_mean, 6) AS indonesian_score_mean, round(indonesian_score_std, 6) AS indonesian_score_std
FROM profile""",
    "class_ids": f"""WITH {LISTINGS} SELECT label_group, row_number() OVER (ORDER BY label_group) - 1 AS class_id
FROM (SELECT DISTINCT label_group FROM listings)""",
    "m_per_class_sample": f"""WITH {LISTINGS},
drawn AS (
  SELECT posting_id, label_group, count(*) OVER (PARTITION BY label_group) AS n,
         row_number() OVER (PARTITION BY label_group ORDER BY md5(concat('42:1:', posting_id))) AS pos
  FROM listings),
classes AS (
  SELECT label_group, (row_number() OVER (ORDER BY md5(concat('42:1:', label_group))) - 1) // 64 AS step
  FROM (SELECT DISTINCT label_group FROM listings)),
slots AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS slot)
SELECT posting_id, label_group, CAST(step AS INTEGER) AS step, slot
FROM drawn JOIN classes USING (label_group) JOIN slots ON slot % least(n, 4) = pos - 1
WHERE pos <= 4""",
    "random_batches": f"""WITH {LISTINGS},
classes AS (
  SELECT label_group, count(*) AS size, row_number() OVER (ORDER BY label_group) - 1 AS class
  FROM listings GROUP BY label_group),
placed AS (
  SELECT posting_id, label_group, class, size,
         row_number() OVER (PARTITION BY label_group ORDER BY md5(concat('42:', posting_id))) - 1 AS pos
  FROM listings JOIN classes USING (label_group)),
steps AS (SELECT unnest(range(390)) AS step, (SELECT count(*) FROM classes) AS n),
class_tries AS (SELECT step, n, unnest(range(CASE WHEN n <= 256 THEN n ELSE 256 END)) AS t FROM steps),
class_draws AS (
  SELECT step, CASE WHEN n <= 256 THEN t ELSE CAST('0x' || substr(md5(concat_ws(':', 42, 1, 'class', step, t)), 1, 12) AS BIGINT) % n END AS class,
         CASE WHEN n <= 256 THEN md5(concat_ws(':', 42, 1, 'class', step, t)) ELSE lpad(CAST(t AS VARCHAR), 12, '0') END AS o
  FROM class_tries),
chosen AS (
  SELECT step, class FROM (SELECT step, class, min(o) AS o FROM class_draws GROUP BY step, class)
  QUALIFY row_number() OVER (PARTITION BY step ORDER BY o) <= 64),
held AS (SELECT step, class, size FROM chosen JOIN classes USING (class)),
row_tries AS (SELECT step, class, size, unnest(range(CASE WHEN size <= 32 THEN size ELSE 32 END)) AS t FROM held WHERE size >= 4),
row_draws AS (
  SELECT step, class, CASE WHEN size <= 32 THEN t ELSE CAST('0x' || substr(md5(concat_ws(':', 42, 1, 'row', step, class, t)), 1, 12) AS BIGINT) % size END AS pos,
         CASE WHEN size <= 32 THEN md5(concat_ws(':', 42, 1, 'row', step, class, t)) ELSE lpad(CAST(t AS VARCHAR), 12, '0') END AS o
  FROM row_tries),
within AS (
  SELECT step, class, pos, row_number() OVER (PARTITION BY step, class ORDER BY o) - 1 AS slot
  FROM (SELECT step, class, pos, min(o) AS o FROM row_draws GROUP BY step, class, pos) QUALIFY slot < 4),
again AS (
  SELECT step, class, CAST('0x' || substr(md5(concat_ws(':', 42, 1, 'again', step, class, slot)), 1, 12) AS BIGINT) % size AS pos, slot
  FROM held CROSS JOIN (SELECT unnest(range(4)) AS slot) WHERE size < 4)
SELECT posting_id, label_group, CAST(step AS INTEGER) AS step, CAST(slot AS INTEGER) AS slot
FROM (SELECT * FROM within UNION ALL SELECT * FROM again) JOIN placed USING (class, pos)""",
    "projection_apply": """WITH cells AS (
  SELECT vec_id, j, sum(x * ((j * 7 + i * 3) % 11 - 5) / 10.0::DOUBLE) + j / 10.0::DOUBLE AS z
  FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  CROSS JOIN (SELECT unnest(range(8)) AS j) GROUP BY vec_id, j),
normed AS (
  SELECT vec_id, j, (z - j / 20.0::DOUBLE) / sqrt(1 + j / 4.0::DOUBLE + 1e-5) * (1 + j / 8.0::DOUBLE)
                    + j / 100.0::DOUBLE AS y FROM cells)
SELECT posting_id, pos, """
    + unsigned_zero("value")
    + """ AS value FROM (
  SELECT vec_id AS posting_id, CAST(j AS INTEGER) AS pos, round(CAST(CAST(
    y / greatest(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 1e-12) AS FLOAT) AS DOUBLE), 5) AS value
  FROM normed)""",
}
SQL["language_scores_shuffled"] = SQL["language_scores"]
