"""Registered queries: group profiles, strata, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import profile, quantiles, sampling, splitting
from kinfold.operators.embeddings import select_split
from kinfold.plans import profiling
from kinfold.registry.fragments import (
    LISTINGS,
    SCORES,
    SPLITS,
    STDS,
    STRATA,
    listings,
    profile_sql,
    rounded_profile,
    splits,
    strata,
)

_GROUP_COLUMNS = ("product_count", *STDS)


def _round(df, digits=9):
    """Doubles rounded, other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def group_profile(spark, folder):
    return _round(profile.group_profile(listings(spark, folder), score_cols=SCORES))


def describe_scores(spark, folder):
    return _round(profile.describe(listings(spark, folder), SCORES))


def describe_groups(spark, folder):
    return _round(profile.describe(rounded_profile(listings(spark, folder)), _GROUP_COLUMNS))


def boxplot_stats(spark, folder):
    return _round(profile.boxplot_stats(rounded_profile(listings(spark, folder)), _GROUP_COLUMNS))


def boxplot_outliers(spark, folder):
    return _round(profile.boxplot_outliers(rounded_profile(listings(spark, folder)), _GROUP_COLUMNS))


def third_quartiles(spark, folder):
    return _round(
        quantiles.exact_quantiles(rounded_profile(listings(spark, folder)), _GROUP_COLUMNS, [0.75])
    )


def group_strata(spark, folder):
    return strata(listings(spark, folder)).select("label_group", "stratum")


def stratum_counts(spark, folder):
    return profile.value_counts(strata(listings(spark, folder)), "stratum")


def group_split(spark, folder):
    return splits(listings(spark, folder)).select("label_group", "stratum", "split")


def group_split_counts(spark, folder):
    return profile.value_counts(splits(listings(spark, folder)), "split")


def _assignments(spark, folder):
    rows = listings(spark, folder)
    return splitting.assign_rows(rows, splits(rows))


def assignments(spark, folder):
    return _assignments(spark, folder)


def row_split_counts(spark, folder):
    return profile.value_counts(_assignments(spark, folder), "split")


def group_sizes(spark, folder):
    return profile.value_counts(listings(spark, folder), "label_group")


# The paths that only large tables take, forced on the given ones.


def quantiles_bracketed(spark, folder):
    profile_rows = rounded_profile(listings(spark, folder))
    return _round(quantiles.exact_quantiles(profile_rows, _GROUP_COLUMNS, [0.75], small_rows=0))


def hot_key_assignments(spark, folder):
    """Groups of more than 25 rows take the way of hot keys."""
    rows = listings(spark, folder)
    return splitting.assign_rows(rows, splits(rows), hot_rows=25)


def split_null_stratum(spark, folder):
    """Groups of the lower stratum lose their label; a null stratum is drawn like any other."""
    named = F.when(F.col("stratum") == "higher_variance", F.col("stratum"))
    groups = strata(listings(spark, folder)).withColumn("stratum", named)
    return splitting.stratified_group_split(groups).select("label_group", "stratum", "split")


def split_job(spark, folder):
    """The split job: its three distributions and, by split and stratum, the rows it assigned."""
    rows = listings(spark, folder)
    split = profiling.split_groups(rows, rounded_profile(rows))
    named = lambda df, name: df.select(
        F.lit(name).alias("table"), F.col(df.columns[0]).alias("value"), F.lit(None).cast("string").alias("stratum"), "count"
    )
    counts = named(split.stratum_counts, "strata").unionByName(named(split.group_counts, "groups"))
    both = split.assignments.groupBy("split", "stratum").count().select(
        F.lit("assignments").alias("table"), F.col("split").alias("value"), "stratum", "count"
    )
    return counts.unionByName(named(split.row_counts, "rows")).unionByName(both)


def train_val_classes(spark, folder):
    """Class ids over the labels of two splits together, and each row of both with its class."""
    rows = _assignments(spark, folder).select("posting_id", "label_group", "split")
    train, val = select_split(rows, "train"), select_split(rows, "val")
    ids = sampling.class_ids(train, val)
    return train.unionByName(val).join(ids.hint("shuffle_hash"), "label_group").select("posting_id", "label_group", "split", "class_id")


QUERIES = {
    f.__name__: f
    for f in (
        group_profile,
        describe_scores,
        describe_groups,
        boxplot_stats,
        boxplot_outliers,
        third_quartiles,
        group_strata,
        stratum_counts,
        group_split,
        group_split_counts,
        assignments,
        row_split_counts,
        group_sizes,
        quantiles_bracketed,
        hot_key_assignments,
        split_null_stratum,
        split_job,
        train_val_classes,
    )
}

_PROFILE = f"WITH {LISTINGS},\n{profile_sql('listings')}"
_STRATA = f"{_PROFILE},\n{STRATA}"
_SPLITS = f"{_STRATA},\n{SPLITS}"


def _describe_sql(source: str, columns) -> str:
    def row(name: str, call: str) -> str:
        cells = ", ".join(f"round({call.format(c=c)}, 9) AS {c}" for c in columns)
        return f"SELECT '{name}' AS statistic, {cells} FROM {source}"

    calls = {
        "count": "CAST(count({c}) AS DOUBLE)",
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "CAST(min({c}) AS DOUBLE)",
        "25%": "quantile_cont(CAST({c} AS DOUBLE), 0.25)",
        "50%": "quantile_cont(CAST({c} AS DOUBLE), 0.5)",
        "75%": "quantile_cont(CAST({c} AS DOUBLE), 0.75)",
        "max": "CAST(max({c}) AS DOUBLE)",
    }
    return "\nUNION ALL ".join(row(n, c) for n, c in calls.items())


_MELTED = "melted AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM rounded WHERE {c} IS NOT NULL"
    for c in _GROUP_COLUMNS
) + ")"
_BOXES = """boxes AS (
  SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM melted GROUP BY "column"),
fenced AS (
  SELECT m.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM melted m JOIN boxes USING ("column"))"""

SQL = {
    "group_profile": f"""{_PROFILE} SELECT label_group, product_count,
round(multiples_score_mean, 9) AS multiples_score_mean, round(multiples_score_std, 9) AS multiples_score_std,
round(indonesian_score_mean, 9) AS indonesian_score_mean, round(indonesian_score_std, 9) AS indonesian_score_std
FROM profile""",
    "describe_scores": f"WITH {LISTINGS} {_describe_sql('listings', SCORES)}",
    "describe_groups": f"{_STRATA} {_describe_sql('rounded', _GROUP_COLUMNS)}",
    "boxplot_stats": f"""{_STRATA}, {_MELTED}, {_BOXES}
SELECT "column", round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
       round(least(min(value) FILTER (inside), q1), 9) AS whisker_low,
       round(greatest(max(value) FILTER (inside), q3), 9) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM fenced GROUP BY "column", q1, median, q3""",
    "boxplot_outliers": f"""{_STRATA}, {_MELTED}, {_BOXES}
SELECT "column", round(value, 9) AS value, count(*) AS rows FROM fenced WHERE NOT inside
GROUP BY "column", fenced.value""",
    "third_quartiles": f"""{_STRATA}, {_MELTED}
SELECT "column", CAST(0.75 AS DOUBLE) AS prob, round(quantile_cont(value, 0.75), 9) AS value
FROM melted GROUP BY "column\"""",
    "group_strata": f"{_STRATA} SELECT label_group, stratum FROM strata",
    "stratum_counts": f"{_STRATA} SELECT stratum, count(*) AS count FROM strata GROUP BY stratum",
    "group_split": f"{_SPLITS} SELECT label_group, stratum, split FROM splits",
    "group_split_counts": f"{_SPLITS} SELECT split, count(*) AS count FROM splits GROUP BY split",
    "assignments": f"""{_SPLITS} SELECT l.*, s.split, s.stratum
FROM listings l LEFT JOIN splits s USING (label_group)""",
    "row_split_counts": f"""{_SPLITS} SELECT s.split, count(*) AS count
FROM listings l JOIN splits s USING (label_group) GROUP BY s.split""",
    "group_sizes": f"""WITH {LISTINGS} SELECT label_group, count(*) AS count
FROM listings WHERE label_group IS NOT NULL GROUP BY label_group""",
}
SQL["split_job"] = f"""{_SPLITS},
rows AS (SELECT l.posting_id, s.split, s.stratum FROM listings l JOIN splits s USING (label_group))
SELECT 'strata' AS "table", stratum AS value, CAST(NULL AS VARCHAR) AS stratum, count(*) AS count FROM strata GROUP BY strata.stratum
UNION ALL SELECT 'groups', split, NULL, count(*) FROM splits GROUP BY split
UNION ALL SELECT 'rows', split, NULL, count(*) FROM rows GROUP BY split
UNION ALL SELECT 'assignments', split, stratum, count(*) FROM rows GROUP BY split, stratum"""
SQL["train_val_classes"] = f"""{_SPLITS},
rows AS (SELECT l.posting_id, label_group, s.split FROM listings l JOIN splits s USING (label_group)
         WHERE s.split IN ('train', 'val')),
ids AS (SELECT label_group, row_number() OVER (ORDER BY label_group) - 1 AS class_id
        FROM (SELECT DISTINCT label_group FROM rows))
SELECT posting_id, label_group, split, class_id FROM rows JOIN ids USING (label_group)"""
SQL["quantiles_bracketed"] = SQL["third_quartiles"]
SQL["hot_key_assignments"] = SQL["assignments"]
# Of two strata the ties of the largest remainder are the only place where the name counts.
SQL["split_null_stratum"] = f"""{_SPLITS} SELECT label_group,
CASE WHEN stratum = 'higher_variance' THEN stratum END AS stratum, split FROM splits"""
