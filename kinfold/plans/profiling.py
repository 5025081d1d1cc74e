"""Jobs: profile the products, count their n-grams, split their groups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from kinfold.operators import profile as pf
from kinfold.operators import splitting
from kinfold.operators.language import LanguageModel, language_scores, target_score
from kinfold.operators.prototypes import classify_by_prototypes, pick_class
from kinfold.session import materialize

# Fixed value: how sharply similarities to the prompts become probabilities.
PROMPT_SCALE = 30
ROW_COLUMNS = ("multiples_score", "indonesian_score")
GROUP_COLUMNS = ("product_count", "multiples_score_std", "indonesian_score_std")


class Profile(NamedTuple):
    rows: DataFrame
    row_statistics: DataFrame
    row_boxes: DataFrame
    groups: DataFrame
    group_statistics: DataFrame
    group_boxes: DataFrame


def augment(
    products: DataFrame,
    embeddings: DataFrame,
    prototypes: DataFrame,
    language_model: LanguageModel,
    *,
    target_language: str,
    text_col: str = "title",
    id_col: str = "posting_id",
    scale: float = PROMPT_SCALE,
    positive_class: int = 1,
) -> DataFrame:
    """Products with ``multiples_score`` and ``indonesian_score``, joined by id."""
    visual = classify_by_prototypes(embeddings, prototypes, scale=scale)
    visual = visual.select(id_col, pick_class("probs", positive_class).alias("multiples_score"))
    spoken = language_scores(products, language_model, text_col=text_col, id_col=id_col)
    spoken = spoken.select(
        id_col, target_score("scores", language_model, target_language).alias("indonesian_score")
    )
    return products.join(visual, id_col, "left").join(spoken, id_col, "left")


def profile(
    augmented: DataFrame, *, id_col: str = "posting_id", group_col: str = "label_group"
) -> Profile:
    """Row and group statistics with the numbers behind their box plots.

    The augmented rows and the group table are written once; everything else
    reads them.
    """
    augmented = materialize(augmented)
    groups = materialize(pf.group_profile(augmented, id_col=id_col, group_col=group_col))
    return Profile(
        augmented,
        pf.describe(augmented, ROW_COLUMNS),
        pf.boxplot_stats(augmented, ROW_COLUMNS),
        groups,
        pf.describe(groups, GROUP_COLUMNS),
        pf.boxplot_stats(groups, GROUP_COLUMNS),
    )


class Split(NamedTuple):
    groups: DataFrame
    assignments: DataFrame
    stratum_counts: DataFrame
    group_counts: DataFrame
    row_counts: DataFrame


def split_groups(
    products: DataFrame,
    group_stats: DataFrame,
    *,
    split_ratios: Sequence[float] = (0.7, 0.15, 0.15),
    random_seed: int = 42,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> Split:
    """Strata, split and row assignments, with the three distributions."""
    groups = splitting.stratified_group_split(
        splitting.assign_stratum(group_stats),
        group_col=group_col,
        split_ratios=split_ratios,
        random_seed=random_seed,
    )
    rows = splitting.assign_rows(products, groups, group_col=group_col, id_col=id_col)
    return Split(
        groups,
        rows,
        pf.value_counts(groups, "stratum"),
        pf.value_counts(groups, "split"),
        pf.value_counts(rows, "split"),
    )
