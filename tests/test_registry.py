"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare, oracle_connection  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NO_ORACLE = {"approx_similarity_join", "index_recall", "projection_fit", "variant_matrix"}


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


def test_only_the_named_queries_lack_an_oracle():
    from kinfold.registry import all_queries, all_sql

    assert set(all_queries()) - set(all_sql()) == NO_ORACLE
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    problem, rows, _ = compare(spark, duck, FOLDER, name)
    assert problem is None and rows > 0


def test_approximate_pairs_are_a_subset_of_the_exact(spark):
    from kinfold.operators.neighbors import similarity_join
    from kinfold.registry.retrieval import _vectors

    got = {tuple(r) for r in contract.queries()["approx_similarity_join"](spark, FOLDER).drop("rank").collect()}
    exact = {tuple(r) for r in similarity_join(_vectors(spark, FOLDER), 0.5).drop("rank").collect()}
    assert got <= exact and len(got) >= 500  # at least every row finds itself


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["precision"] <= 1


def test_core_queries_survive_a_missing_requirement_of_the_corpus_operators():
    root = str(Path(__file__).resolve().parents[1])
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; "
        f"sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
        "from kinfold.registry import all_queries; assert set(e.queries()) == set(all_queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
