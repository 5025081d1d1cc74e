from __future__ import annotations

import os

import pytest

from kinfold.session import ensure_checkpoint_dir, materialize, scratch


def tables(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("kinfold-")}


def test_tables_outside_a_scratch_stay(spark):
    before = tables(spark)
    assert materialize(spark.range(3)).count() == 3
    assert len(tables(spark) - before) == 1


def test_a_scratch_deletes_what_was_not_kept(spark):
    before = tables(spark)
    with scratch(spark) as kept:
        first = materialize(spark.range(5))
        result = kept(materialize(first.where("id > 1")))
        with scratch(spark) as inner:
            passed_on = inner(materialize(spark.range(2)))
            materialize(spark.range(9))
        assert passed_on.count() == 2
        assert len(tables(spark) - before) == 3
    assert len(tables(spark) - before) == 1 and result.count() == 3


def test_a_failed_scratch_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(RuntimeError):
        with scratch(spark) as kept:
            kept(materialize(spark.range(5)))
            raise RuntimeError
    assert tables(spark) == before
    materialize(spark.range(1))
    assert len(tables(spark) - before) == 1
