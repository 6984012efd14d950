"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from segflux.catalog import ORACLES, QUERIES  # noqa: E402

ROWS_ONLY = {"model_validation", "rf_train_predict", "rf_importance", "cv_summary", "score_reaches"}


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    assert check.compare(spark, con, name, small) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["hybas_id", "month"] and df.limit(1).count() == 1
