import os

import pytest

from sparkvane.plans import registry

from . import oracle

SLOW = {"cv_score", "learning_curve", "shap_importance", "robustness", "feature_importance", "kmeans_wcss"}


@pytest.fixture(scope="session")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, sf, con, name):
    oracle.same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, sf, name):
    registry.QUERIES[name](spark, sf).collect()


def test_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(sf) and e.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SLOW))
def test_models_run(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows and all(v is None or v == v for r in rows for v in r)
