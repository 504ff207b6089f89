"""Every query against its SQL twin on the smallest data set."""

import pytest
from compare import compare, duck

from oracle.sql import ORACLE_SQL
from wireloom.plans.queries import QUERIES

MODEL_QUERIES = [
    "isolation_forest", "one_class_novelty", "direct_classifier", "sequence_classifier", "train_meta",
    "ensemble_score", "train_all", "model_io",
]


def test_only_model_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLE_SQL) == set(MODEL_QUERIES)
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_twin(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name]) == ""
