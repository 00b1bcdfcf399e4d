"""Every query of the core against its SQL on the smallest data; those without SQL must run."""

import pytest

from tests.oracle import DATA, connect, same
from voxelmill.plans import catalogue

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_query_without_sql_is_sequential_or_iterative():
    rest = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert rest == {"nms_points", "hull_volume", "config_sweep", "residue_config_sweep", "platt_fit", "isotonic_fit"}
