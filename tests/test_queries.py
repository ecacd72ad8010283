"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run and hold their invariants."""

import pytest
from compare import connect, spark_rows, sql_rows

from driftline.plans.oracles import ORACLE
from driftline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Of those without SQL the ones that fit no model over many passes; ``test_models`` has the fits.
RUN = "ag11_rhat ag12_ess m1_spline_posterior m2_spline_posterior_plain m3_trajectory_probabilities m8_block_pca m16_time_logistic".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(con, ORACLE[name])


@pytest.mark.parametrize("name", RUN)
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    for c in df.columns:
        if c.startswith(("traj_prob_", "ps", "hazard")):
            assert all(r[c] is None or r[c] >= 0 for r in rows)
        if c.startswith("traj_prob_") or c == "hazard":
            assert all(r[c] is None or r[c] <= 1 for r in rows)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
