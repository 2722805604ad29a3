"""Registered queries against their SQL on another engine."""

import pytest

from hornspark.operators.catalogue import QUERIES, SQL

from .oracle import DATA, same_rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert (row.head_size, row.support, row.body_size, row.pca_body_size) == (1444, 1444, 1444, 1444)
    assert set(SQL) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_miners_run_over_the_whole_store():
    from hornspark.operators.catalogue import MINED
    from hornspark.plans.mine import MiningConfig

    for config, _ in MINED.values():
        assert not config.head_targets and not config.body_targets and config.max_depth == MiningConfig().max_depth


def test_mine_default_reaches_the_large_heads(spark):
    heads = {r.rule.split(" => ")[1].split()[1] for r in QUERIES["mine_default"](spark, str(DATA.parent / "sf0.001")).collect()}
    assert heads - {"customerNation", "supplierNation"}
