from __future__ import annotations

import subprocess
import sys

import pytest
from oracle import DATA, ROOT, assert_same


from glossaspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(QUERIES[name], ORACLES[name], spark, DATA)


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_rest_imports_nothing_of_the_training_operators():
    code = "import sys, glossaspark.queries, glossaspark.plans.localize, glossaspark.sources.archives, glossaspark.streaming.sink; assert not [m for m in sys.modules if m.startswith('glossaspark.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    if name not in ("state_stream", "stability_stream"):  # they run as streams
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
