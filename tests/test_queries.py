"""Every query of the engine against its SQL, and that those without SQL run."""

import pytest
from compare import same_rows
from conftest import DATA

from tarnwick.plans.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, str(DATA)), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_stats_of_every_tone(spark):
    out = QUERIES["fbank_stats"](spark, str(DATA)).select("event_id")
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id")
    assert out.count() == events.count() and events.join(out, "event_id", "left_anti").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
