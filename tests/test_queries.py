"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from sluicegate.plans import queries as engine

DATA = "/root/testdata/sf0.001"
SLOW = {"train_boosted_scores", "walk_forward_validation", "train_linear_scores"}


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - SLOW))
def test_query(spark, oracle, same_rows, name):
    got = engine.queries()[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in engine.oracle_sql():
        assert same_rows(got, oracle("sf0.001").sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["zscore_detector", "alarm_rates", "mahalanobis", "mahalanobis_many"])
@pytest.mark.parametrize("first", [7, 400])
def test_reference_without_spread(spark, tmp_path, same_rows, name, first):
    """All reference events in one hour (the other events in all): divisions by no spread are those of the SQL."""
    import duckdb

    con = duckdb.connect()
    moved = "CASE WHEN event_id < 400 THEN TIMESTAMP '2024-01-01 05:00:00' + to_seconds(event_id) ELSE ts END"
    con.sql(f"COPY (SELECT * REPLACE ({moved} AS ts) FROM '{DATA}/events.parquet' WHERE event_id < {first} OR event_id >= 400) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert same_rows(engine.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["zscore_detector", "mahalanobis", "mahalanobis_many"])
def test_without_reference(spark, tmp_path, same_rows, name):
    """No event is a reference event: every score is null, as in the SQL."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{DATA}/events.parquet' WHERE event_id >= 400) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = engine.queries()[name](spark, str(tmp_path))
    assert got.where(got[1].isNotNull()).count() == 0
    assert same_rows(got.toPandas(), con.sql(engine.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
