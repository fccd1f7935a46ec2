from __future__ import annotations

import pytest

import __spark_entry__ as entry
from registry.catalog import CHECKS, QUERIES

# Queries without SQL: models and what they score, explanations, schemas.
NO_SQL = {
    "schema_report", "train_model", "predict", "feature_importance", "explain_predictions", "global_importance",
    "evidence_pack", "stream_score", "training_report", "stored_model",
}


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["event_id", "entity_id", "baseline_score", "scenario", "risk_level", "category"]
    assert out.count() > 0


def test_every_query_has_a_check_or_a_reason():
    assert set(QUERIES) - set(CHECKS) == NO_SQL
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", ["features_full", "label_any", "alert_dedup", "state_transitions", "stream_features"])
def test_against_sql(spark, sf_dir, name):
    import duckdb

    from tools.check import TABLES, norm

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(str(norm(r[c])) for c in columns) for r in df.collect()))
    cur = con.execute(CHECKS[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(str(norm(r[names.index(c)])) for c in columns) for r in cur.fetchall())
    assert got == want and got
