from __future__ import annotations

import hashlib
import json

from riskloom.sources import raw
from riskloom.sources.rows import with_row_index


def _write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_row_index_is_the_file_position_across_splits(spark, tmp_path):
    n = 5000
    path = _write(tmp_path, "big.csv", "k\n" + "".join(f"row{i:06d}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = raw.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3
        rows = with_row_index(df).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["row_index"], r["k"]) for r in rows) == [(i, f"row{i:06d}") for i in range(n)]


def test_card(spark, tmp_path):
    path = _write(tmp_path, "card.csv", "Time,V1,V2,Amount,Class\n0,1.5,-2,10.5,0\n0,0.1,7,bad,1\n3600.5,1,1,3,1\n")
    df = raw.read_card(spark, path)
    ev = {r["entity_id"]: r for r in raw.card_events(df).collect()}
    assert set(ev) == {"cc_txn_0", "cc_txn_1", "cc_txn_2"}
    assert ev["cc_txn_0"]["event_id"] == hashlib.sha1(b"CREDITCARD|0").hexdigest()
    assert ev["cc_txn_1"]["amount"] is None and ev["cc_txn_0"]["currency"] == "EUR"
    assert ev["cc_txn_2"]["ts"].isoformat() == "2013-09-01T01:00:00.500000"
    assert json.loads(ev["cc_txn_0"]["metadata"]) == {"V1": 1.5, "V2": -2.0}
    lb = raw.card_labels(df).collect()
    assert sorted(r["scope_id"] for r in lb) == ["cc_txn_1", "cc_txn_2"]
    assert all(r["ts_end"] is None and r["severity"] == 5 and r["label_type"] == "fraud" for r in lb)


def test_ecom(spark, tmp_path):
    path = _write(tmp_path, "txn.csv", "TransactionID,TransactionDT,TransactionAmt,isFraud\n7,60,1.5,0\n8,61,,1\n9,62,2,1\n")
    df = raw.read_ecom(spark, path, rows=2)
    ev = {r["entity_id"]: r for r in raw.ecom_events(df).collect()}
    assert set(ev) == {"user_7", "user_8"} and ev["user_8"]["amount"] is None
    assert ev["user_7"]["ts"].isoformat() == "2017-12-01T00:01:00"
    assert [r["scope_id"] for r in raw.ecom_labels(df).collect()] == ["user_8"]
    assert raw.ecom_labels(df.drop("isFraud")).count() == 0


def test_logon(spark, tmp_path):
    head = "id,date,user,pc,"
    with_success = _write(tmp_path, "a.csv", head + "success\n1,01/02/2010 07:21:06,U1,PC1,T\n2,nope,U1,PC1,1\n3,2010-01-02 07:21:06,,PC1,1\n4,2010-01-02 07:21:06,U2,,0\n5,2010-01-02 08:00:00,U2,PC2,other\n")
    out = {(r["entity_id"], r["status"]): r for r in raw.logon_events(raw.read_csv(spark, with_success)).collect()}
    assert set(out) == {("U1", "success"), ("U2", "fail"), ("U2", "unknown")}
    first = out[("U1", "success")]
    assert first["event_id"] == hashlib.sha1(b"CERT|U1|2010-01-02T07:21:06+00:00|PC1|success").hexdigest()
    with_activity = _write(tmp_path, "b.csv", head + "activity\n1,2010-01-02 07:21:06,U1,PC1, Logon\n2,2010-01-02 07:21:07,U1,PC1,LOGOFF\n3,2010-01-02 07:21:08,U1,PC1,lock\n4,2010-01-02 07:21:09,U1,PC1,failed\n")
    got = sorted(r["status"] for r in raw.logon_events(raw.read_csv(spark, with_activity)).collect())
    assert got == ["fail", "success", "success", "unknown"]
    bare = raw.read_csv(spark, with_success).drop("success")
    assert {r["status"] for r in raw.logon_events(bare).collect()} == {"unknown"}


def test_device_aliases_and_delimiter(spark, tmp_path):
    path = _write(tmp_path, "d.csv", "Row_ID;DateTime;UserName;HOST;Action\nx1;01/02/2010 07:21:06;u;pc9;Connect\nx2;bad;u;pc9;Connect\nx3;01/02/2010 07:21;;pc9;Disconnect\n")
    assert raw.sniff_delimiter(spark, path) == ";"
    out = raw.device_events(raw.read_device(spark, path)).collect()
    assert [(r["event_id"], r["entity_id"], r["device_id"], r["event_type"], r["metadata"]) for r in out] == [
        ("x1", "pc9", "pc9", "connect", '{"cert_row_id":"x1"}')
    ]
    short = _write(tmp_path, "e.csv", "id,date,user\n1,2010-01-01 00:00:00,u\n")
    assert raw.device_events(raw.read_device(spark, short)).count() == 0


def test_metrics_and_labels(spark, tmp_path):
    folder = tmp_path / "metrics"
    folder.mkdir()
    _write(folder, "cpu.load.csv", "timestamp,value\n2014-01-01 00:00:00,1.5\nbad,2\n")
    _write(folder, "disk.csv", "timestamp,value\n2014-01-01 00:05:00,3\n")
    out = {r["entity_id"]: r for r in raw.metric_events(raw.read_metrics(spark, str(folder))).collect()}
    assert set(out) == {"cpu.load", "disk"} and out["cpu.load"]["amount"] == 1.5
    assert out["disk"]["event_id"] == hashlib.sha1(b"NAB|disk|2014-01-01T00:05:00+00:00").hexdigest()
    path = _write(
        tmp_path,
        "labels.json",
        json.dumps(
            {
                "realKnownCause/x.csv": ["2014-01-01 00:00:00", "2014-01-01 00:00:00  2014-01-01 01:00:00", "token", "bad date"],
                "artificial/y.csv": ["2014-01-01 00:00:00"],
            }
        ),
    )
    lb = raw.metric_labels(raw.read_metric_labels(spark, path)).collect()
    assert sorted((r["scope_id"], r["ts_end"] is None, r["severity"]) for r in lb) == [("x", False, 3), ("x", True, 3)]


def test_quotes_line_breaks_and_short_dates(spark, tmp_path):
    text = 'id,date,user,pc,activity\n1,1/2/2010 6:49,"a ""x"" b, c",p,Connect\n2,01/02/2010 06:49:30,"d\ne",p,Connect\n3,soon,f,p,Connect\n'
    path = _write(tmp_path, "device.csv", text)
    df = raw.read_csv(spark, path, line_breaks=True)
    assert [r["user"] for r in df.orderBy("id").collect()] == ['a "x" b, c', "d\ne", "f"]
    times = [str(r[0]) for r in df.orderBy("id").select(raw.tolerant_ts("date").cast("string")).collect()]
    assert times == ["2010-01-02 06:49:00", "2010-01-02 06:49:30", "None"]
    assert [r["id"] for r in raw.unreadable_dates(df).collect()] == ["3"]
    assert raw.read_csv(spark, path).first()["user"] == 'a "x" b, c'
