"""Sources, ingest normalisation, row selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import micros, query, rounded, with_raw
from registry.fixtures import LABELS_CTE, RAW_CTE, labels, r6, raw_events, table
from riskloom.functions.expressions import iso_utc, normalize_status, stable_event_id
from riskloom.operators import features as feat
from riskloom.operators import ingest
from riskloom.operators.baseline import learn_calendar
from riskloom.operators.reports import read_events
from riskloom.plans.lineage import scratch_folder
from riskloom.plans.sampling import sample_per_group, sample_rows
from riskloom.schema import RAW_EVENTS
from riskloom.sources import raw, rows, tables
from riskloom.sources.event_store import EventStore, run_upsert_stream

_ISO = (
    "strftime({t}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({t}) % 1000000 <> 0 then '.' || strftime({t}, '%f') else '' end"
    " || '+00:00'"
)


def _iso(t: str) -> str:
    return _ISO.format(t=t)


def _card_rows(spark, d):
    """Orders in the shape of a card file."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        ((F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6) - F.lit(694224000)).cast("string").alias("Time"),
        F.col("o_custkey").cast("string").alias("V1"),
        F.col("o_orderpriority").alias("V2"),
        F.col("o_totalprice").cast("string").alias("Amount"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("Class"),
    )


@query(
    "src_card_txn",
    f"""select sha1('CREDITCARD|' || o_orderkey) as event_id, 'cc_txn_' || o_orderkey as entity_id,
 epoch_us(timestamp '2013-09-01') + epoch_us(o_orderdate) - 694224000000000 as ts, {r6("o_totalprice")} as amount,
 'EUR' as currency, 'card_present' as channel, 'creditcard_001' as ingest_batch_id from orders""",
)
def src_card_txn(spark, d):
    out = raw.card_events(_card_rows(spark, d))
    return rounded(micros(out.select("event_id", "entity_id", "ts", "amount", "currency", "channel", "ingest_batch_id"), "ts"), ["amount"])


@query(
    "src_card_labels",
    """select 'cc_txn_' || o_orderkey as scope_id, epoch_us(timestamp '2013-09-01') + epoch_us(o_orderdate) - 694224000000000 as ts_start,
 cast(null as bigint) as ts_end, 'fraud' as label_type, 1 as label, 5 as severity, '{"class":1}' as metadata
from orders where o_orderstatus = 'F'""",
)
def src_card_labels(spark, d):
    out = raw.card_labels(_card_rows(spark, d))
    return micros(out.select("scope_id", "ts_start", "ts_end", "label_type", "label", "severity", "metadata"), "ts_start", "ts_end")


def _ecom_rows(spark, d):
    """Line items in the shape of an e-commerce file."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("TransactionID"),
        F.col("l_partkey").cast("string").alias("TransactionDT"),
        F.col("l_extendedprice").cast("string").alias("TransactionAmt"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("isFraud"),
    )


_ECOM_ID = "cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)"


@query(
    "src_ecom_txn",
    f"""select sha1('IEEE_CIS|' || {_ECOM_ID}) as event_id, 'user_' || {_ECOM_ID} as entity_id,
 epoch_us(timestamp '2017-12-01') + l_partkey * 1000000 as ts, {r6("l_extendedprice")} as amount,
 '{{"transaction_id":"' || {_ECOM_ID} || '"}}' as metadata from lineitem""",
)
def src_ecom_txn(spark, d):
    out = raw.ecom_events(_ecom_rows(spark, d))
    return rounded(micros(out.select("event_id", "entity_id", "ts", "amount", "metadata"), "ts"), ["amount"])


@query(
    "src_ecom_labels",
    f"""select 'user_' || {_ECOM_ID} as scope_id, epoch_us(timestamp '2017-12-01') + l_partkey * 1000000 as ts_start,
 'fraud' as label_type, 1 as label, 5 as severity from lineitem where l_returnflag = 'R'""",
)
def src_ecom_labels(spark, d):
    out = raw.ecom_labels(_ecom_rows(spark, d))
    return micros(out.select("scope_id", "ts_start", "label_type", "label", "severity"), "ts_start")


def _text_ts(c="ts"):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _logon_rows(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        _text_ts().alias("date"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("PC-"), (F.col("user_id") % 7).cast("string")).alias("pc"),
        F.when(F.col("event_type") == "view", " Logon ").when(F.col("event_type") == "click", "LOGOFF").otherwise(F.col("event_type")).alias("activity"),
    )


_LOGON_STATUS = "case when event_type in ('view', 'click') then 'success' else 'unknown' end"


@query(
    "src_logon",
    f"""select sha1('CERT|u' || user_id || '|' || {_iso("ts")} || '|PC-' || (user_id % 7) || '|' || {_LOGON_STATUS}) as event_id,
 epoch_us(ts) as ts, 'u' || user_id as entity_id, 'login' as event_type, {_LOGON_STATUS} as status,
 'PC-' || (user_id % 7) as device_id from events""",
)
def src_logon(spark, d):
    out = raw.logon_events(_logon_rows(spark, d))
    return micros(out.select("event_id", "ts", "entity_id", "event_type", "status", "device_id"), "ts")


@query(
    "src_device",
    """select cast(event_id as varchar) as event_id, epoch_us(ts) as ts, 'PC-' || (user_id % 7) as entity_id,
 lower(event_type) as event_type, 'u' || user_id as user_id, 'PC-' || (user_id % 7) as device_id,
 '{"cert_row_id":"' || event_id || '"}' as metadata from events""",
)
def src_device(spark, d):
    ev = table(spark, d, "events")
    rows_ = ev.select(
        F.col("event_id").cast("string").alias("ROW_ID"),
        _text_ts().alias("DateTime"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("UserName"),
        F.concat(F.lit("PC-"), (F.col("user_id") % 7).cast("string")).alias("Host"),
        F.upper("event_type").alias("Action"),
    )
    out = raw.device_events(rows_)
    return micros(out.select("event_id", "ts", "entity_id", "event_type", "user_id", "device_id", "metadata"), "ts")


@query(
    "src_metric_csv",
    f"""select sha1('NAB|metric.' || user_id || '|' || {_iso("ts")}) as event_id, epoch_us(ts) as ts,
 'metric.' || user_id as entity_id, {r6("value")} as amount, '{{"nab_file":"metric.' || user_id || '.csv"}}' as metadata from events""",
)
def src_metric_csv(spark, d):
    rows_ = table(spark, d, "events").select(
        _text_ts().alias("timestamp"),
        F.col("value").cast("string").alias("value"),
        F.concat(F.lit("metric."), F.col("user_id").cast("string"), F.lit(".csv")).alias("file_name"),
    )
    out = raw.metric_events(rows_)
    return rounded(micros(out.select("event_id", "ts", "entity_id", "amount", "metadata"), "ts"), ["amount"])


@query(
    "src_metric_labels",
    """select epoch_us(date_trunc('second', ts)) as ts_start,
 case when event_type = 'purchase' then epoch_us(date_trunc('second', ts)) + 3600000000 end as ts_end,
 'm' || user_id as scope_id, 3 as severity,
 '{"nab_label_path":"realKnownCause/m' || user_id || '.csv"}' as metadata from events where event_type not in ('error', 'signup')""",
)
def src_metric_labels(spark, d):
    """Label files built from events: one JSON object per metric, its windows points, pairs or junk."""
    second = F.date_trunc("second", "ts")
    fmt = "yyyy-MM-dd HH:mm:ss"
    start = F.date_format(second, fmt)
    pair = F.concat_ws(" ", start, F.date_format(second + F.expr("interval 1 hour"), fmt))
    kind = F.col("event_type")
    window = F.when(kind == "error", F.lit("junk")).when(kind == "purchase", pair).otherwise(start)
    group = F.when(kind != "signup", "realKnownCause/m").otherwise("artificial/m")
    path = F.concat(group, F.col("user_id").cast("string"), F.lit(".csv"))
    # One day of windows per JSON text keeps every text small.
    files = (
        table(spark, d, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(path.alias("p"), F.to_date("ts").alias("day"))
        .agg(F.to_json(F.map_from_arrays(F.array(F.first(path)), F.array(F.collect_list(window)))).alias("json"))
    )
    out = raw.metric_labels(files.select("json"))
    return micros(out.select("ts_start", "ts_end", "scope_id", "severity", "metadata"), "ts_start", "ts_end")


@query("src_row_index", "select o_orderkey, row_number() over () - 1 as row_index from orders")
def src_row_index(spark, d):
    return rows.with_row_index(table(spark, d, "orders").select("o_orderkey", "_metadata")).select("o_orderkey", "row_index")


@query(
    "read_events",
    with_raw(
        """select event_id, epoch_us(ts) as ts, entity_id from raw where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'
order by raw.ts desc, event_id desc limit 100"""
    ),
)
def q_read_events(spark, d):
    out = read_events(raw_events(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00", 100)
    return micros(out.select("event_id", "ts", "entity_id"), "ts")


@query(
    "canonical_table",
    with_raw(f"select event_id, epoch_us(ts) as ts, source_dataset, entity_id, {r6('amount')} as amount, status from raw"),
)
def canonical_table(spark, d):
    """Rebuilt on shared storage and read back."""
    path = scratch_folder(spark, "raw_events")
    tables.write_table(raw_events(spark, d), path)
    out = tables.read_table(spark, path, RAW_EVENTS)
    return rounded(micros(out.select("event_id", "ts", "source_dataset", "entity_id", "amount", "status"), "ts"), ["amount"])


@query(
    "side_files",
    with_raw(
        f"""select source_dataset, entity_type, cast(count(*) as bigint) as sample_size,
 {r6("sum(case when extract(hour from ts) = 0 then 1 else 0 end) / count(*)")} as midnight_share,
 {r6("sum(case when dayofweek(ts) = 0 then 1 else 0 end) / count(*)")} as sunday_share from raw group by all"""
    ),
)
def side_files(spark, d):
    """Calendar profiles saved as JSON and loaded again."""
    path = scratch_folder(spark, "calendar")
    profile = learn_calendar(raw_events(spark, d))
    tables.save_side_table(profile, path)
    back = tables.load_side_table(spark, path, profile.schema)
    out = back.select(
        "source_dataset", "entity_type", "sample_size",
        F.col("hourly_counts")[0].alias("midnight_share"), F.col("daily_counts")[0].alias("sunday_share"),
    )
    return rounded(out, ["midnight_share", "sunday_share"])


# --- normalisation -----------------------------------------------------------------------------


@query(
    "stable_event_id",
    f"""select event_id, sha1('CERT|' || user_id || '|' || {_iso("ts")} || '|' || coalesce(case when event_type <> 'view' then event_type end, 'None')) as stable_id
from events""",
)
def q_stable_event_id(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.when(F.col("event_type") != "view", F.col("event_type"))
    return ev.select("event_id", stable_event_id(F.lit("CERT"), "user_id", iso_utc("ts"), part).alias("stable_id"))


_WORDS = "case event_id % 8 when 0 then ' TRUE ' when 1 then '0' when 2 then 'Successful' when 3 then 'f' when 4 then 'Failed' when 5 then 't' when 6 then event_type end"


@query(
    "normalize_status",
    f"""select event_id, case when lower(trim({_WORDS})) in ('1','true','t','success','successful') then 'success'
 when lower(trim({_WORDS})) in ('0','false','f','fail','failed') then 'fail' else 'unknown' end as status from events""",
)
def q_normalize_status(spark, d):
    return table(spark, d, "events").select("event_id", normalize_status(F.expr(_WORDS)).alias("status"))


@query(
    "coerce_events",
    with_raw(
        f"""select event_id, epoch_us(ts) as ts, {r6("amount")} as amount, entity_id, metadata
from raw where channel is not null"""
    ),
)
def coerce_events(spark, d):
    """Text columns: null amounts read 'n/a', and a missing channel takes the entity id away."""
    ev = raw_events(spark, d)
    text = ev.withColumns(
        {
            "ts": _text_ts(),
            "amount": F.coalesce(F.col("amount").cast("string"), F.lit("n/a")),
            "entity_id": F.when(F.col("channel").isNotNull(), F.col("entity_id")),
        }
    )
    out = ingest.coerce_events(text).select("event_id", "ts", "amount", "entity_id", "metadata")
    return rounded(micros(out, "ts"), ["amount"])


@query(
    "coerce_labels",
    "with " + RAW_CTE + ",\n" + LABELS_CTE + """
select epoch_us(ts_start) as ts_start, epoch_us(ts_end) as ts_end, scope_id, label_type, label, severity from lab where severity <> 5""",
)
def coerce_labels(spark, d):
    lab = labels(spark, d)
    text = lab.withColumns(
        {
            "ts_start": _text_ts("ts_start"),
            "ts_end": F.coalesce(_text_ts("ts_end"), F.lit("open")),
            "scope_id": F.when(F.col("severity") != 5, F.col("scope_id")),
        }
    )
    out = ingest.coerce_labels(text).select("ts_start", "ts_end", "scope_id", "label_type", "label", "severity")
    return micros(out, "ts_start", "ts_end")


@query(
    "fill_canonical",
    with_raw("select event_id, entity_id, cast(null as varchar) as ip_hash, cast(null as varchar) as error_code, source_dataset from raw"),
)
def fill_canonical(spark, d):
    short = raw_events(spark, d).select("entity_id", "event_id", "source_dataset")
    return ingest.fill_canonical(short).select("event_id", "entity_id", "ip_hash", "error_code", "source_dataset")


_WHOLE = "event_id, epoch_us(ts) as ts, " + ", ".join(f"{r6(c)} as {c}" if c == "amount" else c for c in RAW_EVENTS.fieldNames()[2:])


def _whole(df):
    """Events with all their columns."""
    return rounded(micros(df.select(*RAW_EVENTS.fieldNames()), "ts"), ["amount"])


def _stored_and_batch(spark, d):
    """Successes are stored; the batch brings every event twice, once an hour later."""
    ev = raw_events(spark, d)
    return ev.filter("status = 'success'"), ev.unionByName(ev.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")))


@query("upsert_events", with_raw(f"select {_WHOLE} from raw"))
def upsert_events(spark, d):
    return _whole(ingest.upsert_events(*_stored_and_batch(spark, d)))


@query("upsert_store", with_raw(f"select {_WHOLE} from raw"))
def upsert_store(spark, d):
    """The same through the stored table: two upserts, the second done twice, and a compaction."""
    store = EventStore(spark, scratch_folder(spark, "event-store"))
    stored, batch = _stored_and_batch(spark, d)
    store.upsert(stored, "stored")
    for _ in range(2):
        store.upsert(batch, "batch")
    store.compact("joined", 1)
    return _whole(store.read())


@query("upsert_stream", with_raw(f"select {_WHOLE} from raw"))
def upsert_stream(spark, d):
    """The same as a stream whose files repeat each other's events."""
    store, path, checkpoint = EventStore(spark, scratch_folder(spark, "event-store")), *(scratch_folder(spark, x) for x in ("landing", "checkpoint"))
    for part in _stored_and_batch(spark, d):
        part.write.mode("append").parquet(path)
        run_upsert_stream(spark, path, store, checkpoint, 1_000_000)
    return _whole(store.read())


@query(
    "append_labels",
    "with " + RAW_CTE + ",\n" + LABELS_CTE + " select scope_id, label_type, count(*) * 2 as n from lab group by all",
)
def append_labels(spark, d):
    lab = labels(spark, d)
    return ingest.append_labels(lab, lab).groupBy("scope_id", "label_type").agg(F.count("*").alias("n"))


@query(
    "ensure_batch",
    with_raw("select ingest_batch_id, min(source_dataset) as source_dataset from raw group by ingest_batch_id"),
)
def ensure_batch(spark, d):
    seen = raw_events(spark, d).select("ingest_batch_id", "source_dataset", F.lit("").alias("notes")).distinct()
    stored = seen.filter("ingest_batch_id = 'batch_001'").groupBy("ingest_batch_id").agg(F.min("source_dataset").alias("source_dataset"), F.first("notes").alias("notes"))
    return ingest.ensure_batches(stored, seen).select("ingest_batch_id", "source_dataset")


@query(
    "split_invalid",
    with_raw("select case when event_type in ('purchase', 'signup') then 'rejected' else 'valid' end as side, count(*) as n from raw group by all"),
)
def split_invalid(spark, d):
    ev = raw_events(spark, d).withColumns(
        {
            "status": F.when(F.col("event_type") == "signup", F.lit("odd")).otherwise(F.col("status")),
            "entity_type": F.when(F.col("event_type") == "purchase", F.lit("robot")).otherwise(F.col("entity_type")),
        }
    )
    good, bad = ingest.split_invalid(ev)
    both = good.withColumn("side", F.lit("valid")).unionByName(bad.withColumn("side", F.lit("rejected")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@query(
    "anti_join",
    with_raw("select event_id, source_dataset from raw where event_type <> 'error'"),
)
def anti_join(spark, d):
    ev = raw_events(spark, d)
    return ingest.new_events(ev.filter("event_type = 'error'"), ev).select("event_id", "source_dataset")


# --- row selections ----------------------------------------------------------------------------

AS_OF = "2024-01-20 12:00:00"


@query(
    "filter_entity_asof",
    with_raw(
        f"""select event_id, entity_id, epoch_us(ts) as ts from raw where ts <= timestamp '{AS_OF}'
 and entity_id in (select entity_id from raw where event_type = 'error' and currency is null)"""
    ),
)
def filter_entity_asof(spark, d):
    ev = raw_events(spark, d)
    ids = ev.filter("event_type = 'error' and currency is null")
    return micros(feat.filter_entity_asof(ev, ids, AS_OF).select("event_id", "entity_id", "ts"), "ts")


@query("sample_rows", with_raw("select event_id from raw order by md5(event_id), event_id limit 500"))
def q_sample_rows(spark, d):
    return sample_rows(raw_events(spark, d), 500).select("event_id")


@query(
    "sample_per_source",
    with_raw(
        """select event_id, source_dataset from (select *, row_number() over (partition by source_dataset order by md5(event_id), event_id) as rn from raw)
where rn <= 1000 // 4 + 1 order by md5(event_id), event_id limit 1000"""
    ),
)
def sample_per_source(spark, d):
    """The dashboard's draw: a quarter of 1000 rows, plus one, per source, and 1000 of these in all."""
    drawn = sample_per_group(raw_events(spark, d), ["source_dataset"], 1000 // 4 + 1)
    return sample_rows(drawn, 1000).select("event_id", "source_dataset")


@query(
    "latest_per_entity",
    with_raw(
        """select event_id, entity_id, cast(1 as bigint) as rn from (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) as k from raw) where k = 1"""
    ),
)
def latest_per_entity(spark, d):
    return feat.latest_per_entity(raw_events(spark, d)).select("event_id", "entity_id", F.col("rn").cast("long").alias("rn"))


@query("latest_one", with_raw("select event_id, epoch_us(ts) as ts from raw order by raw.ts desc, event_id desc limit 1"))
def latest_one(spark, d):
    return micros(feat.latest_one(raw_events(spark, d)).select("event_id", "ts"), "ts")


@query("fill_nulls", with_raw(f"select event_id, {r6('coalesce(amount, 0)')} as amount from raw"))
def fill_nulls(spark, d):
    return rounded(feat.fill_nulls(raw_events(spark, d), ["amount"]).select("event_id", "amount"), ["amount"])
