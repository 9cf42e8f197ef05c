import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vellichor.operators import coverage, inventory, ledger, observe, retention, stateful, verify
from vellichor.sources import archives, tables
from vellichor.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_empty_tables(spark):
    t = {n: tables.empty(spark, n) for n in tables.SCHEMAS}
    assert ledger.buckets(t["fetch_log"]).first().hit_rate == 0.0
    assert inventory.listing(t["documents"], t["anchors"], t["verifications"]).count() == 0
    assert retention.reclaimable(t["versions"], t["documents"], t["anchors"]).count() == 0
    assert verify.report(verify.verify(t["anchors"], spark.createDataFrame([], "document_id string, version_id string, body string"))).first().checked == 0


def test_filters_reject_unknown_values(spark):
    t = {n: tables.empty(spark, n) for n in tables.SCHEMAS}
    with pytest.raises(ValueError):
        inventory.listing(t["documents"], t["anchors"], t["verifications"], status="alive")
    with pytest.raises(ValueError):
        retention.reclaimable(t["versions"], t["documents"], t["anchors"], keep=0)
    assert inventory.members(spark.range(5), "id", []).count() == 0 and inventory.members(spark.range(5), "id", None).count() == 5


def test_classification_equals_simulation(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for d in range(40):
        held, current, last = {}, None, {}
        for s in range(25):
            kind = rng.choice(["rep"] * 5 + ["nm", "arch"])
            body, raw, pipe = rng.choice("AB"), rng.choice("xyz"), rng.choice("pq")
            source = {"rep": "live", "arch": "archive", "nm": None}[kind]
            row = (str(d), s, at(s // 2), kind, None if kind == "nm" else body, None if kind == "nm" else raw, None if kind == "nm" else pipe, source)
            rows.append(row)
            if kind == "nm":
                if current:
                    wanted[(str(d), s)] = ("not_modified", False)
                continue
            key = (body, source)
            changed = False
            if kind == "arch":
                outcome = "archive"
            elif current is None:
                outcome = "created"
            elif current == key:
                outcome = "unchanged"
                changed = last[key] != raw
            elif current[0] == body:
                outcome = "changed"
            else:
                outcome = "renormalized" if held[current][0] == raw and held[current][1] != pipe else "changed"
            held.setdefault(key, (raw, pipe))
            last[key] = raw
            current = key
            wanted[(str(d), s)] = (outcome, changed)
    schema = "document_id string, seq bigint, observed_at timestamp, kind string, text_hash string, raw_hash string, pipeline_version string, source string"
    got = {(r.document_id, r.seq): (r.outcome, r.raw_changed) for r in observe.classify(spark.createDataFrame(rows, schema)).collect()}
    assert got == wanted


def test_merge_keeps_earliest_and_ties_keep_target(spark):
    schema = "version_id string, document_id string, text_hash string, source string, captured_at timestamp, last_observed_at timestamp, last_observed_seq bigint"
    rows = [("s1", "S", "A", "live", at(1), at(9), 1), ("t1", "T", "A", "live", at(2), at(3), 1), ("s2", "S", "B", "live", at(5), at(5), 2), ("t2", "T", "B", "live", at(5), at(6), 2), ("n", "T", None, "live", at(0), at(0), 0)]
    out = observe.merge_documents(spark.createDataFrame(rows, schema), spark.createDataFrame([("S", "T")], "source_id string, target_id string"))
    assert {r.version_id for r in out.collect()} == {"s1", "t2", "n"}
    assert [r.last_observed_seq for r in out.orderBy("last_observed_at").collect()] == [1, 2, 3]


def test_redirect_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x"), ("p", "q")], "url string, target string")
    assert {r.url: r.target for r in observe.terminal_urls(links).collect()} == {"a": "d", "b": "d", "c": "d", "p": "q"}


def test_cache_fold_and_rate(spark):
    rows = [(i, "d", at(t)) for i, t in enumerate([0, 10, 3600, 3700, 8000])]
    log = spark.createDataFrame(rows, "seq bigint, document_id string, requested_at timestamp")
    assert [r.would_hit for r in stateful.cache_hits(log).orderBy("seq").collect()] == [False, True, True, False, False]
    burst = spark.createDataFrame([(i, "d", at(t)) for i, t in enumerate([0, 0, 0, 0, 2])], "seq bigint, document_id string, requested_at timestamp")
    assert [r.over_limit for r in stateful.rate_violations(burst).orderBy("seq").collect()] == [False, False, False, True, False]


def test_as_of(spark):
    v = spark.createDataFrame([("d", "v1", at(10)), ("d", "v2", at(20))], "document_id string, version_id string, captured_at timestamp")
    m = spark.createDataFrame([("d", at(5)), ("d", at(10)), ("d", at(25)), ("e", at(1))], "document_id string, moment timestamp")
    assert [r.version_id for r in inventory.as_of(v, m).orderBy("document_id", "moment").collect()] == [None, "v1", "v2", None]


def test_archive_payloads(spark):
    cdx = '[["timestamp","original","statuscode"],["20200101000000","u1","200"],["20210101000000","u2","200"],["20220101000000","u3","404"],["bad","u4","200"]]'
    got = archives.newest_cdx(spark.createDataFrame([("k", cdx), ("n", None), ("m", "[]"), ("x", "oops")], "k string, p string"), "k", "p").collect()
    assert [(r.k, r.original, r.captured_at.year) for r in got] == [("k", "u2", 2021)]
    memento = '{"mementos":{"list":[{"datetime":"2020-01-01T00:00:00Z","uri":"a"},{"datetime":"2021-01-01T00:00:00Z","uri":"b"}]}}'
    assert archives.last_memento(spark.createDataFrame([("k", memento), ("n", "{}")], "k string, p string"), "k", "p").first().uri == "b"


def test_coverage_round_trip(spark):
    df = spark.createDataFrame([(1, {"aside": 3, "p": 9}), (2, {}), (3, None)], "i int, m map<string,int>")
    back = df.withColumn("e", coverage.encode_dropped("m")).withColumn("d", coverage.decode_dropped("e")).orderBy("i").collect()
    assert [r.e for r in back] == ["p:9 aside:3", "", None] and [r.d for r in back] == [{"aside": 3, "p": 9}, {}, None]


def test_append_refuses_orphans(spark, tmp_path):
    parents = spark.createDataFrame([("a",)], "anchor_id string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "verification_seq bigint, anchor_id string")
    refused = tables.append(rows, str(tmp_path), "verifications", {"anchor_id": (parents, "anchor_id")})
    assert [r.anchor_id for r in refused.collect()] == ["b"] and spark.read.parquet(f"{tmp_path}/verifications.parquet").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "d", "u", at(i * 600), ["error", "changed"][i % 2], None, 200, i, 1) for i in range(60)]
    log = spark.createDataFrame(rows + rows[:5] + [(999, "d", "u", at(40 * 86400), "changed", None, 200, 0, 1)], tables.SCHEMAS["fetch_log"])
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(1000, "d", "u", at(41 * 86400), "changed", None, 200, 0, 1)], tables.SCHEMAS["fetch_log"])
    ingest.start_hourly(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.start_hourly(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.hour, r.outcome): r.requests for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    wanted = {(r.hour, r.outcome): r.n for r in log.dropDuplicates(["seq"]).filter("seq < 900").groupBy(F.date_trunc("hour", "requested_at").alias("hour"), "outcome").agg(F.count("*").alias("n")).collect()}
    assert got == wanted
