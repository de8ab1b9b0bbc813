"""Versioned tables with several writers, the source of doubly encoded documents, the failure log as a stream."""

import json
import threading

import pytest

from figquarry.sources import encoded, files, versions
from figquarry.streaming import incremental as I


def pairs(df):
    return sorted(map(tuple, df.collect()))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


def test_two_writers_that_interleave_keep_both_batches(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def slow(old):  # while the first writer merges, a second one commits
        calls.append(None if old is None else pairs(old))
        if len(calls) == 1:
            files.upsert_into(table(spark, (2, "second"), (3, "second")), path, ["k"])
        new = table(spark, (1, "first"), (2, "first"))
        return new if old is None else files.upsert(old, new, ["k"])

    done = versions.commit(spark, path, slow)
    assert calls == [None, [(2, "second"), (3, "second")]] and done.number == 1
    assert pairs(versions.read(spark, path)) == [(1, "first"), (2, "first"), (3, "second")]
    assert pairs(versions.read(spark, path, 0)) == [(2, "second"), (3, "second")] and versions.read(spark, path, 9) is None
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # what the loser had written is gone


def test_many_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(k):
        try:
            files.upsert_into(table(spark, (k, f"w{k}"), (100, f"w{k}")), path, ["k"], "csv")
        except Exception as error:  # a thread's error would be lost
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = pairs(versions.read(spark, path))
    assert not failed and found[:5] == [(k, f"w{k}") for k in range(5)] and len(found) == 6 and versions.versions(spark, path) == list(range(5))


def test_a_batch_counts_once_and_losers_give_up(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in (0, 1, 1, 0):
        files.upsert_into(table(spark, (number, "x")), path, ["k"], writer="w", batch=number)
    assert versions.versions(spark, path) == [0, 1]

    def always_late(old):
        files.upsert_into(table(spark, (9, "other")), path, ["k"])
        return table(spark, (8, "mine"))

    with pytest.raises(versions.Contended):
        versions.commit(spark, path, always_late, attempts=2)
    assert pairs(versions.read(spark, path)) == [(0, "x"), (1, "x"), (9, "other")]
    assert versions.vacuum(spark, path, 1) == 3 and pairs(versions.read(spark, path))[-1] == (9, "other") and versions.read(spark, str(tmp_path / "none")) is None


def test_manifest_is_merged(spark, tmp_path):
    first = spark.createDataFrame([("b", 1, None), ("a", 2, "x")], "vqa_id string, seed int, preset string")
    files.update_manifest(first, str(tmp_path / "m"), ["vqa_id"])
    found = files.update_manifest(spark.createDataFrame([("b", 7, "y"), ("c", None, None)], "vqa_id string, seed int, preset string"), str(tmp_path / "m"), ["vqa_id"])
    assert sorted((r.vqa_id, r.seed, r.preset) for r in found.collect()) == [("a", 2, "x"), ("b", 7, "y"), ("c", None, None)]
    newest = versions.version(spark, str(tmp_path / "m"))
    lines = [x for f in sorted((tmp_path / "m" / newest.data).glob("*.json")) for x in f.read_text().splitlines()]
    assert lines == ['{"preset":"x","seed":2,"vqa_id":"a"}', '{"preset":"y","seed":7,"vqa_id":"b"}', '{"vqa_id":"c"}']


def test_encoded_documents(spark, tmp_path):
    encoded.register(spark)
    path = tmp_path / "docs"
    rows = [("a b/ü", '{"x": 1}'), ("twice", '[1, "y"]'), ("twice", "7"), ("c", '{"q": "\\\\\\""}')]
    df = spark.createDataFrame([(j, n) for n, j in rows], "json string, name string").coalesce(2)
    df.write.format(encoded.FORMAT).mode("append").save(str(path))
    read = lambda **options: spark.read.format(encoded.FORMAT).options(**options).load(str(path))
    assert sorted((r.name, r.json, r.error) for r in read().collect()) == sorted((n, j, None) for n, j in rows)
    (path / "plain.json").write_text('{"once": true}')
    (path / "thrice.v2.json").write_text(json.dumps(json.dumps(json.dumps("[]"))))
    (path / "broken.json").write_text('"{')
    (path / "binary.json").write_bytes(b"\xff\xfe")
    (path / "empty.json").write_text("")
    (path / "_hidden.json").write_text("{}")
    found = {r.name: (r.json, r.error) for r in read(partitionBytes="1").collect()}
    assert len(found) == 8 and found["plain"][0] == '{"once": true}' and found["thrice.v2"][0] == "[]"
    assert all(found[n][0] is None and found[n][1] for n in ("broken", "binary", "empty"))
    assert read(partitionBytes="1").rdd.getNumPartitions() == 9 and read().rdd.getNumPartitions() == 1
    df.limit(1).write.format(encoded.FORMAT).mode("overwrite").save(str(path))
    assert read().count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format(encoded.FORMAT).load(str(tmp_path / "none")).count() == 0


def test_a_failed_job_leaves_nothing_visible(spark, tmp_path):
    encoded.register(spark)
    path = tmp_path / "docs"
    good = spark.range(4).selectExpr("concat('d', id) AS name", "to_json(struct(id)) AS json")
    good.write.format(encoded.FORMAT).mode("append").save(str(path))
    with pytest.raises(Exception, match="without name or json"):
        spark.range(40).repartition(4).selectExpr("concat('e', id) AS name", "CASE WHEN id <> 33 THEN to_json(struct(id)) END AS json").write.format(encoded.FORMAT).mode("append").save(str(path))
    assert sorted(r.name for r in spark.read.format(encoded.FORMAT).load(str(path)).collect()) == ["d0", "d1", "d2", "d3"]
    assert not list(path.glob("_staged*/*/0/*.json"))
    with pytest.raises(Exception, match="takes columns name and json"):
        spark.range(1).write.format(encoded.FORMAT).mode("append").save(str(path))


LOG = "object string, survey string, pdf string, reason string, at timestamp"


def test_failure_log_state_is_bounded_and_restarts(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    keys, rows_in_state = ["object", "survey", "pdf"], []

    def shard(hour, names):
        at = f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00"
        rows = spark.createDataFrame([(n, "s", "p", "no survey") for n in names], "object string, survey string, pdf string, reason string")
        files.append_shards(rows.selectExpr("*", f"timestamp'{at}' AS at").coalesce(1), log)

    def work():
        query = I.keep_log(I.stream_log(spark, log, LOG, keys, event_time="at", late="2 hours"), out, keys, state)
        query.awaitTermination()
        rows_in_state.extend(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])

    want = set()
    for hour in range(0, 60, 6):  # each time ten new failures, some of this and of long ago again; a new start each time
        names = [f"o{hour}_{k}" for k in range(10)]
        want |= set(names)
        shard(hour, [*names, *names[:3], "o0_1"])
        work()
    found = [r.object for r in versions.read(spark, out).collect()]
    assert sorted(found) == sorted(want)
    assert max(rows_in_state) <= 25 < len(want)
    before = versions.versions(spark, out)
    work()  # nothing new
    assert versions.versions(spark, out) == before
