"""Streams against the batch folds on the same rows, dealt out over several micro-batches."""

import datetime as dt
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from postmill.operators import health, lifecycle, state
from postmill.sources.store import BucketTable, bucket_sink, shared_folder
from postmill.streaming import jobs

START = dt.datetime(2026, 1, 1)


def streamed(spark, frames, schema, job, mode):
    """Runs a job over the frames as files, one micro-batch each, and returns all rows that it gave."""
    jobs.configure(spark)
    source, out, check = (tempfile.mkdtemp(prefix="stream-", dir="/tmp") for _ in range(3))
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    got = []
    query = job(stream).writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(lambda b, _: got.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return got


@pytest.fixture(scope="module")
def captures():
    rng, rows = random.Random(5), []
    for seq in range(120):
        text = rng.choice(["A b", "a  B", "other", "Other 🚗", None])
        rows.append((f"k{rng.randrange(6)}", START + dt.timedelta(minutes=seq), seq, rng.choice([1, 1, 2]), text, START if rng.random() < 0.3 else None, rng.choice([None, "u1", "u2"])))
    return rows


def test_upserts_equal_batch(spark, captures):
    schema = "key string, at timestamp, seq bigint, rank int, text string, posted_at timestamp, author_id string"
    got = streamed(spark, [captures[:50], captures[50:51], captures[51:]], schema, jobs.upserts, "update")
    want = state.capture_outcomes(spark.createDataFrame(captures, schema), ["key"], ["at", "seq"]).select("key", "at", "outcome").collect()
    assert sorted((r["key"], r["at"], r["outcome"]) for r in got) == sorted(map(tuple, want))
    last = {}
    for r in sorted(got, key=lambda r: r["at"]):
        last[r["key"]] = (r["text"], r["rank"], r["edits"], r["posted_at"], r["author_id"])
    stored = state.upsert(spark.createDataFrame(captures, schema), ["key"], ["at", "seq"]).collect()
    assert last == {r["key"]: (r["text"], r["rank"], r["edits"], r["posted_at"], r["author_id"]) for r in stored}


def test_alerts_equal_batch(spark):
    rng = random.Random(9)
    rows = sorted((f"k{rng.randrange(3)}", START + dt.timedelta(minutes=rng.randrange(3000))) for _ in range(150))
    rows.sort(key=lambda r: r[1])
    got = streamed(spark, [rows[:70], rows[70:]], "key string, at timestamp", lambda s: jobs.alerts(s, 6 * 3600), "append")
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, at timestamp, id bigint")
    assert sorted(map(tuple, got)) == sorted((r["key"], r["at"]) for r in health.alerts(events, "key", "at", 6 * 3600).collect())
    fixed = spark.createDataFrame([("a", START + dt.timedelta(hours=h), h) for h in (0, 4, 8, 12, 16)], "key string, at timestamp, id bigint")
    assert sorted(r["id"] for r in health.alerts(fixed, "key", "at", 6 * 3600).collect()) == [0, 8, 16]


def test_silence_alerts_once_and_recovers(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    frames = [[("a", at(0)), ("b", at(0))], [("b", at(50))], [("b", at(100))], [("a", at(130)), ("b", at(140))], [("b", at(200))]]
    got = streamed(spark, frames, "key string, at timestamp", lambda s: jobs.silence(s, 3600, "1 minute"), "append")
    told = [(r["at"], r["verdict"]) for r in sorted(got, key=lambda r: r["at"]) if r["key"] == "a"]
    assert told[:2] == [(at(60), "alert"), (at(130), "recovered")] and [v for _, v in told[2:]] in ([], ["alert"])
    assert all(r["key"] == "a" for r in got)


def test_topic_volume_equals_batch(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), START + dt.timedelta(minutes=rng.randrange(600)), rng.choice(["neg", "neu", "pos"])) for _ in range(200)]
    got = streamed(spark, [rows[:90], rows[90:]], "topic string, at timestamp, sentiment string", lambda s: jobs.topic_volume(s, "Asia/Ho_Chi_Minh"), "update")
    last = {}
    for r in got:
        last[r["topic"], r["hour"]] = r["posts"]
    want = spark.createDataFrame(rows, "topic string, at timestamp, sentiment string").groupBy("topic", F.date_trunc("hour", "at").alias("hour")).count().collect()
    assert last == {(r["topic"], r["hour"]): r["count"] for r in want}


VOLUME = "topic string, hour timestamp, day timestamp_ntz, posts bigint, neg bigint, neu bigint, pos bigint"


def volume_table(spark):
    return BucketTable(spark, shared_folder(spark, "volume"), spark.createDataFrame([], VOLUME).schema, "hour", ["topic"])


def test_bucket_sink_keeps_what_a_batch_does_not_hold(spark):
    """Update mode: the second batch changes topic x of an hour only; topic y of that hour stays. The stream is stopped and its last batch comes again."""
    rng = random.Random(2)
    rows = [(rng.choice("xy"), START + dt.timedelta(minutes=rng.randrange(300)), rng.choice(["neg", "neu", "pos"])) for _ in range(150)]
    late = [("x", START + dt.timedelta(minutes=5), "neg"), ("z", START + dt.timedelta(minutes=70), "pos")]
    table, schema = volume_table(spark), "topic string, at timestamp, sentiment string"
    jobs.configure(spark)
    source, check = (tempfile.mkdtemp(prefix="stream-", dir="/tmp") for _ in range(2))
    sink = bucket_sink(table, "volume")

    def twice(batch, n):
        batch.persist()
        sink(batch, n)
        sink(batch, n)  # a replay
        batch.unpersist()

    for frame in (rows, late):
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{source}/{uuid.uuid4().hex}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        query = jobs.topic_volume(stream, "Asia/Ho_Chi_Minh").writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(twice).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    want = spark.createDataFrame(rows + late, schema).groupBy("topic", F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("posts"), F.count_if(F.col("sentiment") == "neg").alias("neg")).collect()
    assert sorted((r["topic"], r["hour"], r["posts"], r["neg"]) for r in table.read().collect()) == sorted(map(tuple, want))


def test_bucket_table_survives_a_failed_attempt(spark):
    """What was staged without a log entry is not read, and the next attempt takes its place."""
    schema = "ts int, k string, n bigint"
    table = BucketTable(spark, shared_folder(spark, "t"), spark.createDataFrame([], schema).schema, "ts", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert table.read().count() == 0
    table.apply(rows((1, "a", 1), (1, None, 2), (2, "a", 3)), "0")
    rows((1, "a", 99)).withColumn("slot", F.lit("1")).write.partitionBy("slot").parquet(f"{table.path}/data/version=1")
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, "a", 1), (1, None, 2), (2, "a", 3)]
    assert table.apply(rows((1, None, 5), (3, "c", 6)), "1") and not table.apply(rows((1, None, 7)), "1")
    want = [(1, "a", 1), (1, None, 5), (2, "a", 3), (3, "c", 6)]
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    assert not [r for r in table.log().where("version = 1").collect() if r["slot"] == "2"]
    with pytest.raises(ValueError, match="own columns"):
        BucketTable(spark, "/tmp/x", spark.createDataFrame([], "slot int").schema, "slot", [])


def test_replace_writes_changed_buckets_only(spark):
    schema = "ts int, k string, n bigint"
    table = BucketTable(spark, shared_folder(spark, "t"), spark.createDataFrame([], schema).schema, "ts", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table.apply(rows((1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "a", None), (9, "a", 1)), "0")
    changed = table.replace(rows((1, "a", 1), (2, "a", 2), (2, "b", 1), (4, "a", None), (5, "c", 1), (9, "z", 1)), F.col("ts") < 9, "1")
    assert sorted(r["slot"] for r in changed.collect()) == ["2", "3", "5"]
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "a", 2), (2, "b", 1), (4, "a", None), (5, "c", 1), (9, "a", 1)]
    again = table.replace(rows((1, "other", 7)), F.lit(True), "1")
    assert again.count() == 3 and table.read().count() == 6
    assert table.replace(table.read(), F.lit(True), "2").count() == 0
    assert table.vacuum() == [] or table.read().count() == 6


ZONE = "Asia/Ho_Chi_Minh"
PENDING = "id bigint, at timestamp, notifiers array<string>, watch_id string, watches array<struct<muted_until:timestamp_ntz,quiet_start:string,quiet_end:string>>, mode string, every_min int, next_attempt_at timestamp_ntz, matched_at timestamp_ntz"


def test_notifications_equal_schedule_and_flush(spark):
    """Each notification's step is the batch schedule's at its time; a batch goes when digest_flush first lets it go."""
    rng, rows = random.Random(12), []
    for i in range(120):
        at = START + dt.timedelta(minutes=9 * i)
        watch = {"muted_until": dt.datetime(2030, 1, 1) if i % 17 == 0 else None, "quiet_start": "22:00" if i % 3 == 0 else None, "quiet_end": "07:00" if i % 3 == 0 else None}
        due = at + dt.timedelta(minutes=25) if i % 11 == 0 else None
        rows.append((i, at, ["mail", "push"] if i % 4 == 0 else ["mail"], rng.choice("ab"), [watch], rng.choice(["instant", "digest"]), rng.choice([30, 45]), due, at))
    last = (999, START + dt.timedelta(days=9), ["end"], "z", [], "instant", 30, None, START)  # moves the watermark on
    got = streamed(spark, [rows[:40], rows[40:80], rows[80:], [last], [(*last[:1], last[1] + dt.timedelta(days=1), *last[2:])]], PENDING, lambda s: jobs.notifications(s, ZONE, 60), "append")
    got = [r for r in got if r["id"] != 999]
    told = {(r["notifier_id"], r["id"]): (r["at"], r["status"], r["batch_kind"]) for r in got}
    frame = spark.createDataFrame(rows, PENDING)
    steps = {r["id"]: r for r in frame.select("id", lifecycle.step_of(F.col("at").cast("timestamp_ntz"), ZONE, 60).alias("s")).select("id", "s.*").collect()}
    missing = [(n, r[0], r[1], steps[r[0]]) for r in rows for n in r[2] if (n, r[0]) not in told]
    assert len(told) == len(got) and not missing, missing
    waiting = {}
    for r in rows:
        s = steps[r[0]]
        for n in r[2]:
            if s["batch_kind"] is not None:
                waiting.setdefault((n, r[3], s["batch_kind"]), []).append((r[1], s["next_attempt_at"], r[0]))
            elif s["status"] == "pending":
                assert told[n, r[0]] == (s["next_attempt_at"], "sent", None)
            else:
                assert told[n, r[0]] == (r[1], "sent" if s["status"] == "send" else "suppressed", None)
    assert waiting
    for (n, _, kind), held in waiting.items():
        for at, due, i in held:
            # rows of one micro-batch are read together, so a row joins the batch that is open then
            assert told[n, i][1:] == ("sent", kind) and told[n, i][0] <= due and told[n, i][0] in {d for _, d, _ in held}
    flushed = lifecycle.digest_flush(spark.createDataFrame([(1, "m", "a", "quiet", 0, START), (2, "m", "a", "quiet", 0, START + dt.timedelta(hours=5))], "id int, notifier_id string, watch_id string, batch_kind string, attempts int, next_attempt_at timestamp"), F.lit(START))
    assert sorted(r["id"] for r in flushed.collect()) == [1, 2]  # as the stream: all that wait go with the first
