"""Tables that change together: the ledger, jobs on stored tables, and the stream with its fetch."""

import itertools
import json
import os
import random
import uuid

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from podspark import schemas
from podspark.operators import merge
from podspark.plans import answers, jobs, stored
from podspark.sources import colocated, prompts
from podspark.sources.store import Change, Store
from podspark.streaming import fetch

CHANNELS = [("p", "c1"), ("q", "c2")]


def now(year=2024):
    return F.expr(f"timestamp'{year}-01-01 00:00:00'")


def templates():
    return {k: F.lit("{transcript}{insight}") for k in prompts.NAMES}


# A lambda, as it goes to the workers by value.
answer = lambda kind, prompt: "X:\n* some title: b\n* other title: c" if kind == "insights" else ""


def rows(df):
    return sorted(map(str, df.collect()))


def state(store):
    """All tables without the times of writing."""
    return {name: rows(df.drop("created_at", "updated_at")) for name, df in stored.read_all(store).items()}


def said(text):
    return json.dumps({"results": {"channels": [{"alternatives": [{"transcript": text}]}]}, "utterances": [{"start": 0.5, "end": 2.0, "transcript": text, "speaker": 1}]})


def listing(spark, *pairs):
    by = {}
    for channel, video in pairs:
        by.setdefault(channel, []).append({"id": {"videoId": video}})
    return spark.createDataFrame([(c, None, items) for c, items in by.items()], schemas.LISTING)


def details(spark, *found):
    """(channel, video, day, duration)"""
    items = [(c, [{"id": v, "snippet": {"title": f"T {v}", "publishedAt": f"2024-01-{day:02d}T00:00:00Z"}, "contentDetails": {"duration": dur}}]) for c, v, day, dur in found]
    return spark.createDataFrame(items, schemas.DETAILS)


def heard(spark, *pairs):
    return spark.createDataFrame(list(pairs), "video_id string, response string")


def test_commits_change_all_tables_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"a": ("k string, n int", "k"), "b": ("k string", "k")}, 4)
    make = lambda *ks, n=1: spark.createDataFrame([(k, n) for k in ks], "k string, n int")
    empty = store.snapshot()
    assert empty.version == 0 and store.read("a").count() == 0
    first = store.commit(empty, {"a": Change(make("x", "y", "z"), [0, 1, 2, 3]), "b": Change(make("x").select("k"), [0, 1, 2, 3])}, batch=("s", 0))
    assert (first.version, store.done(first, ("s", 0)), store.done(first, ("s", 1))) == (1, True, False)
    # The same rows again are no change; a row that changes is one.
    assert store.commit(first, {"a": Change(make("z", "y", "x"), [0, 1, 2, 3])}) == first
    touched = store.touched(first, "a", make("x"))
    second = store.commit(first, {"a": Change(touched.rows.withColumn("n", F.when(F.col("k") == "x", 5).otherwise(F.col("n"))), touched.numbers)})
    assert rows(store.changes(second, "a", 1)) == ["Row(k='x', n=5)"] and len(rows(store.changes(second, "a", 0))) == 3
    assert sum(second.folders["a"][b] != f for b, f in first.folders["a"].items()) == 1
    # Rows that go, and a bucket that empties, are changes; earlier versions stay readable until cleared.
    gone = store.touched(second, "a", make("x"))
    third = store.commit(second, {"a": Change(gone.rows.filter("k <> 'x'"), gone.numbers)})
    assert len(rows(store.read("a"))) == 2 and len(rows(store.read("a", first))) == 3 and rows(store.read("b", third)) == ["Row(k='x')"]
    with pytest.raises(RuntimeError):
        store.commit(second, {"a": Change(make("w"), [0, 1, 2, 3])})
    store.clear()
    assert store.versions() == [3] and len(rows(store.read("a"))) == 2 and len(rows(store.read("b"))) == 1
    assert len([f for f in (tmp_path / "s" / "a").iterdir()]) == len(set(third.folders["a"].values()))


def landing_batches(spark):
    return [
        (listing(spark, ("c1", "v1"), ("c1", "v2"), ("c2", "v3"), ("c9", "v9")), details(spark, ("c1", "v1", 3, "PT10M")), heard(spark, ("v1", said("one")), ("v2", said("two")), ("v8", said("unknown")))),
        (listing(spark, ("c1", "v4")), details(spark, ("c1", "v2", 2, "PT11M"), ("c2", "v3", 5, "PT4M"), ("c2", "v5", 6, "PT10M")), heard(spark, ("v3", said("three")), ("v4", said("four")))),
        (listing(spark, ("c2", "v5"), ("c2", "v6")), details(spark, ("c1", "v4", 9, "PT12M"), ("c2", "v6", 7, "PT20M")), heard(spark, ("v5", "{broken"), ("v6", said("")))),
    ]


def run(store, batch, number, year=2024):
    spark = store.spark
    return stored.sync_batch(store, *batch, spark.createDataFrame(CHANNELS, "podcast string, channel_id string"), templates(), answer, now(year), ("sync", number))


@pytest.fixture(scope="module")
def whole(spark):
    """The tables of the batch job over everything that lands."""
    batches = landing_batches(spark)
    union = lambda k: batches[0][k].unionByName(batches[1][k]).unionByName(batches[2][k])
    empty = jobs.Tables(*(spark.createDataFrame([], s) for s in (schemas.VIDEOS, schemas.TRANSCRIPTIONS, schemas.SEGMENTS, schemas.INSIGHTS, schemas.SEED_LINKS)))
    tables, _, _ = jobs.sync(empty, union(0), union(1), spark.createDataFrame(CHANNELS, "podcast string, channel_id string"), union(2), templates(), answer, now())
    found = {name: rows(getattr(tables, name).drop("created_at", "updated_at")) for name in tables._fields}
    assert len(found["videos"]) == 5 and len(found["transcriptions"]) == 3
    return found | {"backlog": rows(jobs.backlog(tables.videos, tables.transcriptions).drop("created_at"))}


@pytest.mark.parametrize("order", [(2, 0, 1)])
def test_batches_in_any_order_give_the_tables_of_the_batch_job(spark, tmp_path, whole, order):
    store = stored.open_store(spark, str(tmp_path / "s"), 4)
    batches = landing_batches(spark)
    for number, k in enumerate(order):
        run(store, batches[k], number)
    found = state(store)
    assert {name: found[name] for name in whole} == whole
    assert rows(store.read("rejected").select("video_id", "reason")) == ["Row(video_id='v5', reason='broken')", "Row(video_id='v6', reason='empty')"]
    assert found["described"] == [] and found["listed"] == [] and rows(store.read("waiting").select("video_id")) == ["Row(video_id='v3')", "Row(video_id='v8')"]
    # What came before is not taken up again, nor does a batch without rows change anything but its number.
    version = store.snapshot().version
    assert run(store, batches[order[2]], 2).version == version
    none = tuple(df.limit(0) for df in batches[0])
    assert run(store, none, 3).folders == store.snapshot().folders and state(store) == found


def test_a_break_between_any_two_writes_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), {name: ("k string", "k") for name in "abcd"}, 1)
    one = lambda k: {name: Change(spark.createDataFrame([(k,)], "k string"), [0]) for name in "abcd"}
    was = store.commit(store.snapshot(), one("before"), batch=("s", 0))
    stage, publish = Store._stage, Store._publish
    for point in range(5):
        calls = itertools.count()

        def breaks(f):
            def g(*args):
                if next(calls) == point:  # noqa: B023
                    raise RuntimeError("lost")
                return f(*args)

            return g

        monkeypatch.setattr(Store, "_stage", breaks(stage))
        monkeypatch.setattr(Store, "_publish", breaks(publish))
        with pytest.raises(RuntimeError):
            store.commit(was, one("after"), batch=("s", 1))
        monkeypatch.undo()
        assert store.snapshot() == was and not store.done(was, ("s", 1)) and all(rows(store.read(name)) == ["Row(k='before')"] for name in "abcd")
    store.commit(was, one("after"), batch=("s", 1))
    store.clear()
    assert all(rows(store.read(name)) == ["Row(k='after')"] for name in "abcd") and all(len(list((tmp_path / "s" / name).iterdir())) == 1 for name in "abcd")


def test_a_batch_that_broke_off_is_taken_up_whole(spark, tmp_path, monkeypatch):
    batches = landing_batches(spark)
    store = stored.open_store(spark, str(tmp_path / "s"), 2)
    stage = Store._stage
    monkeypatch.setattr(Store, "_stage", lambda self, was, name, *more: stage(self, was, name, *more) if name != "videos" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(store, batches[0], 0)
    assert store.snapshot().version == 0 and not any(state(store).values())
    monkeypatch.undo()
    run(store, batches[0], 0)
    assert [r.video_id for r in store.read("transcriptions").collect()] == ["v1"] and run(store, batches[0], 0).version == 1


def test_newest_per_channel_are_kept_without_old_listings(spark, tmp_path):
    store = stored.open_store(spark, str(tmp_path / "s"), 2)
    channels = spark.createDataFrame(CHANNELS, "podcast string, channel_id string")
    batches = [[5, 1, 9], [3], [8, 2, 7]]
    for number, days in enumerate(batches):
        found = [("c1", f"v{d}", d, "PT10M") for d in days]
        batch = listing(spark, *[f[:2] for f in found]), details(spark, *found), heard(spark)
        stored.sync_batch(store, *batch, channels, templates(), answer, now(), ("sync", number), n=3)
    assert sorted(r.video_id for r in store.read("newest").collect()) == ["v7", "v8", "v9"]
    # A video that was never among the newest three when it came is not stored.
    assert sorted(r.video_id for r in store.read("videos").collect()) == ["v1", "v3", "v5", "v7", "v8", "v9"]


def test_seeding_reads_what_changed(spark, tmp_path, monkeypatch):
    store = stored.open_store(spark, str(tmp_path / "s"), 4)
    make = lambda *links: spark.createDataFrame([(*link, k) for k, link in enumerate(links)], "video_id string, podcast string, title string, duration_seconds int, url string, seq bigint")
    stored.seed_links(store, make(("v1", "p", "A", 400, "u"), ("v2", "p", "", None, ""), ("v1", "q", "B", None, ""), ("", "p", "x", 1, "")), now(2021))
    first = stored.seed_from_links(store, now(2021))
    assert {r.video_id: (r.podcast, r.title) for r in store.read("videos").collect()} == {"v1": ("q", "B"), "v2": ("p", "")}
    assert {r.video_id for r in stored.backlog(store).collect()} == {"v1", "v2"}
    # Without news no bucket is written, nor read.
    monkeypatch.setattr(Store, "_read", lambda *a: pytest.fail("read"))
    assert stored.seed_from_links(store, now(2022)) == first == store.snapshot()
    monkeypatch.undo()
    stored.seed_links(store, make(("v2", "r", "C", 500, ""), ("v3", "p", "D", 600, "")), now(2023))
    asked = []
    fold = stored.merge.videos_from_links
    monkeypatch.setattr(stored.merge, "videos_from_links", lambda videos, links, at: asked.extend(r.video_id for r in links.collect()) or fold(videos, links, at))
    last = stored.seed_from_links(store, now(2023))
    assert sorted(asked) == ["v2", "v2", "v3"]
    want = fold(spark.createDataFrame([], schemas.VIDEOS), store.read("seed_links"), now(2023))
    assert rows(store.read("videos").drop("created_at", "updated_at")) == rows(want.drop("created_at", "updated_at"))
    assert {r.video_id for r in stored.backlog(store).collect()} == {"v1", "v2", "v3"} and last.version == store.snapshot().version


def test_stream_with_fetch(spark, tmp_path, whole):
    store = stored.open_store(spark, str(tmp_path / "s"), 2)
    channels = spark.createDataFrame(CHANNELS, "podcast string, channel_id string")
    for name in fetch.LANDING:
        (tmp_path / "in" / name).mkdir(parents=True)
    for k, batch in enumerate(landing_batches(spark)):
        for name, df in zip(fetch.LANDING, batch, strict=True):
            df.coalesce(1).write.mode("append").json(str(tmp_path / "in" / name))
        if k != 1:
            fetch.sync(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), channels, templates(), answer, now()).awaitTermination()
    found = state(store)
    assert {name: found[name] for name in whole} == whole and store.snapshot().batches == {"sync": 1}


def test_answers_are_kept_lot_by_lot(spark, tmp_path):
    store = answers.open_answers(spark, str(tmp_path / "a"), 8)
    log = str(tmp_path / "log")
    (tmp_path / "log").mkdir()

    def breaking(kind, prompt):
        if prompt == "prompt 7":
            raise RuntimeError("lost")
        return f"{kind}:{prompt}"

    def model(kind, prompt):
        with open(f"{log}/{uuid.uuid4()}", "w"):
            return f"{kind}:{prompt}"

    rows = [(f"r{k}", "title" if k % 2 else "insights", f"prompt {k % 20}") for k in range(50)]
    requests = spark.createDataFrame(rows, "request_id string, kind string, prompt string")
    with pytest.raises(PythonException):
        answers.ask_kept(store, requests, breaking, lots=4)
    kept = store.read("answers").count()
    got = answers.ask_kept(store, requests, model, lots=4)
    assert rows_of(got) == sorted((r, f"{k}:{p}") for r, k, p in rows)
    # Only the rest was asked after the break, equal prompts once, and nothing in a rerun.
    assert len(os.listdir(log)) == 20 - kept and store.read("answers").count() == 20
    assert rows_of(answers.ask_kept(store, requests, model)) == rows_of(got) and len(os.listdir(log)) == 20 - kept
    assert rows_of(answers.ask_kept(store, requests.limit(0), model)) == []


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_sync_asks_the_model_once_per_prompt(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = str(tmp_path / "log")

    def model(kind, prompt):
        with open(f"{log}/{uuid.uuid4()}", "w"):
            return "X:\n* some title: b" if kind == "insights" else ""

    kept = answers.open_answers(spark, str(tmp_path / "a"), 2)
    channels = spark.createDataFrame(CHANNELS, "podcast string, channel_id string")
    counts = []
    for attempt in range(2):
        # The second time into new tables, as after a break before the commit.
        store = stored.open_store(spark, str(tmp_path / f"s{attempt}"), 2)
        batch = landing_batches(spark)[0]
        stored.sync_batch(store, *batch, channels, templates(), model, now(), ask=lambda requests, answer: answers.ask_kept(kept, requests, answer, 1))
        counts.append((len(os.listdir(log)), store.read("insights").count()))
    assert counts[0] == counts[1] == (2, 1)


def test_bucketed_tables_are_joined_where_they_lie(spark):
    rng = random.Random(6)
    name = f"t{uuid.uuid4().hex}"
    key = lambda: f"v{rng.randrange(60)}"
    old_rows = [(f"id{k}", f"v{k}", rng.choice(["", "t", None]), rng.choice([None, 5]), None, "p", None, None, None) for k in range(0, 60, 2)]
    old = spark.createDataFrame(old_rows, schemas.VIDEOS)
    new = spark.createDataFrame([(key(), rng.choice(["", None, f"n{k}"]), rng.choice([None, k]), rng.choice([None, f"c{k}"]), f"p{k % 3}", k) for k in range(200)], "video_id string, title string, duration_seconds int, channel_id string, podcast string, seq bigint")
    new = new.withColumn("published_at", F.lit(None).cast("timestamp"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored_old = colocated.save(old, f"{name}_a", "video_id", 4)
        merged = merge.upsert_stored_videos(stored_old, new, now())
        assert rows(merged) == rows(merge.upsert_videos(old, new, now()))
        plan = merged._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert "SelectedBucketsCount: 4 out of 4" in plan and plan.count("Exchange hashpartitioning") == 1  # of the new rows
        assert rows(merge.upsert_stored_videos(stored_old, merged.withColumn("seq", F.lit(0)), now()).drop("updated_at")) == rows(merged.drop("updated_at"))
        videos = colocated.save(merged, f"{name}_b", "video_id", 4, placed=True)
        heard = colocated.save(spark.createDataFrame([(f"v{k}",) for k in range(0, 90, 3)], "video_id string"), f"{name}_c", "video_id", 4)
        backlog = jobs.backlog(videos, heard, ordered=False)
        assert "Exchange" not in backlog._jdf.queryExecution().executedPlan().toString()
        assert {r.video_id for r in backlog.collect()} == {r.video_id for r in merged.collect() if int(r.video_id[1:]) % 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for part in "abc":
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def test_a_commit_holds_the_plans_of_one_table_and_none_of_empty_ones(spark, tmp_path, monkeypatch):
    many = Store(spark, str(tmp_path / "many"), {name: ("id string, n decimal(10,2)", "id") for name in "abcd"}, 4)
    running, most, stage = [], [], Store._stage

    def watched(self, snapshot, name, *rest):
        running.append(name)
        most.append(len(running))
        try:
            return stage(self, snapshot, name, *rest)
        finally:
            running.remove(name)

    monkeypatch.setattr(Store, "_stage", watched)
    rows = spark.createDataFrame([("x", None), ("x", None), ("y", None)], "id string, n decimal(10,2)")
    for number in range(2):
        many.commit(many.snapshot(), {name: Change(rows, many.numbers(rows, "id")) for name in "abc"})
        assert most == [1] * 3 * (number + 1) and [many.read(name).count() for name in "abcd"] == [3, 3, 3, 0]
    assert len(many.versions()) == 1
    assert many.read("d").schema == spark.createDataFrame([], "id string, n decimal(10,2)").schema
    plan = rows.join(many.read("d").select("id"), "id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
