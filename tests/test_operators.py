"""Operators on hand-made rows, and against row-by-row models."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podspark import schemas
from podspark.operators import insights as I
from podspark.operators import bloom, integrity, merge, search
from podspark.operators.chunks import chunks
from podspark.operators.parse import parse_insights
from podspark.operators.transcripts import parse_responses, segments_of
from podspark.plans import jobs
from podspark.sources import listings, prompts, seeds
from podspark.sources import tables as S
from podspark.streaming import sync


def now():
    return F.expr("timestamp'2024-01-01 00:00:00'")


def test_seed_files(spark, tmp_path):
    first = 'URL,x,Duration,Title\nhttps://www.youtube.com/watch?v=dQw4w9WgXcQ,x,1:27:30,A\nhttps://youtu.be/dQw4w9WgXcQ,x,45:00,B\nhttps://youtu.be/aaaaaaaaaaa,x,4:59,short\nhttps://youtu.be/aaaaaaaaaaa,x,45:00,long\nhttps://youtu.be/bbbbbbbbbbb\n"https://youtu.be/ddddddddddd",x,10:00,"Say ""hi"",\nthen go",extra\nhttps://www.youtube.com/shorts/ccccccccccc,x,45:00,S\n'
    second = "https://youtu.be/aaaaaaaaaaa,x,45:00,later\nhttps://youtu.be/dQw4w9WgXcQ,x,45:00,again\n"
    (tmp_path / "one.csv").write_text(first)
    (tmp_path / "two.csv").write_text(second)
    got = {r.video_id: r for r in seeds.read_seed_csvs(spark, {"p": str(tmp_path / "one.csv"), "q": str(tmp_path / "two.csv"), "r": str(tmp_path / "none.csv")}).collect()}
    assert set(got) == {"dQw4w9WgXcQ", "aaaaaaaaaaa", "bbbbbbbbbbb", "ddddddddddd"}
    assert (got["dQw4w9WgXcQ"].title, got["dQw4w9WgXcQ"].duration_seconds, got["aaaaaaaaaaa"].title, got["aaaaaaaaaaa"].podcast) == ("A", 5250, "later", "q")
    assert got["bbbbbbbbbbb"].duration_seconds is None and got["bbbbbbbbbbb"].title == "" and got["ddddddddddd"].title == 'Say "hi",\nthen go'
    assert seeds.read_seed_csv(spark, str(tmp_path / "none.csv")).collect() == []
    assert {r.podcast for r in seeds.read_seed_csv(spark, str(tmp_path / "one.csv")).collect()} == {"9operators"}


def test_link_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"links": [{"video_id": " v1 ", "podcast": "p"}, {"video_id": "", "podcast": "p"}, {"video_id": "v1", "podcast": "p", "title": "T", "duration_seconds": 5}]}')
    links = seeds.read_link_batches(spark, str(tmp_path))
    merged = merge.upsert_seed_links(spark.createDataFrame([], schemas.SEED_LINKS), links, now()).collect()
    assert [(r.video_id, r.podcast, r.title, r.duration_seconds, r.url) for r in merged] == [("v1", "p", "T", 5, "")]


def fold(old, new):
    """Row by row."""
    table = {(r[0], r[1]): list(r[2:]) for r in old}
    for v, p, title, dur, url in new:
        row = table.setdefault((v, p), ["", None, ""])
        row[0], row[2] = title or row[0], url or row[2]
        row[1] = row[1] if dur is None else dur
    return sorted((*k, *r) for k, r in table.items())


def test_upserts_fold_in_order_and_are_idempotent(spark):
    rng = random.Random(1)
    row = lambda: (f"v{rng.randint(0, 9)}", rng.choice("pq"), rng.choice(["", "a", "b", "c"]), rng.choice([None, 1, 2, 3]), rng.choice(["", "x", "y"]))
    old = list({r[:2]: r for r in (row() for _ in range(12))}.values())
    new = [row() for _ in range(80)]
    stamp = "timestamp'2023-01-01 00:00:00'"
    table = spark.createDataFrame(old, "video_id string, podcast string, title string, duration_seconds int, url string").select(F.concat("video_id", "podcast").alias("id"), "video_id", "podcast", "title", "duration_seconds", "url", F.expr(stamp).alias("created_at"), F.expr(stamp).alias("updated_at"))
    rows = spark.createDataFrame([(*r, k) for k, r in enumerate(new)], "video_id string, podcast string, title string, duration_seconds int, url string, seq long").repartition(5)
    once = merge.upsert_seed_links(table, rows, now())
    key = lambda df: sorted((r.video_id, r.podcast, r.title, r.duration_seconds, r.url) for r in df.collect())
    assert key(once) == [tuple(r) for r in fold(old, new)]
    assert key(merge.upsert_seed_links(once, rows, now())) == key(once)


def test_null_titles_stay_and_last_podcast_wins(spark):
    old = spark.createDataFrame([("i", "v", None, None, None, "p", None, None, None)], schemas.VIDEOS)
    new = spark.createDataFrame([("v", "", None, None, "q", None, 1), ("v", "", 5, "c", None, None, 2), ("w", None, None, None, "r", None, 1)], "video_id string, title string, duration_seconds int, channel_id string, podcast string, published_at timestamp, seq long")
    got = {r.video_id: r for r in merge.upsert_videos(old, new, now()).collect()}
    assert got["v"].title is None and got["v"].duration_seconds == 5 and got["v"].id == "i" and got["w"].title == "" and got["w"].podcast == "r"


def test_responses_and_segments(spark):
    cases = [
        ("a", '{"results": {"channels": [{"alternatives": [{"transcript": " hello "}]}]}, "utterances": [{"start": 1.5, "end": 2, "transcript": " x ", "speaker": 0}, {"start": 1, "end": null, "transcript": "y", "speaker": 1}, {"start": null, "end": 3, "transcript": "z"}, {"start": 4, "end": 5, "transcript": " "}]}'),
        ("b", '{"results": {"channels": []}}'), ("c", None), ("d", '{"results": {"channels": [{"alternatives": [{"transcript": "only text"}]}]}, "utterances": []}'),
        ("e", '{"results": {"channels": [{"alternatives": [{"transcript": "t"}]}]}, "utterances": [{"start": null, "end": 1, "transcript": "q"}]}'), ("f", "not json"),
    ]
    parsed = parse_responses(spark.createDataFrame(cases, "video_id string, response string"))
    got = {r.video_id: (r.raw_text, r.timestamped) for r in parsed.collect()}
    assert got == {"a": ("hello", "00:00:01 Speaker: x\n00:00:01 1: y"), "b": ("", ""), "c": ("", ""), "d": ("only text", "only text"), "e": ("t", ""), "f": ("", "")}
    segments = [(float(r.start_time_sec), float(r.end_time_sec), r.text, r.speaker_label) for r in segments_of(parsed, now()).collect()]
    assert sorted(segments) == [(1.5, 2.0, "x", ""), (4.0, 5.0, "", "")]


@pytest.mark.parametrize("n", [0, 1, 5999, 6000, 6001, 11500, 11501, 20000])
def test_chunks_put_together_again(spark, n):
    text = "".join(random.Random(n).choice("aé😀 b") for _ in range(n))
    got = [r.chunk for r in chunks(spark.createDataFrame([("v", text)], "v string, t string"), "t", ["v"]).orderBy("chunk_no").collect()]
    assert "".join([*got[:1], *(c[500:] for c in got[1:])]) == text and all(len(c) == 6000 for c in got[:-1])
    with pytest.raises(ValueError):
        chunks(spark.createDataFrame([("v", text)], "v string, t string"), "t", ["v"], size=5, overlap=5)


def plain_parse(text):
    """The rules line by line."""
    out = []

    def bullets(lines, category):
        for line in lines:
            line = line.strip()
            if line.startswith("*"):
                body = line[1:].strip()
                m = re.match(r'^"([^"]+)"\s*[–—\-]\s*(.+)$', body)
                if m:
                    out.append((category, m[2].strip(), m[1].strip()))
                elif ": " in body:
                    t, d = body.split(": ", 1)
                    out.append((category, t.strip(), d.strip()))
                else:
                    out.append((category, body, ""))

    body = re.sub(r"\n?---+\s*$", "", re.sub(r"^\s*---+\s*\n?", "", text))
    for block in re.split(r"\n---+\n", body):
        block = block.strip()
        if not block or "(none)" in block.lower():
            continue
        lines, category, held = block.splitlines(), "", []
        for line in map(str.strip, lines):
            if line and not line.startswith("*") and line.endswith(":"):
                if category:
                    bullets(held, category)
                category, held = line.rstrip(":").strip(), []
            elif line.startswith("*"):
                held.append(line)
        if category:
            bullets(held, category)
        if not out and not category and not lines[0].rstrip(":").startswith("*"):
            bullets(lines[1:], lines[0].rstrip(":").strip())
    return out


def test_parsed_insights_equal_the_rules(spark):
    rng = random.Random(7)
    pieces = ["A:", "B::", ":", "* x: y", '* "q" – P', '*"q"-P: z', "* bare", "*", "prose", "prose:", "---", "----", " ---", "(None)", "", "  ", "* (none)", "<tag>", " * in: d : e", "\x1f* odd", "a\x0b* b", "* c\r", "\u2028"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw string").repartition(4)
    got = {}
    for r in parse_insights(rows, ["k"]).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.category, r.title, r.description))
    for k, text in enumerate(texts):
        assert got.get(k, []) == plain_parse(text), repr(text)


def test_responses_are_parsed_without_a_shuffle(spark):
    plan = parse_insights(spark.range(9).select("id", F.lit("A:\n* b").alias("raw")), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "ArrowEval" not in plan


def test_model_steps(spark):
    template = {"extract_insights_system": F.lit("T {transcript}")}
    pieces = spark.createDataFrame([("v", 0, "c0"), ("v", 1, "c1")], "video_id string, chunk_no int, chunk string")
    asked = I.insight_requests(pieces, template["extract_insights_system"])
    assert sorted(r.prompt for r in asked.collect()) == ["T c0", "T c1"] and I.insight_requests(pieces, F.lit("")).collect() == []
    found = I.insights_of(asked, I.ask(asked, lambda kind, prompt: f"X:\n* {prompt[-2:]}: d"), pieces)
    assert sorted((r.chunk_no, r.title, r.chunk) for r in found.collect()) == [(0, "c0", "c0"), (1, "c1", "c1")]
    nothing = spark.createDataFrame([], "request_id string, raw string")
    assert I.insights_of(asked, nothing, pieces).collect() == []


def test_search_rules(spark):
    rows = [("1", "v", "p", "c", "Brand Spend", "on brand", 2.0, None, None), ("2", "v", "p", "c", "Other", "brand spend spend", None, None, None), ("3", "w", "q", "c", "x", "y", 1.0, None, "Brand, spend!"), ("4", "w", "q", "d", "brand", "z", 1.0, None, None)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c.endswith('_sec') else 'string'}" for c in schemas.SEARCH_FIELDS))
    ids = lambda *a, **k: [r.id for r in search.search(docs, *a, **k).collect()]
    assert ids("BRAND spend") == ["1", "2", "3"] and ids("") == ["1", "2", "3", "4"] and ids("brand", limit=0) == []
    assert ids("", sort="start_time_sec:desc, ,title:asc") == ["1", "4", "3", "2"] and ids("", {"podcast": "q", "category": ""}) == ["3", "4"]
    assert search.search(docs, "brand", limit=2).first().total == 4
    for bad in ({"sort": "id:asc"}, {"sort": "title:up"}, {"limit": -1}):
        with pytest.raises(ValueError):
            search.search(docs, "", **bad)
    queries = spark.createDataFrame([("a", "brand spend"), ("b", "nothing here"), ("c", ""), ("d", "Z brand")], "query_id string, q string")
    got = sorted((r.query_id, r.place, r.id) for r in search.batch_search(docs, queries, 2).collect())
    assert got == [("a", 1, "1"), ("a", 2, "2"), ("d", 1, "4")]


def test_search_keeps_the_best_and_counts_in_one_pass(spark, monkeypatch):
    rows = [(str(k), "v", "p", "c", f"word {'word ' * (k % 7)}", "other", float(k % 5), None, None) for k in range(300)]
    docs = spark.createDataFrame(rows, "id string, video_id string, podcast string, category string, title string, description string, start_time_sec double, end_time_sec double, framework_markdown string").repartition(5)
    kept = []
    monkeypatch.setattr(search, "stored", lambda df, f=search.stored: kept.append(df) or f(df))
    got = search.search(docs, "word", sort="start_time_sec:desc", limit=7).collect()
    want = sorted(rows, key=lambda r: (-r[6], -len(r[4].split()), r[0]))[:7]
    assert [r.id for r in got] == [r[0] for r in want] and {r.total for r in got} == {300}
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and kept[0].count() == 7 and "TakeOrderedAndProject" in plan and plan.count("CollectMetrics") == 1 and plan.count("Scan") == 1
    # Nothing found, nothing asked for, nothing there.
    assert search.search(docs, "absent").collect() == [] == search.search(docs, "word", limit=0).collect()
    assert search.search(docs.limit(0), "word").collect() == [] == search.search(docs.filter("1 = 0"), "").collect()
    assert {r.total for r in search.search(docs, "", limit=500).collect()} == {300}


def test_cascade_and_orphans(spark):
    v = spark.createDataFrame([("a",), ("b",)], "video_id string")
    t = spark.createDataFrame([("ta", "a"), ("tb", "b"), ("tz", "z")], "id string, video_id string")
    s = spark.createDataFrame([("ta",), ("tb",), ("no",)], "transcription_id string")
    n = [df.count() for df in integrity.cascade_delete(v, t, s, t, v.filter("video_id = 'a'"))]
    assert n == [1, 2, 2, 2]
    assert {r.relation: r.orphans for r in integrity.orphan_report(v, t, s, t).collect()} == {"transcriptions": 1, "segments": 1, "insights": 1}


def test_prompts_and_channels(spark, tmp_path):
    for name, text in (("operators/title_generation", "def"), ("mine/title_generation", "own"), ("operators/timestamp_extraction", "ts")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.md").write_text(text)
    read = prompts.read_prompts(spark, str(tmp_path))
    values = {k: spark.range(1).select(v.alias("x")).first().x for k, v in prompts.templates(read, "mine").items()}
    assert values == {"extract_insights_system": "", "title_generation": "own", "timestamp_extraction": "ts", "make_framework_content": ""}
    assert listings.videos_of(spark.createDataFrame([], schemas.LISTING), spark.createDataFrame([], schemas.DETAILS)).collect() == []


def test_bucketed_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, x int"
    S.write_table(spark.createDataFrame([(str(k), k) for k in range(50)], schema), path, "k", 8)
    new = spark.createDataFrame([("3", -3), ("99", 99)], schema)
    old, numbers = S.touched(spark, path, schema, new, "k", 8)
    S.overwrite_buckets(merge.replace_by_key(old, new, new, "k"), path, "k", numbers, 8)
    assert len(numbers) <= 2 and {r.k: r.x for r in S.read_table(spark, path, schema).collect()} == {**{str(k): k for k in range(50)}, "3": -3, "99": 99}


def test_emptied_buckets_stay_empty(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, x int"
    S.write_table(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema), path, "k", 4096)
    gone, none = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([], schema)
    for _ in range(2):  # the same once more changes nothing
        old, numbers = S.touched(spark, path, schema, gone, "k", 4096)
        S.overwrite_buckets(merge.replace_by_key(old, none, gone, "k"), path, "k", numbers, 4096)
        assert {r.k for r in S.read_table(spark, path, schema).collect()} == {"b", "c"}
    every = spark.createDataFrame([("b",), ("c",)], "k string")
    old, numbers = S.touched(spark, path, schema, every, "k", 4096)
    S.overwrite_buckets(merge.replace_by_key(old, none, every, "k"), path, "k", numbers, 4096)
    assert S.read_table(spark, path, schema).collect() == []


def test_new_set_without_insights_empties_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("i", v, *[None] * 9) for v in ("v1", "v2")], schemas.INSIGHTS)
    S.write_table(old, path, "video_id", 512)
    processed = spark.createDataFrame([("v1",)], "video_id string")
    rows, numbers = S.touched(spark, path, schemas.INSIGHTS, processed, "video_id", 512)
    S.overwrite_buckets(merge.replace_insights(rows, spark.createDataFrame([], schemas.INSIGHTS), processed), path, "video_id", numbers, 512)
    assert [r.video_id for r in S.read_table(spark, path, schemas.INSIGHTS).collect()] == ["v2"]


SAID = '{"results": {"channels": [{"alternatives": [{"transcript": "said"}]}]}, "utterances": [{"start": 1, "end": 2, "transcript": "said", "speaker": 1}]}'


def test_sync_again_after_a_crash(spark, tmp_path, monkeypatch):
    root, templates = str(tmp_path / "tables"), {k: F.lit("{transcript}{insight}") for k in prompts.NAMES}
    sync.create_tables(spark, root, 16)
    landed = spark.createDataFrame([("v1", "p", SAID), ("v2", "p", SAID), ("v1", "q", SAID)], sync.LANDED)

    def run(said):
        sync.process_batch(spark, root, landed, templates, lambda kind, prompt: said if kind == "insights" else "", now(), 16)

    write = S.overwrite_buckets

    def breaks(df, path, *more):
        if path.endswith("videos"):
            raise RuntimeError("lost")
        write(df, path, *more)

    monkeypatch.setattr(S, "overwrite_buckets", breaks)
    with pytest.raises(RuntimeError):
        run("X:\n* one: a\n* two: b\n* three: c")
    assert sync.read_tables(spark, root).insights.count() == 6
    # What is asked again may be answered by nothing: the rows of the run that broke off must go.
    monkeypatch.setattr(S, "overwrite_buckets", write)
    run("")
    run("X:\n* one: a")
    t = sync.read_tables(spark, root)
    assert (t.insights.count(), t.transcriptions.count(), t.segments.count(), sorted(r.video_id for r in t.videos.collect())) == (0, 2, 2, ["v1", "v2"])


def test_link_batches_in_the_order_of_their_files(spark, tmp_path):
    for name, title in (("b2", "second"), ("a1", "first"), ("c3", "third")):
        (tmp_path / f"{name}.json").write_text('{"links": [{"video_id": "v", "podcast": "p", "title": "x"}, {"video_id": "v", "podcast": "p", "title": "%s"}]}' % title)
    links = seeds.read_link_batches(spark, str(tmp_path))
    assert [r.title for r in links.orderBy("seq").collect()] == ["x", "first", "x", "second", "x", "third"]
    assert merge.upsert_seed_links(spark.createDataFrame([], schemas.SEED_LINKS), links, now()).first().title == "third"


def test_default_places_of_seed_files(spark, tmp_path, monkeypatch):
    path = tmp_path / "links.csv"
    path.write_text("https://youtu.be/aaaaaaaaaaa,x,45:00,A\n")
    monkeypatch.setattr(schemas, "DEFAULT_CSVS", {"p": str(path), "q": str(tmp_path / "none.csv")})
    for none in (None, {}):
        assert [(r.video_id, r.podcast) for r in seeds.read_seed_csvs(spark, none).collect()] == [("aaaaaaaaaaa", "p")]
    empty = jobs.Tables(*(spark.createDataFrame([], s) for s in (schemas.VIDEOS, schemas.TRANSCRIPTIONS, schemas.SEGMENTS, schemas.INSIGHTS, schemas.SEED_LINKS)))
    heard = spark.createDataFrame([("aaaaaaaaaaa", SAID), ("unknown", SAID)], "video_id string, response string")
    templates = {k: F.lit("{transcript}") for k in prompts.NAMES}
    tables, per_video, summary = jobs.backfill_default_csvs(spark, empty, heard, templates, lambda kind, prompt: "X:\n* some title: b", now())
    assert summary.first().asDict() == {"seeded": 1, "processed": 1, "insights": 1} and per_video.count() == tables.insights.count() == tables.transcriptions.count() == 1


def test_no_local_folder_on_a_cluster():
    class Unset:
        def __getattr__(self, name):
            return {"master": "spark://host:7077", "isDefined": lambda: False, "get": lambda name, default: default}.get(name, self)

        def __call__(self):
            return self

    with pytest.raises(ValueError):
        S.checkpoint_root(Unset())


def test_prompts_are_not_shuffled(spark):
    found = spark.createDataFrame([("v", 0, 0, "c", "t", "d", "chunk")], "video_id string, chunk_no int, pos int, category string, title string, description string, chunk string")
    told = spark.createDataFrame([("v", "long text")], "video_id string, timestamped string")
    asked = I.ask(I.timestamp_requests(found, told, F.lit("{transcript}")), lambda kind, prompt: "")
    plan = asked._jdf.queryExecution().executedPlan().toString().splitlines()
    ask = next(k for k, line in enumerate(plan) if "MapInPandas" in line)
    first = next(k for k, line in enumerate(plan) if "Exchange" in line)
    assert ask < first and any("replace(" in line for line in plan[ask:first])


def test_a_transcript_crosses_once_per_stretch_of_its_video(spark):
    found = spark.createDataFrame([(f"v{v}", c, p, "t", d) for v in range(3) for c in (0, 31, 32) for p, d in enumerate(["{insight}", "", None])], "video_id string, chunk_no int, pos int, title string, description string")
    told = spark.createDataFrame([("v0", "long {insight} text {transcript}"), ("v1", None), ("v2", "")], "video_id string, timestamped string")
    for template in ("{transcript} # {insight}{insight}", "{insight}", "none", ""):
        say = lambda kind, prompt: f"{kind}: {prompt}"
        by_video = I.told_by_video(found, told, F.lit(template))
        rows = I.ask_by_video(by_video, say).collect()
        want = {r.request_id: r.raw for r in I.ask(I.timestamp_requests(found, told, F.lit(template)), say).collect()}
        assert {r.request_id: r.raw for r in rows} == want and len(rows) == len(want) == (27 if template else 0)
        assert by_video.count() == (6 if template else 0)
    assert I.ask_by_video(I.told_by_video(found.limit(0), told, F.lit("x")), say).collect() == []


def test_answers_of_many_videos_leave_the_worker_together(spark, monkeypatch):
    found = spark.range(300).repartition(1).selectExpr("concat('v', id) AS video_id", "0 AS chunk_no", "cast(id % 7 AS int) AS pos", "'t' AS title", "concat('d', id) AS description")
    told = found.select("video_id", F.lit("x").alias("timestamped"))
    by_video = I.told_by_video(found, told, F.lit("{transcript}{insight}")).coalesce(1)
    ask = lambda: I.ask_by_video(by_video, lambda kind, prompt: prompt)
    batches = lambda df: df.mapInArrow(lambda parts: (pa.RecordBatch.from_arrays([pa.array([p.num_rows])], ["n"]) for p in parts), "n bigint").collect()
    assert [r.n for r in batches(ask())] == [300]
    assert sorted((r.video_id, r.chunk_no, r.pos, r.raw) for r in ask().collect()) == sorted((f"v{k}", 0, k % 7, f"xd{k}") for k in range(300))
    monkeypatch.setattr(I, "ANSWERS", 128)
    assert sorted(r.raw for r in ask().collect()) == sorted(f"xd{k}" for k in range(300))


def test_in_rows_and_by_requests_give_the_same_insights(spark):
    said = {"insights": "Frameworks:\n* ab: one\n* a long title: two\nQuotes:\n* x: three\n* another title: four", "title": "<title>T</title>", "timestamps": "<start_time>1:00</start_time>", "framework": "<FrameWork>F</FrameWork>"}
    answer = lambda kind, prompt: None if "none" in prompt and kind != "insights" else said[kind] if "silent" not in prompt else ""
    responses = spark.createDataFrame([(f"v{k}", "p", json.dumps({"results": {"channels": [{"alternatives": [{"transcript": text}]}]}})) for k, text in enumerate(["short", "none", "silent", "", "x" * 12_000, "none " * 3000])], "video_id string, podcast string, response string")
    full = {"extract_insights_system": "I {transcript}", "title_generation": "N {insight}", "timestamp_extraction": "W {insight} {transcript}", "make_framework_content": "M {topic} {raw_transcript}"}
    empty = jobs.Tables(*(spark.createDataFrame([], s) for s in (schemas.VIDEOS, schemas.TRANSCRIPTIONS, schemas.SEGMENTS, schemas.INSIGHTS, schemas.SEED_LINKS)))
    for blank in (None, *full):
        templates = {k: F.lit("" if k == blank else v) for k, v in full.items()}
        a, b = (jobs.process(empty, responses, templates, answer, now(), ask) for ask in (I.ask, lambda requests, answer: I.ask(requests, answer)))
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(a[0].insights) == rows(b[0].insights) and rows(a[1]) == rows(b[1]), blank
        assert a[0].insights.count() == (0 if blank == "extract_insights_system" else 4 * 8)
    # What is asked in rows is not shuffled.
    plan = I.titled_and_framed(spark.createDataFrame([("v", "p", 0, "c")], "video_id string, podcast string, chunk_no int, chunk string"), templates, answer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 3


def test_missing_by_filter_equals_the_anti_join(spark):
    rng = random.Random(1)
    child = spark.createDataFrame([(rng.randrange(900) if k % 9 else None, str(k % 50), k % 3) for k in range(3000)] + [(7000, "x", 1)] * 3, "word bigint, bits string, _key int")
    parent = spark.createDataFrame([(rng.randrange(900), "a") for _ in range(700)] + [(None, "b")], "word int, _parent string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(integrity.orphans(child, parent.select(F.col("word").alias("p")), "word", "p"))
    assert len(want) > 500
    # A filter of one word lets all pass, so wrong hits settle it; the last way shuffles them.
    for most, keys in ((1 << 20, 1000), (1, 1000), (1, 0)):
        assert rows(bloom.missing(child, parent, "word", "word", most, keys)) == want
    assert rows(bloom.missing(child, parent.limit(0), "word", "word")) == rows(child.filter("word IS NOT NULL"))
    assert rows(bloom.missing(child.limit(0), parent, "word", "word")) == []
    texts = child.selectExpr("bits AS id")
    assert rows(bloom.missing(texts, texts.filter("id < '3'"), "id", "id")) == rows(texts.filter("id >= '3'"))
    with pytest.raises(ValueError):
        bloom.missing(child.selectExpr("cast(word AS double) AS w"), parent, "w", "word")


def test_filter_keeps_rows_of_the_child_in_place(spark):
    child, parent = spark.range(20_000).selectExpr("id % 5000 AS k", "repeat('x', 50) AS wide"), spark.range(4000)
    assert bloom.key_filter(parent, "id", bloom.words_for(4000)).count() <= bloom.words_for(4000) == 1024
    out = bloom.missing(child, parent, "k", "id")
    assert out.count() == 4000
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    # Wrong hits are few while the filter is not full.
    found = bloom.key_filter(parent, "id", 1024).alias("_bloom")
    assert spark.range(4000, 24_000).join(F.broadcast(found), bloom._hit(F.col("id"), 1024), "left_semi").count() < 2000
