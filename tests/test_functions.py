"""Scalar expressions against worked examples."""

import pytest
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.sources import listings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("1:27:30", 5250), ("45:00", 2700), ("299", 299), ("1.5", 65), ("-5", 5), ("", None), ("none", None), (None, None), ("1:2:3:4", 3723), ("99999999999", None), ("9999999:00:00", None), (" 7 ", 7)],
)
def test_parse_duration(spark, text, seconds):
    c = F.lit(text).cast("string")
    assert value(spark, T.parse_duration(c)) == seconds
    if seconds is not None:
        assert value(spark, T.parse_time(c)) == float(seconds)


@pytest.mark.parametrize(("text", "seconds"), [("PT1H27M30S", 5250), ("PT", 0), ("P1DT2H", None), ("pt1h", None), ("PT2m", 120), ("PT1M2M", 120), (None, None), ("PT45S", 45)])
def test_parse_iso8601_duration(spark, text, seconds):
    assert value(spark, T.parse_iso8601_duration(F.lit(text).cast("string"))) == seconds


@pytest.mark.parametrize(
    ("url", "video"),
    [("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?t=3", "dQw4w9WgXcQ"), ("x/embed/dQw4w9WgXcQabc", "dQw4w9WgXcQ"), ("https://www.youtube.com/shorts/ccccccccccc", None), ("URL", None), ("youtu.be/short", None)],
)
def test_extract_video_id(spark, url, video):
    assert value(spark, T.extract_video_id(F.lit(url))) == video


def test_podcast_hms_and_speakers(spark):
    for path, podcast in (("/x/Marketing Operators.csv", "marketing_operator"), ("/FINANCE_operators", "finance_operators"), ("/marketing.csv", "9operators")):
        assert value(spark, T.infer_podcast(F.lit(path))) == podcast
    for seconds, hms in ((0.9, "00:00:00"), (3661.5, "01:01:01"), (360000.0, "100:00:00")):
        assert value(spark, T.format_hms(F.lit(seconds))) == hms
    for speaker, name, label in ((None, "Speaker", ""), ("", "Speaker", ""), ("0", "Speaker", ""), ("0.0", "Speaker", ""), ("00", "00", "00"), ("0e5x", "0e5x", "0e5x"), ("1", "1", "1"), ("Ann", "Ann", "Ann")):
        c = F.lit(speaker).cast("string")
        assert (value(spark, T.speaker_name(c)), value(spark, T.speaker_label(c))) == (name, label)
    assert value(spark, T.utterance_line(F.lit(61.2), F.lit("A"), F.lit(" hi\n"))) == "00:01:01 A: hi"


def test_tags(spark):
    raw = F.lit("x <title> A </title><start_time>0:42:10</start_time><end_time>45:30</end_time><FrameWork>\n## F\n</FrameWork></FrameWork>")
    assert value(spark, T.title_of(raw)) == "A" and value(spark, T.framework_of(raw)) == "## F"
    assert (value(spark, T.start_time_of(raw)), value(spark, T.end_time_of(raw))) == (2530.0, 2730.0)
    bare = F.lit(" " + "y" * 200 + " ")
    assert value(spark, T.title_of(bare)) == "y" * 120 and value(spark, T.framework_of(bare)) == "y" * 200 and value(spark, T.start_time_of(bare)) is None
    empty = F.lit("<title></title><FrameWork></FrameWork><start_time></start_time>")
    assert value(spark, T.title_of(empty)) == "" and value(spark, T.framework_of(empty)) == "" and value(spark, T.start_time_of(empty)) is None


def test_strip_render_and_handles(spark):
    odd = "\x1c   a b　\x1f\n"
    assert value(spark, T.strip(F.lit(odd))) == odd.strip() == "a b"
    filled = T.render(F.lit("{transcript}-{insight}"), {"transcript": F.lit("$1 {insight}"), "insight": F.lit("\\i")})
    assert value(spark, filled) == "$1 \\i-\\i"
    for own, usual, want in (("@@me ", "d", "me"), (" ", "d", "d"), (None, "d", "d"), ("@", "d", ""), (None, None, None)):
        assert value(spark, T.channel_handle(F.lit(own).cast("string"), F.lit(usual).cast("string"))) == want
    assert value(spark, T.seconds(F.lit(1e12))) is None and schemas.MIN_DURATION == 300


def test_default_channel_handles(spark):
    shows = spark.createDataFrame([(p,) for p in (*schemas.PODCASTS, "other")], "podcast string")
    own = spark.createDataFrame([("finance_operators", " @@mine "), ("marketing_operator", "  ")], "podcast string, handle string")
    channels = spark.createDataFrame([(h, f"id {h}") for h in ("Operators9", "MarketingOperators", "mine")], "handle string, channel_id string")
    got = {r.podcast: r.channel_id for r in listings.channels_of(shows, own, None, channels).collect()}
    assert got == {"9operators": "id Operators9", "marketing_operator": "id MarketingOperators", "finance_operators": "id mine"}
