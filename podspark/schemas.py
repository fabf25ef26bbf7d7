"""Explicit schemas of every table and landed document; nothing is inferred from data."""

from __future__ import annotations

import os

VIDEOS = "id string, video_id string, title string, duration_seconds int, channel_id string, podcast string, published_at timestamp, created_at timestamp, updated_at timestamp"
TRANSCRIPTIONS = "id string, video_id string, raw_text string, language string, created_at timestamp"
SEGMENTS = "id string, transcription_id string, start_time_sec decimal(10,2), end_time_sec decimal(10,2), text string, speaker_label string, created_at timestamp"
INSIGHTS = "id string, video_id string, podcast string, category string, title string, description string, start_time_sec decimal(10,2), end_time_sec decimal(10,2), framework_markdown string, source_chunk string, created_at timestamp"
SEED_LINKS = "id string, video_id string, podcast string, title string, duration_seconds int, url string, created_at timestamp, updated_at timestamp"

SEED_CSV = "url string, c2 string, duration string, title string"
LINK_BATCH = "links array<struct<video_id: string, podcast: string, title: string, duration_seconds: int, url: string>>"
LISTING = "channel_id string, podcast string, items array<struct<id: struct<videoId: string>>>"
DETAILS = "channel_id string, items array<struct<id: string, snippet: struct<title: string, publishedAt: string>, contentDetails: struct<duration: string>>>"
SPEECH = "results struct<channels: array<struct<alternatives: array<struct<transcript: string>>>>>, utterances array<struct<start: double, `end`: double, transcript: string, speaker: string>>"

# The three shows and their default channel handles.
PODCASTS = ("9operators", "marketing_operator", "finance_operators")
DEFAULT_HANDLES = {"9operators": "Operators9", "marketing_operator": "MarketingOperators", "finance_operators": "FinanceOperators"}
# Where each show's list of links is looked for if no place is given.
DEFAULT_FOLDER = os.path.join(os.environ.get("USERPROFILE", ""), "Downloads")
DEFAULT_CSVS = {
    "9operators": os.path.join(DEFAULT_FOLDER, "Operators Podcast Video Youtube Links.csv"),
    "marketing_operator": os.path.join(DEFAULT_FOLDER, "Marketing Operators Podcast Video Youtube Links.csv"),
    "finance_operators": os.path.join(DEFAULT_FOLDER, "Finance Operators Podcast Video Youtube Links.csv"),
}
MIN_DURATION = 300
LATEST = 50
CHUNK_SIZE, CHUNK_OVERLAP = 6000, 500
TITLE_CHARS, URL_CHARS, CHUNK_CHARS, RAW_TITLE_CHARS = 2048, 2048, 8000, 120
SEARCH_FIELDS = ("id", "video_id", "podcast", "category", "title", "description", "start_time_sec", "end_time_sec", "framework_markdown")
