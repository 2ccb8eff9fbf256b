"""Explicit schemas of every table; nothing is ever inferred."""

from __future__ import annotations

PAGE = "url string, status int, html string, fetched_at timestamp"
ARCHIVE_PAGE = "page_id bigint, url string, html string"

SEED_TASK = "country string, format string, year int, style string, page int"
DETAIL_TASK = "url string"
SEED_TASK_COLUMNS = ("country", "format", "year", "style", "page")

# Fields each stage writes into the catalogue, in the order they are written.
INDEX_FIELDS = (
    "artist",
    "title",
    "detail_url",
    "label",
    "catalog_number",
    "format",
    "year",
    "country",
    "url",
    "page_index",
    "crawler_time",
)
DETAIL_FIELDS = ("cover_url", "title_list", "crawler_time")
IMAGE = "name string, content binary"
IMAGE_SOURCE = "url string, content binary"
OUTCOME = "fp string, attempt int, ok boolean, error string"
