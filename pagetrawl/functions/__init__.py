"""Column functions: everything here is a native Spark expression."""

from pagetrawl.functions.text import (
    STYLE_WORDS,
    UNKNOWN,
    clean_count,
    count_value,
    facet_url_name,
    fingerprint,
    first_or_default,
    has_keyword,
    image_data_uri,
    page_count,
    stamp,
    strip,
)
from pagetrawl.functions.urls import (
    get_url_param,
    image_name,
    last_path_segment,
    search_url,
    set_url_param,
    url_join,
    url_key,
)

__all__ = [
    "STYLE_WORDS",
    "UNKNOWN",
    "clean_count",
    "count_value",
    "facet_url_name",
    "fingerprint",
    "first_or_default",
    "get_url_param",
    "has_keyword",
    "image_data_uri",
    "image_name",
    "last_path_segment",
    "page_count",
    "search_url",
    "set_url_param",
    "stamp",
    "strip",
    "url_join",
    "url_key",
]
