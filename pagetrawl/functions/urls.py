"""URL expressions. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_URL = "https://catalogue.example.com"

# Generic URI syntax (RFC 3986, appendix B), one group per component.
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^//([^/?#]*)"


def _escape(value: Column) -> Column:
    """Percent-encode a query value whose spaces already are ``+``."""
    return F.replace(F.url_encode(value.cast("string")), F.lit("%2B"), F.lit("+"))


def search_url(base: str = BASE_URL, decade: int = 2000, per_page: int = 100) -> Column:
    """Search page of a task (columns country, format, year, style, page)."""
    return F.concat(
        F.lit(f"{base}/search/?layout=sm&country_exact="),
        _escape(F.col("country")),
        F.lit("&format_exact="),
        _escape(F.col("format")),
        F.lit(f"&limit={per_page}&year="),
        F.col("year").cast("string"),
        F.lit("&style_exact="),
        _escape(F.col("style")),
        F.lit("&page="),
        F.col("page").cast("string"),
        F.lit(f"&decade={decade}"),
    )


def set_url_param(url: Column, name: str, value) -> Column:
    """Replace the value of query parameter ``name``; other URLs pass unchanged."""
    value = value if isinstance(value, Column) else F.lit(value)
    with_group = F.concat(F.lit("$1"), value.cast("string"))
    return F.regexp_replace(url, F.lit(f"([?&]{name}=)[^&#]*"), with_group)


def get_url_param(url: Column, name: str) -> Column:
    """Value of query parameter ``name``, null when the URL has none."""
    pattern = f"[?&]{name}=([^&#]*)"
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def last_path_segment(url: Column) -> Column:
    """Everything after the last slash, query string included."""
    return F.substring_index(url, "/", -1)


def image_name(url: Column) -> Column:
    return F.replace(last_path_segment(url), F.lit(".jpeg"), F.lit(""))


def url_key(url: Column) -> Column:
    """Join key of a URL: what a fetch sends, i.e. without the fragment."""
    return F.substring_index(url, "#", 1)


def _path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def _query_of(rest: Column) -> Column:
    """``?query`` with its mark, or empty."""
    return F.regexp_extract(rest, r"^[^?#]*(\?[^#]+)", 1)


def _fragment_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(#.+)$", 1)


def _merge_paths(base_path: Column, path: Column) -> Column:
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    joined = F.regexp_replace(F.concat(folder, path), r"/{2,}", "/")
    return F.when(path.startswith("/"), path).otherwise(joined)


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; only paths that have some get here."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_open = F.element_at(parts, -1).isin(".", "..")
    kept = F.when(ends_open, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(kept, "/")


def url_join(base, href) -> Column:
    """Resolve ``href`` against ``base`` as a browser would.

    An empty or null reference is the base itself; a reference with a scheme
    is already absolute; the other forms inherit what they leave out.
    """
    base = base if isinstance(base, Column) else F.lit(base)
    # as browsers do: no spaces or control characters around it, no tabs or line breaks in it
    href = F.regexp_replace(F.regexp_replace(href, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", "")
    scheme = F.regexp_extract(base, _SCHEME, 1)
    after_scheme = F.regexp_replace(base, _SCHEME, "")
    authority = F.regexp_extract(after_scheme, _AUTHORITY, 0)
    base_rest = F.regexp_replace(after_scheme, _AUTHORITY, "")

    path, query, fragment = _path_of(href), _query_of(href), _fragment_of(href)
    merged = _merge_paths(_path_of(base_rest), path)
    resolved = F.when(merged.rlike(r"(^|/)\.\.?(/|$)"), _drop_dots(merged)).otherwise(merged)
    resolved = F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))
    root = F.concat(scheme, F.lit(":"), authority)
    kept_query = F.when(query == "", _query_of(base_rest)).otherwise(query)

    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(path == "", F.concat(root, _path_of(base_rest), kept_query, fragment))
        .otherwise(F.concat(root, resolved, query, fragment))
    )
