"""URLs: schemes, query keys that carry secrets, data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SENSITIVE_QUERY_KEYS


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?:"), F.lit(False))


def resolve(href: Column, base: Column) -> Column:
    """href against the page's URL: absolute, scheme-relative, root-relative, query-only and plain relative ones."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def normalised(url: Column) -> Column:
    """An absolute http(s) URL as browsers write it: no outer blanks, scheme and host in lower case, no default port, no dot segments."""
    url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    origin = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(http://.*):(80)?$", "$1"), r"^(https://.*):(443)?$", "$1")
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*([?#][\s\S]*)?$", 1)
    parts = F.split(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/")
    up = lambda p: F.lower(p).isin("..", ".%2e", "%2e.", "%2e%2e")
    here = lambda p: F.lower(p).isin(".", "%2e")
    # The first part is empty, it stands before the leading slash; a last dot segment leaves an empty one.
    parts = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i == F.size(parts) - 1).alias("last")))
    after = lambda s, p: F.when(p["last"], F.concat(s, F.array(F.lit("")))).otherwise(s)
    step = lambda s, p: F.when(up(p["p"]), after(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), p)).when(here(p["p"]), after(s, p)).otherwise(F.concat(s, F.array(p["p"])))
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(url.rlike("^(?i)https?://"), F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), rest)).otherwise(url)


def query_keys(url: Column) -> Column:
    """Decoded names of the query's parameters, in order, repeats kept."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    return F.transform(names, lambda k: F.coalesce(F.try_url_decode(k), k))


def sensitive_keys(url: Column) -> Column:
    return F.filter(query_keys(url), lambda k: F.lower(k).isin(SENSITIVE_QUERY_KEYS))


def masked_url(url: Column) -> Column:
    """Origin and path, the query hidden."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*)", 1)
    bare = head.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$")
    return F.concat(head, F.when(bare, F.lit("/")).otherwise(F.lit("")), F.lit("?..."))


def data_url_of(screenshot: Column) -> Column:
    """The data URL of a screenshot message: the text itself, or the first of the known keys of a JSON object."""
    keys = ("dataUrl", "dataURL", "image", "screenshot")
    return F.when(F.startswith(F.ltrim(screenshot), F.lit("{")), F.coalesce(*[F.get_json_object(screenshot, f"$.{k}") for k in keys])).otherwise(screenshot)


def data_url_parts(url: Column) -> tuple[Column, Column]:
    """MIME type and bytes of an image data URL; nulls for anything else."""
    ok = F.startswith(url, F.lit("data:image/")) & F.contains(url, F.lit(","))
    head = F.substring_index(url, ",", 1)
    mime = F.split_part(F.substring(head, 6, 1 << 20), F.lit(";"), F.lit(1))
    body = F.try_to_binary(F.regexp_extract(url, r"^[^,]*,(.*)$", 1), F.lit("base64"))
    return F.when(ok, mime), F.when(ok, body)
