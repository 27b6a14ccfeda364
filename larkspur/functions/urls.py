"""URL expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query names that only track a visit, besides every name that starts with utm_.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src"]

# File endings that are never HTML.
NON_HTML = [
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif", "pdf", "zip", "gz", "tar", "dmg", "pkg", "ipa", "exe", "mp3", "mp4", "mov", "m4a", "wav", "webm", "css", "js", "json", "xml", "rss", "atom", "txt",
    "woff", "woff2", "ttf", "otf",
]

SPACES = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
WEB = "(?is)^(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def without_dots(path: Column) -> Column:
    """Path with its ``.`` and ``..`` segments resolved; other paths pass untouched."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")
    fixed = F.when(path.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(path.rlike("(^|/)\\.\\.?(/|$)"), fixed).otherwise(path)


def kept_query(query: Column) -> Column:
    """Query string without tracking items, the rest sorted by name and value; null if nothing is left."""
    name = lambda x: F.substring_index(x, "=", 1)
    items = F.filter(
        F.split(query, "&", -1), lambda x: ~F.lower(name(x)).startswith("utm_") & ~F.lower(name(x)).isin(*TRACKING)
    )
    rows = F.array_sort(F.transform(items, lambda x: F.struct(name(x).alias("name"), F.regexp_extract(x, "(?s)=(.*)$", 1).alias("value"), x.alias("item"))))
    return F.when(F.size(items) > 0, F.array_join(F.transform(rows, lambda r: r["item"]), "&"))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, WEB, group)


def host_port(url: Column) -> tuple[Column, Column]:
    """Host in lower case and the port as text (empty if none or the scheme's own) of a trimmed web URL."""
    authority = F.regexp_replace(_part(url, 2), "^.*@", "")
    host = F.lower(F.regexp_extract(authority, "^(\\[[^\\]]*\\]|[^:]*)", 1))
    port = F.regexp_extract(authority, ":(\\d+)$", 1)
    scheme = F.lower(_part(url, 1))
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return host, F.when(own, F.lit("")).otherwise(port)


def normalize_url(url: Column) -> Column:
    """One spelling for all URLs of a page; null for null, blank, relative and non-web ones.

    Scheme and host are lowered, user, fragment and default port dropped, dot segments resolved, an empty
    path becomes ``/``, tracking items leave the query and the others are sorted; an empty query is dropped.
    """
    t = trimmed(url)
    host, port = host_port(t)
    path = without_dots(_part(t, 3))
    query = _part(t, 4)
    kept = F.when(query != "", kept_query(query))
    return F.when(
        t.rlike(WEB) & (host != ""),
        F.concat(
            F.lower(_part(t, 1)),
            F.lit("://"),
            host,
            F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")),
            F.when(path == "", F.lit("/")).otherwise(path),
            F.coalesce(F.concat(F.lit("?"), kept), F.lit("")),
        ),
    )


def host_key(host: Column) -> Column:
    """A host without regard to case, a trailing dot or a default port, as host columns spell it."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(host)), ":(80|443)$", ""), "\\.$", "")


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` of a normalised URL."""
    return F.nullif(F.regexp_extract(url, "^(https?://[^/?#]+)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a normalised URL, without its port."""
    return F.nullif(F.regexp_extract(url, "^https?://(\\[[^\\]]*\\]|[^/?#:]+)", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a normalised URL."""
    return F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)


def path_depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(url_path(url), "/"), lambda s: s != ""))


def host_within(host: Column, domain: Column | str) -> Column:
    """Whether the host is the domain or one of its subdomains."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (host == d) | host.endswith(F.concat(F.lit("."), d))


def is_non_html(url: Column) -> Column:
    """Whether the path ends in an extension that is never HTML."""
    ext = F.lower(F.regexp_extract(url_path(url), "[^/]\\.([^./]+)/?$", 1))
    return ext.isin(*NON_HTML)


def looks_like_trap(url: Column) -> Column:
    """More than 20 path segments, one segment more than three times, or more than 10 query items."""
    parts = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    most = F.array_max(F.transform(parts, lambda s: F.size(F.filter(parts, lambda o: o == s))))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    items = F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&")))
    return (F.size(parts) > 20) | (F.coalesce(most, F.lit(0)) > 3) | (items > 10)


def url_text(url: Column) -> Column:
    """Host and decoded path as words: slashes, hyphens, underscores and dots become spaces."""
    path = F.coalesce(F.try_url_decode(F.replace(url_path(url), F.lit("+"), F.lit("%2B"))), url_path(url))
    return F.translate(F.concat(F.coalesce(url_host(url), F.lit("")), path), "/-_.", "    ")
