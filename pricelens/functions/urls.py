"""URL helpers: absolute links, host allowlists, image-link safety."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.text import py_strip
from pricelens.params import ALLOWED_EXACT_HOSTS, ALLOWED_HOST_SUFFIXES, BASE_URL

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absolute_url(href, base: str = BASE_URL) -> Column:
    """Resolve an href against the site root (scheme-relative, rooted, relative)."""
    h = _c(href)
    return (F.when(h.rlike(SCHEME_RE), h)
            .when(h.startswith("//"), F.concat(F.lit(base.split(":", 1)[0] + ":"), h))
            .when(h.startswith("/") | h.startswith("?") | h.startswith("#"), F.concat(F.lit(base), h))
            .otherwise(F.concat(F.lit(base + "/"), h)))


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), SCHEME_RE, 1))


def url_host(url) -> Column:
    """Lower-cased host: after the last '@' of the authority, before any port."""
    netloc = F.regexp_extract(_c(url), NETLOC_RE, 1)
    hostinfo = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(py_strip(F.regexp_extract(hostinfo, r"^([^:]*)", 1)))


def host_allowed(host: Column, exact: Sequence[str] = ALLOWED_EXACT_HOSTS,
                 suffixes: Sequence[str] = ALLOWED_HOST_SUFFIXES) -> Column:
    """Exact host or dotted-suffix match.  IP literals never pass: no IP ends
    in a dotted domain suffix."""
    cond = host.isin(list(exact)) if exact else F.lit(False)
    for s in suffixes:
        cond = cond | host.endswith(s)
    return (host != "") & cond


def safe_listing_url(url, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> Column:
    """The URL when it is http(s) on an allowed host, else NULL."""
    u = _c(url)
    ok = url_scheme(u).isin("http", "https") & host_allowed(url_host(u), exact, suffixes)
    return F.when(ok, u)


def image_url_allowed(url, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> Column:
    """True only for https links on an allowed host."""
    u = _c(url)
    return F.coalesce((url_scheme(u) == "https") & host_allowed(url_host(u), exact, suffixes),
                      F.lit(False))
