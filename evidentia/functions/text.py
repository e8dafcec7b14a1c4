"""Scalar rules over text: URLs, times, identifiers, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the evidence profile.
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})\z"
SHA256 = r"\A[0-9a-f]{64}\z"
CONTROL = r"[\x00-\x1F\x7F]"
MOST_TEXT = 2048


def falsy(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def valid_text(c: Column) -> Column:
    """Non-empty, not over 2048 characters, no control characters."""
    return F.coalesce((F.trim(c) != "") & (F.length(c) <= MOST_TEXT) & ~c.rlike(CONTROL), F.lit(False))


def valid_time(c: Column) -> Column:
    return F.coalesce(c.rlike(RFC3339) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def bare_url(c: Column) -> Column:
    """Scheme, lower-case host, port and path of an http(s) URL; user, query and fragment go; null if it is none."""
    scheme, host, port, path = (F.regexp_extract(c, r"\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?", i) for i in range(1, 5))
    return F.when(host != "", F.concat(scheme, F.lit("://"), F.lower(host), port, path))


def namespace(named: Column, uri: Column) -> Column:
    """The object's namespace, or else the one in the request's path."""
    return falsy(named, F.regexp_extract(uri, r"/namespaces/([^/?]*)", 1))


def redacted(c: Column) -> Column:
    """E-mail addresses, bearer tokens and absolute home paths replaced by marks."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    c = F.regexp_replace(c, r"Bearer [A-Za-z0-9._~+/=-]+", "Bearer [token]")
    return F.regexp_replace(c, r"/(Users|home)/[A-Za-z0-9._-]+", "/[home]")
