"""URL parts and reference resolution as column expressions.

Anchored regexes instead of ``parse_url``: ``parse_url`` returns null for URLs
with spaces or non-ASCII characters, which real hrefs contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
HOST_RE = r"^(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"
SUFFIX_RE = r"^[^?#]*(.*)$"          # "?query#fragment" part, verbatim
NO_FRAGMENT_RE = r"^([^#]*)"
ANY_AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
HOST_PORT_RE = r"""^(?:[^@]*@)?(?:\[[^\]]*\]|[^: "<>\\^`{|}\[\]]*)(?::[0-9]*)?$"""
# Characters that a path or fragment keeps as they are when written out.
KEPT_RE = r"^[A-Za-z0-9\-._~$&+,/:;=@!'()*\[\]%?#]*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.regexp_extract(_col(url), SCHEME_RE, 1)


def authority(url) -> Column:
    return F.regexp_extract(_col(url), AUTHORITY_RE, 1)


def hostname(url) -> Column:
    """Host without userinfo, port or IPv6 brackets (case kept)."""
    h = F.regexp_extract(authority(url), HOST_RE, 1)
    return F.regexp_replace(h, r"^\[|\]$", "")


def path(url) -> Column:
    return F.regexp_extract(_col(url), PATH_RE, 1)


def raw_query(url) -> Column:
    return F.regexp_extract(_col(url), QUERY_RE, 1)


def decoded_path(url) -> Column:
    """The path with percent escapes decoded (a ``+`` stays); as it is if they are bad."""
    p = path(url)
    decoded = F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(p, F.lit("%")), F.coalesce(decoded, p)).otherwise(p)


def robots_path(url) -> Column:
    """The decoded path plus ``?query`` when the query is non-empty (robots key)."""
    q = raw_query(url)
    return F.when(q != F.lit(""), F.concat(decoded_path(url), F.lit("?"), q)).otherwise(decoded_path(url))


def is_valid(url) -> Column:
    """Whether a URL or reference parses: no control characters, whole percent escapes
    outside the query, no empty scheme, no colon in the first segment of a relative
    path, and a host and port of legal characters."""
    u = _col(url)
    no_query = F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"(#.*)$", 1))
    broken = F.contains(F.regexp_replace(no_query, "%[0-9A-Fa-f]{2}", ""), F.lit("%"))
    relative = ~F.regexp_like(u, F.lit(SCHEME_RE))
    colon = relative & F.regexp_like(u, F.lit(r"^[^/?#:]*:"))
    host = F.regexp_extract(u, ANY_AUTHORITY_RE, 1)
    return (~F.regexp_like(u, F.lit(r"[\x00-\x1f\x7f]")) & ~broken & ~colon
            & F.regexp_like(host, F.lit(HOST_PORT_RE)))


def remove_dot_segments(p) -> Column:
    """RFC 3986 5.2.4 on an absolute path, folding over its segments."""
    p = _col(p)
    segs = F.split(F.regexp_replace(p, "^/", ""), "/")
    folded = F.aggregate(
        segs, F.lit(""),
        lambda acc, s: F.when(s == F.lit("."), acc)
        .when(s == F.lit(".."), F.regexp_replace(acc, r"/[^/]*$", ""))
        .otherwise(F.concat(acc, F.lit("/"), s)))
    last = F.element_at(segs, -1)
    slash_end = last.isin(".", "..") & ~folded.endswith("/")
    out = F.when(slash_end, F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(out == F.lit(""), F.lit("/")).otherwise(out)


def _merge(base, ref_path) -> Column:
    bp = path(base)
    dir_ = F.when(bp == F.lit(""), F.lit("/")).otherwise(F.regexp_extract(bp, r"^(.*/)", 1))
    return F.concat(F.when(dir_ == F.lit(""), F.lit("/")).otherwise(dir_), ref_path)


def resolve(base, href) -> Column:
    """Resolve ``href`` against ``base``.

    An href starting with ``http`` is returned verbatim (even ``httpfoo``); other
    absolute hrefs (``mailto:``) are returned as they are; otherwise RFC 3986
    resolution, with path and fragment percent-encoded. Null when the base has no
    scheme and authority, or when base or href does not parse.
    """
    base, href = _col(base), _col(href)
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    base_nofrag = F.regexp_extract(base, NO_FRAGMENT_RE, 1)
    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    ref_suffix = F.regexp_extract(href, SUFFIX_RE, 1)
    query = F.regexp_extract(ref_suffix, r"^([^#]*)", 1)
    suffix = F.concat(query, encode(F.regexp_extract(ref_suffix, r"(#.*)$", 1)))
    resolved = (
        F.when(href.startswith("http"), href)
        .when(F.regexp_like(href, F.lit(SCHEME_RE)), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), encode(ref_path), suffix))
        .when(href == F.lit(""), base_nofrag)
        .when(href.startswith("#"), F.concat(base_nofrag, suffix))
        .when(href.startswith("?"), F.concat(origin, encode(path(base)), suffix))
        .when(href.startswith("/"), F.concat(origin, encode(remove_dot_segments(ref_path)), suffix))
        .otherwise(F.concat(origin, encode(remove_dot_segments(_merge(base, ref_path))), suffix)))
    valid = (scheme(base) != F.lit("")) & (authority(base) != F.lit("")) & is_valid(base) & is_valid(href)
    return F.when(valid | href.startswith("http"), resolved)


def encode(part) -> Column:
    """Percent-encode what a path or fragment may not hold (UTF-8, upper-case hex)."""
    u = _col(part)
    enc = F.array_join(F.transform(F.split(u, ""), lambda c: F.when(
        ~F.regexp_like(c, F.lit(KEPT_RE)),
        F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(F.regexp_like(u, F.lit(KEPT_RE)), u).otherwise(enc)


def encode_non_ascii(url) -> Column:
    """Percent-encode non-ASCII characters and spaces (UTF-8, upper-case hex)."""
    u = _col(url)
    chars = F.split(u, "")
    enc = F.concat_ws("", F.transform(chars, lambda c: F.when(
        (F.ascii(c) >= 128) | (c == F.lit(" ")),
        F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)))
    return F.when(F.regexp_like(u, F.lit(r"[^!-~]")), enc).otherwise(u)
