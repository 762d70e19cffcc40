"""URL functions as Column expressions (usable at top level and inside lambdas)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

URL_REGEX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# File suffixes that are never followed.
SKIP_EXT_REGEX = (
    r"(?i)\.(pdf|jpe?g|png|gif|webp|svg|ico|css|js|zip|gz|mp4|mp3|woff2?|ttf|"
    r"eot|xml|json|csv|doc|docx|xls|xlsx|ppt|pptx)\n?\z"
)

_C0_AND_SPACE = "".join(map(chr, range(0x21)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_REGEX, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 5)


def split(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


def has_web_scheme(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def defrag(url: Column) -> Column:
    """Drop the fragment; a URL that has one is re-assembled from its parts."""
    empty = F.lit("")
    return F.when(
        url.contains("#"),
        let(split(_clean(url)), lambda u: _unsplit(u.scheme, u.netloc, u.path, u.query, empty)),
    ).otherwise(url)


def normalize(url: Column) -> Column:
    """Drop the fragment, then every trailing slash."""
    return F.rtrim(defrag(url), F.lit("/"))


def root_host(host: Column) -> Column:
    """Host without one leading ``www.``; case and port stay."""
    return F.regexp_replace(host, r"^(?i)www\.", "")


def site_of(url: Column) -> Column:
    """Root host of a URL, in one match."""
    return F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:www\.)?([^/?#]*)", 1)


def same_site(url: Column, site: Column) -> Column:
    """``site`` is a root host, see :func:`site_of`."""
    return site_of(url) == site


def has_skipped_extension(url: Column) -> Column:
    return path(url).rlike(SKIP_EXT_REGEX)


def xml_unescape(text: Column) -> Column:
    """One entity after the other, so ``&amp;lt;`` ends as ``<``."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _remove_dot_segments(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` over an array of path segments."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(seg == ".", kept)
        .otherwise(F.array_append(kept, seg)),
    )
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.array_append(resolved, F.lit(""))).otherwise(resolved)
    return F.array_join(closed, "/")


def _resolve_path(base_path: Column, ref_path: Column) -> Column:
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    has_dots = lambda p: p.rlike(r"(?:^|/)\.\.?(?:/|$)")

    def relative(joined: Column) -> Column:
        parts = F.split(joined, "/", -1)
        n = F.size(parts)
        inner = F.filter(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
        squeezed = F.when(n <= 1, parts).otherwise(
            F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1))
        )
        return let(
            squeezed,
            lambda p: F.when(
                F.exists(p, lambda s: s.isin(".", "..")), _remove_dot_segments(p)
            ).otherwise(F.array_join(p, "/")),
        )

    return (
        F.when(
            ref_path.startswith("/"),
            F.when(has_dots(ref_path), _remove_dot_segments(F.split(ref_path, "/", -1))).otherwise(ref_path),
        )
        .otherwise(relative(F.concat(folder, ref_path)))
    )


def _unsplit(sch: Column, host: Column, pth: Column, qry: Column, frag: Column) -> Column:
    rooted = F.when((pth != "") & ~pth.startswith("/"), F.concat(F.lit("/"), pth)).otherwise(pth)
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host, rooted)).otherwise(pth),
        F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )


def _clean(url: Column) -> Column:
    cleaned = F.translate(F.ltrim(url, F.lit(_C0_AND_SPACE)), "\t\r\n", "")
    return F.when(url.rlike(r"^[\x00-\x20]|[\t\r\n]"), cleaned).otherwise(url)


# References that need no re-assembly: absolute web URLs, and paths from the root without dot segments.
_PLAIN_ABSOLUTE = r"^https?://[^/?#\s]++(?:/[^?#\s]*+)?(?:\?[^#\s]++)?(?:#\S++)?\z"
_PLAIN_ROOTED = r"^/(?!/)(?:[^?#\s./]++|/(?!\.)|(?<!/)\.)*+(?:\?[^#\s]++)?(?:#\S++)?\z"


def join_parts(base: Column, base_parts: Column, ref: Column) -> Column:
    """Resolve ``ref`` against an already split base (see :func:`split`)."""

    def resolved(r: Column) -> Column:
        sch = F.when(r.scheme == "", base_parts.scheme).otherwise(r.scheme)
        has_path = r.path != ""
        return (
            F.when(
                (sch != base_parts.scheme) | ~sch.isin("http", "https", ""),
                ref,
            )
            .when(r.netloc != "", _unsplit(sch, r.netloc, r.path, r.query, r.fragment))
            .when(
                ~has_path,
                _unsplit(
                    sch,
                    base_parts.netloc,
                    base_parts.path,
                    F.when(r.query == "", base_parts.query).otherwise(r.query),
                    r.fragment,
                ),
            )
            .otherwise(
                let(
                    _resolve_path(base_parts.path, r.path),
                    lambda p: _unsplit(
                        sch,
                        base_parts.netloc,
                        F.when(p == "", F.lit("/")).otherwise(p),
                        r.query,
                        r.fragment,
                    ),
                )
            )
        )

    plain_base = base_parts.scheme.isin("http", "https") & (base_parts.netloc != "")
    return (
        F.when(base == "", ref)
        .when(ref == "", base)
        .when(ref.startswith("http") & ref.rlike(_PLAIN_ABSOLUTE), ref)
        .when(
            ref.startswith("/") & plain_base & ref.rlike(_PLAIN_ROOTED),
            F.concat(base_parts.scheme, F.lit("://"), base_parts.netloc, ref),
        )
        .otherwise(let(_clean(ref), lambda c: let(split(c), resolved)))
    )


def split_clean(url: Column) -> Column:
    """Parts of a base URL, for :func:`join_parts`."""
    return split(_clean(url))


def join(base: Column, ref: Column) -> Column:
    return let(split_clean(base), lambda parts: join_parts(base, parts, ref))
