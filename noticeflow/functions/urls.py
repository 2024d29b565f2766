"""URL functions as native column expressions.

``parse_url`` yields null on spaces, pipes and non-ASCII paths, so URLs are split
with the generic-syntax pattern of RFC 3986.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeflow.functions.staging import stage
from noticeflow.functions.text import NON_ASCII, let
from noticeflow.lexicon import (
    AUDIT_DOCUMENT_SUFFIXES,
    LINK_DOCUMENT_SUFFIXES,
    TRACKING_PARAMS,
    TRACKING_PREFIXES,
)

_GENERIC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
_RELATIVE_SCHEMES = ("http", "https", "ftp", "file")


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{_SPACE}+|{_SPACE}+$", "")


class UrlParts(NamedTuple):
    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column


def _tidy(url: Column) -> Column:
    """Drop what every URL reader drops: leading controls, embedded line breaks."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url: Column) -> UrlParts:
    """Parts as separate expressions; for several uses bind them with ``with_parts``."""
    part = [F.regexp_extract(_tidy(url), _GENERIC, i) for i in range(1, 6)]
    return UrlParts(F.lower(part[0]), *part[1:])


def with_parts(url: Column, body) -> Column:
    """``body(UrlParts)`` with the split done once per row."""
    parts = let(_tidy(url), lambda u: F.struct(
        F.lower(F.regexp_extract(u, _GENERIC, 1)).alias("scheme"),
        *[F.regexp_extract(u, _GENERIC, i).alias(n) for i, n in enumerate(UrlParts._fields[1:], 2)],
    ))
    return let(parts, lambda p: body(UrlParts(*[p[n] for n in UrlParts._fields])))


_PARAMS = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def join_url(parts: UrlParts) -> Column:
    def tail(mark: str, value: Column) -> Column:
        return let(value, lambda v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise(""))

    def build(p: Column) -> Column:
        rooted = (p["netloc"] != "") & (p["path"] != "") & ~p["path"].startswith("/")
        return F.concat(
            F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
            F.when(p["netloc"] != "", F.concat(F.lit("//"), p["netloc"])).otherwise(""),
            F.when(rooted, F.lit("/")).otherwise(""),
            p["path"],
        )

    head = F.struct(*[getattr(parts, n).alias(n) for n in ("scheme", "netloc", "path")])
    return F.concat(let(head, build), tail("?", parts.query), tail("#", parts.fragment))


def _remove_dots(path: Column, squeeze: Column) -> Column:
    """Resolve ``.`` and ``..``; ``squeeze`` also drops empty inner segments."""

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    def fold(segments: Column) -> Column:
        last = F.size(segments) - 1
        kept = F.filter(segments, lambda s, i: ~squeeze | (s != "") | (i == 0) | (i == last))
        resolved = F.aggregate(kept, F.array().cast("array<string>"), step)
        closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
        return F.array_join(F.concat(resolved, F.coalesce(closing, F.array().cast("array<string>"))), "/")

    return let(let(F.split(path, "/"), fold), lambda t: F.when(t == "", F.lit("/")).otherwise(t))


def resolve_url(base: Column, url: Column) -> Column:
    """Resolve a possibly relative reference against its page address."""

    def both(home: UrlParts, ref: UrlParts) -> Column:
        scheme = F.when(ref.scheme == "", home.scheme).otherwise(ref.scheme)
        relative = ((ref.scheme == "") | (ref.scheme == home.scheme)) & home.scheme.isin(
            *_RELATIVE_SCHEMES
        )
        bare = F.regexp_replace(ref.path, r"(?s);[^/]*$", "")
        params = F.regexp_extract(ref.path, r"(?s)(;[^/]+)$", 1)
        merged = F.when(bare.startswith("/"), bare).otherwise(
            F.concat(F.regexp_extract(home.path, r"(?s)^(.*/)?", 1), bare)
        )
        # Only paths with dots or doubled slashes pay for the segment fold.
        relative_path = ~ref.path.startswith("/")
        path = let(
            merged,
            lambda m: F.when(
                m.rlike(r"(^|/)\.{1,2}(/|$)|//"), _remove_dots(m, relative_path)
            ).otherwise(m),
        )
        no_path = ref.path.isin("", ";")
        own = (ref.netloc != "") | ~no_path
        joined = join_url(UrlParts(
            scheme,
            F.when(ref.netloc != "", ref.netloc).otherwise(home.netloc),
            F.when(ref.netloc != "", ref.path).when(no_path, home.path).otherwise(
                F.concat(path, params)
            ),
            F.when(~own & (ref.query == ""), home.query).otherwise(ref.query),
            ref.fragment,
        ))
        return F.when(relative, joined).otherwise(url)

    resolved = with_parts(base, lambda home: with_parts(url, lambda ref: both(home, ref)))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", url).when(url == "", base).otherwise(resolved)
    )


def unquote(text: Column) -> Column:
    """Percent-decode; stray percent signs and plus signs stay."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), decoded).otherwise(text)


def unquote_plus(text: Column) -> Column:
    return unquote(F.replace(text, F.lit("+"), F.lit(" ")))


def quote_plus(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array<struct<k, v>> of the decoded parameters, blanks kept."""
    fields = F.filter(F.split(query, "&"), lambda f: f != "")
    return F.transform(
        fields,
        lambda f: F.struct(
            unquote_plus(F.substring_index(f, "=", 1)).alias("k"),
            unquote_plus(
                F.when(f.contains("="), F.substr(f, F.instr(f, "=") + 1)).otherwise("")
            ).alias("v"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))),
        "&",
    )


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """Stable form of a crawled link for duplicate detection.

    Resolved, lower-case authority without default port, no trailing slash, no
    fragment, tracking parameters dropped and the others sorted.
    """
    text = _strip(F.coalesce(url, F.lit("")))

    def tracked(key: Column) -> Column:
        low = F.lower(key)
        test = low.isin(*TRACKING_PARAMS)
        for prefix in TRACKING_PREFIXES:
            test = test | low.startswith(prefix)
        return test

    def rebuild(parts: UrlParts) -> Column:
        host = F.lower(parts.netloc)
        host = F.when(parts.scheme == "http", F.regexp_replace(host, r":80$", "")).when(
            parts.scheme == "https", F.regexp_replace(host, r":443$", "")
        ).otherwise(host)
        bare = F.regexp_extract(parts.path, _PARAMS, 1)
        params = F.regexp_extract(parts.path, _PARAMS, 2)
        path = F.concat(
            F.when(bare == "", F.lit("/"))
            .when(F.length(bare) > 1, F.regexp_replace(bare, "/+$", ""))
            .otherwise(bare),
            F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        )
        kept = F.array_sort(F.filter(query_pairs(parts.query), lambda p: ~tracked(p["k"])))
        query = F.when(parts.query == "", "").otherwise(encode_pairs(kept))
        return join_url(UrlParts(parts.scheme, host, path, query, F.lit("")))

    def canonical(t: Column) -> Column:
        target = resolve_url(base, t) if base is not None else t
        return F.when(t == "", "").otherwise(with_parts(target, rebuild))

    return let(text, canonical)


def _idna(host: str | None) -> str | None:
    if host is None:
        return None
    try:
        return host.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None


@F.pandas_udf(T.StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """ASCII form of an international host name; null when it has none."""
    return hosts.map(_idna)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _idna_hosts(rows: pd.Series) -> pd.Series:
    """ASCII forms of lists of host names; each distinct name of a batch is converted once."""
    forms = {h: _idna(h) for h in {h for row in rows if row is not None for h in row}}
    return rows.map(lambda row: None if row is None else [forms[h] for h in row])


def with_host_forms(df: DataFrame, links: Column, name: str = "_hosts") -> DataFrame:
    """Add a dictionary of the international hosts in ``links``, an array of URLs.

    A map from host to ASCII form, null in rows without such a host and for a host that has
    none. One Arrow column serves all URLs of a row, also those inside lists; rows without
    international hosts send a null. Read it with ``host_form``.
    """
    foreign = F.array_distinct(F.filter(F.transform(links, lambda u: host_of(_strip(u))), lambda h: h.rlike(NON_ASCII)))
    found = stage(df, **{name: F.when(F.size(foreign) > 0, foreign)})
    return stage(found, **{name: F.map_from_arrays(name, _idna_hosts(name))})


def host_form(name: str = "_hosts"):
    """The ``idna`` argument of ``catalog_url`` for rows that hold a host dictionary."""
    return lambda host: F.try_element_at(F.col(name), host)


class Authority(NamedTuple):
    user: Column
    host: Column
    port: Column


def split_authority(netloc: Column) -> Authority:
    """User part (null when absent), lower-case host without brackets, port text."""
    has_user = netloc.contains("@")
    hostport = F.regexp_extract(netloc, r"(?s)^(?:.*@)?(.*)$", 1)
    pattern = r"(?s)^(\[[^\]]*\]|[^:]*)(?::(.*))?$"
    host = F.lower(F.regexp_replace(F.regexp_extract(hostport, pattern, 1), r"[\[\]]", ""))
    return Authority(
        F.when(has_user, F.regexp_extract(netloc, r"(?s)^(.*)@", 1)),
        host,
        F.regexp_extract(hostport, pattern, 2),
    )


def with_authority(netloc: Column, body) -> Column:
    auth = split_authority(netloc)
    bound = F.struct(*[getattr(auth, n).alias(n) for n in Authority._fields])
    return let(bound, lambda a: body(Authority(*[a[n] for n in Authority._fields])))


def host_of(url: Column) -> Column:
    return split_authority(split_url(url).netloc).host


def bad_port(port: Column) -> Column:
    return (port != "") & (~port.rlike("^[0-9]{1,9}$") | (port.try_cast("int") > 65535))


def catalog_url(url: Column, idna=idna_host) -> Column:
    """struct<url, error>: strict registry form, or the reason there is none.

    ``idna`` gives the ASCII form of an international host, by default in an Arrow column.
    Inside lambdas, where no such column can stand, pass ``host_form()`` of a dictionary.
    """
    raw = _strip(F.coalesce(url, F.lit("")))

    def checked(t: Column, parts: UrlParts, host: Column, auth: Authority) -> Column:
        port = auth.port.try_cast("int")
        standard = ((parts.scheme == "http") & (port == 80)) | ((parts.scheme == "https") & (port == 443))
        error = (
            F.when(t == "", F.lit("empty"))
            .when(t.rlike(_SPACE), F.lit("whitespace"))
            .when(bad_port(auth.port), F.lit("port"))
            .when(~parts.scheme.isin("http", "https"), F.lit("scheme"))
            .when(auth.host == "", F.lit("no_host"))
            .when(auth.user.isNotNull(), F.lit("credentials"))
            .when(host.isNull(), F.lit("host"))
        )
        shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
        netloc = F.when((auth.port == "") | F.coalesce(standard, F.lit(False)), shown).otherwise(
            F.concat(shown, F.lit(":"), port.cast("string"))
        )
        path = F.regexp_replace(parts.path, "/+$", "")
        clean = join_url(UrlParts(parts.scheme, netloc, path, parts.query, F.lit("")))
        return let(error, lambda e: F.struct(F.when(e.isNull(), clean).alias("url"), e.alias("error")))

    host = host_of(raw)
    foreign = host.rlike(NON_ASCII)
    # Only foreign hosts reach Python; the others cross as nulls.
    ascii_host = F.coalesce(F.when(~foreign, host), idna(F.when(foreign, host)))
    bound = F.struct(raw.alias("t"), ascii_host.alias("host"))
    return let(bound, lambda b: with_parts(b["t"], lambda p: with_authority(
        p.netloc, lambda auth: checked(b["t"], p, b["host"], auth))))


def fingerprint(institution_id: Column, title: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", institution_id.cast("string"), title, url), 256)


# Second-level public suffixes under .br.
_BR_SECOND_LEVEL = ("com", "edu", "gov", "org", "net", "mil")


def domain_family(host: Column) -> Column:
    """Registrable domain of a host; null for an empty host."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), r"\.")
    size = F.size(labels)
    br = (F.element_at(labels, -1) == "br") & F.try_element_at(labels, F.lit(-2)).isin(*_BR_SECOND_LEVEL)
    keep = F.when(size <= 2, size).when(br, 3).otherwise(2)
    family = F.array_join(F.slice(labels, size - keep + 1, keep), ".")
    return F.when(F.coalesce(host, F.lit("")) == "", None).otherwise(family)


def is_http(url: Column) -> Column:
    """Scheme http or https and a non-empty authority."""
    return _tidy(url).rlike(r"^(?i:https?)://[^/?#]")


def is_document_url(url: Column, suffixes=LINK_DOCUMENT_SUFFIXES) -> Column:
    return F.lower(split_url(url).path).rlike(r"\.(" + "|".join(suffixes) + r")$")


def is_audit_document(url: Column, suffixes=AUDIT_DOCUMENT_SUFFIXES) -> Column:
    """Audit variant: decoded path, trailing slashes ignored."""
    path = F.regexp_replace(F.lower(unquote(split_url(url).path)), "/+$", "")
    return path.rlike(r"\.(" + "|".join(suffixes) + r")$")


def site_base(url: Column) -> Column:
    return with_parts(url, lambda p: F.concat(p.scheme, F.lit("://"), p.netloc, F.lit("/")))


def listing_url(url: Column) -> Column:
    """Address without fragment and path parameters."""
    return with_parts(url, lambda p: join_url(UrlParts(
        p.scheme, p.netloc, F.regexp_extract(p.path, _PARAMS, 1), p.query, F.lit("")
    )))


def dedupe_url(url: Column, token: Column) -> Column:
    """Listing address whose ``id`` parameter is the stable token of one process."""
    return tagged_listing(listing_url(url), token)


def tagged_listing(listing: Column, token: Column) -> Column:
    """``dedupe_url`` of an address that is a listing address already."""

    def tagged(p: UrlParts) -> Column:
        kept = F.filter(query_pairs(p.query), lambda q: ~F.lower(q["k"]).isin("id", "processo_id"))
        pairs = F.concat(kept, F.array(F.struct(F.lit("id").alias("k"), token.alias("v"))))
        return join_url(UrlParts(p.scheme, p.netloc, p.path, encode_pairs(pairs), F.lit("")))

    return with_parts(listing, tagged)
