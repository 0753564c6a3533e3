"""URL functions. Columns wherever the common form of a URL allows, a vectorised UDF for all other forms.

A URL that cannot be parsed gives null, never an error.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qsl, quote, quote_plus, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import js_trim

#: Query parameters that do not change a page (fixed values).
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid",
    "ref", "mc_cid", "mc_eid", "_ga", "_gl", "gad_source", "campaignid", "adgroupid",
)

#: Hosts whose links are utilities (fixed values).
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "linkedin.com", "tiktok.com", "pinterest.com", "maps.google.com", "goo.gl/maps", "yelp.com")
UTILITY_SCHEMES = ("tel:", "mailto:", "sms:", "whatsapp:")

_DEFAULT_PORT = {"http": "80", "https": "443"}
_PARTS = re.compile(r"^(https?):[/\\]*(?:([^/\\?#]*)@)?([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", re.S | re.I)
_BAD_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_JS_SPACE = " \t\n\r\x0b\x0c                 　﻿"


# ---- the general parser


def _host(text: str) -> str | None:
    host = unquote(text).lower()
    if host.startswith("[") and host.endswith("]"):
        return host if re.fullmatch(r"\[[0-9a-f:.]+\]", host) else None
    if not host.isascii():
        try:
            host = ".".join(label.encode("idna").decode() if not label.isascii() else label for label in host.split("."))
        except UnicodeError:
            return None
    if not host or _BAD_HOST.search(host):
        return None
    last = host.rstrip(".").rpartition(".")[2]
    if last.isdigit() and not re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", host):
        return None
    return host


def _path(text: str) -> str:
    out: list[str] = []
    segments = text.replace("\\", "/").split("/")[1:] or [""]
    for k, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        last = k == len(segments) - 1
        if dots == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif dots == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/" + quote("/".join(out), safe="/!$%&'()*+,-.:;=@_~|[]^")


def split_url(url: str) -> tuple[str, str, str, str, str, str | None] | None:
    """(scheme, user, host, port, path, query) of an http or https URL, serialised as a browser would."""
    m = _PARTS.match("".join(c for c in url.strip(_JS_SPACE) if c not in "\t\n\r"))
    if not m:
        return None
    scheme, (place, _, port) = m[1].lower(), m[3].rpartition(":") if re.search(r":\d*$", m[3]) else (m[3], "", "")
    host = _host(place)
    if host is None or (port and int(port) > 65535):
        return None
    port = str(int(port)) if port else ""
    return scheme, quote(m[2] or "", safe="%:!$&'()*+,-.;=_~"), host, "" if port == _DEFAULT_PORT[scheme] else port, _path(m[4] or "/"), m[5]


def join_url(scheme: str, user: str, host: str, port: str, path: str, query: str | None) -> str:
    return f"{scheme}://{user + '@' if user else ''}{host}{':' + port if port else ''}{path}{'?' + query if query else ''}"


def _order(key: str) -> tuple:
    """Alphabetical order as people sort: signs, digits, letters; accents and case only decide between equals."""
    plain = "".join(c for c in unicodedata.normalize("NFD", key) if not unicodedata.combining(c))
    weight = tuple((2 if c.isalpha() else 1 if c.isdigit() else 0, c.lower()) for c in plain)
    return weight, key.casefold(), tuple(c.isupper() for c in plain)


def normalize_one(url: str | None) -> str | None:
    if not url:
        return None
    text = url.strip(_JS_SPACE)
    if not re.match(r"https?://", text, re.I):
        text = "https://" + text
    parts = split_url(text)
    if parts is None:
        return None
    scheme, user, host, port, path, query = parts
    pairs = [(k, v) for k, v in parse_qsl(query or "", keep_blank_values=True) if k not in TRACKING_PARAMETERS]
    pairs.sort(key=lambda p: _order(p[0]))
    query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs)
    if path != "/" and path.endswith("/"):
        path = path[:-1]
    return join_url(scheme, user, host, port, path, query)


def resolve_one(reference: str | None, base: str | None, origin_only: bool = False) -> str | None:
    """reference resolved against base (its origin only, if so asked); other schemes as they are, null if base is none."""
    if reference is None or not base:
        return None
    text = reference.strip(_JS_SPACE)
    if re.match(r"https?:[/\\]{2}", text, re.I):
        parts = split_url(text)
    elif re.match(r"[a-z][a-z0-9+.-]*:", text, re.I):
        return text
    else:
        root = split_url(base)
        if root is None:
            return None
        scheme, user, host, port, path, query = root
        if origin_only:
            path, query = "/", None
        if text.replace("\\", "/").startswith("//"):
            parts = split_url(scheme + ":" + text)
        elif not text or text.startswith("#"):
            parts = root if not origin_only else (scheme, user, host, port, path, query)
        else:
            target, _, _ = text.partition("#")
            target, mark, q = target.partition("?")
            target = target.replace("\\", "/")
            if target.startswith("/"):
                path = target
            elif target:
                path = path[: path.rfind("/") + 1] + target
            parts = (scheme, user, host, port, _path(path), q if mark else (query if not target else None))
    if parts is None:
        return None
    _, mark, fragment = text.partition("#")
    scheme, user, host, port, path, query = parts
    return join_url(scheme, user, host, port, path, query and quote(query, safe="%!$&'()*+,-./:;=?@_~|[]^`{}\\")) + (f"#{fragment}" if fragment else "")


def normalize_link(url: str, origin: str) -> str:
    """A link as navigation stores it: phone and mail links as they are, others normalised against the origin."""
    if url.startswith(("tel:", "mailto:")):
        return url
    absolute = url if url.startswith("http") else resolve_one(url, origin, origin_only=True)
    if absolute is None or not re.match(r"https?:", absolute, re.I):
        return url
    return normalize_one(absolute) or url


def is_external(url: str, origin: str) -> bool:
    if not url or url.startswith(("#", "javascript:", "tel:", "mailto:")):
        return False
    base = split_url(origin)
    if base is None:
        return False
    absolute = resolve_one(url, origin)
    if absolute is None:
        return False
    parts = split_url(absolute)
    return parts is None or parts[2] != base[2]


def is_utility(url: str, compat: bool = False) -> bool:
    """Phone, mail and chat links, and links to social hosts (compat: that contain a social host's name anywhere)."""
    low = url.lower()
    if low.startswith(UTILITY_SCHEMES):
        return True
    if compat:
        return any(h in low for h in SOCIAL_HOSTS)
    m = re.match(r"https?://([^/?#:]+)(/[^?#]*)?", low)
    place = (m[1] + (m[2] or "")) if m else ""
    return any(place == h or place.startswith(h + "/") or m and (m[1] == h or m[1].endswith("." + h)) for h in SOCIAL_HOSTS) if m else False


@F.pandas_udf(StringType())
def _normalize_slow(url: pd.Series) -> pd.Series:
    return url.map(normalize_one, na_action="ignore")


@F.pandas_udf(StringType())
def _resolve_slow(reference: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(r, b) for r, b in zip(reference, base)])


# ---- columns

_COMMON = r"^(?i:https?)://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*(:[0-9]{1,4})?(/[A-Za-z0-9._~/-]*)?(\?[A-Za-z0-9._=&-]*)?(#.*)?$"
_UNCOMMON = r"(?i)/\.{1,2}(/|$|\?|#)|xn--"


def _with_scheme(url: Column) -> Column:
    return F.regexp_replace(js_trim(url), "^(?!(?i:https?)://)", "https://")


def _pairs(text: Column) -> Column:
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    named = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    return F.filter(named, lambda p: ~p["k"].isin(*TRACKING_PARAMETERS))


def normalize_url(url: Column) -> Column:
    """Identity of a page: scheme added, host lowered, default port and fragment dropped, tracking parameters
    dropped, the others sorted by name (equal names keep their order), one slash at the end dropped.

    The expression names its parts as seldom as it can: it is often nested, and plans copy what they inline.
    """
    text = _with_scheme(url)
    pairs = _pairs(text)
    plain = F.forall(pairs, lambda p: (p["k"] != "") & ~p["v"].contains("="))
    common = text.rlike(_COMMON) & ~text.rlike(_UNCOMMON) & plain & ((F.size(pairs) <= 1) | F.forall(pairs, lambda p: p["k"].rlike("^[a-z0-9]+$")))
    place = F.lower(F.regexp_extract(text, r"^([^:]+://[^/?#]*)", 1))
    place = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, "^(https://.*):0*443$", "$1"), "^(http://.*):0*80$", "$1"), ":0+([0-9]+)$", ":$1")
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:]+://[^/?#]*/([^?#]*)", 1), "/$", "")
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    query = F.array_join(F.transform(F.array_sort(numbered), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    fast = F.regexp_replace(F.concat(place, F.lit("/"), path, F.lit("?"), query), r"\?$", "")
    # the function gets nothing to do where the columns suffice
    return F.when(common, fast).otherwise(_normalize_slow(F.when(~common, url)))


def normalize_url_with(url: Column, enforce_https: bool = False, slash: str = "never") -> Column:
    """normalize_url with a policy: http raised to https; a slash at the path's end "never", "always" (unless the last
    segment looks like a file) or "preserve"d as given."""
    if slash not in ("never", "always", "preserve"):
        raise ValueError("slash is never, always or preserve")
    out = normalize_url(url)
    if enforce_https:
        out = F.regexp_replace(F.regexp_replace(out, "^http:", "https:"), "^(https://[^/?#]*?):80(?=[/?#]|$)", "$1")
    if slash != "never":
        path = F.regexp_extract(out, r"^https?://[^/?#]*([^?#]*)", 1)
        wanted = ~path.endswith("/") & ~F.element_at(F.split(path, "/"), -1).contains(".") if slash == "always" else ~path.endswith("/") & js_trim(url).rlike(r"^[^?#]*[^/?#:]/+(?:[?#]|$)")
        out = F.when(wanted, F.regexp_replace(out, r"^(https?://[^?#]*)", "$1/")).otherwise(out)
    return out


def domain(url: Column) -> Column:
    """Host name of the URL's identity, without port."""
    return F.regexp_extract(normalize_url(url), r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)


def raw_domain(url: Column) -> Column:
    """What stands between :// and the next slash, port and user included."""
    return F.substring_index(F.substring_index(url, "://", -1), "/", 1)


def is_valid_url(url: Column) -> Column:
    return normalize_url(url).isNotNull()


def url_path(url: Column) -> Column:
    return F.regexp_extract(normalize_url(url), r"^https?://[^/?#]*(/[^?#]*)", 1)


def same_url(a: Column, b: Column) -> Column:
    return F.coalesce(normalize_url(a) == normalize_url(b), F.lit(False))


def resolve_url(reference: Column, base: Column) -> Column:
    return normalize_url(_resolve_slow(reference, base))


def absolute_url(reference: Column, base: Column) -> Column:
    """reference made absolute, as it is where that fails."""
    return F.coalesce(_resolve_slow(reference, base), reference)


def is_external_link(url: Column, base: Column) -> Column:
    """Does a link leave the base's host? Anchors, scripts, phone and mail links do not."""
    inner = (url == "") | url.rlike("^(#|javascript:|tel:|mailto:)")
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1))
    own, target = host(base), F.when(url.rlike("^//"), host(F.concat(F.lit("https:"), url))).when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), host(url))
    return F.coalesce(~inner & (own != "") & target.isNotNull() & (target != own), F.lit(False))


def is_utility_link(url: Column, compat: bool = False) -> Column:
    """Phone, mail and chat links and links to social hosts; compat takes any URL that contains a social host's name."""
    low = F.lower(url)
    schemes = low.rlike("^(" + "|".join(UTILITY_SCHEMES) + ")")
    if compat:
        return schemes | low.rlike("|".join(re.escape(h) for h in SOCIAL_HOSTS))
    hosts, places = [h for h in SOCIAL_HOSTS if "/" not in h], [h for h in SOCIAL_HOSTS if "/" in h]
    named = "|".join(re.escape(h) for h in hosts)
    return schemes | low.rlike(rf"^https?://([^/?#]*\.)?({named})(:[0-9]+)?([/?#]|$)") | low.rlike(rf"^https?://({'|'.join(re.escape(p) for p in places)})(/|$)")


def sitemap_type_hint(sitemap: Column) -> Column:
    """Kind of pages that a sitemap's file name announces, null if none; the first rule counts."""
    name = F.lower(F.element_at(F.split(sitemap, "/"), -1))
    return (
        F.when(name.rlike("^post-sitemap"), "post")
        .when(name.rlike("^page-sitemap"), "page")
        .when(name.rlike("^(post_)?(category|tag|author)-sitemap"), "pagination")
        .when(name.rlike("^sitemap-posts"), "post")
        .when(name.rlike("^sitemap-pages"), "page")
        .when(name.rlike("^sitemap-(categories|tags)"), "pagination")
        .when(name.rlike("blog|article|news"), "post")
        .when(name.contains("product"), "product")
        .when(name.contains("event"), "event")
        .when(name.contains("portfolio"), "portfolio")
    )


def is_sitemap_url(url: Column) -> Column:
    low = F.lower(url)
    return is_valid_url(url) & (low.endswith(".xml") | low.contains("sitemap"))


def url_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(url_path(url), "/"), lambda s: s != ""))


def page_kind(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("/blog/"), "blog")
        .when(low.contains("/product/"), "product")
        .when(low.contains("/category/"), "category")
        .when(url_path(url) == "/", "homepage")
        .otherwise("page")
    )


def url_language(url: Column, languages: tuple[str, ...] = ("es", "fr", "de", "it", "pt", "ja", "zh"), default: str = "en") -> Column:
    out = None
    for code in languages:
        test = url.contains(f"/{code}/")
        out = F.when(test, code) if out is None else out.when(test, code)
    return out.otherwise(default)


def page_language(url: Column, html: Column, default: str = "en") -> Column:
    """Language by the URL's folder, else the lang attribute, else the content-language meta element; primary part only."""
    found = lambda c: F.nullif(F.lower(c), F.lit(""))
    by_url = found(F.regexp_extract(url, r"/(es|fr|de|it|pt|ja|zh)(?:/|$)", 1))
    by_tag = found(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    by_meta = found(F.regexp_extract(html, r"""(?i)<meta[^>]*http-equiv\s*=\s*["']?content-language["']?[^>]*content\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.coalesce(by_url, by_tag, by_meta, F.lit(default))


def url_hash(url: Column) -> Column:
    """MD5 of the lower-cased URL without one slash at its end."""
    return F.md5(F.regexp_replace(F.lower(js_trim(url)), "/$", ""))


def was_redirected(requested: Column, final: Column) -> Column:
    """Is the page another one than was asked for? Null URLs are no other's equal."""
    return ~same_url(requested, final)


def matches_policy(url: Column, include: list[str], exclude: list[str]) -> Column:
    """URL policy: some include pattern (if there are any) and no exclude pattern."""
    ok = F.lit(True)
    if include:
        ok = F.lit(False)
        for p in include:
            ok = ok | url.rlike(p)
    for p in exclude:
        ok = ok & ~url.rlike(p)
    return ok
