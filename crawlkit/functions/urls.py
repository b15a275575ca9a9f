"""URL parsing, validation, resolution and content addressing.

The target behaviour is the WHATWG URL standard for http and https. Spark's own
``parse_url`` follows RFC 2396: it keeps host case and returns NULL for hosts with
an underscore and for URLs holding a space or a bar, so hosts are cut out by regex.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlkit.functions.bind import let

# URL grammar.
EDGE_OR_BREAK = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HTTP_AUTHORITY = r"(?is)^https?:[/\\]*([^/\\?#]*)"
HOST_IN_AUTHORITY = (
    r"(?is)^(?:.*@)?(\[[0-9a-f:.]+\]|[^:\x00-\x20#/<>?@\[\\\]^|\x7f]+)(?::[0-9]*)?$"
)
#: A host once its escapes are decoded.
DECODED_HOST = r"^(?:\[[0-9a-f:.]+\]|[^:\x00-\x20#/<>?@\[\\\]^|%\x7f]+)$"
PORT_IN_AUTHORITY = r":([0-9]+)$"
USERINFO_IN_AUTHORITY = r"(?s)^(.+@)"
NUMERIC_HOST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
DOTTED_QUAD = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
)
DOT_SEGMENT = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"
# Characters that stay as they are in each URL part; all others are percent-encoded.
PATH_SAFE = r"\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e"
QUERY_SAFE = r"\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e"
FRAGMENT_SAFE = r"\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e"
# A lower-case host name without port whose last label is not a number.
PLAIN_HOST = r"^https?://((?:[a-z0-9-]++\.)*+[a-z][a-z0-9-]*+)(?:[/?#]|$)"
# An absolute path without dot segments, query or anything to encode.
PLAIN_PATH = (
    r"^/(?![/\\])(?!(?:.*/)?(?:\.|%2[eE]){1,2}(?:/|$))"
    r"[\x21\x24-\x3b\x3d\x40-\x5b\x5d\x5f\x61-\x7a\x7c\x7e]*+$"
)
DEFAULT_PORT = {"http": 80, "https": 443}
MAX_PORT = 65535


def clean(url: Column) -> Column:
    """Drop surrounding control characters and spaces, and any tab or line break."""
    return F.regexp_replace(url, EDGE_OR_BREAK, "")


def _blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _sql_let(value: Column, body: str) -> Column:
    """``let`` with a body in SQL over ``h``: one call to build, however long it is."""
    return F.call_function("transform", F.array(value), F.expr(f"h -> {body}"))[0]


#: ``h`` without percent escapes; NULL where that leaves what no host may hold.
_DECODED = f"""CASE WHEN contains(h, '%') THEN
  transform(array(lower(try_url_decode(replace(h, '+', '%2B')))), t -> CASE WHEN t RLIKE r'{DECODED_HOST}' THEN t END)[0]
  ELSE h END"""

#: Value of one part of a numeric host: hexadecimal, octal or decimal; NULL if it is none or too long.
_IPV4_NUMBER = r"""CAST(CASE
  WHEN p RLIKE r'^0x0*[0-9a-f]{0,8}$' THEN conv(concat('0', regexp_replace(p, r'^0x0*', '')), 16, 10)
  WHEN p RLIKE r'^00*[0-7]{0,11}$' THEN conv(regexp_replace(p, r'^0+(?=.)', ''), 8, 10)
  WHEN p RLIKE r'^[1-9][0-9]{0,9}$' THEN p END AS BIGINT)"""

#: The address that the numbers ``n`` make: up to four, of which the last fills the bytes left.
_IPV4_VALUE = """CASE WHEN size(n) <= 4 AND forall(n, x -> x IS NOT NULL) AND forall(slice(n, 1, size(n) - 1), x -> x <= 255)
    AND element_at(n, -1) < element_at(array(4294967296L, 16777216L, 65536L, 256L), least(size(n), 4))
  THEN element_at(n, -1) + aggregate(reverse(slice(n, 1, size(n) - 1)), 0L, (total, x) -> total div 256 + x * 16777216L) END"""

_IPV4 = f"""transform(array(transform(split(regexp_replace(h, r'\\.$', ''), r'\\.', -1), p -> {_IPV4_NUMBER})), n ->
  transform(array({_IPV4_VALUE}), v -> CASE WHEN v IS NOT NULL THEN
    concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256) END)[0])[0]"""


def ipv4_host(host: Column) -> Column:
    """Dotted form of a host whose last label is a number (``127.1``, ``0x7f000001``, ``017700000001``); NULL if it is no address."""
    return _sql_let(host, _IPV4)


def authority_host(authority: Column) -> Column:
    """Lower-case host of ``user@host:port``; NULL if the authority does not parse.

    Percent escapes are decoded, and hosts that end in a number become dotted addresses.
    """

    def check(part):
        address = F.when(~part["host"].rlike(NUMERIC_HOST) | part["host"].rlike(DOTTED_QUAD), part["host"])
        port = part["port"].isNull() | (part["port"].try_cast("bigint") <= MAX_PORT)
        return F.when(port, F.coalesce(address, ipv4_host(part["host"])))

    port = _blank_to_null(F.regexp_extract(authority, PORT_IN_AUTHORITY, 1))
    host = _sql_let(_blank_to_null(F.lower(F.regexp_extract(authority, HOST_IN_AUTHORITY, 1))), _DECODED)
    return let(F.struct(host.alias("host"), port.alias("port")), check)


def url_host(url: Column) -> Column:
    """Host of an absolute http(s) URL: lower case, no port, no user info; else NULL.

    A plain lower-case host name, the common case, takes one regex.
    """

    def host(text):
        general = authority_host(F.regexp_extract(clean(text), HTTP_AUTHORITY, 1))
        return let(
            F.regexp_extract(text, PLAIN_HOST, 1),
            lambda plain: F.when(plain != "", plain).otherwise(general),
        )

    return let(url, host)


def valid_url(url: Column) -> Column:
    """True if ``url`` parses as an absolute URL.

    http and https need a good host; other schemes only need the scheme itself.
    """
    scheme = F.lower(F.regexp_extract(clean(url), SCHEME, 1))
    return F.coalesce(
        F.when(scheme.isin(*DEFAULT_PORT), url_host(url).isNotNull()).otherwise(scheme != ""),
        F.lit(False),
    )


def http_only(resolved: Column) -> Column:
    return F.coalesce(
        resolved.startswith("http://") | resolved.startswith("https://"), F.lit(False)
    )


def percent_encode(part: Column, safe: str) -> Column:
    """Percent-encode (UTF-8) everything outside ``safe``; existing escapes are kept."""

    def encode_run(run):
        encoded = F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))
        return F.when(run.rlike(f"^[^{safe}]"), encoded).otherwise(run)

    def encode(text):
        runs = F.regexp_extract_all(text, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
        return F.when(
            text.rlike(f"[^{safe}]"), F.array_join(F.transform(runs, encode_run), "")
        ).otherwise(text)

    return let(part, encode)


def remove_dot_segments(path: Column) -> Column:
    """Apply ``.`` and ``..`` in an absolute path; a final dot segment leaves a slash."""
    nothing = F.array().cast("array<string>")

    def dots(segment):
        return F.replace(F.lower(segment), F.lit("%2e"), F.lit("."))

    def step(kept, segment):
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(dots(segment) == "..", parent)
            .when(dots(segment) == ".", kept)
            .otherwise(F.array_append(kept, segment))
        )

    def fold(segments):
        last = dots(F.element_at(segments, -1))
        tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(nothing)
        kept = F.aggregate(segments, nothing, step)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    def apply(p):
        segments = F.split(F.substring(p, 2, 2**31 - 1), "/", -1)
        return F.when(p.rlike(DOT_SEGMENT), let(segments, fold)).otherwise(p)

    return let(path, apply)


def _origin(scheme: Column, authority: Column) -> Column:
    """``scheme://user@host:port`` in normal form, NULL for a bad authority."""

    def build(part):
        port = part["port"].try_cast("int")
        default = F.when(part["scheme"] == "http", DEFAULT_PORT["http"]).otherwise(
            DEFAULT_PORT["https"]
        )
        return F.concat(
            part["scheme"],
            F.lit("://"),
            F.when(part["user"].isin("@", ":@"), F.lit("")).otherwise(part["user"]),
            part["host"],
            F.when(port.isNull() | (port == default), F.lit("")).otherwise(
                F.concat(F.lit(":"), port.cast("string"))
            ),
        )

    return let(
        F.struct(
            scheme.alias("scheme"),
            authority_host(authority).alias("host"),
            F.regexp_extract(authority, USERINFO_IN_AUTHORITY, 1).alias("user"),
            F.regexp_extract(authority, PORT_IN_AUTHORITY, 1).alias("port"),
        ),
        build,
    )


def _scheme_and_rest(text: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(text, SCHEME, 1)).alias("scheme"),
        F.regexp_replace(text, SCHEME, "").alias("rest"),
        text.alias("text"),
    )


def _pieces(rest: Column) -> Column:
    """Path (slashes normalised), ``?query`` and ``#fragment`` of a reference."""
    return F.struct(
        F.translate(F.regexp_extract(rest, r"(?s)^[^?#]*", 0), "\\", "/").alias("path"),
        F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.regexp_extract(rest, r"(?s)^[^#]*(#.*)$", 1).alias("fragment"),
    )


def _authority(path: Column) -> Column:
    return F.regexp_extract(path, "^/*([^/]*)", 1)


def _after_authority(path: Column) -> Column:
    return _slash_if_empty(F.regexp_replace(path, "^/*[^/]*", ""))


def _slash_if_empty(path: Column) -> Column:
    return F.regexp_replace(path, "^$", "/")


def _normal_path(path: Column) -> Column:
    return percent_encode(remove_dot_segments(path), PATH_SAFE)


def base_parts(url: Column) -> Column:
    """``struct(scheme, origin, path, query)`` of a page URL, to resolve its links with.

    ``origin`` is NULL unless the URL is a valid absolute http(s) URL.
    """

    def build(head):
        return let(
            _pieces(head["rest"]),
            lambda p: F.struct(
                head["scheme"].alias("scheme"),
                F.when(
                    head["scheme"].isin(*DEFAULT_PORT), _origin(head["scheme"], _authority(p["path"]))
                ).alias("origin"),
                _normal_path(_after_authority(p["path"])).alias("path"),
                percent_encode(p["query"], QUERY_SAFE).alias("query"),
            ),
        )

    return let(clean(url), lambda text: let(_scheme_and_rest(text), build))


def resolve(href: Column, base: Column) -> Column:
    """``href`` resolved against ``base_parts`` of its page; NULL where that is impossible.

    The fragment is kept. Results of other schemes keep their written form. A plain
    absolute path, the most common link, takes the short way.
    """

    def relative(head):
        return let(_pieces(head["rest"]), lambda p: join(head, p))

    def join(head, p):
        own_scheme = head["scheme"] != ""
        scheme = F.when(own_scheme, head["scheme"]).otherwise(base["scheme"])
        has_authority = p["path"].startswith("//") | (own_scheme & (head["scheme"] != base["scheme"]))
        same_document = (p["path"] == "") & ~has_authority
        path = (
            F.when(has_authority, _after_authority(p["path"]))
            .when(p["path"].startswith("/"), p["path"])
            .otherwise(F.concat(F.regexp_extract(base["path"], "^.*/", 0), p["path"]))
        )
        return F.concat(
            F.when(has_authority, _origin(scheme, _authority(p["path"]))).otherwise(base["origin"]),
            F.when(same_document, base["path"]).otherwise(_normal_path(path)),
            F.when(same_document & (p["query"] == ""), base["query"]).otherwise(
                percent_encode(p["query"], QUERY_SAFE)
            ),
            percent_encode(p["fragment"], FRAGMENT_SAFE),
        )

    def general(head):
        other = (head["scheme"] != "") & ~head["scheme"].isin(*DEFAULT_PORT)
        return F.when(other, head["text"]).otherwise(relative(head))

    return let(
        clean(href),
        lambda text: F.when(base["origin"].isNull(), F.lit(None).cast("string"))
        .when(text.rlike(PLAIN_PATH), F.concat(base["origin"], text))
        .otherwise(let(_scheme_and_rest(text), general)),
    )


def resolve_url(df: DataFrame, href: str = "href", base: str = "url", out: str = "resolved"):
    """Add ``out``: ``href`` resolved against the URL in ``base``."""
    return df.withColumn(out, let(base_parts(F.col(base)), lambda b: resolve(F.col(href), b)))


def canonicalize(df: DataFrame, url: str = "url", out: str = "url") -> DataFrame:
    """A URL in normal form; NULL where it is not an absolute http(s) URL."""
    return resolve_url(df, url, url, out)


@F.pandas_udf(T.StringType())
def punycode_host(host: pd.Series) -> pd.Series:
    """ASCII form of international host names; NULL where there is none.

    Only for tables known to hold such hosts: plain ASCII hosts need no UDF.
    """

    def encode(name):
        try:
            return name if name is None or name.isascii() else name.encode("idna").decode()
        except UnicodeError:
            return None

    return host.map(encode, na_action="ignore")


def url_hash(url: Column) -> Column:
    """SHA-256 hex of the raw URL string (of the URL, not of the page)."""
    return F.sha2(url, 256)


def shard_columns(hashed: Column) -> dict[str, Column]:
    return {"shard1": F.substring(hashed, 1, 2), "shard2": F.substring(hashed, 3, 2)}


def shard_path(hashed: Column) -> Column:
    """``html/ab/cd/<hash>.html``"""
    return F.concat_ws(
        "/",
        F.lit("html"),
        F.substring(hashed, 1, 2),
        F.substring(hashed, 3, 2),
        F.concat(hashed, F.lit(".html")),
    )


def rate_key(host: Column, prefix: str = "ratelimit:domain:") -> Column:
    return F.concat(F.lit(prefix), host)


def request_json(url: Column) -> Column:
    return F.to_json(F.struct(url.alias("url")))


def request_url(body: Column) -> Column:
    """URL of a JSON request body; NULL when there is none or the JSON is broken."""
    return F.from_json(body, "url STRING")["url"]


def form_url(body: Column) -> Column:
    """URL of an urlencoded request body."""
    value = F.regexp_extract(body, r"(?:^|&)url=([^&]*)", 1)
    return _blank_to_null(F.try_url_decode(value))
