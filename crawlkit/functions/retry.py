"""Retry delays and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retry policy.
INGEST_ATTEMPTS = 5
INGEST_BASE_MS = 2000
FETCH_ATTEMPTS = 25
FETCH_BASE_MS = 1000
FETCH_CAP_MS = 30000
DOMAIN_LIMIT = "DomainRateLimitError"

# Failure kind, error name, status code, message template.
ERRORS = [
    ("domain_limit", "DomainRateLimitError", 429, "Domain %s is currently rate limited"),
    ("dns", "DnsResolutionError", 502, "Failed to resolve hostname: %s"),
    ("timeout", "ConnectionTimeoutError", 504, "Connection timed out while fetching %s"),
    ("http_429", "Http429Error", 429, "Target server rate limited request: %s"),
    ("http_404", "Http404Error", 404, "Page not found: %s"),
    ("content_type", "UnsupportedContentTypeError", 415, "Unsupported content type: %s"),
    ("too_large", "ResponseTooLargeError", 413, "Response size exceeded limit: %s bytes"),
    ("storage", "HtmlStorageError", 500, "Failed to store HTML at %s"),
]
SERVER_ERROR = ("Http5xxError", "Server error (%d) while fetching %s")
OTHER_ERROR = ("AppError", 500)


def _doubled(base_ms: int, times: Column) -> Column:
    """``base * 2^times`` for small ``times``; exact in a double, hence in the result."""
    return (base_ms * F.pow(F.lit(2.0), times)).cast("bigint")


def ingest_backoff_ms(attempt: Column) -> Column:
    """Wait after a failed ingest attempt (from 1); NULL when no attempt is left."""
    return F.when(
        attempt.between(1, INGEST_ATTEMPTS - 1), _doubled(INGEST_BASE_MS, attempt - 1)
    )


def fetch_backoff_ms(error_name: Column, attempt: Column) -> Column:
    """Wait after a failed fetch attempt; NULL when no attempt is left."""
    wait = F.when(error_name == DOMAIN_LIMIT, F.lit(FETCH_BASE_MS).cast("bigint")).otherwise(
        F.least(_doubled(FETCH_BASE_MS, attempt), F.lit(FETCH_CAP_MS).cast("bigint"))
    )
    return F.when(attempt.between(1, FETCH_ATTEMPTS - 1), wait)


#: Attempts and waits of a policy: the wait follows from the error's name and the attempt.
POLICIES = {
    "ingest": (INGEST_ATTEMPTS, lambda error_name, attempt: ingest_backoff_ms(attempt)),
    "fetch": (FETCH_ATTEMPTS, fetch_backoff_ms),
}


def failure_kind(kind: Column, http_status: Column) -> Column:
    """One kind per failure: the given one, else read off the HTTP status."""
    return F.coalesce(
        kind,
        F.when(http_status == 429, "http_429")
        .when(http_status == 404, "http_404")
        .when(http_status >= 500, "http_5xx"),
    )


def error_class(kind: Column, http_status: Column, detail: Column) -> Column:
    """``struct(name, message, status_code, detail)`` of a failure, as one expression."""
    full = failure_kind(kind, http_status)
    name = F.when(full == "http_5xx", SERVER_ERROR[0])
    code = F.when(full == "http_5xx", http_status.cast("int"))
    message = F.when(full == "http_5xx", F.format_string(SERVER_ERROR[1], http_status.cast("int"), detail))
    for error_kind, error_name, status, template in ERRORS:
        name = name.when(full == error_kind, error_name)
        code = code.when(full == error_kind, status)
        message = message.when(full == error_kind, F.format_string(template, detail))
    return F.struct(
        name.otherwise(OTHER_ERROR[0]).alias("name"),
        message.otherwise(detail).alias("message"),
        code.otherwise(OTHER_ERROR[1]).alias("status_code"),
        detail.alias("detail"),
    )
