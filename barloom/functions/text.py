"""Redaction, fingerprints and source identity for request evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MASK = "***"
SENSITIVE_NAME = "(?i)token|secret|password|credential|auth"
HEX_RUN = "[0-9a-fA-F]{8,}"
MESSAGE_LENGTH = 200
NON_OFFICIAL_WARNING = "NON_OFFICIAL_VENDOR_ENDPOINT"
SAFE_CODE_PATTERN = r"^[A-Za-z0-9._-]{1,64}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact_params(params: Column | str, secret: Column | str | None = None) -> Column:
    """Mask the value of every ``(name, value)`` whose name or value gives a secret away."""
    def clean(p: Column) -> Column:
        hidden = p["name"].rlike(SENSITIVE_NAME)
        if secret is not None:
            hidden = hidden | F.coalesce(p["value"] == _col(secret), F.lit(False))
        return F.struct(p["name"].alias("name"),
                        F.when(hidden, MASK).otherwise(p["value"]).alias("value"))

    return F.transform(_col(params), clean)


def mask_message(message: Column | str) -> Column:
    """First 200 characters with every run of eight or more hex digits masked."""
    return F.regexp_replace(F.substring(_col(message), 1, MESSAGE_LENGTH), HEX_RUN,
                            F.lit(MASK))


def nonfinite_marker(c: Column | str) -> Column:
    """Label for a number that JSON cannot hold; null for a usable one."""
    c = _col(c)
    return (F.when(F.isnan(c), "NaN")
            .when(c == float("inf"), "Infinity")
            .when(c == float("-inf"), "-Infinity"))


def row_fingerprint(columns: Sequence[Column | str]) -> Column:
    """sha256 over the fields in the given order; a null differs from an empty field."""
    cells = [F.coalesce(F.concat(F.lit("="), _col(c).cast("string")), F.lit("~"))
             for c in columns]
    return F.sha2(F.concat_ws("|", *cells), 256)


def safe_vendor_code(c: Column | str) -> Column:
    """The vendor code when it is safe to keep as evidence, else null."""
    c = _col(c)
    return F.when(c.rlike(SAFE_CODE_PATTERN), c)


def url_host(url: Column | str) -> Column:
    """Lower-case host of an http(s) URL, null when there is none."""
    url = _col(url)
    return F.when(url.rlike("^(?i)https?://"), F.lower(F.try_parse_url(url, F.lit("HOST"))))


def source_columns(url: Column | str, official_host: str, official: str = "official",
                   other: str = "non-official") -> list[Column]:
    """host, official flag, source label and provenance warning; never the full URL."""
    host = url_host(url)
    is_official = host == official_host.lower()
    return [
        host.alias("host"),
        F.coalesce(is_official, F.lit(False)).alias("is_official"),
        F.when(host.isNull(), "INVALID_URL").when(is_official, official).otherwise(other)
        .alias("source"),
        F.when(host.isNotNull() & ~is_official, NON_OFFICIAL_WARNING).alias("warning"),
    ]
