"""Keys removed from addresses and from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def redact_url(url: Column, param: str = "api_key") -> Column:
    """The address without the parameter; text that is no address gets its value masked instead."""
    gone = F.regexp_replace(url, rf"(?<=[?&]){param}=[^&#]*&?", "")
    tidy = F.regexp_replace(gone, r"[?&]+(?=#|$)", "")
    masked = F.regexp_replace(url, rf"{param}=[^&#]*", f"{param}=REDACTED")
    has = url.rlike(rf"[?&]{param}=")
    return F.when(~has, url).when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#]+"), tidy).otherwise(masked)


def redact_secrets(text: Column, literal: str | None = None, param: str = "api_key") -> Column:
    """The literal key anywhere, and the parameter's value up to a quote, &, # or white space."""
    out = text if not literal else F.replace(text, F.lit(literal), F.lit("REDACTED"))
    return F.regexp_replace(out, rf'{param}=[^"&#\s]*', f"{param}=REDACTED")
