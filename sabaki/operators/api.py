"""Requests as rows: keys, and the shape of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_rejection(key: Column, expected: Column) -> Column:
    """Why a request is refused (401), or null."""
    missing = F.coalesce(key, F.lit("")) == ""
    return F.when(missing, "API key is missing").when(~key.eqNullSafe(expected), "Invalid API key")


def error_envelope(status: Column, message: Column, path: Column, at: Column) -> Column:
    """JSON of an error; without a status it is an internal one, without a message the usual text."""
    code = F.coalesce(status, F.lit(500))
    text = F.coalesce(message, F.when(status.isNull(), "Internal server error").otherwise("Error occurred"))
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(code.alias("statusCode"), stamp.alias("timestamp"), path.alias("path"), text.alias("message")))
