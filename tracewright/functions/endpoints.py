"""Endpoints, credentials and HTTP exchanges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACES = "/v1/traces"


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def host_port(url: Column) -> Column:
    """host:port of an endpoint; 443 unless the scheme is http (80); null where nothing is left."""
    rest = F.regexp_replace(_bare(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    port = F.when(_bare(url).rlike("^http://"), "80").otherwise("443")
    return F.when(host == "", None).when(host.rlike(r":\d+$"), host).otherwise(F.concat_ws(":", host, port))


def traces_path(url: Column) -> Column:
    """The path of an endpoint with the traces suffix."""
    rest = F.regexp_replace(_bare(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.when(F.regexp_extract(rest, "^([^/]*)", 1) != "", F.concat(F.regexp_extract(rest, "^[^/]*(/.*)?$", 1), F.lit(TRACES)))


def basic_credential(key: Column) -> Column:
    """``Basic`` value of a key used as name and password; Spark wraps base64 lines, headers mustn't."""
    return F.concat(F.lit("Basic "), F.regexp_replace(F.base64(F.encode(F.concat_ws(":", key, key), "UTF-8")), "[\r\n]", ""))


def bearer(key: Column) -> Column:
    return F.concat(F.lit("Bearer "), key)


def http_class(status: Column, error: Column) -> Column:
    """``error`` where the exchange failed, ``http_<code>`` from 400, else ``ok``."""
    return F.when(error.isNotNull() & (error != ""), "error").when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))).otherwise("ok")


def http_prompt(method: Column, url: Column) -> Column:
    return F.concat_ws(" ", method, F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1))


def http_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)
