"""Redaction of four classes of secrets as column expressions, all inside the JVM.

``\\b`` depends on the JDK's idea of a word, so boundaries are spelled out for ASCII words. Cards are
replaced only where the check digit holds; as Spark has no replacement by callback, the text is split at the candidates and put
together again around them.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The patterns and placeholders of the four classes, in the order they apply.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN = r"\d{3}-\d{2}-\d{4}"
AWS_KEY = r"(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}"
CARD = r"\d(?:[ -]?\d){12,18}"
PLACEHOLDERS = {"email": "[EMAIL]", "ssn": "[SSN]", "aws_key": "[AWS_KEY]", "card": "[CREDIT_CARD]"}

_LEFT, _RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


#: The e-mail pattern tried once for each run of its first signs: a run that fails from its start fails from everywhere.
_EMAIL_ONCE = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL


def _bounded(pattern: str) -> str:
    return _LEFT + pattern + _RIGHT


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_valid(c: Column) -> Column:
    """Whether the digits of ``c``, 13 to 19 of them, pass the check; false for null."""
    d = digits(c)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def card_candidates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_bounded(CARD)), F.lit(0))


def redact_cards(c: Column) -> Column:
    found, between = card_candidates(c), F.split(c, _bounded(CARD), -1)
    tail = F.transform(found, lambda x, i: F.concat(F.when(luhn_valid(x), F.lit(PLACEHOLDERS["card"])).otherwise(x), F.element_at(between, i + 2)))
    return F.when(F.size(found) > 0, F.concat(F.element_at(between, 1), F.array_join(tail, ""))).otherwise(c)


def redact_pii(c: Column) -> Column:
    """``c`` with e-mail addresses, social security numbers, cloud keys and cards replaced; null stays null."""
    c = F.regexp_replace(c, _EMAIL_ONCE, PLACEHOLDERS["email"])
    c = F.regexp_replace(c, _bounded(SSN), PLACEHOLDERS["ssn"])
    c = F.regexp_replace(c, _bounded(AWS_KEY), PLACEHOLDERS["aws_key"])
    return redact_cards(c)


def clip(c: Column, n: int) -> Column:
    """The first ``n`` code points; nothing for n below 1."""
    return F.left(c, F.lit(n))


def safe_value(c: Column, cap: int, order: str = "redact_first") -> Column:
    """Redacted and clipped. ``clip_first`` is the older order, in which a value that straddles the cap can stay visible."""
    if order not in ("redact_first", "clip_first"):
        raise ValueError(order)
    return clip(redact_pii(c), cap) if order == "redact_first" else redact_pii(clip(c, cap))


def redact_attributes(bag: Column, keys: tuple[str, ...] = ("input.value", "output.value")) -> Column:
    """A map of span attributes with only the values of ``keys`` redacted."""
    return F.transform_values(bag, lambda k, v: F.when(k.isin(*keys), redact_pii(v)).otherwise(v))


def register(spark: SparkSession, name: str = "redact_pii") -> None:
    """A SQL function of the same meaning that Catalyst inlines."""
    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    card = lit(_bounded(CARD))
    body = f"regexp_replace(s, {lit(_EMAIL_ONCE)}, '[EMAIL]')"
    body = f"regexp_replace({body}, {lit(_bounded(SSN))}, '[SSN]')"
    body = f"regexp_replace({body}, {lit(_bounded(AWS_KEY))}, '[AWS_KEY]')"
    found, between = f"regexp_extract_all(t, {card}, 0)", f"split(t, {card}, -1)"
    number = "regexp_replace(x, '[^0-9]', '')"
    joined = f"array_join(transform({found}, (x, i) -> concat(CASE WHEN length({number}) BETWEEN 13 AND 19 AND luhn_check({number}) THEN '[CREDIT_CARD]' ELSE x END, element_at({between}, i + 2))), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN (SELECT CASE WHEN size({found}) > 0 THEN concat(element_at({between}, 1), {joined}) ELSE t END FROM (SELECT {body} AS t))")
