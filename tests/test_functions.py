import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.config import Settings
from tracewright.functions import endpoints, hashing, redact, scalars
from tracewright.plans.telemetry import _CASES

WANT = (
    "write to [EMAIL] now", "ssn [SSN] and x123-45-6789", "key [AWS_KEY] end", "card [CREDIT_CARD], 4111111111111112", "[CREDIT_CARD] [CREDIT_CARD]", '{"mail":"[EMAIL]","id":"[SSN]"}', "[CREDIT_CARD] is thirteen zeros", "", "nothing 12345 here",
)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("given,want", zip(_CASES, WANT, strict=True))
def test_redaction(spark, given, want):
    assert one(spark, given, redact.redact_pii) == want
    assert one(spark, want, redact.redact_pii) == want


def test_redaction_of_null_and_long(spark):
    assert one(spark, None, redact.redact_pii) is None
    assert one(spark, "x " * 200_000 + "a@b.co", redact.redact_pii).endswith("x [EMAIL]")


def test_each_run_is_tried_once_with_the_same_result(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b.", "@", "co", ".", "-", "_", " ", "é", "1", "a@b.co"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", redact._EMAIL_ONCE, "<>")).collect()]
    assert got == [re.sub(redact.EMAIL, "<>", t) for t in texts]


def test_sql_function(spark):
    redact.register(spark, "r")
    df = spark.createDataFrame([(c,) for c in _CASES], "v string")
    df.createOrReplaceTempView("cases")
    assert [r[0] for r in spark.sql("select r(v) from cases").collect()] == list(WANT)


@pytest.mark.parametrize("s,ok", [("4111111111111111", True), ("4111 1111 1111 1111", True), ("378282246310005", True), ("4111111111111112", False), ("12345", False), ("", False), ("words", False), (None, False)])
def test_luhn(spark, s, ok):
    assert one(spark, s, redact.luhn_valid) is ok


def test_order_of_redaction_and_cap(spark):
    text = "abcdefgh a@example.org"
    assert one(spark, text, lambda c: redact.safe_value(c, 12)) == "abcdefgh [EM"
    assert one(spark, text, lambda c: redact.safe_value(c, 12, "clip_first")) == "abcdefgh a@e"
    assert one(spark, "世界ab", lambda c: redact.clip(c, 3)) == "世界a" and one(spark, "ab", lambda c: redact.clip(c, -1)) == ""


def test_attributes(spark):
    bag = {"input.value": "a@b.co", "output.value": "123-45-6789", "agent.name": "like@mail.org"}
    assert one(spark, bag, redact.redact_attributes, "map<string,string>") == {"input.value": "[EMAIL]", "output.value": "[SSN]", "agent.name": "like@mail.org"}


@pytest.mark.parametrize("url,host,path", [("https://h", "h:443", "/v1/traces"), ("http://h/", "h:80", "/v1/traces"), ("h:4318", "h:4318", "/v1/traces"), ("https://h:1/base/", "h:1", "/base/v1/traces"), ("h", "h:443", "/v1/traces"), ("", None, None)])
def test_endpoints(spark, url, host, path):
    assert one(spark, url, endpoints.host_port) == host and one(spark, url, endpoints.traces_path) == path


def test_credentials_have_no_line_ends(spark):
    import base64

    key = "k" * 80
    assert one(spark, key, endpoints.basic_credential) == "Basic " + base64.b64encode(f"{key}:{key}".encode()).decode()


def test_messages(spark):
    f = lambda c: scalars.verdict_message(c, F.lit("BLOCK"), F.lit("r1"), F.lit("denied"))
    assert one(spark, " ", f) == "BLOCK by policy r1 (approval denied)" and one(spark, "no", f) == "no (approval denied)"


def test_hash_borders(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)], "x string, y string")
    assert df.select(hashing.integrity(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4


def test_settings():
    assert not Settings().enforcing and Settings(endpoint="e", api_key="k").enforcing
    with pytest.raises(ValueError):
        Settings(endpoint="e")
    assert Settings.from_env({"TRACEWRIGHT_ENDPOINT": " e ", "TRACEWRIGHT_API_KEY": "k", "TRACEWRIGHT_REDACT": "no"}).redact is False
