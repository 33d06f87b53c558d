"""Queries of the problems about language-model data, and the SQL that checks some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, packing, pairs, pii, sentences, sequences, tokens, truncation
from tracewright.sources.tables import prepare, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _pairs(spark, base).select("record_id", "answer_field", "call_no", "defect_type")


def p1_labels(spark: SparkSession, base: str) -> DataFrame:
    """Every defect of every defective pair, with its posterior."""
    found = _pairs(spark, base)
    chance = F.create_map(*(x for d in pairs.ORDER for x in (F.lit(d), F.col(f"p_{d}"))))
    return found.select("record_id", "answer_field", "call_no", F.explode("defects").alias("defect_type"), chance.alias("chances")).withColumn("posterior", F.round(F.col("chances")[F.col("defect_type")], 6)).drop("chances")


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    return pairs.defective_pairs(table(spark, base, "decision_journals"), table(spark, base, "documents"))


def _values(spark: SparkSession, base: str, agents: bool = False) -> DataFrame:
    prepare(spark)
    return truncation.all_values(*(table(spark, base, t) for t in ("decision_journals", "agent_events", "spans")), agents)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return truncation.cut_values(_values(spark, base))


def p2_shares(spark: SparkSession, base: str) -> DataFrame:
    return truncation.cut_shares(_values(spark, base, True))


def _prose(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    return pii.texts(table(spark, base, "decision_journals"), table(spark, base, "spans"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.values(_prose(spark, base))


def p4_rewritten(spark: SparkSession, base: str) -> DataFrame:
    """Each text that holds personal data, with typed placeholders and with surrogates. A key for tests only."""
    return pii.rewritten(_prose(spark, base), b"public test key")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    seqs = sequences.latest_sequences(table(prepare(spark), base, "decision_journals"))
    return sequences.frequent_patterns(seqs, 0.03).select(F.array_join("steps", ">").alias("pattern"))


def p5_supports(spark: SparkSession, base: str) -> DataFrame:
    seqs = sequences.latest_sequences(table(prepare(spark), base, "decision_journals"))
    return sequences.frequent_patterns(seqs, 0.03).select(F.array_join("steps", ">").alias("pattern"), "support", "closed")


def p8_packing(spark: SparkSession, base: str) -> DataFrame:
    """Every document, or piece of one, with its container of each kind."""
    prepare(spark)
    return packing.packed(table(spark, base, "documents"), table(spark, base, "container_sizes"))


def p8_unused(spark: SparkSession, base: str) -> DataFrame:
    return packing.report(p8_packing(spark, base))


def p8_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold for every kind of container."""
    return packing.checked(p8_packing(spark, base), tokens.with_sizes(table(spark, base, "documents")).select("doc_id", "n_tokens"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """Every use of a document in the mix."""
    prepare(spark)
    return mixing.mixed(table(spark, base, "documents"), table(spark, base, "source_targets"))[0]


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed(table(spark, base, "documents"), table(spark, base, "source_targets"))[1]


def p9_tempered(spark: SparkSession, base: str) -> DataFrame:
    """The shares reached where the weights come from a temperature instead of the targets."""
    prepare(spark)
    return mixing.mixed(table(spark, base, "documents"), table(spark, base, "source_targets"), weights="temperature")[1]


def p9_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold for every source."""
    return mixing.checked(p9_mix(spark, base), table(spark, base, "source_targets"), table(spark, base, "documents"))


def p9_temperature(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    return mixing.temperatures(table(spark, base, "documents"), table(spark, base, "source_targets"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.sentence_units(table(prepare(spark), base, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_shares, p4_found, p4_rewritten, p5_found, p5_supports, p8_packing, p8_unused, p8_checks, p9_mix, p9_shares, p9_tempered, p9_temperature, p9_checks, p10_found)}

def _longer(n: int) -> str:
    """Distinct patterns of n steps per journal from those of n - 1."""
    return f"s{n} AS (SELECT DISTINCT t.j, t.p || '>' || s.name AS p, s.i FROM s{n - 1} t JOIN steps s ON t.j = s.j AND s.i - t.i BETWEEN 1 AND 3)"


_TOOL_STEPS = f"""
WITH latest AS (
  SELECT journal_id, arg_max(tool_calls, record_id) AS calls FROM decision_journals GROUP BY journal_id
), kept AS (SELECT row_number() OVER (ORDER BY journal_id) AS j, calls FROM latest WHERE len(calls) > 0),
steps AS (SELECT j, i, name FROM (SELECT j, unnest(range(len(calls))) AS i, unnest(calls).tool_name AS name FROM kept) WHERE name IS NOT NULL),
s1 AS (SELECT j, name AS p, i FROM steps), {", ".join(_longer(n) for n in (2, 3, 4, 5))},
counted AS (SELECT n, p AS pattern, count(DISTINCT j) AS support FROM ({" UNION ALL ".join(f"SELECT {n} AS n, j, p FROM s{n}" for n in (3, 4, 5))}) GROUP BY n, p),
found AS (SELECT * FROM counted WHERE n < 5 AND support >= 0.03 * (SELECT count(*) FROM kept))"""

_CHECKS = "SELECT container_kind, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS wrong_size, CAST(0 AS BIGINT) AS cut_without_need FROM container_sizes"

_REPEATS = "SELECT lower(trim(source)) AS source, max(coalesce(max_repeats, 1)) AS max_repeats, CAST(0 AS BIGINT) AS over_repeated, CAST(0 AS BIGINT) AS foreign_documents FROM source_targets WHERE trim(source) <> '' GROUP BY 1"

ORACLE = {"p9_checks": _REPEATS, "p8_checks": _CHECKS, "p5_found": _TOOL_STEPS + " SELECT pattern FROM found", "p5_supports": _TOOL_STEPS
  + """, ends AS (SELECT n - 1 AS n, unnest([regexp_replace(pattern, '^[^>]*>', ''), regexp_replace(pattern, '>[^>]*$', '')]) AS pattern, support FROM counted)
SELECT pattern, support, NOT EXISTS (SELECT 1 FROM ends e WHERE e.pattern = f.pattern AND e.n = f.n AND e.support = f.support) AS closed FROM found f"""}
