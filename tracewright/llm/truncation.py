"""Text values that were cut, at a fixed length or in transfer, and how often each source cuts.

Values of all sources come into one narrow table: lengths in characters and bytes, a hash, how the value ends, and whether
something beside it proves a cut. Length histograms per source and column, in characters and in bytes, are
then tested for spikes at their top: a cap leaves many different values of one length and next to none beyond.

Two detectors, told apart in ``reason``. ``spike``: a value of a spike length whose end isn't one that a cut leaves
only by chance. What breaks off in transfer has no common length, so the second one reads the value itself:
``longer_copy`` (the same record holds the text with more behind it), ``broken_json``, ``mark`` (a sign of cutting, half a
character) and ``open_end`` (it stops inside a sentence). Ends that need no mark (list items, links, code, labelled
numbers, JSON, stock phrases such as ``done``) are complete below the spike; stock phrases are found by how often
a value without an end recurs in its column.

Only lengths, hashes and flags are kept, never the texts; the histograms and the stock phrases are bounded (lengths of the
top of each column; at most 1 / STOCK_SHARE phrases a column), so only they are broadcast.

Defined results: null and empty values and stand-ins for nothing aren't cut; a null payload is no case, a
payload that isn't readable JSON and doesn't end like an object is cut; repeats of an event or span count
once and are cut if any copy is; tables without rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import endings
from tracewright.sources.tables import settled

#: A value without an end that makes up this share of a column (and occurs five times) is a stock phrase.
STOCK_SHARE = 0.0005
TEXTS = ("user_message", "cot_preview", "result_preview")
REASONS = ("spike", "longer_copy", "broken_json", "mark", "open_end")


def _java(pattern: str) -> str:
    """The pattern with letters of all scripts, as Python reads it."""
    return "(?U)" + pattern


def last_line(text: Column) -> Column:
    """The last line, without blanks behind it."""
    bare = F.when(F.right(text, F.lit(1)).rlike(_java(r"\s")), F.regexp_replace(text, _java(r"(?<!\s)\s+$"), "")).otherwise(text)
    return F.substring_index(bare, "\n", -1)


#: ``endings.holds_nothing``; fails at the first letter of anything else.
_NOTHING = r"(?i)^[^\p{L}\p{N}]*+(?:(?:" + "|".join(sorted(endings.STAND_INS, reverse=True)) + r")[^\p{L}\p{N}]*+)?$"


def end_kind(text: Column, line: Column) -> Column:
    """``endings.ending`` as a column expression: COMPLETE, NATURAL, OPEN, MARKED or NOTHING. line: the text's ``last_line``."""
    natural = line.rlike(_java("|".join((endings.LINK, endings.CODE, endings.FENCE, endings.LABEL, endings.ITEM, endings.UNMARKED))))
    return (
        F.when(text.rlike(_NOTHING), endings.NOTHING)
        .when(line.endswith("[...]"), endings.MARKED)
        .when(line.rlike(endings.TERMINAL), endings.COMPLETE)
        .when(line.rlike(endings.MARK), endings.MARKED)
        .when(line.rlike(endings.JSON) & text.rlike(r"^\s*[\[{]"), endings.COMPLETE)
        .when(natural, endings.NATURAL)
        .otherwise(endings.OPEN)
    )


#: At a spike length these still count as whole: a closed piece of code, a full link path, an end that no cut leaves by chance.
FIRM_AT_SPIKE = r"`[^`\n]+`$|```$|https?://\S+/\d{3,}$|[^\W\d_] ?[:：] ?\d{3,}$"


def _measured(df: DataFrame, source: str, column: Column, group: Column, key: Column, call: Column, text: Column, proof: Column) -> DataFrame:
    # The text and its last line are projected once, as each is read by several expressions.
    once = df.select(column.alias("column"), group.cast("string").alias("grp"), key.alias("row_key"), call.cast("bigint").alias("call_no"), text.alias("text"), proof.alias("proof")).withColumn("line", last_line(F.col("text")))
    return once.select(
        F.lit(source).alias("source_field"),
        "column",
        "grp",
        "row_key",
        "call_no",
        F.length("text").alias("n_chars"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("value"),
        F.when(F.col("text").isNull(), endings.NOTHING).otherwise(end_kind(F.col("text"), F.col("line"))).alias("ending"),
        F.coalesce(F.col("line").rlike(_java(FIRM_AT_SPIKE)), F.lit(False)).alias("firm"),
        "proof",
    )


def journal_values(journals: DataFrame) -> DataFrame:
    calls = journals.select("record_id", "agent_id", F.posexplode("model_calls").alias("call_no", "call")).select("record_id", "agent_id", "call_no", "call.prompt_preview", "call.cot_reasoning")
    seen, full = F.col("prompt_preview"), F.col("cot_reasoning")
    longer = (F.length(full) > F.length(seen)) & (F.length(seen) > 0) & full.startswith(seen)
    return _measured(calls, "decision_journals.prompt_preview", F.lit("prompt_preview"), F.col("agent_id"), F.col("record_id").cast("string"), F.col("call_no"), seen, F.when(longer, "longer_copy"))


def event_values(events: DataFrame) -> DataFrame:
    read = events.where("payload is not null").select(
        "event_id", F.lower(F.trim("event_type")).alias("grp"), "payload", F.from_json("payload", ", ".join(f"{t} string" for t in TEXTS) + ", broken string", {"columnNameOfCorruptRecord": "broken"}).alias("p")
    )
    text = F.coalesce(*(F.col(f"p.{t}") for t in TEXTS))
    which = F.coalesce(*(F.when(F.col(f"p.{t}").isNotNull(), t) for t in TEXTS), F.lit("payload"))
    broken = F.col("p.broken").isNotNull()
    whole = F.when(broken, F.lit(None).cast("string")).otherwise(text)
    return _measured(read, "agent_events.payload", F.when(broken, "payload").otherwise(which), F.col("grp"), F.col("event_id"), F.lit(-1), whole, F.when(broken, "broken_json"))


def span_values(spans: DataFrame, agents: bool = False) -> DataFrame:
    """agents: with the agent of the trace's root, since model calls carry none; else the group is the model."""
    calls = spans.where("span_name = 'governance.model_call'").select("span_id", "trace_id", "agent_id", "llm_model_name", "output_value")
    group = F.coalesce("agent_id", "llm_model_name")
    if agents:
        roots = spans.where("span_kind = 'AGENT' and trace_id is not null").groupBy("trace_id").agg(F.min("agent_id").alias("root_agent"))
        calls, group = calls.join(roots, "trace_id", "left"), F.coalesce("agent_id", "root_agent")
    return _measured(calls, "spans.output_value", F.lit("output_value"), group, F.col("span_id"), F.lit(-1), F.col("output_value"), F.lit(None).cast("string"))


def spikes(values: DataFrame, unit: str, near: int = 25, times: float = 8.0, least: int = 5, beyond: float = 0.01, slack: int = 0) -> DataFrame:
    """(source_field, column, at) of the lengths that spike at the top of a column's histogram.

    A spike has ``least`` different values, at least half as many as values, and ``times`` the mean of the ``near``
    lengths below it; at most a share ``beyond`` of the column is longer by more than ``slack``, which bytes need: a cap that keeps
    characters whole leaves up to three bytes.
    """
    by = ["source_field", "column"]
    histogram = values.where(F.col(unit) > 0).groupBy(*by, F.col(unit).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value").alias("different"))
    order = Window.partitionBy(*by).orderBy("at")
    below = F.sum("n").over(order.rangeBetween(-near, -1)) / F.lit(near)
    longer = F.sum("n").over(order.rangeBetween(1 + slack, Window.unboundedFollowing))
    total = F.sum("n").over(Window.partitionBy(*by))
    judged = histogram.select(*by, "at", "n", "different", F.coalesce(below, F.lit(0.0)).alias("below"), F.coalesce(longer, F.lit(0)).alias("longer"), total.alias("total"))
    many = (F.col("different") >= least) & (F.col("different") >= 0.5 * F.col("n")) & (F.col("n") >= times * F.col("below"))
    return judged.where(many & (F.col("longer") <= beyond * F.col("total"))).select(*by, "at")


def judged(values: DataFrame) -> DataFrame:
    """``values`` with ``reason``, null for whole ones. Reads ``values`` several times, so it should be settled."""
    by = ["source_field", "column"]
    open_ones = values.where(F.col("ending") == endings.OPEN)
    total = values.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    phrases = open_ones.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    stock = phrases.join(F.broadcast(total), by).where((F.col("n") >= 5) & (F.col("n") >= STOCK_SHARE * F.col("total"))).select(*by, "value", F.lit(True).alias("stock"))
    chars = F.broadcast(spikes(values, "n_chars").select(*by, F.col("at").alias("n_chars"), F.lit(True).alias("at_chars")))
    octets = F.broadcast(spikes(values, "n_bytes", slack=3).select(*by, F.col("at").alias("n_bytes"), F.lit(True).alias("at_bytes")))
    known = values.join(chars, [*by, "n_chars"], "left").join(octets, [*by, "n_bytes"], "left").join(F.broadcast(stock), [*by, "value"], "left")
    at_spike, ending = F.coalesce(F.col("at_chars"), F.col("at_bytes"), F.lit(False)), F.col("ending")
    no_terminal = ending.isin(endings.OPEN, endings.MARKED) | (ending == endings.NATURAL) & ~F.col("firm")
    read = F.coalesce(F.col("proof"), F.when(ending == endings.MARKED, "mark"), F.when((ending == endings.OPEN) & F.col("stock").isNull(), "open_end"))
    return known.withColumn("reason", F.when(at_spike & no_terminal, "spike").otherwise(read))


def all_values(journals: DataFrame, events: DataFrame, spans: DataFrame, agents: bool = False) -> DataFrame:
    return settled(journal_values(journals).unionByName(event_values(events)).unionByName(span_values(spans, agents)))


def cut_values(values: DataFrame) -> DataFrame:
    """(source_field, row_key, call_no) of the cut values; repeats of events and spans once."""
    found = judged(values).where("reason is not null").select("source_field", "row_key", "call_no")
    journals = F.col("source_field") == "decision_journals.prompt_preview"
    return found.where(journals).unionByName(found.where(~journals).distinct())


def cut_shares(values: DataFrame) -> DataFrame:
    """Per source, column and agent or event type: values, cut ones by reason (the first of ``REASONS`` of a value's copies) and their share; repeats once."""
    place = F.array_position(F.array(*(F.lit(r) for r in REASONS)), F.col("reason"))
    once = judged(values).where((F.col("ending") != endings.NOTHING) | F.col("reason").isNotNull()).groupBy("source_field", "row_key", "call_no").agg(F.min("column").alias("column"), F.min("grp").alias("grp"), F.min(place).alias("place"))
    by = ["source_field", "column", "grp"]
    out = once.groupBy(*by).agg(F.count(F.lit(1)).alias("n_values"), F.count("place").alias("n_cut"), *(F.count_if(F.col("place") == i + 1).alias(f"n_{r}") for i, r in enumerate(REASONS)))
    return out.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
