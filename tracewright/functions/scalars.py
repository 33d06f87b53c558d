"""Ids, statuses, times and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def journal_id(at: Column, *key: Column) -> Column:
    """``inv-<UTC day>-<6 hex>``, from the natural key so that a rerun gives the same id. 24 bits collide: use ``journal_key`` to join."""
    return F.concat(F.lit("inv-"), F.date_format(at, "yyyy-MM-dd"), F.lit("-"), F.left(journal_key(*key), F.lit(6)))


def journal_key(*key: Column) -> Column:
    return F.sha2(F.concat_ws("|", *key), 256)


def trace_id(*key: Column) -> Column:
    """32 hex digits."""
    return F.left(journal_key(*key), F.lit(32))


def elapsed_ms(start: Column, end: Column, whole: bool = False) -> Column:
    """Milliseconds between two times; ``whole`` drops fractions."""
    ms = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)
    return F.floor(ms).cast("double") if whole else ms


def status(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("ok"))


def kept_latency(c: Column, keep_zero: bool = True) -> Column:
    """A latency as an optional attribute; zero is either a value or absent."""
    return c if keep_zero else F.when(c > 0, c)


def verdict_message(message: Column, decision: Column, rule: Column, approval: Column | None = None) -> Column:
    """The message, or what was decided by which rule; with the outcome of a failed approval behind it."""
    text = F.coalesce(F.nullif(F.trim(message), F.lit("")), F.trim(F.concat(decision, F.lit(" by policy "), F.coalesce(rule, F.lit("")))))
    return text if approval is None else F.when(approval.isNotNull() & (approval != "approved"), F.concat(text, F.lit(" (approval "), approval, F.lit(")"))).otherwise(text)


def object_json(c: Column) -> Column:
    """JSON text if it holds an object, else ``{}``."""
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c).otherwise("{}")


def user_message(messages: Column) -> Column:
    """The user's text of a conversation, an array of (role, content string, blocks array of (text)).

    The last user message that has one wins: its first block with text, or its content if it has no blocks, an empty content
    too; blocks without text keep what was said before. Nothing said is ''.
    """
    def first_text(blocks: Column) -> Column:
        return F.get(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), F.lit(0))["text"]

    said = F.filter(messages, lambda m: m["role"] == "user")
    return F.aggregate(said, F.lit(""), lambda kept, m: F.when(m["blocks"].isNotNull(), F.coalesce(first_text(m["blocks"]), kept)).otherwise(F.coalesce(m["content"], kept)))


def block_text(blocks: Column) -> Column:
    """The texts of content blocks in order, blocks without text left out."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")


def result_text(blocks: Column, plain: Column, other: Column) -> Column:
    """Text of a tool result: its blocks, else a plain string, else the first 500 characters of anything else, else nothing."""
    return F.when(F.size(blocks) > 0, block_text(blocks)).when(plain.isNotNull(), plain).otherwise(F.coalesce(F.left(other, F.lit(500)), F.lit("")))
