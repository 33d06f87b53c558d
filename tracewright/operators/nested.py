"""Nested records as flat tables that keep their parents.

Every node (a call, a usage map, a JSON object inside the arguments) carries a Dewey label: the ordinals
on the way down from the journal, e.g. ``[1, 2, 0, 3]`` for the fourth member of the arguments of tool
call 2. Arrays take a place in the label but are no nodes, so a node's parent is found by cutting its
label back until it is that of a node; what the parent is called is looked up by its label.
Nodes with the same schema path (the path without array positions) form one table.

The flat tables (``flat_rows``) hold all of it: besides the nodes, a row for each journal and for each array element that is no
object, a table of their own with ordinal and value; empty arrays stay in their object, and arguments in which
there is no object or array, readable or not, on the row of their call.

Defined results: null and empty arrays give no nodes; a null element of a call array is still a node;
null or invalid JSON has no nodes below its call; JSON inside a JSON string counts as the root, however
often it is wrapped; of repeated keys in one object the last one counts; rows that occur twice give their
nodes twice. Nesting of any depth is read, without recursion where the standard parser gives up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

NODE = "record_id long, dewey array<int>, parent_dewey array<int>, table_path string, node_path string, parent_path string, attributes string"
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)")
_BLANK = re.compile(r"[ \t\r\n]*")


def _refuse(name: str):
    raise ValueError(name)


def _deep(text: str):
    """JSON of any depth, read with an explicit stack; ValueError where it is invalid."""
    at, stack, done, value = _BLANK.match(text).end(), [], False, None
    while True:
        if not done:
            c = text[at : at + 1]
            if c in ("{", "["):
                box: dict | list = {} if c == "{" else []
                at = _BLANK.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, at, done = box, at + 1, True
                else:
                    stack.append([box, None])
                    if c == "{":
                        at = _key(text, at, stack)
                    continue
            elif c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
                done = True
            elif m := _SCALAR.match(text, at):
                value, at, done = json.loads(m[0]), m.end(), True
            else:
                raise ValueError("no value")
        at = _BLANK.match(text, at).end()
        if not stack:
            if at != len(text):
                raise ValueError("text after the value")
            return value
        box, key = stack[-1]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        c, at = text[at : at + 1], _BLANK.match(text, at + 1).end()
        if c == ",":
            done = False
            if isinstance(box, dict):
                at = _key(text, at, stack)
        elif c == ("}" if isinstance(box, dict) else "]"):
            value = stack.pop()[0]
        else:
            raise ValueError("no end")


def _key(text: str, at: int, stack: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    stack[-1][1], at = json.decoder.scanstring(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return _BLANK.match(text, at + 1).end()


def read_json(text: str | None):
    """The value held by ``text``, unwrapping strings that hold JSON; None where it is null or invalid."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_refuse)
        except RecursionError:
            try:
                value = _deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def _attributes(value: dict, whole: bool = False) -> str:
    return json.dumps({k: v for k, v in value.items() if not isinstance(v, (dict, list)) or whole and v == []}, ensure_ascii=False)


def walk(value, label: tuple[int, ...], path: str, table: str, whole: bool = False) -> Iterator[tuple[tuple[int, ...], str, str, str]]:
    """(label, table, path, attributes) of each object in ``value``, with ``whole`` also of each array element that is no object; parents come first.

    ``label`` and ``path`` are those of the enclosing call; the value itself hangs below it as one step.
    """
    todo = [(value, (*label, 0), path + ".tool_args", table + ".tool_args")]
    while todo:
        value, label, path, table = todo.pop()
        if isinstance(value, dict):
            yield label, table, path, _attributes(value, whole)
            below = [(v, (*label, i), f"{path}.{k}", f"{table}.{k}") for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list) and value:
            below = [(v, (*label, i), f"{path}[{i}]", f"{table}[]") for i, v in enumerate(value)]
            if whole:
                todo.extend(reversed(below))
                continue
        else:  # an element, or an empty array in one
            if whole:
                yield label, table, path, json.dumps({"ordinal": label[-1], "value": value}, ensure_ascii=False)
            continue
        below = [x for x in below if not (whole and x[0] == [])]
        todo.extend(x for x in reversed(below) if isinstance(x[0], (dict, list)))


def parent(label: tuple[int, ...], nodes: dict[tuple[int, ...], str]) -> tuple[int, ...]:
    """The nearest label above that is a node's."""
    above = label[:-1]
    while above not in nodes:
        above = above[:-1]
    return above


_COLUMNS = (("record_id", pa.int64()), ("dewey", pa.list_(pa.int32())), ("parent_dewey", pa.list_(pa.int32())), ("table_path", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("attributes", pa.string()))


def _argument_nodes(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    for batch in batches:
        for record, call, text in zip(*(batch.column(c).to_pylist() for c in ("record_id", "call_no", "tool_args")), strict=True):
            value = read_json(text)
            if whole and value == []:
                continue  # on the row of its call
            if not isinstance(value, (dict, list)):
                continue
            known = {(1, call): f"tool_calls[{call}]"}
            for label, table, path, held in walk(value, (1, call), known[1, call], "tool_calls[]", whole):
                above = parent(label, known)
                rows.append((record, label, above, table, path, known[above], held))
                known[label] = path  # an element has nothing below it
            if len(rows) >= 20_000:
                yield out()
    if rows:
        yield out()


def _node(*columns) -> F.Column:
    """dewey, steps of the parent's label, table_path, node_path, parent_path, attributes."""
    label, steps, *rest = columns
    return F.struct(label.alias("dewey"), F.slice(label, 1, steps).alias("parent_dewey"), *(c.alias(n) for n, c in zip(("table_path", "node_path", "parent_path", "attributes"), rest, strict=True)))


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_argument_nodes`` with everything, and with the row of each call, which holds the arguments that are no nodes."""
    for batch in batches:
        held = []
        for text, own in zip(batch.column("tool_args").to_pylist(), batch.column("own").to_pylist(), strict=True):
            value = read_json(text)
            bare = text is not None and (value == [] or not isinstance(value, (dict, list)))
            more = f'"tool_args":{json.dumps(text, ensure_ascii=False)}' if bare else ""
            held.append(own[:-1] + ("," if more and own != "{}" else "") + more + "}")
        call_no = batch.column("call_no").to_pylist()
        columns = [batch.column("record_id"), pa.array([[1, c] for c in call_no], pa.list_(pa.int32())), pa.array([[]] * len(call_no), pa.list_(pa.int32())), pa.array(["tool_calls[]"] * len(call_no)), pa.array([f"tool_calls[{c}]" for c in call_no]), pa.array([""] * len(call_no)), pa.array(held, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [n for n, _ in _COLUMNS])
        yield from _argument_nodes(iter([batch]), True)


def flat_rows(journals: DataFrame) -> DataFrame:
    """All rows of all flat tables (see ``NODE``), with nothing left out: journals (``journals``, the path ''), nodes and elements; map-only."""
    plain = [c for c in journals.columns if c not in ("record_id", "model_calls", "tool_calls")]
    held = F.to_json(F.struct(*plain)) if plain else F.lit("{}")
    own = journals.select("record_id", F.array().cast("array<int>").alias("dewey"), F.lit(None).cast("array<int>").alias("parent_dewey"), F.lit("journals").alias("table_path"), F.lit("").alias("node_path"), F.lit(None).cast("string").alias("parent_path"), held.alias("attributes"))
    calls = journals.select("record_id", F.posexplode("tool_calls").alias("call_no", "call"))
    given = calls.select("record_id", "call_no", "call.tool_args", F.to_json(F.struct("call.tool_name", "call.result", "call.duration_ms")).alias("own"))
    models = flatten(journals.withColumn("tool_calls", F.lit(None).cast(journals.schema["tool_calls"].dataType)))
    return own.unionByName(models).unionByName(given.mapInArrow(_whole_nodes, NODE))


def flatten(journals: DataFrame) -> DataFrame:
    """All nodes of all journals, one row each (see ``NODE``); map-only, nothing is shuffled."""
    one, zero = F.lit(1), F.lit(0)

    def of_model_call(call, i):
        i = i.cast("int")
        path = F.concat(F.lit("model_calls["), i.cast("string"), F.lit("]"))
        held = F.to_json(F.struct(*(call[c].alias(c) for c in ("model_id", "prompt_preview", "cot_reasoning", "latency_ms"))))
        usage = call["token_usage"]
        own = _node(F.array(zero, i), 0, F.lit("model_calls[]"), path, F.lit(""), held)
        used = _node(F.array(zero, i, zero), 2, F.lit("model_calls[].token_usage"), F.concat(path, F.lit(".token_usage")), path, F.to_json(usage))
        return F.when(F.size(usage) > 0, F.array(own, used)).otherwise(F.array(own))

    models = journals.select("record_id", F.explode(F.flatten(F.transform("model_calls", of_model_call))).alias("n")).select("record_id", "n.*")
    calls = journals.select("record_id", F.posexplode("tool_calls").alias("call_no", "call"))
    path = F.concat(F.lit("tool_calls["), F.col("call_no").cast("string"), F.lit("]"))
    held = F.to_json(F.struct("call.tool_name", "call.result", "call.duration_ms"))
    own = calls.select("record_id", _node(F.array(one, F.col("call_no")), 0, F.lit("tool_calls[]"), path, F.lit(""), held).alias("n")).select("record_id", "n.*")
    inside = calls.where("call.tool_args is not null").select("record_id", "call_no", "call.tool_args").mapInArrow(_argument_nodes, NODE)
    return models.unionByName(own).unionByName(inside)


def typed(rows: DataFrame, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One flat table: record_id, dewey, parent_dewey, node_path, parent_path and the attributes as typed columns.

    columns: names and types; by default as Spark infers them from all rows. Attributes named like a key column get an underscore.
    """
    keys = ["record_id", "dewey", "parent_dewey", "node_path", "parent_path"]
    own = rows.where(F.col("table_path") == path)
    if columns is None:
        # One row: the schema that all rows have in common.
        seen = own.agg(F.schema_of_variant_agg(F.parse_json("attributes")).alias("s")).first()["s"] or "VOID"
        read = DataType.fromDDL(re.sub(r"\bVOID\b", "STRING", seen.replace("OBJECT<", "STRUCT<"))) if seen.startswith("OBJECT<") else StructType()
        columns = {f.name: f.dataType.simpleString() for f in read.fields}
    if not columns:
        return own.select(*keys)
    held = F.from_json("attributes", ", ".join(f"`{n}` {t}" for n, t in columns.items()))
    return own.select(*keys, held.alias("held")).select(*keys, *(F.col("held")[n].alias(n + "_" * (n in keys)) for n in columns))


def write_tables(rows: DataFrame, folder: str) -> None:
    """All flat tables at once, laid out by schema path; a reader of one path reads only its files."""
    rows.write.mode("overwrite").partitionBy("table_path").parquet(folder)
