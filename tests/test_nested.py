import json
from collections import Counter

import pytest

from tracewright.operators import nested

USAGE = "map<string,bigint>"
SCHEMA = f"record_id long, model_calls array<struct<model_id:string,prompt_preview:string,cot_reasoning:string,token_usage:{USAGE},latency_ms:double>>, tool_calls array<struct<tool_name:string,tool_args:string,result:string,duration_ms:double>>, node_path string"


def brute(args, call):
    """Nodes of one argument text, recursively."""
    try:
        value = json.loads(args) if args is not None else None
        while isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        return []
    out = []

    def go(v, path, parent):
        if isinstance(v, dict):
            out.append((parent, path))
            for k, x in v.items():
                go(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", parent)

    go(value, f"tool_calls[{call}].tool_args", f"tool_calls[{call}]")
    return out


ARGS = [
    "{}", '{"a":1}', '{"a":{"b":[{"c":{}},[{"d":1},2]]}}', '[{"x":{}}, 3, [{"y":1}]]', '"{\\"q\\":{\\"r\\":1}}"', '"no json inside"', '{"broken":', "null", "5", None, "", "[]",
    '{"k":1,"k":{"z":2}}', '{"v":NaN}', '{"deep":' * 3 + "{}" + "}" * 3, json.dumps(json.dumps({"twice": {"held": 1}})), '{"é中":{"b c":{}}}',
]


def test_against_brute_force(spark):
    rows = [(1, [("m", "p", "c", {"in": 1}, 1.0), ("m", None, None, {}, None), None], [("t", a, "r", 1.0) for a in ARGS], "clash"), (2, None, [], "clash"), (3, [("m", "p", "c", None, 0.0)], None, None)]
    got = Counter((r["record_id"], r["parent_path"], r["node_path"]) for r in nested.flatten(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter([(1, "", f"model_calls[{i}]") for i in range(3)] + [(1, "model_calls[0]", "model_calls[0].token_usage"), (3, "", "model_calls[0]")])
    for i, a in enumerate(ARGS):
        want[1, "", f"tool_calls[{i}]"] += 1
        want.update((1, p, n) for p, n in brute(a, i) if a != '{"v":NaN}')
    assert got == want


def test_labels_cut_to_the_parent(spark):
    rows = [(1, None, [("t", '{"a":[{"b":{}}]}', "r", 1.0)], None)]
    nodes = {r["node_path"]: r for r in nested.flatten(spark.createDataFrame(rows, SCHEMA)).collect()}
    child, parent = nodes["tool_calls[0].tool_args.a[0].b"], nodes["tool_calls[0].tool_args.a[0]"]
    assert child["parent_path"] == parent["node_path"] and child["parent_dewey"] == parent["dewey"] == child["dewey"][: len(parent["dewey"])]
    for n in nodes.values():  # every parent is a node or the journal, and no node lies between
        above = [m["dewey"] for m in nodes.values() if n["dewey"][: len(m["dewey"])] == m["dewey"] and m is not n]
        assert n["parent_dewey"] == max(above, key=len, default=[])
    assert child["table_path"] == "tool_calls[].tool_args.a[].b"


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, None, [("t", "{}", "r", 1.0)], None)] * 2
    assert nested.flatten(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert nested.flatten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("depth", [10, 5000])
def test_any_depth(depth):
    text = '{"a":' * depth + "{}" + "}" * depth
    assert sum(1 for _ in nested.walk(nested.read_json(text), (1, 0), "tool_calls[0]", "tool_calls[]")) == depth + 1


def test_own_parser_agrees():
    for a in ARGS:
        if a is None:
            continue
        try:
            want = json.loads(a, parse_constant=nested._refuse)
        except ValueError:
            want = "invalid"
        try:
            got = nested._deep(a)
        except ValueError:
            got = "invalid"
        assert got == want, a


def test_flat_rows_lose_nothing(spark):
    args = ['{"ids":[1,null,"x"],"o":[],"d":{"v":[[2],{"k":[true]}]}}', "[1,[],{}]", "[]", '{"broken":', "5", None, "null", ""]
    rows = [(4, [("m", "p", "c", {"in": 1}, 1.0)], [("t", a, "r", 1.0) for a in args] + [None], "clash")]
    got = {r["node_path"]: r for r in nested.flat_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = {p: json.loads(r["attributes"]) for p, r in got.items()}
    a, b = "tool_calls[0].tool_args", "tool_calls[1].tool_args"
    elements = {f"{a}.ids[0]": 1, f"{a}.ids[1]": None, f"{a}.ids[2]": "x", f"{a}.d.v[0][0]": 2, f"{a}.d.v[1].k[0]": True, f"{b}[0]": 1, f"{b}[1]": []}
    assert {p: v["value"] for p, v in held.items() if "ordinal" in v} == elements
    assert got[f"{a}.d.v[1].k[0]"]["parent_path"] == f"{a}.d.v[1]" and got[f"{b}[0]"]["parent_path"] == "tool_calls[1]" and got[f"{a}.ids[2]"]["table_path"] == "tool_calls[].tool_args.ids[]"
    assert held[a] == {"o": []} and held[""] == {"node_path": "clash"} and got[""]["parent_path"] is None and got[""]["table_path"] == "journals"
    assert [held[f"tool_calls[{i}]"].get("tool_args") for i in range(9)] == [None, None, "[]", '{"broken":', "5", None, "null", "", None]
    assert len(got) == 1 + 2 + 9 + len(elements) + 4


def test_typed_tables(spark, tmp_path):
    rows = [(1, [("m", "p", "c", {"in": 1}, 1.0)], [("t", '{"a":1,"node_path":"x","d":{"v":[1.5]}}', "r", 1.0), ("u", '{"a":2}', None, None)], "clash")]
    flat = nested.flat_rows(spark.createDataFrame(rows, SCHEMA))
    args = {r["node_path"]: r for r in nested.typed(flat, "tool_calls[].tool_args").collect()}
    assert args["tool_calls[1].tool_args"]["a"] == 2 and args["tool_calls[0].tool_args"]["node_path_"] == "x" and args["tool_calls[0].tool_args"]["parent_path"] == "tool_calls[0]"
    assert [r["value"] for r in nested.typed(flat, "tool_calls[].tool_args.d.v[]", {"ordinal": "int", "value": "double"}).collect()] == [1.5]
    assert nested.typed(flat, "nowhere").count() == 0
    nested.write_tables(flat, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("table_path = 'tool_calls[]'").count() == 2
