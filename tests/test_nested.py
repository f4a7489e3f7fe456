import json

import __spark_entry__ as entry
from pyspark.sql import Row

from stemma.operators import nested

from .conftest import rows

VALUES = {
    "lone": '{"tag":"a","child":{"tag":"b","extent":["x",null,{"unit":"line","precision":{"degree":"low","by":{"hand":3}}}]}}',
    "many": '[{"children":[{"t":1},null,"s",[{"t":9}],{"t":2}]},null,"bare",{"reason":"r"}]',
    "quoted": json.dumps('[{"a":1}]'),
    "twice": json.dumps(json.dumps('[{"a":1}]')),
    "cut": '[{"a":1},{"b"',
    "empty": "",
    "null": None,
    "scalar": "5",
    "nan": '[{"a":NaN}]',
    "none": "[]",
}


def frame(spark, values, **more):
    return spark.createDataFrame([Row(doc_id=k, supplied=v, gap=None, node="clash", parent=1, field=None, **more) for k, v in values.items()], "doc_id string, supplied string, gap string, node string, parent int, field string")


def test_nodes(spark):
    got = rows(nested.shred(frame(spark, VALUES), ["supplied", "gap"]), "doc_id", "field", "node", "parent", "link")
    assert got == [
        ("lone", "supplied", "1", "", ""), ("lone", "supplied", "1.1", "1", "child"), ("lone", "supplied", "1.1.1", "1.1", "extent"),
        ("many", "supplied", "1", "", ""), ("many", "supplied", "1.1", "1", "children"), ("many", "supplied", "1.2", "1", "children"), ("many", "supplied", "2", "", ""),
        ("quoted", "supplied", "1", "", ""),
    ]


def test_attributes_and_items(spark):
    n = nested.shred(frame(spark, VALUES), ["supplied"])
    flat = {(r["doc_id"], r["node"]): r for r in nested.inlined(n, ["tag", "unit", "precision.by.hand"]).collect()}
    assert flat["lone", "1.1.1"]["precision_by_hand"] == "3" and flat["lone", "1.1"]["tag"] == "b" and flat["lone", "1"]["unit"] is None
    assert ("lone", "supplied", "1.1", "extent", 1, "x") in rows(nested.repeated(n))
    graph = nested.schema_graph(frame(spark, VALUES), ["supplied"])
    assert ("supplied", "precision", "degree", False, False, 1) in rows(graph, "field", "element", "name", "is_object", "many", "n")
    tables = nested.tables_of(graph)
    assert tables == {"children", "child", "extent"} and {"precision.degree", "precision.by.hand", "tag", "unit"} <= set(nested.singletons(graph, tables))


def test_layout():
    one, many = (True, False), (True, True)
    assert nested.layout([("", "a", *one), ("a", "b", *one), ("a", "x", False, True)], ()) == set()
    assert nested.layout([("", "a", *many)], ()) == {"a"}
    assert nested.layout([("", "a", *one), ("", "c", *one), ("a", "b", *one), ("c", "b", *one)], ()) == {"b"}
    assert nested.layout([("", "a", *one), ("a", "b", *one), ("b", "a", *one)], ()) == {"a", "b"}
    assert nested.layout([("", "a", *one)], ("child",)) == {"child"}


def test_objects_in_arrays_are_rows(spark):
    values = {"a": '{"who":[{"name":"x","roles":[{"r":1},{"r":2},5]},null,{"name":"y"}],"place":{"at":{"lat":1.5}},"child":{"place":{"at":{"lat":2}}}}'}
    n = nested.shred(frame(spark, values), ["supplied"])
    got = {r["node"]: (r["parent"], r["link"], dict(r["attributes"])) for r in n.collect()}
    assert got == {
        "1": ("", "", {}),
        "1.1": ("1", "child", {}),
        "1/who.1": ("1", "who", {"name": "x"}), "1/who.3": ("1", "who", {"name": "y"}),
        "1/who.1/roles.1": ("1/who.1", "roles", {"r": "1"}), "1/who.1/roles.2": ("1/who.1", "roles", {"r": "2"}),
        "1/place.1": ("1", "place", {"at.lat": "1.5"}), "1.1/place.1": ("1.1", "place", {"at.lat": "2"}),
    }
    assert rows(nested.repeated(n), "node", "name", "position", "value") == [("1", "who", 2, None), ("1/who.1", "roles", 3, "5")]


def test_every_singleton_is_a_column(spark, tmp_path):
    values = {"a": '[{"tag":"x","n":7,"cert":"low","children":[{"Tag":"y","node":"z","deep":{"er":{"est":true}},"both":"one"}]}]', "b": '[{"both":["p","q"]}]'}
    frame(spark, values).drop("node", "parent", "field").write.parquet(str(tmp_path / "corpus.parquet"))
    nodes = entry.queries()["p6_nodes"](spark, str(tmp_path))
    nodes.write.parquet(str(tmp_path / "out"))  # no two names differ in case alone
    got = {(r["doc_id"], r["node"]): {k: v for k, v in r.asDict().items() if v is not None} for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    at = lambda doc, node, parent, link: {"doc_id": doc, "field": "supplied", "node": node, "parent": parent, "link": link}
    assert got == {
        ("a", "1"): at("a", "1", "", "") | {"tag_2": "x", "n": "7", "cert": "low"},
        ("a", "1.1"): at("a", "1.1", "1", "children") | {"Tag": "y", "node_2": "z", "deep_er_est": "true", "both": "one"},
        ("b", "1"): at("b", "1", "", ""),
    }
    assert rows(entry.queries()["p6_items"](spark, str(tmp_path)), "doc_id", "name", "position", "value") == [("b", "both", 1, "p"), ("b", "both", 2, "q")]


def test_last_delivery_and_repeats(spark):
    d = spark.createDataFrame([("a", '[{"x":1}]', "2020-01-01"), ("a", '[{"x":1},{"y":1}]', "2021-01-01"), ("a", '[{"x":1},{"y":1}]', "2021-01-01"), (None, "[{}]", "2021-01-01")], "doc_id string, s string, loaded_at string")
    assert rows(nested.shred(d, ["s"]), "doc_id", "node") == [("a", "1"), ("a", "2")]


def test_deep(spark):
    deep = 30_000
    got = nested.shred(frame(spark, {"d": '{"child":' * deep + "{}" + "}" * deep}), ["supplied"])
    assert got.count() == deep + 1


def test_deep_parser_agrees():
    for v in [x for x in VALUES.values() if x] + ['{"a":{"b":[1,2.5e3,true,null,"\\u03b1"]},"c":[]}', "[1,]", '{"a" 1}', "{,}", "[1 2]", "nul", '{"a":1}x', "[[[]]]", '"s"']:
        try:
            want = json.loads(v, parse_constant=nested._no_constant)
        except ValueError:
            want = ValueError
        try:
            got = nested._parse_deep(v)
        except ValueError:
            got = ValueError
        assert got == want, v


def test_lists(spark):
    d = spark.createDataFrame([("a", ["1 2", "2", None, "", " 3 "]), ("b", []), ("c", None), ("a", ["1 2", "2", None, "", " 3 "])], "doc_id string, hgv array<string>")
    assert rows(nested.list_entries(d, "hgv")) == [("a", "hgv", "1", ""), ("a", "hgv", "2", ""), ("a", "hgv", "3", "")]


def test_empty(spark):
    assert rows(nested.shred(frame(spark, {}), ["supplied", "gap"])) == []
