"""Deeply nested records as related flat tables, by shared inlining.

The schema graph of JSON columns has an element for each key that holds objects; one pass over the
data finds it (:func:`schema_graph`), and :func:`layout` lays out the tables from it. Elements
that repeat, have several parents or contain themselves get a table of their own; all
other descendants are inlined as columns of the nearest such ancestor. Values in arrays are rows
of a table of values. Every row keeps the record it comes from and, as a path of positions, its
own place and that of its parent.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose objects are numbered as nodes of one tree, whatever the schema graph shows (fixed values).
LINKS = ("children", "child", "extent")

_TOKEN = re.compile(r"[ \t\n\r]*(?:([\[\]{},:])|(\")|(true|false|null)|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))")
_BLANK = re.compile(r"[ \t\n\r]*")


def _no_constant(name: str):
    raise ValueError(name)


def _parse_deep(text: str):
    """JSON without recursion, for values nested deeper than the interpreter's stack."""
    stack: list = []  # (container, pending key)
    at, state, value = 0, "value", None
    while True:
        if state == "done":
            if _BLANK.match(text, at).end() != len(text):
                raise ValueError("more after the value")
            return value
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at, (mark, quote, word, number) = m.end(), m.groups()
        if state == "next":
            box = stack[-1][0]
            if mark == ",":
                state = "key" if isinstance(box, dict) else "value"
            elif mark == ("}" if isinstance(box, dict) else "]"):
                value, state = stack.pop()[0], "close"
            else:
                raise ValueError(f"unexpected token at {at}")
        elif state in ("key", "first key"):
            if quote:
                stack[-1][1], at = scanstring(text, at, True)
                colon = _TOKEN.match(text, at)
                if not colon or colon.group(1) != ":":
                    raise ValueError(f"no colon at {at}")
                at, state = colon.end(), "value"
            elif mark == "}" and state == "first key":
                value, state = stack.pop()[0], "close"
            else:
                raise ValueError(f"no key at {at}")
        elif mark == "{":
            stack.append([{}, None])
            state = "first key"
        elif mark == "[":
            stack.append([[], None])
            state = "first value"
        elif mark == "]" and state == "first value":
            value, state = stack.pop()[0], "close"
        elif quote:
            (value, at), state = scanstring(text, at, True), "close"
        elif word or number:
            value, state = json.loads(word or number), "close"
        else:
            raise ValueError(f"unexpected token at {at}")
        if state == "close":
            if not stack:
                state = "done"
                continue
            box, key = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            state = "next"


def read_json(text: str | None):
    """The value of a JSON text; a value quoted as a string is read once more; None if it is not JSON."""
    for _ in range(2):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            try:
                text = _parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return None if isinstance(text, str) else text


def _objects(place) -> list[dict]:
    return [place] if isinstance(place, dict) else [x for x in place if isinstance(x, dict)] if isinstance(place, list) else []


def edges_of(value):
    """(element, key, whether an object, whether in an array) for everything below a value's objects; '' is the element at the top."""
    todo = [("", n) for n in _objects(value)]
    while todo:
        element, box = todo.pop()
        for k, v in box.items():
            for x, many in ((x, True) for x in v) if isinstance(v, list) else ((v, False),):
                yield element, k, isinstance(x, dict), many
                if isinstance(x, dict):
                    todo.append((k, x))


def layout(edges, links: tuple[str, ...] = LINKS) -> frozenset[str]:
    """The elements that get a table: those in ``links``, and all that repeat, have several parents or contain themselves.

    ``edges`` are (element, key, whether an object, whether in an array), of any number of columns.
    """
    parents: dict[str, set[str]] = {}
    tables = set(links)
    for element, key, is_object, many in edges:
        if is_object:
            parents.setdefault(key, set()).add(element)
            if many:
                tables.add(key)
    for key, above in parents.items():
        if len(above) > 1:
            tables.add(key)
        seen, todo = set(), list(above)
        while todo:
            e = todo.pop()
            if e not in seen:
                seen.add(e)
                todo.extend(parents.get(e, ()))
        if key in seen:
            tables.add(key)
    return frozenset(tables)


def nodes_of(value, links: tuple[str, ...] = LINKS, tables: frozenset[str] = frozenset(LINKS)):
    """(path, parent path, key, inlined attributes, repeated values) of every row of a value's tables, parents first.

    Objects of elements without a table are inlined under dotted names, however deep; values in
    arrays come as (name, position, text). Objects of ``links`` directly in a row are numbered on from one link
    to the next, in the order of ``links``; those of other tables have the path ``parent/name.position``.
    """
    todo = [(str(i), "", "", n) for i, n in enumerate(_objects(value), 1)][::-1]
    while todo:
        path, parent, link, node = todo.pop()
        flat: dict[str, str | None] = {}
        many: list[tuple[str, int, str | None]] = []
        below = [(key, child) for key in links for child in _objects(node.get(key))]
        rows = [(f"{path}.{i}", path, key, child) for i, (key, child) in enumerate(below, 1)]
        inner = [("", node)]
        while inner:
            prefix, box = inner.pop()
            for k, v in box.items():
                name = f"{prefix}{k}"
                linked = not prefix and k in links
                if isinstance(v, dict):
                    if linked:
                        continue
                    if k in tables:
                        rows.append((f"{path}/{name}.1", path, k, v))
                    else:
                        inner.append((f"{name}.", v))
                elif isinstance(v, list):
                    for i, x in enumerate(v, 1):
                        if isinstance(x, dict):
                            if not linked:
                                rows.append((f"{path}/{name}.{i}", path, k, x))
                        elif isinstance(x, str) or not linked:
                            many.append((name, i, x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)))
                elif not linked or (isinstance(v, str) and v):
                    flat[name] = v if isinstance(v, str) or v is None else json.dumps(v)
        yield path, parent, link, flat, many
        todo.extend(rows[::-1])


_NODE = "doc_id string, field string, node string, parent string, link string, attributes map<string,string>, items array<struct<name:string,position:int,value:string>>"


def _last(docs: DataFrame, columns: list[str]) -> DataFrame:
    at = [F.col("loaded_at").cast("timestamp").alias("at")] if "loaded_at" in docs.columns else []
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.struct(*at, *[F.col(c) for c in columns]).alias("x"))
    return given.groupBy("doc_id").agg(F.max("x").alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(c) for c in columns])


def schema_graph(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The schema graph that the data show: ``field``, ``element``, ``name``, ``is_object``, ``many``, ``n``.

    A row says how many values a key has in objects of an element, apart for objects and others, and for
    single values and those in arrays. Every task sums up first: what is shuffled has the size of the schema.
    """

    def run(batches):
        n: dict[tuple, int] = {}
        for batch in batches:
            for field in columns:
                for v in batch.column(field).to_pylist():
                    for edge in edges_of(read_json(v)) if v else ():
                        n[field, *edge] = n.get((field, *edge), 0) + 1
        c = list(zip(*((*edge, x) for edge, x in n.items()))) or [()] * 6
        yield pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()))], ["field", "element", "name", "is_object", "many", "n"])

    edges = _last(docs, columns).mapInArrow(run, "field string, element string, name string, is_object boolean, many boolean, n long")
    return edges.groupBy("field", "element", "name", "is_object", "many").agg(F.sum("n").alias("n"))


def tables_of(graph: DataFrame, links: tuple[str, ...] = LINKS) -> frozenset[str]:
    """The layout of a schema graph; the driver gets rows of the schema's size."""
    return layout([(r["element"], r["name"], True, r["many"]) for r in graph.where("is_object").collect()], links)


def stored(graph: DataFrame, tables: frozenset[str]) -> DataFrame:
    """The schema graph with ``stored``: whether what a key holds becomes rows of a table or a column."""
    row = F.when(F.col("is_object"), F.col("name").isin(*tables)).otherwise(F.col("many"))
    return graph.withColumn("stored", F.when(row, "table").otherwise("column"))


def shred(docs: DataFrame, columns: list[str], links: tuple[str, ...] = LINKS, tables: frozenset[str] | None = None) -> DataFrame:
    """All rows of the tables of JSON columns: ``doc_id``, ``field``, ``node``, ``parent``, ``link``, ``attributes``, ``items``.

    Which elements get rows and which are inlined is decided by the schema graph (``tables``; if it isn't
    given, a pass over the data finds it). Rows are the objects at the top of a value, those under a row's ``links``, and
    those of all other elements with a table; each such place is one object or an array, of which only the objects count.
    ``link`` is the key ('' at the top). ``node`` is the path of positions from 1, ``parent`` that of the parent, '' at the top. The last
    delivery of a document counts (ties: the greatest values). Null, empty and cut-off values (not JSON) have no
    rows, a value quoted as a JSON string is read once more, of repeated keys of an object the last
    holds, and there is no limit to the depth. Arrays inside arrays stay JSON texts. Null ids are left out; an
    empty table gives no rows; further columns are ignored.
    """
    laid_out = tables_of(schema_graph(docs, columns), links) if tables is None else tables

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for field in columns:
                rows = [(d, field, *n) for d, v in zip(ids, batch.column(field).to_pylist()) if v for n in nodes_of(read_json(v), links, laid_out)]
                c = list(zip(*rows)) or [()] * 7
                yield pa.record_batch(
                    [*(pa.array(c[i], pa.string()) for i in range(5)), pa.array([list(a.items()) for a in c[5]], pa.map_(pa.string(), pa.string())),
                     pa.array([[dict(zip(("name", "position", "value"), m)) for m in x] for x in c[6]], pa.list_(pa.struct([("name", pa.string()), ("position", pa.int32()), ("value", pa.string())])))],
                    ["doc_id", "field", "node", "parent", "link", "attributes", "items"],
                )

    return _last(docs, columns).mapInArrow(run, _NODE)


def list_entries(docs: DataFrame, column: str) -> DataFrame:
    """Distinct entries of a list column: ``doc_id``, ``field``, ``node``, ``parent`` ('').

    An entry may hold several ids parted by blanks; null and empty ones are left out.
    """
    each = F.explode(F.array_distinct(F.flatten(F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: F.split(x, r"\s+")))))
    return _last(docs, [column]).select("doc_id", F.lit(column).alias("field"), each.alias("node"), F.lit("").alias("parent")).where("node <> ''")


def singletons(graph: DataFrame, tables: frozenset[str]) -> list[str]:
    """The names of inlined attributes, dotted through elements without a table, in order: from the schema graph alone.

    A name that is an array elsewhere counts too: its single values are in no table of repeated ones.
    """
    rows = graph.where("not is_object and not many").select("element", "name").distinct().collect()
    above: dict[str, set[str]] = {}
    for r in graph.where("is_object and not many").select("element", "name").distinct().collect():
        above.setdefault(r["name"], set()).add(r["element"])

    def prefixes(element: str) -> list[str]:
        if not element or element in tables:
            return [""]
        return [f"{p}{element}." for e in sorted(above.get(element, ())) for p in prefixes(e)]  # ends: what contains itself has a table

    return sorted({f"{p}{r['name']}" for r in rows for p in prefixes(r["element"]) if p or r["name"] not in LINKS})


_KEYS = ("doc_id", "field", "node", "parent", "link")


def column_names(names: list[str]) -> list[str]:
    """A column name for each attribute, dots as underscores; those taken already, in any case of letters, get a number."""
    used, out = set(_KEYS), []
    for n in names:
        plain = c = n.replace(".", "_") or "_"
        i = 2
        while c.lower() in used:
            c, i = f"{plain}_{i}", i + 1
        used.add(c.lower())
        out.append(c)
    return out


def inlined(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The table of nodes with one column for each attribute name, null where a node lacks it."""
    return nodes.select(*_KEYS, *[F.element_at("attributes", F.lit(n)).alias(c) for n, c in zip(names, column_names(names))])


def repeated(nodes: DataFrame) -> DataFrame:
    """The table of repeated attribute values; (doc_id, field, node) is the key of their node."""
    return nodes.select("doc_id", "field", "node", F.explode("items").alias("i")).select("doc_id", "field", "node", "i.name", "i.position", "i.value")
