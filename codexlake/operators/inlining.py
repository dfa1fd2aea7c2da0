"""Nested records to related flat tables: shared inlining over the schema graph found in the data.

The schema graph (which element stands in which, and how often) is gathered from all records.  Elements
that occur at most once in a single kind of parent are inlined into that parent's table; elements that
repeat, that several parents share or that contain themselves get a table of their own, whose rows carry
the key of the row around them.  Records are walked without recursion and expanded level by level, so any
depth is read, and what no wanted table can hold is never expanded.  Only the graph's edges are shuffled.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import durable, release

#: Kinds of children a parent may have; the names under one that has more are values, and its children are told apart by no name.
MAX_KINDS = 1_000
#: Name of the children of such a parent; their own names become the field ``#name``.
ANY = "*"
_SHRED_SCHEMA = "record_id string, table_name string, row_id bigint, position int, parent_table string, parent_row_id bigint, via string, ancestors map<string,string>, fields map<string,string>"
_COLUMNS = ["record_id", "table_name", "row_id", "position", "parent_table", "parent_row_id", "via", "ancestors", "fields"]
#: Types of scalars from narrow to wide, as they stand in the graph; texts take all.
_TYPES = ("boolean", "bigint", "double", "string")


@dataclass(slots=True)
class Graph:
    """Edges ``(parent, child)`` with the most occurrences of the child in one parent, and the type of each ``(element, field)``."""

    edges: dict[tuple[str, str], int] = field(default_factory=dict)
    fields: dict[tuple[str, str], str] = field(default_factory=dict)

    def wide(self) -> set[str]:
        """Elements whose children's names are values."""
        return {p for p, n in Counter(p for p, _ in self.edges).items() if n > MAX_KINDS or (p, ANY) in self.edges}


def _json_type(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) and abs(value) < 2**63 else "double" if isinstance(value, float) else "string"


def _split_json(value: object, useful: set[str] | None = None) -> tuple[dict[str, object], list[tuple[str, object]]]:
    """Scalar fields of a JSON value and the elements in it, one level deep; elements of other than ``useful`` names are left out."""
    fields: dict[str, object] = {}
    children: list[tuple[str, object]] = []
    inside = isinstance(value, list)
    items: Iterable = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value)) if inside else (("value", value),)
    for key, v in items:
        if isinstance(v, dict):
            if useful is None or key in useful:
                children.append((key, v))
        elif isinstance(v, list):
            if useful is None or (inside and "item" in useful) or key in useful:
                children.extend([("item", v)] if inside else [(key, x) for x in v])
        elif v is not None:
            fields[key] = v
    return fields, children


_LOCAL: dict[str, str] = {}


def _local(name: str) -> str:
    if name not in _LOCAL:
        _LOCAL[name] = name.rpartition("}")[2]
    return _LOCAL[name]


def _split_xml(node: ET.Element, useful: set[str] | None = None) -> tuple[dict[str, object], list[tuple[str, object]]]:
    """Attributes (``@name``), text (``#text``) and following text (``#tail``) of an XML element, and the elements in it."""
    fields: dict[str, object] = {"@" + _local(k): v for k, v in node.attrib.items()}
    if node.text and not node.text.isspace():
        fields["#text"] = node.text
    if node.tail and not node.tail.isspace():
        fields["#tail"] = node.tail
    children = [(_local(c.tag), c) for c in node if isinstance(c.tag, str)]
    return fields, children if useful is None else [c for c in children if c[0] in useful]


def parse_json(text: str) -> dict | None:
    """A JSON object; None for anything else."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parse_xml(text: str) -> ET.Element | None:
    """An XML document below an element of its own; None if not well-formed."""
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return None
    top = ET.Element("record")
    top.append(root)
    return top


@dataclass(frozen=True, slots=True)
class Kind:
    """A format: how a text is parsed, how a value is split one level deep, and the type of a scalar."""

    parse: Callable[[str], object | None]
    split: Callable[..., tuple[dict[str, object], list[tuple[str, object]]]]
    type_of: Callable[[object], str]


KINDS = {"json": Kind(parse_json, _split_json, _json_type), "xml": Kind(parse_xml, _split_xml, lambda value: "string")}


def schema_graph(docs: DataFrame, text: str, kind: str) -> Graph:
    """The graph of all records.  A parent with more than ``MAX_KINDS`` kinds of children or fields has ``ANY`` in their place."""
    of = KINDS[kind]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most: dict[str, dict[str, int]] = {}
        types: dict[str, dict[str, int]] = {}
        known_lists: set[tuple] = set()
        for batch in batches:
            for value in batch["text"]:
                top = of.parse(value) if value is not None else None
                todo = [("record", top)] if top is not None else []
                while todo:
                    name, element = todo.pop()
                    fields, children = of.split(element)
                    known = types.setdefault(name, {})
                    for f, v in fields.items():
                        rank = _TYPES.index(of.type_of(v))
                        # Truth values and numbers have only texts in common.
                        held = known.get(f, rank)
                        known[f] = 3 if 0 in (held, rank) and held != rank else max(rank, held)
                    if len(known) > MAX_KINDS:
                        types[name] = {ANY: 3}
                    if children:
                        kinds = most.setdefault(name, {})
                        for child, n in Counter(c for c, _ in children).items():
                            child = ANY if ANY in kinds else child
                            kinds[child] = max(n, kinds.get(child, 0))
                        if len(kinds) > MAX_KINDS:
                            most[name] = kinds = {ANY: len(children)}
                        for c, x in children:
                            c = ANY if ANY in kinds else c
                            # Lists of numbers, such as points, are looked at once for each name and pattern of types.
                            if type(x) is list and (pattern := tuple(map(type, x))) and not {dict, list, str} & set(pattern) and None not in x and -(2**63) < min(x) and max(x) < 2**63:
                                if (c, pattern) in known_lists:
                                    continue
                                known_lists.add((c, pattern))
                            todo.append((c, x))
        rows = [(p, c, n, True) for p, cs in most.items() for c, n in cs.items()] + [(p, f, t, False) for p, fs in types.items() for f, t in fs.items()]
        yield pd.DataFrame(rows, columns=["parent", "child", "n", "edge"])

    found = docs.select(F.col(text).alias("text")).mapInPandas(edges, "parent string, child string, n long, edge boolean")
    widest = F.when(~F.col("edge") & (F.min("n") == 0) & (F.max("n") > 0), 3).otherwise(F.max("n"))
    summed = durable(found.groupBy("parent", "child", "edge").agg(widest.alias("n")))  # small, and read several times
    # A name that partitions found to be a value in different ways is a value; its parent keeps one row.
    wide = summed.groupBy("parent", "edge").agg(F.when((F.count(F.lit(1)) > MAX_KINDS) | (F.max(F.col("child") == ANY)), True).otherwise(False).alias("wide"), F.max("n").alias("top"))
    kept = summed.join(wide, ["parent", "edge"]).select("parent", F.when(F.col("wide"), ANY).otherwise(F.col("child")).alias("child"), "edge", F.when(F.col("wide"), F.when(F.col("edge"), F.greatest("top", F.lit(2))).otherwise(3)).otherwise(F.col("n")).alias("n")).distinct()
    # What stands only under names that are values has no place of its own in the graph.
    reached = kept.where("edge").select(F.col("child").alias("parent")).union(kept.sparkSession.createDataFrame([("record",)], "parent string")).distinct()
    out = Graph()
    for r in kept.join(reached, "parent", "left_semi").collect():
        if r.edge:
            out.edges[r.parent, r.child] = r.n
        else:
            out.fields[r.parent, r.child] = _TYPES[r.n]
    release(summed)
    return out


def tables_of(graph: Graph | Mapping[tuple[str, str], int], root: str = "record") -> set[str]:
    """Names with a table of their own: the root, and what is repeated, shared or recursive."""
    edges = graph.edges if isinstance(graph, Graph) else graph
    parents: dict[str, set[str]] = {}
    below: dict[str, set[str]] = {}
    for parent, child in edges:
        parents.setdefault(child, set()).add(parent)
        below.setdefault(parent, set()).add(child)

    def recursive(name: str) -> bool:
        seen, todo = set(), list(below.get(name, ()))
        while todo:
            x = todo.pop()
            if x == name:
                return True
            if x not in seen:
                seen.add(x)
                todo.extend(below.get(x, ()))
        return False

    return {root} | {c for (_, c), n in edges.items() if n > 1 or len(parents[c]) > 1 or recursive(c)}


def _useful(graph: Graph, tables: set[str], keep: set[str]) -> set[str]:
    """Names that lead to a kept table or are inlined into one."""
    above: dict[str, set[str]] = {}
    below: dict[str, set[str]] = {}
    for parent, child in graph.edges:
        above.setdefault(child, set()).add(parent)
        below.setdefault(parent, set()).add(child)
    out, todo = set(keep), list(keep)
    while todo:
        for x in above.get(todo.pop(), ()):
            if x not in out:
                out.add(x)
                todo.append(x)
    todo = list(keep)
    while todo:
        for x in below.get(todo.pop(), ()):
            if x not in tables and x not in out:
                out.add(x)
                todo.append(x)
    return out


def shred(docs: DataFrame, key: str, text: str, kind: str, tables: set[str], keep: set[str] | None = None, id_fields: tuple[str, ...] = ("id", "@id"), graph: Graph | None = None) -> DataFrame:
    """The rows of all tables (or of those in ``keep``) in one narrow pass.

    Columns: ``record_id``, ``table_name``, ``row_id`` (number of the element among the expanded ones of its
    record), ``position`` (among the elements of its name in its parent, from 0), ``parent_table`` and
    ``parent_row_id`` (the row around it), ``via`` (path of the inlined elements between them), ``ancestors``
    (table name to the id of the innermost such row around it) and ``fields`` (own scalars and those of inlined
    elements, under ``child.field``).  With a ``graph``, elements that no kept table can hold are not expanded.
    Records that are null, malformed or no object give nothing; null fields are left out; an empty table gives
    an empty result.
    """
    of = KINDS[kind]
    useful = _useful(graph, tables, keep) if graph is not None and keep is not None else None
    wide = graph.wide() if graph is not None else set()

    def scalars(fields: dict[str, object]) -> dict[str, str]:
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in fields.items()}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for record, value in zip(batch["record_id"], batch["text"], strict=True):
                top = of.parse(value) if value is not None else None
                if top is None:
                    continue
                number = 0
                todo: list[tuple] = [("record", None, top, 0, None, None, "", {})]
                while todo:
                    name, called, element, position, parent_table, parent_row, via, ancestors = todo.pop()
                    own, number = number, number + 1
                    first, children = of.split(element, None if name in wide else useful)
                    fields = scalars(first)
                    if called is not None:
                        fields["#name"] = called
                    around = ancestors
                    if own_id := next((fields[f] for f in id_fields if f in fields), None):
                        around = ancestors | {name: own_id}
                    inner = [("", name, children)]
                    nested = []
                    while inner:
                        prefix, parent, parts = inner.pop()
                        seen: Counter = Counter()
                        for child, x in parts:
                            known = ANY if parent in wide else child
                            if useful is not None and known not in useful:
                                continue
                            if known in tables:
                                nested.append((known, child if known == ANY else None, x, seen[known], name, own, prefix[:-1], around))
                                seen[known] += 1
                            else:
                                deeper, below = of.split(x, None if child in wide else useful)
                                fields |= {f"{prefix}{child}.{k}": v for k, v in scalars(deeper).items()}
                                if below:
                                    inner.append((f"{prefix}{child}.", child, below))
                    if keep is None or name in keep:
                        out.append((record, name, own, position, parent_table, parent_row, via, ancestors, fields))
                    todo.extend(reversed(nested))
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"parent_row_id": "Int64"})

    return docs.select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("text")).mapInPandas(rows, _SHRED_SCHEMA)


def field_types(graph: Graph, tables: set[str], name: str) -> dict[str, str]:
    """Fields of a table, those of inlined elements under ``child.field``, with their types."""
    out: dict[str, str] = {}
    todo = [("", name)]
    while todo:
        prefix, element = todo.pop()
        out |= {prefix + f: t for (e, f), t in graph.fields.items() if e == element and f != ANY}
        todo += [(f"{prefix}{c}.", c) for p, c in graph.edges if p == element and c not in tables and c != ANY]
    return dict(sorted(out.items()))


def typed_table(rows: DataFrame, graph: Graph, tables: set[str], name: str) -> DataFrame:
    """The table ``name`` of shredded rows with a column for each field, typed by the graph.

    The key is ``record_id``, ``row_id``; ``parent_table`` and ``parent_row_id`` point to the row around it.
    Fields beyond those the graph names (of elements whose names are values) stay in ``fields``.
    """
    f = F.col("fields")
    types = field_types(graph, tables, name)
    columns = [f[k].try_cast(t).alias(k) for k, t in types.items()]
    other = F.map_filter("fields", lambda k, _: ~k.isin(*types)) if types else f
    return rows.where(F.col("table_name") == name).select("record_id", "row_id", "parent_table", "parent_row_id", "position", "via", *columns, F.when(F.size(other) > 0, other).alias("fields"))


def shred_array(df: DataFrame, key: str, array: str, parent: str | None = None) -> DataFrame:
    """The elements of an array column as child rows, JVM-side: ``record_id``, ``position`` and the element's parts.

    An array of pairs gives ``x`` and ``y``; null and empty arrays give nothing.  A point with fewer than two
    numbers has nulls in their place.
    """
    ids = [F.col(key).cast("string").alias("record_id")] + ([F.col(parent).alias("parent_id")] if parent else [])
    exploded = df.select(*ids, F.posexplode(array).alias("position", "item"))
    return exploded.select(*[c for c in exploded.columns if c != "item"], F.get("item", F.lit(0)).alias("x"), F.get("item", F.lit(1)).alias("y"))
