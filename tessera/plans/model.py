"""Plans as data: value types, operator signatures, JSON text to plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

IR_VERSION = "0.2"
PORT = "result"

# Names that plans contain.
TYPES = ("Table", "Row", "RowSet", "Entity", "EntitySet", "Document", "DocumentSet", "String", "Number", "Date", "Boolean", "ValueSet")
ANSWER_TYPES = ("Entity", "EntitySet", "String", "Number", "Date", "Boolean", "ValueSet")
PREDICATES = ("eq", "contains", "in", "numeric_eq", "numeric_gt", "numeric_lt")
FUNCTIONS = ("count", "sum", "min", "max", "average")

# Our choice, where plans leave the value open.
RELATIONS = ("eq", "lt", "gt", "le", "ge")
SELECTIONS = ("min", "max")  # relations of a keyed set
ARITHMETIC = ("add", "subtract", "multiply", "divide")
NORMALIZATIONS = ("none", "casefold_trim")
UNITS = ("day", "month", "year")


@dataclass(frozen=True)
class Overload:
    """One way to call an operator: the types each input role accepts."""

    roles: dict[str, tuple[str, ...]]
    same: bool = False  # all inputs of one type


@dataclass(frozen=True)
class Operator:
    """Overloads, arguments with their allowed values (None: any), tool binding."""

    overloads: tuple[Overload, ...]
    arguments: dict[str, tuple | None]
    tool: str
    optional: dict[str, tuple | None] = field(default_factory=dict)


_ROWS = ("Table", "RowSet")
REGISTRY: dict[str, Operator] = {
    "FILTER": Operator((Overload({"table": ("Table",)}), Overload({"rows": ("RowSet",)})), {"predicate": None}, "table.filter"),
    "PROJECT": Operator((Overload({"table": ("Table",)}), Overload({"row": ("Row",)}), Overload({"rows": ("RowSet",)})), {"column": None, "mode": ("text", "links"), "cardinality": ("one", "many")}, "table.project"),
    "RETRIEVE": Operator((Overload({"entities": ("Entity", "EntitySet")}),), {}, "document.retrieve"),
    "EXTRACT": Operator((Overload({"documents": ("Document", "DocumentSet")}),), {"attribute": None, "value_type": ("String", "Number", "Date", "Entity", "Boolean"), "cardinality": ("one", "many")}, "document.extract"),
    "JOIN": Operator((Overload({"rows": ("RowSet", "Table"), "key": ("String", "Entity", "EntitySet", "ValueSet")}),), {"right_column": None, "match": ("exact", "normalized")}, "table.join"),
    "AGGREGATE": Operator((Overload({"values": ("ValueSet",)}), Overload({"entities": ("EntitySet",)}), Overload({"rows": ("RowSet",)})), {"function": FUNCTIONS}, "calculator.aggregate"),
    "COMPARE": Operator((Overload({"left": ("String", "Number", "Date", "Entity", "Boolean"), "right": ("String", "Number", "Date", "Entity", "Boolean")}, same=True), Overload({"values": ("ValueSet",)})), {"relation": RELATIONS + SELECTIONS, "return": ("boolean", "selection"), "tie_policy": ("error", "all")}, "calculator.compare", {"parse": ("Number", "Date", "String")}),
    "PARSE": Operator((Overload({"value": ("String",)}), Overload({"values": ("ValueSet",)})), {"target_type": ("Number", "Date")}, "calculator.parse"),
    "ARG_EXTREME": Operator((Overload({"table": ("Table",)}), Overload({"rows": ("RowSet",)})), {"column": None, "mode": ("min", "max"), "parse": ("Number", "Date", "String"), "tie_policy": ("error",)}, "table.arg_extreme"),
    "ARITHMETIC": Operator((Overload({"left": ("Number",), "right": ("Number",)}), Overload({"left": ("Date",), "right": ("Date",)})), {"function": ARITHMETIC}, "calculator.arithmetic", {"unit": UNITS}),
    "DISTINCT": Operator((Overload({"values": ("ValueSet",)}), Overload({"entities": ("EntitySet",)})), {"normalization": NORMALIZATIONS}, "calculator.distinct"),
}


def output_type(operator: str, arguments: dict, inputs: dict[str, str]) -> str:
    """The type that a node with valid inputs and arguments has."""
    only = next(iter(inputs.values()), "")
    many = arguments.get("cardinality") == "many"
    match operator:
        case "FILTER" | "JOIN":
            return "RowSet"
        case "PROJECT":
            return {("text", False): "String", ("text", True): "ValueSet", ("links", False): "Entity", ("links", True): "EntitySet"}[arguments["mode"], many]
        case "RETRIEVE":
            return "DocumentSet" if only == "EntitySet" else "Document"
        case "EXTRACT":
            return arguments["value_type"] if not many else "EntitySet" if arguments["value_type"] == "Entity" else "ValueSet"
        case "COMPARE":
            return "Boolean" if arguments["return"] == "boolean" else "Entity" if arguments["tie_policy"] == "error" else "EntitySet"
        case "PARSE":
            return arguments["target_type"] if only == "String" else "ValueSet"
        case "ARG_EXTREME":
            return "Row"
        case "DISTINCT":
            return only
    return "Number"


@dataclass(frozen=True)
class Parsed:
    plan: dict | None
    error: str | None


_FENCE = re.compile(r"^```(?:json)?\s*(.*?)\s*```$", re.S | re.I)


def _no_duplicates(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON number")


def parse_plan(text: str) -> Parsed:
    """The one JSON object in ``text``, a Markdown fence around it allowed; nothing is repaired."""
    text = text.strip()
    if m := _FENCE.match(text):
        text = m[1]
    try:
        found = json.loads(text, object_pairs_hook=_no_duplicates, parse_constant=_no_constant)
    except ValueError as e:
        return Parsed(None, str(e))
    return Parsed(found, None) if isinstance(found, dict) else Parsed(None, "not an object")


def dump_plan(plan: dict, indent: int | None = 2) -> str:
    return json.dumps(plan, ensure_ascii=False, indent=indent, sort_keys=True)
