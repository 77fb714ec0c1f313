"""Relations of the code graph and their kind vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


NODES = _struct(
    ("id", S, False), ("kind", S, False), ("name", S, False),
    ("qualified_name", S, True), ("file_path", S, False), ("language", S, False),
    ("start_line", I, True), ("end_line", I, True),
    ("start_column", I, True), ("end_column", I, True),
    ("docstring", S, True), ("signature", S, True), ("visibility", S, True),
    ("is_exported", B, True), ("is_async", B, True),
    ("is_static", B, True), ("is_abstract", B, True),
    ("decorators", T.ArrayType(S), True), ("type_parameters", T.ArrayType(S), True),
    ("return_type", S, True), ("updated_at", L, True), ("seq", I, True),
)

EDGES = _struct(
    ("source", S, False), ("target", S, False), ("kind", S, False),
    ("metadata", T.MapType(S, S), True),
    ("line", I, True), ("col", I, True), ("provenance", S, True),
)

FILES = _struct(
    ("path", S, False), ("content_hash", S, False), ("language", S, False),
    ("size", L, True), ("modified_at", L, True), ("indexed_at", L, True),
    ("node_count", I, True),
    ("errors", T.ArrayType(_struct(("message", S, True), ("severity", S, True))), True),
)

REFS = _struct(
    ("ref_id", S, False), ("from_node_id", S, False),
    ("reference_name", S, False), ("reference_kind", S, False),
    ("line", I, True), ("col", I, True), ("candidates", T.ArrayType(S), True),
    ("file_path", S, True), ("language", S, True),
    ("status", S, True), ("name_tail", S, True),
)

# They decide which rows a query returns.
CALL_LIKE = ["calls", "references", "imports", "instantiates", "uses"]
CONTAINERS = ["class", "interface", "struct", "trait", "protocol", "module", "enum"]
DEFINITIONS = ["class", "interface", "enum", "struct", "trait", "type_alias",
               "method", "function", "module", "namespace"]
NODE_KINDS = ["file", "module", "class", "struct", "interface", "trait", "protocol",
              "function", "method", "property", "field", "variable", "constant",
              "enum", "enum_member", "type_alias", "namespace", "parameter",
              "import", "export", "route", "component"]
EDGE_KINDS = ["contains", "calls", "imports", "exports", "extends", "implements",
              "references", "type_of", "returns", "instantiates", "overrides",
              "decorates", "uses"]
UNSEGMENTED_KINDS = ["file", "import"]
