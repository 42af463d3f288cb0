"""The tables of the engine: component graph, rendered contexts, selectors, evidence."""

from __future__ import annotations

from pyspark.sql import types as T

DYN = "struct<reason:string,expr:string,chain:string>"
OPTION = f"struct<classes:array<string>,dyn:array<{DYN}>>"
FACTS = f"struct<static:array<string>,optional:array<string>,exclusive:array<array<{OPTION}>>,dynamic:array<{DYN}>>"
SEGMENT = "struct<classes:array<string>,not_classes:array<string>,tag:string,combinator:string,wildcard:boolean>"

ENTRIES = "entry_ord int, ref string, module string, source_file string, name string"
ITEMS = "list_key string, ord array<int>, kind string, val string, next_list string, ref string"
NODES = f"node_id string, ref string, tag string, repeat boolean, raw boolean, facts {FACTS}"
SELECTORS = f"sel_id long, selector string, file string, line int, segments array<{SEGMENT}>, skip_reason string"
EVIDENCE = "token string, file string, line int, literal string, source string"


def struct_type(ddl: str) -> T.StructType:
    """The StructType of a comma list of columns."""
    return T.StructType.fromDDL(ddl)
