"""Schemas of the engine's tables."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(text: str) -> T.StructType:
    """A schema from "name type [not null], ..."; needs no session, unlike the library's parser."""
    fields = []
    for part in text.split(", "):
        name, kind, *rest = part.split()
        fields.append(T.StructField(name, _KINDS[kind], not rest))
    return T.StructType(fields)


_CHUNK = (
    "id string not null, file_path string not null, content string not null, start_line int not null, end_line int not null, "
    "name string, node_type string not null, signature string, docstring string, language string not null"
)
SOURCE_FILE = _struct("file_path string not null, content string")
CHUNK = _struct(_CHUNK)
VECTOR_RECORD = _struct(_CHUNK + ", vector array<float> not null, content_hash string not null, indexed_at timestamp not null")
RAW_EDGE = _struct("source_id string not null, source_path string not null, target_symbol string not null, edge_type string not null, module_path string")
GRAPH_NODE = _struct(
    "id string not null, file_path string not null, symbol_name string, kind string not null, start_line int not null, end_line int not null, "
    "updated_at timestamp, stale boolean not null"
)
GRAPH_EDGE = _struct("source_id string not null, target_id string not null, edge_type string not null, weight double not null, metadata string")
SESSION_EVENT = _struct(
    "session_id string not null, seq bigint not null, ts timestamp not null, action string not null, node_id string, priority double, text string"
)
CHANGE_EVENT = _struct("file_path string not null, ts timestamp not null, kind string not null, content string")

# Kinds of edges and nodes.
EDGE_TYPES = ("calls", "imports", "extends", "implements", "exports", "agent_linked")
NODE_KINDS = ("function", "class", "interface", "type", "enum", "module", "variable", "method", "unknown")
