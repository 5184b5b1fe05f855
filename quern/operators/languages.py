"""Languages of the chunker: extensions, boundary node types and name patterns.

Fixed values: extensions and node types by language.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES: dict[str, dict] = {
    "typescript": {"extensions": (".ts",), "types": ("function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "export_statement", "lexical_declaration", "variable_declaration")},
    "tsx": {"extensions": (".tsx",), "types": ("function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "export_statement", "lexical_declaration", "variable_declaration")},
    "javascript": {"extensions": (".js", ".mjs", ".cjs"), "types": ("function_declaration", "method_definition", "class_declaration", "export_statement", "lexical_declaration", "variable_declaration")},
    "jsx": {"extensions": (".jsx",), "types": ("function_declaration", "method_definition", "class_declaration", "export_statement", "lexical_declaration", "variable_declaration")},
    "python": {"extensions": (".py", ".pyw"), "types": ("function_definition", "class_definition", "decorated_definition")},
    "go": {"extensions": (".go",), "types": ("function_declaration", "method_declaration", "type_declaration")},
    "rust": {"extensions": (".rs",), "types": ("function_item", "impl_item", "struct_item", "enum_item", "trait_item", "mod_item")},
    "java": {"extensions": (".java",), "types": ("class_declaration", "method_declaration", "interface_declaration", "constructor_declaration", "enum_declaration", "record_declaration")},
    "csharp": {"extensions": (".cs",), "types": ("class_declaration", "method_declaration", "interface_declaration", "constructor_declaration", "struct_declaration", "property_declaration", "namespace_declaration")},
    "cpp": {"extensions": (".cpp", ".cc", ".cxx", ".hpp", ".h", ".hxx"), "types": ("function_definition", "class_specifier", "struct_specifier", "template_declaration", "namespace_definition")},
    "c": {"extensions": (".c",), "types": ("function_definition", "struct_specifier", "enum_specifier", "declaration")},
}

BY_EXTENSION = {e: lang for lang, c in LANGUAGES.items() for e in c["extensions"]}
EXTENSIONS = tuple(sorted(BY_EXTENSION))
#: Languages whose chunks give calls, imports and heritage edges.
WITH_EDGES = ("typescript", "tsx", "javascript", "jsx", "python")


def language_column(path: Column) -> Column:
    """Language of a path by its extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in sorted(BY_EXTENSION.items()) for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def by_extension(ext: str) -> str | None:
    return BY_EXTENSION.get(ext.lower())
