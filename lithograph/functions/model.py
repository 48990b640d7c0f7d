"""The tables of the code model, as Spark schemas."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
PARAMETER = _struct(type=S, name=S)

TABLES: dict[str, T.StructType] = {
    "packages": _struct(id=S, fqn=S, name=S, parent_fqn=S, file_count=I, type_count=I),
    "types": _struct(
        id=S, fqn=S, simple_name=S, package_fqn=S, kind=S, modifiers=S, super_class=S, interfaces=T.ArrayType(S), source_file=S, start_line=I, end_line=I, line_count=I, field_count=I, method_count=I
    ),
    "fields": _struct(id=S, fqn=S, simple_name=S, declaring_type_fqn=S, field_type=S, modifiers=S, initializer=S, start_line=I),
    "methods": _struct(
        id=S, fqn=S, simple_name=S, declaring_type_fqn=S, return_type=S, parameters=T.ArrayType(PARAMETER), modifiers=S, start_line=I, end_line=I, cyclomatic_complexity=I, body_hash=S
    ),
    "relationships": _struct(id=S, from_entity_fqn=S, to_entity_fqn=S, kind=S, source_line=I),
    "analyst_notes": _struct(id=S, entity_fqn=S, content=S, created_at=L, updated_at=L),
    "inconsistencies": _struct(id=S, entity1_fqn=S, entity1_kind=S, entity2_fqn=S, entity2_kind=S, reason=S, similarity_score=D, kind=S),
    "git_meta": _struct(entity_fqn=S, last_author_name=S, last_author_email=S, last_commit_time=L, last_commit_hash=S, last_commit_msg=S, commit_count=I),
}

#: What identifies a row of each table: an upsert replaces it.
KEYS = {name: "entity_fqn" if name == "git_meta" else "id" for name in TABLES}

#: What a scan writes anew; notes outlive scans.
SCAN_TABLES = tuple(name for name in TABLES if name != "analyst_notes")

#: What the statistics count.
COUNTED = ("packages", "types", "fields", "methods", "relationships", "inconsistencies")
