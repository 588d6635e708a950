"""Schema changes as a stream: versions of tables' columns compared, statements classified, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions.predicates import table_match
from deltaloom.functions.scalar import ddl_kind


def _names(cols: Column) -> Column:
    return F.transform(cols, lambda c: c["name"])


def column_sets(old: Column, new: Column) -> Column:
    """(added, removed, modified, shared) names between two arrays of (name, type), each in order."""
    changed = F.filter(new, lambda x: F.exists(old, lambda y: (y["name"] == x["name"]) & (y["type"] != x["type"])))
    return F.struct(
        F.array_sort(F.array_except(_names(new), _names(old))).alias("added"), F.array_sort(F.array_except(_names(old), _names(new))).alias("removed"),
        F.array_sort(_names(changed)).alias("modified"), F.array_sort(F.array_intersect(_names(new), _names(old))).alias("shared"),
    )


def from_versions(versions: DataFrame) -> DataFrame:
    """Schema changes from (schema, table, version, cols): create for a table's first version, alter where columns differ."""
    was = F.lag("cols").over(Window.partitionBy("schema", "table").orderBy("version"))
    d = versions.withColumn("was", was).withColumn("d", column_sets(F.coalesce("was", F.array().cast(versions.schema["cols"].dataType)), F.col("cols")))
    kind = F.when(F.col("was").isNull(), "create").when(F.size("d.added") + F.size("d.removed") + F.size("d.modified") > 0, "alter")
    return d.withColumn("kind", kind).where("kind is not null").select("schema", "table", "version", "kind", "d.added", "d.removed", "d.modified")


def from_statements(ddl: DataFrame, statement: str = "sql") -> DataFrame:
    return ddl.withColumn("kind", ddl_kind(F.col(statement)))


def published(changes: DataFrame, prefix: str, exclude_tables: list[str] = (), exclude_kinds: list[str] = ()) -> DataFrame:
    """The changes that are published, with their topic: excluded tables (globs on schema.table or table) and kinds go."""
    out = changes.where(~F.col("kind").isin(list(exclude_kinds))) if exclude_kinds else changes
    if exclude_tables:
        out = out.where(~table_match(list(exclude_tables)))
    return out.withColumn("topic", F.lit(f"{prefix}.schema_changes" if prefix else "schema_changes"))
