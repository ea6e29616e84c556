"""Schemas that drift between files.

Method: tagged-union inference. The schemas of all releases of a series are fused into one structure: per field a list of
alternatives, each tagged with its type and name and with the stretch of releases that it holds for. Everything is read off
this structure: the one list of fields with canonical type and typed branches, the alternatives that appear, and the changes
between neighbouring releases, which are the places where one stretch of a field ends and the next one begins (or none).
Values are kept in the branch of their own type beside one canonical conversion.

Defined results: a column without any name and without standard name is no field. Exact copies and repeated rows of one
column count once; where they differ the row recorded last holds. Of several columns with one field the first counts.
A null type is unknown: it is no alternative and no change. Files without a series or release are no part of any
series. A value that its declared type cannot hold is kept as a string. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import small, trimmed

#: Spellings of types in R and SQL, each with the canonical Spark type. Fixed values.
TYPES = {
    "character": "string", "string": "string", "varchar": "string", "text": "string", "char": "string", "factor": "string",
    "double": "double", "numeric": "double", "float8": "double", "float": "double", "real": "double", "double precision": "double",
    "integer": "int", "int": "int", "int4": "int",
    "integer64": "bigint", "bigint": "bigint", "int8": "bigint", "long": "bigint",
    "logical": "boolean", "boolean": "boolean", "bool": "boolean",
}
WHOLE, NUMERIC = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Narrowest common type of two alternatives; anything else meets in string.
WIDER = {frozenset(("int", "bigint")): "bigint", frozenset(("int", "double")): "double", frozenset(("bigint", "double")): "double"}


def squeezed(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def bare(c: Column) -> Column:
    """Without blanks and quotes around it."""
    return F.regexp_replace(c, r"""(?U)^[\s"'`]+|[\s"'`]+$""", "")


def canonical_type(c: Column) -> Column:
    """The Spark type of an R or SQL spelling; an unknown spelling stays itself in lower case, blank is null."""
    low = F.lower(trimmed(F.regexp_replace(c, r"\(.*\)", "")))
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.when(low != "", F.coalesce(F.try_element_at(known, low), low))


def columns_of_files(column_info: DataFrame, aliases: DataFrame, alias_bound: int = 100_000) -> DataFrame:
    """(file_id, field, name, type): one row per field of a file."""
    known = aliases.select(squeezed(F.col("input_name")).alias("_key"), F.lower(trimmed(F.col("standard_name"))).alias("_std")).filter("_key <> '' and _std <> ''")
    known = known.groupBy("_key").agg(F.min("_std").alias("_std"))
    latest = column_info.groupBy("file_id", "col_index").agg(
        F.max_by(F.struct("input_name", "standard_name", "class_name"), F.struct("recorded_at", "ci_id")).alias("c")
    )
    c = latest.select("file_id", "col_index", bare(F.col("c.input_name")).alias("name"), F.lower(trimmed(F.col("c.standard_name"))).alias("std"), canonical_type(F.col("c.class_name")).alias("type"))
    c = c.withColumn("_key", squeezed(F.col("name"))).join(small(known, alias_bound), "_key", "left")
    c = c.withColumn("field", F.coalesce(F.nullif("std", F.lit("")), "_std", F.nullif("_key", F.lit("")), F.nullif("name", F.lit("")))).filter("field is not null")
    first = F.min(F.struct("col_index", "name", "type"))
    return c.groupBy("file_id", "field").agg(first.alias("c")).select("file_id", "field", "c.name", "c.type")


def release_order(files: DataFrame, width: int = 1024) -> DataFrame:
    """(series_id, n, release_no, file_id): the files of a series numbered from 0 by release.

    A series is numbered in stretches of ``width`` release numbers, each of which also learns how many files lie before it;
    so even one huge series is spread over many tasks."""
    f = files.filter("series_id is not null and release_no is not null and file_id is not null").select("series_id", "release_no", "file_id").distinct()
    f = f.withColumn("_b", F.floor(F.col("release_no") / width))
    before = f.groupBy("series_id", "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = before.select("series_id", "_b", F.coalesce(F.sum("_k").over(Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k"))
    inner = Window.partitionBy("series_id", "_b").orderBy("release_no", "file_id")
    return f.join(before, ["series_id", "_b"]).select("series_id", (F.col("_k") + F.row_number().over(inner) - 1).alias("n"), "release_no", "file_id")


def fused(cols: DataFrame, order: DataFrame, width: int = 1024) -> DataFrame:
    """(series_id, field, name, type, from_n, to_n, since): the fused schema of each series as alternatives of its fields.

    An alternative is a name with a type (the tag) and the longest stretch of neighbouring releases that have it; stretches
    are also cut at every ``width`` releases, so no task holds more of a field than that. since is the release of from_n."""
    at = order.join(cols, "file_id").withColumn("_b", F.floor(F.col("n") / width))
    w = Window.partitionBy("series_id", "field", "_b").orderBy("n")
    same = F.lag(F.struct("n", "name", "type")).over(w).eqNullSafe(F.struct((F.col("n") - 1).alias("n"), "name", "type"))
    runs = at.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("series_id", "field", "_b", "_run").agg(
        F.first("name").alias("name"), F.first("type").alias("type"), F.min("n").alias("from_n"), F.max("n").alias("to_n"), F.min("release_no").alias("since")
    ).drop("_b", "_run")


def fused_series(column_info: DataFrame, files: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the fused alternatives, the order of releases)."""
    order = release_order(files)
    return fused(columns_of_files(column_info, aliases), order), order


def drift(column_info: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, field, drift, was, now): added, removed, renamed and retyped against the release before: where an
    alternative of the fused schema ends and another one, or none, begins."""
    spans, order = fused_series(column_info, files, aliases)
    ends = spans.select("series_id", "field", (F.col("to_n") + 1).alias("n"), F.struct("name", "type").alias("old"))
    begins = spans.select("series_id", "field", F.col("from_n").alias("n"), F.struct("name", "type").alias("new"))
    both = ends.join(begins, ["series_id", "field", "n"], "full").filter("n > 0")  # the first release of a series changes nothing
    both = both.join(order.select("series_id", "n", "file_id"), ["series_id", "n"])  # nor does anything end after the last
    change = lambda kind, test, was, now: F.when(test, F.struct(F.lit(kind).alias("drift"), was.alias("was"), now.alias("now")))
    n, o = F.col("new"), F.col("old")
    kept = n.isNotNull() & o.isNotNull()
    each = F.array(
        change("added", o.isNull(), F.lit(None).cast("string"), n["name"]),
        change("removed", n.isNull(), o["name"], F.lit(None).cast("string")),
        change("renamed", kept & ~n["name"].eqNullSafe(o["name"]), o["name"], n["name"]),
        change("retyped", kept & (n["type"] != o["type"]), o["type"], n["type"]),
    )
    return both.select("file_id", "field", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("d")).select("file_id", "field", "d.drift", "d.was", "d.now")


def common_type(types: Column) -> Column:
    """The canonical type of an array of alternative types (null for none)."""

    def meet(a: Column, b: Column) -> Column:
        out = F.when(a.isNull() | (a == b), b)
        for pair, wide in WIDER.items():
            x, y = sorted(pair)
            out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(wide))
        return out.otherwise(F.lit("string"))

    return F.aggregate(types, F.lit(None).cast("string"), meet)


def fused_fields(column_info: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(field, canonical_type, alternatives, branches, n_files, n_names): the one consistent list of fields of all files."""
    cols = columns_of_files(column_info, aliases).join(files.select("file_id").distinct(), "file_id", "left_semi")
    by = cols.groupBy("field").agg(F.sort_array(F.collect_set("type")).alias("alternatives"), F.count(F.lit(1)).alias("n_files"), F.count_distinct("name").alias("n_names"))
    branch = F.when(F.size("alternatives") > 1, F.transform("alternatives", lambda t: F.concat_ws("__", F.col("field"), t))).otherwise(F.array().cast("array<string>"))
    return by.select("field", F.coalesce(common_type(F.col("alternatives")), F.lit("string")).alias("canonical_type"), F.array_join("alternatives", "|").alias("alternatives"), F.array_join(branch, "|").alias("branches"), "n_files", "n_names")


def new_alternatives(column_info: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(series_id, field, type, release_no): each type of a field with the first release of the series that has it,
    for fields that have more than one."""
    first = fused_series(column_info, files, aliases)[0].filter("type is not null").groupBy("series_id", "field", "type").agg(F.min("since").alias("release_no"))
    many = first.groupBy("series_id", "field").agg(F.count(F.lit(1)).alias("k"), F.min("release_no").alias("since")).filter("k > 1")
    return first.join(many, ["series_id", "field"]).filter("release_no > since").select("series_id", "field", "type", "release_no")


def typed_values(cells: DataFrame, column_info: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """cells(..., file_id, field, value) as one consistent table: besides the columns of cells (without value) the tag of the
    value (its own type), one typed branch for each type, of which only that of the tag is filled, the canonical type of the
    field and the value converted to it (``as_number`` for numbers, else ``as_text``)."""
    fields = fused_fields(column_info, files, aliases).select("field", "canonical_type")
    own = columns_of_files(column_info, aliases).select("file_id", "field", "type")
    keep = [c for c in cells.columns if c != "value"]
    x = cells.join(small(own, 500_000), ["file_id", "field"], "left").join(small(fields, 500_000), "field", "left")
    v, t = F.col("value"), F.coalesce("type", F.lit("string"))
    flag = F.when(F.upper(v).isin("TRUE", "T"), True).when(F.upper(v).isin("FALSE", "F"), False)
    shape = {"int": WHOLE, "bigint": WHOLE, "double": NUMERIC}
    branch = {k: F.when((t == k) & v.rlike(rx), v.try_cast(k)) for k, rx in shape.items()} | {"boolean": F.when(t == "boolean", flag)}
    held = F.coalesce(*[F.when(b.isNotNull(), F.lit(k)) for k, b in branch.items()], F.lit("string"))
    canonical = F.coalesce("canonical_type", F.lit("string"))
    number = F.when(canonical.isin(*shape) & v.rlike(NUMERIC), v.try_cast("double"))
    return x.select(
        *keep, held.alias("tag"), *[b.alias(f"v_{k}") for k, b in branch.items()], F.when(held == "string", v).alias("v_string"), canonical.alias("canonical_type"),
        number.alias("as_number"), F.when(number.isNull(), v).alias("as_text"),
    )


def unify(frames: dict[str, DataFrame], rename: dict[str, str] | None = None) -> DataFrame:
    """Frames with different schemas as one table: every field once in its canonical type; where types conflict, also
    one branch per type (``field__type``) that holds the values as they were. ``_source`` names the frame.

    rename maps names (compared by letters and digits) to fields. A value that the canonical type cannot hold is null
    there and kept in its branch.
    """
    rename = {"".join(x for x in k.lower() if x.isalnum()): v for k, v in (rename or {}).items()}
    seen: dict[str, dict[str, None]] = {}
    plans = []
    for source, df in frames.items():
        taken: dict[str, tuple[str, str]] = {}
        for name, kind in df.dtypes:
            key = "".join(x for x in name.lower() if x.isalnum())
            field = rename.get(key, key or name)
            if field not in taken:  # the first of several columns with one field
                taken[field] = (name, kind)
                seen.setdefault(field, {})[kind] = None
        plans.append((source, df, taken))

    def widest(kinds: dict[str, None]) -> str:
        return reduce(lambda a, b: a if a == b else WIDER.get(frozenset((a, b)), "string"), kinds)

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    parts = []
    for source, df, taken in plans:
        out = [F.lit(source).alias("_source")]
        for field, kinds in seen.items():
            have = quoted(taken[field][0]) if field in taken else F.lit(None)
            out.append((have.try_cast(widest(kinds)) if field in taken else have.cast(widest(kinds))).alias(field))
            if len(kinds) > 1:
                out += [(have if field in taken and taken[field][1] == k else F.lit(None).cast(k)).alias(f"{field}__{k}") for k in kinds]
        parts.append(df.select(*out))
    return reduce(lambda a, b: a.unionByName(b), parts)
