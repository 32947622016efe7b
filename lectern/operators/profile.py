"""Which columns of a table are key, text, metadata, date or file reference.

Statistics are one aggregate pass per table. The rules then run on the long
column table, which has one row per column of the catalog.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lectern.functions import text as X
from lectern.operators.documents import SENSITIVE_COLUMNS
from lectern.sources.tables import widen

# Tables to leave out, type classes and name patterns.
SKIP_TABLES = (
    "activity_log", "user_login_try", "user_password_history", "user_permission",
    "update_log", "clarification_reminder_log", "test", "website_setting",
)
SKIP_SUFFIXES = ("_log", "_session", "_sessions", "_migration", "_migrations", "_cache")
TEXT_TYPES = ("varchar", "text", "mediumtext", "longtext", "char", "tinytext", "json")
LONG_TEXT_TYPES = ("text", "mediumtext", "longtext")
NUMERIC_TYPES = ("int", "bigint", "smallint", "tinyint", "mediumint", "decimal", "float", "double", "enum")
DATE_TYPES = ("date", "datetime", "timestamp")
DATE_PATTERNS = ("_date", "_at", "created_", "updated_", "modified_", "dt_", "date_of_", "dob", "expiry", "valid_")
FILE_PATTERNS = ("_file", "_path", "file_", "attachment", "document", "upload", "certificate_file", "spec_file",
                 "drawing_file")
TYPE_SUFFIXES = ("_type", "_mime", "_ext", "_extension")
VARCHAR_CHARS = 255
#: The approximate counts err by a few hundredths; half is far below what they can make of a true key.
KEY_SHARE = 0.5

CATALOG_SCHEMA = ("table_name string, ordinal int, column_name string, base_type string, nullable boolean, "
                  "declared_key string")


def base_type(dtype: T.DataType) -> str:
    """Catalog type of a Spark type; vectors have no role."""
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
        return "vector"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "json"
    names = {T.StringType: "varchar", T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int",
             T.LongType: "bigint", T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "decimal",
             T.BooleanType: "tinyint", T.DateType: "date", T.TimestampType: "datetime",
             T.TimestampNTZType: "datetime", T.BinaryType: "blob"}
    return names[type(dtype)]


def skipped(table: Column) -> Column:
    return table.isin(*SKIP_TABLES) | F.lower(table).rlike("(" + "|".join(SKIP_SUFFIXES) + ")$")


def declared_catalog(spark: SparkSession, frames: Mapping[str, DataFrame],
                     keys: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """One row per column as declared; sensitive columns and skipped tables left out."""
    rows = [
        (name, i, f.name, base_type(f.dataType), f.nullable, (keys or {}).get((name, f.name), ""))
        for name, df in frames.items() for i, f in enumerate(df.schema.fields)
        if f.name.lower() not in SENSITIVE_COLUMNS
    ]
    columns = pd.DataFrame(rows, columns=[c.split()[0] for c in CATALOG_SCHEMA.split(", ")])
    return spark.createDataFrame(columns, CATALOG_SCHEMA).where(~skipped(F.col("table_name")))


def _digest(name: str, dtype: T.DataType) -> str:
    """What stands for a value in an exact count: long and nested values meet as digests."""
    if isinstance(dtype, T.StringType):
        return f"if(length({name}) > 32, md5({name}), {name})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"md5(to_json({name}))"
    return name


def statistics(df: DataFrame, table: str, exact: Collection[str] = ()) -> DataFrame:
    """Rows, NULLs, distinct values and text lengths per column, in one pass.

    Distinct values are approximate but for the columns in ``exact``; their
    values are made distinct in each task before the shuffle.
    """
    measures, entries = ["count(*) AS n"], []
    for i, f in enumerate(df.schema.fields):
        name = "`" + f.name.replace("`", "``") + "`"
        length = f"length({name})" if isinstance(f.dataType, T.StringType) else "CAST(NULL AS INT)"
        distinct = (f"count(DISTINCT {_digest(name, f.dataType)})" if f.name in exact
                    else f"approx_count_distinct({name})")
        measures += [f"count({name}) AS v{i}", f"{distinct} AS d{i}", f"avg({length}) AS a{i}", f"max({length}) AS m{i}"]
        entries.append(f"named_struct('ordinal', {i}, 'n_rows', n, 'n_nulls', n - v{i}, 'n_distinct', d{i}, "
                       f"'avg_length', a{i}, 'max_length', m{i})")
    rows = df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(entries)}))")
    return rows.select(F.lit(table).alias("table_name"), "*")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_statistics(frames: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """Statistics of all columns of all tables."""
    return _union([statistics(widen(df), name, df.columns if exact else ()) for name, df in frames.items()])


def catalog(spark: SparkSession, frames: Mapping[str, DataFrame],
            keys: Mapping[tuple[str, str], str] | None = None, *, long_chars: int = VARCHAR_CHARS,
            key_share: float = KEY_SHARE) -> DataFrame:
    """Declared columns with measured statistics. Columns with a text of over ``long_chars`` get the type ``text``.

    A table without a declared key gets the first column whose values are
    measured unique and never NULL. Columns whose approximate count of distinct
    values is at least ``key_share`` of the rows are counted exactly. The measuring runs here; what is kept are
    one row per column and one per table.
    """
    declared = declared_catalog(spark, frames, keys)
    kept = {r["table_name"] for r in declared.select("table_name").distinct().collect()}
    used = {name: df for name, df in frames.items() if name in kept}
    stats = spark.createDataFrame(profile_statistics(used).toArrow())
    columns = declared.join(stats, ["table_name", "ordinal"])
    long = (F.col("base_type") == "varchar") & (F.col("max_length") > long_chars)
    columns = columns.withColumn("data_type", F.when(long, "text").otherwise(F.col("base_type")))
    unique = spark.createDataFrame(exact_keys(used, columns, key_share).toArrow())
    with_key = columns.join(unique, "table_name", "left")
    declared_pk = F.max(F.col("declared_key") == "PRI").over(Window.partitionBy("table_name"))
    measured = ~declared_pk & (F.col("ordinal") == F.col("key_ordinal"))
    done = with_key.select(
        "table_name", "ordinal", "column_name", "data_type", "nullable",
        F.when(measured, "PRI").otherwise(F.col("declared_key")).alias("column_key"),
        "n_rows", "n_nulls", "n_distinct", "avg_length")
    return spark.createDataFrame(done.toArrow())


def exact_keys(frames: Mapping[str, DataFrame], columns: DataFrame, key_share: float = KEY_SHARE) -> DataFrame:
    """``(table_name, key_ordinal)``: first column with as many exact distinct values as rows."""
    close = (F.col("n_rows") > 0) & (F.col("n_nulls") == 0) & (F.col("n_distinct") >= key_share * F.col("n_rows"))
    possible = F.col("data_type").isin("int", "bigint", "smallint", "varchar", "char")
    rows = columns.where(close & possible).select("table_name", "column_name").collect()
    candidates: dict[str, list[str]] = {}
    for r in rows:
        candidates.setdefault(r["table_name"], []).append(r["column_name"])
    spark = columns.sparkSession
    if not candidates:
        return spark.createDataFrame([], "table_name string, key_ordinal int")
    counted = _union([
        statistics(widen(frames[t].select(*names)), t, names).select("table_name", F.col("ordinal").alias("place"),
                                                                     F.col("n_distinct").alias("exact"))
        .withColumn("column_name", F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1))
        for t, names in candidates.items()])
    unique = counted.join(columns.select("table_name", "column_name", "ordinal", "n_rows"), ["table_name", "column_name"])
    return unique.where(F.col("exact") == F.col("n_rows")).groupBy("table_name").agg(F.min("ordinal").alias("key_ordinal"))


# ---- proposals of a model ----------------------------------------------------

PROPOSAL_SCHEMA = ("table string, label string, description string, pk_column string, text_columns array<string>, "
                   "metadata_columns array<string>, date_column string, file_columns array<array<string>>")


def proposed_configs(answers: DataFrame, answer: str, db: str) -> DataFrame:
    """Configurations in the JSON array of each model answer; malformed items and items without a table are skipped."""
    raw = answers.select(
        *[c for c in answers.columns if c != answer],
        F.posexplode(X.parse_json_array(F.col(answer), "array<string>")).alias("position", "raw"))
    items = raw.withColumn("item", F.from_json("raw", PROPOSAL_SCHEMA)).drop("raw")
    none = F.array().cast("array<string>")
    pairs = F.transform(
        F.filter("item.file_columns", lambda f: F.size(f) > 0),
        lambda f: F.struct(F.get(f, 0).alias("path_col"), F.coalesce(F.get(f, 1), F.lit("")).alias("type_col")))
    kept = [c for c in items.columns if c != "item"]
    return items.where(F.col("item.table").isNotNull()).select(
        *kept, F.lit(db).alias("db"), F.col("item.table").alias("table_name"),
        F.coalesce("item.label", "item.table").alias("label"), F.coalesce("item.description", F.lit("")).alias("description"),
        "item.pk_column", F.coalesce("item.text_columns", none).alias("text_columns"),
        F.coalesce("item.metadata_columns", none).alias("metadata_columns"), "item.date_column",
        F.coalesce(pairs, F.array().cast("array<struct<path_col:string,type_col:string>>")).alias("file_columns"))


# ---- roles -------------------------------------------------------------------


def primary_keys(columns: DataFrame) -> DataFrame:
    return columns.where("column_key = 'PRI'").groupBy("table_name").agg(
        F.min_by("column_name", "ordinal").alias("pk_column"))


def _with_pk(columns: DataFrame) -> DataFrame:
    return columns.join(primary_keys(columns), "table_name", "left")


def _is_pk() -> Column:
    return F.coalesce(F.col("column_name") == F.col("pk_column"), F.lit(False))


def text_columns(columns: DataFrame) -> DataFrame:
    """Text type, not the key, not a short indexed column, not named like a file."""
    kind, lower = F.col("data_type"), F.lower("column_name")
    ends = "(" + "|".join(FILE_PATTERNS) + ")$"
    starts = "^(" + "|".join(p.lstrip("_") for p in FILE_PATTERNS) + ")"
    indexed = F.col("column_key").isin("MUL", "UNI") & ~kind.isin(*LONG_TEXT_TYPES)
    chosen = kind.isin(*TEXT_TYPES) & ~_is_pk() & ~indexed & ~lower.rlike(ends) & ~lower.rlike(starts)
    return _with_pk(columns).where(chosen).select("table_name", "ordinal", "column_name")


def metadata_columns(columns: DataFrame) -> DataFrame:
    """The key first, then numeric, indexed and date columns."""
    kind = F.col("data_type")
    chosen = _is_pk() | kind.isin(*NUMERIC_TYPES, *DATE_TYPES) | F.col("column_key").isin("MUL", "UNI")
    place = F.when(_is_pk(), -1).otherwise(F.col("ordinal"))
    return _with_pk(columns).where(chosen).select("table_name", place.alias("ordinal"), "column_name")


def date_columns(columns: DataFrame) -> DataFrame:
    """First date column with a date-like name, else the first date column."""
    named = F.lower("column_name").rlike("|".join(DATE_PATTERNS))
    dates = columns.where(F.col("data_type").isin(*DATE_TYPES))
    return dates.groupBy("table_name").agg(
        F.min_by("column_name", F.struct((~named).alias("later"), "ordinal")).alias("date_column"))


def file_columns(columns: DataFrame) -> DataFrame:
    """Text columns whose name contains a file pattern."""
    chosen = F.lower("column_name").rlike("|".join(FILE_PATTERNS)) & F.col("data_type").isin(*TEXT_TYPES)
    return columns.where(chosen).select("table_name", "ordinal", "column_name")


def type_columns(columns: DataFrame) -> DataFrame:
    """File columns with the column that names their type, empty when there is none.

    Tried in order: the name with ``_file`` or ``_path`` replaced by a type
    suffix, then ``file_type``; never the column itself.
    """
    files = file_columns(columns).withColumnRenamed("column_name", "path_col")
    lower = F.lower("path_col")
    names = [F.replace(F.replace(lower, F.lit("_file"), F.lit(s)), F.lit("_path"), F.lit(s)) for s in TYPE_SUFFIXES]
    tries = F.array(*names, F.lit("file_type"))
    wanted = files.select("table_name", "ordinal", "path_col", F.posexplode(tries).alias("prio", "wanted"))
    others = columns.select("table_name", F.lower("column_name").alias("wanted"), F.col("column_name").alias("type_col"),
                            F.col("ordinal").alias("type_ordinal"))
    found = wanted.join(others, ["table_name", "wanted"]).where(F.col("type_col") != F.col("path_col"))
    best = found.groupBy("table_name", "path_col").agg(
        F.min_by("type_col", F.struct("prio", "type_ordinal")).alias("type_col"))
    return files.join(best, ["table_name", "path_col"], "left").select(
        "table_name", "ordinal", "path_col", F.coalesce("type_col", F.lit("")).alias("type_col"))


def _listed(df: DataFrame, value: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", value.alias("v"))))
    return df.groupBy("table_name").agg(F.transform(ordered, lambda e: e["v"]).alias(name))


def configs(columns: DataFrame, db: str) -> DataFrame:
    """One configuration row per table that has text or file columns."""
    files = type_columns(columns)
    parts = [
        primary_keys(columns), date_columns(columns),
        _listed(text_columns(columns), F.col("column_name"), "text_columns"),
        _listed(metadata_columns(columns), F.col("column_name"), "metadata_columns"),
        _listed(files, F.struct("path_col", "type_col"), "file_columns"),
    ]
    tables = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    joined = reduce(lambda a, b: a.join(b, "table_name", "left"), parts, tables)
    empty = F.array().cast("array<string>")
    described = F.concat(F.lit("Table "), "table_name", F.lit(" ("), "n_columns", F.lit(" columns)"))
    return joined.where(F.col("text_columns").isNotNull() | F.col("file_columns").isNotNull()).select(
        F.lit(db).alias("db"), "table_name", X.title_label(F.col("table_name")).alias("label"),
        described.alias("description"), "pk_column",
        F.coalesce("text_columns", empty).alias("text_columns"),
        F.coalesce("metadata_columns", empty).alias("metadata_columns"), "date_column",
        F.coalesce("file_columns", F.array().cast("array<struct<path_col:string,type_col:string>>")).alias("file_columns"))
