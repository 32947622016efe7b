"""Rows to documents: text, key, metadata; and the projections of hits and previews."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.config import Code, Field, Flag, Joined, Name, Slot, TableConfig, Template
from lectern.functions import text as X

# Columns that never leave the source table.
SENSITIVE_COLUMNS = frozenset({
    "user_pass", "password", "login_token", "email_verification_code",
    "password_reset_code", "aadhar_no", "aadhar",
    "session_token", "api_key", "secret",
})

DOCUMENT_COLUMNS = ("doc_id", "source_db", "source_table", "doc_label", "pk_value", "text",
                    "metadata", "version")


def _cell(schema: T.StructType, name: str) -> Column:
    return X.clean(F.col(name), schema[name].dataType)


def _slot(schema: T.StructType, slot: Slot) -> Column:
    match slot:
        case Field(column):
            return _cell(schema, column)
        case Joined(columns, sep):
            return X.join_nonblank([_cell(schema, c) for c in columns], sep)
        case Name(columns):
            return F.concat_ws(" ", *[F.nullif(_cell(schema, c), F.lit("")) for c in columns])
        case Flag(column, yes, no):
            kind = schema[column].dataType
            if isinstance(kind, T.BooleanType):
                truth = F.col(column)
            elif isinstance(kind, T.NumericType):
                truth = F.col(column) != 0
            else:
                truth = F.length(F.col(column).cast("string")) > 0
            return F.when(truth, yes).otherwise(no)
        case Code(column, words, otherwise):
            code = X.as_text(F.col(column), schema[column].dataType)
            chosen = F.lit(otherwise)
            for value, word in words.items():
                chosen = F.when(code == value, word).otherwise(chosen)
            return chosen
    raise TypeError(f"unknown slot {slot!r}")


def render_template(schema: T.StructType, template: Template) -> Column:
    parts: list[Column] = []
    for literal, mark, _, _ in Formatter().parse(template.text):
        if literal:
            parts.append(F.lit(literal))
        if mark:
            parts.append(_slot(schema, template.slots.get(mark, Field(mark))))
    rendered = F.concat(*parts)
    if template.attachment:
        content = F.coalesce(F.col(template.attachment), F.lit(""))
        head = F.substring(content, 1, template.attachment_chars)
        rendered = F.concat(rendered, F.when(
            content != "", F.concat(F.lit("\n\nFile Content:\n"), head)).otherwise(""))
    return rendered


def render_generic(schema: T.StructType, label: str, columns: tuple[str, ...]) -> Column:
    """Label line, then one ``Title: value`` line per text column with a value."""
    lines = []
    for name in columns:
        cell = _cell(schema, name)
        lines.append(F.when(X.informative(cell), F.concat(F.lit(f"{X.title_of(name)}: "), cell)))
    return F.concat(F.lit(label + "\n"), F.concat_ws("\n", *lines))


def render(schema: T.StructType, cfg: TableConfig) -> Column:
    if cfg.template:
        return render_template(schema, cfg.template)
    return render_generic(schema, cfg.label, cfg.text_columns)


def content_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def key_value(schema: T.StructType, pk: str | None, text: Column) -> Column:
    """Primary key as text, or a hash of the document text where there is none."""
    if pk is None:
        return content_key(text)
    return F.coalesce(X.as_text(F.col(pk), schema[pk].dataType), content_key(text))


def doc_id(db: str, table: str, pk_value: Column) -> Column:
    return F.concat_ws(".", F.lit(db), F.lit(table), pk_value)


def metadata_map(schema: T.StructType, cfg: TableConfig, pk_value: Column) -> Column:
    """Provenance and metadata columns as ``map<string,string>``, NULL values left out."""
    fixed = [("source_db", F.lit(cfg.db)), ("source_table", F.lit(cfg.table)),
             ("doc_label", F.lit(cfg.label)), ("pk_value", pk_value)]
    own = [(c, X.as_text(F.col(c), schema[c].dataType)) for c in cfg.metadata_columns]
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fixed + own]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def build_documents(df: DataFrame, cfg: TableConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """One document per row, with the columns ``keep`` of the row. Rows of equal text in a table without key share their id."""
    schema = df.schema
    version = F.col(cfg.date_column).cast("timestamp_ntz") if cfg.date_column else F.lit(None).cast("timestamp_ntz")
    keyed = (
        df.withColumn("_text", render(schema, cfg))
        .withColumn("_pk", key_value(schema, cfg.pk_column, F.col("_text")))
    )
    return keyed.select(
        doc_id(cfg.db, cfg.table, F.col("_pk")).alias("doc_id"),
        F.lit(cfg.db).alias("source_db"),
        F.lit(cfg.table).alias("source_table"),
        F.lit(cfg.label).alias("doc_label"),
        F.col("_pk").alias("pk_value"),
        F.col("_text").alias("text"),
        metadata_map(schema, cfg, F.col("_pk")).alias("metadata"),
        version.alias("version"),
        *keep,
    )


def drop_sensitive(df: DataFrame, names: frozenset[str] = SENSITIVE_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def snippet(text: Column, chars: int = 400) -> Column:
    return F.substring(text, 1, chars)


def project_hits(hits: DataFrame, chars: int = 400) -> DataFrame:
    """Hits as shown to a user: rank, four-place score, provenance and snippet."""
    return hits.select(
        "query_id", "rank", "doc_id", F.round("score", 4).alias("score"),
        F.col("doc_label").alias("label"), "source_db", "source_table",
        snippet(F.col("text"), chars).alias("snippet"),
    )


def one_line(text: Column, chars: int = 280) -> Column:
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" | "))


def preview_cell(c: Column, dtype: T.DataType, chars: int = 60) -> Column:
    """First characters of a cell; NULL and values that count as false read NULL."""
    shown = F.substring(X.as_text(c, dtype), 1, chars)
    if isinstance(dtype, T.BooleanType):
        empty = ~c
    elif isinstance(dtype, T.NumericType):
        empty = c == 0
    else:
        empty = F.length(c.cast("string")) == 0
    return F.when(c.isNull() | empty, "NULL").otherwise(shown)
