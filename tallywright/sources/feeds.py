"""Ledger feeds: NDJSON reading and writing, store merging, upserts, sectioned text and pipe tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.ordered import bucketed_running, latest_by

LEDGER_SCHEMA = T.StructType([
    T.StructField(n, T.ArrayType(T.StringType()) if n == "tags" else T.StringType())
    for n in ("id", "ts", "type", "text", "tags", "agent", "source", "was", "supersedes", "ekey", "evalue")
])


def parse_ndjson_lenient(lines: DataFrame, schema: T.StructType | str, line: str = "value") -> DataFrame:
    """SRC01. One row per line that is a JSON object; everything else is dropped."""
    good = F.trim(line).startswith("{") & F.col("_ok")
    keep = [c for c in lines.columns if c != line]
    return (lines.withColumn("_ok", F.expr(f"try_parse_json(`{line}`)").isNotNull())
            .filter(good).select(*keep, F.from_json(line, schema).alias("_r")).select(*keep, "_r.*"))


def split_ndjson(lines: DataFrame, schema: T.StructType | str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC02. (good rows, quarantined lines). Blank lines are neither. Objects and arrays are rows."""
    text = F.trim(F.regexp_replace(F.col(line), "\r$", ""))
    probed = lines.filter(text != "").withColumn(
        "_ok", F.expr(f"try_parse_json(`{line}`)").isNotNull() & text.rlike(r"^[\[{]"))
    keep = [c for c in lines.columns if c != line]
    good = probed.filter("_ok").select(*keep, F.from_json(line, schema).alias("_r")).select(*keep, "_r.*")
    return good, probed.filter("NOT _ok").select(*keep, F.col(line).alias("raw"))


def read_ndjson_lenient(spark: SparkSession, path: str, schema: T.StructType | str = LEDGER_SCHEMA) -> DataFrame:
    """SRC01 on files. The text reader splits large files, so no file goes through one task whole."""
    return parse_ndjson_lenient(spark.read.text(path), schema)


def read_ndjson_quarantine(spark: SparkSession, path: str, schema: T.StructType | str = LEDGER_SCHEMA):
    """SRC02 on files; the quarantine side names the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    return split_ndjson(lines, schema)


def to_ndjson_lines(df: DataFrame) -> DataFrame:
    """SRC03. One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_ndjson(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """SRC03 on files."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def read_feed_glob(spark: SparkSession, glob: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """SRC04. All feeds below a glob as one DataFrame."""
    return spark.read.schema(schema).json(glob)


def merge_two_stores(primary: DataFrame, legacy: DataFrame, key: str = "id") -> DataFrame:
    """SRC05. One row per id; the primary store wins."""
    both = primary.withColumn("_prio", F.lit(1)).unionByName(legacy.withColumn("_prio", F.lit(0)))
    return latest_by(both.filter(F.col(key).isNotNull()), [key], ["_prio"]).drop("_prio")


def upsert_by_id(target: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """SRC06. Fields present in the change replace the stored ones; an absent (null or blank) field keeps them."""
    cols = [c for c in target.columns if c != key]
    blank = {f.name for f in changes.schema if isinstance(f.dataType, T.StringType)}
    t, c = target.alias("t"), changes.alias("c")

    def new(n: str) -> Column:
        v = F.col(f"c.{n}")
        return F.when(v != "", v) if n in blank else v

    return t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer").select(
        F.coalesce(F.col(f"c.{key}"), F.col(f"t.{key}")).alias(key),
        *[F.coalesce(new(n), F.col(f"t.{n}")).alias(n) if n in changes.columns else F.col(f"t.{n}") for n in cols])


def append_if_absent(target: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """SRC07. Rows of ``incoming`` whose key is not in ``target``."""
    return incoming.join(target.select(key), key, "left_anti")


def parse_sectioned_text(docs: DataFrame, doc_key: str, text: str, header: str, fields: Sequence[str],
                         line_block: int = 4096) -> DataFrame:
    """SRC12. A header line opens an entry; the lines below it are its body.

    ``header`` is a regex with one group, the title. Entries are numbered by a running count of header lines, in
    blocks of lines, so a very long text does not end up in one task. Field lines are ``**name:** value``.
    """
    lines = docs.select(doc_key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("_h", F.col("line").rlike(header).cast("long"))
    numbered = bucketed_running(lines, [doc_key], F.floor(F.col("line_no") / line_block), ["line_no"],
                                {"entry": F.col("_h")}).filter("entry > 0")
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("_h") == 0, F.struct("line_no", "line")))), lambda s: s["line"]), "\n")
    entries = numbered.groupBy(doc_key, "entry").agg(
        F.max(F.when(F.col("_h") == 1, F.regexp_extract("line", header, 1))).alias("title"),
        F.trim(body).alias("body"))
    out = entries
    for f in fields:
        value = F.trim(F.regexp_extract("body", rf"(?m)^\*\*{f}:\*\*[ \t]*(.*)$", 1))
        out = out.withColumn(f, F.when(value != "", value))
    return out


def parse_pipe_table(docs: DataFrame, doc_key: str, text: str, first_header: str, columns: Sequence[str]) -> DataFrame:
    """SRC13. Rows of the first pipe table whose first header cell is ``first_header``; stops at the first other line."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda l: F.regexp_replace(l, "\r$", ""))
    heads = F.transform(F.col("_lines"), lambda l: l.rlike(rf"^\s*\|\s*{first_header}\s*\|"))
    step = docs.select(doc_key, lines.alias("_lines")).withColumn("_at", F.array_position(heads, True)).filter("_at > 0")
    step = step.withColumn("_rest", F.expr("slice(_lines, _at + 2, greatest(size(_lines), 1))"))
    outside = F.array_position(F.transform("_rest", lambda l: F.ltrim(l).startswith("|")), False)
    step = step.withColumn("_end", outside)
    step = step.withColumn("_rows", F.expr("CASE WHEN _end > 0 THEN slice(_rest, 1, CAST(_end AS INT) - 1) ELSE _rest END"))
    rows = step.select(doc_key, F.posexplode("_rows").alias("row_no", "_line"))
    cells = F.transform(F.split("_line", r"\|"), lambda c: F.trim(c))
    rows = rows.select(doc_key, "row_no", cells.alias("_c")).filter(F.size("_c") >= len(columns) + 2)
    return rows.select(doc_key, "row_no", *[F.col("_c")[i + 1].alias(n) for i, n in enumerate(columns)])


def document_table_lookup(docs: DataFrame, doc: str, path: str, out: str) -> DataFrame:
    """SRC14. A JSON path of the document column as a column; missing paths are null."""
    return docs.withColumn(out, F.get_json_object(doc, path))
