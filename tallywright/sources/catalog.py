"""Document scanning, cataloguing and CSV with quoting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import fixed, text as tx


def is_internal(path: Column) -> Column:
    out = F.lit(False)
    for p in fixed.INTERNAL_PREFIXES:
        out = out | path.startswith(p)
    return out


def scan_documents(objects: DataFrame, path: str = "path", extensions: list[str] | None = None) -> DataFrame:
    """SRC10. Objects that are neither folders nor written by the document jobs."""
    keep = ~is_internal(F.col(path)) & ~F.col(path).endswith("/")
    if extensions:
        keep = keep & F.lower(path).rlike(r"\.(" + "|".join(extensions) + ")$")
    return objects.filter(keep)


def read_documents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC10 on files, with content kept lazy until a column asks for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return scan_documents(files.withColumn("path", F.regexp_replace("path", "^file:/*" + root.strip("/") + "/?", "")))


def build_catalog(docs: DataFrame, path: str, text: str, size: str, max_bytes: int = 50_000_000) -> DataFrame:
    """SRC11. One row per document; oversize rows are listed without text facts."""
    big = F.col(size) > max_bytes
    name = tx.basename(F.col(path))
    # The text is gone through once, in a projection of its own.
    docs = docs.withColumn("_chars", F.when(big, 0).otherwise(tx.alnum_count(F.col(text))))
    return docs.select(
        F.col(path).alias("path"), F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("").alias("ext"),
        F.col(size).alias("size"), F.element_at(F.split(path, "/"), 1).alias("entity"),
        F.when(~big, F.sha2(text, 256)).alias("sha256"),
        F.col("_chars").alias("text_chars"),
        name.alias("title"),
        (~big & (F.col("_chars") >= 3)).alias("sidecar"),
        F.when(big, F.concat(F.lit("oversize-skipped:"), F.round(F.col(size) / 1e6).cast("long").cast("string"), F.lit("MB"))).alias("err"))


def guard_csv(df: DataFrame) -> DataFrame:
    """SRC08. Cells that a spreadsheet would read as a formula get a leading quote."""
    def cell(f: T.StructField) -> Column:
        if not isinstance(f.dataType, T.StringType):
            return F.col(f"`{f.name}`")
        return F.regexp_replace(f"`{f.name}`", r"^([=+\-@\t\r])", "'$1").alias(f.name)
    return df.select(*[cell(f) for f in df.schema])


def write_csv_safe(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SRC08 on files."""
    guard_csv(df).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv_quoted(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC09. Header row, doubled quotes inside quotes; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def parse_csv_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """SRC09 on a column of CSV records."""
    parsed = F.from_csv(F.col(line), F.lit(schema), {"quote": '"', "escape": '"'})
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, parsed.alias("_r")).select(*keep, "_r.*")
