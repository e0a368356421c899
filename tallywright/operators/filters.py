"""Predicates over ledger rows, documents and catalogs."""
from __future__ import annotations

import operator
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.sources.catalog import is_internal

_OPS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def field_compare(df: DataFrame, col: Column, op: str, value) -> DataFrame:
    """FLT01. The comparison is typed by the value; text that does not cast is not selected."""
    if isinstance(value, bool):
        col = col.try_cast("boolean")
    elif isinstance(value, (int, float)):
        col = col.try_cast("double")
    return df.filter(_OPS[op](col, F.lit(value)))


def contains_ci(df: DataFrame, col: str, part: str) -> DataFrame:
    """FLT02. Substring without wildcards; ``part`` is matched against the lower-cased column as it is."""
    return df.filter(F.contains(F.lower(col), F.lit(part)))


def is_defined(df: DataFrame, doc: str, key: str) -> DataFrame:
    """FLT03. The key exists in the JSON object, also with a null value."""
    return df.filter(F.array_contains(F.json_object_keys(doc), key))


def project_fields(df: DataFrame, fields: dict[str, Column], out: str = "doc") -> DataFrame:
    """FLT04. The chosen fields as one JSON object."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias(out))


def partition_scope(df: DataFrame, pk: str, value: str | None) -> DataFrame:
    """FLT05. One partition, or all when no value is given."""
    return df if value is None else df.filter(F.col(pk) == value)


def recent_of_type(df: DataFrame, types: Sequence[str], since: Column, ts: str = "ts") -> DataFrame:
    """FLT06. Rows of the types at or after ``since``; a null timestamp is out."""
    return df.filter(F.col("type").isin(*types) & (F.col(ts) >= since))


def sourced_claims(df: DataFrame, since: Column, source: str = "source", ts: str = "ts") -> DataFrame:
    """FLT07. Recent claims that cite a source."""
    return recent_of_type(df, fixed.CLAIM_TYPES, since, ts).filter(F.length(F.trim(source)) > 0)


def hygiene_filter(df: DataFrame, retracted: Column, include_exhaust: bool = False, type_filter: str = "") -> DataFrame:
    """FLT08. Retracted rows never pass; exhaust types pass only when asked for."""
    out = df.filter(~F.coalesce(retracted, F.lit(False)))
    if include_exhaust or type_filter:
        return out
    return out.filter(~F.lower(F.coalesce("type", F.lit(""))).isin(*fixed.EXHAUST_TYPES))


def denied(agent: Column, texts: Sequence[Column], agents: Sequence[str], words: Sequence[str]) -> Column:
    """FLT09 as an expression."""
    blob = F.concat_ws(" ", *texts)
    return F.lower(F.coalesce(agent, F.lit(""))).isin(*agents) | tx.deny(blob, list(words))


def deny_rule_filter(df: DataFrame, agents: Sequence[str], words: Sequence[str], texts: Sequence[str] = ("text",)):
    """FLT09. Rows of denied agents or with denied words are dropped."""
    return df.filter(~denied(F.col("agent"), [F.col(t) for t in texts], agents, words))


def composed(c: Column) -> Column:
    """Whether a text is in normal form C, for which there is no built-in function."""
    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v is not None and (v.isascii() or unicodedata.is_normalized("NFC", v)))
    return check(c)


def well_formed_path(path: Column) -> Column:
    """A relative path in normal form C without scheme, control characters, empty or dotted parts."""
    parts = F.split(path, "/")
    ascii = path.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(
        (F.length(path) > 0) & (F.length(path) <= 1024) & ~path.rlike(r"[\\%?#\x00-\x1f\x7f]")
        # Only texts beyond ASCII go to Python; the others are null there.
        & (ascii | composed(F.when(~ascii, path))) & ~path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
        & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def reserved_path(path: Column) -> Column:
    return F.coalesce(F.lower(F.split(path, "/")[0]).isin(*fixed.RESERVED_ROOTS), F.lit(False))


def safe_path(path: Column) -> Column:
    """A well-formed path outside the reserved roots."""
    return well_formed_path(path) & ~reserved_path(path)


def exclusion_reason(prefixes: Sequence[str] | None, entities: Column | None = None, doc_date: Column | None = None) -> Column:
    """FLT10. Name of the first failing check, null when the catalog row is eligible."""
    path, sha = F.col("path"), F.col("sha256")
    cohort = F.lit(True)
    if prefixes is not None:
        cohort = F.lit(False)
        for p in prefixes:
            cohort = cohort | path.startswith(p)
    bad_meta = F.col("entity").isNotNull() & (F.col("entity") != "") & (F.trim("entity") == "")
    if entities is not None:
        bad_meta = bad_meta | F.coalesce(F.exists(entities, lambda e: F.coalesce(F.trim(e), F.lit("")) == ""), F.lit(False))
    if doc_date is not None:
        bad_meta = bad_meta | (F.coalesce(doc_date, F.lit("")) != "") & (
            ~doc_date.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") | F.try_to_timestamp(doc_date).isNull())
    return (
        F.when(~safe_path(path), "invalid_path")
        .when(~cohort, "outside_cohort")
        .when(sha.isNull() | ~sha.rlike("^[0-9a-f]{64}$") | (sha == "0" * 64), "missing_source_hash")
        .when(~F.coalesce("sidecar", F.lit(False)), "missing_sidecar_claim")
        .when(~F.coalesce("enriched", F.lit(False)), "missing_enrichment_claim")
        .when(~F.col("enriched_sha256").eqNullSafe(sha), "missing_matching_enrichment_hash")
        .when(F.coalesce("err", F.lit("")) != "", "source_error")
        .when(bad_meta, "invalid_metadata_schema"))


def filter_findings(df: DataFrame, id=None, source=None, status=None, severity=None) -> DataFrame:
    """FLT11. AND of the parameters that are given."""
    if id is not None:
        df = df.filter(F.col("id") == id)
    if source is not None:
        df = df.filter(F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(str(source).lower())))
    if status is not None:
        df = df.filter(F.col("status") == status)
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    return df


def injection_marker_flag(df: DataFrame, text: str = "text", out: str = "injected") -> DataFrame:
    """FLT12. Marks text that carries an instruction to the reader's tools."""
    return df.withColumn(out, tx.matches(F.coalesce(text, F.lit("")), fixed.INJECTION_MARKERS, True))


def changed_since_hash(df: DataFrame, done: str, done_hash: str, hash_: str, reindex: bool = False) -> DataFrame:
    """FLT13. Not processed yet, or processed in another version."""
    if reindex:
        return df
    return df.filter(~F.coalesce(done, F.lit(False)) | ~F.col(done_hash).eqNullSafe(F.col(hash_)))


def select_todo(df: DataFrame, reindex: bool = False, prefix: str = "") -> DataFrame:
    """FLT14. Rows still to be read in depth, among them rows with an open thin-text reason."""
    open_reason = F.coalesce(F.exists("review_reasons", lambda r: r.rlike("(?i)thin|re-?OCR")), F.lit(False)) & ~(
        F.coalesce("non_text_asset", F.lit(False)) | F.coalesce("reocr", F.lit(False)) | F.coalesce("reocr_tried", F.lit(False)))
    todo = df.filter((F.coalesce("path", F.lit("")) != "") & ~is_internal(F.col("path"))
                     & (F.lit(reindex) | ~F.coalesce("deep", F.lit(False)) | open_reason))
    return todo.filter(F.col("path").startswith(prefix)) if prefix else todo


def name_term_filter(df: DataFrame, name: str, query: str) -> DataFrame:
    """FLT15. Any term of more than two characters occurs in the name; no such term keeps every row."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    if not terms:
        return df
    return df.filter(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(name), t)))


def visibility_select(df: DataFrame, entitlements: DataFrame, lane: str, caller: str, include_private: bool) -> DataFrame:
    """FLT16. Lanes the caller may read; private lanes need the entitlement and the flag."""
    allowed = entitlements.filter((F.col("caller") == caller) & (~F.col("private") | F.lit(include_private)))
    return df.join(allowed.select(F.col("lane").alias(lane)).distinct(), lane, "left_semi")
