"""Expressions that run as table jobs. Each returns a Column built from built-in functions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import text as tx
from tallywright.operators.aggregates import model_price


def strip_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def item_id(org: Column, kind: Column, ref: Column, period: Column, endpoint: Column, guid: Column) -> Column:
    """SC05. Stable id of one unit of work."""
    blank = [F.coalesce(c.cast("string"), F.lit("")) for c in (org, kind, ref, period, endpoint, guid)]
    return F.concat(F.lit("cfr_"), F.substring(F.sha2(F.concat_ws("|", *blank), 256), 1, 20))


def batch_id(ids: Column, day: Column) -> Column:
    """SC05. Stable id of a bounded batch: its day and its sorted item ids."""
    basis = F.concat(day, F.lit("|"), F.array_join(F.array_sort(ids), ","))
    return F.concat(F.lit("batch_"), F.substring(F.sha2(basis, 256), 1, 16))


def strip_html(html: Column) -> Column:
    """SC06. Text of a page: block ends become line ends, tags go until none is left, entities are decoded with the ampersand last.

    A removal can join two halves of a tag. Every pass that changes the text uses up at least one ``<``, so the number of
    those left after the first pass bounds the passes that are still needed; usually it is zero.
    """
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?i)</(p|div|li)>", "\n")
    s = F.regexp_replace(s, "<[^>]*>", "")
    left = F.length(s) - F.length(F.translate(s, "<", ""))
    # The fold carries whether the last pass changed the text; once it did not, the passes that are left cost nothing.
    once = lambda t: F.transform(F.array(F.regexp_replace(t, "<[^>]*>", "")), lambda new: F.struct(new.alias("t"), (new != t).alias("go")))[0]
    again = F.aggregate(F.sequence(F.lit(1), F.greatest(left, F.lit(1))), F.struct(s.alias("t"), (left > 0).alias("go")), lambda acc, _: F.when(acc["go"], once(acc["t"])).otherwise(acc))
    s = F.when(left > 0, again["t"]).otherwise(s)
    for pattern, to in ((r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), ("&#39;", "'"), (r"&quot;", '"'), (r"(?i)&amp;", "&")):
        s = F.regexp_replace(s, pattern, to)
    s = F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), "\n{2,}", "\n")
    return strip_all(s)


def ascii_safe(c: Column) -> Column:
    """SC07. Printable ASCII on one line."""
    s = F.translate(F.coalesce(c, F.lit("")), "‘’“”–—", "''\"\"--")
    s = F.regexp_replace(F.replace(s, F.lit("…"), F.lit("...")), r"\r?\n", " ")
    return strip_all(F.regexp_replace(F.regexp_replace(s, r"[^\x20-\x7E]", "?"), r"\s+", " "))


def ascii_cap(c: Column, n: int) -> Column:
    """SC07. ASCII text cut to ``n`` characters, three of them dots."""
    s = ascii_safe(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, max(0, n - 3)), F.lit("...")))


def cap_list(items: Column, max_items: int = 20, max_chars: int = 60) -> Column:
    """SC07. The first non-blank items, each capped."""
    kept = F.filter(items, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.transform(F.slice(kept, 1, max_items), lambda x: ascii_cap(x, max_chars))


def coerce_enum(c: Column, allowed: Sequence[str], fallback: str = "") -> Column:
    """SC08. The vocabulary's spelling of the value, or the fallback."""
    m = F.create_map(*[F.lit(x) for a in reversed(allowed) for x in (a.lower(), a)])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(c))), F.lit(fallback))


def valid_date(c: Column) -> Column:
    """SC09. A calendar-valid date prefix between 1990 and 2100, else an empty string."""
    d = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4}-\d{2}-\d{2})", 1)
    p = F.try_to_timestamp(F.nullif(d, F.lit("")), F.lit("yyyy-MM-dd"))
    ok = p.isNotNull() & F.year(p).between(1990, 2100)
    return F.when(ok, F.concat(d, F.lit("T00:00:00.000Z"))).otherwise("")


def parse_amount(c: Column) -> Column:
    """SC10. struct(amount, currency) of the first number and the first known currency mark."""
    s = F.coalesce(c, F.lit(""))
    cur = (F.when(F.contains(s, F.lit("€")) | tx.matches(s, r"\bEUR\b", True), "EUR").when(F.contains(s, F.lit("£")) | tx.matches(s, r"\bGBP\b", True), "GBP")
           .when(F.contains(s, F.lit("$")) | tx.matches(s, r"\bUSD\b", True), "USD").otherwise(""))
    n = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"-?[0-9]+(\.[0-9]+)?", 0)
    return F.struct(n.try_cast("double").alias("amount"), cur.alias("currency"))


def path_parts(path: Column) -> Column:
    """SC12. struct(dirname, entity, date, ext)."""
    dirs = F.split(path, "/")
    first = F.trim(dirs[0])
    return F.struct(
        F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0))), "/").alias("dirname"),
        F.when(first == "", "(root)").otherwise(first).alias("entity"),
        F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1).alias("date"),
        F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


def extract_mentions(c: Column, chars: int | None = None) -> Column:
    """SC13. struct(url, page_id, verified_date, signed_off_by) found in the text, or in its leading ``chars`` characters (as published 20000)."""
    s = tx.leading(F.coalesce(c, F.lit("")), chars)
    url = F.regexp_replace(F.regexp_extract(s, r"https?://[^\s\")\]]+", 0), r"[.,;]+$", "")
    dashed = F.regexp_extract(c, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 0)
    plain = F.regexp_extract(c, tx.ascii_regex(r"\b[0-9a-f]{32}\b", True), 0)
    v1 = F.regexp_extract(s, r"(?i)(?:last )?verified(?: as of)?[:\s]+(\d{4}-\d{2}-\d{2})", 1)
    v2 = F.regexp_extract(s, r"(?i)confirmed as of[:\s]+(\d{4}-\d{2}-\d{2})", 1)
    by = F.regexp_extract(s, r"(?:signed off by|approved by|reviewed by)[:\s]+([A-Z][a-zA-Z.'-]+(?:\s+[A-Z][a-zA-Z.'-]+){0,2})", 1)
    return F.struct(url.alias("url"), F.when(dashed != "", dashed).otherwise(plain).alias("page_id"),
                    valid_date(F.when(v1 != "", v1).otherwise(v2)).alias("verified_date"), F.trim(by).alias("signed_off_by"))


def legacy_date(c: Column) -> Column:
    """SC14. /Date(ms+0000)/ as an ISO time; other text stays."""
    ms = F.regexp_extract(F.coalesce(c, F.lit("")), r"^/Date\((-?\d+)", 1)
    iso = F.date_format(F.timestamp_millis(F.nullif(ms, F.lit("")).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(ms != "", F.coalesce(iso, F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def days_until(due: Column, now: Column) -> Column:
    """SC15. Whole UTC days to a date."""
    return F.datediff(due, now)


def expand_year(y: Column, pivot: int) -> Column:
    """SC16. Two-digit years up to the pivot are 20xx, others 19xx."""
    n = y.try_cast("int")
    return F.when(F.length(y) == 2, F.when(n <= pivot, n + 2000).otherwise(n + 1900)).otherwise(n)


def canonical_json_hash(doc: Column) -> Column:
    """SC18. Hash of the JSON text with keys in order at every level; VARIANT stores object keys sorted. Null where
    the text is not JSON."""
    return F.sha2(F.to_json(F.try_parse_json(doc)), 256)


NOTE_LABELS = {"SUBJECT": "subject", "CLAIM": "claim", "EVIDENCE": "evidence", "CONF": "confidence", "CONFIDENCE": "confidence", "SUPERSEDES": "supersedes", "TAGS": "tags"}


def parse_labelled_text(df: DataFrame, text: str) -> DataFrame:
    """SC19. ``LABEL: value | LABEL: value`` as fields, tags distinct, with validation errors and the text rendered back."""
    segs = F.filter(F.transform(F.split(F.col(text), r"\|"), strip_all), lambda s: s.rlike(r"(?s)^[A-Za-z]+\s*:\s*.+$"))
    pair = lambda s: F.struct(F.upper(F.regexp_extract(s, r"^([A-Za-z]+)", 1)).alias("k"), strip_all(F.regexp_extract(s, r"(?s)^[A-Za-z]+\s*:\s*(.*)$", 1)).alias("v"))
    d = df.withColumn("_p", F.transform(segs, pair))

    def last(field: str) -> Column:
        names = [k for k, v in NOTE_LABELS.items() if v == field]
        return F.try_element_at(F.filter("_p", lambda p: p["k"].isin(*names) & (p["v"] != "")), F.lit(-1))["v"]

    conf = F.lower(last("confidence"))
    tags = F.array_distinct(F.filter(F.transform(F.split(last("tags"), ","), strip_all), lambda x: x != ""))
    d = d.withColumn("subject", last("subject")).withColumn("claim", last("claim")).withColumn("evidence", last("evidence"))
    d = d.withColumn("_c", conf).withColumn("supersedes_id", last("supersedes")).withColumn("tags", F.when(F.size(tags) > 0, tags))
    ok = F.col("_c").isin("low", "med", "high")
    d = d.withColumn("confidence", F.when(ok, F.col("_c")))
    errors = F.array_compact(F.array(
        F.when(F.col("subject").isNull(), "subject is required"), F.when(F.col("claim").isNull(), "claim is required"),
        F.when(F.col("_c").isNotNull() & ~ok, "confidence must be low, med or high")))
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label + ": "), c))
    back = F.concat_ws(" | ", part("SUBJECT", F.col("subject")), part("CLAIM", F.col("claim")), part("EVIDENCE", F.col("evidence")), part("CONF", F.col("confidence")),
                       part("SUPERSEDES", F.col("supersedes_id")), part("TAGS", F.array_join("tags", ",")))
    return d.withColumn("errors", errors).withColumn("rendered", back).drop("_p", "_c")


def first_json_object(c: Column, schema: str) -> Column:
    """SC20. The object between the first opening and the last closing brace; null when there is none or it is broken."""
    whole = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(whole != "", F.from_json(whole, schema, {"mode": "PERMISSIVE"}))


def price_cost(model: Column, tok_in: Column, tok_out: Column, cache_write: Column | None = None, cache_read: Column | None = None) -> Column:
    """SC21. Dollars for the tokens of one row."""
    pi, po, pw, pr = model_price(model)
    zero = F.lit(0)
    return (tok_in * pi + tok_out * po + (zero if cache_write is None else cache_write) * pw + (zero if cache_read is None else cache_read) * pr) / 1e6


def saving(from_model: Column, to_model: Column, tok_in: Column, tok_out: Column) -> Column:
    """SC21. struct(from_usd, to_usd, saved_usd, saved_pct) of moving the tokens to another model."""
    a, b = price_cost(from_model, tok_in, tok_out), price_cost(to_model, tok_in, tok_out)
    return F.struct(a.alias("from_usd"), b.alias("to_usd"), (a - b).alias("saved_usd"), F.coalesce(F.try_divide(a - b, a) * 100, F.lit(0.0)).alias("saved_pct"))


def first_divergence(a: Column, b: Column, context: int = 50) -> Column:
    """SC22. struct(index, a_context, b_context) of the first different character of two collapsed texts; null when equal."""
    x, y = tx.collapse_spaces(a), tx.collapse_spaces(b)
    at = F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
    start = F.greatest(at - 1 - context, F.lit(0))
    cut = lambda s: F.substring(s, start + 1, at - 1 + context - start)
    return F.when(x != y, F.struct((at - 1).alias("index"), cut(x).alias("a_context"), cut(y).alias("b_context")))


