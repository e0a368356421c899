"""Chunking, classification, metadata and text assembly of documents.

Python appears in three row functions whose loops no expression states: the chunker, the budget shrinker and the
positions of date matches. They run as Arrow pandas functions and return arrays that are exploded.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from datetime import date
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import fixed, text as tx
from tallywright.functions.ordered import bucketed_running
from tallywright.operators import scalars as sc
from tallywright.operators.windows import collapse_near_spans, collision_suffix

# Chunking --------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[.!?][\"')\]]?(?=\s)\s+")


class Breaks:
    """All places of a text where a chunk may end, found in one pass for each kind, and asked by bisection."""

    def __init__(self, text: str):
        self.blank = [m.start() for m in re.finditer(r"\n(?=\n)", text)]
        sentences = [(m.start(), m.start() + len(m[0].rstrip()), m.end()) for m in _SENTENCE.finditer(text)]
        self.sentence, self.gap, self.after = map(list, zip(*sentences)) if sentences else ([], [], [])
        self.line = [m.start() for m in re.finditer(r"\n", text)]
        self.word = [m.start() for m in re.finditer(" ", text)]
        self.white = [m.start() for m in re.finditer(r"\s", text)]

    def last(self, low: int, high: int) -> int | None:
        """End of the last paragraph, else sentence, else line, else word that lies between the two places."""
        k = bisect_left(self.blank, high - 1) - 1
        if k >= 0 and self.blank[k] > low:
            return self.blank[k] + 2
        k = bisect_left(self.gap, high) - 1
        if k >= 0 and self.sentence[k] >= low:
            return min(self.after[k], high)
        for places in (self.line, self.word):
            k = bisect_left(places, high) - 1
            if k >= 0 and places[k] > low:
                return places[k] + 1
        return None

    def word_start(self, low: int, high: int) -> int:
        """The place after the first white space from ``low`` on, if it comes before ``high``."""
        k = bisect_left(self.white, low)
        return self.white[k] + 1 if k < len(self.white) and self.white[k] < high else low


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every chunk. The last 30 percent of a full chunk are searched for a break; the next chunk starts ``overlap``
    before, moved to a word within 60 characters."""
    if not text.strip():
        return []
    overlap, spare, breaks = max(0, min(overlap, size // 2)), max(1, int(size * 0.3)), Breaks(text)
    bounds = [(0, len(text))]
    while bounds[-1][1] - bounds[-1][0] > size:
        start = bounds[-1][0]
        end = breaks.last(max(start, start + size - spare), start + size)
        end = end if end is not None and end > start else start + size
        back = end - overlap
        then = breaks.word_start(back, min(back + 60, end)) if back > start else back
        bounds[-1:] = [(start, end), (then if then > start else end, len(text))]
    return bounds


def chunk_pieces(text: str | None, size: int = 2000, overlap: int = 200) -> list[str]:
    """Chunks of at most ``size`` characters; each starts up to ``overlap`` characters before the end of the one before."""
    return [text[a:b] for a, b in chunk_bounds(text, size, overlap)] if text else []


def chunk_text(docs: DataFrame, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """DP01. One row per chunk with its number from 0; blank texts have none."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda v: chunk_pieces(v, size, overlap))
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(pieces(F.col(text))).alias("ordinal", "chunk"))


def chunk_rows(catalog: DataFrame, store: str, text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """DP02. Chunk documents: id from the path's hash, parent, paths, title, content hash and word count of the whole text."""
    d = catalog.select("path", "sha256", "entity", text, tx.word_count(F.col(text)).alias("word_count"), F.sha1("path").alias("parent_id"))
    c = chunk_text(d, text, size, overlap)
    return c.select(F.concat_ws("_", "parent_id", F.col("ordinal").cast("string")).alias("chunk_id"), "parent_id", F.concat(F.lit(store + "/"), "path").alias("path"),
                    sc.path_parts(F.col("path")).getField("dirname").alias("source_path"), tx.basename(F.col("path")).alias("title"), "ordinal", "chunk",
                    F.coalesce("sha256", F.lit("")).alias("content_hash"), "entity", "word_count")


# Classification and metadata ------------------------------------------------------------------------------------------

def classify_category(docs: DataFrame, path: str, text: str, rules: Sequence[tuple[str, str]], material: Sequence[str], other: str | None = None, chars: int | None = None) -> DataFrame:
    """DP03. First rule that matches the path and the text, else the non-accounting pattern, else the inbox.

    ``chars`` restricts the look to the first characters of path and text; as published it is 8000.
    """
    hay = F.lower(tx.leading(F.concat(F.regexp_replace(path, "[/_-]", " "), F.lit(" \n "), F.coalesce(text, F.lit(""))), chars))
    d = docs.withColumn("_hay", hay)
    cat = None
    for folder, pattern in rules:
        hit = tx.matches(F.col("_hay"), pattern, pattern != pattern.lower())
        cat = F.when(hit, folder) if cat is None else cat.when(hit, folder)
    if other:
        cat = cat.when(tx.matches(F.col("_hay"), other, other != other.lower()), "_NON-ACCOUNTING")
    d = d.withColumn("category", cat.otherwise("_INBOX-UNCLASSIFIED")).drop("_hay")
    return d.withColumn("material", F.col("category").isin(*material))


def rule_metadata(docs: DataFrame, path: str, text: str, chars: int | None = None, claim_chars: int | None = None) -> DataFrame:
    """DP04. Source type, confidentiality and flags from path and text. ``chars`` and ``claim_chars`` restrict the look to leading
    characters for the confidentiality rules and the claim rule; as published they are 2000 and 20000."""
    p, s = F.lower(path), F.coalesce(text, F.lit(""))
    hay = F.lower(F.concat(F.col(path), F.lit(" "), tx.leading(s, chars)))
    m = lambda c, pat: tx.matches(c, pat)
    kind = F.when(m(p, r"session-checkpoint|digest|_recovery/"), "ai_memo").when(m(p, r"\.(json|csv)$"), "machine_generated").otherwise("primary_source")
    conf = (F.when(m(hay, r"attorney[- ]client|attorney[- ]privileged"), "attorney_privileged").when(m(hay, r"\bssn\b|social security number"), "personal_pii")
            .when(m(p, r"\bpublished\b|\bpublic[_-]site\b"), "public").otherwise(""))
    return docs.withColumn("source_type", kind).withColumn("confidentiality", conf).withColumn(
        "mnpi_flag", m(hay, r"\bmnpi\b|material non-?public|reg[- ]fd|insider trading")).withColumn(
        "medical_claims", tx.matches(tx.leading(s, claim_chars), r"\bhearing aid\b|\bfda[- ]clear(ed|ance)\b|\btreats? hearing loss\b|medical device claim", True))


def metadata_conform(df: DataFrame, fields: Sequence[dict]) -> DataFrame:
    """DP05. Columns cast to their field kinds with caps and vocabularies; blanks and empty lists become null.

    A field is {name, kind: scalar|list|bool|int|double|date, max_len, max_items, max_item_len, enum, fallback}.
    """
    out = []
    for f in fields:
        c, k = F.col(f["name"]), f["kind"]
        if k == "list":
            l = sc.cap_list(c, f.get("max_items", 20), f.get("max_item_len", 60))
            v = F.when(F.size(l) > 0, l)
        elif k == "bool":
            v = F.coalesce(c.cast("boolean"), F.lit(False))
        elif k in ("int", "double"):
            n = c.cast("string").try_cast("bigint" if k == "int" else "double")
            v = n if k == "int" else F.when(~F.isnan(n), n)
        elif k == "date":
            d = sc.valid_date(c.cast("string"))
            v = F.when(d != "", d)
        else:
            s = sc.ascii_cap(c.cast("string"), f["max_len"]) if f.get("max_len") else sc.ascii_safe(c.cast("string"))
            if f.get("enum"):
                s = sc.coerce_enum(s, f["enum"], f.get("fallback", ""))
            v = F.when(s != "", s)
        out.append(v.alias(f["name"]))
    return df.select(*[c for c in df.columns if c not in {f["name"] for f in fields}], *out)


def segment_labels(df: DataFrame, segments: str, labels: Sequence[str], max_items: int | None = None, locator_chars: int | None = None, rationale_chars: int | None = None) -> DataFrame:
    """DP06. Segments with a known label and a locator, with the distinct labels and the mixed flag. ``max_items``, ``locator_chars`` and ``rationale_chars`` cut them (as published 6, 220 and 140)."""
    capped = lambda c, n: sc.ascii_safe(c) if n is None else sc.ascii_cap(c, n)
    clean = F.transform(F.coalesce(segments, F.array().cast(df.schema[segments].dataType)), lambda s: F.struct(
        sc.coerce_enum(s["label"], labels).alias("label"), capped(s["locator"], locator_chars).alias("locator"), capped(s["rationale"], rationale_chars).alias("rationale")))
    kept = F.filter(clean, lambda s: (s["label"] != "") & (s["locator"] != ""))
    kept = kept if max_items is None else F.slice(kept, 1, max_items)
    d = df.withColumn("segments_kept", kept)
    return d.withColumn("labels", F.array_distinct(F.transform("segments_kept", lambda s: s["label"]))).withColumn("mixed", F.size("segments_kept") > 0)


def shrunk_lengths(length: int, least: int, share: float = 0.7) -> list[int]:
    """The lengths that a field passes through: cut to a share of itself while it is longer than ``least``."""
    out = [length]
    while out[-1] > least:
        out.append(int(out[-1] * share))
    return out


def cut_lengths(sizes: dict[str, int], budget: int, order: Sequence[str], least: int = 40) -> dict[str, int]:
    """The lengths of the fields that are cut, in turns, in the given order, until names and values together fit.

    Every field's lengths are known beforehand, so all cuts stand in one list, turn by turn; the first whose running saving is enough
    is the last one made.
    """
    over = sum(len(k) + n for k, n in sizes.items()) - budget
    lengths = {k: shrunk_lengths(sizes[k], least) for k in order if sizes.get(k)}
    cuts = sorted((turn, place, k) for place, k in enumerate(lengths) for turn in range(1, len(lengths[k])))
    saved = list(accumulate(lengths[k][turn - 1] - lengths[k][turn] for turn, _, k in cuts))
    made = cuts[:bisect_left(saved, over) + 1] if over > 0 else []
    return {k: lengths[k][turn] for turn, _, k in made}


def shrink_pairs(pairs: dict[str, str | None], budget: int, order: Sequence[str], least: int = 40) -> dict[str, str | None]:
    """Fields cut in turns, in the given order, until names and values together fit."""
    final = cut_lengths({k: len(v or "") for k, v in pairs.items()}, budget, order, least)
    return {k: v[:final[k]] if k in final else v for k, v in pairs.items()}


def shrink_to_budget(df: DataFrame, fields: Sequence[str], budget: int = 7200, order: Sequence[str] = fixed.SHRINK_ORDER) -> DataFrame:
    """DP07. The string ``fields`` of each row within the budget, with the resulting size and whether it is still over.

    Python decides on lengths only; no text leaves the executor's own memory.
    """
    fields = list(fields)
    text = {f: F.col(f) if isinstance(df.schema[f].dataType, T.StringType) else F.lit(None).cast("string") for f in fields}

    @F.pandas_udf(T.StructType([T.StructField(f, T.IntegerType()) for f in fields]))
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, **cut_lengths(r, budget, order)} for r in frame.to_dict("records")]
        return pd.DataFrame(rows, columns=fields)

    d = df.withColumn("_f", fit(F.struct(*[F.coalesce(F.length(text[f]), F.lit(0)).alias(f) for f in fields])))
    size = sum((F.col(f"_f.{f}") for f in fields), F.lit(sum(len(f) for f in fields)))
    d = d.withColumn("bytes", size)
    keep = [c for c in df.columns if c not in fields]
    return d.select(*keep, *[F.substring(text[f], F.lit(1), F.col(f"_f.{f}")).alias(f) for f in fields], "bytes", (F.col("bytes") > budget).alias("over_budget"))


CONTEXT_MARK = "<!-- CTX-PREFIX v1 -->"


def context_prefix(text: Column, prefix: Column) -> Column:
    """DP08. The marker and the prefix in front of the text, once."""
    t = F.coalesce(text, F.lit(""))
    skip = (F.coalesce(prefix, F.lit("")) == "") | t.startswith(CONTEXT_MARK)
    return F.when(skip, t).otherwise(F.concat(F.lit(CONTEXT_MARK + "\n"), prefix, F.lit("\n\n"), t))


def additive_schema_merge(live: DataFrame, desired: T.StructType) -> DataFrame:
    """DP09. The live table with the fields it lacks added as nulls; shared fields keep the live type, live-only fields stay."""
    have = set(live.columns)
    desired_names = [f.name for f in desired]
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in desired]
    return live.select(*cols, *[F.col(c) for c in live.columns if c not in desired_names])


def blocks_to_text(blocks: DataFrame, doc: str) -> DataFrame:
    """DP10. LINE blocks as one text per document: lines by page and order, a blank line between pages.

    ``blocks`` has (doc, block_type, page, ordinal, text); a missing page is page 1. Pages are assembled apart from documents.
    """
    l = blocks.filter((F.col("block_type") == "LINE") & F.col("text").isNotNull()).withColumn("_p", F.coalesce("page", F.lit(1)))
    pages = l.groupBy(doc, "_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n").alias("_t"))
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda s: s["_t"]), "\n\n").alias("text"))


# Dates in text -------------------------------------------------------------------------------------------------------

_DATE_FORMS = [
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b", re.A), ("y", "m", "d")),
    (re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\b", re.A), ("m", "d", "y")),
    (re.compile(rf"\b({fixed.MONTHS})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", re.A | re.I), ("m", "d", "y")),
    (re.compile(rf"\b(\d{{1,2}})\s+({fixed.MONTHS})\.?,?\s+(\d{{4}})\b", re.A | re.I), ("d", "m", "y")),
]
_MONTH_NO = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def date_spans(text: str | None, pivot: int = 79) -> list[tuple[int, int, str]]:
    """(start, end, ISO date) of every valid date, by position."""
    found = []
    for order, (form, names) in enumerate(_DATE_FORMS):
        for m in form.finditer(text or ""):
            part = dict(zip(names, m.groups()))
            year = int(part["y"])
            if len(part["y"]) == 2:
                year += 2000 if year <= pivot else 1900
            month = _MONTH_NO.get(part["m"][:3].lower()) or int(part["m"])
            try:
                found.append((m.start(), order, m.end(), date(year, month, int(part["d"])).isoformat()))
            except ValueError:
                continue
    return [(s, e, d) for s, _, e, d in sorted(found)]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("date", T.StringType())]))


def raw_spans(text: Column) -> Column:
    @F.pandas_udf(SPAN)
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [{"start": a, "end": b, "date": d} for a, b, d in date_spans(v)])
    return find(text)


def deadline_candidates(docs: DataFrame, text: str, context: int = 100) -> DataFrame:
    """DP11. One row per date that is not a close repeat, with its surroundings and the deadline word on its line.

    A line that holds little more than the date also takes the line above it. Positions come from the row function; the
    repeat rule, the surroundings and the word are expressions.
    """
    keep = [c for c in docs.columns if c != text]
    d = docs.select(*keep, text, F.explode(collapse_near_spans(raw_spans(F.col(text)))).alias("s"))
    t, start, end = F.col(text), F.col("s.start"), F.col("s.end")
    before, after = F.substring(t, F.lit(1), start), F.substring(t, end + 1, F.length(t))
    d = d.withColumn("_up", F.substring_index(before, "\n", -2)).withColumn("_left", F.substring_index(before, "\n", -1)).withColumn("_right", F.substring_index(after, "\n", 1))
    line = F.concat("_left", F.substring(t, start + 1, end - start), "_right")
    alone = (F.length(tx.collapse_spaces(line)) <= 15) & (F.length("_left") < F.length(before))
    window = F.when(alone, F.concat(F.substring_index("_up", "\n", 1), F.lit(" "), line)).otherwise(line)
    low = F.greatest(start - context, F.lit(0))
    what = tx.collapse_spaces(F.substring(t, low + 1, end + context - low))
    word = F.regexp_extract(tx.collapse_spaces(window), "(?i)" + "|".join(fixed.DEADLINE_KEYWORDS), 0)
    d = d.select(*keep, start.alias("start"), F.col("s.date").alias("date"), what.alias("what"), F.trim(F.substring(t, start + 1, end - start)).alias("match_text"), F.nullif(word, F.lit("")).alias("keyword"))
    return d.withColumn("confidence", F.when(F.col("keyword").isNotNull(), "high").otherwise("low"))


def docket_delta(entries: DataFrame, since: str | None, source: str, chars: int | None = None) -> DataFrame:
    """DP12. New docket entries as unverified rows; ``entries`` has (date_filed, date_created, description, entry_number). ``chars`` cuts the text (as published 500)."""
    day = F.substring(F.coalesce("date_filed", "date_created"), 1, 10)
    desc = tx.collapse_spaces(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("(no description)")))
    label = F.when(F.col("entry_number").isNotNull(), F.concat(F.lit("Docket Entry #"), F.col("entry_number").cast("string"), F.lit(": "), desc)).otherwise(desc)
    keep = [c for c in entries.columns if c not in ("date_filed", "date_created", "description", "entry_number")]
    e = entries.select(*keep, day.alias("date"), tx.leading(label, chars).alias("what"), F.lit(source).alias("source"), F.lit(False).alias("verified"))
    e = e.filter(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return e.filter(F.col("date") > since) if since else e


def propose_mapping(catalog: DataFrame, order: str) -> DataFrame:
    """DP13. New path entity/category/name, with six hash characters where an earlier row has the same one."""
    folder = F.when(F.col("category") == "_NON-ACCOUNTING", F.concat(F.lit("_NON-ACCOUNTING/"), "entity")).otherwise(F.concat_ws("/", "entity", "category"))
    c = catalog.withColumn("_target", F.concat_ws("/", folder, tx.basename(F.col("path"))))
    return collision_suffix(c, "_target", order, "sha256").drop("_target")


# Conversations -----------------------------------------------------------------------------------------------------

_TURN = "type STRING, timestamp STRING, uuid STRING, role STRING, content STRING, message STRUCT<role: STRING, content: STRING>"


def journal_turns(lines: DataFrame, line: str, max_chars: int | None = None) -> DataFrame:
    """DP14. User and assistant text of transcript lines, tool envelopes left out.

    Content is a text or an array of parts; of an array the text parts count, for the assistant those longer than 20 characters.
    A line without a message object carries role and content itself. ``max_chars`` cuts long turns; as published it is 4000.
    """
    p = lines.withColumn("_m", F.from_json(line, _TURN))
    own = F.col("_m.message").isNull()
    content = F.when(own, F.col("_m.content")).otherwise(F.col("_m.message.content"))
    parts = F.from_json(content, "ARRAY<STRUCT<type: STRING, text: STRING>>")
    is_list = content.startswith("[")
    role = F.coalesce(F.when(own, F.col("_m.role")).otherwise(F.col("_m.message.role")), F.col("_m.type"))
    texts = lambda long: F.transform(F.filter(parts, lambda x: (x["type"] == "text") & (F.length(F.trim(F.coalesce(x["text"], F.lit("")))) > (20 if long else -1))), lambda x: x["text"])
    user = F.when(is_list, F.array_join(texts(False), " ")).otherwise(content)
    bot = F.when(is_list, F.trim(F.array_join(texts(True), "\n")))
    said = F.when(role == "user", user).when(role == "assistant", bot)
    drop = (role == "user") & (F.contains(said, F.lit("tool_result")) | F.contains(said, F.lit("This session is being continued from a previous conversation")))
    keep = [c for c in lines.columns if c != line]
    return p.filter((F.coalesce(said, F.lit("")) != "") & ~F.coalesce(drop, F.lit(False))).select(
        *keep, F.col("_m.timestamp").alias("ts"), F.when(role == "user", "IN").otherwise("OUT").alias("dir"), tx.leading(said, max_chars).alias("text"), F.substring("_m.timestamp", 1, 10).alias("day"))


def agent_day_body(turns: DataFrame, keys: Sequence[str], order: Sequence[str], max_chars: int | None = None, line_chars: int | None = None, bucket: Column | None = None) -> DataFrame:
    """DP15. The joined turns of an agent's day, all or the last ``max_chars`` characters; ``line_chars`` cuts each turn (as published
    24000 and 500).

    With a limit, turns are kept by their running length from the end, in buckets that follow the order (by default the hour of
    ``ts``), so the text is assembled from at most the turns that fit.
    """
    line = F.concat(F.lit("["), F.substring("ts", 12, 8), F.lit("] "), "dir", F.lit(": "), tx.leading(tx.collapse_spaces(F.col("text")), line_chars))
    t = turns.withColumn("_line", line)
    if max_chars is not None:
        t = t.withColumn("_b", bucket if bucket is not None else F.substring("ts", 1, 13))
        total = t.groupBy(*keys).agg(F.sum(F.length("_line") + 1).alias("_all"))
        r = bucketed_running(t, keys, F.col("_b"), order, {"_used": F.length("_line") + 1}).join(total, list(keys))
        # A line is needed when fewer than max_chars characters follow it.
        t = r.filter(F.col("_all") - F.col("_used") < max_chars)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda s: s["_line"]), "\n")
    out = t.groupBy(*keys).agg(body.alias("body"))
    return out if max_chars is None else out.withColumn("body", F.right("body", F.lit(max_chars)))
