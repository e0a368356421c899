"""Language identification by Bayesian fusion of evidence.

For every text and language: likelihood of its letter trigrams, of the language that markup or metadata declares, of the address
suffix, and a prior of its host. All tables are counted over all rows by grouped aggregation:

* trigram counts of the texts that declare a language (a row per task, language and cell, then summed);
* how often a language, as the trigrams alone see it, is declared as each code or stands under each suffix;
* host priors that shrink to the prior of the host's suffix, which shrinks to that of all rows.

"und" competes with a background in which letters are independent; a text without letters is "und". A row is kept if its best
language is one of ``languages`` with probability of at least ``least``.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import only, saved
from tallywright.llm.transducer import END, LETTER, LL, EE, ONE, RV, batches, char_classes

CELLS = 1 << 14
LANGUAGES = ("de", "en", "es", "fr")
NONE = "und"
PART = 0.3  # share of the trigrams' log-likelihood that counts, for overlapping trigrams are not independent
BATCH = 500_000  # characters whose trigrams are held at once
NOISE = 0.1  # share of a text's trigrams that any language expects from names, codes and the like
SHRINK = 20.0  # rows of the wider group that a host's or a suffix's own rows are mixed with


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all letter trigrams (runs of other characters are one blank), cells of their last letters, and where texts start."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    classes = char_classes()[points]
    ends = np.cumsum([len(t) + 1 for t in low]) - 1
    classes[ends] = END
    letter = np.isin(classes, (LETTER, ONE, RV, LL, EE))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    text = np.searchsorted(ends, np.flatnonzero(keep))
    c = np.where(letter, points, 0)[keep].astype(np.uint64)
    before, two = np.zeros_like(c), np.zeros_like(c)
    before[1:], two[2:] = c[:-1], c[:-2]
    same1, same2 = np.zeros(len(c), bool), np.zeros(len(c), bool)
    same1[1:], same2[2:] = text[1:] == text[:-1], text[2:] == text[:-2]
    before, two = np.where(same1, before, 0), np.where(same2, two, 0)
    h = (c * np.uint64(0x9E3779B97F4A7C15)) ^ (before * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (two * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    cell = (h >> np.uint64(50)).astype(np.int64)
    one = ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    return cell, one, np.searchsorted(text, np.arange(len(texts) + 1))


def _counts(rows: DataFrame, languages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts by language, and counts of single letters over all."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, letters = np.zeros((len(languages), CELLS), np.int64), np.zeros(4096, np.int64)
        for part in parts:
            texts, declared = part.column("text").to_pylist(), part.column("declared").to_pylist()
            for a, b in batches(texts, BATCH):
                cell, one, at = _trigrams(texts[a:b])
                letters += np.bincount(one, minlength=4096)
                lang = np.array([languages.index(d) if d in languages else -1 for d in declared[a:b]])
                lang = np.repeat(lang, np.diff(at))
                grams += np.bincount((lang * CELLS + cell)[lang >= 0], minlength=grams.size).reshape(grams.shape)
        table = np.append(grams.ravel(), letters)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["cell", "n"])

    # At most a row per language and cell.
    got = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(languages) * CELLS + 4096)
    table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return table[:-4096].reshape(len(languages), CELLS), table[-4096:]


def identify(df: DataFrame, key: str, text: str = "text", declared: str | Column | None = None, suffix: str | Column | None = None, host: str | Column | None = None,
             languages: tuple[str, ...] = LANGUAGES, least: float = 0.5) -> DataFrame:
    """One row per input row: the key under its own name, language, probability, kept, and what the trigrams alone say (text_language).

    ``declared`` may hold a full tag ("en-US"); its first part counts, in lower case. Evidence that is null, and a null text, says nothing.
    Without trigrams in any declared language the background takes all rows. Repeated rows are judged one by one; ties go to the
    language first in alphabetical order; other columns are ignored; an empty table gives no rows.
    """
    none = F.lit(None).cast("string")
    tag = F.lower(F.substring_index(F.translate((F.col(f"`{declared}`") if isinstance(declared, str) else declared), "_", "-"), "-", 1)) if declared is not None else none
    rows = only(df, key=key, text=text, declared=tag, suffix=suffix if suffix is not None else none, host=host if host is not None else none)
    grams, letters = _counts(rows.select("text", "declared"), languages)
    share = (1 - NOISE) * (grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * CELLS)
    share[grams.sum(axis=1) == 0] = 0.0  # a language that no row declares
    alone = np.log((letters + 0.1) / (letters.sum() + 0.1 * len(letters)))
    names = [*languages, NONE]

    def likelihood(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, out, found = part.column("text").to_pylist(), [], []
            for a, b in batches(texts, BATCH):
                cell, one, at = _trigrams(texts[a:b])
                sums = np.zeros((b - a, len(names)))
                owner = np.repeat(np.arange(b - a), np.diff(at))
                noise = background(one, owner)
                chance = NOISE * np.exp(noise)
                for k in range(len(languages)):
                    sums[:, k] = np.bincount(owner, weights=np.log(share[k][cell] + chance), minlength=b - a)
                sums[:, -1] = np.bincount(owner, weights=noise, minlength=b - a)
                out.append(sums * PART)
                found.append(np.diff(at) > 0)
            if out:
                flat = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "declared", "suffix", "host")), pa.array(list(flat), pa.list_(pa.float64())), pa.array(np.concatenate(found))], ["key", "declared", "suffix", "host", "said", "letters"])

    def background(one: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Trigrams of three independent letters."""
        own = alone[one]
        before, two = np.roll(own, 1), np.roll(own, 2)
        if len(own) > 1:
            before[1:][owner[1:] != owner[:-1]] = 0
        before[:1] = 0
        two[:2] = 0
        if len(own) > 2:
            two[2:][owner[2:] != owner[:-2]] = 0
        return own + before + two

    kind = rows.schema["key"].dataType.simpleString()
    said = saved(rows.mapInArrow(likelihood, f"key {kind}, declared string, suffix string, host string, said array<double>, letters boolean"), "likelihoods")
    first = F.array_position("said", F.array_max("said")).cast("int") - 1
    said = said.withColumn("guess", F.when(F.col("letters"), F.get(F.array(*map(F.lit, names)), first)))
    judged = said.filter(F.col("guess").isNotNull())

    def shares(columns: list[str]) -> DataFrame:
        """Counts of guesses, an array by language, for every value of the columns."""
        return judged.filter(reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.lit(True))).groupBy(*columns).agg(F.array(*(F.count(F.when(F.col("guess") == x, 1)) for x in names)).alias("n"))

    total = [float(x) for x in (shares([]).first() or [[0] * len(names)])[0]]
    mass = sum(total) or 1.0
    base = F.array(*(F.lit((x + 1) / (mass + len(names))) for x in total))
    each = F.array(*(F.lit(x + 1.0) for x in total))

    def shrunk(n: Column, wider: Column) -> Column:
        own = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.transform(wider, lambda p, k: (F.get(n, k) + SHRINK * p) / (own + SHRINK))

    def likely(n: str, values: int) -> Column:
        """log P(value | language) from the counts of one value among all rows of the language."""
        return F.transform(each, lambda all_, k: F.log((F.coalesce(F.get(F.col(n), k), F.lit(0)) + 0.5) / (all_ + 0.5 * values)))

    by_declared, by_suffix = shares(["declared"]).withColumnRenamed("n", "n_declared"), shares(["suffix"]).withColumnRenamed("n", "n_suffix")
    hosts = shares(["host", "suffix"]).unionByName(judged.filter("host IS NOT NULL AND suffix IS NULL").groupBy("host").agg(F.array(*(F.count(F.when(F.col("guess") == x, 1)) for x in names)).alias("n")).withColumn("suffix", none)).withColumn("under", F.coalesce("suffix", F.lit("")))
    priors = hosts.join(by_suffix, "suffix", "left").select("host", "under", shrunk(F.col("n"), F.when(F.col("n_suffix").isNotNull(), shrunk(F.col("n_suffix"), base)).otherwise(base)).alias("prior"))
    n_declared, n_suffix = (max(1, t.count()) for t in (by_declared, by_suffix))
    facts = said.withColumn("under", F.coalesce("suffix", F.lit(""))).join(by_declared, "declared", "left").join(by_suffix, "suffix", "left").join(priors, ["host", "under"], "left")
    zero = F.array_repeat(F.lit(0.0), len(names))
    parts = [F.col("said"), F.when(F.col("declared").isNotNull(), likely("n_declared", n_declared + 1)).otherwise(zero), F.when(F.col("suffix").isNotNull(), likely("n_suffix", n_suffix + 1)).otherwise(zero), F.transform(F.coalesce("prior", base), lambda x: F.log(x))]
    fused = facts.withColumn("odds", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)).withColumn("most", F.array_max("odds"))
    weight = F.aggregate("odds", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    best = F.get(F.array(*map(F.lit, names)), F.array_position("odds", F.col("most")).cast("int") - 1)
    language = F.when(F.col("letters"), best).otherwise(NONE)
    out = fused.select(F.col("key").alias(key), language.alias("language"), F.when(F.col("letters"), 1 / weight).otherwise(F.lit(1.0)).alias("probability"), "guess")
    return out.select(key, "language", "probability", ((F.col("language") != NONE) & (F.col("probability") >= least)).alias("kept"), F.coalesce("guess", F.lit(NONE)).alias("text_language"))


def page_evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, text without markup, declared language, host and address suffix of web pages."""
    rows = only(pages, page_id=page_id, url=url, html=html)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1), F.lit(""))
    return rows.select("page_id", bare.alias("text"), declared.alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"))
