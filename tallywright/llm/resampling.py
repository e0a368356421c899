"""Importance resampling of documents towards the word n-grams of a target table.

Every run of 1 to ``size`` consecutive words is a feature, put into one of ``buckets`` by CRC-32. A bucket's gain is the log ratio of its
smoothed shares in the target and in the documents, in thousandths; a document's weight is the sum of its features' gains. Gumbel noise
from a hash of the id makes the highest scores a weighted draw without replacement.

A task interns the n-grams of a batch in an open-addressed table (``interning``), works out the bucket of each different one once, and
counts or sums over the slots of the occurrences. Only bucket counts are shuffled, one row for a bucket and task; gains are one number
for a bucket. Texts are read twice and never shuffled.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import numbered, only, saved
from tallywright.llm.interning import Interned, padded

SLICE_BYTES = 4_000_000  # texts of so many bytes are worked on at once, a longer one alone
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD = np.zeros(256, bool)  # of UTF-8: every byte of a character beyond ASCII is a word byte
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def slices(column: pa.Array, most: int | None = None) -> Iterator[slice]:
    """Rows of a string column in stretches of at most ``most`` bytes (``SLICE_BYTES``), but of one row at least."""
    most = most or SLICE_BYTES
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right"))
        b = max(b, a + 1)
        yield slice(a, b)
        a = b


class Features:
    """Interned n-grams of some texts: ``table``, ``row`` (the text of every occurrence) and the number of ``words`` of every text."""

    def __init__(self, texts: list[str | None], size: int):
        parts = [(t or "").encode() for t in texts]
        data = LOWER[padded(b"\n".join(parts) + b"\n")]
        inside = WORD[data]
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        borders = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        at = np.searchsorted(start, borders)
        self.words = np.diff(at)
        row = np.repeat(np.arange(len(parts)), self.words)
        if size > 1:
            # Words with one space after each, so that a run of words is one slice.
            keep = inside.copy()
            keep[end] = True
            place = np.cumsum(keep) - 1
            data = np.where(inside, data, np.uint8(32))[keep]
            start, end = place[start], place[end]
            data = padded(data.tobytes())
        firsts, lasts, rows = [], [], []
        for k in range(size):
            n = max(len(start) - k, 0)
            whole = np.flatnonzero(row[:n] == row[k:])
            firsts.append(start[whole])
            lasts.append(end[whole + k])
            rows.append(row[whole])
        first = np.concatenate(firsts)
        self.row = np.concatenate(rows)
        self.table = Interned(data, first, np.concatenate(lasts) - first)

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of every slot."""
        return np.array([zlib.crc32(s) % n for s in self.table.strings()], np.int64)


def bucket_counts(texts: DataFrame, text: str, size: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of all texts fall into it; buckets without any have no row."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            column = part.column(0)
            for s in slices(column):
                f = Features(column[s].to_pylist(), size)
                np.add.at(total, f.buckets(buckets), f.table.count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return only(texts, text=text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s_all, t_all = float(sum(documents.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((documents.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, n_features, n_words and weight of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, column = part.columns
            for s in slices(column):
                f = Features(column[s].to_pylist(), size)
                n = len(f.words)
                gain = gains[f.buckets(len(gains))][f.table.slot]
                weight = np.zeros(n, np.int64)
                np.add.at(weight, f.row, gain)
                yield pa.RecordBatch.from_arrays([ids[s], pa.array(np.bincount(f.row, minlength=n)), pa.array(f.words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hexadecimal digits of sha256("seed:id"); no id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", size: int = 1, buckets: int = 10_000,
             least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every document with n_features, weight, score and rank.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) with the highest scores are drawn and ranked from 1,
    ties to the smaller id (null first), then to the smaller weight and number of features; the others have a null rank. Each row is a document: rows that share an id are
    scored by themselves. A null or empty text has no features and weight 0. An empty target gives every bucket a count of 0. Other columns
    are ignored. The scores are written to the shared folder before ranking.
    """
    # At most one row for each bucket comes to the driver.
    counted = [{r.bucket: r.n for r in bucket_counts(df, c, size, buckets).collect()} for df, c in ((docs, text), (target, target_text))]
    gains = bucket_gains(*counted, buckets)
    rows = saved(weighed(docs, gains, doc_id, text, size).withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights")
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    ranked = numbered(fit, [F.col("score").desc(), "doc_id", "weight", "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
