"""Best-two-fit packing of token sequences.

Documents of equal length are interchangeable, so the packing is decided on the number of pieces of each length, a table
bounded by the sequence length whatever the size of the corpus. A bin is opened with the longest piece left and filled greedily
with the longest that fits; then its smallest piece gives way to two unpacked ones that fit the grown gap more tightly. The
same bin is repeated as often as the counts allow, which is what bin-by-bin packing would do. Every piece then finds its place by
its rank among the pieces of its length; ranks are counted in buckets, so no length, however common, meets in one task.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm import transducer
from tallywright.llm.common import only, saved

PIECE = "piece int, start long, length long"


def token_pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut only where longer than ``size``.

    Columns doc_id, piece (from 0), start, length, ids_crc32 (of the little-endian unsigned 32-bit ids) and, if asked for,
    ids. A null text is empty and has just the end id.
    """
    def cut(parts):
        for part in parts:
            texts, keys = part.column("text").to_pylist(), part.column("doc_id")
            for a, b in transducer.batches(texts):
                ids, at = transducer.encode(transducer.machine(tokenizer), texts[a:b])
                rows: list[tuple] = []
                for k in range(b - a):
                    own = np.append(ids[at[k]:at[k + 1]], end_id).astype("<u4")
                    for n, s in enumerate(range(0, len(own), size)):
                        p = own[s:s + size]
                        rows.append((a + k, n, s, len(p), zlib.crc32(p.tobytes()), p.astype(np.int32) if with_ids else None))
                cols = list(zip(*rows))
                arrays = [keys.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                if with_ids:
                    arrays.append(pa.array(list(cols[5]), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)])

    rows = only(df, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECE}, ids_crc32 long" + ", ids array<int>" * with_ids)


def two_fit_patterns(counts: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (pieces as (length, how many), times) for ``counts[length]`` pieces of each length."""
    left, out = counts.astype(np.int64).copy(), []
    lengths = np.flatnonzero(left)
    while len(lengths):
        used: dict[int, int] = {}

        def spare(length: int) -> int:
            return int(left[length]) - used.get(length, 0)

        def longest(room: int) -> int:
            k = bisect_right(lengths, room) - 1
            while k >= 0 and spare(int(lengths[k])) == 0:
                k -= 1
            return int(lengths[k]) if k >= 0 else 0

        gap = size
        while gap and (length := longest(gap)):
            n = min(spare(length), gap // length)
            used[length] = n
            gap -= n * length
        if gap and sum(used.values()) > 1:
            small = min(used)
            room = gap + small
            fit = np.array([x for x in lengths[:bisect_right(lengths, room)] if spare(int(x))], np.int64)
            if len(fit):
                other = np.searchsorted(fit, room - fit, side="right") - 1
                alone = (other == np.arange(len(fit))) & (left[fit] - [used.get(int(x), 0) for x in fit] < 2)
                other = np.where(alone, other - 1, other)
                total = np.where(other >= 0, fit + fit[other], 0)
                best = int(total.argmax())
                if total[best] > small:
                    for length in (int(fit[best]), int(fit[other[best]])):
                        used[length] = used.get(length, 0) + 1
                    used[small] -= 1
        used = {k: n for k, n in used.items() if n}
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        out.append((sorted(used.items(), reverse=True), times))
        lengths = lengths[left[lengths] > 0]
    return out


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces of this length in each sequence), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pieces, times in patterns:
        offset = 0
        for length, n in pieces:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, offset, n))
            ranks[length] = rank + n * times
            offset += n * length
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset; lengths are 1 to ``size``.

    Pieces of equal length take places in the order of their bucket, doc_id and piece. Repeated rows are placed one by one. An
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    # A row for each length and bucket; the driver gets one row for each length, at most ``size``.
    per = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    places = _places(two_fit_patterns(counts, size))
    base = per.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_bucket")
    names = pieces.columns
    keys = places[:, 0] << 40 | places[:, 1]

    def locate(parts):
        for part in parts:
            length, rank = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = places[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            step = rank - row[:, 1]
            sequence, offset = row[:, 2] + step // row[:, 4], row[:, 3] + step % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(locate, schema)


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = 4096) -> DataFrame:
    """The place of every piece of every document. Tokenizes once; the pieces are written to the shared folder."""
    return pack(saved(token_pieces(df, tokenizer, doc_id, text, end_id, size), "pieces"), size)


def sequences(df: DataFrame, placed: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = 4096) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the lengths of its pieces in order. doc_id must be unique."""
    full = token_pieces(df, tokenizer, doc_id, text, end_id, size, with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(full, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``size`` ids in a sequence
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p.ids", F.size).alias("lengths"))
