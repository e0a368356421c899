"""Token ids as packed matrices: best-fit-decreasing packing with a segment tree over capacities.

Each task packs the documents of its partition in windows of a bounded number of tokens, so no document leaves its task and memory
does not grow with the partition; a window wastes at most part of its last sequences.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallywright.llm import transducer
from tallywright.llm.common import only, shared_folder


class CapacityTree:
    """How many open bins have each capacity; finds the least capacity that holds a piece in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, number: int, by: int = 1) -> None:
        if by > 0:
            self.bins[capacity].append(number)
        k = capacity + self.leaves
        while k:
            self.open[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return a bin of the least capacity that is at least ``need``."""
        k = need + self.leaves
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        number = self.bins[capacity].pop()
        self.add(capacity, number, -1)
        return capacity, number


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers."""
    tree, bins = CapacityTree(size), []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[item])
        if found is None:
            found = size, len(bins)
            bins.append([])
        capacity, number = found
        bins[number].append(item)
        if capacity > lengths[item]:
            tree.add(capacity - lengths[item], number)
    return bins


SEQUENCE = "sequence_id long, n_tokens int, ids binary, cumulative_lengths array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<long>"


def packed_matrices(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 50256, pad_id: int = 50256, window: int = 2_000_000) -> DataFrame:
    """A row per sequence, which is a row of the id matrix of its task.

    ids: ``size`` little-endian unsigned ids of 2 bytes, 4 if the vocabulary needs them, padded with ``pad_id`` beyond n_tokens.
    cumulative_lengths: from 0, one more than there are segments. position_resets: where position ids start again at 0.
    doc_ids, pieces, starts: whose ids each segment holds and from which of that document's ids on. Each document ends in
    ``end_id``; longer ones are cut without loss into pieces of ``size``. A null text is empty and has just the end id.
    """
    rows = only(df, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def write(parts):
        vocabulary = transducer.machine(tokenizer)
        width = "<u2" if max(vocabulary.n_ids, end_id + 1, pad_id + 1) <= 1 << 16 else "<u4"
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal number, held, tokens
            bins = best_fit_decreasing([len(p[3]) for p in held], size)
            out: list[list] = [[] for _ in range(8)]
            for items in bins:
                own = [held[k] for k in items]
                full = np.full(size, pad_id, width)
                edges = np.cumsum([0, *(len(p[3]) for p in own)])
                full[:edges[-1]] = np.concatenate([p[3] for p in own])
                for col, v in zip(out, (number, int(edges[-1]), full.tobytes(), edges.tolist(), edges[:-1].tolist(), [p[0] for p in own], [p[1] for p in own], [p[2] for p in own])):
                    col.append(v)
                number += 1
            held, tokens = [], 0
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(key_type), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = ["sequence_id", "n_tokens", "ids", "cumulative_lengths", "position_resets", "doc_ids", "pieces", "starts"]
            for a in range(0, len(out[0]), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 1000], k) for c, k in zip(out, kinds)], names)

        for part in parts:
            texts, keys = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            for a, b in transducer.batches(texts):
                ids, at = transducer.encode(vocabulary, texts[a:b])
                for k in range(b - a):
                    own = np.append(ids[at[k]:at[k + 1]], end_id).astype(width)
                    for n, s in enumerate(range(0, len(own), size)):
                        held.append((keys[a + k], n, s, own[s:s + size]))
                    tokens += len(own)
                    if tokens >= window:
                        yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(write, SEQUENCE.format(kind=kind))


def write_matrices(df: DataFrame, path: str) -> DataFrame:
    """Write packed matrices as Parquet, zstd, and give them as read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments(matrices: DataFrame, size: int = 2048) -> DataFrame:
    """The segments of written matrices: doc_id, piece, start, length, ids_crc32 (of the ids as stored), sequence_id, offset."""
    kind = matrices.schema["doc_ids"].dataType.elementType.simpleString()

    def digest(parts):
        for part in parts:
            rows = part.to_pylist()
            if not rows:
                continue
            out = []
            for r in rows:
                edges, width = r["cumulative_lengths"], len(r["ids"]) // size
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((r["doc_ids"][k], r["pieces"][k], r["starts"][k], b - a, zlib.crc32(r["ids"][a * width:b * width]), r["sequence_id"], a))
            cols = list(zip(*out))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            kinds = [part.schema.field("doc_ids").type.value_type, pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return matrices.mapInArrow(digest, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def position_ids(cumulative_lengths: list[int], size: int) -> np.ndarray:
    """Position ids of one sequence: they start again at 0 in every segment and in the padding."""
    edges = np.array([*cumulative_lengths, size])
    return np.arange(size) - np.repeat(edges[:-1], np.diff(edges))


def matrices_in_shared_folder(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    return write_matrices(packed_matrices(df, tokenizer, **options), shared_folder(df.sparkSession, "matrices"))
