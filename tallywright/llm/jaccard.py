"""Set-similarity join of documents on word shingles, with Bayesian pruning of candidates.

1. Documents with the same set of shingles are one class; copies are counted, never paired.
2. MinHash values of every class are cut into bands; classes that agree in a band are candidates. With 28 bands of 4 values a pair of
   similarity 0.8 is missed with probability 4e-7, a more similar one more rarely.
3. Candidates are compared in the blocks of their connected part, 16 MinHash values at a time. With a uniform prior on the
   similarity, a pair is dropped when after m matches of n the posterior probability of reaching the threshold is below ``tolerance``.
4. What is left is verified exactly on the shingle sets.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.blocks import block_pairs, in_groups, spanning
from tallywright.llm.common import only, saved
from tallywright.llm.components import components
from tallywright.llm.transducer import batches
from tallywright.llm.words import Words, mix, shingles

BANDS, ROWS, STEP = 28, 4, 16
BLOCK_BYTES = 3_000_000  # shingle sets of a block; a longer document has one to itself
BATCH = 1_000_000  # characters of texts whose shingles are held at once


def seeds() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def minhashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 32-bit MinHash values for each set; sets must not be empty."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    for k, seed in enumerate(seeds()):
        out[:, k] = np.minimum.reduceat(sets * seed, at[:-1]) >> np.uint64(32)
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n values that leave P(similarity >= threshold) at ``tolerance`` or more, from a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _sets(texts: list[str | None], size: int):
    """For each text its sorted set of shingles."""
    w = Words(texts)
    h, at = shingles(w.hashes, w.at, size)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))])


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, two fingerprints and the size of the set, hash of every band; texts without words have no row."""
    def sketch(parts):
        for part in parts:
            texts, keys = part.column("text").to_pylist(), part.column("doc_id")
            for a, b in batches(texts, BATCH):
                h, at = _sets(texts[a:b], size)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                at = np.append(at[full], at[-1])
                values = minhashes(h, at)
                bands = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + values[:, r::ROWS])
                prints = [np.add.reduceat(x, at[:-1]).view(np.int64) for x in (mix(h), mix(h + np.uint64(99)))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(full + a)), *map(pa.array, prints), pa.array(np.diff(at)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "f1", "f2", "n", "bands"])

    return rows.mapInArrow(sketch, "doc_id long, f1 long, f2 long, n long, bands array<long>")


def near_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """One row per doc_id: class_id (least doc_id with the same shingles), n_links (other documents at ``threshold`` or more),
    group_id (least doc_id reachable by links), kept (doc_id = group_id).

    A text of fewer than ``size`` words is one shingle; null texts and texts without words link with nothing. Rows without doc_id are left
    out. Rows that share a doc_id are one document, whose text is the greatest of theirs. An empty table gives no rows.
    """
    rows = only(df, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL")
    # Texts are shuffled for it only where an id repeats.
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = saved(rows.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    sketches = saved(_sketches(rows, size), "sketches")
    own = sketches.select("doc_id", "f1", "f2", "n", "bands")
    # One class per set.
    classes = saved(own.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")

    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    least = keys.groupBy("band", "key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").drop("most")
    edges = keys.join(least, ["band", "key"]).filter("id <> least").select("id", "least").distinct()
    near = components(edges, "id", "least")

    members = near.join(classes.select("id", "copies"), "id").join(rows.withColumnRenamed("doc_id", "id"), "id")

    def fill(parts):
        for part in parts:
            texts = part.column("text").to_pylist()
            for a, b in batches(texts, BATCH):
                h, at = _sets(texts[a:b], size)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    values = minhashes(h, np.append(at[full], at[-1]))
                    picked = pa.array(full + a)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(picked) for c in ("id", "component", "copies")), pa.array([h[at[k]:at[k + 1]].tobytes() for k in full], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], ["id", "component", "copies", "shingles", "values"])

    filled = members.mapInArrow(fill, "id long, component long, copies long, shingles binary, values binary")
    filled = saved(filled, "sets").withColumn("bytes", F.octet_length("shingles"))
    pairs = block_pairs(filled, "component", "id", "bytes", BLOCK_BYTES).drop("bytes")
    limits = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]

    def compare(held: dict[str, list]) -> list[tuple]:
        ids, copies, second = np.array(held["id"], np.int64), np.array(held["copies"], np.int64), np.array(held["second"], bool)
        values = np.frombuffer(b"".join(held["values"]), np.uint32).reshape(len(ids), -1)
        same = held["p"][0] == held["q"][0]
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        x, y = candidates(values, a, b, same)
        x, y = prune(values, x, y, limits)
        if not len(x):
            return []
        sets = [np.frombuffer(s, np.uint64) for s in held["shingles"]]
        n = np.array([len(s) for s in sets])
        both = shared_counts(sets, x, y)
        ok = both >= threshold * (n[x] + n[y] - both) - 1e-9
        x, y = x[ok], y[ok]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        root = dict(spanning(ids, x, y))
        return [(int(ids[k]), int(links[k]), root.get(int(ids[k]), int(ids[k]))) for k in np.flatnonzero(links)]

    found = saved(in_groups(pairs, ["component", "p", "q"], compare, "id long, links long, root long", ["id", "links", "root"], [pa.int64()] * 3), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.join(links, "id", "left").join(components(found, "id", "root"), "id", "left").select(
        "f1", "f2", "n", F.col("id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("group_id"))
    linked = own.select("doc_id", "f1", "f2", "n").join(facts, ["f1", "f2", "n"]).select("doc_id", "class_id", "n_links", "group_id")
    alone = rows.select("doc_id").distinct().join(own.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id") == F.col("group_id"))


def candidates(values: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (one of ``a``, one of ``b``) that agree in a band; each pair once."""
    hit = np.zeros((len(a), len(b)), bool)
    for k in range(0, BANDS * ROWS, ROWS):
        bands = mix(mix(values[:, k].astype(np.uint64) << np.uint64(32) | values[:, k + 1]) + (values[:, k + 2].astype(np.uint64) << np.uint64(32) | values[:, k + 3]))
        hit |= bands[a][:, None] == bands[b][None]
    if same:
        hit = np.triu(hit, 1)
    x, y = np.nonzero(hit)
    return a[x], b[y]


def prune(values: np.ndarray, x: np.ndarray, y: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step of the comparison gives up."""
    matches = np.zeros(len(x), np.int16)
    for n, least in limits:
        matches += (values[x, n - STEP:n] == values[y, n - STEP:n]).sum(axis=1, dtype=np.int16)
        keep = matches >= least
        x, y, matches = x[keep], y[keep], matches[keep]
    return x, y


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets x and y, pair by pair."""
    places = np.unique(np.concatenate([x, y]))
    if len(x) < 20 * len(places) ** 0.5 or len(x) < 200:
        return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(x, y)], np.int64)
    row = np.full(len(sets), -1)
    row[places] = np.arange(len(places))
    owner = np.repeat(np.arange(len(places)), [len(sets[k]) for k in places])
    _, column, often = np.unique(np.concatenate([sets[k] for k in places]), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
    total = np.zeros(len(x), np.int64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4097, 4096))
    for s, e in zip(edges, edges[1:]):  # a slice of the vocabulary at a time
        if e > s:
            has = np.zeros((len(places), 4096), np.float32)
            has[owner[s:e], column[s:e] % 4096] = 1
            total += np.rint((has @ has.T)[row[x], row[y]]).astype(np.int64)
    return total
