"""Near-duplicate lines by a segment-partition edit join.

A line that is to be found within ``edits`` edits is cut into ``edits + 1`` segments of nearly equal length; one of them survives in every
line that near. Lines are indexed by (length, segment number, segment) and probed with the substrings that may be such a segment of a
line up to ``edits`` shorter; the places of these substrings depend on both lengths and are those that leave enough edits for both
sides. Lines that meet in a key are candidates, compared in blocks and verified by a banded bit-parallel edit distance.

Equal lines are one line with a weight from the start, so a frequent line costs no more than a rare one after its first shuffle, which
combines it in the map tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.blocks import block_pairs, in_groups, spanning
from tallywright.llm.common import HashFilter, only, saved
from tallywright.llm.components import components
from tallywright.llm.transducer import batches
from tallywright.llm.words import mix, prefix_hashes, slices_hash

BLOCK_BYTES, LINE_COST = 1_000_000, 4_000  # a block holds lines of so many bytes, and about 250 at most
CELLS = 2_000_000
SPACES = np.array([k for k in range(0x3001) if chr(k).isspace()], np.uint32)
BATCH = 500_000  # characters of texts that are cut into lines at once


class Lines:
    """Lines of a batch of texts: ``owner``, ``number`` in the text, ``start`` and ``end`` in ``joined``, ``hash``; all of them, short ones too."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        self.end = np.flatnonzero(self.points == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.owner = np.searchsorted(ends, self.end)
        self.number = np.arange(len(self.end)) - np.searchsorted(self.owner, np.arange(len(texts)))[self.owner]
        self.sums, self.down = prefix_hashes(self.points)
        self.hash = slices_hash(self.sums, self.down, self.start, self.end)

    def filled(self) -> np.ndarray:
        """Whether a line holds anything but white space."""
        seen = np.concatenate([[0], np.cumsum(~np.isin(self.points, SPACES))])
        return seen[self.end] > seen[self.start]


def keys_of(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(lines, keys, whether indexed). Each key set of a line holds its own segments (indexed) and the substrings it probes with."""
    size = end - start
    for less in range(edits + 1):
        other = size - less  # length of the indexed line
        for segment in range(edits + 1):
            base, extra = other // (edits + 1), other % (edits + 1)
            # The last ``extra`` segments are one longer.
            short = edits + 1 - extra
            at = segment * base + np.maximum(segment - short, 0)
            width = base + (segment >= short)
            # With s segments before it, s edits at most have happened left of the first one that survives, and edits - s right of it.
            low = max(-segment, less - (edits - segment))
            high = min(segment, less + (edits - segment))
            for shift in range(low, high + 1):
                place = at + shift
                ok = np.flatnonzero((base > 0) & (place >= 0) & (place + width <= size))
                s = start[ok] + place[ok]
                key = slices_hash(sums, down, s, s + width[ok])
                key = mix(key + mix(other[ok].astype(np.uint64) * np.uint64(64) + np.uint64(segment)))
                yield ok, key, less == 0 and shift == 0


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``: vertical differences of a diagonal band in the bits of one word.

    Bit k of column j stands for row j - edits + k. Rows above the first are flat, rows that enter the band from below and differences
    that enter it from above are taken as one more, which never makes a distance smaller than it is.
    """
    assert 2 * edits + 1 <= 64
    out = np.zeros(len(a), bool)
    swap = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]
    order = np.array(sorted(range(len(a)), key=lambda k: len(swap[k][0])), np.int64)
    order = order[[len(swap[k][0]) - len(swap[k][1]) <= edits for k in order]] if len(order) else order
    # Pairs go together by length, so many at once as fill a grid of CELLS characters.
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + 4096)
        while hi > lo + 1 and (hi - lo) * len(swap[order[hi - 1]][0]) > CELLS:
            hi = lo + (hi - lo) // 2
        chosen = order[lo:hi]
        out[chosen] = _band([swap[k] for k in chosen], edits)
        lo = hi
    return out


def _grid(texts: list[str], before: int, after: int, fill: int) -> np.ndarray:
    width = max(map(len, texts), default=0)
    out = np.full((len(texts), before + width + after), fill, np.uint32)
    for k, t in enumerate(texts):
        out[k, before:before + len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def _band(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    long, short = [p[0] for p in pairs], [p[1] for p in pairs]
    band = 2 * edits + 1
    rows, columns = _grid(long, edits, edits + 1, 0xFFFFFFFF), _grid(short, 0, 0, 0xFFFFFFFE)
    n = np.array([len(x) for x in short])
    gap = np.array([len(x) for x in long]) - n
    weights = np.uint64(1) << np.arange(band, dtype=np.uint64)
    mask, one, top = np.uint64((1 << band) - 1), np.uint64(1), np.uint64(1 << (band - 1))
    plus = np.full(len(pairs), ((1 << edits) - 1) << (edits + 1), np.uint64)  # rows 1 to edits before the first column
    minus = np.zeros(len(pairs), np.uint64)
    score, ended = gap.copy(), np.full(len(pairs), edits + 1)
    ended[n == 0] = gap[n == 0]
    live = np.flatnonzero(n > 0)
    plus, minus, score = plus[live], minus[live], score[live]
    for j in range(int(n.max(initial=0))):
        plus, minus = (plus >> one) | top, minus >> one
        equal = (rows[live, j:j + band] == columns[live, j][:, None]) @ weights
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        up = (minus | ~(diagonal | plus)) & mask
        down = diagonal & plus
        score = score + 1 - ((diagonal >> (edits + gap[live]).astype(np.uint64)) & one).astype(np.int64)
        up = (up << one | one) & mask
        plus, minus = ((down << one) | ~(diagonal | up)) & mask, up & diagonal
        over = n[live] == j + 1
        ended[live[over]] = score[over]
        stay = ~over & (score <= edits)
        if not stay.all():
            live, plus, minus, score = live[stay], plus[stay], minus[stay], score[stay]
            if not len(live):
                break
    return ended <= edits


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 2, least: int = 40, exact: int | None = None) -> DataFrame:
    """The lines that go: doc_id, number (from 0) in the document, group (a line's hash).

    Lines of at least ``least`` characters that are within ``edits`` edits of each other are linked; of each connected group the first
    occurrence (least doc_id, then number) stays and all others go. Of shorter lines those of at least ``exact`` characters that are not
    all white space are linked if they are equal; without ``exact`` they all stay. Rows without doc_id are not looked at, and rows
    that share a doc_id are read as one document each: a line that goes, goes in all of them.
    """
    rows = only(df, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL")

    def occurrences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, keys = part.column("text").to_pylist(), part.column("doc_id")
            for a, b in batches(texts, BATCH):
                x = Lines(texts[a:b])
                long = x.end - x.start >= least
                if exact is not None:
                    long |= (x.end - x.start >= exact) & x.filled()
                long = np.flatnonzero(long)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(x.owner[long] + a)), pa.array(x.number[long].astype(np.int32)), pa.array(x.hash[long].view(np.int64))], ["doc_id", "number", "line"])

    def keys(known: HashFilter | None = None):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = part.column("text").to_pylist()
                for a, b in batches(texts, BATCH):
                    x = Lines(texts[a:b])
                    own = long_lines(x)
                    for at, key, indexed in keys_of(x.sums, x.down, x.start[own], x.end[own], edits):
                        if known is not None:
                            some = known.holds(key)
                            at, key = at[some], key[some]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x.hash[own][at].view(np.int64)), pa.array(np.full(len(at), indexed))], ["key", "line", "indexed"])
        return run

    def long_lines(x: Lines) -> np.ndarray:
        """One place of each line that is long enough."""
        _, own = np.unique(x.hash, return_index=True)
        return own[x.end[own] - x.start[own] >= least]

    def contents(known: HashFilter):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = part.column("text").to_pylist()
                for a, b in batches(texts, BATCH):
                    x = Lines(texts[a:b])
                    own = long_lines(x)
                    own = own[known.holds(x.hash[own])]
                    yield pa.RecordBatch.from_arrays([pa.array(x.hash[own].view(np.int64)), pa.array([x.joined[s:e] for s, e in zip(x.start[own], x.end[own])], pa.string())], ["line", "content"])
        return run

    kind = rows.schema["doc_id"].dataType.simpleString()
    places = rows.mapInArrow(occurrences, f"doc_id {kind}, number int, line long")
    met = "key long, line long, indexed boolean"
    # A key leads to the least line indexed under it; all other lines that meet there hang on that one.
    heads = rows.mapInArrow(keys(), met).groupBy("key").agg(F.min(F.when(F.col("indexed"), F.col("line"))).alias("head"), F.min("line").alias("low"), F.max("line").alias("high")).filter("head IS NOT NULL AND low <> high")
    heads = saved(heads.select("key", "head"), "heads")
    edges = rows.mapInArrow(keys(HashFilter(heads, "key")), met).select("key", "line").join(heads, "key").filter("line <> head").select("line", "head").distinct()
    near = components(edges, "line", "head")
    texts = rows.mapInArrow(contents(HashFilter(near, "id")), "line long, content string").join(near, F.col("line") == F.col("id")).groupBy("id", "component").agg(F.min("content").alias("content"))
    texts = saved(texts, "lines").withColumn("bytes", F.octet_length("content") + LINE_COST)
    pairs = block_pairs(texts, "component", "id", "bytes", BLOCK_BYTES).drop("bytes")

    def compare(held: dict[str, list]) -> list[tuple]:
        ids, second, lines = np.array(held["id"], np.int64), np.array(held["second"], bool), held["content"]
        x, y = met_in_block(lines, edits, np.array(held["_group"], np.uint64))
        apart = (np.array(held["p"]) == np.array(held["q"]))[x] | (second[x] != second[y])
        x, y = x[apart], y[apart]
        ok = within([lines[k] for k in x], [lines[k] for k in y], edits)
        return spanning(ids, x[ok], y[ok])

    links = saved(in_groups(pairs, ["component", "p", "q"], compare, "line long, root long", ["line", "root"], [pa.int64()] * 2, together=2000), "links")
    groups = components(links, "line", "root").select(F.col("id").alias("line"), F.col("component").alias("group"))
    firsts = places.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n"))
    grouped = saved(firsts.join(groups, "line", "left").filter("n > 1 OR group IS NOT NULL").select("line", "first", F.coalesce("group", "line").alias("group")), "firsts")
    stays = grouped.groupBy("group").agg(F.min("first").alias("stays"))
    decided = grouped.join(stays, "group").select("line", "group", "stays")
    return places.join(decided, "line").filter((F.col("stays.doc_id") != F.col("doc_id")) | (F.col("stays.number") != F.col("number"))).select("doc_id", "number", "group").distinct()


def met_in_block(lines: list[str], edits: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, of one group if groups are given, whose lines share a key, one of them as an indexed line."""
    x = Lines(["\n".join(lines)])
    key, line, indexed = [], [], []
    for at, k, i in keys_of(x.sums, x.down, x.start, x.end, edits):
        key.append(k if group is None else mix(k + mix(group[at])))
        line.append(at)
        indexed.append(np.full(len(at), i))
    key, line, indexed = np.concatenate(key), np.concatenate(line), np.concatenate(indexed)
    order = np.lexsort((~indexed, key))
    key, line, indexed = key[order], line[order], indexed[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    first = np.concatenate([[0], np.cumsum(indexed)])
    some = np.flatnonzero((np.diff(edge) > 1) & (np.diff(first[edge]) > 0))
    found = []
    for s, e in zip(edge[some], edge[some + 1]):
        n = int(first[e] - first[s])
        if n:
            a, b = np.repeat(line[s:s + n], e - s), np.tile(line[s:e], n)
            low, high = np.minimum(a, b), np.maximum(a, b)
            found.append(np.unique(low * len(lines) + high))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(found))
    pair = pair[pair // len(lines) != pair % len(lines)]
    return pair // len(lines), pair % len(lines)


def line_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per doc_id: n_lines (of its longest row), n_dropped, dropped (their numbers in order). Null texts have no lines."""
    rows = only(df, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    gone = repeated_lines(df, doc_id, text, **options).groupBy("doc_id").agg(F.sort_array(F.collect_list("number")).alias("dropped"))
    n = rows.groupBy("doc_id").agg(F.max(count).alias("n_lines"))
    return n.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents with their columns, repeated lines taken out of the text. A document of which nothing but white space is left
    goes; one that loses no line stays as it is, null and empty texts and null ids included."""
    gone = repeated_lines(df, doc_id, text, **options).groupBy(F.col("doc_id").alias("_dedup_id")).agg(F.collect_list("number").alias("_dedup_gone"))
    joined = df.join(gone, F.col(f"`{doc_id}`") == F.col("_dedup_id"), "left").drop("_dedup_id")
    at = df.columns.index(text)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, numbers = part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            for k, out in enumerate(numbers):
                if out is not None and texts[k] is not None:
                    out = set(out)
                    texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in out)
            stay = pa.array([n is None or bool((t or "").strip()) for n, t in zip(numbers, texts)], pa.bool_())
            arrays = list(part.columns[:-1])
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(part.schema)[:-1])).filter(stay)

    return joined.mapInArrow(cut, df.schema)
