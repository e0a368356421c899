"""Collocations from a weighted de Bruijn graph of word n-grams.

An edge is a run of ``size`` words inside a piece of text, weighted by its occurrences; it leads from its first ``size - 1`` words to its
last. Only these longest runs are counted. Where a piece ends, the last words stand as a shorter run; these are the corrections that make
the flow of a node, edges out plus ends, the number of its occurrences, and the flows over all nodes with the same first words the number
of occurrences of those words. So every shorter count is a sum of longer ones.

Through a node whose whole flow comes in by one edge and leaves by one edge, nothing branches, begins or ends. Such unary paths are
compacted to one row of words with one weight, by list ranking: every edge learns the first edge of its path and its distance from
it, both doubling their reach each round.

Runs are counted batch by batch on interned words before they are shuffled, once, one row for each first word of a batch with all that
follows it. What follows a very frequent word is spread by a hash; ``heavy_words`` bounds what stands together.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.ordered import top_per_key
from tallywright.llm.common import only, saved
from tallywright.llm.interning import Interned, padded
from tallywright.llm.resampling import LOWER, slices

END = np.zeros(256, bool)
END[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = END.copy()
GAP[list(b" \t")] = True
HEAVY = 1000  # words with more than a thousandth of all occurrences are spread
SALTS = 64
BATCH_BYTES = 2_000_000  # of texts that are counted at once


class Pieces:
    """Interned words of some texts, with the piece and the text of every word."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        data = LOWER[padded(b"\n".join(parts) + b"\n")]
        data[-8:] = ord("\n")
        edge = np.diff(np.concatenate([[True], GAP[data]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        borders = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.row = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(start, borders)))
        self.piece = np.cumsum(END[data])[start]
        self.table = Interned(data, start, end - start)


def heavy_words(docs: DataFrame, text: str) -> list[str]:
    """At most ``HEAVY`` words, among them every word with more than 2 / HEAVY of all occurrences.

    A batch reports the words that are at least half as frequent in it as the bound asks for. What it leaves out of a word is less than half
    the bound's share of the batch, so a word above twice the bound still reaches it with the reported part alone.
    """
    def report(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(0)
            for s in slices(column, BATCH_BYTES):
                p = Pieces(column[s].to_pylist())
                often = np.flatnonzero(p.table.count * (2 * HEAVY) >= len(p.row)) if len(p.row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in p.table.strings(often)), None], pa.string()), pa.array([*p.table.count[often].tolist(), len(p.row)], pa.int64())], ["word", "n"])

    rows = only(docs, text=text).mapInArrow(report, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # The total, under no word, is the first; less than HEAVY words have more than a HEAVY-th of it each.
    top = rows.orderBy(F.col("word").isNotNull(), F.desc("n")).limit(HEAVY + 1).collect()
    return sorted(r.word for r in top[1:] if r.n * HEAVY > top[0].n)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each is there."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.append(first, len(key)))


def runs(docs: DataFrame, lang: str, text: str, size: int, heavy: list[str]) -> DataFrame:
    """lang, w1, salt, spread, runs: for every word of a batch the runs of 1 to ``size`` words that start with it.

    ``runs`` has a line for each run: its further words and, behind a tab, its occurrences if there are several. Each batch is a graph of its own:
    the edges are counted, the flow of a shorter run is the sum of the edges that go on from it and of its ends. What starts with a word that is not heavy stands together. What starts with a heavy
    word is dealt by ``salt``, a hash of the words up to the first that is not heavy; ``spread`` of the first words are heavy.
    """
    spread = {w.encode() for w in heavy}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, column = part.columns
            for s in slices(column, BATCH_BYTES):
                p = Pieces(column[s].to_pylist())
                total = len(p.row)
                if not total:
                    continue
                coded = langs[s].fill_null("und").dictionary_encode()
                strings, wide = p.table.strings(), len(p.table.owner) + 1
                words = pa.array(strings, pa.binary()).cast(pa.string())
                ids = np.zeros((size + 1, total), np.int64)  # the language, then the words from 1; 0 behind the end of the piece
                ids[0] = coded.indices.to_numpy().astype(np.int64)[p.row]
                for j in range(min(size, total)):
                    inside = np.flatnonzero(p.piece[:total - j] == p.piece[j:])
                    ids[j + 1, inside] = p.table.slot[inside + j] + 1
                if len(coded.dictionary) * wide ** size < 1 << 63:
                    key = ids[0]
                    for row in ids[1:]:
                        key = key * wide + row
                    key, n = counted(key)
                    ids = ids[:, :len(key)]
                    for j in range(size, 0, -1):
                        key, ids[j] = np.divmod(key, wide)
                    ids[0] = key
                else:
                    ids, n = np.unique(ids, axis=1, return_counts=True)
                hot = np.array([False, *(w in spread for w in strings)])[ids[1:]]
                leading = np.logical_and.accumulate(hot, axis=0).sum(axis=0)
                salt = np.zeros(len(n), np.uint64)
                keys = np.concatenate([np.zeros(1, np.uint64), p.table.keys])
                for j in range(1, size):
                    salt = np.where(leading >= j, salt * np.uint64(31) + keys[ids[j + 1]] + np.uint64(1), salt)
                salt = np.where(leading > 0, 1 + (salt ^ (salt >> np.uint64(32))) % np.uint64(SALTS), 0).astype(np.int64)
                group = ((ids[0] * wide + ids[1]) * (SALTS + 1) + salt) * (size + 1) + leading
                order = np.argsort(group, kind="stable")
                ids, n, group, salt, leading = ids[:, order], n[order], group[order], salt[order], leading[order]
                new = np.concatenate([[True], group[1:] != group[:-1]])
                first = np.flatnonzero(new)
                lines, of = [], []
                for k in range(1, size + 1):
                    # Rows with the same first k words stand together: their sum is the flow.
                    if k > 1:
                        new = new | np.concatenate([[True], ids[k, 1:] != ids[k, :-1]])
                    at = np.flatnonzero(new)
                    flow = np.add.reduceat(n, at)
                    whole = ids[k, at] > 0
                    at, flow = at[whole], flow[whole]
                    line = pc.binary_join_element_wise(*[words.take(pa.array(ids[j, at] - 1)) for j in range(2, k + 1)], " ") if k > 1 else pa.array([""] * len(at), pa.string())
                    lines.append(pc.if_else(pa.array(flow > 1), pc.binary_join_element_wise(line, pa.array(flow).cast(pa.string()), "\t"), line))
                    of.append(np.searchsorted(first, at, side="right") - 1)
                of = np.concatenate(of)
                by = np.argsort(of, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[by], np.arange(len(first) + 1)).astype(np.int32)), pa.concat_arrays(lines).take(pa.array(by)))
                out = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(ids[0, first])), words.take(pa.array(ids[1, first] - 1)), pa.array(salt[first].astype(np.int8)), pa.array(leading[first].astype(np.int8)), pc.binary_join(lists, "\n")], ["lang", "w1", "salt", "spread", "runs"])
                del p, strings, words, ids, n, hot, leading, salt, keys, group, order, new, lines, of, by, lists, line, at, flow, whole
                pa.default_memory_pool().release_unused()
                yield out

    return only(docs, lang=F.col(f"`{lang}`").cast("string"), text=text).mapInArrow(count, "lang string, w1 string, salt byte, spread byte, runs string")


def flows(docs: DataFrame, lang: str, text: str, size: int, least: int) -> DataFrame:
    """lang, k, phrase, n: every run of k words, 1 to ``size``, with its occurrences; runs of two words and more only from ``least``.

    Runs shorter than ``size`` that have heavy words only may come in several parts, to be added up.
    """
    dealt = runs(docs, lang, text, size, heavy_words(docs, text)).repartition("lang", "w1", "salt")
    line = F.col("line")
    lines = dealt.select("lang", "w1", "salt", "spread", F.explode(F.split("runs", "\n")).alias("line"))
    several = F.contains(line, F.lit("\t"))
    lines = lines.select("lang", "w1", "salt", "spread", F.substring_index(line, "\t", 1).alias("rest"), F.when(several, F.substring_index(line, "\t", -1).cast("long")).otherwise(F.lit(1)).alias("n"))
    k = F.when(F.col("rest") == "", 1).otherwise(F.size(F.split("rest", " ")) + 1)
    sums = lines.groupBy("lang", "w1", "salt", "spread", "rest").agg(F.sum("n").alias("n"))
    sums = sums.filter((F.col("n") >= least) | (F.col("rest") == "") | ((F.col("spread") > 0) & (k <= F.col("spread")) & (k < size)))
    return sums.select("lang", k.alias("k"), F.when(F.col("rest") == "", F.col("w1")).otherwise(F.concat_ws(" ", "w1", "rest")).alias("phrase"), "n")


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, words, n: the edges (lang, phrase, n) with unary paths compacted; ``nodes`` are lang, phrase, n.

    An edge without such a neighbour is a path by itself. A path is no longer than the piece of text that it comes from.
    """
    word = F.split("phrase", " ")
    rows = saved(edges.select(F.monotonically_increasing_id().alias("id"), "lang", word.alias("words"), "n"), "edges")
    head, tail = F.array_join(F.slice("words", 1, F.size("words") - 1), " "), F.array_join(F.slice("words", 2, F.size("words") - 1), " ")
    # All of the node's flow comes by one edge and leaves by one: both weigh as much as the node.
    unary = (rows.select(F.col("id").alias("before"), "lang", tail.alias("phrase"), "n").join(nodes, ["lang", "phrase", "n"])
             .join(rows.select(F.col("id"), "lang", head.alias("phrase"), "n"), ["lang", "phrase", "n"]).select("id", "before"))
    # to: an edge before this one, distance back; done: nothing is before it.
    state = saved(rows.join(unary, "id", "left").select("id", F.coalesce("before", "id").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("distance"), F.col("before").isNull().alias("done")), "ranks")
    while not state.filter("NOT done").isEmpty():
        far = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("distance").alias("d2"), F.col("done").alias("done2"))
        moving = state.filter("NOT done").join(far, "to").select("id", F.col("to2").alias("to"), (F.col("distance") + F.col("d2")).alias("distance"), F.col("done2").alias("done"))
        state = saved(state.filter("done").union(moving), "ranks")
    order = F.array_sort(F.collect_list(F.struct("distance", "words")))
    whole = rows.join(state, "id").groupBy("lang", "to", "n").agg(order.alias("es"))
    first = F.col("es")[0]["words"]
    return whole.select("lang", F.concat(first, F.transform(F.slice("es", 2, F.size("es")), lambda e: F.element_at(e["words"], -1))).alias("words"), "n")


def parts_of(paths: DataFrame, length: int, start: int, stop: Column) -> DataFrame:
    """lang, phrase, n: the runs of ``length`` words of every path from place ``start`` up to ``stop``, places from 1."""
    places = F.when(stop >= start, F.sequence(F.lit(start), stop)).otherwise(F.array().cast("array<int>"))
    return paths.select("lang", "n", "words", F.explode(places).alias("i")).select("lang", F.array_join(F.slice("words", F.col("i"), length), " ").alias("phrase"), "n")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = 3, least: int = 10, share: int = 50, first: int = 2000) -> DataFrame:
    """The ``first`` best phrases of 2 to ``size`` words of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs. a, l and r are the occurrences of
    the phrase, of the first part and of the rest at its lowest-scoring cut, n all words of the language; score = floor(10^6 a a / (l r)). A phrase with fewer than ``least``
    occurrences is none; one inside a longer phrase that has at least ``share`` per cent of its occurrences is left out. Ties: more occurrences, then the phrase by its
    bytes. A null language is ``und``; null and empty texts have no words; rows are documents, ids and other columns are not looked at. Counts are exact.
    """
    if size < 2 or not 0 < share <= 100:
        raise ValueError("size is at least 2, share from 1 to 100")
    counts = saved(flows(docs, lang, text, size, least), "flows")
    edges = counts.filter(F.col("k") == size).drop("k")
    shorter = saved(counts.filter(F.col("k") < size).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "shorter")
    nodes = shorter.filter(F.col("k") == size - 1).drop("k")
    compact = saved(paths(edges, nodes), "paths")
    last = F.size("words") - size + 1  # places of edges; nodes have one more
    longest = parts_of(compact, size, 1, last)
    within = parts_of(compact, size - 1, 2, last)  # nodes inside paths: as frequent as the edges beside them, hence left out below
    ends = compact.select("lang", "n", F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", last + 1, size - 1))).alias("w")).select("lang", F.array_join("w", " ").alias("phrase"), "n")
    outer = nodes.join(within, ["lang", "phrase"], "left_anti")
    shorter = shorter.filter(F.col("k") < size - 1)
    known = longest.union(within).union(outer).union(shorter.drop("k"))

    def uncovered(level: DataFrame, longer: DataFrame) -> DataFrame:
        most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        return level.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("n") * share, F.lit(True))).select("lang", "phrase", "n")

    kept = longest
    if size > 2:
        kept = kept.union(uncovered(outer, ends))
    above = outer.union(within)
    for k in range(size - 2, 1, -1):
        word = F.split("phrase", " ")
        inside = above.select("lang", "n", F.explode(F.array(F.slice(word, 1, k), F.slice(word, 2, k))).alias("w")).select("lang", F.array_join("w", " ").alias("phrase"), "n")
        above = shorter.filter(F.col("k") == k).drop("k")
        kept = kept.union(uncovered(above, inside))
    word = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), word.alias("w"), F.explode(F.sequence(F.lit(1), F.size(word) - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("front"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("front"), F.col("n").alias("l")), ["lang", "front"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(1000000 * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    total = counts.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    # The best of each share of a language first, so that at most SALTS * first rows of a language come together.
    order = [F.col("x.score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_per_key(scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), ["lang", "_share"], order, first).drop("rank", "_share")
    ranked = top_per_key(best, ["lang"], order, first).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")
