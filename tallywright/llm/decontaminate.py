"""Benchmark decontamination: BM25 over test items, every training passage a query.

Items are indexed, passages of all documents are the queries, and all items whose score reaches ``threshold`` of the score they give
their own text are retrieved, whatever their number. Bounds are those of block-max WAND, but there is no pivot and no cursor: they are
worked out for all blocks of items, for so many passages at once as fill a grid of bounded size:

* frequent terms whose highest impacts together stay below a share of the threshold cannot lift an item over it alone, so only the
  other terms open candidates;
* items stand in blocks; for every term and block the highest impact is kept, and a block is scored only where the sum of its bounds
  (with the bound of its frequent terms) reaches the threshold; other parts of the posting lists are not read.

What is retrieved is verified on the words: question and answer of the item must both overlap with the passage.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import only
from tallywright.llm.transducer import batches
from tallywright.llm.words import Words, shingles

K1, B = 1.2, 0.75
ITEM_BYTES = 32_000_000  # texts of the items of one index; more items make more indexes, each queried by all passages
CELLS = 2_000_000  # bounds or postings that are held at once


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line, or else the last sentence, is the answer. A single sentence is both."""
    cut = text.rstrip().rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text.strip())]
        cut = ends[-1] if ends else -1
    head, tail = (text[:cut], text[cut:]) if cut > 0 else (text, text)
    return (head, tail) if re.search(r"\w", head) and re.search(r"\w", tail) else (text, text)


def _runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs and the places in them, for runs of ``count`` places from ``start``."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) + (start - np.cumsum(count) + count)[run]


class Statistics:
    """Number of items, their words, and the items of each term, added up over parts of the items."""

    def __init__(self):
        self.n, self.words, self.terms, self.df = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        for a, b in batches(texts):
            w = Words(texts[a:b])
            owner = np.repeat(np.arange(b - a), np.diff(w.at))
            order = np.lexsort((owner, w.hashes))
            h, o = w.hashes[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            terms, df = np.unique(h[first], return_counts=True)
            every, place = np.unique(np.concatenate([self.terms, terms]), return_inverse=True)
            self.df = np.bincount(place, weights=np.concatenate([self.df, df]), minlength=len(every)).astype(np.int64)
            self.terms, self.n, self.words = every, self.n + b - a, self.words + len(h)


class Index:
    """Impact lists of items. Without ``whole``, statistics of more items than these, they are those of the items of this index."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, block: int = 8, whole: Statistics | None = None):
        self.ids = np.array(ids, np.int64)
        w = Words(texts)
        n = len(texts)
        lengths = np.diff(w.at)
        self.longest = int(lengths.max(initial=0))
        self.threshold = threshold
        item = np.repeat(np.arange(n), lengths)
        self.terms, term = np.unique(w.hashes, return_inverse=True)
        pair, tf = np.unique(term * n + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        n_all, mean, df_all = (n, lengths.mean() if n else 1, df) if whole is None else (whole.n, whole.words / max(whole.n, 1), whole.df[np.searchsorted(whole.terms, self.terms)])
        idf = np.log1p((n_all - df_all + 0.5) / (df_all + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(mean, 1e-9)))
        impact /= np.bincount(item, weights=impact, minlength=n)[item]
        self.item, self.impact = item, impact
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.block, self.n_blocks = block, -(-n // block)
        cell = term * max(self.n_blocks, 1) + item // block
        cells, place = np.unique(cell, return_inverse=True)
        best = np.zeros(len(cells))
        np.maximum.at(best, place, impact)
        self.block_at = np.searchsorted(cells // max(self.n_blocks, 1), np.arange(len(self.terms) + 1))
        self.cells, self.cell_at = cells, np.searchsorted(cell, np.append(cells, cells[-1:] + 1))  # postings stand in the order of their cells
        self.block_of, self.block_max = cells % max(self.n_blocks, 1), best
        # Frequent terms first, while all of them together stay below 60 percent of the threshold for every item.
        order = np.argsort(-df, kind="stable")
        sums = np.zeros(n)
        self.rare = np.ones(len(self.terms), bool)
        for t in order:
            own = slice(self.at[t], self.at[t + 1])
            sums[item[own]] += impact[own]
            if sums.max() > 0.6 * threshold:
                sums[item[own]] -= impact[own]
                break
            self.rare[t] = False
        self.frequent = np.zeros(max(self.n_blocks, 1))
        np.maximum.at(self.frequent, np.arange(n) // block, sums)
        self.parts = [[self._part(x) for x in split_item(t)] for t in texts]

    @staticmethod
    def _part(text: str) -> tuple[np.ndarray, int]:
        """Distinct runs of five words, or the one run of a shorter part, and the length of a run."""
        w = Words([text])
        h, _ = shingles(w.hashes, w.at)
        return np.unique(h), min(5, len(w.hashes))

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int) -> Iterator[tuple[int, int, float]]:
        """Passage, item and score for distinct (passage, term) rows in the order of the passage."""
        edges = np.searchsorted(passage, np.arange(n + 1))
        step = max(1, CELLS // max(self.n_blocks, 1))
        for a in range(0, n, step):
            b = min(n, a + step)
            rows = slice(edges[a], edges[b])
            bound = self._bounds(passage[rows] - a, term[rows], b - a)
            open_ = (bound > 0) & (bound + self.frequent >= self.threshold - 1e-9)
            for k in np.flatnonzero(open_.any(axis=1)):
                own, blocks = term[edges[a + k]:edges[a + k + 1]], np.flatnonzero(open_[k])
                few = max(1, CELLS // (self.block * len(own)))
                for c in range(0, len(blocks), few):
                    for i, score in self._scores(own, blocks[c:c + few]):
                        yield int(a + k), i, score

    def _bounds(self, p: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """Highest scores by rare terms, passages by blocks; the cells of the terms are summed CELLS at once, or those of one term."""
        rare = self.rare[t]
        p, t = p[rare], t[rare]
        count = self.block_at[t + 1] - self.block_at[t]
        ends, bound, lo = np.cumsum(count), np.zeros(n * self.n_blocks), 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
            at, cell = _runs(self.block_at[t[lo:hi]], count[lo:hi])
            np.add.at(bound, p[lo:hi][at] * self.n_blocks + self.block_of[cell], self.block_max[cell])
            lo = hi
        return bound.reshape(n, self.n_blocks)

    def _scores(self, terms: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, float]]:
        """Items of these blocks that reach the threshold. Of each posting list only the blocks' parts are read."""
        wanted = (terms[:, None] * self.n_blocks + blocks).ravel()
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        cell, place = at[self.cells[at] == wanted], np.flatnonzero(self.cells[at] == wanted) % len(blocks)
        run, posting = _runs(self.cell_at[cell], self.cell_at[cell + 1] - self.cell_at[cell])
        score = np.bincount(place[run] * self.block + self.item[posting] % self.block, weights=self.impact[posting], minlength=len(blocks) * self.block)
        for k in np.flatnonzero(score >= self.threshold - 1e-9):
            yield int(blocks[k // self.block] * self.block + k % self.block), float(score[k])

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's runs of words that stand in the passage."""
        out = []
        for runs, size in self.parts[item]:
            own, _ = shingles(words, np.array([0, len(words)]), size) if size else (np.zeros(0, np.uint64), None)
            out.append(float(np.isin(runs, own).mean()) if len(runs) and len(words) >= size else 0.0)
        return out[0], out[1]


def passages(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
    """Verified candidates: text, item, score, overlaps. Passages are twice as long as the longest item and overlap by half, so
    every place of a text where an item can stand lies whole in one of them."""
    w = Words(texts)
    if not len(w.hashes) or not len(index.terms):
        return
    step = max(64, index.longest)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.at))
    place = (np.arange(len(w.hashes)) - w.at[owner]) // step
    first = np.concatenate([[0], np.cumsum(np.maximum(-(-np.diff(w.at) // step) - 1, 1))])  # first passage of each text
    last = first[owner + 1] - 1
    here = np.minimum(first[owner] + place, last)
    term = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = index.terms[term] == w.hashes
    before = known & (place > 0)
    n = int(first[-1])
    key = np.unique(np.concatenate([here[known], np.maximum(first[owner] + place - 1, 0)[before]]) * len(index.terms) + np.concatenate([term[known], term[before]]))
    for a in range(0, n, 20_000):
        lo, hi = np.searchsorted(key, [a * len(index.terms), min(n, a + 20_000) * len(index.terms)])
        for k, item, score in index.retrieve(key[lo:hi] // len(index.terms) - a, key[lo:hi] % len(index.terms), min(n, a + 20_000) - a):
            text = int(np.searchsorted(first, k + a, side="right")) - 1
            s = int(w.at[text]) + (k + a - int(first[text])) * step
            q, r = index.overlaps(item, w.hashes[s:min(s + 2 * step, int(w.at[text + 1]))])
            yield text, item, score, q, r


def leaks(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Pairs of a document and a test item that it holds: doc_id, item_id, score (share of the item's own BM25 score, best passage),
    question_overlap, answer_overlap (of that passage).

    A pair is returned if in one passage the score reaches ``threshold`` and both overlaps reach ``overlap``. Null and empty texts and
    items hold nothing; rows without an id keep a null id; repeated rows give one pair; an empty table on either side gives no rows.
    """
    kind = {"d": df.schema[doc_id].dataType.simpleString(), "i": items.schema[item_id].dataType.simpleString()}
    rows = only(df, doc_id=doc_id, text=text)
    own = only(items, item_id=item_id, text=item_text).filter(F.col("text").rlike(r"[\p{L}\p{N}\p{M}]"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-int(size) // ITEM_BYTES)
    out, whole = None, None

    def items_of(shard: int) -> pa.Table:
        return own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).toArrow()

    if shards > 1:
        # Statistics of all items come first, so that an item scores the same in any index; they take 16 bytes a term.
        whole = Statistics()
        for shard in range(shards):
            whole.add(items_of(shard)["text"].to_pylist())
    for shard in range(shards):
        part = items_of(shard)
        # The index of at most about ITEM_BYTES of texts goes to every task; other items come in other rounds.
        index = df.sparkSession.sparkContext.broadcast(Index(list(range(part.num_rows)), part["text"].to_pylist(), threshold, whole=whole))
        names = part["item_id"].combine_chunks()

        def search(parts: Iterator[pa.RecordBatch], index=index, names=names) -> Iterator[pa.RecordBatch]:
            for p in parts:
                texts, found = p.column("text").to_pylist(), []
                for a, b in batches(texts):
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for t, i, score, q, r in passages(index.value, texts[a:b]):
                        if q >= overlap and r >= overlap:
                            best[t, i] = max(best.get((t, i), (0.0, 0.0, 0.0)), (score, q, r))
                    found += [(t + a, i, *x) for (t, i), x in best.items()]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([p.column("doc_id").take(pa.array(cols[0])), names.take(pa.array(cols[1])), *(pa.array(c, pa.float64()) for c in cols[2:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(search, f"doc_id {kind['d']}, item_id {kind['i']}, score double, question_overlap double, answer_overlap double")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return df.sparkSession.createDataFrame([], f"doc_id {kind['d']}, item_id {kind['i']}, score double, question_overlap double, answer_overlap double")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap")
