"""Toxicity by weak supervision.

Voters (lexicons, word beginnings, patterns) look at whole texts and fire or not. A generative label model, a mixture of two classes
with class means (the accuracies of the voters) and one covariance (their correlations), is fitted by expectation maximisation to the
counts of voting patterns; its posteriors label the training documents, and a logistic regression on words and word beginnings is
trained on these labels. The classifier alone scores documents. Lang, source, id and labels are never inputs of a score.

Fitting uses at most ``sample`` labelled documents, those with the least hash of their id; scoring reads every text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import only, saved
from tallywright.llm.transducer import batches
from tallywright.llm.words import Words, mix, prefix_hashes, slices_hash

#: Insults of everyday language.
INSULTS = {
    "en": "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool imbecile filthy ugly bastard bitch asshole jerk retard whore slut shit fuck crap hate kill vermin coward liar",
    "de": "idiot dumm blöd arschloch scheiße trottel depp abschaum versager drecksack schwachkopf widerlich hurensohn wichser",
    "fr": "idiot imbécile stupide connard salaud merde crétin abruti ordure pute débile pourriture minable",
    "es": "idiota imbécil estúpido basura mierda cabrón pendejo gilipollas puta asqueroso patético inútil escoria",
}
BEGINNINGS = (4, 5, 6)  # lengths of the word beginnings that are features beside whole words
FEATURES = 4000  # learned terms of the classifier
LEXICON = 400  # learned terms of the voters
HALVES = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Terms:
    """Distinct words and word beginnings of every text: ``owner`` and ``hash``; ``words`` are the whole words' hashes in order."""

    def __init__(self, texts: list[str | None], wanted: np.ndarray | None = None):
        w = Words(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(w.at))
        sums, down = prefix_hashes(np.frombuffer(w.joined.encode("utf-32-le"), np.uint32))
        size = w.end - w.start
        hashes, owners = [w.hashes], [owner]
        for n in BEGINNINGS:
            long = size > n
            hashes.append(mix(slices_hash(sums, down, w.start[long], w.start[long] + n) + np.uint64(n)))
            owners.append(owner[long])
        h, o = np.concatenate(hashes), np.concatenate(owners)
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            known = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
            h, o = at[known].astype(np.uint64), o[known]
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        self.hash, self.owner, self.words, self.at = h[new], o[new], w, w.at


def _hash_words(words: str) -> np.ndarray:
    return np.unique(Words([words]).hashes)


def votes(texts: list[str | None], lexicons: list[np.ndarray]) -> np.ndarray:
    """A row of 0 or 1 for each text: the lexicons, then the patterns shouting, exclamation and address with an insult."""
    t = Terms(texts)
    out = np.zeros((len(texts), len(lexicons) + 3), np.int8)
    for k, lexicon in enumerate(lexicons):
        out[t.owner[np.isin(t.hash, lexicon)], k] = 1
    insult = np.isin(t.words.hashes, np.concatenate(lexicons))
    you = np.isin(t.words.hashes, _hash_words("you your du dein tu ton eres tú"))
    near = np.zeros(len(insult), bool)
    for d in range(1, 5):
        near[d:] |= you[:-d] & insult[d:]
        near[:-d] |= you[d:] & insult[:-d]
    owner = np.repeat(np.arange(len(texts)), np.diff(t.at))
    out[owner[near], -1] = 1
    for k, text in enumerate(texts):
        upper = sum(map(str.isupper, text or ""))
        out[k, -3] = upper > 0.3 * max(len(text or ""), 1)
        out[k, -2] = (text or "").count("!") * 200 > max(len(text or ""), 200)
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior of class 1 for every voting pattern. ``start`` is a first posterior.

    Both classes share one covariance, so correlated voters count together no more than their joint evidence.
    """
    x, p = patterns.astype(float), start.astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        mass = weight.sum(axis=1) + 1e-6
        means = (weight @ x) / mass[:, None]
        spread = sum(((x - m) * w[:, None]).T @ (x - m) for m, w in zip(means, weight)) / mass.sum() + 0.01 * np.eye(x.shape[1])
        direction = np.linalg.solve(spread, means[1] - means[0])
        odds = (x - means.mean(axis=0)) @ direction + np.log(mass[1] / mass[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray, rounds: int = 500, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary sparse features and soft targets.

    Gradient steps scaled feature by feature by the gradients so far, so that rare terms learn as fast as frequent ones.
    """
    w, seen = np.zeros(width + 1), np.full(width + 1, 1e-12)
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[columns], minlength=n) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(columns, weights=err[rows], minlength=width), err.sum()) / n + ridge * w
        seen += grad * grad
        w -= 0.3 * grad / np.sqrt(seen)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Term hashes in order, their weights, bias. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    train = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most ``sample`` ids and one text of each, the greatest, so the broadcast and the sample are bounded by that parameter.
    picked = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = saved(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "training")

    def terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, toxic = part.column("text").to_pylist(), part.column("toxic").to_numpy(zero_copy_only=False)
            for a, b in batches(data):
                t = Terms(data[a:b])
                h, place = np.unique(t.hash, return_inverse=True)
                bad = np.bincount(place, weights=toxic[a:b][t.owner], minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(place, minlength=len(h))), pa.array(bad.astype(np.int64))], ["term", "n", "bad"])

    total, bad_total = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad_total or bad_total == total:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((bad_total + 0.5) / (total - bad_total + 0.5)))
    # Lower end of the share of toxic documents among those with the term, two standard errors down.
    share, n = F.col("bad") / F.col("n"), F.col("n")
    sure = (share + 2 / n - 2 * F.sqrt(share * (1 - share) / n + 1 / (n * n))) / (1 + 4 / n)
    stats = texts.mapInArrow(terms, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n >= 3")
    stats = saved(stats.withColumn("sure", sure), "terms")
    bad_terms = stats.filter("sure >= 0.499").orderBy(F.desc("sure"), "term").limit(FEATURES).toPandas()
    good_terms = stats.filter("bad < 0.3 * n").orderBy(F.desc("n"), "term").limit(FEATURES // 4).toPandas()
    learned = np.sort(bad_terms["term"].to_numpy(np.int64)[:LEXICON].view(np.uint64))
    known = [_hash_words(INSULTS["en"]), _hash_words(" ".join(INSULTS[k] for k in ("de", "fr", "es")))]
    lexicons = known + [learned[mix(learned) % np.uint64(HALVES) == k] for k in range(HALVES)]
    features = np.unique(np.concatenate([bad_terms["term"].to_numpy(np.int64), good_terms["term"].to_numpy(np.int64)]).view(np.uint64))

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = part.column("text").to_pylist()
            for a, b in batches(data):
                fired = votes(data[a:b], lexicons) @ (1 << np.arange(len(lexicons) + 3))
                t = Terms(data[a:b], features)
                edges = np.searchsorted(t.owner, np.arange(b - a + 1))
                lists = [t.hash[x:y].astype(np.int32) for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, b - a), part.column("toxic").slice(a, b - a), pa.array(fired.astype(np.int64)), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "toxic", "fired", "features"])

    seen = saved(texts.mapInArrow(look, "doc_id long, toxic int, fired long, features array<int>"), "votes")
    # At most 2 ** voters patterns.
    table = seen.groupBy("fired").agg(F.count("*").alias("n"), F.avg("toxic").alias("bad")).orderBy("fired").toPandas()
    fired = table["fired"].to_numpy()
    patterns = fired[:, None] >> np.arange(len(lexicons) + 3) & 1
    posterior = label_model(patterns, table["n"].to_numpy(float), np.clip(table["bad"].to_numpy(float), 0.02, 0.98))
    # The bounded sample again, now as few numbers a document.
    rows = seen.orderBy("doc_id").select("fired", "features").toPandas()
    target = posterior[np.searchsorted(fired, rows["fired"].to_numpy())]
    size = rows["features"].map(len).to_numpy()
    weights, bias = logistic(np.repeat(np.arange(len(rows)), size), np.concatenate([*rows["features"], np.zeros(0, np.int32)]).astype(np.int64), len(rows), len(features), target)
    return features, weights, bias


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id as text is a multiple of 5), score (0 to 1), predicted (score >= 0.5).

    Labels of held-out ids are never read. Null texts score as empty ones; a null id counts as not held out and trains nothing. Without
    labels of both classes every score is the share of the one class. Repeated rows are scored one by one and train as one; other columns are ignored.
    """
    rows = only(df, doc_id=doc_id, text=text)
    features, weights, bias = fit(rows.filter("doc_id IS NOT NULL"), only(labels, doc_id=doc_id, toxic=toxic), sample)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, out = part.column("text").to_pylist(), []
            for a, b in batches(data):
                t = Terms(data[a:b], features)
                z = bias + np.bincount(t.owner, weights=weights[t.hash.astype(np.int64)], minlength=b - a)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            if out:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
