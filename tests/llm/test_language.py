"""Evidence fusion against a plain version, and how often it is right where the declared language is hidden or wrong."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import language
from tallywright.llm.language import CELLS, LANGUAGES, NOISE, NONE, PART, SHRINK

NAMES = [*LANGUAGES, NONE]


def plain(rows):
    """rows: [(text, declared, suffix, host)] -> [(language, probability)]"""
    grams, letters, found = {x: [0] * CELLS for x in LANGUAGES}, [0] * 4096, []
    for text, declared, _, _ in rows:
        cell, one, _ = language._trigrams([text])
        found.append((cell.tolist(), one.tolist()))
        for c in found[-1][1]:
            letters[c] += 1
        for c in found[-1][0] if declared in LANGUAGES else []:
            grams[declared][c] += 1
    total = {x: sum(g) for x, g in grams.items()}
    share = lambda x, c: (1 - NOISE) * (grams[x][c] + 0.1) / (total[x] + 0.1 * CELLS) if total[x] else 0.0
    alone = [math.log((n + 0.1) / (sum(letters) + 0.1 * 4096)) for n in letters]
    said, guess = [], []
    for cells, ones in found:
        noise = [alone[c] + (alone[ones[k - 1]] if k > 0 else 0) + (alone[ones[k - 2]] if k > 1 else 0) for k, c in enumerate(ones)]
        sums = [PART * sum(math.log(share(x, c) + NOISE * math.exp(n)) for c, n in zip(cells, noise)) for x in LANGUAGES] + [PART * sum(noise)]
        said.append(sums)
        guess.append(NAMES[sums.index(max(sums))] if cells else None)

    def tally(pick):
        out = {}
        for r, g in zip(rows, guess):
            if g and (v := pick(r)) is not None:
                out.setdefault(v, dict.fromkeys(NAMES, 0))[g] += 1
        return out

    every = tally(lambda r: 0).get(0, dict.fromkeys(NAMES, 0))
    mass = sum(every.values()) or 1
    base = [(every[x] + 1) / (mass + len(NAMES)) for x in NAMES]
    declared, suffix = tally(lambda r: r[1]), tally(lambda r: r[2])
    hosts = tally(lambda r: (r[3], r[2]) if r[3] is not None else None)
    shrunk = lambda own, wider: [(own[x] + SHRINK * p) / (sum(own.values()) + SHRINK) for x, p in zip(NAMES, wider)]
    likely = lambda table, v: [math.log((table.get(v, {}).get(x, 0) + 0.5) / (every[x] + 1 + 0.5 * (max(1, len(table)) + 1))) for x in NAMES]
    out = []
    for (_, d, s, h), sums, g in zip(rows, said, guess):
        prior = base
        if (h, s) in hosts:
            prior = shrunk(hosts[h, s], shrunk(suffix[s], base) if s in suffix else base)
        odds = [a + math.log(p) for a, p in zip(sums, prior)]
        for table, v in ((declared, d), (suffix, s)):
            if v is not None:
                odds = [a + b for a, b in zip(odds, likely(table, v))]
        best = odds.index(max(odds))
        out.append((NAMES[best], 1 / sum(math.exp(o - max(odds)) for o in odds)) if g else (NONE, 1.0))
    return out


def documents(n, seed):
    import duckdb
    got = duckdb.execute("SELECT text, lang, source FROM read_parquet('/root/testdata/sf0.01/documents.parquet') WHERE lang IN ('de', 'en', 'es', 'fr') ORDER BY hash(doc_id + ?) LIMIT ?", [seed, n]).fetchall()
    return [((t or "")[:400], l, s) for t, l, s in got]


def test_fusion_equals_a_plain_version(spark):
    rng = random.Random(1)
    rows = [(t, rng.choice([l, l, None, "en", "xx"]), rng.choice([l, "com", None]), rng.choice([s, s, None])) for t, l, s in documents(195, 3)]
    rows += [("", "de", "de", "h"), (None, None, None, None), ("!!! 12 34", "en", None, "src1"), ("ok", None, None, "src1"), ("die", "fr", "de", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, text string, declared string, suffix string, host string").repartition(3)
    got = {r.k: r for r in language.identify(df, "k", declared="declared", suffix=F.col("suffix"), host=F.col("host")).collect()}
    for k, (name, probability) in enumerate(plain(rows)):
        assert got[k].probability == pytest.approx(probability, rel=1e-6)
        assert got[k].language == name and got[k].kept == (name != NONE and probability >= 0.5)


@pytest.mark.parametrize("change, least", [("hidden", 0.98), ("swapped", 0.95)])
def test_accuracy_where_the_declared_language_is_hidden_or_wrong(spark, change, least):
    """A third of the rows declare nothing, or another language; the rest teach the trigrams."""
    rng = random.Random(2)
    rows = documents(600, 5)
    rows = [(t, l, s) for t, l, s in rows if sum(c.isalpha() for c in t) >= 40]
    shown = [l if rng.random() > 1 / 3 else None if change == "hidden" else rng.choice([x for x in LANGUAGES if x != l]) for _, l, _ in rows]
    df = spark.createDataFrame([(k, t, d, s) for k, ((t, _, s), d) in enumerate(zip(rows, shown))], "k long, text string, declared string, host string")
    got = {r.k: r.language for r in language.identify(df, "k", declared="declared", host=F.col("host")).collect()}
    asked = [k for k, (r, d) in enumerate(zip(rows, shown)) if d != r[1]]
    right = np.mean([got[k] == rows[k][1] for k in asked])
    print(f"{change}: {right:.3f} of {len(asked)} right")
    assert len(asked) > 100 and right >= least
