"""Collocations and compacted paths against plain counting."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywright.llm import phrases


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low(text)) if (w := re.findall(r"[^ \t]+", p))]


def plain(rows, size, least, share, first):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = Counter()
        for l, t in rows:
            for p in pieces(t) if (l or "und") == lang else []:
                f.update(tuple(p[i:i + k]) for k in range(1, size + 1) for i in range(len(p) - k + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        drop = {g[i:i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= share * found[g[i:i + k]]}
        best = []
        for g, a in found.items():
            if g not in drop:
                score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:first])]
    return sorted(out)


def rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["ÉTÉ", "the", "The", "of", "日本", "x y", "k" * 40]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)]
    def text():
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(words) if rng.random() < 0.8 else rng.choice(passages))
            parts.append(rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", " of the "]))
        return "".join(parts)
    return [(rng.choice(["en", "en", "en", "fr", None, "und"]), text()) for _ in range(n)] + [("en", None), ("de", ""), ("en", "w1 w2 " * 2000)]


@pytest.mark.parametrize("size, least, share, heavy", [(3, 4, 50, 1000), (3, 2, 80, 12), (2, 3, 50, 12), (4, 3, 50, 12), (5, 2, 100, 1000)])
def test_collocations(spark, monkeypatch, size, least, share, heavy):
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    monkeypatch.setattr(phrases, "BATCH_BYTES", 900)
    data = rows(size)
    df = spark.createDataFrame(data, "lang string, text string").withColumn("n", F.lit("x")).withColumn("k", F.lit("x")).repartition(4)
    got = phrases.collocations(df, size=size, least=least, share=share, first=40)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, size, least, share, 40)


def test_heavy_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HEAVY", 12)
    data = rows(7)
    count = Counter(w for _, t in data for p in pieces(t) for w in p)
    found = set(phrases.heavy_words(spark.createDataFrame(data, "lang string, text string").repartition(3), "text"))
    total = sum(count.values())
    assert {w for w, n in count.items() if 6 * n > total} <= found <= {w for w, n in count.items() if 12 * n > total} and len(found) < 12


def test_paths(spark):
    """A passage that ten texts share is one path; where texts part it ends; its inner nodes have its weight."""
    a, b = "s1 a b c d e f g h t1".split(), "s2 a b c d x y z t2".split()
    data = [("en", " ".join(a))] * 10 + [("en", " ".join(b))] * 5
    table = phrases.flows(spark.createDataFrame(data, "lang string, text string"), "lang", "text", 3, 2)
    got = phrases.paths(table.filter("k = 3").drop("k"), table.filter("k = 2").drop("k")).collect()
    assert {(" ".join(r.words), r.n) for r in got} == {("s1 a b", 10), ("s2 a b", 5), ("a b c d", 15), ("c d e f g h t1", 10), ("c d x y z t2", 5)}


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "  ,, ")], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(df, size=1)
