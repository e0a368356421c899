"""Interning against dictionaries, importance weights against a plain definition."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywright.llm import interning, resampling
from tallywright.llm.common import numbered


def test_interning(monkeypatch):
    rng = random.Random(3)
    some = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in [*range(70), 100, 3000] for _ in range(8)]
    uses = [rng.choice(some) for _ in range(20_000)]
    length = np.array([len(w) for w in uses])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    data = interning.padded(b"".join(uses))
    assert interning.xxhash64(data, start, length).tolist() == [xxhash.xxh64_intdigest(w) for w in uses]
    # Also where all keys are equal and only the bytes tell strings apart.
    for hashed in (interning.xxhash64, lambda d, s, n: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(interning, "xxhash64", hashed)
        t = interning.Interned(data, start, length)
        strings = t.strings()
        assert [strings[k] for k in t.slot.tolist()] == uses and dict(zip(strings, t.count.tolist())) == Counter(uses)
    assert len(interning.Interned(data, start[:0], length[:0]).owner) == 0


def plain(docs, target, size, buckets, least, percent, seed):
    """docs: [(id, text)] -> {id: (features, weight, score, rank)}"""
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i:i + k]) for k in range(1, size + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    total = lambda c: sum(c.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    out, fit = {}, []
    for i, text in docs:
        words, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(fs), weight, score)
        if len(words) >= least:
            fit.append((-score, i))
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(fit)[:percent * len(fit) // 100])}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


@pytest.mark.parametrize("size", [1, 2, 3])
def test_resample(spark, monkeypatch, size):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 700)
    rng = random.Random(size)
    words = ["The", "ÉTÉ", "x1", "don't", "a_b", "zwölf", "日本語", "Straße", *[f"w{k}" for k in range(60)], "k" * 40]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "--"]) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))
    docs = [(k, text()) for k in range(120)] + [(200, None), (201, ""), (202, "w1 " * 3000), (203, "w1 " * 3000)]
    target = [" ".join(rng.choice(words[:12]) for _ in range(30)) for _ in range(9)] + [None]
    want = plain(docs, target, size, 500, 20, 30, 2024)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("weight", F.lit("x")).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), size=size, buckets=500, percent=30)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got.collect()} == want


def test_resample_edges(spark):
    df = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (None, "b " * 30), (None, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none, percent=100).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and sorted(r.n_features for r in got) == [0, 30, 30, 30]
    assert resampling.resample(df.limit(0), none).collect() == []


def test_numbered(spark):
    rng = random.Random(5)
    values = [rng.randrange(50) for _ in range(400)]
    rows = numbered(spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long").repartition(7), [F.col("v").desc(), "k"], "rank").collect()
    want = sorted(((v, k) for k, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    assert [(r.v, r.k) for r in sorted(rows, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in rows) == list(range(1, 401))
