"""Links, components and groups against all pairs, the archives by hand, and what the classifiers find in held-out rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import components, decontaminate, jaccard, line_dedup, pivots, queries, toxicity, warc
from tallywright.llm.words import Words


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, k) for k in range(n)]


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 460)]
    want = joined(500, links)
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.components(df, "a", "b").collect())
    seen = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: want[k] for k in seen}


def sentences(n, seed, words=400):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(words)}" for _ in range(rng.randint(6, 60))] for _ in range(n)]
    out = []
    for k in range(3 * n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 5])):
            t[rng.randrange(len(t))] = f"w{rng.randrange(words)}"
        out.append(" ".join(t).capitalize() + rng.choice([".", "!", ""]))
    return out


def test_near_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    data = sentences(40, 2)
    sets = []
    for t in data:
        w = t.lower().rstrip(".!").split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    links = [(a, b) for a in range(len(data)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    group = joined(len(data), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(data))
    got = {r.doc_id: r for r in jaccard.near_documents(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)).collect()}
    assert [(got[k].n_links, got[k].group_id, got[k].kept) for k in range(len(data))] == [(count[k], group[k], group[k] == k) for k in range(len(data))]
    assert all(got[k].class_id == min(j for j in range(len(data)) if sets[j] == sets[k]) for k in range(len(data)))


def test_pruning_keeps_what_reaches_the_threshold():
    assert jaccard.least_matches(16, 0.8, 1e-6) <= 6 and jaccard.least_matches(112, 0.8, 1e-6) > 50
    assert all(a <= b for a, b in zip([jaccard.least_matches(n, 0.8, 1e-6) for n in range(16, 100)], [jaccard.least_matches(n, 0.8, 1e-6) for n in range(17, 101)]))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = rng.randint(0, len(out)), rng.randrange(3)
        if kind == 0:
            out.insert(k, rng.choice("abcé"))
        elif out:
            k = min(k, len(out) - 1)
            out[k:k + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(out)


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 5])
def test_edit_distance(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 4, 9, 33, 80]))) for _ in range(400)]
    b = [changed(rng, x, rng.randint(0, 6)) for x in a]
    assert line_dedup.within(a, b, edits).tolist() == [edit(x, y) <= edits for x, y in zip(a, b)]


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, monkeypatch, edits):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 9000)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(12, 40))) for _ in range(60)]
    docs = []
    for _ in range(80):
        docs.append("\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))))
    places = [(d, n, line) for d, t in enumerate(docs) for n, line in enumerate(t.split("\n")) if len(line) >= 12]
    links = [(a, b) for a in range(len(places)) for b in range(a) if abs(len(places[a][2]) - len(places[b][2])) <= edits and edit(places[a][2], places[b][2]) <= edits]
    group = joined(len(places), links)
    want = {(d, n) for k, (d, n, _) in enumerate(places) if group[k] != k}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    assert {(r.doc_id, r.number) for r in line_dedup.repeated_lines(df, edits=edits, least=12).collect()} == want
    left = dict(line_dedup.without_repeated_lines(df, edits=edits, least=12).collect())
    for d, t in enumerate(docs):
        gone = [n for n in range(len(t.split("\n"))) if (d, n) in want]
        text = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert left.get(d) == (text if not gone or text.strip() else None)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[rng.integers(0, 60, 300)] + rng.normal(size=(300, 16)) * rng.choice([0, 0.02, 0.1, 0.3], (300, 1))]).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)).collect()}
    found = sum(got[k].n_links for k in got)
    assert 0.95 * near.sum() <= found <= near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in got)
    if found == near.sum():
        assert [got[k].component_id for k in range(len(v))] == joined(len(v), list(zip(*np.nonzero(near))))


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 2, 3, 6])))
    items = [" ".join(word() for _ in range(rng.randint(8, 25))) + ". " + " ".join(word() for _ in range(rng.randint(5, 9))) + "." for _ in range(30)]
    docs = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(120)]
    want = set()
    for d in range(0, 120, 3):
        i = rng.randrange(30)
        w = docs[d].split()
        k = rng.randint(0, len(w))
        docs[d] = " ".join(w[:k] + items[i].upper().replace(".", " ,").split() + w[k:])
        want.add((d, i))
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.score > 0.99 and r.question_overlap > 0.99 and r.answer_overlap > 0.99 for r in got)


def test_bounds_lose_no_item_above_the_threshold():
    rng = random.Random(7)
    word = lambda: f"w{min(int(rng.expovariate(0.04)), 200)}"
    index = decontaminate.Index(list(range(40)), [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(40)], 0.35, block=4)
    queries = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(200)]
    w = Words(queries)
    pairs = sorted({(k, int(np.searchsorted(index.terms, h))) for k in range(200) for h in w.hashes[w.at[k]:w.at[k + 1]] if h in index.terms})
    p, t = (np.array(x) for x in zip(*pairs))
    want = set()
    for k in range(200):
        score = np.zeros(40)
        for x in t[p == k]:
            score[index.item[index.at[x]:index.at[x + 1]]] += index.impact[index.at[x]:index.at[x + 1]]
        want |= {(k, i) for i in np.flatnonzero(score >= 0.35 - 1e-9)}
    assert {(k, i) for k, i, _ in index.retrieve(p, t, 200)} == want and want


def test_arc_versions_and_digests():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n\nhttp://x 0.0.0.0 1 a/b 3\nabc"
    one = b"filedesc://a.arc 0.0.0.0 20240101000000 text/plain 8\n1 0 org\n\nhttp://a 1.2.3.4 2024 text/html %d\n%s\n" % (len(body), body)
    two = b"filedesc://a.arc 0.0.0.0 20240101000000 text/plain 200 - - 0 a.arc 8\n2 0 org\n\nhttp://a 1.2.3.4 20240102030405 text/html 200 c - 9 a.arc %d\n%s\n" % (len(body), body)
    for raw, version in ((one, "1"), (two, "2")):
        records = list(warc.arc_records(raw))
        assert [r["damaged"] for r in records] == [False, False] and records[1]["version"] == version and records[1]["body"] == body
    assert [r["damaged"] for r in warc.arc_records(one[:-9])] == [False, True]
    assert warc.iso_date("2024") == "2024-01-01T00:00:00Z" and warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z"
    record = {"id": "urn:uuid:1", "kind": "response", "to": None, "date": "d", "url": "u", "ip": "i", "payload_digest": "x", "head": b"HTTP/1.1 200 OK\r\n\r\n", "payload": b"\xff\xfe\r\n\r\nWARC/1.1"}
    import gzip
    back = list(warc.warc_records(gzip.compress((warc.warc_record(record) + "\r\n\r\n").encode())))
    assert back[0][1] == record["head"] + record["payload"] and back[0][0]["warc-type"] == "response"


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(9)
    bad, words = ["idiot", "grobuxa", "grobuxi", "grobuxo", "vandela"], [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1500):
        toxic = rng.random() < 0.2
        t = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            t.insert(rng.randint(0, len(t)), rng.choice(bad))
        docs.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert len(held) > 200 and sum(a == b for a, b in held) >= 0.97 * len(held)
    # Labels of held-out rows change nothing.
    import binascii
    turned = [(k, 1 - y if binascii.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    again = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(turned, "doc_id long, toxic int")).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {r.doc_id: round(r.score, 9) for r in again}


def test_correlated_voters_count_once():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, truth, ~truth) for _ in range(3)]
    copied = np.where(rng.random(4000) < 0.6, truth, ~truth)
    votes = np.array([*good, copied, copied, copied, copied]).T.astype(int)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.clip(patterns[:, :3].mean(axis=1), 0.02, 0.98)
    posterior = toxicity.label_model(patterns, counts.astype(float), start)[place.ravel()]
    assert ((posterior > 0.5) == truth).mean() > 0.9


@pytest.mark.parametrize("n", [3000, 9000])
def test_vectors_of_a_dense_cluster(spark, n):
    """A third of the rows are distinct vectors of one cluster: their links are found at any size."""
    rng = np.random.default_rng(n)
    k = n // 3
    v, centre = rng.standard_normal((n, 64)), np.eye(64)[0]
    v[:k, 0] = 0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:k] = 0.97 * centre + np.sqrt(1 - 0.97 ** 2) * v[:k]
    want = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = pivots.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == n and all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * want.sum() > 0


def test_short_lines_that_repeat_exactly(spark):
    docs = ["All rights reserved.\n\nfirst text\n  ", "All rights reserved.\n\nsecond text\n  \nx", "x\nAll rights reserved!\nx"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r.doc_id, r.number) for r in line_dedup.repeated_lines(df, exact=1).collect()} == {(1, 0), (2, 0), (2, 2)}
    assert {(r.doc_id, r.number) for r in line_dedup.repeated_lines(df, exact=2).collect()} == {(1, 0)}
    assert line_dedup.repeated_lines(df).count() == 0


def test_line_query_removes_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "All rights reserved.\nfirst"), (2, "All rights reserved.\nsecond")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.dropped for r in queries.QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()} == {1: [], 2: [0]}


def test_leaks_are_the_same_in_several_indexes(spark, monkeypatch):
    """Scores follow from the statistics of all items, however many indexes and slices there are."""
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.expovariate(0.02)), 300)}"
    items = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(60)]
    docs = [" ".join([*(word() for _ in range(20)), *items[k % 60].split()[:rng.randint(8, 30)]]) for k in range(120)]
    df, of = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    run = lambda: {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.leaks(df, of, overlap=0.2).collect()}
    want = run()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1500)
    assert len(want) > 40 and run() == want


def test_slices_lose_no_item(monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{min(int(rng.expovariate(0.04)), 200)}"
    index = decontaminate.Index(list(range(50)), [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(50)], 0.35, block=4)
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(100)]
    w = Words(texts)
    pairs = sorted({(k, int(np.searchsorted(index.terms, h))) for k in range(100) for h in w.hashes[w.at[k]:w.at[k + 1]] if h in index.terms})
    p, t = (np.array(x) for x in zip(*pairs))
    run = lambda: {(k, i): round(s, 9) for k, i, s in index.retrieve(p, t, 100)}
    want = run()
    monkeypatch.setattr(decontaminate, "CELLS", 10)
    assert len(want) > 20 and run() == want


def test_repeated_rows_of_a_document_are_one_document(spark):
    words = [f"word{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(words[:-2])
    df = spark.createDataFrame([(1, a), (1, a), (1, a), (2, b), (3, "z " + b), (3, a + " of another kind " * 20)], "doc_id long, text string")
    assert {r.doc_id: (r.n_links, r.group_id) for r in jaccard.near_documents(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_repeated_rows_train_as_one(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice(["you idiot scum", "garden tea", "stupid", "morning rain"][k % 2::2]) for _ in range(12))) for k in range(120)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in docs], "doc_id long, toxic int")
    fit = lambda rows: toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, 100)
    one, many = fit(docs), fit(docs + [d for d in docs if d[0] < 10] * 40)
    assert len(one[0]) and all(np.array_equal(x, y) for x, y in zip(one[:2], many[:2])) and one[2] == many[2]
