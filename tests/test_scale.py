"""Bounds that have to hold for large keys, long chains and frequent tokens, and the results there."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import links, ordered, similarity
from tallywright.operators import aggregates as ag, graph as gr, joins as jn, search, windows as wn

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rounds(monkeypatch):
    """Written tables of the pointer jumps and of the operators that use them."""
    made = []
    for module in (links, gr):
        kept = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=kept: made.append(1) or f(df))
    return made


@pytest.fixture
def whole_shuffles(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_follow(spark):
    rng = random.Random(4)
    to = {k: rng.randrange(400) for k in range(300)}
    got = {r.src: (r.end, r.ended) for r in links.follow_to_cycles(spark.createDataFrame(list(to.items()), "src long, dst long")).withColumn("ended", F.lit(True)).collect()}
    for k in to:
        seen, at = [k], to[k]
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        assert got[k][0] == (at if at not in seen or at not in to else next(x for x in seen if x == at))
    ends = {r.src: (r.end, r.steps) for r in links.follow(spark.createDataFrame(list(to.items()), "src long, dst long")).filter("ended").collect()}
    for k, (end, steps) in ends.items():
        at = k
        for _ in range(steps):
            at = to[at]
        assert at == end and end not in to
    assert links.follow(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_aliases_of_a_long_chain(spark, rounds):
    n = 10_000
    a = spark.range(n).select(F.concat(F.lit("k"), "id").alias("ekey"), F.concat(F.lit("k"), F.col("id") + 1).alias("evalue"), F.col("id").alias("ts"), F.col("id").cast("string").alias("id"))
    got = gr.alias_resolve(spark.createDataFrame([("k0",), ("k9999",), ("x",), (None,)], "key string"), a)
    assert {r.key: r.target for r in got.collect()} == {"k0": "k10000", "k9999": "k10000", "x": "x", None: None}
    assert len(rounds) <= 17  # 15 jumps at most, the links and the first state


def plain_cycles(edges):
    edges = set(edges)
    while True:
        src, dst = {a for a, _ in edges}, {b for _, b in edges}
        kept = {(a, b) for a, b in edges if a in dst and b in src}
        if kept == edges:
            return edges
        edges = kept


def test_cycles(spark, rounds):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert gr.cycle_check(chain).collect() == []
    assert len(rounds) < 20
    rng = random.Random(3)
    for size, edges in ((30, 40), (60, 70), (20, 60), (200, 190)):
        e = [(rng.randrange(size), rng.randrange(size)) for _ in range(edges)]
        got = gr.cycle_check(spark.createDataFrame(e, "src long, dst long")).collect()
        assert {(r.src, r.dst) for r in got} == plain_cycles(e) and all(r.self_edge == (r.src == r.dst) for r in got)


def test_chains_that_fork_and_meet_heads(spark):
    rng = random.Random(9)
    up = {k: rng.choice([None, rng.randrange(k), rng.randrange(k), 500 + k]) if k else None for k in range(150)} | {900: 901, 901: 902, 902: 900, 903: 901}
    heads = [149, 148, 120, 75, 3, 0, 900, 903]
    want = {}
    for h in heads:
        at, depth = h, 0
        while at is not None and at in up and (h, at) not in want:
            want[h, at] = depth
            at, depth = up[at], depth + 1
    df = spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in up.items()], "id string, supersedes string")
    got = gr.chain_members(df, spark.createDataFrame([(str(h),) for h in heads], "id string")).collect()
    assert {(int(r.head), int(r.id)): r.depth for r in got} == want and len(got) == len(want)


def test_shuffled_rows_of_a_frequent_token(spark):
    """A token that 100,000 sets share: the rows that meet, and what plain prefix lists in blocks of one side would take."""
    n = 100_000
    k = F.col("id")
    # The frequent token is inside the prefix of every set, for each set has only frequent tokens.
    token = lambda name, of: F.concat(F.lit(name), (F.xxhash64(k, F.lit(name)) % of).cast("string"))
    sets = spark.range(n).select(F.array_sort(F.array_distinct(F.array(F.lit("hot"), token("a", 6), token("b", 6), token("c", 6), token("d", 6)))).alias("tokens"))
    sets = sets.withColumn("tokens", F.concat("tokens", F.array(F.concat(F.lit("only"), F.monotonically_increasing_id().cast("string"))))).withColumn("sid", similarity.set_id(F.col("tokens")))
    assert sets.filter(F.array_contains("tokens", "hot")).count() == n
    left, right, keys = similarity.postings(sets, sets, 0.75, [], True)
    rows = left.count() + right.count()
    largest = right.groupBy(*keys).count().agg(F.max("count")).first()[0]
    # 6 tokens, 2 of them in the prefix: the unique one and a frequent one, refined by the token behind it.
    print(f"rows that meet for a token of df {n}: {rows}, largest list {largest}")
    assert rows < 12 * n and largest <= 2 * similarity.BLOCK
    assert similarity.similar_sets(sets.limit(0), sets.limit(0), 0.75, self_join=True).count() == 0


@pytest.mark.parametrize("hot, block", [(2, 2), (1, 50), (5, 3)])
@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.6, 0.9, 1.0])
def test_similarity_with_refined_tokens(spark, monkeypatch, hot, block, threshold):
    monkeypatch.setattr(similarity, "HOT", hot)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(hot)
    some = {frozenset(rng.sample("abcdefghijkl", rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 8]))) for _ in range(90)}
    sets = [sorted(s) for s in some]
    make = lambda rows: spark.createDataFrame([(r,) for r in rows], "tokens array<string>").withColumn("sid", similarity.set_id(F.col("tokens")))
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    got = similarity.similar_sets(make(sets), make(sets), threshold, self_join=True)
    assert got.count() == got.select("left_sid", "right_sid").distinct().count() == sum(score(a, b) >= threshold for i, a in enumerate(sets) for b in sets[:i])
    half = sets[:len(sets) // 2] + sets[-5:]
    assert similarity.similar_sets(make(half), make(sets), threshold).count() == sum(score(a, b) >= threshold for a in half for b in sets)


def test_ranges_of_a_busy_hour(spark, whole_shuffles):
    """Half of all rows are one key's inside one hour, and a thousand of these at one instant: no range holds more than twice its share.

    Adaptive execution, which joins ranges below its advisory size, is kept from it here, for all of these are.
    """
    rng = random.Random(2)
    rows = [("hot", T0 + dt.timedelta(seconds=rng.randrange(3600)) if n >= 1000 else T0, n) for n in range(20_000)]
    rows += [(f"k{rng.randrange(50)}", T0 + dt.timedelta(hours=rng.randrange(900)), 20_000 + n) for n in range(20_000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long").repartition(6)
    r = ordered.ranged(df, ["key"], ["ts", "id"])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert r.groupBy("key", "_range").count().agg(F.max("count")).first()[0] <= 2 * len(rows) / partitions
    got = ordered.bucketed_lag(r, ["key"], F.col("_range"), ["ts", "id"], {"before": "id"})
    got = {x.id: x.before for x in got.collect()}
    last = {}
    for key, t, i in sorted(rows):
        assert got[i] == last.get(key)
        last[key] = i
    state = F.when(F.col("id") % 3 == 0, "x").otherwise("y")
    streak = {x.id: x.streak for x in wn.consecutive_streak(df.withColumn("state", state), "key", "state").collect()}
    run = {}
    for key, t, i in sorted(rows):
        s = "x" if i % 3 == 0 else "y"
        run[key] = (s, run[key][1] + 1) if key in run and run[key][0] == s else (s, 1)
        assert streak[i] == run[key][1]


def test_order_statistics_of_a_frequent_value(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), 7.5 if rng.random() < 0.5 else rng.randrange(1000) / 4) for _ in range(9000)] + [("c", 1.0), (None, 2.0), (None, 3.0)]
    got = ag.latency_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}, 10.0)
    counted = [n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in n]
    assert not counted
    for r in got.collect():
        v = sorted(x for k, x in rows if k == r.k)
        assert (r.n, r.p50, r.p95, r.top) == (len(v), v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.95))], v[-1])


def test_days_ahead(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    days = sorted({rng.randrange(3000) for _ in range(200)})
    events = [(day(rng.randrange(3100)), f"t{rng.randrange(12)}") for _ in range(3000)]
    df = spark.createDataFrame(events, "date date, text string").repartition(5)
    marks = spark.createDataFrame([(day(d),) for d in days], "date date")
    want = {}
    for d, t in events:
        at = next((x for x in days if day(x) >= d), None)
        if at is not None:
            want[day(at), t] = min(d, want.get((day(at), t), d))
    assert {(r.day, r.text): r.date for r in jn.asof_rows(df, marks).collect()} == want
    plan = jn.asof_rows(df, marks)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan
    joined = {r.day: r.event for r in jn.asof_forward(df, marks).collect()}
    for d in {k for k, _ in want}:
        listed = [t for _, t in sorted((when, t) for (x, t), when in want.items() if x == d)]
        text = ""
        for t in listed:
            text = t if not text else text if t in text else f"{text} | {t}"
        assert joined[d] == text


def _bm25(queries, docs, fields, k, scope):
    """(query, scope, id, score) of the first k by the formula. Rows of one id, field and length count as one document."""
    from collections import Counter, defaultdict
    from math import log
    docs, asked, total = [d for d in docs if d["room"] is not None or not scope], defaultdict(Counter), defaultdict(float)
    for q, terms in queries:
        asked[q].update(set(terms))
    for field, boost in fields.items():
        n, words, tf, of_field = Counter(), Counter(), defaultdict(Counter), defaultdict(float)
        for d in docs:
            t = (d[field] or "").split()
            s = d["room"] if scope else None
            n[s] += 1
            words[s] += len(t)
            tf[s, d["id"], len(t)].update(t)
        df = Counter((s, w) for (s, _, _), c in tf.items() for w in c)
        for (s, i, size), c in tf.items():
            for q, terms in asked.items():
                for w in set(terms) & set(c):
                    idf = log(1 + (n[s] - df[s, w] + 0.5) / (df[s, w] + 0.5))
                    of_field[q, s, i] += terms[w] * boost * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size * n[s] / words[s]))
        for key, x in of_field.items():
            total[key] = max(total[key], x)
    out = []
    for q, s in {key[:2] for key in total}:
        rows = sorted(((-round(x, 9), i) for (a, b, i), x in total.items() if (a, b) == (q, s)), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        out += [(q, s, i, round(-x, 6)) for x, i in rows[:k]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scope", [(), ("room",)])
@pytest.mark.parametrize("block, step", [(1 << 17, 1 << 21), (4, 64)])
def test_bm25_scores_documents_where_they_are_read(spark, monkeypatch, scope, block, step):
    """Ids that come again or are null, copies, queries that come twice, rooms that are null: in one block and in many."""
    monkeypatch.setattr(search, "TERM_BLOCK", block)
    monkeypatch.setattr(search, "STEP", step)
    rng = random.Random(5)
    words = [f"w{n}x" for n in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [{"id": f"d{n % 55}" if n else None, "room": rng.choice(["a", "b", None]), "title": text(rng.randrange(3)), "body": text(rng.randrange(9)) if n % 7 else "w1x w2x"} for n in range(60)]
    docs[3]["body"] = None
    asked = [(n, [rng.choice(words) for _ in range(3)]) for n in range(6)]
    asked.append(asked[2])
    fields = {"title": 2.0, "body": 1.0}
    got = search.bm25_search(spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame(docs, "id string, room string, title string, body string").repartition(3), fields, 4, scope).collect()
    assert sorted(((r.query_id, r.room if scope else None, r.id, round(r.score, 6)) for r in got), key=repr) == _bm25(asked, docs, fields, 4, scope)


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    """400 documents that all match 50 queries: what reaches the ranking is a few rows a task and query, not 20,000 pairs."""
    docs = spark.createDataFrame([(n, "common " * (1 + n % 5)) for n in range(400)], "id long, text string").repartition(2)
    asked = spark.createDataFrame([(q, ["common"]) for q in range(50)], "query_id long, terms array<string>")
    assert search.bm25_scores(asked, docs, {"text": 1.0}, top=3).count() <= 50 * 3 * 2
    assert search.bm25_scores(asked, docs, {"text": 1.0}).count() == 20_000


def test_shrinking_sends_no_text_to_python(spark):
    """Python gets lengths; cuts count code points, and nulls and values that are no strings stay out."""
    from tallywright.operators import documents as dp
    df = spark.createDataFrame([(1, "ñ😀" * 700, "y" * 100, 3), (2, None, "", 4)], "id long, summary string, keywords string, title int")
    out = dp.shrink_to_budget(df, ["summary", "keywords", "title"], 600)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "fit(struct(summary, coalesce(length(summary" in plan.replace("#", "").translate(str.maketrans("", "", "0123456789")), plan
    for r, was in zip(sorted(out.collect(), key=lambda r: r.id), df.collect()):
        want = dp.shrink_pairs({"summary": was.summary, "keywords": was.keywords, "title": None}, 600, ["summary", "keywords"])
        assert (r.summary, r.keywords, r.title, r.bytes) == (want["summary"], want["keywords"], None, sum(len(k) + len(v or "") for k, v in want.items()))


def test_a_catalog_reads_each_text_once(spark):
    from tallywright.sources import catalog
    docs = spark.createDataFrame([("a/b.txt", "x - y1", 6), ("a/c", None, 0), ("big.txt", "abc", 99)], "path string, text string, size long")
    out = catalog.build_catalog(docs, "path", "text", "size", 50)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [(r.text_chars, r.sidecar) for r in sorted(out.collect(), key=lambda r: r.path)] == [(3, True), (0, False), (0, False)]


ODD_TEXTS = ["", " ", "a", "ab", "The cat's 2nd hat, x-ray: Ab12 AB12 ab12", "\u212aelvin \u0130stanbul stra\u00dfe na\u00efve caf\u00e9s", "one", "two", "", "end9", "9", "z\x00zz\nnew line the and of",
             "\U0001f600ok\U0001f600", None, "ab" * 50, "last a", "b"]


@pytest.mark.parametrize("bytes_at_once", [1, 7, 1 << 22])
def test_words_cut_out_of_bytes_are_the_tokens(spark, monkeypatch, bytes_at_once):
    import pyarrow as pa
    from tallywright.functions import text as tx
    monkeypatch.setattr(search, "TEXT_BYTES", bytes_at_once)
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, t string").orderBy("i").select(F.lower(F.coalesce("t", F.lit(""))).alias("low"), tx.token_list(F.col("t")).alias("toks")).collect()
    vocabulary = sorted({w for r in rows for w in r.toks})[::2] + ["the", "absent"]
    texts = pa.array(["before", *[r.low for r in rows], "after"]).slice(1, len(rows))
    length, piece, found = search._in_words(texts, pa.array(vocabulary))
    assert length.tolist() == [len(r.toks) for r in rows]
    assert [(p, vocabulary[f]) for p, f in zip(piece.tolist(), found.tolist())] == [(i, w) for i, r in enumerate(rows) for w in r.toks if w in vocabulary]
    assert [x.tolist() for x in search._in_words(texts.slice(0, 0), pa.array(vocabulary))] == [[], [], []]


def test_bm25_reads_the_texts_twice_and_shuffles_no_words(spark, tmp_path, monkeypatch):
    """Lengths and document frequencies come from one reading, and only sums of them are shuffled, not one row for a word."""
    made, kept = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    spark.range(3000).select(F.col("id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), (F.col("id") * (j + 3) % 97).cast("string")) for j in range(20)]).alias("text")).write.parquet(f"{tmp_path}/d")
    asked = spark.createDataFrame([(1, ["w0x3", "w5x8"]), (2, ["w1x4", "none"])], "query_id long, terms array<string>")
    hits = search.bm25_search(asked, spark.read.parquet(f"{tmp_path}/d"), {"text": 1.0}, 5)
    made.append(hits._jdf.queryExecution().optimizedPlan().toString())
    readings = [p for p in made if "lower" in p]
    assert len(readings) == 2 and all(p.count("lower") == 1 for p in readings)
    assert not any("regexp_extract_all" in p or "array_distinct(filter" in p for p in made)
    assert {r.query_id for r in hits.collect()} == {1, 2}
