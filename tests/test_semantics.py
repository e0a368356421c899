"""Semantics that no SQL states: greedy clusters, chunking, dates in text, nested masking, state machines, files."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import similarity, text as tx
from tallywright.functions.ordered import bucketed_lag, bucketed_row_number, bucketed_running
from tallywright.operators import clusters as cl, documents as dp, finance as fn, graph as gr, ledger, privacy as pr, search as vs, windows as wn
from tallywright.sources import catalog as cat, feeds
from tallywright.streaming import jobs, runner
from tests.brute import jac, leaders, toks

T0 = dt.datetime(2024, 1, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n, seed, hot=0):
    """Random short texts; ``hot`` of them are copies or near copies of one text."""
    r = random.Random(seed)
    out = [" ".join(r.choices(WORDS, k=r.randint(1, 9))) + f" {r.randint(1, 5)}" for _ in range(n - hot)]
    base = " ".join(WORDS[:12])
    out += [base + (f" extra{i % 7}" if i % 3 else "") for i in range(hot)]
    out += ["", None, "the and of", "caffè été", "\U0001f600 emoji", "line one\r\nline two"]
    r.shuffle(out)
    return out


def claims(spark, n=80, seed=1, hot=0):
    rows = [(f"{i:04d}", T0 + dt.timedelta(hours=i // 2), f"a{i % 5}", "fact" if i % 3 else "decision", x) for i, x in enumerate(texts(n, seed, hot))]
    return rows, spark.createDataFrame(rows, "id string, ts timestamp_ntz, agent string, type string, text string")


@pytest.mark.parametrize("threshold,hot", [(0.35, 0), (0.5, 40), (0.8, 25)])
def test_leader_clusters_equal_the_greedy_definition(spark, threshold, hot):
    rows, df = claims(spark, 120, 7, hot)
    want = leaders([(i, a, x) for i, _, a, _, x in sorted(rows, key=lambda r: (r[1], r[0]))], threshold)
    for parts in (1, 7):
        got = {r.id: r.leader_id for r in cl.leader_clusters(df.repartition(parts), ["ts", "id"], threshold=threshold).collect()}
        assert got == want


def test_leader_clusters_in_several_steps(spark):
    rows, df = claims(spark, 120, 3, 50)
    want = leaders([(i, "", x) for i, _, _, _, x in sorted(rows, key=lambda r: (r[1], r[0]))], 0.5)
    got = {r.id: r.leader_id for r in cl.leader_clusters(df, ["ts", "id"], scope=(), threshold=0.5, pair_budget=200).collect()}
    assert got == want
    # An order that is a text is cut the same way.
    by_id = leaders([(i, "", x) for i, _, _, _, x in sorted(rows, key=lambda r: r[0])], 0.5)
    assert {r.id: r.leader_id for r in cl.leader_clusters(df, ["id"], scope=(), threshold=0.5, pair_budget=200).collect()} == by_id


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_is_exact(spark, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rows, df = claims(spark, 90, 11, 20)
    s = df.select(tx.tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0).withColumn("sid", similarity.set_id(F.col("tokens"))).dropDuplicates(["sid"])
    sets = [set(r.tokens) for r in s.collect()]
    want = sum(jac(a, b) >= threshold for i, a in enumerate(sets) for b in sets[:i])
    assert similarity.similar_sets(s, s, threshold, self_join=True).count() == want


def test_jaccard_exactly_at_the_threshold(spark):
    df = spark.createDataFrame([("1", T0, "fact", "aa bb cc dd"), ("2", T0, "fact", "aa bb cc dd ee")], "id string, ts timestamp_ntz, type string, text string")
    assert [(r.id, r.match_id) for r in cl.near_duplicate(df, ["ts", "id"]).collect()] == [("2", "1")]


def test_group_assertions_majority_and_tie(spark):
    df = spark.createDataFrame([("1", "s", "x", T0), ("2", "s", "y", T0), ("3", "s", "y", T0), ("4", "s", "x", T0), ("5", "u", "z", T0)], "id string, subject string, leader_id string, ts timestamp_ntz")
    got = {r.id: r.role for r in cl.group_assertions(df, ["subject"], ["ts", "id"]).collect()}
    assert got == {"1": "assertion", "4": "assertion", "2": "contradiction", "3": "contradiction", "5": "assertion"}


def test_score_claim_boundaries(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    rows = [("c", r, f"{r[0]}{i}", dt.datetime(2024, 3, 1), 1.0, str(i)) for r, n in (("assertion", 3), ("contradiction", 1)) for i in range(n)] + [("d", "assertion", "x", dt.datetime(2024, 1, 31), 1.0, "9")]
    df = spark.createDataFrame(rows, "k string, role string, agent string, ts timestamp_ntz, confidence double, id string")
    got = {r.k: r for r in cl.score_claim(df, ["k"], now).collect()}
    assert got["c"].trust == pytest.approx(1 - 0.125 - 0.6) and got["c"].status == "contested"
    assert got["d"].trust == pytest.approx(1 - 0.5 ** 0.5) and got["d"].status == "unverified"


def test_contested_groups(spark):
    rows = [("1", T0, "a", "budget for project apollo is 100 dollars"), ("2", T0, "b", "budget for project apollo is 100 dollars"),
            ("3", T0, "c", "budget for project zeus moon is 900 euros"), ("4", T0, "d", "budget for project zeus moon is 900 euros"), ("5", T0, "e", "something else entirely")]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, agent string, text string")
    got = cl.contested_groups(df, ["ts", "id"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), partition_threshold=0.2, claim_threshold=0.9, conflict_threshold=0.2).collect()
    assert [(r.majority, r.minority) for r in got] == [("a, b", "c, d")]


def test_contested_groups_of_any_size(spark):
    tail = " and so on" * 20
    rows = [(f"{k:02d}", T0, "ab"[k % 2] if k < 30 else "cd"[k % 2], ("budget for project apollo is 100 dollars" if k < 30 else "budget for project zeus moon is 900 euros") + tail) for k in range(50)]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, agent string, text string")
    run = lambda **x: cl.contested_groups(df, ["ts", "id"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), partition_threshold=0.2, claim_threshold=0.9, conflict_threshold=0.2, **x).collect()
    (got,) = run()
    assert (got.majority, got.minority, got.claim) == ("a, b", "c, d", rows[0][3]) and len(got.evidence.split(",")) == 50
    assert sorted(r.evidence for r in run(evidence_rows=True)) == sorted(f"{a}:{i}" for i, _, a, _ in rows)
    assert run(max_rows=40) == []


def test_trust_rerank_moves_corroborated_hits_up(spark):
    rows = [(1, "x", 1, "a", T0, "lone claim words"), (1, "y", 2, "b", T0, "shared fact stands here"), (1, "z", 3, "c", T0, "shared fact stands here")]
    df = spark.createDataFrame(rows, "query_id int, id string, rank int, agent string, ts timestamp_ntz, text string")
    got = cl.trust_rerank(df, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).orderBy("new_rank").collect()
    assert [r.id for r in got] == ["y", "z", "x"] and got[0].status == "corroborated"


def test_compact_ledger_keeps_counts(spark):
    rows = [("1", T0, "entity", "k", "v1", None), ("2", T0 + dt.timedelta(1), "entity", "k", "v2", "1"), ("3", T0, "decision", None, "keep me", None),
            ("4", T0, "fact", None, "old wording of it", None), ("5", T0 + dt.timedelta(1), "fact", None, "new wording", "4"), ("6", T0, "fact", None, "same words here", None), ("7", T0 + dt.timedelta(1), "fact", None, "same words here", None)]
    rows += [(f"s{i:02d}", T0 + dt.timedelta(hours=i), "status", None, "busy", None) for i in range(9)]
    df = spark.createDataFrame([(a, b, c, d, e, e, f) for a, b, c, d, e, f in rows], "id string, ts timestamp_ntz, type string, ekey string, text string, evalue string, supersedes string")
    c = ledger.compact_ledger(df, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    got = sorted((r.section, r.id, r["count"]) for r in c.collect())
    assert got == sorted([("entity", "2", 2), ("decision", "3", 1), ("chain", "5", 2), ("consolidated", "7", 2), ("status_digest", None, 4)] + [("status", f"s{i:02d}", 1) for i in range(4, 9)], key=lambda x: (x[0], x[1] or ""))
    s = ledger.compaction_stats(df, c).first()
    assert (s.before, s.preserved, s.after) == (16, 9, 10)


def test_compaction_stays_inside_a_key_and_keeps_the_order_of_values(spark):
    rows = [("1", 1, "a", "v1", None), ("2", 2, "b", "w1", "1"), ("3", 3, "b", "w2", "2"), ("4", 4, "b", "w3", "3")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(d), "entity", k, v, v, s) for i, d, k, v, s in rows], "id string, ts timestamp_ntz, type string, ekey string, text string, evalue string, supersedes string")
    got = {(r.id, r["count"]) for r in ledger.compact_ledger(df, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {("1", 1), ("4", 3)}
    assert [(r.head, r.position, r.value) for r in ledger.value_history(df).orderBy("position").collect()] == [("4", 1, "w1"), ("4", 2, "w2"), ("4", 3, "w3")]


def test_chain_members_stop_at_cycles(spark):
    df = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "3"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, supersedes string")
    heads = spark.createDataFrame([("4",), ("z",), ("x",)], "id string")
    got = {(r.head, r.id): r.position for r in gr.supersede_chain(df, heads).collect()}
    assert got == {("4", "1"): 1, ("4", "2"): 2, ("4", "3"): 3, ("4", "4"): 4, ("z", "z"): 1, ("x", "x"): 2, ("x", "y"): 1}


def test_alias_cycles_end(spark):
    a = spark.createDataFrame([("a", "b", 1, 1), ("b", "c", 1, 2), ("c", "b", 1, 3), ("d", "e", 1, 4), ("d", "f", 2, 5)], "ekey string, evalue string, ts int, id int")
    k = spark.createDataFrame([("a",), ("d",), ("q",)], "key string")
    assert {r.key: r.target for r in gr.alias_resolve(k, a).collect()} == {"a": "b", "d": "f", "q": "q"}


# Documents -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_chunks_cover_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choices(["word", " ", ". ", "\n", "\n\n", "longerword"], weights=[8, 8, 1, 1, .5, 4], k=900))
    chunks, at = list(dp.chunk_pieces(text, 300, 40)), 0
    for c in chunks:
        assert 0 < len(c) <= 300
        start = text.index(c, max(0, at - 40 - 1)) if at else 0
        assert start <= at
        at = max(at, start + len(c))
    assert at == len(text) and text.endswith(chunks[-1])


def test_chunk_breaks_at_paragraph_then_sentence():
    head = "a" * 75
    assert next(iter(dp.chunk_pieces(head + "\n\n" + "b" * 60, 100, 10))) == head + "\n\n"
    assert next(iter(dp.chunk_pieces(head + ". " + "b" * 60, 100, 10))) == head + ". "
    assert list(dp.chunk_pieces("  \n ", 100, 10)) == [] and list(dp.chunk_pieces("short", 100, 10)) == ["short"]


def test_date_spans_and_deadlines(spark):
    assert [d for _, _, d in dp.date_spans("2026-07-15, 7/15/26; July 15, 2026 and 15 July 2026; 13/45/2020 no")] == ["2026-07-15"] * 4
    doc = "Answer due\n7/15/26\nand later, far away from there in the text, a plain 2027-01-02 date"
    got = [(r.date, r.keyword, r.confidence) for r in dp.deadline_candidates(spark.createDataFrame([(1, doc), (2, None)], "id int, text string"), "text").orderBy("start").collect()]
    assert got == [("2026-07-15", "Answer due", "high"), ("2027-01-02", None, "low")]


def test_near_spans_of_one_date_collapse(spark):
    df = spark.createDataFrame([("seen 2026-07-15 or 7/15/26 and " + "x" * 60 + " 2026-07-15",)], "text string")
    kept = df.select(wn.collapse_near_spans(dp.raw_spans(F.col("text"))).alias("k")).first().k
    assert len(kept) == 2


def test_shrink_stops_at_the_budget():
    out = dp.shrink_pairs({"summary": "x" * 1000, "keywords": "y" * 100, "title": "z" * 50}, 600, ["summary", "keywords"])
    assert sum(len(k) + len(v) for k, v in out.items()) <= 600 and out["title"] == "z" * 50


# Privacy -------------------------------------------------------------------------------------------------------------

def test_deidentify_is_closed_to_unknown_keys(spark):
    df = spark.createDataFrame([(1, "Ann", "secret", [{"order_date": "2020-01-02", "odd": "x", "product": "call 555-123-4567"}])],
                               "id int, name string, weird string, purchase_history array<struct<order_date: string, odd: string, product: string>>")
    r = pr.deidentify_record(df, 2024).first()
    assert r.name == "[NAME-REDACTED]" and r.id == "[ID-REDACTED]" and r.weird is None
    assert r.purchase_history[0].order_date == "2020" and r.purchase_history[0].odd is None and "555" not in r.purchase_history[0].product


def test_maps_are_walked_entry_by_entry(spark):
    schema = "id int, dob string, tags map<string, string>, sizes map<string, int>, inner map<string, struct<email: string, odd: string, note: string>>"
    tags = {"Email": "a@b.co", "visit_date": "2020-05-06", "birth_date": "1920-01-01", "zip": "12345", "age": "93", "odd": "some words", "thing": "MRN-55555", "product": "call 555-123-4567", "empty": None, "customer_id": "7"}
    df = spark.createDataFrame([(1, "1920-01-01", tags, {"qty": 3, "age": 95, "weight": 80}, {"x": ("a@b.co", "words", "seen 2020-01-02"), "y": None}), (2, None, None, {}, None)], schema)
    got = {k + 1: r for k, r in enumerate(pr.deidentify_record(df, 2024, zips=["123"]).orderBy(F.col("dob").isNull()).collect())}
    assert got[1].tags == {"Email": "[EMAIL-REDACTED]", "visit_date": "2020", "birth_date": "REDACTED-90+", "zip": "12300", "age": "90+", "thing": "[MRN-REDACTED]",
                           "product": "call [PHONE-REDACTED]", "empty": None, "customer_id": "[ID-REDACTED]"}
    assert got[1].sizes == {"qty": "3", "age": "90+"} and got[1].inner["x"].asDict() == {"email": "[EMAIL-REDACTED]", "odd": None, "note": "seen 2020"} and got[1].inner["y"] is None
    assert got[1].dropped_keys == ["odd", "weight"] and {"phone", "mrn", "email", "geo_zip", "age_over_89", "dob_year_over_89_suppressed"} <= set(got[1].categories)
    assert (got[2].tags, got[2].sizes, got[2].inner, got[2].dropped_keys) == (None, {}, None, [])


def test_bleeding_money_is_not_an_injury(spark):
    df = spark.createDataFrame([("we are bleeding money",), ("it is bleeding badly",), ("explosion-proof lamp",)], "t string")
    assert [r.matched for r in pr.safety_classify(df, "t").collect()] == [False, True, False]


def test_ascii_word_boundaries(spark):
    df = spark.createDataFrame([("éinjury",), ("injuryé",), ("xinjury",)], "t string")
    assert [r.matched for r in pr.safety_classify(df, "t").collect()] == [True, True, False]


# Order, files, search, seeds -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 7, 64])
def test_bucketed_windows_equal_plain_windows(spark, parts):
    from pyspark.sql import Window
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("o"), (F.col("id") % 11).alias("v")).repartition(parts)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("v").over(w).alias("p"), F.sum("v").over(w).alias("s"), F.row_number().over(w).cast("long").alias("n"))
    got = bucketed_lag(df, ["k"], F.floor(F.col("o") / 40), ["o"], {"p": "v"})
    got = bucketed_running(got, ["k"], F.floor(F.col("o") / 40), ["o"], {"s": F.col("v")})
    got = bucketed_row_number(got, ["k"], F.floor(F.col("o") / 40), ["o"], "n").select("k", "o", "p", "s", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ndjson_and_csv_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"id":"1","ts":"t"}\nbroken\n\n[1]\n"x"\n{"id":"2"}\r\n')
    path = str(tmp_path / "a.ndjson")
    assert sorted(r.id for r in feeds.read_ndjson_lenient(spark, path).collect()) == ["1", "2"]
    good, bad = feeds.read_ndjson_quarantine(spark, path)
    assert sorted(r.raw for r in bad.collect()) == ['"x"', "broken"] and bad.filter(F.col("file_path").endswith("a.ndjson")).count() == 2
    df = spark.createDataFrame([("=cmd", 'say "x", y', 1)], "a string, b string, n int")
    cat.write_csv_safe(df, str(tmp_path / "csv"))
    assert tuple(cat.read_csv_quoted(spark, str(tmp_path / "csv")).first()) == ("'=cmd", 'say "x", y', "1")
    feeds.write_ndjson(df, str(tmp_path / "out"))
    assert feeds.read_feed_glob(spark, str(tmp_path / "out"), df.schema).first() == df.first()
    (tmp_path / "room/_TEXT").mkdir(parents=True)
    (tmp_path / "room/a.txt").write_text("x")
    (tmp_path / "room/_TEXT/a.txt.txt").write_text("x")
    assert [r.path for r in cat.read_documents(spark, str(tmp_path / "room"), "*.txt").select("path").collect()] == ["a.txt"]


@pytest.mark.parametrize("parts", [1, 5])
def test_knn_keeps_ties_in_id_order(spark, parts):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(99, [0.0, 1.0])], "id long, vector array<double>").repartition(parts)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, vector array<double>")
    assert [r.id for r in vs.knn_search(q, c, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_knn_in_blocks_of_queries(spark, monkeypatch):
    q = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "query_id int, vector array<double>")
    c = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(12)], "id int, vector array<double>")
    whole = sorted(map(tuple, vs.knn_search(q, c, 4).collect()))
    monkeypatch.setattr(vs, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vs.knn_search(q, c, 4).collect())) == whole and len(whole) == 36


def test_superseded_rows_are_not_matched(spark):
    t = "alpha beta gamma delta epsilon costs "
    rows = [("1", 1, t + "10", None), ("2", 2, t + "10 zeta", "1"), ("3", 3, t + "10", None), ("4", 4, t + "11", None)]
    df = spark.createDataFrame(rows, "id string, ts int, text string, supersedes string").withColumn("type", F.lit("fact"))
    near = {r.id: r.match_id for r in cl.near_duplicate(df, ["ts"]).collect()}
    assert near["3"] == "2"
    contra = {r.id: r.match_id for r in cl.value_contradiction(df, ["ts"]).collect()}
    assert contra["4"] == "2"


def test_claims_without_confidence_weigh_one(spark):
    df = spark.createDataFrame([("k", "a", 0.0, "assertion", "1"), ("n", "a", 0.0, "assertion", "2")], "k string, agent string, d double, role string, id string")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("confidence", F.when(F.col("k") == "n", float("nan")))
    got = {r.k: r.trust for r in cl.score_claim(df, ["k"], F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {"k": 0.5, "n": 0.5}


def test_years_of_any_length_leave_no_full_date(spark):
    df = spark.createDataFrame([("on 3/15/005 and 3/15/0007, 1-2-000, 4/5/69, 4/5/70 and 6/7/0123",)], "t string")
    assert df.select(pr.scrub_free_text(F.col("t"))["t"].alias("t")).first().t == "on 5 and 7, 0, 2069, 1970 and 123"


def test_aliases_are_followed_to_their_end(spark):
    a = spark.createDataFrame([(f"k{i}", f"k{i + 1}", 1, str(i)) for i in range(20)] + [("a", "b", 1, "x"), ("b", "a", 1, "y")], "ekey string, evalue string, ts int, id string")
    k = spark.createDataFrame([("k0",), ("k15",), ("z",), ("a",)], "key string")
    assert dict(gr.alias_resolve(k, a).collect()) == {"k0": "k20", "k15": "k20", "z": "z", "a": "a"}
    assert dict(gr.alias_resolve(k, a, 8).collect())["k0"] == "k8"


def test_beta_forms(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 4.0, 7.0)], "k string, s double, m double")
    kept, fixed = fn.beta(df, ["k"], "s", "m").first().beta, fn.beta(df, ["k"], "s", "m", True).first().beta
    assert kept == pytest.approx(fixed * 3 / 2)


# Streams -------------------------------------------------------------------------------------------------------------

def events(n=300, seed=5):
    r = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=10 * i + r.randint(0, 9)), f"k{r.choice([0, 0, 0, 1, 2])}", r.random() < 0.5) for i in range(n)]


def fold(rows, step, start):
    state, out = {}, []
    for i, t, k, flag in sorted(rows, key=lambda r: (r[1], r[0])):
        state[k], res = step(state.get(k, start), i, t, flag)
        if res is not None:
            out.append((k, *res))
    return sorted(out)


def as_stream(spark, tmp_path, rows, files=4):
    """Rows cut into files in time order; one micro-batch per file."""
    import time
    schema = "id long, ts timestamp, key string, flag boolean"
    folder = tmp_path / "in"
    size = -(-len(rows) // files)
    for f in range(files):
        part = sorted(rows, key=lambda r: r[1])[f * size:(f + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return runner.stream_files(spark, str(folder), "*.parquet", schema, 1)


def cooldown_step(state, i, t, flag):
    last, n = state
    if last is not None and (t - last).total_seconds() < 6 * 3600:
        return state, None
    return (t, n + 1), (i, n + 1, n + 1 >= 3)


def test_alert_cooldown_over_batches(spark, tmp_path):
    rows = events()
    stream = as_stream(spark, tmp_path, rows)
    got = runner.to_the_end(lambda close: jobs.alert_cooldown(stream, "key", close=close), spark, str(tmp_path / "w"))
    assert sorted((r.key, r.id, r.consecutive, r.escalate) for r in got.collect()) == fold(rows, cooldown_step, (None, 0))


def streak_step(state, i, t, dark):
    streak, sent, last = state
    streak = streak + 1 if dark else 0
    go = dark and streak >= 2 and (last is None or (t - last).total_seconds() >= 6 * 3600)
    sent = sent + go if dark else 0
    return (streak, sent, t if go else last), (i, streak, go, dark and sent >= 3)


def test_dark_streak_over_batches(spark, tmp_path):
    rows = events(200, 8)
    stream = as_stream(spark, tmp_path, rows).withColumnRenamed("flag", "dark")
    got = runner.to_the_end(lambda close: jobs.dark_streak(stream, "key", close=close), spark, str(tmp_path / "w"))
    assert sorted((r.key, r.id, r.streak, r.dispatch, r.escalate) for r in got.collect()) == fold(rows, streak_step, (0, 0, None))


def restart_step(state, i, t, flag):
    last, n, paused = state
    if paused:
        return state, (i, "paused", n)
    if last is not None and (t - last).total_seconds() < 6 * 3600:
        return state, (i, "cooldown", n)
    if n + 1 > 3:
        return (last, n, True), (i, "escalate", n)
    return (t, n + 1, False), (i, "restart", n + 1)


def test_restart_plan_over_batches(spark, tmp_path):
    rows = events(200, 9)
    stream = as_stream(spark, tmp_path, rows)
    got = runner.to_the_end(lambda close: jobs.restart_plan(stream, "key", close=close), spark, str(tmp_path / "w"))
    assert sorted((r.key, r.id, r.plan, r.attempt) for r in got.collect()) == fold(rows, restart_step, (None, 0, False))


def test_aggregates_over_batches_equal_the_batch_form(spark, tmp_path):
    rows = events(240, 4)
    batch = spark.createDataFrame(rows, "id long, ts timestamp, key string, flag boolean")
    stream = as_stream(spark, tmp_path, rows)
    pairs = [(jobs.current_value_stream, ("key", "flag"), ["key"]), (jobs.idempotent_append, ("key", ["flag"]), ["key"]), (jobs.burn_rate_stream, (F.col("flag"), 0.95), ["window_end"])]
    for n, (job, args, keys) in enumerate(pairs):
        got = runner.update_to_table(job(stream, *args), keys, str(tmp_path / f"w{n}"))
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, (lambda b: b.select(*sorted(b.columns)).collect())(job(batch, *args))))


def test_incremental_index_prunes_a_document_that_shrank(spark, tmp_path):
    import time
    schema = "path string, sha256 string, entity string, text string, ts timestamp"
    folder = str(tmp_path / "docs")
    for day, rows in enumerate([[("a", "1", "e", "word " * 900), ("b", "2", "e", "small")], [("a", "3", "e", "short now"), ("b", "2", "e", "small")]]):
        spark.createDataFrame([(*r, T0 + dt.timedelta(days=day)) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    heads, chunks = jobs.incremental_index(runner.stream_files(spark, folder, "*.parquet", schema, 1), str(tmp_path / "index"))
    assert {r.path: (r.sha256, r.chunks, r.version) for r in heads.collect()} == {"a": ("3", 1, 1), "b": ("2", 1, 0)}
    assert sorted(r.chunk for r in chunks.collect()) == ["short now", "small"]


def test_tokens_match_the_definition(spark):
    rows, df = claims(spark, 60, 2)
    assert all(set(r.t) == toks(r.text) for r in df.select("text", tx.tokens(F.col("text")).alias("t")).collect())


def test_value_contradiction_takes_the_first_earlier_row(spark):
    rows = [("1", 0, "budget of apollo is 100 dollars"), ("2", 1, "budget of apollo is 100 dollars"), ("3", 2, "budget of apollo is $9 dollars"),
            ("4", 3, "budget of apollo is 100 dollars"), ("5", 4, "no numbers about apollo"), ("6", 5, "other words 100 entirely")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), "fact", x) for i, h, x in rows], "id string, ts timestamp_ntz, type string, text string")
    got = {r.id: r.match_id for r in cl.value_contradiction(df, ["ts", "id"]).collect()}
    assert got == {"3": "1", "4": "3"}


def test_tagged_conversations_alert_once(spark, tmp_path):
    text = "The aid caught fire and I was injured."
    for k, rows in enumerate([[(1, 0), (2, 0)], [(1, 1), (3, 0)], [(2, 5), (4, 0)]]):
        df = spark.createDataFrame([(c, n, "user", text, dt.datetime(2024, 1, 1 + k)) for c, n in rows], "conv_id long, turn int, role string, text string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runner.stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    alerts, tags = jobs.safety_stream(stream, ["user"], str(tmp_path / "out"))
    assert len(alerts.select("conv_id").collect()) == 4 == alerts.select("conv_id").distinct().count()
    assert {r.conv_id for r in tags.collect()} == {1, 2, 3, 4}
