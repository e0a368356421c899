"""What the findings of round 3 asked for: bounds and results on rows that show the fault when small."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.functions import similarity, text as tx
from tallywright.operators import privacy as pr
from tallywright.operators.ledger import compact_ledger
from tallywright.streaming import jobs, stateful


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def long_texts(seed, n=150):
    """Sets of 20 to 120 tokens of a small vocabulary, half of them near copies of earlier ones, in two scopes and none."""
    rng, made = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    for k in range(n):
        if made and rng.random() < 0.5:
            old = list(rng.choice(made)[1])
            t = set(rng.sample(old, max(1, len(old) * rng.randrange(40, 101) // 100))) | set(rng.sample(words, rng.randrange(0, 20)))
        else:
            t = set(rng.sample(words, rng.randrange(20, 120)))
        made.append((rng.choice(["a", "a", "b", None]), sorted(t)))
    return list({(s, tuple(t)): (s, t) for s, t in made}.values())


def as_sets(spark, rows):
    return spark.createDataFrame(rows, "scope string, tokens array<string>").withColumn("sid", similarity.set_id(F.col("tokens"), F.coalesce("scope", F.lit("none"))))


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.6])
def test_long_texts_meet_by_signatures(spark, threshold, monkeypatch):
    """pairs that postings bring together and that are not similar are written nowhere."""
    monkeypatch.setattr(similarity, "SIDE", 40)
    monkeypatch.setattr(similarity, "STRIP", 16)
    monkeypatch.setattr(similarity, "near_postings", None)  # the way over postings is not taken
    rows, more = long_texts(1), long_texts(2, 60)
    sets, others = as_sets(spark, rows).cache(), as_sets(spark, more).cache()
    ids = lambda d: {(r.scope, tuple(r.tokens)): bytes(r.sid) for r in d.collect()}
    ids_s, ids_o = ids(sets), ids(others)
    key = lambda r: (r[0], tuple(r[1]))
    got = {(frozenset((bytes(r.left_sid), bytes(r.right_sid))), r.score) for r in similarity.similar_sets(sets, sets, threshold, ["scope"], self_join=True).collect()}
    want = {(frozenset((ids_s[key(a)], ids_s[key(b)])), jaccard(a[1], b[1])) for i, a in enumerate(rows) for b in rows[:i] if a[0] is not None and a[0] == b[0] and jaccard(a[1], b[1]) >= threshold}
    assert got == want and want
    assert similarity.similar_sets(sets, sets, threshold, ["scope"], self_join=True).count() == len(want)
    got = sorted((bytes(r.left_sid), bytes(r.right_sid), r.score) for r in similarity.similar_sets(sets, others, threshold, ["scope"]).collect())
    assert got == sorted((ids_s[key(a)], ids_o[key(b)], jaccard(a[1], b[1])) for a in rows for b in more if a[0] is not None and a[0] == b[0] and jaccard(a[1], b[1]) >= threshold)
    # Without a scope every set may meet every other; few pairs that are not similar pass the signatures.
    plain = sets.dropDuplicates(["sid"]).select("sid", "tokens")
    true = similarity.similar_sets(plain, plain, threshold, self_join=True).count()
    assert len(similarity.near_signatures(plain, plain, threshold, [], True).collect()) <= true + len(rows)


def test_short_texts_meet_by_postings(spark, monkeypatch):
    monkeypatch.setattr(similarity, "near_signatures", None)
    sets = spark.range(400).select(F.array(*[F.concat(F.lit(p), (F.col("id") * m % 41).cast("string")) for p, m in (("x", 1), ("y", 7), ("z", 3))]).alias("tokens")).distinct().withColumn("sid", similarity.set_id(F.col("tokens")))
    assert similarity.similar_sets(sets, sets, 0.5, self_join=True).count() == 0
    assert similarity.similar_sets(sets, sets, 0.3, self_join=True).count() == 0


ODD = [None, "", "no sign at all", "1-URGENT", "seen 2-Jan-24, 3-February-1999 and 4-Mar-0005", "1-2-24 12-31-99 9-9-0099 1-1-00", "1/2/24 and 03/04/0101", "born 2020-01-05", "on May 5, 2021 or jan. 7 1999",
       "call 555-123-4567 ext. 9, 5551234567 or (555)\n123 4567", "123-45-6789 123456789", "at 12\nMain St, Unit 4", "12 Old Oak Road Apt 5, Salt Lake", "see https://a.b/c?d=1-2-2024", "Dr. Ann Lee and Patient Bo", "10.0.0.1 1.2.3",
       "a@b.org b@c.de", "0-0-0 1-a-1 1-abc-x", "Mr. John Roe, mail j@x.org, seen 2020-01-03, 7/8/2009 at 5 High Street"]


def test_scrub_steps_are_few_and_skip_nothing(spark):
    """F26 pr03_deidentify_record: a text without a sign costs one look, and the rules of a step go over a text together; results are those of every rule in turn."""
    d = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    plain = d.withColumn("s", F.coalesce("t", F.lit(""))).withColumn("c", F.array().cast("array<string>"))
    for category, _, rules in pr._scrub_steps():
        for pattern, to in rules:
            plain = plain.withColumn("n", tx.replace_all(F.col("s"), pattern, to)).withColumn("c", F.when(F.col("n") != F.col("s"), F.array_append("c", F.lit(category))).otherwise(F.col("c"))).withColumn("s", F.col("n")).drop("n").localCheckpoint()
    want = {r.k: (r.s, r.c) for r in plain.select("k", "s", F.array_sort(F.array_distinct("c")).alias("c")).collect()}
    got = {r.k: (r.t, r.categories) for r in pr.scrub_table(d, "t").collect()}
    assert got == want and sum(bool(c) for _, c in got.values()) > 10
    made = d.select(pr.scrub_free_text(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert made.count("transform(") <= 2 * len(pr._scrub_steps()) + 1


@pytest.mark.parametrize("n", [0, 7])
def test_report_works_records_out_once(spark, tmp_path, n):
    """F28 pr06_deid_report: one pass over the records; no filter that works them out again."""
    spark.range(n).select((F.col("id") + 86).cast("int").alias("age"), F.lit("words").alias("reference"), F.lit("a@b.org").alias("email")).write.parquet(str(tmp_path / "r"))
    report = pr.deid_report(pr.deidentify_record(spark.read.parquet(str(tmp_path / "r")), 2024))
    assert report.columns == ["name", "records", "kind"]
    want = {("records_processed", n, "total")}
    if n:
        want |= {("email", n, "category"), ("age_over_89", 3, "category"), (pr.UNCLASSIFIED, n, "category"), ("reference", n, "dropped_key")}
    assert {tuple(r) for r in report.collect()} == want
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Filter" not in plan


class Store:
    """State and timers of one key, and the number of times they are used."""

    def __init__(self):
        self.value, self.slots, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, *_):
        return type("V", (), {"get": lambda _: self.used(self.value), "exists": lambda _: self.used(self.value is not None), "clear": lambda _: self.put(None), "update": lambda _, v: self.put(v)})()

    def getMapState(self, *_):
        return type("M", (), {"getValue": lambda _, k: self.used(self.slots.get(k)), "updateValue": lambda _, k, v: self.used(self.slots.__setitem__(k, v)), "removeKey": lambda _, k: self.used(self.slots.pop(k)),
                              "keys": lambda _: self.used(iter(list(self.slots)))})()

    def put(self, v):
        self.calls, self.value = self.calls + 1, v

    def used(self, v):
        self.calls += 1
        return v

    def registerTimer(self, at):
        self.timers.add(self.used(at))

    def deleteTimer(self, at):
        self.timers.discard(self.used(at))

    def run(self, work, batches, late_us):
        """Rows out, by micro-batches of (ts us, id, value); timers fire up to the watermark after each batch and at the end."""
        work.init(self)
        out, mark = [], 0
        for batch in [*batches, None]:
            if batch is not None and (batch := [r for r in batch if r[0] > 1000 * mark]):
                f = pd.DataFrame(batch, columns=["ts", "id", "value"])
                list(work.handleInputRows(("k",), iter([f.assign(ts=pd.to_datetime(f["ts"], unit="us"))]), None))
            mark = max([mark, *((r[0] - late_us) // 1000 for r in batch)]) if batch is not None else 10 ** 15
            for at in sorted(t for t in self.timers if t <= mark):
                for d in work.handleExpiredTimer(("k",), type("T", (), {"getCurrentWatermarkInMs": lambda _: mark})(), type("E", (), {"getExpiryTimeInMs": lambda _: at})()):
                    out += d.values.tolist()
                self.timers.discard(at)
        return out


@pytest.mark.parametrize("near", [0, 7, 4096])
def test_rows_wait_together_or_slot_by_slot(near, monkeypatch):
    """F23 st05_alert_cooldown: the same rows in the same order however many wait together, over batches that overlap, and with a key that starts anew."""
    monkeypatch.setattr(stateful, "NEAR", near)
    minute = 60_000_000
    for seed in range(20):
        rng = random.Random(seed)
        rows = [(t * minute + rng.randrange(minute), n, rng.random() < 0.5) for n, t in enumerate(sorted(rng.randrange(6000) for _ in range(200)))]
        rows = [(t + (9 * 24 * 60 * minute if n > 150 else 0), n, v) for t, n, v in rows]
        dealt = sorted(rows, key=lambda r: r[0] + rng.randrange(100 * minute))
        cuts = sorted(rng.sample(range(200), 5))
        batches = [dealt[a:b] for a, b in zip([0, *cuts], [*cuts, 200])]
        step, start = jobs.streak_step(360 * minute, 2, 3), (0, 0, jobs.NEVER)
        work = stateful.InOrder(step, start, "streak long, sent long, last long", "long", ["key_", "id", "ts", "streak", "go", "up"], 3_600_000, 3 * 86_400_000)
        store = Store()
        got = store.run(work, batches, 100 * minute)
        state, seen, want = start, None, []
        for ts, n, v in sorted(rows):
            state = start if seen is not None and ts - seen > 3 * 86_400_000_000 else state
            seen = ts
            state, o = step(state, ts, v)
            want.append(["k", n, pd.Timestamp(ts, unit="us"), *o])
        assert got == want
        assert store.value is None and not store.slots and not store.timers


def test_a_key_costs_few_calls():
    """F23 st05_alert_cooldown: 200 rows of a key in 200 slots; the store is called some times and not for each row."""
    work = stateful.InOrder(jobs.cooldown_step(86_400_000_000, 3), (jobs.NEVER, 0), "last long, n long", "long", ["key_", "id", "ts", "n", "up"], 3_600_000, 30 * 86_400_000)
    store = Store()
    got = store.run(work, [[(n * 3_600_000_000, n, None) for n in range(1, 201)]], 3_600_000_000)
    assert [r[1] for r in got] == list(range(1, 201, 24)) and store.calls < 20


def test_compaction_reads_the_ledger_once(spark):
    """F29 cl11_compact_ledger: an id is worked out once for each row, whatever the number of sections and rounds that need it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(n):
        seen.add(1)
        return f"r{n:03d}"

    kinds = F.element_at(F.array(*[F.lit(k) for k in ("entity", "fact", "status", "correction", "decision")]), (F.col("n") % 5 + 1).cast("int"))
    rows = spark.range(60).select(F.col("id").alias("n")).repartition(3, "n").select(
        name("n").alias("id"), F.expr("timestamp '2024-01-01' + make_dt_interval(n)").alias("ts"), kinds.alias("type"), F.concat(F.lit("k"), F.col("n") % 2).alias("ekey"),
        F.concat(F.lit("some words of row "), F.col("n") % 7).alias("text"), F.when((F.col("n") % 5).isin(0, 3) & (F.col("n") >= 10), F.format_string("r%03d", F.col("n") - 10)).alias("supersedes"))
    got = compact_ledger(rows, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()
    assert seen.value == 60
    assert {(r.id, r["count"], r.note) for r in got if r.section == "entity"} == {("r055", 6, "superseded 5 earlier value(s) from id=r005"), ("r050", 6, "superseded 5 earlier value(s) from id=r000")}
    assert sum(r["count"] for r in got) == 60
