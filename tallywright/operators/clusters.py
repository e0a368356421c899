"""Near-duplicates, contradictions, leader clusters and claim trust."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.functions.links import follow
from tallywright.functions.ordered import latest_by
from tallywright.functions.similarity import posting_cost, set_id, similar_pairs, similar_sets
from tallywright.operators.graph import supersede_chain
from tallywright.operators.joins import active_rows, supersede_pairs
from tallywright.session import cut_lineage

LOCAL_EDGES = 2_000_000  # similar pairs (80 MB) whose leaders are found in one task, more are by rounds, with the same result
RANGES = 64  # parts of the order of which the earliest are solved first


def _tokenised(rows: DataFrame, scope: Sequence[str], text: str) -> DataFrame:
    """The rows with their tokens and set. Rows without tokens are still among them: a filter here would have Spark cut every text a second time."""
    r = rows.withColumn("tokens", tx.tokens(F.col(text)))
    return r.withColumn("sid", set_id(F.col("tokens"), *[F.col(c) for c in scope]))


def _sets(tokenised: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row for each set of tokens that is not empty, written once; the tokens as 64-bit hashes, which are shorter and enough for a comparison."""
    hashed = tokenised.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))
    return cut_lineage(hashed.groupBy("sid", *keys).agg(F.first("tokens").alias("tokens"), *more).filter(F.size("tokens") > 0))


def _similar(tokenised: DataFrame, threshold: float, scope: Sequence[str]) -> DataFrame:
    """The pairs of similar sets of :func:`_tokenised` rows."""
    sets = _sets(tokenised, scope)
    return similar_sets(sets, sets, threshold, scope, self_join=True)


def _live(rows: DataFrame) -> DataFrame:
    """The rows that may be matched: those that no row supersedes."""
    return active_rows(rows) if "supersedes" in rows.columns else rows


def near_duplicate(rows: DataFrame, order: Sequence[str], text: str = "text", scope: Sequence[str] = ("type",), threshold: float = 0.8, pairs: DataFrame | None = None) -> DataFrame:
    """CL01. For every row the most similar earlier active row of its scope, the earliest among equals; rows without one are left out.

    Of each token set only the first active row can be a match, and a row after it has similarity 1. Distinct sets are compared once,
    unless the caller has their ``pairs`` (of :func:`similar_sets`) at this threshold or below.
    """
    scope = list(scope)
    cut = _tokenised(rows, scope, text)
    # The rows are read by several joins below; writing them once, without their tokens, saves reading and cutting every text again for each.
    r = cut_lineage(cut.select("id", "sid", F.struct(*order).alias("_o"), F.size("tokens").alias("_n"), *scope)).filter("_n > 0")
    first = r.join(_live(rows).select("id"), "id", "left_semi").groupBy("sid").agg(F.min_by(F.struct("id", "_o"), "_o").alias("f"))
    first = cut_lineage(first.select("sid", F.col("f.id").alias("match_id"), F.col("f._o").alias("mo")))
    placed = r.select("id", "sid", "_o").join(first, "sid", "left").withColumn("again", F.coalesce(F.col("mo") < F.col("_o"), F.lit(False)))
    repeats = placed.filter("again").select("id", "match_id", F.lit(1.0).alias("score"))
    pairs = _similar(cut, threshold, scope) if pairs is None else pairs.filter(F.col("score") >= threshold)
    both = pairs.select("left_sid", "right_sid", "score").unionByName(pairs.select(F.col("right_sid").alias("left_sid"), F.col("left_sid").alias("right_sid"), "score"))
    near = both.join(first.withColumnRenamed("sid", "right_sid"), "right_sid").select(F.col("left_sid").alias("sid"), "match_id", "mo", "score")
    met = placed.filter("NOT again").select("id", "sid", "_o").join(near, "sid").filter(F.col("mo") < F.col("_o"))
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "mo", "match_id")).alias("b"))
    return repeats.unionByName(best.select("id", F.col("b.match_id").alias("match_id"), (-F.col("b.s")).alias("score")))


def value_contradiction(rows: DataFrame, order: Sequence[str], text: str = "text", scope: Sequence[str] = ("type",), threshold: float = 0.6, pairs: DataFrame | None = None) -> DataFrame:
    """CL02. For every row the first earlier active row of its scope with similar words and different numbers.

    Rows are collapsed to distinct (tokens, numbers); for each such key the earliest contradicting key with an active row is found once
    and then compared with the row's own position. ``pairs`` as in CL01.
    """
    scope = list(scope)
    cut, vals = _tokenised(rows, scope, text), tx.value_tokens(F.col(text))
    r = cut.withColumn("vals", vals).select("id", set_id(F.col("vals"), F.col("sid")).alias("kid"), "sid", "vals", F.struct(*order).alias("_o"), F.size("tokens").alias("_n"), *scope)
    r = cut_lineage(r).filter((F.size("vals") > 0) & (F.col("_n") > 0))
    live = r.join(_live(rows).select("id"), "id", "left_semi").groupBy("kid").agg(F.min_by(F.struct("id", "sid", "vals", "_o"), "_o").alias("f")).select(
        "kid", F.col("f.id").alias("first_id"), F.col("f.sid").alias("sid"), F.col("f.vals").alias("vals"), F.col("f._o").alias("first_o"))
    keys = r.groupBy("kid", "sid").agg(F.min("vals").alias("vals"))
    pairs = _similar(cut.filter(F.size(vals) > 0), threshold, scope) if pairs is None else pairs.filter(F.col("score") >= threshold)
    # Equal token sets with other numbers contradict too. Per token set only its two earliest number keys can be first.
    both = pairs.select("left_sid", "right_sid", "score").unionByName(pairs.select(F.col("right_sid").alias("left_sid"), F.col("left_sid").alias("right_sid"), "score"))
    both = both.unionByName(r.select(F.col("sid").alias("left_sid"), F.col("sid").alias("right_sid"), F.lit(1.0).alias("score")).distinct())
    early = live.withColumn("_r", F.row_number().over(Window.partitionBy("sid").orderBy("first_o"))).filter("_r <= 2").drop("_r")
    other = early.select(F.col("sid").alias("right_sid"), F.col("kid").alias("okid"), F.col("first_id").alias("oid"), F.col("vals").alias("ovals"), F.col("first_o").alias("oo"))
    met = keys.select(F.col("sid").alias("left_sid"), "kid", "vals").join(both, "left_sid").join(other, "right_sid").filter(F.col("vals") != F.col("ovals"))
    first = met.groupBy("kid").agg(F.min_by(F.struct("oid", "score", "oo"), "oo").alias("m"))
    return r.select("id", "kid", "_o").join(first, "kid").filter(F.col("m.oo") < F.col("_o")).select(
        "id", F.col("m.oid").alias("match_id"), F.col("m.score").alias("subject_score"))


def write_advisory(rows: DataFrame, order: Sequence[str], text: str = "text", scope: Sequence[str] = ("type",)) -> DataFrame:
    """CL03. Per row: a contradiction first, else a near-duplicate, else nothing. Token sets are compared once for both."""
    pairs = cut_lineage(_similar(_tokenised(rows, scope, text), 0.6, scope))
    c = value_contradiction(rows, order, text, scope, 0.6, pairs).select("id", F.col("match_id").alias("_c"))
    d = near_duplicate(rows, order, text, scope, 0.8, pairs).select("id", F.col("match_id").alias("_d"), "score")
    j = rows.select("id").join(c, "id", "left").join(d, "id", "left")
    return j.select("id", F.when(F.col("_c").isNotNull(), "contradiction").when(F.col("_d").isNotNull(), "near_duplicate").otherwise("none").alias("advice"),
                    F.coalesce("_c", "_d").alias("match_id"), F.when(F.col("_c").isNull(), F.round(F.col("score") * 100).cast("long")).alias("similarity_pct"))


def _covered(edges: DataFrame) -> DataFrame:
    """The sets that an earlier leader is similar to, of a bounded number of (early, late), in one task."""
    def solve(parts):
        found = [p for p in parts if p.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        n = rows.num_rows
        codes = pa.concat_arrays([*rows["early"].chunks, *rows["late"].chunks]).dictionary_encode()
        ids, at = codes.dictionary, codes.indices.to_numpy()
        early, late, state = at[:n], at[n:], np.zeros(len(ids), np.int8)  # 1 leads, 2 is covered
        while len(early):
            new = state == 0
            new[late] = False
            state[new] = 1
            hit = late[state[early] == 1]
            state[hit] = 2
            open_ = (state[early] == 0) & (state[late] == 0)
            early, late = early[open_], late[open_]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(state == 2)))], ["sid"])

    return edges.coalesce(1).mapInArrow(solve, "sid binary")


def _greedy_leaders(sets: DataFrame, threshold: float, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(leaders among ``sets``, similar pairs as early and late): a set leads unless an earlier leader is similar.

    Rounds over the similarity graph: an undecided set without an undecided earlier neighbour leads, and its later
    neighbours are covered. Every round decides at least the earliest undecided set of each connected part.
    """
    pairs = similar_sets(sets, sets, threshold, scope, self_join=True)
    pos = sets.select("sid", "pos")
    e = pairs.join(pos.select(F.col("sid").alias("left_sid"), F.col("pos").alias("lp")), "left_sid").join(
        pos.select(F.col("sid").alias("right_sid"), F.col("pos").alias("rp")), "right_sid")
    left_first = F.col("lp") < F.col("rp")
    every = cut_lineage(e.select(F.when(left_first, F.col("left_sid")).otherwise(F.col("right_sid")).alias("early"),
                                 F.when(left_first, F.col("right_sid")).otherwise(F.col("left_sid")).alias("late")))
    if every.count() <= LOCAL_EDGES:
        return sets.select("sid").join(_covered(every), "sid", "left_anti"), every
    undecided, leaders, edges = sets.select("sid"), sets.select("sid").limit(0), every
    while True:
        new = cut_lineage(undecided.join(edges.select(F.col("late").alias("sid")).distinct(), "sid", "left_anti"))
        leaders = leaders.unionByName(new)
        covered = edges.join(new.withColumnRenamed("sid", "early"), "early", "left_semi").select(F.col("late").alias("sid")).distinct()
        undecided = cut_lineage(undecided.join(new, "sid", "left_anti").join(covered, "sid", "left_anti"))
        if undecided.isEmpty():
            return leaders, every
        edges = cut_lineage(edges.join(undecided.withColumnRenamed("sid", "early"), "early", "left_semi").join(
            undecided.withColumnRenamed("sid", "late"), "late", "left_semi"))


def leader_clusters(rows: DataFrame, order: Sequence[str], text: str = "text", scope: Sequence[str] = ("agent",), threshold: float = 0.5,
                    pair_budget: float = 5e9) -> DataFrame:
    """CL04. Greedy clusters in ``order``: a row joins the earliest cluster whose first row is similar enough, else it opens one.

    Returns the rows with ``leader_id``. Rows without tokens are never similar to anything and lead themselves. When the
    candidate bound, and 250 times the similar pairs that a sample lets expect, exceed ``pair_budget``, an early part of the order is solved first and everything similar to its
    leaders stops being a candidate leader, so a dense group is settled by its first members and not by all its pairs.
    """
    scope = list(scope)
    r = _tokenised(rows, scope, text)
    first = F.min_by(F.struct("id", *scope, F.struct(*order).alias("_o")), F.struct(*order)).alias("f")
    sets = _sets(r, (), first).select("sid", *[F.col(f"f.{c}").alias(c) for c in scope], "tokens", F.col("f.id").alias("first_id"), F.col("f._o").alias("pos"))
    pending, leaders, first_round, whole = sets, sets.select("sid").limit(0), True, False
    while True:
        cost = posting_cost(pending, scope).first()["cost"]
        if cost > pair_budget:
            cost = min(cost, 250 * similar_pairs(pending, threshold, scope))
        share = min(1.0, (pair_budget / cost) ** 0.5) if cost > 0 else 1.0
        head = pending
        if share < 1.0:
            # The earliest part of the order, whatever its columns are: as many of its ranges as the share allows, one at least.
            parts = cut_lineage(pending.repartitionByRange(RANGES, "pos").withColumn("_range", F.spark_partition_id()))
            sizes = sorted(parts.groupBy("_range").count().collect())
            upto, room = 0, share * sum(n for _, n in sizes) - sizes[0][1]
            while upto + 1 < len(sizes) and sizes[upto + 1][1] <= room:
                upto, room = upto + 1, room - sizes[upto + 1][1]
            pending = parts.drop("_range")
            head = parts.filter(F.col("_range") <= sizes[upto][0]).drop("_range")
        new, similar = _greedy_leaders(head, threshold, scope)
        new = cut_lineage(new)
        whole = share >= 1.0 and first_round
        first_round = False
        leaders = cut_lineage(leaders.unionByName(new))
        if share >= 1.0:
            break
        rest = pending.join(head.select("sid"), "sid", "left_anti")
        near = similar_sets(rest, head.join(new, "sid", "left_semi"), threshold, scope).select(F.col("left_sid").alias("sid")).distinct()
        pending = cut_lineage(rest.join(near, "sid", "left_anti"))
        if pending.isEmpty():
            break
    led = sets.join(leaders, "sid", "left_semi")
    # When everything was solved at once, the pairs at hand already name every similar leader.
    near = similar.select(F.col("late").alias("left_sid"), F.col("early").alias("right_sid")) if whole else similar_sets(sets, led, threshold, scope).select("left_sid", "right_sid")
    hits = near.join(
        led.select(F.col("sid").alias("right_sid"), F.col("first_id").alias("leader_id"), F.col("pos").alias("lp")), "right_sid")
    own = led.select(F.col("sid").alias("left_sid"), F.col("first_id").alias("leader_id"), F.col("pos").alias("lp"))
    pos = sets.select(F.col("sid").alias("left_sid"), F.col("pos").alias("_p"))
    hits = hits.select("left_sid", "leader_id", "lp").unionByName(own).join(pos, "left_sid").filter(F.col("lp") <= F.col("_p"))
    of = hits.groupBy("left_sid").agg(F.min_by("leader_id", "lp").alias("leader_id")).withColumnRenamed("left_sid", "sid")
    of = of.select("sid", F.col("leader_id").alias("_leader"), F.lit(True).alias("_led"))
    return r.drop("tokens").join(of, "sid", "left").withColumn("leader_id", F.when(F.col("_led"), F.col("_leader")).otherwise(F.col("id"))).drop("sid", "_leader", "_led")


def subject_partitions(clustered: DataFrame, max_rows: int | None = 40) -> DataFrame:
    """CL05. Clusters with their size: ``kept`` for 2 to ``max_rows`` rows (None: any), ``oversized`` and ``single`` are reported, not lost."""
    n = clustered.groupBy("leader_id").agg(F.count("*").alias("size"))
    return clustered.join(n, "leader_id").withColumn("subject", F.concat(F.lit("cluster-"), "leader_id")).withColumn(
        "outcome", F.when(F.col("size") < 2, "single").when(F.col("size") > max_rows if max_rows is not None else F.lit(False), "oversized").otherwise("kept"))


def group_assertions(clustered: DataFrame, subject: Sequence[str], order: Sequence[str]) -> DataFrame:
    """CL06. Inside a subject the largest cluster is the claim, the earliest among equals; rows of the others contradict it."""
    subject = list(subject)
    n = clustered.groupBy(*subject, "leader_id").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_f"))
    # Among equal sizes the earliest cluster is the claim: largest size first, then smallest first position.
    big = n.groupBy(*subject).agg(F.max("_n").alias("_n"))
    win = n.join(big, [*subject, "_n"]).groupBy(*subject).agg(F.min_by("leader_id", "_f").alias("claim_id"))
    return clustered.join(win, subject).withColumn("role", F.when(F.col("leader_id") == F.col("claim_id"), "assertion").otherwise("contradiction"))


def confidence(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.lit(1.0))


def score_claim(assertions: DataFrame, keys: Sequence[str], now: Column, half_life_days: float = 30.0, durable: int = 3,
                penalty: float = 0.6, ceiling: float = 0.55) -> DataFrame:
    """CL07. Trust and status per claim from rows with (keys, agent, ts, confidence 0..1, role, id).

    The newest row per agent and role counts. Both steps combine before their shuffle, so a claim of any size is spread.
    """
    rows = assertions.select(*keys, "role", "agent", "ts", "confidence", "id")
    one = latest_by(rows.filter(F.col("agent").isNotNull()), [*keys, "role", "agent"], ["ts", "id"])
    age_days = F.greatest((F.unix_micros(now.cast("timestamp")) - F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))) / 8.64e10, F.lit(0.0))
    c = F.col("confidence")
    c = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1.0).otherwise(c)
    w = c * F.pow(F.lit(0.5), age_days / half_life_days)
    yes = F.col("role") == "assertion"
    g = one.groupBy(*keys).agg(
        F.count_if(yes).alias("distinct_agents"), F.count_if(~yes).alias("contradicting_agents"),
        F.coalesce(F.sum(F.when(yes, w).otherwise(0.0)), F.lit(0.0)).alias("_w"), F.coalesce(F.sum(F.when(~yes, w).otherwise(0.0)), F.lit(0.0)).alias("_c"),
        F.max(F.when(yes, F.col("ts"))).alias("_newest"))
    n = assertions.groupBy(*keys).agg(F.count_if(yes).alias("corroborations"))
    g = g.join(n, list(keys)).withColumn("trust", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(F.lit(0.5), F.col("_w")) - penalty * F.col("_c"))))
    contested = (F.col("contradicting_agents") > 0) & ((F.col("contradicting_agents") >= F.col("distinct_agents")) | (F.col("trust") <= ceiling))
    status = F.when(contested, "contested").when(F.col("distinct_agents") >= durable, "durable").when(F.col("distinct_agents") >= 2, "corroborated").otherwise("unverified")
    age = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_newest").cast("timestamp"))) / 8.64e10).cast("long")
    return g.withColumn("status", status).withColumn("newest_age_days", age).drop("_w", "_c", "_newest")


def promotion(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    """CL08. Durable claims above the threshold are recommended."""
    up = (F.col("status") == "durable") & (F.col("trust") >= threshold)
    return scored.withColumn("promote", up).withColumn("to_status", F.when(up, "semantic/durable").otherwise(F.col("status")))


def contested_groups(rows: DataFrame, order: Sequence[str], now: Column, partition_threshold: float = 0.35, claim_threshold: float = 0.5,
                     conflict_threshold: float = 0.4, max_rows: int | None = None, claim_chars: int | None = None, evidence_rows: bool = False) -> DataFrame:
    """CL09. Subjects whose claim is contested by rows with similar words and other numbers.

    Rows come filtered by the deny rules. The published definition leaves out subjects of more than ``max_rows`` = 40 rows and cuts
    claims to ``claim_chars`` = 140 characters. ``evidence`` is one list per subject, or with ``evidence_rows`` one row per assertion
    or contradiction, which no size of a subject makes long.
    """
    parts = subject_partitions(leader_clusters(rows, order, scope=(), threshold=partition_threshold), max_rows).filter("outcome = 'kept'")
    # Written once: what follows reads it some ten times, and most subjects of one row are gone by now.
    parts = cut_lineage(parts.drop("leader_id", "size", "outcome"))
    g = group_assertions(leader_clusters(parts, order, scope=("subject",), threshold=claim_threshold), ["subject"], order)
    g = cut_lineage(g.withColumn("confidence", F.lit(1.0)))
    scored = score_claim(g, ["subject"], now).filter("status = 'contested'")
    claim = g.filter("id = claim_id").select("subject", F.col("text").alias("claim_text"))
    c = g.filter("role = 'contradiction'").join(claim, "subject")
    va, vb = tx.value_tokens(F.col("claim_text")), tx.value_tokens(F.col("text"))
    real = (F.size(va) > 0) & (F.size(vb) > 0) & (va != vb) & (tx.jaccard(tx.tokens(F.col("claim_text")), tx.tokens(F.col("text"))) >= conflict_threshold)
    genuine = c.filter(real).select("subject").distinct()
    facts = g.groupBy("subject").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "assertion", F.col("agent")))), ", ").alias("majority"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "assertion", F.col("agent")))), ", ").alias("minority"))
    one = F.concat_ws(":", "agent", "id")
    evidence = g.select("subject", one.alias("evidence")) if evidence_rows else g.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("evidence"))
    facts = facts.join(evidence, "subject")
    text = F.col("claim_text") if claim_chars is None else tx.clip(F.col("claim_text"), claim_chars)
    return scored.join(genuine, "subject", "left_semi").join(facts, "subject").join(claim, "subject").select(
        "subject", text.alias("claim"), "majority", "minority", "evidence", "trust", "distinct_agents", "contradicting_agents")


TRUST_RANK = {"durable": 0, "corroborated": 1, "unverified": 2, "contested": 3}


def trust_rerank(hits: DataFrame, now: Column, query: str = "query_id", position: str = "rank") -> DataFrame:
    """CL10. Hits of each query clustered, scored and stably ordered by trust. Hits are a top-k, so a query's list is short."""
    c = leader_clusters(hits, [position], scope=(query,), threshold=0.5)
    c = cut_lineage(c.withColumn("role", F.lit("assertion")).withColumn("confidence", F.lit(1.0)))
    s = score_claim(c, [query, "leader_id"], now).select(query, "leader_id", "status", "trust", "distinct_agents")
    m = F.create_map(*[F.lit(x) for kv in TRUST_RANK.items() for x in kv])
    j = c.join(s, [query, "leader_id"]).withColumn("_t", F.coalesce(F.element_at(m, F.col("status")), F.lit(2)))
    return j.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy("_t", position))).drop("_t", "role", "confidence")


def memory_diff(rows: DataFrame, since: Column, now: Column) -> DataFrame:
    """CL12. added, changed, retired or still_true per row for a window of time; a row that is none of these is left out.

    A changed row has the oldest row of its chain, ``was``, and its own place in the chain from 1; :func:`memory_diff_chains` lists the rows between.
    """
    ids = rows.select(F.col("id").alias("_oid"))
    r = rows.join(ids, F.col("supersedes") == F.col("_oid"), "left")
    nxt = rows.filter(F.col("supersedes").isNotNull()).groupBy("supersedes").agg(F.max_by(F.struct("id", "ts"), F.struct("ts", "id")).alias("_n"))
    r = r.join(nxt.withColumnRenamed("supersedes", "_s"), F.col("id") == F.col("_s"), "left")
    inside = lambda c: F.coalesce((c >= since) & (c <= now), F.lit(False))
    here, gone = inside(F.col("ts")), F.col("_n").isNotNull()
    state = (F.when(F.col("_oid").isNotNull() & here, "changed").when(gone & inside(F.col("_n.ts")) & ~here, "retired")
             .when(here, "added").when(~here & ~gone, "still_true"))
    r = r.withColumn("state", state).filter("state IS NOT NULL").withColumn("retired_by", F.when(F.col("state") == "retired", F.col("_n.id")))
    back = rows.filter(F.col("supersedes") != F.col("id")).join(ids, F.col("supersedes") == F.col("_oid"), "left_semi").groupBy(F.col("id").alias("src")).agg(F.min("supersedes").alias("dst"))
    way = follow(back).select(F.col("src").alias("_w"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
    r = r.join(way, F.col("id") == F.col("_w"), "left")
    changed = F.col("state") == "changed"
    return r.withColumn("was", F.when(changed, F.coalesce("_end", "id"))).withColumn("place", F.when(changed, F.coalesce("_steps", F.lit(0)) + 1)).drop("_oid", "_s", "_n", "_w", "_end", "_steps")


def memory_diff_chains(rows: DataFrame, diff: DataFrame) -> DataFrame:
    """CL12. (head, id, position, chain_length): the rows, oldest first, behind every changed row of ``diff`` that nothing supersedes. A chain stands once, not once for each of its rows."""
    newest = diff.filter("state = 'changed'").join(rows.select(F.col("supersedes").alias("_s")).filter("_s IS NOT NULL").distinct(), F.col("id") == F.col("_s"), "left_anti")
    return supersede_chain(rows, newest.select("id"))


def recurring_clusters(clustered: DataFrame, private_agents: Sequence[str] = (), at_least: int = 2) -> DataFrame:
    """CL13. Clusters per agent with their size."""
    c = clustered.filter(~F.lower("agent").isin(*private_agents)) if private_agents else clustered
    g = c.groupBy(F.lower("agent").alias("agent"), "leader_id").agg(F.count("*").alias("count"))
    return g.withColumn("recurring", F.col("count") >= at_least)


def hard_negative_pairs(rows: DataFrame, denied_agents: Sequence[str], denied_words: Sequence[str], chatter: str, low: float = 0.03, high: float = 0.55) -> DataFrame:
    """CL14. Supersede pairs with the reason each is kept or rejected."""
    p = supersede_pairs(rows)
    j = tx.jaccard(tx.tokens(F.col("old_text")), tx.tokens(F.col("new_text")))
    ok_agent = lambda a: (F.coalesce(a, F.lit("")) != "") & ~a.isin(*denied_agents)
    p = p.withColumn("jaccard", j)
    reason = (F.when(~(ok_agent(F.col("old_agent")) & ok_agent(F.col("new_agent"))), "unsafe_agent")
              .when(F.lower("new_type").isin(*fixed.EXHAUST_TYPES), "exhaust_type")
              .when(tx.deny(F.col("old_text"), list(denied_words)) | tx.deny(F.col("new_text"), list(denied_words)), "denied_content")
              .when(tx.matches(F.col("old_text"), chatter, True) & tx.matches(F.col("new_text"), chatter, True), "progress_chatter")
              .when(F.col("jaccard") > high, "near_duplicate").when(F.col("jaccard") < low, "unrelated").otherwise("eligible"))
    return p.select("old_id", "new_id", "jaccard", reason.alias("reason"))
