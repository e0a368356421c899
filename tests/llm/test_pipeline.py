"""run() against the stages done by hand on a small table."""
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallywright.llm.queries import QUERIES, tokenizer
from tests.llm.test_pairs import edit, joined

EN = "the of and to in that was for with his they this from have not which her she you had are but were been their one all would there".split()
DE = "der die und das nicht ein ist von mit sich auch auf für als dem eine werden noch wie bei einer nach über wenn aber wird sind aus".split()


def corpus(rng):
    say = lambda words, n: " ".join(rng.choice(words) + (str(rng.randrange(90)) if rng.random() < 0.3 else "") for _ in range(n))
    items = [say(EN, 14) + ". " + say(EN, 8) + "." for _ in range(6)]
    docs = []
    for k in range(140):
        words, lang = (EN, "en") if k % 3 else (DE, "de")
        lines = [say(words, rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
        docs.append([lines, lang])
    for k in range(140):
        lines, lang = docs[rng.randrange(140)]
        lines = list(lines)
        kind = rng.randrange(5)
        if kind == 0:
            lines = [x.replace("a", "o", 1) for x in lines]
        elif kind == 1:
            lines = [" ".join(lines) + " " + say(EN, 1)]
        elif kind == 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(items))
        docs.append([lines, lang])
    docs.append([["1234 5678 !!! ???"], "en"])
    return [(k, "\n".join(lines), lang, f"src{k % 4}", len("\n".join(lines))) for k, (lines, lang) in enumerate(docs)], list(enumerate(items))


def by_hand(docs, items):
    texts = {k: t for k, t, *_ in docs if re.search(r"[^\W\d]", t)}
    # Lines.
    places = [(d, n, x) for d, t in sorted(texts.items()) for n, x in enumerate(t.split("\n")) if x.strip()]
    links = [(a, b) for a in range(len(places)) for b in range(a) if places[a][2] == places[b][2] or min(len(places[a][2]), len(places[b][2])) >= 40 and abs(len(places[a][2]) - len(places[b][2])) <= 2 and edit(places[a][2], places[b][2]) <= 2]
    group = joined(len(places), links)
    gone = {(d, n) for k, (d, n, _) in enumerate(places) if group[k] != k}
    left = {}
    for d, t in texts.items():
        rest = [x for n, x in enumerate(t.split("\n")) if (d, n) not in gone]
        if len(rest) == len(t.split("\n")) or "\n".join(rest).strip():
            left[d] = "\n".join(rest)
    # Near-duplicates.
    ids = sorted(left)
    words = [re.findall(r"\w+", left[d].lower()) for d in ids]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    group = joined(len(ids), links)
    left = {d: left[d] for k, d in enumerate(ids) if group[k] == k}
    # Test items.
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    return {d: t for d, t in left.items() if not any(plain(x) in plain(t) for _, x in items)}


@pytest.mark.parametrize("seed", [1])
def test_run(spark, tmp_path, seed):
    docs, items = corpus(random.Random(seed))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = by_hand(docs, items)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(want)
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert 0 < len(want) < len(docs) - 40


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]
