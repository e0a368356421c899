"""The transducer, the counts and both packings against the tokenizers library."""
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallywright.llm import binary_output, packing, token_counts, transducer
from tallywright.llm.queries import tokenizer

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = [*"abeé'strvldmDLEΣßİ '\n\t 0123½²,.!-_<|>\x85\xa0ñ語文😀́", "'re", "'ll", "'VE", "<|endoftext|>", "<|startoftext|>", " the", "  ", "ing", "\r\n"]


def texts(n=600, seed=3):
    rng = random.Random(seed)
    return ["", None, "<|endoftext|>", " ", "a<|endoftext|><|endoftext|> b ", "x" * 3000, "the cat sat on the mat " * 400] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return transducer.Transducer(tokenizer(request.param)), Tokenizer.from_file(tokenizer(request.param))


def test_ids_and_counts(both):
    machine, library = both
    data = texts()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in data]
    ids, at = transducer.encode(machine, data)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert transducer.count_tokens(machine, data).tolist() == list(map(len, want))


def test_tables_may_be_dropped_at_any_time(both):
    machine, _ = both
    data = texts(200, 9)
    want = transducer.count_tokens(machine, data).tolist()
    machine.max_states = 50
    assert [int(transducer.count_tokens(machine, [t])[0]) for t in data] == want
    machine.max_states = 400_000


def test_chunk_maps_compose_to_the_states_of_one_walk():
    table, _ = transducer.piece_tables(True)
    rng = np.random.default_rng(1)
    classes = rng.integers(0, transducer.N_CLASSES, (40, 30)).astype(np.uint8)
    state, want = transducer.FRESH, []
    for chunk in classes.T:
        want.append(state)
        for c in chunk:
            state = int(table[state * transducer.N_CLASSES + c])
    assert transducer.entry_states(transducer.chunk_maps(classes, table)).tolist() == want


def test_every_character_has_the_class_that_the_tokenizer_gives_it():
    split = Tokenizer.from_file(tokenizer(FILES[0])).pre_tokenizer
    classes = transducer.char_classes()
    joins = lambda a, b: len(split.pre_tokenize_str(a + b)) == 1
    for c in [*range(0x21, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x12000), *range(0x1D7C0, 0x1D800), *range(0x1E000, 0x1F640)]:
        if 0xD800 <= c < 0xE000 or chr(c) in "'":
            continue
        kind = int(classes[c])
        letter = kind in (transducer.LETTER, transducer.ONE, transducer.RV, transducer.LL, transducer.EE)
        assert (letter, kind == transducer.NUMBER, kind == transducer.OTHER) == (joins("b", chr(c)), joins("1", chr(c)), joins("!", chr(c))), hex(c)


@pytest.fixture(scope="module")
def docs(spark):
    data = texts(150, 5)
    return spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3), data


def test_counts_query(docs):
    df, data = docs
    library = Tokenizer.from_file(tokenizer(FILES[0]))
    got = {r.doc_id: r for r in token_counts.token_counts(df, tokenizer(FILES[0]), limit=20).collect()}
    for k, t in enumerate(data):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 20)


def test_two_fit_packing(docs):
    df, data = docs
    library, size = Tokenizer.from_file(tokenizer(FILES[1])), 64
    rows = packing.pack_documents(df, tokenizer(FILES[1]), end_id=1, size=size).collect()
    want = {}
    for k, t in enumerate(data):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for n, s in enumerate(range(0, len(ids), size)):
            want[k, n] = (s, len(ids[s:s + size]), zlib.crc32(ids[s:s + size].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= size
    least = -(-sum(r.length for r in rows) // size)
    assert len(bins) <= least + max(2, least // 50)
    full = {r.sequence_id: r for r in packing.sequences(df, packing.pack_documents(df, tokenizer(FILES[1]), size=size), tokenizer(FILES[1]), size=size).collect()}
    assert sum(len(r.ids) for r in full.values()) == sum(bins.values()) and all(sum(r.lengths) == len(r.ids) for r in full.values())


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(101, np.int64)
    counts[[70, 20, 18, 11]] = 1  # 70 + 20 leaves 10; 18 + 11 fill 30 more tightly than 20 does
    patterns = packing.two_fit_patterns(counts, 100)
    assert patterns[0] == ([(70, 1), (18, 1), (11, 1)], 1) and patterns[1] == ([(20, 1)], 1)


def one_by_one(counts, size):
    """Best-two-fit without counts by length: a bin at a time, a piece at a time."""
    left = sorted((x for x, n in enumerate(counts) for _ in range(n)), reverse=True)
    out = []
    while left:
        bin_, gap = [], size
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap and len(bin_) > 1:
            small, room = min(bin_), gap + min(bin_)
            # Two unpacked pieces that fill the room best, if better than the smallest piece; ties go to the shortest first one.
            best = None
            for i, x in enumerate(sorted(left)):
                for y in sorted(left)[:i]:
                    if x + y <= room and (best is None or (x + y, -min(x, y)) > (best[0] + best[1], -min(best))):
                        best = (x, y)
            if best and sum(best) > small:
                bin_.remove(small)
                left.append(small)
                for x in best:
                    left.remove(x)
                    bin_.append(x)
                left.sort(reverse=True)
        out.append(tuple(sorted(bin_)))
    return sorted(out)


def test_equal_lengths_are_packed_as_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = np.zeros(41, np.int64)
        np.add.at(counts, rng.integers(1, 41, rng.integers(1, 60)), 1)
        bins = []
        for pieces, times in packing.two_fit_patterns(counts, 40):
            assert sum(length * n for length, n in pieces) <= 40 and times > 0
            bins += [tuple(sorted(length for length, n in pieces for _ in range(n)))] * times
        assert sorted(bins) == one_by_one(counts, 40)


def test_matrices(docs):
    df, data = docs
    library, size = Tokenizer.from_file(tokenizer(FILES[0])), 64
    rows = binary_output.packed_matrices(df, tokenizer(FILES[0]), size=size, window=2000).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        edges = r.cumulative_lengths
        assert len(ids) == size and edges[-1] == r.n_tokens and r.position_resets == edges[:-1] and (ids[r.n_tokens:] == 50256).all()
        places = binary_output.position_ids(edges, size)
        assert all(places[a] == 0 and places[b - 1] == b - a - 1 for a, b in zip(edges, edges[1:]))
        for d, p, a, b in zip(r.doc_ids, r.pieces, edges, edges[1:]):
            parts[d, p] = ids[a:b].tolist()
    for k, t in enumerate(data):
        want = library.encode(t or "", add_special_tokens=False).ids + [50256]
        assert sum((parts[k, p] for p in range(-(-len(want) // size))), []) == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = binary_output.segments(binary_output.matrices_in_shared_folder(df, tokenizer(FILES[0]), size=size, window=2000), size).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == {k: zlib.crc32(np.array(v, "<u2").tobytes()) for k, v in parts.items()}


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(4)
    for _ in range(50):
        size = rng.choice([10, 31, 64])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
        plain, left = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [(room, b) for b, room in enumerate(left) if room >= lengths[k]]
            if fits:
                room = min(fits)[0]
                b = next(b for b, x in enumerate(left) if x == room)
            else:
                b = len(left)
                left.append(size)
                plain.append([])
            left[b] -= lengths[k]
            plain[b].append(k)
        bins = binary_output.best_fit_decreasing(lengths, size)
        assert sorted(sum(lengths[k] for k in b) for b in bins) == sorted(sum(lengths[k] for k in b) for b in plain)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
