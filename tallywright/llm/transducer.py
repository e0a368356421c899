"""Byte-pair tokenizers compiled to deterministic finite-state transducers.

Two machines run over a batch of texts, both in lock step over many chunks with numpy:

* **Pieces.** The published split patterns of the tokenizers are small automata over character classes. Where a chunk starts
  inside a piece its entry state is not known, so each chunk is first reduced to its *state map* (entry state to exit state);
  the maps compose, and a parallel prefix scan of the compositions gives every chunk its entry state.
* **Tokens.** After a prefix of a piece exactly one token ends the encoding of that prefix. The state holds, for every suffix
  that can still grow into a vocabulary entry, the token before it and the number of tokens before it. Reading a byte finds
  the one entry that may follow its predecessor, so a transition carries the *change of the token count*, and the state
  carries the last token, from which ids are read backwards. States are finite and are compiled when first met;
  the tables are dropped and rebuilt between batches when they pass ``max_states``, which changes no result.

Results equal those of the ``tokenizers`` library (tests/llm/test_tokens.py). Texts are read whole; null is the empty text.
"""
from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, ONE, RV, LL, EE, END = range(11)
N_CLASSES = 11
FRESH, WORD, DIGITS, SIGNS, APO, APO_RV, APO_L, DONE, SP1, SP2, WS1, WS2 = range(12)
N_STATES = 12
CHUNK = 128  # characters of a chunk of the piece automaton
LANE = 128  # bytes of a lane of the token transducer, at least
MANY = 40  # suffixes with more continuations keep their predecessor instead of its class
CHANGE_BITS, CHANGE_ZERO = 8, 200  # a packed transition: next state, change of the count


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, text):
            a, b = m.span()
            for lo, hi, shift in ((0, 0xD800, 0), (0xD800, len(text), 0x800)):
                x, y = max(a, lo), min(b, hi)
                if x < y:
                    table[x + shift:y + shift] = cls
    # Where two versions of Unicode disagree, the tokenizers library has the word.
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    joins = lambda pair: len(split.pre_tokenize_str(pair)) == 1
    by_group = {"L": LETTER, "N": NUMBER}
    for c in map(ord, text):
        if table[c] != BLANK and table[c] != by_group.get(unicodedata.category(chr(c))[0], OTHER):
            table[c] = LETTER if joins("b" + chr(c)) else NUMBER if joins("1" + chr(c)) else OTHER
    for chars, cls in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("rv", RV), ("l", LL), ("e", EE)):
        table[[ord(c) for c in chars]] = cls
    return table


def _start(cls: int, blanks: bool) -> int:
    if cls in (SPACE, BLANK):
        return (SP1 if cls == SPACE else WS1) if blanks else FRESH
    return {NUMBER: DIGITS, OTHER: SIGNS, QUOTE: APO, END: FRESH}.get(cls, WORD)


def _step(state: int, cls: int, blanks: bool) -> tuple[int, int]:
    """Next state; bit 0: a piece starts at this character, bit 1: one starts at the character before."""
    letter = cls in (LETTER, ONE, RV, LL, EE)
    fresh = (_start(cls, blanks), 1)
    if state in (APO_RV, APO_L):
        if cls == (EE if state == APO_RV else LL):
            return DONE, 0
        nxt, out = _step(WORD, cls, blanks)
        return nxt, out | 2
    if cls == END:
        return fresh
    if state == WORD:
        return (WORD, 0) if letter else fresh
    if state == DIGITS:
        return (DIGITS, 0) if cls == NUMBER and blanks else fresh
    if state == SIGNS:
        return (SIGNS, 0) if cls in (OTHER, QUOTE) else fresh
    if state == APO:
        follow = {ONE: DONE, RV: APO_RV, LL: APO_L, OTHER: SIGNS, QUOTE: SIGNS}.get(cls)
        return fresh if follow is None else (follow, 0)
    if state in (SP1, SP2, WS1, WS2):
        if cls in (SPACE, BLANK):
            return (SP2 if cls == SPACE else WS2), 0
        cut = 2 if state in (SP2, WS2) else 0
        if state in (SP1, SP2):
            return (WORD if letter else DIGITS if cls == NUMBER else SIGNS), cut
        return fresh[0], 1 | cut
    return fresh


@lru_cache(2)
def piece_tables(blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables. ``blanks``: white space belongs to pieces and digits form runs."""
    rows = [[_step(s, c, blanks) for c in range(N_CLASSES)] for s in range(N_STATES)]
    return (np.array([[x[0] for x in r] for r in rows], np.uint8).ravel(), np.array([[x[1] for x in r] for r in rows], np.uint8).ravel())


def chunk_maps(classes: np.ndarray, table: np.ndarray, sure: int = 12) -> np.ndarray:
    """State map of every chunk; ``classes`` has a row for each place in a chunk and a column for each chunk.

    Maps that are constant after ``sure`` characters stay constant, so one lane carries them on.
    """
    def walk(maps, rows):
        for row in rows:
            maps = table[maps * N_CLASSES + row]
        return maps

    maps = walk(np.broadcast_to(np.arange(N_STATES, dtype=np.uint8)[:, None], (N_STATES, classes.shape[1])), classes[:sure])
    open_ = np.flatnonzero((maps != maps[0]).any(axis=0))
    full = walk(maps[:, open_], classes[sure:, open_])
    maps = np.broadcast_to(walk(maps[0], classes[sure:]), maps.shape).copy()
    maps[:, open_] = full
    return maps


def entry_states(maps: np.ndarray) -> np.ndarray:
    """Entry state of every chunk: an inclusive prefix scan that doubles the reach of the composed maps."""
    scan, reach = maps.copy(), 1
    while reach < scan.shape[1]:
        later = np.take_along_axis(scan[:, reach:], scan[:, :-reach].astype(np.intp), axis=0)
        scan = np.concatenate([scan[:, :reach], later], axis=1)
        reach *= 2
    return np.concatenate([[FRESH], scan[FRESH, :-1]]).astype(np.uint8)


def piece_starts(classes: np.ndarray, blanks: bool) -> np.ndarray:
    """Where pieces start, for the classes of a batch whose texts each end in END."""
    n = len(classes)
    table, outputs = piece_tables(blanks)
    grid = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    state = entry_states(chunk_maps(grid, table))
    out = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = state * N_CLASSES + row
        out[k] = outputs[at]
        state = table[at]
    out = out.T.ravel()
    starts = (out[:n] & 1).astype(bool)
    starts[:-1] |= (out[1:n] & 2).astype(bool)
    return starts


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """A ``tokenizers`` JSON file with a byte-level BPE model, with or without word ends."""

    def __init__(self, path: str, max_states: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        end = model.get("end_of_word_suffix") or ""
        self.word_ends = bool(end)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.max_states = max_states

        def symbols(token: str) -> str:
            last = bool(end) and token.endswith(end)
            if last:
                token = token[:-len(end)]
            s = [letters[c] for c in token]
            if last:
                s[-1] += 256
            return "".join(map(chr, s))

        self.ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.specials:
                self.ids[symbols(token)] = i
        self.n_ids = 1 + max([*self.ids.values(), *self.specials.values()])
        self.text = {i: s for s, i in self.ids.items()}
        self.length = np.ones(self.n_ids, np.int32)
        for i, s in self.text.items():
            self.length[i] = len(s)
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbols(a), symbols(b)
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        parts = {i: (p, rank) for p, (rank, i) in reversed(self.ranks.items())}
        self.right = {}
        self.left = {}
        for i in self.text:
            for spines, side in ((self.right, 1), (self.left, 0)):
                spine, at, above = [], i, np.inf
                while True:
                    spine.append((at, above))
                    if at not in parts:
                        break
                    at, above = parts[at][0][side], parts[at][1]
                spines[i] = spine[::-1]
        self.whole: dict[int, bool] = {}
        self.longer: dict[str, list[int]] = {}
        for s, i in self.ids.items():
            for k in range(1, len(s)):
                self.longer.setdefault(s[:k], []).append(i)
        self.classes: dict[tuple, int] = {}
        self.sets: dict[tuple, int] = {}
        self.samples: list[int] = []
        self._clear()

    def _clear(self) -> None:
        self.columns = np.full(512, -1, np.int16)
        self.symbols: list[str] = []
        self.keys: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.width = 64
        self.table = np.full(4096 * self.width, -1, np.int32)
        self.last = np.zeros(4096, np.int32)
        self._number((("", -1, 0),))

    def encode_symbols(self, s: str) -> list[int]:
        """Merges by rank, the leftmost first: the definition that the transducer is compiled from."""
        out = [self.ids[c] for c in s]
        while len(out) > 1:
            best = min((self.ranks.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(out, out[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 60:
                break
            out[best[2]:best[2] + 2] = [best[1]]
        return out

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the encoding of the two texts joined is these two tokens.

        At any time of the merging the two symbols at the seam lie on the right edge of the first token's merge tree and on
        the left edge of the second's. The seam is lost if such a pair can merge before either symbol merges away from it.
        """
        if token not in self.whole:
            self.whole[token] = self.encode_symbols(self.text[token]) == [token]
        if not self.whole[token] or before < 0:
            return self.whole[token]
        edge, other = self.right[before], self.left[token]
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = edge[i], other[j]
            rank = self.ranks.get((a, b), (np.inf,))[0]
            if rank < until_a and rank <= until_b and rank < np.inf:
                return False
            if until_a == until_b == np.inf:
                return True
            i, j = i + (until_a <= until_b), j + (until_b <= until_a)

    def _context(self, suffix: str, before: int) -> int | None:
        """One predecessor for all that allow the same entries beyond ``suffix``; None if there are none."""
        key = (suffix, before)
        if key not in self.classes:
            longer = self.longer[suffix]
            if len(longer) > MANY:
                self.classes[key] = before
            else:
                allowed = tuple(t for t in longer if self.may_follow(before, t))
                self.classes[key] = self.sets.setdefault((suffix, allowed), before) if allowed else None
        return self.classes[key]

    def _number(self, key: tuple) -> int:
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if n == len(self.last):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[n] = key[-1][1]
        return n

    def _compile(self, state: int, column: int) -> None:
        symbol = self.symbols[column]
        grown, token, count = [], -1, 0
        for suffix, before, at in self.keys[state]:
            longer = suffix + symbol
            if token < 0 and (i := self.ids.get(longer)) is not None and self.may_follow(before, i):
                token, count = i, at + 1
            if longer in self.longer and (before := self._context(longer, before)) is not None:
                grown.append((longer, before, at))
        key = tuple((s, b, at - count) for s, b, at in grown) + (("", token, 0),)
        self.table[state * self.width + column] = self._number(key) << CHANGE_BITS | count + CHANGE_ZERO

    def _column(self, present: np.ndarray) -> None:
        for s in present[self.columns[present] < 0]:
            self.columns[s] = len(self.symbols)
            self.symbols.append(chr(s))
            if len(self.symbols) > self.width:
                old = self.table.reshape(-1, self.width)
                self.table = np.concatenate([old, np.full_like(old, -1)], axis=1).ravel()
                self.width *= 2

    def run(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after, and change of the token count at, every symbol; ``first`` marks the starts of pieces."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int8)
        if len(self.keys) > self.max_states:
            self._clear()
        self._column(np.flatnonzero(np.bincount(symbols, minlength=512)))
        columns = self.columns[symbols] - first * np.int16(1024)  # below zero: a piece starts
        starts = np.flatnonzero(first)
        lanes = starts[np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + 1, LANE)))]
        sizes = np.diff(np.append(lanes, n))
        order = np.argsort(-sizes, kind="stable")
        lanes, sizes = lanes[order], sizes[order]
        alive = len(lanes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        state = np.zeros(len(lanes), np.int32)
        found = np.empty(n, np.int32)
        for t in range(int(sizes[0])):
            at = lanes[:alive[t]] + t
            c = columns[at]
            cell = np.where(c < 0, c + np.int32(1024), state[:alive[t]] * self.width + c)
            packed = self.table[cell]
            if packed.min() < 0:
                for x in np.unique(cell[packed < 0]):
                    self._compile(*divmod(int(x), self.width))
                packed = self.table[cell]
            found[at] = packed
            state = packed >> CHANGE_BITS
        return found >> CHANGE_BITS, ((found & (1 << CHANGE_BITS) - 1) - CHANGE_ZERO).astype(np.int8)

    def ends(self, states: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where tokens end, read back from the end of every piece."""
        marks = np.zeros(len(states), bool)
        if not len(states):
            return marks
        starts = np.flatnonzero(first)
        at = np.append(starts[1:], len(states)) - 1
        while len(at):
            marks[at] = True
            at, starts = at - self.length[self.last[states[at]]], starts
            keep = at >= starts
            at, starts = at[keep], starts[keep]
        return marks


class Pieces:
    """Symbols of a batch of texts: each text cut at special tokens, then into pieces, then into bytes."""

    def __init__(self, machine: Transducer, texts: list[str | None]):
        self.special_owner, self.special_id, self.special_after = [], [], []
        segments, owner = [], []
        cut = regex.compile("|".join(map(regex.escape, sorted(machine.specials, key=len, reverse=True)))) if machine.specials else None
        for k, text in enumerate(texts):
            text, at = text or "", 0
            for m in cut.finditer(text) if cut and "<" in text else ():
                segments.append(text[at:m.start()])
                owner.append(k)
                at = m.end()
                self.special_owner.append(k)
                self.special_id.append(machine.specials[m[0]])
                self.special_after.append(len(segments) - 1)
            segments.append(text[at:])
            owner.append(k)
        if machine.word_ends:
            segments = [_folded(s) for s in segments]
        joined = "\n".join(segments) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = char_classes()[points]
        classes[np.cumsum([len(s) + 1 for s in segments]) - 1] = END
        starts = piece_starts(classes, blanks=not machine.word_ends)
        keep = ~np.isin(classes, (END, SPACE, BLANK) if machine.word_ends else (END,))
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        head = (raw & 0xC0) != 0x80
        char = np.cumsum(head, dtype=np.int32) - 1
        kept = keep[char]
        segment = np.cumsum(classes == END, dtype=np.int32)
        self.segment = segment[char][kept]
        self.first = (head & starts[char])[kept]
        self.symbols = raw[kept].astype(np.int16)
        if machine.word_ends and len(self.symbols):
            self.symbols[np.append(np.flatnonzero(self.first)[1:], len(self.symbols)) - 1] += 256
        self.owner = np.array(owner)
        self.n_texts = len(texts)


def _folded(text: str) -> str:
    """Normal form C and lower case, character by character as the tokenizer file says."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def count_tokens(machine: Transducer, texts: list[str | None]) -> np.ndarray:
    """Token count of every text: the sum of the changes along its transitions."""
    p = Pieces(machine, texts)
    _, changes = machine.run(p.symbols, p.first)
    per = np.bincount(p.owner[p.segment], weights=changes, minlength=p.n_texts)
    per += np.bincount(np.array(p.special_owner, np.int64), minlength=p.n_texts)
    return per.astype(np.int64)


def encode(machine: Transducer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text starts (one more entry at the end)."""
    p = Pieces(machine, texts)
    states, _ = machine.run(p.symbols, p.first)
    marks = machine.ends(states, p.first)
    ids, segment = machine.last[states[marks]], p.segment[marks]
    if p.special_id:
        places = np.searchsorted(segment, p.special_after, side="right")
        ids = np.insert(ids, places, p.special_id)
        segment = np.insert(segment, places, p.special_after)
    per = np.bincount(p.owner[segment], minlength=p.n_texts)
    return ids.astype(np.uint32), np.concatenate([[0], np.cumsum(per)])


def batches(texts: list[str | None], budget: int = 2_000_000):
    """Slices of a list of texts that hold about ``budget`` characters; a longer text has one to itself."""
    a = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > budget:
            yield a, k
            a, size = k, 0
        size += len(t or "") + 1
    if a < len(texts):
        yield a, len(texts)


@lru_cache(4)
def machine(path: str) -> Transducer:
    """One transducer for each tokenizer file and Python worker."""
    return Transducer(path)
