"""Piece vocabularies of merge type, and the lazily built machine that both codec and counter run.

In a merge tokenizer the last token of every prefix of a text is unique: it is the token that ends
there and is compatible with the last token of the prefix before it. Two tokens are compatible when
merging their joined text gives the two back. The machine reads one character a step; its state
holds the automaton node (the longest suffix that begins a token) and the last tokens of the
prefixes from which a token may still reach further. States are made when first needed.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem

SPACE = "▁"
START = -1  # "last token" at the start of a segment: compatible with every token
UNKNOWN = -2  # a character outside the vocabulary: written as its UTF-8 bytes
PAIRS = 500_000  # token pairs whose compatibility is remembered
SEGMENTS = 300_000  # results kept per Python worker; above it they are worked out anew
LONGEST_SEGMENT = 40  # longer segments are not kept
STATES = 300_000  # per Python worker; above it the machine starts anew (results do not change)


class Vocabulary:
    """Pieces, merge order and compatibility of tokens, from a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[int, str] = {}
        self.score: dict[int, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i], self.score[i], self.ids[piece] = piece, model.get_score(i), i
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError("a piece holds a character that is no piece itself")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces that go on over a blank are not supported")
        # How a token is made: its last merge (left part, right part), none for one character.
        self.parts: dict[int, tuple[int, int] | None] = {}
        for piece, i in self.ids.items():
            made = self._merged(piece)
            if made is not None:
                self.parts[i] = made[0]
        self._pairs: dict[int, bool] = {}

    def _merged(self, piece: str) -> list[tuple[int, int] | None] | None:
        """The last merge when the piece's characters merge into the piece, else None (never made)."""
        symbols, last = [self.ids[c] for c in piece], None
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(self.text[symbols[k]] + self.text[symbols[k + 1]])
                if i is not None and (best is None or self.score[i] > self.score[best]):
                    best, at = i, k
            if best is None:
                return None
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [best]
        return [last]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens leaves exactly these two."""
        if left < 0 or right < 0:
            return True
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo merges, latest first; at no time may a better merge have been open across the cut.

        Of equal scores the one further left comes first. `limit` is the score of the merge undone
        last, `ties` whether a merge across the cut with that very score would have come before it.
        """
        limit, ties = float("-inf"), False
        while True:
            joined = self.ids.get(self.text[left] + self.text[right])
            if joined is not None:
                score = self.score[joined]
                if score > limit or ties and score == limit:
                    return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and self.score[left] < self.score[right]:
                limit, ties, left = self.score[left], False, a[1]
            else:
                limit, ties, right = self.score[right], True, b[0]


class State(dict):
    """A machine state; as a dict it maps a character to the next state."""

    __slots__ = ("machine", "key", "last", "delta")

    def __missing__(self, char: str) -> State:
        after = self[char] = self.machine.step(self, char)
        return after


class Machine:
    """Deterministic machine over characters.

    Every state knows the last token of the prefix read. With `counting`, every step also knows how
    the number of tokens changes; without, fewer states are needed.
    """

    def __init__(self, vocabulary: Vocabulary, counting: bool, limit: int = STATES):
        self.vocabulary, self.counting, self.limit = vocabulary, counting, limit
        self.after: list[dict[str, int]] = [{}]
        self.depth, self.token, up = [0], [START], [0]
        for i in vocabulary.parts:
            node = 0
            for c in vocabulary.text[i]:
                down = self.after[node].get(c)
                if down is None:
                    down = self.after[node][c] = len(self.after)
                    self.after.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(START)
                    up.append(0)
                node = down
            self.token[node] = i
        order = [0]
        for node in order:
            for c, down in self.after[node].items():
                order.append(down)
                if node:
                    at = up[node]
                    while at and c not in self.after[at]:
                        at = up[at]
                    up[down] = self.after[at].get(c, 0)
        self.up = up
        # Suffixes of a node that begin tokens, longest first, the empty one last; and those of them
        # that begin longer tokens: only the prefixes before these can matter later.
        self.chain: list[tuple[int, ...]] = [(0,)] * len(self.after)
        self.open: list[tuple[int, ...]] = [(0,)] * len(self.after)
        for node in order[1:]:
            self.chain[node] = (node, *self.chain[up[node]])
            self.open[node] = (node, *self.open[up[node]]) if self.after[node] else self.open[up[node]]
        self.size = {i: len(t) for i, t in vocabulary.text.items()}
        # Worked out once per node, as every step asks for them: the tokens that may end there with
        # their sizes, longest first; sizes of the open suffixes; where a key has the token before each.
        self.ends = [tuple((self.token[n], self.depth[n]) for n in found if self.token[n] >= 0) for found in self.chain]
        self.sizes = [tuple(self.depth[n] for n in found[:-1]) for found in self.open]
        self.places = [{self.depth[n]: 3 + 2 * i for i, n in enumerate(found)} for found in self.open]
        self.clear()

    def clear(self) -> None:
        """Forget all states."""
        self.states: dict[tuple, State] = {}
        self.root = self._state((0, 0, False, START, 0))

    def _state(self, key: tuple) -> State:
        """The state of a key: node, change of the count, whether the last character is a blank, and
        for each open suffix of the node the last token before it and the count there, longest first."""
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State()
            state.machine, state.key, state.delta, state.last = self, key, key[1], key[-2]
        return state

    def step(self, state: State, char: str) -> State:
        key = state.key
        if char == SPACE and not key[2]:
            # No piece goes on over a blank after other characters: a new segment starts here.
            node = self.after[0][SPACE]
            one = int(self.counting)
            return self._state((node, one, True, START, -one, self.token[node], 0))
        node = key[0]
        while node and char not in self.after[node]:
            node = self.up[node]
        node = self.after[node].get(char, 0)
        if not node:
            size = len(char.encode("utf-8")) if self.counting else 0
            return self._state((0, size, False, UNKNOWN, 0))
        places, compatible = self.places[key[0]], self.vocabulary.compatible
        for token, size in self.ends[node]:
            at = places[size - 1]
            if compatible(key[at], token):
                break
        else:
            raise AssertionError("no token ends here")
        delta = key[at + 1] + 1 if self.counting else 0
        history = []
        for size in self.sizes[node]:
            at = places[size - 1]
            history += (key[at], key[at + 1] - delta)
        return self._state((self.open[node][0], delta, char == SPACE, *history, token, 0))

    def run(self, text: str) -> Iterator[State]:
        """The states after each character, from a segment's start."""
        if len(self.states) > self.limit:
            self.clear()
            gc.collect()
        states = accumulate(text, getitem, initial=self.root)
        next(states)
        return states

    def count(self, text: str) -> int:
        return sum(s.delta for s in self.run(text))

    def ids(self, text: str) -> list[int]:
        """Token ids: last tokens of all prefixes, then back from the end, token by token."""
        states = list(self.run(text))
        out, at, size, byte_ids = [], len(text), self.size, self.vocabulary.byte_ids
        while at:
            token = states[at - 1].last
            if token >= 0:
                out.append(token)
                at -= size[token]
            else:
                at -= 1
                out.extend(byte_ids[b] for b in reversed(text[at].encode("utf-8")))
        out.reverse()
        return out


segments = re.compile(f"{SPACE}+[^{SPACE}]*").findall  # of an escaped text; no token crosses their bounds


def escaped(text: str) -> str:
    """The text as the model sees it: a blank in front, blanks as a visible character."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Memo(dict):
    """Results per segment, worked out when first asked for; at most `limit` are kept.

    Kept in two halves: when the newer is full it becomes the older, whose results come back to the
    newer as they are asked for again. Rare segments fall out, frequent ones stay.
    """

    def __init__(self, work, limit: int = SEGMENTS):
        super().__init__()
        self.work, self.half, self.older = work, limit // 2, {}

    def __missing__(self, segment: str):
        result = self.older.get(segment)
        if result is None:
            result = self.work(segment)
        if len(segment) <= LONGEST_SEGMENT:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[segment] = result
        return result


def next_segment(text: str, at: int) -> int:
    """Where the first segment from `at` on starts: a blank after another character; -1 if none."""
    at = text.find(SPACE, max(at, 1))
    while at >= 0 and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1)
    return at


_MACHINES: dict[tuple[str, bool], Machine] = {}


def machine(path: str, counting: bool) -> Machine:
    """The machine of a model file, built once per Python worker."""
    if (path, counting) not in _MACHINES:
        # States live long and hold no dead cycles: look through them less often.
        gc.set_threshold(200_000, 20, 50)
        _MACHINES[path, counting] = Machine(Vocabulary(path), counting)
    return _MACHINES[path, counting]
