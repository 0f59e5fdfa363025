"""A minimal acyclic transducer from sorted terms to their ordinals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Maps each of its terms to its place among them in the order of bytes.

    States are numbered so that the targets of a state come before it.  An arc is found by its key,
    256 * state + byte; ``skips`` holds how many terms come before those behind the arc.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, terms: int) -> None:
        self.keys, self.targets, self.skips, self.final, self.terms = keys, targets, skips, final, terms

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending order, in one pass.

        Only the states along the last term are open; a state whose terms are complete is looked up by
        its arcs, so that equal ends of terms share their states.
        """
        known: dict[tuple[bool, bytes, tuple[int, ...]], int] = {}
        states: list[tuple[bool, bytes, tuple[int, ...]]] = []
        # Open states along the last term: labels of arcs, their targets (the last one still missing).
        labels: list[bytearray] = [bytearray()]
        targets: list[list[int]] = [[]]
        final = [False]

        def shorten(depth: int) -> None:
            while len(final) > depth:
                state = (final.pop(), bytes(labels.pop()), tuple(targets.pop()))
                number = known.get(state)
                if number is None:
                    number = known[state] = len(states)
                    states.append(state)
                if targets:
                    targets[-1].append(number)

        last, size = b"", 0
        for term in terms:
            if size and term <= last:
                raise ValueError("terms are distinct and ascend")
            common = next((i for i, (a, b) in enumerate(zip(last, term)) if a != b), min(len(last), len(term)))
            shorten(common + 1)
            for byte in term[common:]:
                labels[-1].append(byte)
                labels.append(bytearray())
                targets.append([])
                final.append(False)
            final[-1] = True
            last, size = term, size + 1
        shorten(0)

        behind = np.zeros(len(states), np.int64)
        keys, to, skips = [], [], []
        for number, (ends, letters, nexts) in enumerate(states):
            before = int(ends)
            for letter, target in zip(letters, nexts):
                keys.append(number * 256 + letter)
                to.append(target)
                skips.append(before)
                before += int(behind[target])
            behind[number] = before
        return cls(
            np.array(keys, np.int64),
            np.array(to, np.int32),
            np.array(skips, np.int32),
            np.array([s[0] for s in states], bool),
            size,
        )

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinals of the strings data[start:end], -1 for those that are no term."""
        out = np.full(len(starts), -1, np.int64)
        alive = np.arange(len(starts))
        state = np.full(len(starts), len(self.final) - 1, np.int64)
        passed = np.zeros(len(starts), np.int64)
        at = starts.astype(np.int64)
        while len(alive):
            over = at == ends[alive]
            ended = over & self.final[state]
            out[alive[ended]] = passed[ended]
            going = ~over
            alive, state, passed, at = alive[going], state[going], passed[going], at[going]
            if not len(alive) or not len(self.keys):
                break
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            arc, alive = arc[known], alive[known]
            state, passed, at = self.targets[arc].astype(np.int64), passed[known] + self.skips[arc], at[known] + 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        state, out = len(self.final) - 1, bytearray()
        while True:
            low, high = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            if self.final[state] and ordinal == 0:
                return bytes(out)
            arc = low + int(np.searchsorted(self.skips[low:high], ordinal, side="right")) - 1
            ordinal -= int(self.skips[arc])
            out.append(int(self.keys[arc]) % 256)
            state = int(self.targets[arc])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.terms], np.int64)
        return b"".join(a.tobytes() for a in (head, self.keys, self.targets, self.skips, self.final))

    @classmethod
    def from_bytes(cls, packed: bytes) -> Transducer:
        arcs, states, terms = (int(n) for n in np.frombuffer(packed, np.int64, 3))
        at, parts = 24, []
        for kind, length in ((np.int64, arcs), (np.int32, arcs), (np.int32, arcs), (bool, states)):
            parts.append(np.frombuffer(packed, kind, length, at))
            at += parts[-1].nbytes
        return cls(*parts, terms)
