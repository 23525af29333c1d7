"""A minimal acyclic transducer: byte strings to sequences of token ids.

Words are added in sorted order and equal suffixes share states. Each arc
carries how many words sort before those it leads to, so the sum along a path
is the word's rank, which addresses its ids. The whole is one flat buffer that
tasks map into memory; a batch of words is looked up at once, one byte at a
time.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

PARTS = [("arcs", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("offset", np.int64),
         ("ids", np.uint32)]


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs, self.final, self.number, self.words = {}, False, -1, 0

    def key(self):
        return self.final, tuple((b, s.number) for b, s in self.arcs.items())


def compile_words(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``words`` (each with its ids) as a buffer."""
    root, register, kept = _State(), {}, []
    path: list[_State] = [root]
    last = b""

    def settle_down(to: int) -> None:
        """States of the last word below depth ``to`` are final: share equal ones."""
        for depth in range(len(last), to, -1):
            state = path.pop()
            known = register.get(key := state.key())
            if known is None:
                state.number = len(kept)
                state.words = state.final + sum(s.words for s in state.arcs.values())
                register[key] = state
                kept.append(state)
            else:
                path[-1].arcs[last[depth - 1]] = known

    order = sorted(words)
    for word in order:
        common = 0
        for a, b in zip(word, last):
            if a != b:
                break
            common += 1
        settle_down(common)
        for byte in word[common:]:
            state = _State()
            path[-1].arcs[byte] = state
            path.append(state)
        path[-1].final = True
        last = word
    settle_down(0)
    root.number = len(kept)
    kept.append(root)

    arcs, target, skip = [], [], []
    for state in kept:
        before = int(state.final)
        for byte, to in state.arcs.items():
            arcs.append(state.number << 8 | byte)
            target.append(to.number)
            skip.append(before)
            before += to.words
    sizes = np.fromiter((len(words[w]) for w in order), np.int64, len(order))
    ids = np.fromiter((i for w in order for i in words[w]), np.uint32, int(sizes.sum()))
    made = {"arcs": arcs, "target": target, "skip": skip, "final": [s.final for s in kept],
            "offset": np.concatenate([[0], np.cumsum(sizes)]), "ids": ids}
    flat = [np.asarray(made[name], kind).tobytes() for name, kind in PARTS]
    head = np.array([len(x) for x in flat] + [root.number], np.int64).tobytes()
    return head + b"".join(x + b"\0" * (-len(x) % 8) for x in flat)


class Transducer:
    """A compiled buffer, mapped from a file that is already unlinked: its pages are shared and cost no heap."""

    def __init__(self, buffer: bytes):
        handle, path = tempfile.mkstemp(suffix=".lexicon")
        try:
            os.write(handle, buffer)
            self.map = mmap.mmap(handle, len(buffer), access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
            os.unlink(path)
        head = np.frombuffer(self.map, np.int64, len(PARTS) + 1)
        at = head.nbytes
        for (name, kind), size in zip(PARTS, head):
            setattr(self, name, np.frombuffer(self.map, kind, int(size) // np.dtype(kind).itemsize, at))
            at += int(size) + (-int(size) % 8)
        self.root = int(head[-1])

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, -1 where it holds no such word."""
        n = len(words)
        if not n or not len(self.arcs):
            return np.full(n, -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        state, rank = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        active, depth = np.flatnonzero(sizes > 0), 0
        while len(active):
            want = state[active] << 8 | text[start[active] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            found = self.arcs[arc] == want
            rank[active[~found]] = -1
            state[active[~found]] = -1
            active, arc = active[found], arc[found]
            state[active] = self.target[arc]
            rank[active] += self.skip[arc]
            depth += 1
            active = active[sizes[active] > depth]
        alive = state >= 0
        alive[alive] = self.final[state[alive]] == 1
        return np.where(alive, rank, -1)
