"""A minimal acyclic transducer: words to lists of ids, in one file that is mapped into memory.

Words that end alike share their last states.  A transition's output is the number of words
that sort before those below it; along a word's path the outputs add up to the word's number,
and the number finds its ids.  So outputs never keep equal endings apart.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Names and types of the arrays of a file, in order; a head of their lengths stands before them.
_PARTS = [("keys", np.int64), ("begins", np.int64), ("target", np.int32), ("output", np.int32), ("ids", np.uint32), ("final", np.uint8)]


def compiled(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a transducer over (word, ids), which come sorted by word, each word once."""
    register: dict[tuple, int] = {}
    below: list[int] = []  # words from each state on
    begins, ids = [0], []
    open_states: list[list] = [[False, []]]  # along the last word: [final, [(byte, state)]]
    last = b""

    def freeze() -> int:
        final, out = open_states.pop()
        key = (final, tuple(out))
        if key not in register:
            register[key] = len(register)
            below.append(final + sum(below[t] for _, t in out))
        return register[key]

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            byte = last[len(open_states) - 2]
            state = freeze()
            open_states[-1][1].append((byte, state))

    for word, out in entries:
        if word <= last and len(begins) > 1:
            raise ValueError("words must be sorted and distinct")
        same = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        close(same)
        open_states += [[False, []] for _ in word[same:]]
        open_states[-1][0], last = True, word
        ids += out
        begins.append(len(ids))
    close(0)
    freeze()  # the root is the last state
    keys, target, output, final = [], [], [], np.zeros(len(register), np.uint8)
    for (ends, out), state in register.items():
        before = final[state] = ends
        before = int(before)
        for byte, to in out:
            keys.append(state << 8 | byte)
            target.append(to)
            output.append(before)
            before += below[to]
    parts = {"keys": keys, "begins": begins, "target": target, "output": output, "ids": ids, "final": final}
    arrays = [np.asarray(parts[name], kind) for name, kind in _PARTS]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Transducer:
    """A compiled file, mapped: the workers of a machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = raw[: 8 * len(_PARTS)].view(np.int64)
        at = 8 * len(_PARTS)
        for (name, kind), n in zip(_PARTS, head.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += size
        self.states = len(self.final)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for those that are not accepted; all words walk together, a byte a step."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1)
        if not len(words) or not len(self.keys):
            return np.where((size == 0) & bool(self.final[-1]), 0, -1)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.cumsum(size) - size
        live, state, total = np.arange(len(words)), np.full(len(words), self.states - 1, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = size[live] == step
            done = ended & (self.final[state] == 1)
            out[live[done]] = total[done]
            live, state, total = live[~ended], state[~ended], total[~ended]
            key = state << 8 | data[at[live] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            place = place[hit]
            live, state, total = live[hit], self.target[place].astype(np.int64), total[hit] + self.output[place]
            step += 1
        return out

    def found(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian 32-bit integers; None for words that are not accepted."""
        return [self.ids[self.begins[i] : self.begins[i + 1]].tobytes() if i >= 0 else None for i in self.numbers(words).tolist()]
