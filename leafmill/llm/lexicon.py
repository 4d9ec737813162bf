"""A minimal acyclic transducer: words to numbers, suffixes shared, read from a memory map."""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from functools import lru_cache
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<5q")
_BYTES = [bytes([b]) for b in range(256)]


class Transducer:
    """Words with integer sequences as outputs.

    A word's number is the sum of the skips on its path (how many words sort before it), and the
    number selects its outputs, so that equal suffixes share states whatever their outputs are.
    """

    def __init__(self, blob: bytes | mmap.mmap):
        n_states, n_edges, n_words, n_ids, _ = _HEAD.unpack_from(blob, 0)
        at, view = _HEAD.size, memoryview(blob)

        def part(kind: str, n: int) -> memoryview:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = view[at : at + size].cast({"<i4": "i", "u1": "B"}[kind])
            at += size + -size % 8
            return out

        self.first, self.target, self.skip = part("<i4", n_states + 1), part("<i4", n_edges), part("<i4", n_edges)
        self.start, self.ids = part("<i4", n_words + 1), part("<i4", n_ids)
        self.find, self.labels = blob.find, at
        part("u1", n_edges)
        self.final = part("u1", n_states)

    def get(self, word: bytes) -> list[int] | None:
        state, number, first, find, base = 0, 0, self.first, self.find, self.labels
        for byte in word:
            e = find(_BYTES[byte], base + first[state], base + first[state + 1]) - base
            if e < 0:
                return None
            number += self.skip[e]
            state = self.target[e]
        if not self.final[state]:
            return None
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words, built in one pass over them in byte order."""
    entries = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # A path of open nodes [final, edges, byte that leads here]; closed ones are in the register.
    path: list[list] = [[False, [], None]]

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((node[2], freeze(node)))

    previous = b""
    for word, _ in entries:
        shared = len(os.path.commonprefix([previous, word]))
        close(shared)
        for byte in word[shared:]:
            path.append([False, [], byte])
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(path[0])

    count: list[int] = []  # words below each state; targets always precede their sources
    for final, edges in states:
        count.append(int(final) + sum(count[t] for _, t in edges))
    order = [root] + [s for s in range(len(states)) if s != root]
    place = {s: i for i, s in enumerate(order)}
    first, label, target, skip, final = [0], [], [], [], []
    for s in order:
        is_final, edges = states[s]
        before = int(is_final)
        for byte, t in edges:
            label.append(byte)
            target.append(place[t])
            skip.append(before)
            before += count[t]
        first.append(len(label))
        final.append(is_final)
    start = np.cumsum([0, *(len(ids) for _, ids in entries)])
    ids = [i for _, out in entries for i in out]
    parts = [(first, "<i4"), (target, "<i4"), (skip, "<i4"), (start, "<i4"), (ids, "<i4"), (label, "u1"), (final, "u1")]
    body = b"".join((b := np.asarray(x, kind).tobytes()) + b"\0" * (-len(b) % 8) for x, kind in parts)
    return _HEAD.pack(len(states), len(label), len(entries), len(ids), 0) + body


@lru_cache(maxsize=2)
def mapped(blob: bytes) -> Transducer:
    """The automaton read through a memory map of an unlinked file in the worker's own folder; one for all tasks of a worker."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
