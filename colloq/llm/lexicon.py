"""A minimal acyclic transducer from words to token ids, in one flat buffer.

Words are added in sorted order; a suffix that cannot change any more is replaced by an equal one
that is registered already, so suffixes are shared and the automaton is minimal for its outputs.
Ids are pushed to the earliest transition that determines them. The buffer can be written to a file
and memory-mapped: a lookup touches only the states on the word's path, and a filter of one hashed bit
in 16 a word turns away most words that are not in the lexicon before they are walked.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Sequence

MAGIC = b"ACTX2\0\0\0"


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # label -> [state, output]
        self.final = False
        self.tail: tuple[int, ...] = ()  # output at the end of a word

    def signature(self) -> tuple:
        return (self.final, self.tail, tuple((k, id(s), out) for k, (s, out) in self.arcs.items()))


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """``entries``: distinct words with their ids, in any order."""
    register: dict[tuple, _State] = {}
    root = _State()
    path = [root]  # states of the last word, which may still change
    last = b""

    def freeze(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            arc = path[i - 1].arcs[last[i - 1]]
            arc[0] = register.setdefault(path[i].signature(), path[i])
        del path[depth + 1 :]

    words = []
    for word, ids in sorted(entries):
        words.append(word)
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        for byte in word[common:]:
            state = _State()
            path[-1].arcs[byte] = [state, ()]
            path.append(state)
        rest = tuple(ids)
        for i in range(common):  # share what the outputs on the common path agree on, push the remainder down
            arc = path[i].arcs[word[i]]
            n = 0
            while n < min(len(arc[1]), len(rest)) and arc[1][n] == rest[n]:
                n += 1
            spare = arc[1][n:]
            if spare:
                arc[1] = arc[1][:n]
                below = path[i + 1]
                for lower in below.arcs.values():
                    lower[1] = spare + lower[1]
                if below.final:
                    below.tail = spare + below.tail
            rest = rest[n:]
        if common < len(word):
            path[common].arcs[word[common]][1] = rest
        else:
            path[-1].tail = rest
        path[-1].final = True
        last = word
    freeze(0)
    return _pack(root, words)


def _pack(root: _State, words: list[bytes]) -> bytes:
    order, number = [root], {id(root): 0}
    for state in order:
        for target, _ in state.arcs.values():
            if id(target) not in number:
                number[id(target)] = len(order)
                order.append(target)
    first, tails, target, outs, ids, labels = array("I"), array("I"), array("I"), array("I"), array("I", [0]), bytearray()
    pool: dict[tuple[int, ...], int] = {(): 0}

    def stored(out: tuple[int, ...]) -> int:
        if out not in pool:
            pool[out] = len(ids)
            ids.append(len(out))
            ids.extend(out)
        return pool[out]

    for state in order:
        first.append(len(labels))
        tails.append(stored(state.tail) + 1 if state.final else 0)
        for label, (below, out) in sorted(state.arcs.items()):
            labels.append(label)
            target.append(number[id(below)])
            outs.append(stored(out))
    first.append(len(labels))
    bits = 1 << max(6, (16 * len(words)).bit_length())
    filter_ = bytearray(bits // 8)
    for word in words:
        at = zlib.crc32(word) % bits
        filter_[at >> 3] |= 1 << (at & 7)
    parts = [x.tobytes() for x in (first, tails, target, outs, ids)] + [bytes(labels), bytes(filter_)]
    return MAGIC + struct.pack("<7I", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """Lookups in a packed buffer (bytes or an open memory map)."""

    def __init__(self, buffer) -> None:
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        sizes, at, views = struct.unpack("<7I", bytes(buffer[8:36])), 36, []
        whole = memoryview(buffer)
        for n in sizes[:5]:
            views.append(whole[at : at + n].cast("I"))
            at += n
        self._buffer, self._labels = buffer, at
        self._filter = whole[at + sizes[5] : at + sizes[5] + sizes[6]]
        self._mask = 8 * sizes[6] - 1
        self._first, self._tails, self._target, self._outs, self._ids = views

    @property
    def states(self) -> int:
        return len(self._tails)

    def ids(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if it is not in the lexicon."""
        bit = zlib.crc32(word) & self._mask
        if not self._filter[bit >> 3] >> (bit & 7) & 1:
            return None
        state, found, first, base, ids = 0, [], self._first, self._labels, self._ids
        for i in range(len(word)):
            low = base + first[state]
            at = self._buffer.find(word[i : i + 1], low, base + first[state + 1]) - base
            if at < 0:
                return None
            out = self._outs[at]
            if out:
                found.extend(ids[out + 1 : out + 1 + ids[out]])
            state = self._target[at]
        tail = self._tails[state]
        if not tail:
            return None
        if tail > 1:
            found.extend(ids[tail : tail + ids[tail - 1]])
        return found
