"""Exact byte-pair merging and a minimal acyclic transducer of frequent words.

The transducer maps a word to its number (sum of the numbers on its arcs), the number
to a list of token ids. Equal suffixes share states; the arrays are flat integers that
workers memory-map.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np

# Fixed value: how the byte-level vocabulary splits text into words. Letters and numbers
# stand first, which changes nothing (no other alternative starts with one) and is faster.
WORD_PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nearly the same words, found faster; good enough to choose the lexicon by.
ROUGH_PATTERN = r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: always merge the adjacent pair of lowest rank, leftmost first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        a = parts[i]
        j = nxt[i]
        if a is None or j >= n or len(a) + len(parts[j]) != len(both) or a + parts[j] != both:
            continue  # one side was merged meanwhile
        parts[i], parts[j] = both, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(m := both + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, m))
        if (p := prv[i]) >= 0 and (r := ranks.get(m := parts[p] + both)) is not None:
            heapq.heappush(heap, (r, p, m))
    return [ranks[p] for p in parts if p is not None]


def build_transducer(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Minimal automaton of distinct ``words`` in byte order, as one flat byte string."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
        return s

    path: list[list] = [[False, []]]  # open nodes of the last word: [final, [(byte, state)]]
    last = b""

    def close(to: int) -> None:
        while len(path) > to + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        last = w
        path.extend([False, []] for _ in range(len(w) - k))
        path[-1][0] = True
    close(0)
    root = freeze(path[0])
    count = [0] * len(states)
    for s, (final, arcs) in enumerate(states):  # children are frozen before parents
        count[s] = final + sum(count[t] for _, t in arcs)
    keys, to, out = [], [], []
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            to.append(t)
            out.append(before)
            before += count[t]
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [keys, to, out, [final for final, _ in states], starts, [i for x in ids for i in x]]
    head = np.array([root, *map(len, arrays)], dtype="<i8").tobytes()
    return head + b"".join(np.asarray(a, dtype="<i4").tobytes() for a in arrays)


class Transducer:
    """Reads ``build_transducer``'s file by memory map and walks many words at once."""

    def __init__(self, path: str) -> None:
        head = np.memmap(path, dtype="<i8", mode="r", shape=(7,))
        self.root, sizes = int(head[0]), [int(x) for x in head[1:]]
        flat = np.memmap(path, dtype="<i4", mode="r", offset=56, shape=(sum(sizes),))
        ends = np.cumsum([0, *sizes])
        self.keys, self.to, self.out, self.final, self.starts, self.ids = (flat[a:b] for a, b in zip(ends, ends[1:]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that is not in the lexicon."""
        n = len(words)
        length = np.fromiter(map(len, words), "int64", n)
        flat = np.frombuffer(b"".join(words), dtype="uint8")
        start = np.cumsum(length) - length
        state = np.full(n, self.root, dtype="int64")
        number = np.zeros(n, dtype="int64")
        live = np.flatnonzero(length >= 0) if len(self.keys) else np.array([], "int64")
        at, top = 0, len(self.keys)
        done = length == 0
        while (live := live[length[live] > at]).size:
            key = state[live] << 8 | flat[start[live] + at]
            i = np.minimum(np.searchsorted(self.keys, key), top - 1)
            hit = self.keys[i] == key
            live, i = live[hit], i[hit]
            number[live] += self.out[i]
            state[live] = self.to[i]
            at += 1
            done[live] = length[live] == at
        known = done & (self.final[state] == 1) if len(self.final) else np.zeros(n, dtype=bool)
        return np.where(known, number, -1)
