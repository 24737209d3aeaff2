"""A semi-Markov conditional random field over candidate segments.

A line is segmented in candidate items and the text between them; the score of a
segmentation sums the weights of each item's whole-span features and of the change from
the item before it. Items have bounded length (their grammar's), so decoding is a
dynamic programme over the candidates in order of their ends.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pairloom.llm.spans import KINDS, Span

START = len(KINDS)


def _sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class SemiCRF:
    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.w = dict(weights or {})

    def score(self, c: Span) -> float:
        w = self.w
        return sum(w.get(f, 0.0) for f in c.features)

    def change(self, before: int, kind: int) -> float:
        return self.w.get(f"t={before},{kind}", 0.0)

    def decode(self, spans: list[Span]) -> list[Span]:
        """The best set of items that do not overlap; ``spans`` in order of their ends.

        For each type of the item before, the best path that ends early enough is a prefix
        maximum found by bisection, so a line costs n log n.
        """
        if not spans:
            return []
        ends = [c.end for c in spans]
        back: list[int] = []
        tops: list[list[tuple[float, int]]] = [[(-math.inf, -1)] for _ in KINDS]  # per type: best path among the first i items
        best: list[float] = []
        for i, c in enumerate(spans):
            early = bisect_right(ends, c.start, 0, i)
            top, arg = self.change(START, c.kind), -1
            for k, t in enumerate(tops):
                v, j = t[early]
                if j >= 0 and (v := v + self.change(k, c.kind)) > top:
                    top, arg = v, j
            best.append(top + self.score(c))
            back.append(arg)
            for k, t in enumerate(tops):
                t.append((best[i], i) if k == c.kind and best[i] > t[-1][0] else t[-1])
        i = max(range(len(spans)), key=best.__getitem__)
        if best[i] <= 0:
            return []
        out = []
        while i >= 0:
            out.append(spans[i])
            i = back[i]
        return out[::-1]

    def _expectations(self, spans: list[Span]):
        """Log partition and how probable each item and each change is."""
        n = len(spans)
        s = [self.score(c) for c in spans]
        before = [[j for j in range(i) if spans[j].end <= c.start] for i, c in enumerate(spans)]
        fwd = [0.0] * n
        for i, c in enumerate(spans):
            fwd[i] = s[i] + _sum([self.change(START, c.kind), *(fwd[j] + self.change(spans[j].kind, c.kind) for j in before[i])])
        z = _sum([0.0, *fwd])
        bwd = [0.0] * n
        after: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in before[i]:
                after[j].append(i)
        for i in range(n - 1, -1, -1):
            bwd[i] = _sum([0.0, *(self.change(spans[i].kind, spans[k].kind) + s[k] + bwd[k] for k in after[i])])
        node = [math.exp(fwd[i] + bwd[i] - z) for i in range(n)]
        edge: dict[str, float] = {}
        for i, c in enumerate(spans):
            f = f"t={START},{c.kind}"
            edge[f] = edge.get(f, 0.0) + math.exp(self.change(START, c.kind) + s[i] + bwd[i] - z)
            for j in before[i]:
                f = f"t={spans[j].kind},{c.kind}"
                edge[f] = edge.get(f, 0.0) + math.exp(fwd[j] + self.change(spans[j].kind, c.kind) + s[i] + bwd[i] - z)
        return z, node, edge

    def fit(self, lines: list[tuple[list[Span], set[tuple[int, int, int]]]], rounds: int = 8, rate: float = 0.1, decay: float = 1e-3) -> SemiCRF:
        """Maximum likelihood by AdaGrad; each line is its candidates and the true (start, end, kind)."""
        seen: dict[str, float] = {}
        for _ in range(rounds):
            for spans, gold in lines:
                if not spans:
                    continue
                _, node, edge = self._expectations(spans)
                grad: dict[str, float] = {f: -v for f, v in edge.items()}
                last = START
                for c, p in zip(spans, node):
                    true = (c.start, c.end, c.kind) in gold
                    if true:
                        f = f"t={last},{c.kind}"
                        grad[f] = grad.get(f, 0.0) + 1.0
                        last = c.kind
                    for f in c.features:
                        grad[f] = grad.get(f, 0.0) + true - p
                for f, g in grad.items():
                    g -= decay * self.w.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-8) + g * g
                    self.w[f] = self.w.get(f, 0.0) + rate * g / math.sqrt(seen[f])
        return self
