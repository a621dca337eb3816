"""The decoders over flat lists of many sentences' phrases, with a constant time a question.

What competes for a pair (i, j), as ``parsing.competitors`` finds it, is the phrases between them that hang on j: all decoders attach
within what is closed, so chains from between i and j end at children of j. So each candidate keeps its children's context bits and
the sum of their weights, and a question looks nothing up. Heads and places are within sentences; phrases are numbers of the batch.
"""

from __future__ import annotations

from math import exp

import numpy as np

from lexiloom.sources import arrays as A

Bits = list  # of tuples of context bits, a phrase


def _sure(m: float) -> float:
    return 1 / (1 + exp(-max(-700.0, min(700.0, m))))


def _taken(bits: tuple, mask: int, total: float, w: list[float]) -> tuple[int, float]:
    for c in bits:
        if not mask >> c & 1:
            mask |= 1 << c
            total += w[6 + c]
    return mask, total


def linear(ends: list[int], lft: list, rgt: list, before: list, opens: list, ctx: Bits, w: list[float]) -> tuple[list, list]:
    heads, probs = [-1] * ends[-1], [0.0] * ends[-1]
    for a, b in zip(ends[:-1], ends[1:]):
        stack: list[int] = []
        for j in range(a + 1, b - 1):
            stack.append(j - 1)
            mask, more = 0, 0.0
            while stack:
                i = stack[-1]
                far, inside = j - i, opens[j] - before[i]
                p = probs[i] = _sure(lft[i] + rgt[j] + (w[0 if far == 1 else 1 if far < 6 else 2] + w[3 if inside > 0 else 4 if inside < 0 else 5] + more))
                if p <= 0.5:
                    break
                heads[i] = j - a
                stack.pop()
                if ctx[i]:
                    mask, more = _taken(ctx[i], mask, more, w)
        for i in [*stack, b - 2] if b - a > 1 else ():
            heads[i] = b - 1 - a
    return heads, probs


def chunking(ends: list[int], lft: list, rgt: list, before: list, opens: list, ctx: Bits, w: list[float]) -> tuple[list, list]:
    heads, probs = [-1] * ends[-1], [0.0] * ends[-1]
    mask, more = [0] * ends[-1], [0.0] * ends[-1]
    for a, b in zip(ends[:-1], ends[1:]):
        left = list(range(a, b - 1))
        while left:
            j = left[-1]
            heads[j], probs[j] = b - 1 - a, 0.0
            gone, following = set(), True
            for k in range(len(left) - 2, -1, -1):
                i = left[k]
                far, inside = j - i, opens[j] - before[i]
                p = probs[i] = _sure(lft[i] + rgt[j] + (w[0 if far == 1 else 1 if far < 6 else 2] + w[3 if inside > 0 else 4 if inside < 0 else 5] + more[j]))
                if p > 0.5:
                    heads[i] = j - a
                if heads[i] == -1:
                    if following:
                        gone.add(j)
                    following = False
                else:
                    following = True
                j = i
            if heads[left[0]] != -1:
                gone.add(left[0])
            for g in gone:
                if ctx[g]:
                    h = heads[g] + a
                    mask[h], more[h] = _taken(ctx[g], mask[h], more[h], w)
            left = [x for x in left if x not in gone]
    return heads, probs


def backward(ends: list[int], lft: list, rgt: list, before: list, opens: list, ctx: Bits, w: list[float]) -> tuple[list, list]:
    heads, probs = [-1] * ends[-1], [0.0] * ends[-1]
    mask, more = [0] * ends[-1], [0.0] * ends[-1]
    for a, b in zip(ends[:-1], ends[1:]):
        for i in range(b - 2, a - 1, -1):
            j, best, top = i + 1, -1, 0.0
            l, start = lft[i], before[i]  # noqa: E741
            while True:
                far, inside = j - i, opens[j] - start
                p = _sure(l + rgt[j] + (w[0 if far == 1 else 1 if far < 6 else 2] + w[3 if inside > 0 else 4 if inside < 0 else 5] + more[j]))
                if p > top:
                    best, top = j, p
                if heads[j] == -1:
                    break
                j = heads[j] + a
            heads[i], probs[i] = best - a, top
            if ctx[i]:
                mask[best], more[best] = _taken(ctx[i], mask[best], more[best], w)
    return heads, probs


def tournament(ends: list[int], lft: list, rgt: list, before: list, opens: list, ctx: Bits, w: list[float], far_side: list, w2: list[float]) -> tuple[list, list]:
    heads, probs = [-1] * ends[-1], [0.0] * ends[-1]
    mask, more, more2 = [0] * ends[-1], [0.0] * ends[-1], [0.0] * ends[-1]
    for a, b in zip(ends[:-1], ends[1:]):
        for i in range(b - 2, a - 1, -1):
            best = j = i + 1
            l, start, p = lft[i], before[i], 0.0  # noqa: E741
            near = None
            while heads[j] != -1:
                j = heads[j] + a
                if near is None:
                    far, inside = best - i, opens[best] - start
                    near = l + rgt[best] + (w[0 if far == 1 else 1 if far < 6 else 2] + w[3 if inside > 0 else 4 if inside < 0 else 5] + more[best])
                far, inside = j - i, opens[j] - start
                p = _sure(near + far_side[j] + (w2[0 if far == 1 else 1 if far < 6 else 2] + w2[3 if inside > 0 else 4 if inside < 0 else 5] + more2[j]))
                if p > 0.5:
                    best, near = j, None
            heads[i], probs[i] = best - a, p
            for c in ctx[i]:
                if not mask[best] >> c & 1:
                    mask[best] |= 1 << c
                    more[best] += w[6 + c]
                    more2[best] += w2[6 + c]
    return heads, probs


DECODERS = {"linear": linear, "chunking": chunking, "backward": backward, "tournament": tournament}


def decoded(strategy: str, sizes: np.ndarray, sides: list[np.ndarray], before: np.ndarray, opens: np.ndarray, ctx: Bits, whole: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(heads, probabilities) of consecutive sentences of so many phrases by a linear model: the sums of the phrases' sides (lft, rgt and
    for the tournament far), brackets up to and before each phrase, its context bits, and the weights of pairs as a whole."""
    if not len(before):
        return np.zeros(0, np.int32), np.zeros(0)
    more = [sides[2].tolist(), whole[1]] if strategy == "tournament" else []
    h, p = DECODERS[strategy](A.starts(sizes).tolist(), sides[0].tolist(), sides[1].tolist(), before.tolist(), opens.tolist(), ctx, whole[0], *more)
    return np.array(h, np.int32), np.array(p, np.float64)


def gold(strategy: str, sizes: np.ndarray, heads: np.ndarray, ctx: Bits | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """(questions a sentence, i, j, y, competitors' bits) of the decisions that gold heads lead to, as ``parsing.gold_events`` gives
    them, phrases by number of the batch; bits only with ``ctx``."""
    counts, i, j, y, bits = _GOLD[strategy](A.starts(sizes).tolist(), heads.tolist(), ctx)
    i, j = (np.concatenate(x) if x and isinstance(x[0], np.ndarray) else np.array(x, np.int64) for x in (i, j))
    y = np.concatenate(y) if y and isinstance(y[0], np.ndarray) else np.array(y, bool)
    return np.array(counts, np.int64), i.astype(np.int64), j.astype(np.int64), np.where(y, 1, -1).astype(np.int32), bits


def _union(old: tuple, new: tuple) -> tuple:
    return tuple(sorted({*old, *new}))


def _gold_linear(ends: list[int], gold: list[int], ctx: Bits | None):
    counts, out_i, out_j, out_y, bits = [], [], [], [], []
    for a, b in zip(ends[:-1], ends[1:]):
        stack: list[int] = []
        was = len(out_i)
        for j in range(a + 1, b - 1):
            stack.append(j - 1)
            seen: tuple = ()
            while stack:
                i = stack[-1]
                y = gold[i] == j - a
                out_i.append(i)
                out_j.append(j)
                out_y.append(y)
                if ctx is not None:
                    bits.append(seen)
                    if ctx[i]:
                        seen = _union(seen, ctx[i])
                if not y:
                    break
                stack.pop()
        counts.append(len(out_i) - was)
    return counts, out_i, out_j, out_y, bits


def _gold_backward(ends: list[int], gold: list[int], ctx: Bits | None):
    counts, out_i, out_j, out_y, bits = [], [], [], [], []
    found = [-1] * ends[-1]
    own: list[tuple] = [()] * ends[-1] if ctx is not None else []
    for a, b in zip(ends[:-1], ends[1:]):
        chain: list[int] = []
        was = len(out_i)
        for i in range(b - 2, a - 1, -1):
            # The next phrase and its chain of heads, nearest last.
            h = found[i + 1]
            while chain and chain[-1] != h:
                chain.pop()
            chain.append(i + 1)
            g = gold[i] + a if gold[i] >= 0 else -1
            out_i += [i] * len(chain)
            out_j += chain[::-1]
            if ctx is not None:
                bits += [own[x] for x in reversed(chain)]
            if g in chain:
                y = [False] * len(chain)
                y[len(chain) - 1 - chain.index(g)] = True
                out_y += y
                found[i] = g
                if ctx is not None and ctx[i]:
                    own[g] = _union(own[g], ctx[i])
            else:
                out_y += [False] * len(chain)
        counts.append(len(out_i) - was)
    return counts, out_i, out_j, out_y, bits


def _gold_chunking(ends: list[int], gold: list[int], ctx: Bits | None):
    counts, out_i, out_j, out_y, bits = [], [], [], [], []
    all_gold = np.array(gold, np.int64)
    for a, b in zip(ends[:-1], ends[1:]):
        n, asked = b - a, 0
        left, want, head = np.arange(n - 1), all_gold[a:b], np.full(n, -1)
        own: list[tuple] = [()] * n if ctx is not None else []
        while len(left):
            i, j = left[:-1], left[1:]
            y = want[i] == j
            head[left[-1]] = n - 1
            head[i[y]] = j[y]
            out_i.append(i[::-1] + a)
            out_j.append(j[::-1] + a)
            out_y.append(y[::-1])
            asked += len(i)
            if ctx is not None:
                bits += [own[x] for x in j[::-1]]
            # A phrase leaves once attached, unless its left neighbour is, too.
            has = head[left] != -1
            gone = has.copy()
            gone[1:] &= ~has[:-1]
            if ctx is not None:
                for g in left[gone].tolist():
                    own[head[g]] = _union(own[head[g]], ctx[a + g])
            left = left[~gone]
        counts.append(asked)
    return counts, out_i, out_j, out_y, bits


_GOLD = {"linear": _gold_linear, "backward": _gold_backward, "chunking": _gold_chunking}
