"""Context-tree weighting over byte contexts: counting, weighting and scoring, in numpy.

A byte is decomposed into eight binary decisions.  A node of the tree is a context of the d most
recent bytes (0 <= d <= D) together with the bits of the present byte seen so far; it keeps how often
the next bit was 0 and 1.  The Krichevsky-Trofimov estimate of a node and the product of its children's
weighted probabilities are mixed half and half at every depth (Willems, Shtarkov and Tjalkens, 1995).

The functions here work on one array of counts.  ``lm_score`` deals the counts out over a cluster:
all nodes below one pair of most recent bytes depend on nothing outside that pair.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 by Stirling's series after a shift to x >= 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    small = y < 8
    while small.any():
        shift[small] -= np.log(y[small])
        y[small] += 1
        small = y < 8
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - 2 * 0.5723649429247001 - lgamma(n0 + n1 + 1.0)


def byte_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): for each byte, its context and itself as one integer.

    From the most significant byte: the most recent byte before it, the one before that, ... and last
    the byte itself, so that sorted keys are in the order of the context tree.  A text starts as if
    after ``depth`` newlines.
    """
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    pad = b"\n" * depth
    a = np.frombuffer(pad + pad.join(texts) if texts else b"", dtype=np.uint8)
    n = len(a) - depth
    if n <= 0:
        return np.zeros(0, np.uint64), lengths
    key = a[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        key |= a[depth - d : depth - d + n].astype(np.uint64) << _U(8 * (depth + 1 - d))
    # What lies over the padding between two texts is not a byte of any text.
    keep = np.ones(n, bool)
    ends = np.cumsum(lengths + depth)[:-1]
    for d in range(1, depth + 1):
        keep[ends - d] = False
    return key[keep], lengths


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]  # what was handed over can go
    del order
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _level(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context << 8 | 1 and the bits so far), zeros, ones; keys are context << 8 | byte."""
    ids, zeros, ones = [], [], []
    ctx, b = keys >> _U(8) << _U(8), keys & _U(255)
    for j in range(8):
        node = ctx | (_U(1) << _U(j)) | (b >> _U(8 - j))
        bit = (b >> _U(7 - j)) & _U(1)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ids.append(node[first])
        zeros.append(np.add.reduceat(np.where(bit == 0, counts, 0), first))
        ones.append(np.add.reduceat(np.where(bit == 1, counts, 0), first))
    i = np.concatenate(ids)
    order = np.argsort(i, kind="stable")
    return i[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, below=None):
    """Yield (d, nodes, zeros, ones, log Pw, stop) for d = depth ... top.

    keys: context of ``depth`` bytes << 8 | byte, distinct.  stop: the posterior weight of the node's
    own estimate against its children's.  below: (nodes, log Pw) of depth + 1, if that is known already.
    """
    for d in range(depth, top - 1, -1):
        if not len(keys):
            return
        node, n0, n1 = _level(keys, counts)
        pe = log_kt(n0.astype(np.float64), n1.astype(np.float64))
        if below is None:
            pw, stop = pe, np.ones(len(node))
        else:
            child, cw = below
            parent = child >> _U(16) << _U(8) | child & _U(255)
            kids = np.bincount(np.searchsorted(node, parent), weights=cw, minlength=len(node))
            pw = np.logaddexp(pe, kids) - np.log(2)
            stop = np.exp(np.minimum(0, pe - np.log(2) - pw))
        yield d, node, n0, n1, pw, stop
        below = node, pw
        if d > top:
            keys, counts = summed(keys >> _U(16) << _U(8) | keys & _U(255), counts)


def slots(d, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, tag) of nodes of one depth in a table: the nodes themselves, and their depth."""
    return node, np.full(len(node), d, np.uint8)


class Table:
    """All nodes put into it, by depth: the chance of a one and the weight of stopping there."""

    def __init__(self, depth: int):
        self.depth = depth
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))] * (depth + 1)

    def put(self, slot, tag, one, stop) -> None:
        """Nodes of one depth, ascending, that is all of that depth."""
        if len(slot):
            self.levels[int(tag[0])] = slot, one, stop

    def get(self, d: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the table has them, chance of a one, weight of stopping) of nodes of one depth."""
        slot, one, stop = self.levels[d]
        if not len(slot):
            return np.zeros(len(node), bool), np.zeros(len(node)), np.zeros(len(node))
        at = np.minimum(np.searchsorted(slot, node), len(slot) - 1)
        return slot[at] == node, one[at], stop[at]

    def log10_byte(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each key's byte after its context.

        The path goes from depth 0 as deep as training has seen the node; the deepest node counts
        with its own estimate.  Which nodes were seen depends on the context and the bits before
        only, so the chances of all 256 bytes add up to 1.
        """
        out, b = np.zeros(len(keys)), keys & _U(255)
        for j in range(8):
            tail = (_U(1) << _U(j)) | (b >> _U(8 - j))
            p, kt, stop, live = [], [], [], np.ones(len(keys), bool)
            for d in range(self.depth + 1):
                node = keys >> _U(8 * (self.depth + 1 - d)) << _U(8) | tail if d else tail
                found, one, s = self.get(d, node)
                live = live & found
                p.append(live)
                kt.append(one)
                stop.append(s)
                if not live.any():
                    break
            chance = np.full(len(keys), 0.5)
            deeper = np.zeros(len(keys), bool)
            for found, one, s in zip(reversed(p), reversed(kt), reversed(stop)):
                w = np.where(deeper, s, 1.0)
                chance = np.where(found, w * one + (1 - w) * chance, chance)
                deeper |= found
            bit = (b >> _U(7 - j)) & _U(1)
            out += np.log10(np.where(bit == 1, chance, 1 - chance))
        return out


def quantised(n0, n1, stop) -> tuple[np.ndarray, np.ndarray]:
    """What a table keeps of nodes, as doubles: the chance of a one and the weight of stopping."""
    return (n1 + 0.5) / (n0 + n1 + 1.0), np.clip(stop, 0, 1)
