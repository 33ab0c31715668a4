"""Recursive graph bisection: an order of documents in which those that share terms stand together.

A node's documents are halved, and pairs are swapped between the halves as long as that lowers the cost of the halves' posting lists
(each term costs the logarithm of its mean gap, once a document); then each half is halved in turn."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Term numbers of documents laid end to end; document k has those from at[k] up to at[k + 1]."""

    at: np.ndarray
    terms: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        size = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(size)])
        return Rows(at, self.terms[np.repeat(self.at[which] - at[:-1], size) + np.arange(at[-1])])

    def sums(self, of_term: np.ndarray) -> np.ndarray:
        """The sum of of_term over each document's terms."""
        total = np.concatenate([[0.0], np.cumsum(of_term[self.terms])])
        return total[self.at[1:]] - total[self.at[:-1]]


def _cost(n: np.ndarray, size: int) -> np.ndarray:
    return n * np.log2(max(size, 1) / (n + 1.0))


def _degrees(rows: Rows, right: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    side = np.repeat(right, np.diff(rows.at))
    every = np.bincount(rows.terms, minlength=n_terms).astype(float)
    b = np.bincount(rows.terms[side], minlength=n_terms).astype(float)
    return every - b, b


def halves(rows: Rows, n_terms: int, rounds: int = 12) -> np.ndarray:
    """Which documents go to the right half; the halves differ by one document at most."""
    n = len(rows.at) - 1
    right = np.arange(n) >= n // 2
    sizes = n // 2, n - n // 2
    for _ in range(rounds):
        a, b = _degrees(rows, right, n_terms)
        now = _cost(a, sizes[0]) + _cost(b, sizes[1])
        to_right = now - _cost(np.maximum(a - 1, 0), sizes[0]) - _cost(b + 1, sizes[1])
        to_left = now - _cost(a + 1, sizes[0]) - _cost(np.maximum(b - 1, 0), sizes[1])
        gain = np.where(right, rows.sums(to_left), rows.sums(to_right))
        l, r = np.flatnonzero(~right), np.flatnonzero(right)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        k = min(len(l), len(r))
        swaps = int((gain[l[:k]] + gain[r[:k]] > 1e-9).sum())
        if not swaps:
            break
        right[l[:swaps]], right[r[:swaps]] = True, False
    return right


def order(rows: Rows, leaf: int) -> np.ndarray:
    """The documents in their new order; the recursion ends at `leaf` documents."""
    n = len(rows.at) - 1
    out, todo = [], [np.arange(n)]
    while todo:
        docs = todo.pop()
        if len(docs) <= leaf:
            out.append(docs)
            continue
        own = rows.take(docs)
        names, own.terms = np.unique(own.terms, return_inverse=True)
        right = halves(own, len(names))
        todo += [docs[right], docs[~right]]  # the left half comes off first
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tree(rows: Rows, n_terms: int, leaf: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Nodes of the recursion by number (the root 1, the children of k 2k and 2k+1): terms, and what each adds for the right half."""
    out, todo = {}, [(1, np.arange(len(rows.at) - 1))]
    while todo:
        node, docs = todo.pop()
        if len(docs) <= leaf:
            continue
        own = rows.take(docs)
        right = halves(own, n_terms)
        a, b = _degrees(own, right, n_terms)
        sizes = int((~right).sum()), int(right.sum())
        gain = (_cost(a + 1, sizes[0]) - _cost(a, sizes[0])) - (_cost(b + 1, sizes[1]) - _cost(b, sizes[1]))
        told = np.flatnonzero(a + b)
        out[node] = told, gain[told]
        todo += [(2 * node, docs[~right]), (2 * node + 1, docs[right])]
    return out


def routed(rows: Rows, nodes: dict[int, tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """The leaf of each document: at each node it joins the half whose lists it makes longer by less; alike documents go alike ways."""
    at = np.ones(len(rows.at) - 1, np.int64)
    todo = [1] if 1 in nodes else []
    while todo:
        node = todo.pop()
        docs = np.flatnonzero(at == node)
        if not len(docs):
            continue
        gain = np.zeros(n_terms)
        gain[nodes[node][0]] = nodes[node][1]
        at[docs] = 2 * node + (rows.take(docs).sums(gain) > 1e-9)
        todo += [child for child in (2 * node, 2 * node + 1) if child in nodes]
    return at
