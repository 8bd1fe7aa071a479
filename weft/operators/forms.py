"""Canonical forms of small coloured graphs, exact whatever their symmetry."""

from __future__ import annotations

from typing import Any


def refined(colour: list[int], rel: list[list[Any]]) -> list[int]:
    """Colours split by the colours and relations around each vertex until nothing splits any more."""
    n, now = len(colour), colour
    while True:
        sig = [(now[i], sorted((now[j], rel[i][j], rel[j][i]) for j in range(n) if j != i)) for i in range(n)]
        rank = {repr(s): k for k, s in enumerate(sorted(sig))}  # the place in order, so that classes of one colour stay together
        place = {s: k for k, s in enumerate(sorted(set(rank.values())))}
        new = [place[rank[repr(s)]] for s in sig]
        if len(set(new)) == len(set(now)):
            return new
        now = new


def _twins(u: int, v: int, rel: list[list[Any]]) -> bool:
    """Whether exchanging two vertices changes no relation."""
    return rel[u][u] == rel[v][v] and rel[u][v] == rel[v][u] and all(rel[u][x] == rel[v][x] and rel[x][u] == rel[x][v] for x in range(len(rel)) if x not in (u, v))


def least_order(colour: list[Any], rel: list[list[Any]]) -> list[int]:
    """The order of vertices whose relations, read row by row, are the least of all orders that refinement leaves open.

    ``colour`` and the relations ``rel[i][j]`` are comparable values; isomorphic graphs, and only those, read the same in their orders. A class
    that refinement doesn't split is split by singling out each of its vertices in turn, but only one of several twins.
    """
    place = {c: k for k, c in enumerate(sorted(set(colour)))}
    best: tuple[Any, list[int]] | None = None
    stack = [refined([place[c] for c in colour], rel)] if colour else []
    while stack:
        now = stack.pop()
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(now):
            groups.setdefault(c, []).append(i)
        open_ = next((groups[c] for c in sorted(groups) if len(groups[c]) > 1), None)
        if open_ is None:
            order = sorted(range(len(now)), key=now.__getitem__)
            form = [[rel[i][j] for j in order] for i in order]
            if best is None or form < best[0]:
                best = form, order
            continue
        tried: list[int] = []
        for v in open_:
            if not any(_twins(u, v, rel) for u in tried):
                tried.append(v)
                stack.append(refined([2 * c - (i == v) for i, c in enumerate(now)], rel))
    return best[1] if best else []
