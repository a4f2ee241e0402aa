"""Pivot lattice trees over integer points, lower values better, and layers of points by one such tree a layer.

A tree holds points of which none dominates another. Its pivot is a balanced one of them; every other point has a bit mask
that says in which measures it is not better than the pivot. Points of mask m can be dominated only by points whose mask is
a subset of m, so that all other pairs of classes are skipped; a class is a tree again.
"""

from __future__ import annotations

import numpy as np

#: Points that a leaf compares one by one.
LEAF = 48


class Tree:
    """``pivot`` and ``children`` by mask, or the points of a leaf."""

    __slots__ = ("children", "pivot", "points")

    def __init__(self, points: np.ndarray | None = None, pivot: np.ndarray | None = None):
        self.points, self.pivot, self.children = points, pivot, []

    def dominates(self, rows: np.ndarray) -> np.ndarray:
        """For each row, whether some point of the tree dominates it."""
        hit = np.zeros(len(rows), bool)
        if not len(rows):
            return hit
        if self.pivot is None:
            return _dominated_by(self.points, rows)
        masks, all_bits = _masks(rows, self.pivot), (1 << rows.shape[1]) - 1
        hit[masks == all_bits] = (rows[masks == all_bits] > self.pivot).any(axis=1)
        for mask, child in self.children:
            # A row of the pivot's values has all bits; what would dominate it would dominate the pivot too.
            open_ = np.flatnonzero(~hit & (masks & mask == mask) & (masks != all_bits))
            if len(open_):
                hit[open_] = child.dominates(rows[open_])
        return hit


def _dominated_by(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(rows), bool)
    for p in points:
        hit |= (p <= rows).all(axis=1) & (p < rows).any(axis=1)
    return hit


def _masks(rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return ((rows >= pivot) << np.arange(rows.shape[1])).sum(axis=1)


def _balanced(rows: np.ndarray) -> int:
    """The undominated row whose measures, scaled, differ least from each other."""
    low = rows.min(axis=0)
    scaled = (rows - low) / np.maximum(rows.max(axis=0) - low, 1)
    at = int(np.argmin(np.ptp(scaled, axis=1) + 1e-9 * scaled.sum(axis=1)))
    above = np.flatnonzero((rows <= rows[at]).all(axis=1))
    return int(above[np.argmin(rows[above].sum(axis=1))])


def skyline(rows: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the undominated ones among distinct rows, and which rows they are."""
    if len(rows) <= LEAF:
        weak = (rows[:, None, :] <= rows[None, :, :]).all(axis=2)
        np.fill_diagonal(weak, False)  # rows are distinct: not worse anywhere is better somewhere
        keep = ~weak.any(axis=0)
        return Tree(points=rows[keep]), keep
    at = _balanced(rows)
    tree, keep = Tree(pivot=rows[at]), np.zeros(len(rows), bool)
    keep[at] = True
    masks, all_bits = _masks(rows, rows[at]), (1 << rows.shape[1]) - 1
    for mask in sorted(set(np.unique(masks).tolist()) - {all_bits}, key=lambda m: (m.bit_count(), m)):
        own = np.flatnonzero(masks == mask)
        for below, child in tree.children:
            if below & mask == below:
                own = own[~child.dominates(rows[own])]
        if len(own):
            child, kept = skyline(rows[own])
            tree.children.append((mask, child))
            keep[own[kept]] = True
    return tree, keep


def ranked(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables with each measure replaced by its rank among all values: comparisons stay, scales become alike."""
    both = np.concatenate(tables)
    ranks = np.stack([np.unique(both[:, k], return_inverse=True)[1] for k in range(both.shape[1])], axis=1).astype(np.int32).reshape(both.shape)
    return np.split(ranks, np.cumsum([len(t) for t in tables])[:-1])


def raise_levels(rows: np.ndarray, levels: np.ndarray, most: int) -> np.ndarray:
    """The least levels not below the given ones at which every dominated row is above what dominates it; up to most + 1.

    With levels of 1 these are the layers: a tree of each level's undominated rows in turn; what it dominates goes up.
    """
    levels = levels.copy()
    rows = ranked(rows)[0] if len(rows) else rows
    for level in range(1, most + 1):
        own = np.flatnonzero(levels == level)
        if not len(own):
            continue
        tree, keep = skyline(rows[own])
        levels[own[~keep]] = level + 1
        under = np.flatnonzero(levels < level)
        levels[under[tree.dominates(rows[under])]] = level + 1
    return levels


def raise_from(source: np.ndarray, source_levels: np.ndarray, rows: np.ndarray, levels: np.ndarray, most: int) -> np.ndarray:
    """Levels of ``rows`` raised above every source row that dominates them; sources of the highest level first."""
    levels = levels.copy()
    source, rows = ranked(source, rows)
    for level in range(most, 0, -1):
        under, own = np.flatnonzero(levels <= level), np.flatnonzero(source_levels == level)
        if len(own) and len(under):
            levels[under[skyline(source[own])[0].dominates(rows[under])]] = level + 1
    return levels
