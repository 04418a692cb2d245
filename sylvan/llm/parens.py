"""Balanced parentheses with a range min-max tree: the trie encoding of :mod:`prefixtrie`.

A tree in preorder is a bit vector, 1 where a node opens and 0 where it
closes. ``excess[i]`` is the number of opens less closes in bits 0..i; the
close of the node that opens at i is the first place behind i where the excess
falls to excess[i] - 1. Blocks of ``BLOCK`` bits keep their least excess, and
groups of ``FAN`` blocks (groups of groups, ...) theirs, so the search leaves a
block without looking at its bits. All queries of a tree run side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK, FAN = 64, 8


class BalancedParentheses:
    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        step = np.where(self.bits, 1, -1).astype(np.int64)
        self.excess = np.cumsum(step)
        n = len(bits)
        #: least excess of every block, of every group of blocks, ... up to one
        self.least: list[np.ndarray] = []
        level, width = self.excess, BLOCK
        while True:
            pad = -len(level) % width
            level = np.append(level, np.full(pad, n + 1)).reshape(-1, width).min(axis=1)
            self.least.append(level)
            if len(level) <= 1:
                break
            width = FAN
        #: opens and leaf pairs "()" at bits before i
        self.opens = np.append(0, np.cumsum(self.bits))
        self.pairs = np.append(0, np.cumsum(self.bits & ~np.append(self.bits[1:], True)))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Place of the close of every node that opens at ``at``."""
        want = self.excess[at] - 1
        pos, found = self._scan(at + 1, want, BLOCK)
        left = np.flatnonzero(~found)
        if len(left):
            spot, block = want[left], (pos[left] // BLOCK)
            block = self._next_block(block, spot)
            got, ok = self._scan(block * BLOCK, spot, BLOCK)
            if not ok.all():
                raise ValueError("parentheses are not balanced")
            pos[left] = got
        return pos

    def _scan(self, start, want, width):
        """First place from ``start`` to the end of its run of ``width`` with excess ``want``; the run's end if there is none."""
        pos = np.asarray(start, dtype=np.int64).copy()
        end = np.minimum((pos // width + 1) * width, len(self.excess))
        # a start that is the first bit of a run belongs to that run
        found = np.zeros(len(pos), dtype=bool)
        live = np.arange(len(pos))
        while len(live):
            live = live[pos[live] < end[live]]
            hit = self.excess[pos[live]] == want[live]
            found[live[hit]] = True
            live = live[~hit]
            pos[live] += 1
        return pos, found

    def _next_block(self, block, want):
        """The first block from ``block`` on whose least excess is ``want`` or below: up the tree, then down."""
        index, level = block.copy(), np.zeros(len(block), dtype=np.int64)
        done = np.zeros(len(block), dtype=bool)
        for k, least in enumerate(self.least):
            # along the siblings, and up when the next sibling lies under another parent
            here = np.flatnonzero(~done & (level == k))
            for _ in range(FAN + 1):
                if not len(here):
                    break
                if (index[here] >= len(least)).any():
                    raise ValueError("parentheses are not balanced")
                hit = least[index[here]] <= want[here]
                done[here[hit]] = True
                here = here[~hit]
                index[here] += 1
                up = index[here] % FAN == 0
                index[here[up]] //= FAN
                level[here[up]] = k + 1
                here = here[~up]
        for k in range(len(self.least) - 1, 0, -1):
            here = np.flatnonzero(level == k)
            index[here] *= FAN
            level[here] = k - 1
            while len(here):
                here = here[self.least[k - 1][index[here]] > want[here]]
                index[here] += 1
        return index
