"""Which categorical factors of a term need full-rank coding, so that no column is redundant."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Sequence
from itertools import combinations


def codings(factors: Sequence[Hashable], used: set[frozenset]) -> list[dict[Hashable, bool]]:
    """For each part of a term: factor -> coded in full.

    The term spans the space of all subsets of its factors, each in reduced
    form. Subsets that earlier terms span already (``used``) are left out; of
    the rest, a subset and the same subset with one more reduced factor merge
    into one with that factor in full.
    """
    subsets = [s for size in range(len(factors) + 1) for s in combinations(factors, size) if frozenset(s) not in used]
    used.update(map(frozenset, subsets))
    # A part is a pair of bit sets: factors that it holds, and those of them in full. Parts never coincide.
    bits = {f: 1 << k for k, f in enumerate(factors)}
    parts: dict[tuple[int, int], int] = {(sum(bits[f] for f in s), 0): place for place, s in enumerate(subsets)}
    waiting: list[tuple] = []

    def note(part: tuple[int, int], *, shorter: bool) -> None:
        """Queue merges of a part with later ones of one reduced factor more (and with earlier ones of one less)."""
        held, full = part
        for bit in bits.values():
            pairs = [] if held & bit else [(part, (held | bit, full))]
            if shorter and held & bit and not full & bit:
                pairs.append(((held & ~bit, full), part))
            for short, long in pairs:
                if short in parts and long in parts and parts[short] < parts[long]:
                    heapq.heappush(waiting, (parts[short], parts[long], short, long, bit))

    for part in list(parts):
        note(part, shorter=False)
    # The first part that can merge does so with the first one that it can.
    while waiting:
        i, j, short, long, bit = heapq.heappop(waiting)
        if parts.get(short) == i and parts.get(long) == j:
            del parts[short], parts[long]
            merged = long[0], long[1] | bit
            parts[merged] = j
            note(merged, shorter=True)
    return [{f: bool(full & bits[f]) for f in subsets[place]} for (_, full), place in sorted(parts.items(), key=lambda p: p[1])]
