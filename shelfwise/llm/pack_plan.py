"""Shortest-pack-first over a histogram of lengths: a plan of packs with no rows in it.

Lengths are placed from the longest to the shortest. Each copy goes to the open pack with the
most room (the shortest pack); a pack is opened only where none has room. Packs of equal contents
are one group with a count, so a length updates counts instead of packs, and the work and
the plan depend on the number of different lengths alone, not on the number of documents.

Each pack offers a length places at its room, its room less one length, and so on; taking
the c greatest offers is what placing c copies one by one gives. Every length splits one
group at most and opens two at most, so there are fewer than 3 * capacity groups, and a pack holds
fewer than sqrt(2 * capacity) different lengths: a plan for 2,048 tokens has less than
400,000 entries, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Group:
    """``count`` packs of the same contents: (length, copies) from the longest on."""

    room: int
    count: int
    items: tuple

    def with_copies(self, length: int, copies: int, count: int) -> Group:
        """``count`` of these packs with so many copies more."""
        added = (*self.items, (length, copies)) if copies else self.items
        return Group(self.room - copies * length, count, added)


def _offers(rooms: np.ndarray, length: int, floor: int) -> np.ndarray:
    """How many copies each pack takes at a room of ``floor`` or more (length at least)."""
    return np.maximum(0, (rooms - max(floor, length)) // length + 1)


def _place(groups: list[Group], length: int, copies: int) -> tuple[list[Group], int]:
    """The groups after placing what fits, and the copies left over."""
    rooms = np.array([g.room for g in groups], np.int64)
    counts = np.array([g.count for g in groups], np.int64)

    def taken(floor: int) -> int:
        return int((_offers(rooms, length, floor) * counts).sum())

    if not groups or taken(length) <= copies:
        each = _offers(rooms, length, length).tolist()
        out = [g.with_copies(length, n, g.count) for g, n in zip(groups, each)]
        return out, copies - (taken(length) if groups else 0)
    low, high = length, int(rooms.max()) + 1  # taken(low) > copies >= taken(high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if taken(middle) > copies else (low, middle)
    sure, last = _offers(rooms, length, high).tolist(), _offers(rooms, length, low).tolist()
    left, out = copies - taken(high), []
    for group, n, more in zip(groups, sure, last):
        extra = min(left, group.count) if more > n else 0
        left -= extra
        if extra:
            out.append(group.with_copies(length, n + 1, extra))
        if group.count > extra:
            out.append(group.with_copies(length, n, group.count - extra))
    return out, 0


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Group]:
    """The groups of packs that hold every length of the histogram exactly as often as it says."""
    opened: list[Group] = []
    closed: list[Group] = []
    for length in sorted(histogram, reverse=True):
        opened, left = _place(opened, length, histogram[length])
        most = capacity // length
        whole, rest = divmod(left, most)
        empty = Group(capacity, 0, ())
        opened += [empty.with_copies(length, n, c) for n, c in ((most, whole), (rest, 1)) if n * c]
        closed += [g for g in opened if not g.room]
        opened = [g for g in opened if g.room]
    return closed + opened
