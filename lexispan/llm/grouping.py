"""Suffix sorting by linear grouping.

Phase one sorts the suffixes into groups of equal Lyndon prefix. Groups are taken from the greatest to the
smallest. For each suffix of the group at hand the previous smaller suffix is found by following the pointers of
suffixes handled before; that suffix's prefix is followed by this group's, once or several times in a row, so it
moves to a new group right above its old one, the higher the more repeats. Phase two walks through the order from
its start and puts the suffixes in front of each placed one, along the pointers, into the next free seats of
their groups. Nothing is renamed and no smaller problem is solved.
"""

from __future__ import annotations


def lyndon_groups(data: bytes) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes in ascending order, the end mark's first, and the pointers to previous smaller suffixes."""
    n = len(data)
    by_byte: dict[int, list[int]] = {}
    for i, c in enumerate(data):
        by_byte.setdefault(c, []).append(i)
    members = [[n], *(by_byte[c] for c in sorted(by_byte))]  # position n is an end mark below all bytes
    group = [0] * (n + 1)
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    # groups form a chain: lower[g] and upper[g] are its neighbours, -1 at the ends
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    handled = bytearray(len(members))
    before = [-1] * (n + 1)
    order: list[list[int]] = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]  # those that moved on are left behind here
        handled[g] = 1
        if own:
            order.append(own)
        # pointers to the nearest suffix before that isn't greater; handled groups are jumped over
        inner = False
        for i in own:
            p = i - 1
            while p >= 0 and handled[at := group[p]] and at != g:
                p = before[p]
            before[i] = p
            if p >= 0 and group[p] == g:
                inner = True
        if inner:
            # runs of this group's prefix: all of a run point to the suffix before its first
            first: dict[int, int] = {}
            runs: dict[int, int] = {}
            for i in sorted(own):
                p = before[i]
                root = first[p] if p >= 0 and group[p] == g else i
                first[i] = root
                runs[root] = runs.get(root, 0) + 1
            for i, root in first.items():
                before[i] = before[root]
            ends = [(before[root], k) for root, k in runs.items()]
        else:
            ends = [(before[i], 1) for i in own]
        moves: dict[int, dict[int, list[int]]] = {}
        for p, k in ends:
            if p >= 0:
                moves.setdefault(group[p], {}).setdefault(k, []).append(p)
        for old, by_count in moves.items():
            for k in sorted(by_count, reverse=True):  # the least repeats end up right above the old group
                new, over = len(members), upper[old]
                members.append(by_count[k])
                handled.append(0)
                lower.append(old)
                upper.append(over)
                upper[old] = new
                if over >= 0:
                    lower[over] = new
                for p in by_count[k]:
                    group[p] = new
        g = lower[g]
    order.reverse()
    return order, before


def suffix_array(data: bytes) -> list[int]:
    """Starts of the suffixes of data in ascending order."""
    groups, before = lyndon_groups(data)
    n = len(data)
    seat, start = [0] * (n + 1), 0
    free = []
    for k, own in enumerate(groups):
        free.append(start)
        for i in own:
            seat[i] = k
        start += len(own)
    out, placed = [-1] * (n + 1), bytearray(n + 1)
    out[0], placed[n] = n, 1
    for at in range(n + 1):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            k = seat[j]
            out[free[k]] = j
            free[k] += 1
            placed[j] = 1
            j = before[j]
    return out[1:]
