"""Two-stage suffix sorting of many short strings at once, to a bounded depth.

A suffix that is smaller than its successor (the suffix one byte on) is sorted directly; every other one is induced: scanning the buckets
of first bytes in order, each suffix met puts the one before it, if that is the larger, next in the bucket of its own first byte.
Both stages work on whole NumPy arrays, a bucket at a time.
"""

from __future__ import annotations

import numpy as np

#: Bytes that a repeat has at least.
REPEAT = 50


def _keys(text: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there as one big-endian number; the text is taken to end in eight zero bytes or more."""
    two = text[:-1].astype("u2") << np.uint16(8) | text[1:]
    four = two[:-2].astype("u4") << np.uint32(16) | two[2:]
    return four[:-4].astype("u8") << np.uint64(32) | four[4:]


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; of equal bytes in a row all do as the last, and the last byte's suffix is not."""
    step = np.zeros(len(text), "i2")
    step[:-1] = text[1:].astype("i2") - text[:-1]
    step[-1] = -1
    place = np.where(step != 0, np.arange(len(text), dtype="i4"), np.int32(len(text) - 1))
    follow = np.minimum.accumulate(place[::-1])[::-1]
    return step[follow] > 0


def direct_sort(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` in order of their first ``depth`` bytes: by eight bytes, then tied ones by five more at a time."""
    if not len(at):
        return at
    first = keys[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    group = np.cumsum(np.r_[False, first[1:] != first[:-1]])
    done = 8
    while done < depth:
        same = np.zeros(len(at), bool)
        same[1:] = group[1:] == group[:-1]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        local = np.cumsum(np.r_[False, group[tied][1:] != group[tied][:-1]])
        if local[-1] < 1 << 24:
            mixed = local.astype("u8") << np.uint64(40) | keys[at[tied] + done] >> np.uint64(24)
            order = np.argsort(mixed, kind="stable")
            mixed = mixed[order]
            change = np.r_[True, mixed[1:] != mixed[:-1]]
            step = 5
        else:
            more = keys[at[tied] + done]
            order = np.lexsort((more, local))
            more, local = more[order], local[order]
            change = np.r_[True, (more[1:] != more[:-1]) | (local[1:] != local[:-1])]
            step = 8
        at[tied] = at[tied][order]
        starts = np.r_[True, ~same[1:]]  # of groups so far; new ones start where tied suffixes differ
        starts[tied] = change
        group = np.cumsum(starts) - 1
        done += step
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = REPEAT, keys: np.ndarray | None = None) -> np.ndarray:
    """The places of ``wanted`` (a mask) in the order of their suffixes' first ``depth`` bytes.

    ``text`` has under 2^31 bytes and ends in at least ``depth`` + 16 zero bytes that are not wanted.
    """
    keys = _keys(text) if keys is None else keys
    up = rising(text)
    # The chain from a wanted suffix to the next rising one is sorted too, as the order of each rests on its successor.
    n = len(text)
    place = np.where(up, np.arange(n, dtype="i4"), np.int32(n - 1))
    until = np.minimum.accumulate(place[::-1])[::-1]
    del place
    cover = np.zeros(n + 1, "i4")
    at = np.flatnonzero(wanted)
    np.add.at(cover, at, 1)
    np.add.at(cover, until[at] + 1, -1)
    chosen = np.cumsum(cover[:-1], dtype="i4") > 0
    del cover, until, at
    seeds = direct_sort(np.flatnonzero(chosen & up).astype("i4"), keys, depth)
    # The text's end stands for all falling suffixes at it: none of them are wanted, and the zeros there sort first.
    bounds = np.searchsorted(text[seeds], np.arange(257))
    falling = chosen & ~up
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if falling[n - 1]:
        queues[int(text[n - 1])].append(np.array([n - 1], "i4"))
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Queue the falling suffixes before ``found``; return those of the same first byte, which come next."""
        before = found[found > 0] - 1
        before = before[falling[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        again = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            if first[a] == byte:
                again = before[a:b]
            else:
                queues[first[a]].append(before[a:b])
        return again

    for byte in range(256):
        found = np.concatenate(queues[byte]) if queues[byte] else seeds[:0]
        while len(found):
            out.append(found)
            found = induce(found, byte)
        found = seeds[bounds[byte] : bounds[byte + 1]]
        if len(found):
            out.append(found)
            induce(found, byte)
    whole = np.concatenate(out) if out else seeds
    return whole[wanted[whole]]


def common(order: np.ndarray, keys: np.ndarray, depth: int = REPEAT) -> np.ndarray:
    """For each suffix of ``order``, whether it and the one before it have their first ``depth`` bytes in common."""
    out = np.zeros(len(order), bool)
    if len(order) > 1:
        out[1:] = True
        for step in range(0, depth, 8):
            back = np.uint64(8 * max(0, step + 8 - depth))
            live = np.flatnonzero(out)
            out[live] = keys[order[live] + step] >> back == keys[order[live - 1] + step] >> back
    return out


def smallest_owner(joined: bytes, lengths: np.ndarray, owners: np.ndarray, repeat: int = REPEAT) -> np.ndarray:
    """Of strings end to end, for each place at which ``repeat`` bytes start within a string, the smallest owner of these bytes; -1 elsewhere."""
    ends = np.cumsum(lengths)
    size = int(ends[-1]) if len(ends) else 0
    text = np.zeros(size + len(lengths) + repeat + 16, "u1")
    shift = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)  # a zero byte after each string
    spots = np.arange(size, dtype="i4") + shift
    text[spots] = np.frombuffer(joined, "u1")
    wanted = np.zeros(len(text), bool)
    wanted[spots[np.repeat(ends, lengths) - np.arange(size) >= repeat]] = True
    keys = _keys(np.r_[text, np.zeros(8, "u1")])
    order = suffix_order(text, wanted, repeat, keys)
    out = np.full(size, -1, "i8")
    if len(order):
        same = common(order, keys, repeat)
        del keys
        back = np.zeros(len(text), "i4")
        back[spots] = np.arange(size, dtype="i4")
        place = back[order]
        owner = owners[shift[place]]
        starts = np.flatnonzero(~same)
        least = np.minimum.reduceat(owner, starts)
        out[place] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return out
