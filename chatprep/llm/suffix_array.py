"""Suffix arrays of a shard in numpy: Larsson-Sadakane refinement, Kasai common prefixes.

Suffixes are ordered by their first ``depth`` bytes only, which is all that repeats of that
length need.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a shard: three numbers of this size share a sort key.
_BITS = 20
MAX_TEXT, _MASK = 1 << _BITS, (1 << _BITS) - 1
#: Lanes of the common-prefix walk: stretches of the text that are walked side by side.
LANES = 8192


def _words(text: np.ndarray, n: int, pad: int) -> np.ndarray:
    """The eight bytes from each place, as big-endian numbers; the text ends in zeros."""
    data = np.zeros(n + pad + 8, np.uint8)
    data[:n] = text
    out = np.zeros(n + pad, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= data[k:k + n + pad]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (at most MAX_TEXT bytes) in the order of the ``depth`` bytes from them.

    Groups of suffixes with equal first h bytes are refined by the groups of the suffixes h
    places on, and h doubles up to ``depth``; groups of one suffix are done and stay out of later
    rounds. Beyond the end of the text come zeros. A sort key holds the group, the group further
    on and the place in one number, so that plain sorts do.
    """
    n = len(text)
    if n > MAX_TEXT:
        raise ValueError("a shard's text is too long")
    if not n:
        return np.zeros(0, np.int32)
    # first bytes as numbers of as few bits as the text's bytes need (0 is what follows the end)
    used = np.zeros(257, bool)
    used[text.astype(np.int16) + 1] = True
    used[0] = used[1] = True
    code = np.cumsum(used) - 1
    bits = int(code[-1]).bit_length()
    h = min((63 - _BITS) // bits, depth)
    data = np.ones(n + h, np.int64)  # the code of byte zero
    data[:n] = code[text.astype(np.int16) + 1]
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | data[k:k + n]
    key = np.sort(key << _BITS | np.arange(n))
    order = (key & _MASK).astype(np.int32)
    key >>= _BITS
    head = np.ones(n + 1, bool)  # whether a group starts at a place of the order
    np.not_equal(key[1:], key[:-1], out=head[1:n])
    start = np.flatnonzero(head)
    rank = np.zeros(n + depth, np.int32)  # one more than the place of the first of the group; 0 past the end
    rank[order] = np.repeat(start[:-1] + 1, np.diff(start))
    while h < depth:
        step = min(h, depth - h)
        open_ = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(open_):
            break
        at = order[open_]
        key = np.sort(rank[at].astype(np.int64) << 2 * _BITS + 1 | rank[at + np.int32(step)].astype(np.int64) << _BITS
                      | np.arange(len(at)))
        at = at[key & _MASK]
        key >>= _BITS
        order[open_] = at
        fresh = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        first = np.flatnonzero(fresh)
        head[open_[first[:-1]]] = True
        rank[at] = np.repeat(open_[first[:-1]] + 1, np.diff(first))
        h += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """For each place of the text, the length (``depth`` at most) of the prefix that its suffix
    shares with the suffix before it in ``order``; 0 for the first.

    Kasai's walk: from one place to the next the length falls by one at most, so it goes on from
    there, as long as the suffix after the one before also comes earlier in the order. Suffixes that
    share ``depth`` bytes stand in any order, so those after them may not; the walk then starts anew.
    Stretches of the text are walked side by side, eight bytes at a time.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = _words(text, n, depth) if words is None else words
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    spot = np.empty(n + 1, np.int32)  # of each place in the order; the end of the text is in none
    spot[order] = np.arange(n)
    spot[n] = n
    per = -(-n // LANES)
    lane = np.arange(-(-n // per)) * per
    h = np.zeros(len(lane), np.int64)
    to = np.full(len(lane), -1)
    for t in range(per):
        at = lane + t
        if at[-1] >= n:  # the last lane may be shorter
            lane, h, to = lane[:-1], h[:-1], to[:-1]
            at = at[:-1]
            if not len(at):
                break
        h = np.where(spot[to + 1] < spot[at], np.maximum(h - 1, 0), 0)
        to = before[at]
        live = np.flatnonzero((to >= 0) & (h < depth))
        h[to < 0] = 0
        while len(live):
            x = words[at[live] + h[live]] ^ words[to[live] + h[live]]
            same = x == 0
            # equal leading bytes of the two numbers
            h[live] += np.where(same, 8, _leading(x))
            live = live[same]
            live = live[h[live] < depth]
        np.minimum(h, depth, out=h)
        out[at] = h
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the upper end of each number."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def repeated(text: np.ndarray, depth: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ``depth`` bytes from each place also stand at another place (zeros follow the
    text's end), and whether the place speaks for its string: one place of each string does.
    ``starts`` tells the places that count; others neither repeat nor are repeats."""
    words = _words(text, len(text), depth)
    order = suffix_array(text, depth)
    common = common_prefixes(text, order, depth, words)
    out = np.ones(len(text), bool) if starts is None else starts.copy()
    speaks = np.zeros(len(text), bool)
    if len(order):
        # neighbours with a common prefix of that length are one group
        group = np.cumsum(common[order] < depth) - 1
        real = out[order]
        size = np.bincount(group, weights=real)
        speaks[order[real][np.unique(group[real], return_index=True)[1]]] = True
        out[order] &= size[group] > 1
    return out, speaks
