"""Levenshtein distance of many pairs at once: Myers' bit vectors as lanes of 64-bit words within the bound of the diagonal, all lanes a step."""

from __future__ import annotations

import numpy as np

#: Words of one block of pairs and of its table of characters (16 MB), and the longest shorter side that words are used for; longer ones go one by one.
LANES, TABLE_WORDS, LONGEST = 8192, 1 << 21, 2048
#: Below this many pairs as long as the longest of a block one integer a pair is quicker.
FEWEST = 40
#: Pairs of one block have second texts of at least this part of the longest.
ALIKE = 0.5
#: Steps after which lanes are dealt anew; at most 64, so that two lanes of a pair never begin together after the first step.
STEPS = 32
_ONE = np.uint64(1)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """The lines without their common ends, the shorter first."""
    lead, limit = 0, min(len(a), len(b))
    while lead + 32 <= limit and a[lead : lead + 32] == b[lead : lead + 32]:
        lead += 32
    while lead < limit and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    limit, tail = min(len(a), len(b)), 0
    while tail < limit and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return (a, b) if len(a) <= len(b) else (b, a)


def one_within(a: str, b: str, most: int) -> bool:
    """Whether trimmed lines are within `most` edits, with the bit vectors in one integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, ch in enumerate(b):
        eq = places.get(ch, 0)
        vertical = eq | down
        eq = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(eq | up))
        minus = up & eq
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return False
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return score <= most


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _block(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Whether trimmed pairs are within their bounds.

    Each 64 characters of a first text are a lane of one word. Lane w takes column j of the second text at step j + w, one step after lane w - 1 took it, so
    all lanes of all pairs go on together and a lane's carry is what its neighbour left a step before. Lanes are dealt anew every STEPS steps: a lane is
    there while its rows are within the bound of the diagonal (cells beyond count as large as they can be, which changes no distance within the bound),
    and a pair goes once all of a row is beyond its bound.
    """
    short, long, most = (list(x) for x in zip(*pairs))
    m, n, most = np.array([len(a) for a in short]), np.array([len(b) for b in long]), np.array(most)
    codes = _codes(short + long)
    known = np.zeros(int(codes.max()) + 1, np.int32)
    known[codes] = 1
    codes = np.cumsum(known)[codes]  # from 1 on; 0 is no character
    size, lanes = int(codes.max()) + 1, (m + 63) // 64
    first = np.cumsum(lanes) - lanes
    pair = np.repeat(np.arange(len(pairs)), lanes)
    w = np.arange(len(pair)) - first[pair]
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    places = np.zeros(len(pair) * size, np.uint64)
    np.add.at(places, (np.repeat(first, m) + at // 64) * size + codes[: len(at)], _ONE << (at % 64).astype(np.uint64))
    gap = max(int(lanes.max()), STEPS) + 1
    start = np.cumsum(n + gap) - n
    texts = np.zeros(int(start[-1] + n[-1]) + gap, np.int64)
    texts[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)] = codes[len(at) :]
    bit = np.where(w == lanes[pair] - 1, (m[pair] - 1) % 64, 63)
    begin = (np.maximum(64 * w - most[pair] + w, 0) * (64 * w > most[pair])) // STEPS * STEPS
    end = np.minimum(64 * w + 63 + most[pair], n[pair] - 1) + w
    last, ready = first + lanes - 1, n + lanes - 2  # a pair's last lane, and its last step
    to_begin, to_end = np.argsort(begin, kind="stable"), np.argsort(ready, kind="stable")
    begins, ends = begin[to_begin], ready[to_end]
    out, dead = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    live = np.zeros(0, np.int64)
    up, down, plus, minus = (np.zeros(0, np.uint64) for _ in range(4))
    score, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = 0
    while t <= ends[-1]:
        over = end[live] < t
        dead[pair[live[over & (least > most[pair[live]])]]] = True
        new = np.sort(to_begin[np.searchsorted(begins, t, "left") : np.searchsorted(begins, t, "right")])
        new = new[~dead[pair[new]]]
        if t:
            above = np.searchsorted(live, new - 1)
            value = score[above] - (plus[above].astype(np.int64) - minus[above].astype(np.int64)) + bit[new] + 1
        else:
            value = 64 * w[new] + bit[new] + 1
        keep = ~over & ~dead[pair[live]]
        live = np.concatenate((live[keep], new))
        order, none = np.argsort(live, kind="stable"), np.zeros(len(new), np.uint64)
        live = live[order]
        up, down, plus, minus = (np.concatenate((x[keep], y))[order] for x, y in ((up, ~none), (down, none), (plus, none), (minus, none)))
        score, least = (np.concatenate((x[keep], value))[order] for x in (score, least))
        if not len(live) and dead.all():
            break
        top = np.flatnonzero((np.diff(live, prepend=-2) != 1) | (w[live] == 0))
        base, column, shift = live * size, start[pair[live]] - w[live] + t, bit[live].astype(np.uint64)
        done = to_end[np.searchsorted(ends, t, "left") : np.searchsorted(ends, t + STEPS, "left")]
        done = done[~dead[done]]
        step, where = ready[done], np.searchsorted(live, last[done])
        eq, across, x, grow, fall = (np.empty(len(live), np.uint64) for _ in range(5))
        hin, hneg = np.empty(len(live), np.uint64), np.empty(len(live), np.uint64)
        for now in range(t, t + STEPS):
            hin[1:], hneg[1:] = plus[:-1], minus[:-1]
            hin[top], hneg[top] = 1, 0
            np.take(places, base + texts[column], out=eq, mode="clip")
            column += 1
            np.bitwise_or(eq, down, out=across)
            eq |= hneg
            np.bitwise_and(eq, up, out=x)
            x += up
            x ^= up
            x |= eq
            np.bitwise_or(x, up, out=grow)
            np.invert(grow, out=grow)
            grow |= down
            np.bitwise_and(up, x, out=fall)
            np.right_shift(grow, shift, out=plus)
            plus &= _ONE
            np.right_shift(fall, shift, out=minus)
            minus &= _ONE
            score += plus.view(np.int64)
            score -= minus.view(np.int64)
            np.minimum(least, score, out=least)
            grow <<= _ONE
            grow |= hin
            fall <<= _ONE
            fall |= hneg
            np.bitwise_or(across, grow, out=up)
            np.invert(up, out=up)
            up |= fall
            np.bitwise_and(grow, across, out=down)
            if len(step) and now == step[0]:
                k = int(np.searchsorted(step, now, "right"))
                out[done[:k]] = score[where[:k]] <= most[done[:k]]
                step, where, done = step[k:], where[k:], done[k:]
        t += STEPS
    return out


def within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """For each (a, b, most) whether the Levenshtein distance of a and b is at most `most`."""
    out, left, alone = np.zeros(len(pairs), bool), [], []
    for at, (a, b, most) in enumerate(pairs):
        if abs(len(a) - len(b)) > most:
            continue
        a, b = trimmed(a, b)
        if len(b) <= most:
            out[at] = True
        elif a:
            (left if len(a) <= LONGEST else alone).append((at, a, b, most))
    left.sort(key=lambda p: -len(p[2]))
    kinds = len(set().union(*(set(p[1]) | set(p[2]) for p in left))) + 1 if left else 0
    lanes = np.cumsum([(len(p[1]) + 63) // 64 for p in left])
    first = 0
    while first < len(left):
        most_lanes = (lanes[first - 1] if first else 0) + max(1, min(LANES, TABLE_WORDS // kinds))
        last = max(first + 1, int(np.searchsorted(lanes, most_lanes, "right")))
        last = next((x for x in range(first + 1, last) if len(left[x][2]) < ALIKE * len(left[first][2])), last)
        part, first = left[first:last], last
        if sum(len(p[2]) for p in part) < FEWEST * len(part[0][2]):
            alone += part
        else:
            out[[p[0] for p in part]] = _block([p[1:] for p in part])
    for at, a, b, most in alone:
        out[at] = one_within(a, b, most)
    return out
