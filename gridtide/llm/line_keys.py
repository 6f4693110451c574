"""Candidate pairs of near-equal lines: keys that two lines share although some of their words differ.

PIECES: the 64-bit SimHash of a line's words is cut into PIECES pieces, and each two of them are a block of 42 bits or more, so that a block stays small
however many lines there are. Two lines whose SimHashes differ in PIECES - 2 bits at most share a block (the pigeonhole principle).
HALVES: SimHash moves much in short lines, so hashes of a line's first and of its last words are keys too, half of them each, in the sizes floor(n / 2) and
floor((n - 1) / 2). Two lines that differ in one word (changed, put in or taken out) share at least one, whatever their length: no such pair is missed.
BANDS: pairs of minima (MinHash) over runs of SHINGLE words, for lines that differ in more words. CHARACTER_BANDS: the same over runs of GRAM bytes, for
lines that differ in characters of many words. The chance to share one falls with the number of places; README gives the recall by length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from . import shared

PIECES = 3
HALVES = 4
BANDS = 2
SHINGLE = 3
CHARACTER_BANDS = 5
GRAM = 10
NAMES = [f"k{i}" for i in range(HALVES + BANDS + CHARACTER_BANDS + PIECES * (PIECES - 1) // 2)]
#: Words whose bits are voted on at once.
VOTES_AT_ONCE = 1 << 16

_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], np.uint64)
_ODD = shared.mixed(np.arange(1, 2 * max(BANDS, CHARACTER_BANDS) + 1, dtype=np.uint64)) | np.uint64(1)


def line_keys(words: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Keys (a row for each line, a column for each key) of lines of two words or more: hashes of their words, first word and number of words."""
    place = np.arange(len(words)) - np.repeat(begins, count)
    back = np.repeat(count, count) - 1 - place
    ends = begins + count
    zero = np.zeros(1, np.uint64)
    ahead = np.concatenate((zero, np.cumsum(shared.mixed(words + place.astype(np.uint64) * _A))))
    behind = np.concatenate((zero, np.cumsum(shared.mixed(words ^ (back.astype(np.uint64) * _B + np.uint64(1))))))
    keys = np.empty((len(begins), HALVES + BANDS), np.uint64)
    for i, size in enumerate((count // 2, np.maximum(1, (count - 1) // 2))):
        keys[:, 2 * i] = shared.mixed(ahead[begins + size] - ahead[begins] + _A)
        keys[:, 2 * i + 1] = shared.mixed(behind[ends] - behind[ends - size] + _B)
    runs = words.copy()
    for n in range(1, SHINGLE):  # past a line's end stands 0
        runs *= _C
        runs[: len(words) - n] += np.where(back[: len(words) - n] >= n, words[n:], np.uint64(0))
    runs = shared.mixed(runs)
    for b in range(BANDS):
        one, two = (np.minimum.reduceat(runs * odd, begins) for odd in _ODD[2 * b : 2 * b + 2])
        keys[:, HALVES + b] = shared.mixed(shared.mixed(one) + two * _C + np.uint64(b))
    return keys


def run_sums(data: np.ndarray, size: int) -> np.ndarray:
    """Sum of the `size` bytes from each place on, each times its power, from sums of 1, 2, 4, ... bytes; past the end stands 0."""
    part, wide, done, have = data.astype(np.uint64) + np.uint64(1), 1, np.zeros(len(data), np.uint64), 0
    while wide <= size:
        if size & wide:
            done[: len(data) - have] += part[have:] * _POWERS[have]
            have += wide
        longer = part.copy()
        longer[:-wide] += part[wide:] * _POWERS[wide]
        part, wide = longer, 2 * wide
    return done


def character_keys(data: np.ndarray, begins: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of lines by their bytes (first byte and number of bytes; the first bytes ascend, and a line ends before the next begins): pairs of minima
    over runs of GRAM bytes. Lines of fewer bytes have no run and equal keys."""
    keys = np.zeros((len(begins), CHARACTER_BANDS), np.uint64)
    runs = shared.mixed(run_sums(data, GRAM))
    ends = np.repeat(begins + length, np.diff(begins, append=len(data)))
    over = np.flatnonzero(ends - np.arange(begins[0], len(data)) < GRAM)  # runs over a line's end
    spread = np.empty_like(runs)

    def least(odd: np.uint64) -> np.ndarray:
        np.multiply(runs, odd, out=spread)
        spread[over] = ~np.uint64(0)
        return np.minimum.reduceat(spread, begins)

    for b in range(CHARACTER_BANDS):
        one, two = (least(odd) for odd in _ODD[2 * b : 2 * b + 2])
        keys[:, b] = shared.mixed(shared.mixed(one) + two * _A + np.uint64(b))
    return keys


def sim_hashes(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each line (first word; the lines follow one another): a bit is 1 if it is in more than half of the line's word hashes."""
    edges = np.append(begins, len(words))
    out, at = np.empty(len(begins), np.uint64), 0
    while at < len(begins):  # bounded bit matrices of whole lines
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + VOTES_AT_ONCE, "right")) - 1)
        bits = np.unpackbits(words[edges[at] : edges[to]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, edges[at:to] - edges[at], axis=0, dtype=np.int32)
        most = votes * 2 > np.diff(edges[at : to + 1])[:, None]
        out[at:to] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def piece_keys(sims: np.ndarray) -> np.ndarray:
    """The blocks of SimHashes, each a key of its own kind: all pieces but PIECES - 2."""
    edges = [64 * i // PIECES for i in range(PIECES + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    kept = [np.uint64(x | y) for x, y in combinations(masks, 2)]
    return np.stack([shared.mixed((sims & mask) ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i, mask in enumerate(kept)], 1)


def line_hashes(words: np.ndarray, begins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line by its words and their places."""
    place = (np.arange(len(words)) - np.repeat(begins, count)).astype(np.uint64)
    a = np.add.reduceat(shared.mixed(words + place * _A), begins)
    return a, np.add.reduceat(shared.mixed(words ^ (place * _B + np.uint64(1))), begins)


def keys_of(data: np.ndarray, bounds: np.ndarray, lines: np.ndarray, words: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All keys (columns NAMES) of the given lines of a slice; a line without a run of GRAM bytes repeats its first key in place of the missing ones."""
    length = np.diff(bounds)
    length = length - (data[bounds[1:] - 1] == 10)
    bytewise = character_keys(data, bounds[:-1], length)[lines]
    own = line_keys(words, begins, count)
    short = length[lines] < GRAM
    bytewise[short] = own[short, :1]
    return np.hstack((own, bytewise, piece_keys(sim_hashes(words, begins))))


def keys_of_forms(forms: list[str], classes: np.ndarray, wide: int) -> np.ndarray:
    """All keys of lines given by their normal forms, each of two words or more, and as last column their SimHash."""
    data = np.frombuffer("".join(f"{f}\n" for f in forms).encode(), np.uint8)
    bounds = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(data == 10) + 1))
    words, starts = shared.hashed_words(data, bounds, classes, wide)
    count = np.bincount(shared.per_row(bounds, starts), minlength=len(forms))
    begins = np.cumsum(count) - count
    return np.column_stack((keys_of(data, bounds, np.arange(len(forms)), words, begins, count), sim_hashes(words, begins)))
