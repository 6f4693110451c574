"""Secrets: fixed rules give the base spans; a linear-chain conditional random field over tokens adds spans.

Tokens are runs of ASCII letters and digits, runs of other characters beyond ASCII, and single marks. All tokens of a whole text are one chain: each is
tagged outside, begin or inside of a secret by its shape, the words around it and features of the whole text, and decoded by Viterbi. An inside token
follows its neighbour without white space. The field is written and trained in numpy: its labelled spans are the base spans of a bounded sample of
documents, the same with wording and value rewritten so that the rules miss them, and harmless look-alikes (file names, dates, versions, identifiers,
paths) and plain words as outside.

Features are array operations over many texts at once, and a step of the decoding takes the next token of many texts; no token is passed over. The
probabilities of the tags are needed only where the best tags hold a secret.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, shared

KINDS = ["assign", "access", "hex"]
#: Fixed forms of the base rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
_VALUE, _DIGIT, _LETTER = re.compile("[A-Za-z0-9+/_.=-]+"), re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Documents with base spans, and without, that the field is trained on at most.
SAMPLE_DOCS = 1500
#: Units of one training text that are trained on for a letter and a digit, and tokens of one of them, at most; tokens beside each, and tokens of the
#: stretch of plain words that each training text adds (drawn at random; only of the sample).
TRAIN_CHUNKS, TRAIN_TOKENS, TRAIN_BESIDE, TRAIN_PLAIN = 60, 48, 1, 8
BITS, STEPS, RATE, DECAY = 15, 100, 0.15, 1e-4
#: Least probability of each token of an added span.
CONFIDENCE = 0.8
#: Characters whose features are made at once (longer texts go in pieces that end at white space), and tokens decoded at once.
PIECE_CHARS, DECODED_AT_ONCE = 1_000_000, 1_000_000
#: Below this many chains one by one is quicker.
FEWEST = 12
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the values of the base spans stand: the right side of an assignment, the whole of the others; disjoint, by start."""
    spans = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    return joined_spans(spans + [(a, b) for k, a, b in base_spans(text) if k != "assign"])


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one; disjoint, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kind_of(value: str) -> str:
    """The kind that an added span is told as."""
    if re.fullmatch("[0-9a-fA-F]+", value):
        return "hex"
    return "access" if re.fullmatch("[A-Z]{2,}[A-Z0-9]{12,}", value) else "assign"


# ---------------------------------------------------------------- features

SPACE, ALNUM, LINK, BEYOND, MARK = range(5)
#: Kind of each ASCII character and, last, of those beyond. Letters and digits, and characters beyond ASCII, make runs; others are tokens alone.
_KIND = np.array([SPACE if c in b"\t\n\v\f\r " else ALNUM if chr(c).isalnum() else LINK if c in b"+/_.=-" else MARK for c in range(128)] + [BEYOND], np.uint8)
#: Units: runs of value characters, runs of characters beyond ASCII, other marks alone.
_UNIT = np.array([SPACE, ALNUM, ALNUM, BEYOND, MARK], np.uint8)
_PARTS = np.array([sum(1 << i for i, s in enumerate(("ghijklmnopqrstuvwxyz", "abcdef", "GHIJKLMNOPQRSTUVWXYZ", "ABCDEF", "0123456789")) if chr(c) in s) for c in range(128)] + [0], np.uint8)
_CASE = np.array([1 if 48 <= c < 58 else 2 if 97 <= c < 123 else 3 if 65 <= c < 91 else 0 for c in range(129)], np.uint8)
_BIT_LENGTH = np.array([min(n, 48).bit_length() for n in range(49)])
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(16)], np.uint64)
_COLUMN = 0xD6E8FEB86659FD93
#: Features of a token: fixed number, so that tokens are rows of one array. Those of a whole text are WHOLE of them.
WIDTH, WHOLE = 22, 4
_ACCESS_WORDS = ("passw", "secret", "token", "credential", "auth")
_WORD, _API_KEY = re.compile(r"\S+", re.ASCII), re.compile("api.?key")


def _slots(column: int, values: np.ndarray) -> np.ndarray:
    return (shared.mixed(values.astype(np.uint64) + np.uint64((column + 1) * _COLUMN % (1 << 64))) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def text_features(text: str) -> list[int]:
    """Of the whole text: marks and digits among its characters, line length, and whether words of access are in it."""
    n, low = max(1, len(text)), text.lower()
    marks, digits = (sum(text.count(c) for c in kind) for kind in ("{}[]()<>;=\"'`", "0123456789"))
    access = any(w in low for w in _ACCESS_WORDS) or "api" in low and bool(_API_KEY.search(low))
    return [min(5, 60 * marks // n), min(5, 60 * digits // n), min(8, (n // (1 + text.count("\n"))).bit_length() // 2), int(access)]


def token_features(parts: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the parts of texts, in order: its part, start, end (in the part), whether it is joined to the token before it, and its feature
    slots (tokens, WIDTH). whole: text_features of each part's text."""
    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    small = np.minimum(codes, 128)
    kind = _KIND[small]
    unit = _UNIT[kind]
    before, unit_before = (np.concatenate((np.zeros(1, np.uint8), k[:-1])) for k in (kind, unit))
    begins = (kind != SPACE) & ((kind == LINK) | (kind == MARK) | (kind != before))
    begins_unit = (kind != SPACE) & ((kind == MARK) | (unit != unit_before))
    at = np.flatnonzero(kind)  # all that is not white space; tokens and units follow one another there
    token = np.flatnonzero(begins[at])
    start = at[token]
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), np.zeros((0, WIDTH), np.int32)
    size = np.diff(token, append=len(at))
    first = np.flatnonzero(begins_unit[start])  # the first token of each unit
    tokens = np.diff(first, append=len(start))
    unit_of = np.repeat(np.arange(len(first)), tokens)
    unit_at, unit_size = token[first], np.diff(token[first], append=len(at))
    ends = np.cumsum([len(p) + 1 for p in parts])
    part = np.searchsorted(ends, start, "right")

    codes, small, kind = codes[at].astype(np.uint64), small[at], kind[at]
    letters = _PARTS[small]
    low = codes + np.uint64(1) + np.uint64(32) * ((letters & 12) > 0)
    place = np.arange(len(at)) - np.repeat(token, size)
    word = np.add.reduceat(np.where(place < 16, low * _POWERS[np.minimum(place, 15)], np.uint64(0)), token)
    head = sum(np.where(size > i, low[np.minimum(token + i, len(at) - 1)] * _POWERS[i], np.uint64(0)) for i in range(4))
    tail = sum(np.where(size > i, low[np.maximum(token + size - 1 - i, 0)] * _POWERS[i], np.uint64(0)) for i in range(3))
    shape = np.where(kind[token] == ALNUM, 256 + 8 * np.bitwise_or.reduceat(letters, token).astype(np.int64) + _BIT_LENGTH[np.minimum(size, 48)], small[token])
    case = _CASE[small]
    turned = np.concatenate(([False], case[1:] != case[:-1]))
    turned[unit_at] = False
    turns = np.add.reduceat(turned.astype(np.int64), unit_at)
    distinct = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (codes & np.uint64(63)), unit_at)).astype(np.int64)
    alnum = np.add.reduceat((kind == ALNUM).astype(np.int64), unit_at)
    form = 8 * np.bitwise_or.reduceat(letters, unit_at).astype(np.int64) + _BIT_LENGTH[np.minimum(alnum, 48)]

    def beside(values: np.ndarray, i: np.ndarray, none: int, reach: int = 0) -> np.ndarray:
        """The values of tokens i; `none` where they are of another part, or more than `reach` tokens before the unit."""
        near = np.clip(i, 0, len(start) - 1)
        known = (i == near) & (part[near] == part[first])
        return np.where(known & (i >= first - reach) if reach else known, values[near], np.uint64(none))

    words = np.flatnonzero((kind[token] == ALNUM) | (kind[token] == BEYOND))
    words_before = np.searchsorted(words, first)
    words = words if len(words) else np.zeros(1, np.int64)
    last, last_but_one = (np.where(words_before >= k, words[np.maximum(words_before - k, 0)], -1) for k in (1, 2))
    of_units = [
        *(beside(word, first - k, 1) for k in (1, 2, 3)),
        *(beside(v, i, 1, 4) for v, i in ((word, last), (head, last), (word, last_but_one), (tail, last))), beside(word, first + tokens, 2),
        np.minimum(unit_size, 64) // 4, np.minimum(turns, 24) // 2, np.minimum(9, 10 * turns // unit_size), distinct * 8 // np.minimum(unit_size, 64), form,
        *whole[part[first]].T,
    ]
    rank, edge = np.arange(len(start)) - first[unit_of], np.ones(len(first), bool)
    left, right = np.concatenate(([0], shape[:-1])), np.concatenate((shape[1:], [0]))
    left[first], right[first + tokens - 1] = 1023, 1023
    behind = np.minimum(tokens[unit_of] - rank, 3)
    of_tokens = [shape, left << 10 | shape, shape << 10 | right, np.minimum(rank, 3) * 4 + behind, np.zeros(len(start), np.int64)]
    rows = np.empty((len(start), WIDTH), np.int32)
    for i, values in enumerate(of_units):
        rows[:, i] = _slots(i, values)[unit_of]
    for i, values in enumerate(of_tokens, len(of_units)):
        rows[:, i] = _slots(i, values)
    offset = (ends - [len(p) + 1 for p in parts])[part]
    return part, start - offset, at[token + size - 1] + 1 - offset, np.concatenate((before, [0]))[start] != SPACE, rows


def pieces(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(from, start, end, to): the text in pieces start:end that end at white space, and from:to, which also holds the tokens that their features look at."""
    start = 0
    while start < len(text):
        space = re.compile(r"\s", re.ASCII).search(text, start + PIECE_CHARS - 1)
        end = space.end() if space else len(text)
        width = 256
        while width < start and len(_WORD.findall(text, max(0, start - width), start)) <= 5:
            width *= 4
        after = _WORD.search(text, end)
        yield max(0, start - width), start, end, min(after.start() + 32, len(text)) if after else end
        start = end


def _laid(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of chains one after the other (tags, tokens), and the length and first place of each."""
    n = np.array([len(e) for e in chains])
    return np.ascontiguousarray(np.concatenate(chains).T), n, np.cumsum(n) - n


def _by_token(e: np.ndarray) -> Iterator[list[float]]:
    """The three numbers of each token as plain floats, some thousand tokens at a time."""
    for at in range(0, e.shape[1], 1 << 14):
        yield from e[:, at : at + (1 << 14)].T.tolist()


def _best_of_one(score: list[float], e: np.ndarray, trans: list[list[float]]) -> np.ndarray:
    """Best tags of the last token scored and of those after it, whose emissions are e."""
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = trans
    o, b, i = score
    backs = bytearray()
    for x, y, z in _by_token(e):
        tags = []
        for p, q, r, own in ((o + oo, b + bo, i + io, x), (o + ob, b + bb, i + ib, y), (o + oi, b + bi, i + ii, z)):
            k, s = (1, q) if q > p else (0, p)
            if r > s:
                k, s = 2, r
            backs.append(k)
            tags.append(s + own)
        o, b, i = tags
    tag = max(range(3), key=(o, b, i).__getitem__)
    out = bytearray([tag])
    for t in range(len(backs) - 3, -1, -3):
        tag = backs[t + tag]
        out.append(tag)
    return np.frombuffer(out, np.int8)[::-1]


def _sure_of_one(ahead: list[float], e: np.ndarray, trans: list[list[float]]) -> tuple[np.ndarray, list[float]]:
    """The probability that a token is not outside, of the tokens after the one that the forward sums are of, and the backward sums of that one."""
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = trans
    o, b, i = ahead
    sums, out = array("d"), array("d")
    for x, y, z in _by_token(e):
        o, b, i = (o * oo + b * bo + i * io) * x, (o * ob + b * bb + i * ib) * y, (o * oi + b * bi + i * ii) * z
        total = o + b + i
        o, b, i = o / total, b / total, i / total
        sums.extend((o, b, i))
    o = b = i = 1.0
    for (p, q, r), (x, y, z) in zip(_by_token(np.frombuffer(sums).reshape(-1, 3)[::-1].T), _by_token(e[:, ::-1])):
        out.append((q * b + r * i) / (p * o + q * b + r * i))
        x, y, z = x * o, y * b, z * i
        o, b, i = oo * x + ob * y + oi * z, bo * x + bb * y + bi * z, io * x + ib * y + ii * z
        total = o + b + i
        o, b, i = o / total, b / total, i / total
    return np.frombuffer(out)[::-1], [o, b, i]


# ---------------------------------------------------------------- the field


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


class Field:
    """Linear-chain conditional random field over three tags with hashed features; inside follows begin or inside only."""

    def __init__(self):
        self.w, self.trans = np.zeros((1 << BITS, 3)), np.zeros((3, 3))

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        trans, first = self.trans.copy(), np.zeros(3)
        trans[OUTSIDE, INSIDE] = first[INSIDE] = -1e9
        return first, trans

    def _sums(self, e: np.ndarray, mask: np.ndarray):
        """Log forward and backward sums (batch, length, tags) and the log of the partition sum; masked places pass sums on unchanged."""
        first, trans = self._steps()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, e.shape[1]):
            step = _logsum(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(e.shape[1] - 1, 0, -1):
            step = _logsum(trans[None] + (e[:, t] + beta[:, t])[:, None, :], 2)
            beta[:, t - 1] = np.where(mask[:, t, None], step, beta[:, t])
        return alpha, beta, _logsum(alpha[:, -1], 1), trans

    def emissions(self, x: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """The score of each tag for slots x (tokens, WIDTH); none is inside unless it is joined to the token before it."""
        e = np.zeros((len(x), 3))
        for slots in x.T:
            e += self.w[slots]
        e[~joint, INSIDE] = -1e9
        return e

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, joint: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood of tags y (batch, length) for slots x (batch, length, WIDTH), and its gradients; sums over the batch."""
        e = self.emissions(x.reshape(-1, WIDTH), np.ones(mask.size, bool) if joint is None else joint.ravel()).reshape(*mask.shape, 3)
        alpha, beta, log_z, trans = self._sums(e, mask)
        p = np.exp(alpha + beta - log_z[:, None, None]) * mask[:, :, None]
        own = np.eye(3)[y] * mask[:, :, None]
        pairs = alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        pairs = np.exp(pairs) * mask[:, 1:, None, None]
        seen = own[:, :-1, :, None] * own[:, 1:, None, :]
        loss = log_z.sum() - (e * own).sum() - (np.where(seen > 0, trans, 0) * seen).sum()
        apart = p - own
        g = np.stack([np.bincount(x.ravel(), np.repeat(apart[:, :, k].ravel(), WIDTH), 1 << BITS) for k in range(3)], 1)
        return float(loss), g, (pairs - seen).sum((0, 1))

    def train(self, xs: list[np.ndarray], joints: list[np.ndarray], ys: list[np.ndarray], steps: int = STEPS) -> list[float]:
        """Adam with a small decay of the weights over all stretches (feature rows, whether joined, and tags of each); the mean loss of each step.

        Stretches of like length make one array, so that padding stays small.
        """
        groups = []
        sizes = [len(y) if len(y) <= 12 else 12 + len(y).bit_length() for y in ys]
        for size in sorted(set(sizes)):
            own = [i for i, s in enumerate(sizes) if s == size]
            x, mask = padded([xs[i] for i in own])
            y, joint = np.zeros(mask.shape, np.int64), np.zeros(mask.shape, bool)
            y[mask], joint[mask] = np.concatenate([ys[i] for i in own]), np.concatenate([joints[i] for i in own])
            groups.append((x, mask, y, joint))
        state = [(np.zeros_like(a), np.zeros_like(a)) for a in (self.w, self.trans)]
        losses = []
        for step in range(1, steps + 1):
            loss, *grads = (sum(parts) / len(ys) for parts in zip(*(self.gradient(*g) for g in groups)))
            rate = RATE * 0.05 ** (step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for a, g, (m, v) in zip((self.w, self.trans), grads, state):
                g = g + DECAY * a
                m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                a -= rate * m / (np.sqrt(v) + 1e-8)
            losses.append(loss)
        return losses

    def decode(self, rows: list[np.ndarray], joints: list[np.ndarray] | None = None, all_sure: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best tags by Viterbi, and the probability that a token is not outside, of each chain's feature rows."""
        joints = joints or [np.ones(len(r), bool) for r in rows]
        return self.read([self.emissions(r, j) for r, j in zip(rows, joints)], all_sure)

    def read(self, chains: list[np.ndarray], all_sure: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tags and probabilities, as decode, of chains of tokens given by their emissions; probabilities are 0 where a chain has no secret, unless all
        are asked for."""
        by_length = sorted((i for i, e in enumerate(chains) if len(e)), key=lambda i: -len(chains[i]))
        out = [(np.zeros(len(e), np.int8), np.zeros(len(e))) for e in chains]
        for i, tags in zip(by_length, self._best([chains[i] for i in by_length])):
            out[i][0][:] = tags
        told = [i for i in by_length if all_sure or out[i][0].any()]
        for i, sure in zip(told, self._sure([chains[i] for i in told])):
            out[i][1][:] = sure
        return out

    def _best(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of chains, the longest first: a step takes the next token of all; what a few long chains have left goes one by one."""
        if not chains:
            return []
        first, trans = self._steps()
        e, n, at = _laid(chains)
        score, backs, t = e[:, at] + first[:, None], [], 1
        last = np.zeros(len(n), np.int8)
        while True:
            k = int(np.searchsorted(-n, -t, "left"))
            last[k:score.shape[1]] = score[:, k:].argmax(0)
            score = score[:, :k]
            if k < FEWEST:
                break
            options = score[:, None, :] + trans[:, :, None]
            best = np.maximum(options[0], options[1])
            backs.append(np.where(options[2] > best, np.int8(2), (options[1] > options[0]).astype(np.int8)))
            score = np.maximum(best, options[2]) + e[:, at[:k] + t]
            t += 1
        tags = np.empty(e.shape[1], np.int8)
        for i in range(k):
            rest = _best_of_one(score[:, i].tolist(), e[:, at[i] + t : at[i] + n[i]], trans.tolist())
            last[i], tags[at[i] + t : at[i] + n[i]] = rest[0], rest[1:]
        for back in reversed(backs):
            t -= 1
            k = back.shape[1]
            tags[at[:k] + t] = last[:k]
            last[:k] = back[last[:k], np.arange(k)]
        tags[at] = last
        return np.split(tags, at[1:])

    def _sure(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The probability that a token is not outside: forward and backward sums, each brought to one a token; longest chains first."""
        if not chains:
            return []
        first, trans = self._steps()
        e, n, at = _laid(chains)
        trans = np.exp(trans)
        e[:, at] += first[:, None]
        e = np.exp(e - e.max(0))
        ahead, behind = np.empty_like(e), np.ones((3, len(n)))
        sums, t = e[:, at], 1
        ahead[:, at] = sums
        while (k := int(np.searchsorted(-n, -t, "left"))) >= FEWEST:
            sums = (trans.T @ sums[:, :k]) * e[:, at[:k] + t]
            sums /= sums.sum(0)
            ahead[:, at[:k] + t] = sums
            t += 1
        sure = np.empty(e.shape[1])
        for i in range(k):
            rest = slice(at[i] + t, at[i] + n[i])
            sure[rest], behind[:, i] = _sure_of_one(ahead[:, at[i] + t - 1].tolist(), e[:, rest], trans.tolist())
        for t in range(t - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, "left"))
            both = ahead[:, at[:k] + t] * behind[:, :k]
            sure[at[:k] + t] = (both[1] + both[2]) / both.sum(0)
            sums = trans @ (behind[:, :k] * e[:, at[:k] + t])
            behind[:, :k] = sums / sums.sum(0)
        return np.split(sure, at[1:])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, w=self.w.astype(np.float32), trans=self.trans)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Field:
        made = cls()
        with np.load(io.BytesIO(data)) as stored:
            made.w, made.trans = stored["w"].astype(np.float64), stored["trans"]
        return made


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of stretches as one array (stretches, longest, WIDTH), and which places are tokens."""
    length = np.array([len(r) for r in rows])
    mask = np.arange(length.max()) < length[:, None]
    x = np.zeros((*mask.shape, WIDTH), np.int64)
    x[mask] = np.concatenate(rows)
    return x, mask


# ---------------------------------------------------------------- training

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VALUES = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "access": _LETTERS.upper() + "0123456789",
    "mixed": _LETTERS + _LETTERS.upper() + "0123456789", "base64": _LETTERS + _LETTERS.upper() + "0123456789+/",
}


def random_value(rng: np.random.Generator) -> str:
    """A made secret of a form that the rules know only in some settings."""
    kind = str(rng.choice(list(_VALUES)))
    size = int(rng.integers(12, 44))
    s = "".join(rng.choice(list(_VALUES[kind]), size))
    s = s[:4] + str(rng.integers(0, 10)) + s[4:] + str(rng.choice(list(_LETTERS[:6].upper() if "upper" in kind or kind == "access" else _LETTERS[:6])))
    form = rng.random()
    if form < 0.2:
        return f"{rng.choice(['sk', 'pk', 'key', 'ghx', 'live'])}{rng.choice(['_', '-'])}{s}"
    if form < 0.35:
        k = int(rng.integers(4, 9))
        return "-".join(s[i : i + k] for i in range(0, len(s), k))
    return s + "=" * int(rng.integers(1, 3)) if kind == "base64" and form < 0.6 else s


def rewritten(rng: np.random.Generator) -> tuple[str, str, str]:
    """(words before, value, mark after) of a secret that the rules miss: no colon or equals sign between one of their words and the value."""
    value = random_value(rng)
    word = str(rng.choice(["password", "passwd", "secret", "token", "api key", "api_key", "access key", "pwd", "credentials", "auth", "Bearer", "private key", "signature"]))
    word = word.upper() if rng.random() < 0.2 else word
    quote = str(rng.choice(["", "", '"', "'", "`"]))
    link = str(rng.choice([" ", " is ", " -> ", " => ", ", ", " (", "\t", " was set to "]))
    return f"{word}{link}{quote}", value, quote + (")" if "(" in link else "")


def look_alike(rng: np.random.Generator) -> str:
    """A harmless chunk: file name, date, version, identifier, path, measure, code name."""
    word = lambda: "".join(rng.choice(list(_LETTERS), int(rng.integers(3, 9))))
    number = lambda n: int(rng.integers(10 ** (n - 1), 10**n))
    made = [
        f"{word()}{number(2)}.{rng.choice(['pdf', 'txt', 'html', 'png', 'csv'])}", f"{number(4)}-{number(2)}-{number(2)}T{number(2)}", f"v{number(1)}.{number(2)}.{number(1)}-beta{number(1)}",
        f"{word()}_{number(4)}", f"{word()}/{word()}/{number(3)}/{word()}", f"{number(5)}{rng.choice(['kg', 'km', 'mb', 'px'])}{word()}", f"{word().capitalize()}{word().capitalize()}{number(1)}",
        f"{word()}-{number(3)}-{word()}", f"{word()}.{word()}{number(2)}", f"{word().upper()}-{number(4)}", f"{word()}{number(3)}", f"{word()}={number(5)}",
    ]
    return str(rng.choice(made))


def training_texts(texts: list[str], seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, values that are secrets): the texts as they are, and once more with secrets and look-alikes put between their words."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        out.append((text, secret_values(text)))
        gaps = [m.start() for m in re.finditer(" ", text)]
        made, values, at = "", [], 0
        for gap in sorted(rng.choice(gaps, min(len(gaps), 4), replace=False).tolist()) if gaps else []:
            made += text[at:gap] + " "
            if rng.random() < 0.5:
                before, value, after = rewritten(rng)
                made += before
                values.append((len(made), len(made) + len(value)))
                made += value + after
            else:
                made += look_alike(rng)
            at = gap
        made += text[at:]
        if values or gaps:
            out.append((made, sorted({*values, *(v for v in secret_values(made) if all(v[1] <= a or v[0] >= b for a, b in values))})))
    return out


def training_rows(texts: list[tuple[str, list[tuple[int, int]]]], seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Feature rows, whether joined, and tags of stretches of labelled texts: units with a letter and a digit, or of a labelled value, with the tokens
    beside them, and a stretch drawn from anywhere."""
    rng = np.random.default_rng(seed)
    xs, joints, ys = [], [], []
    for text, values in texts:
        for low, start, end, high in pieces(text):
            _, first, last, joint, rows = token_features([text[low:high]], np.array([text_features(text)]))
            own = (first + low >= start) & (first + low < end)
            first, last, joint, rows = first[own] + low, last[own] + low, joint[own], rows[own]
            if not len(first):
                continue
            tags = np.zeros(len(first), np.int64)
            for a, b in values:
                inside = np.flatnonzero((first >= a) & (last <= b))
                tags[inside] = INSIDE
                tags[inside[:1]] = BEGIN
            units = [m.span() for m in _VALUE.finditer(text, start, end) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
            units += [(a, b) for a, b in values if start <= a < end]
            found = sorted({tuple(np.searchsorted(first, u).tolist()) for u in units})
            if len(found) > TRAIN_CHUNKS:
                found = [found[i] for i in rng.permutation(len(found))[:TRAIN_CHUNKS]]
            found = [(max(0, a - TRAIN_BESIDE), b + TRAIN_BESIDE) for a, b in found if b - a <= TRAIN_TOKENS]
            plain = int(rng.integers(0, max(1, len(first) - TRAIN_PLAIN)))
            for a, b in [*found, (plain, plain + TRAIN_PLAIN)]:
                while a and tags[a] == INSIDE:  # not from the middle of a value
                    a -= 1
                xs.append(rows[a:b])
                joints.append(joint[a:b])
                ys.append(tags[a:b])
    return xs, joints, ys


def trained(texts: list[str]) -> Field | None:
    """The field of the texts; None where they hold no token."""
    xs, joints, ys = training_rows(training_texts(texts))
    if not xs:
        return None
    field = Field()
    field.train(xs, joints, ys)
    return field


def fit(docs: DataFrame) -> bytes:
    """A field trained on a sample of SAMPLE_DOCS documents with base spans and as many without, at most; one task trains, the bound is fixed."""
    told = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}"""
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("text").rlike(told)).alias("told"))
    take = lambda t: known.where(F.col("told") == t).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = take(True).unionAll(take(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained(sorted(t for batch in batches for t in batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([field.to_bytes() if field else b""], pa.binary())], names=["model"])

    found = linear.with_texts(docs, sample).select("text").repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else b""


# ---------------------------------------------------------------- the operator


def added_spans(texts: dict[int, str], field: Field) -> dict[int, list[tuple[int, int]]]:
    """(start, end) of the secrets that the field tags in each text with enough confidence, clear of the base spans; all tokens of several texts together."""
    out: dict[int, list[tuple[int, int]]] = {i: [] for i in texts}
    chains: dict[int, list[np.ndarray]] = {}
    waiting: list[tuple[int, int, int, int, int]] = []
    wide = tokens = 0

    def score() -> None:
        """The emissions of the tokens of the waiting pieces."""
        whole = np.array([known[i] for i, *_ in waiting])
        part, first, last, joint, rows = token_features([texts[i][low:high] for i, low, _, _, high in waiting], whole)
        low, start, end = (np.array([w[k] for w in waiting])[part] for k in (1, 2, 3))
        first, last = first + low, last + low
        own = (first >= start) & (first < end)
        e = field.emissions(rows[own], joint[own])
        edges = np.searchsorted(part[own], np.arange(1, len(waiting)))
        for (i, *_), *arrays in zip(waiting, *(np.split(a, edges) for a in (e, first[own], last[own]))):
            chains.setdefault(i, []).append(arrays)
        waiting.clear()

    def read() -> None:
        done = {i: [np.concatenate(a) for a in zip(*found)] for i, found in chains.items()}
        for (i, (_, first, last)), (tags, sure) in zip(done.items(), field.read([e for e, *_ in done.values()])):
            begins = np.flatnonzero(tags == BEGIN).tolist()
            base = _union(joined_spans([(a, e) for _, a, e in base_spans(texts[i])])) if begins else None
            for b in begins:
                e = b + 1
                while e < len(tags) and tags[e] == INSIDE:
                    e += 1
                span = int(first[b]), int(last[e - 1])
                if sure[b:e].min() >= CONFIDENCE and plausible(texts[i][slice(*span)]) and not _touches(base, *span):
                    out[i].append(span)
        chains.clear()

    known = {}
    for i, text in texts.items():
        known[i] = text_features(text)
        for piece in pieces(text):
            waiting.append((i, *piece))
            wide += piece[3] - piece[0]
            tokens += piece[3] - piece[0]
            if wide >= PIECE_CHARS:
                score()
                wide = 0
        if tokens >= 4 * DECODED_AT_ONCE:  # a token has four characters or so
            if waiting:
                score()
            read()
            wide = tokens = 0
    if waiting:
        score()
    read()
    return out


def plausible(value: str) -> bool:
    """What an added span must satisfy: the least length of a value."""
    return len(value) >= LEAST_VALUE


def _union(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of disjoint spans."""
    return np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


def _touches(spans: tuple[np.ndarray, np.ndarray], start: int, end: int) -> bool:
    """Whether one of the disjoint spans overlaps (start, end)."""
    k = int(np.searchsorted(spans[0], end))
    return k > 0 and bool(spans[1][k - 1] > start)


def find(docs: DataFrame, model: bytes, carried: list[str], name: str = "spans") -> DataFrame:
    """The carried columns and, under the given name, spans (array of kind, start, end, base) of each row by start, then kind.

    Base spans stay; the model tags all tokens of each text, and adds the spans that no base span touches. NULL and empty texts have no spans. Repeated rows stay. An empty model
    adds nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.from_bytes(sent.value) if sent.value else None
        for batch in batches:
            texts = {i: t for i, t in enumerate(batch.column(len(carried)).to_pylist()) if t}
            more = added_spans(texts, field) if field else {}
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text in texts.items():
                found = [(a, KINDS.index(k), b, True) for k, a, b in base_spans(text)]
                found += [(a, KINDS.index(kind_of(text[a:b])), b, False) for a, b in more.get(i, [])]
                spans[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in sorted(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(spans, pa.list_(span))], names=[*carried, name])

    schema = shared.schema_of(docs, carried, f"`{name}` array<struct<kind: string, start: int, end: int, base: boolean>>")
    return docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(run, schema)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_assign, n_access, n_hex count base spans; n_added counts those of the model."""
    docs = shared.table(spark, sf_dir, "documents")
    found = find(docs, fit(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)
