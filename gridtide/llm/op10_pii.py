"""Personal data: fixed rules give the base spans; a character-level bidirectional LSTM with CRF transitions adds spans.

The network is written and trained in numpy: its labelled spans are the base spans of a bounded sample of documents, and rewritten variants of them
that the rules miss (a phone number without its plus, a card number in dotted groups, an address with an accented letter).

Texts are cut into windows of WINDOW characters, each half over the next. A span of any kind must hold a digit or an @, so a window without one
cannot yield a span and is not decoded; that leaves out no span. Overlapping windows are decoded one by one and reconciled over the whole text: of
all candidate spans the set of non-overlapping ones with the largest total confidence stays, after those that touch the base.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, shared

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 96, 48
SAMPLE_DOCS = 2500
TRAIN_WINDOWS = 3000
EMBED, HIDDEN, STEPS, BATCH, RATE = 12, 16, 250, 64, 0.01
#: Least probability of each character of an added span.
CONFIDENCE = 0.6
#: Windows decoded at once.
DECODED_AT_ONCE = 512

# ---------------------------------------------------------------- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each of these starts at the first digit of a run, where its leftmost match must start, so long runs cost one pass.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part that ends at an @ starts where its run of allowed characters starts, or where the match before ended."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def plausible(kind: str, s: str) -> bool:
    """What an added span must satisfy."""
    digits = _digits(s)
    if kind == "email":
        return s.count("@") == 1 and "." in s.split("@")[1].strip(".") and not re.search(r"\s", s)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


# ---------------------------------------------------------------- the network

_PUNCTUATION = " \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = np.zeros(128, np.int64)  # 0: padding and control characters
for _i, _c in enumerate(_PUNCTUATION):
    _SYMBOLS[ord(_c)] = 4 + _i
_SYMBOLS[48:58] = 1
_SYMBOLS[97:123] = 4 + len(_PUNCTUATION) + np.arange(26)
_SYMBOLS[65:91] = 4 + len(_PUNCTUATION) + 26 + np.arange(26)
VOCABULARY = 4 + len(_PUNCTUATION) + 52
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _SYMBOLS[np.minimum(points, 127)], 2)


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


ALLOWED = _allowed()


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF on top."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": rng.standard_normal((VOCABULARY, EMBED)).astype(np.float32) * 0.5, "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[f"wx{d}"], self.p[f"wh{d}"], self.p[f"b{d}"] = init(EMBED, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        batch, length = x.shape
        table = self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        wh, n = self.p[f"wh{d}"], HIDDEN
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        hs, kept = np.zeros((length, batch, n), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ wh
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                kept.append((t, before_h, before_c, i, f, o, g, tc))
        return hs, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(length, batch, tags) scores of the symbols x (batch, length)."""
        (hf, kf), (hb, kb) = self._direction(x, "f", keep), self._direction(x, "b", keep)
        hidden = np.concatenate((hf, hb), axis=2)
        return hidden @ self.p["out"] + self.p["bias"], hidden, kf, kb

    def _chain(self, e: np.ndarray):
        """Scaled forward and backward sums: alpha, beta (length, batch, tags) and the log of the partition sum."""
        trans = np.where(ALLOWED, np.exp(self.p["trans"]), 0).astype(np.float64)
        top = e.max(axis=2, keepdims=True)
        local = np.exp((e - top).astype(np.float64))
        alpha, beta, scale = np.empty_like(local), np.empty_like(local), np.empty(local.shape[:2])
        for t in range(len(e)):
            a = local[t] if t == 0 else (alpha[t - 1] @ trans) * local[t]
            scale[t] = a.sum(1)
            alpha[t] = a / scale[t][:, None]
        beta[-1] = 1
        for t in range(len(e) - 1, 0, -1):
            beta[t - 1] = ((beta[t] * local[t]) @ trans.T) / scale[t][:, None]
        return alpha, beta, local, scale, trans, (np.log(scale) + top[:, :, 0]).sum(0)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        alpha, beta, *_ = self._chain(e)
        m = alpha * beta
        return m / m.sum(2, keepdims=True)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, length) under the CRF and the marginal probability of each tag (batch, length, tags)."""
        e = self.emissions(x)[0]
        trans = np.where(ALLOWED, self.p["trans"], -1e9)
        score, back = e[0], []
        for t in range(1, len(e)):
            options = score[:, :, None] + trans
            best = options.argmax(1)
            back.append(best)
            score = np.take_along_axis(options, best[:, None], 1)[:, 0] + e[t]
        tags = np.empty((x.shape[0], len(e)), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = np.take_along_axis(back[t], tags[:, t + 1 : t + 2], 1)[:, 0]
        return tags, self.marginals(e).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y (batch, length) and its gradients."""
        batch, length = x.shape
        e, hidden, kf, kb = self.emissions(x, keep=True)
        alpha, beta, local, scale, trans, log_z = self._chain(e)
        yt = y.T
        gold = np.take_along_axis(e, yt[:, :, None], 2)[:, :, 0].sum(0) + self.p["trans"][yt[:-1], yt[1:]].sum(0)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_e = (alpha * beta).astype(np.float32)
        d_e /= d_e.sum(2, keepdims=True)
        np.put_along_axis(d_e, yt[:, :, None], np.take_along_axis(d_e, yt[:, :, None], 2) - 1, 2)
        d_e /= batch
        pairs = np.einsum("tbi,tbj->ij", alpha[:-1], beta[1:] * local[1:] / scale[1:, :, None]) * trans
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        g["trans"] = ((pairs - seen) / batch).astype(np.float32)
        g["out"], g["bias"] = np.einsum("tbh,tbk->hk", hidden, d_e), d_e.sum((0, 1))
        d_hidden = d_e @ self.p["out"].T
        n = HIDDEN
        for d, kept, d_h in (("f", kf, d_hidden[:, :, :n]), ("b", kb, d_hidden[:, :, n:])):
            table = np.zeros((VOCABULARY, 4 * n), np.float32)
            later_h, later_c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            for t, before_h, before_c, i, f, o, gg, tc in reversed(kept):
                dh = d_h[t] + later_h
                dc = later_c + dh * o * (1 - tc * tc)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)), 1)
                np.add.at(table, x[:, t], dz)
                g[f"wh{d}"] += before_h.T @ dz
                later_h, later_c = dz @ self.p[f"wh{d}"].T, dc * f
            g[f"b{d}"] = table.sum(0)
            g[f"wx{d}"] = self.p["emb"].T @ table
            g["emb"] += table @ self.p[f"wx{d}"].T
        return float((log_z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches, as many steps for few windows as for many; the loss of each step."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses, order = [], np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(x))
            pick, order = order[:BATCH], order[BATCH:]
            loss, g = self.gradients(x[pick], y[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = RATE * 0.1 ** (step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tagger:
        made = cls()
        with np.load(io.BytesIO(data)) as stored:
            made.p = {k: stored[k] for k in stored.files}
        return made


# ---------------------------------------------------------------- windows


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @, ascending."""
    numbers = {n for m in _ANCHOR.finditer(text) for n in (m.start() // STRIDE, m.start() // STRIDE - 1) if n >= 0}
    return [n * STRIDE for n in sorted(numbers)]


def _window_symbols(text: str, starts: list[int]) -> np.ndarray:
    padded = np.concatenate((symbols(text), np.zeros(WINDOW, np.int64)))
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


def candidates(starts: list[int], tags: np.ndarray, marginals: np.ndarray, length: int) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, confidence) of the decoded spans that end inside their window (or at an end of the text)."""
    found = {}
    for w, start in enumerate(starts):
        row = tags[w]
        for at in np.flatnonzero(row % 2 == 1):
            end = at + 1
            while end < WINDOW and row[end] == row[at] + 1:
                end += 1
            if (at == 0 and start > 0) or (end == WINDOW and start + end < length) or start + end > length:
                continue
            p = marginals[w, at:end]
            sure = float(np.minimum(p[:, row[at]] + p[:, row[at] + 1], 1).min())
            key = (start + int(at), start + int(end), KINDS[(row[at] - 1) // 2])
            found[key] = max(found.get(key, 0.0), sure)
    return [(*k, s) for k, s in found.items()]


def reconciled(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The non-overlapping subset with the largest total confidence (over all windows of a text), by start."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    best, chosen = [0.0], []
    ends = [s[1] for s in spans]
    for i, (start, _, _, sure) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, "right"))
        take = best[before] + sure
        chosen.append((take > best[i], before))
        best.append(max(take, best[i]))
    out, i = [], len(spans)
    while i:
        taken, before = chosen[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def added_spans(text: str, base: list[tuple[str, int, int]], decoded: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int]]:
    """Decoded spans that are sure and plausible, are whole words and stay clear of the base; reconciled over the text."""
    covered = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in covered]
    furthest = np.maximum.accumulate([b for _, b in covered]) if covered else []

    def clear(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b))
        return i == 0 or furthest[i - 1] <= a

    word = lambda i: 0 <= i < len(text) and text[i].isalnum()
    kept = [
        s for s in decoded
        if s[3] >= CONFIDENCE and not word(s[0] - 1) and not word(s[1]) and clear(s[0], s[1]) and plausible(s[2], text[s[0] : s[1]])
    ]
    return [(kind, a, b) for a, b, kind, _ in reconciled(kept)]


# ---------------------------------------------------------------- training


def _variant(kind: str, s: str, rng: np.random.Generator) -> str:
    """A rewriting of a base span that the rules miss."""
    if kind == "phone":
        return rng.choice(["", "00", "(0) "]) + s[1:]
    if kind == "card":
        d = _digits(s)
        return rng.choice([".", " . ", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "email":
        i = int(rng.integers(0, s.index("@")))
        return s[:i] + str(rng.choice(list("éüñø"))) + s[i:]
    return re.sub(r"\.", str(rng.choice([" . ", ", "])), s)


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows of the texts: as they are, and with spans rewritten. At most `most`, chosen at random by the seed."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text in texts:
        for share in (0.0, 0.5):
            made, labels, at = "", [], 0
            spans: list[tuple[str, int, int]] = []
            for kind, a, b in sorted(base_spans(text), key=lambda s: s[1]):
                if a >= at:
                    s = text[a:b]
                    if rng.random() < share:
                        s = _variant(kind, s, rng)
                    made += text[at:a]
                    spans.append((kind, len(made), len(made) + len(s)))
                    made += s
                    at = b
            made += text[at:]
            if share and not spans:
                continue
            labels = np.zeros(len(made) + WINDOW, np.int64)
            for kind, a, b in spans:
                labels[a:b] = 2 + 2 * KINDS.index(kind)
                labels[a] -= 1
            starts = window_starts(made)[:200]
            if starts:
                xs.append(_window_symbols(made, starts))
                ys.append(labels[np.array(starts)[:, None] + np.arange(WINDOW)])
    if not xs:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    pick = rng.permutation(len(x))[:most]
    return x[pick], y[pick]


def fit(docs: DataFrame) -> bytes:
    """Parameters trained on a sample of SAMPLE_DOCS documents at most that hold a digit or an @; one task trains, the bound is fixed."""
    anchored = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sample = anchored.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for batch in batches for t in batch.column(0).to_pylist())
        x, y = training_windows(texts)
        model = Tagger()
        if len(x):
            model.train(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes() if len(x) else b""], pa.binary())], names=["model"])

    found = linear.with_texts(docs, sample).select("text").repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else b""


def _decoded(tagger: Tagger, texts: dict[int, str]) -> dict[int, list[tuple[int, int, str, float]]]:
    """Candidate spans of each text; windows of several texts are decoded together, at most DECODED_AT_ONCE at a time."""
    found: dict[int, list] = {i: [] for i in texts}
    waiting: list[tuple[int, list[int], np.ndarray]] = []

    def flush() -> None:
        tags, marginals = tagger.decode(np.concatenate([w[2] for w in waiting]))
        at = 0
        for i, starts, x in waiting:
            found[i] += candidates(starts, tags[at : at + len(x)], marginals[at : at + len(x)], len(texts[i]))
            at += len(x)
        waiting.clear()

    count = 0
    for i, text in texts.items():
        starts = window_starts(text)
        for k in range(0, len(starts), DECODED_AT_ONCE):
            part = starts[k : k + DECODED_AT_ONCE]
            if count + len(part) > DECODED_AT_ONCE and waiting:
                flush()
                count = 0
            waiting.append((i, part, _window_symbols(text[part[0] : part[-1] + WINDOW], [s - part[0] for s in part])))
            count += len(part)
    if waiting:
        flush()
    return found


def find(docs: DataFrame, model: bytes, carried: list[str], name: str = "spans") -> DataFrame:
    """The carried columns and, under the given name, spans (array of kind, start, end, base) of each row: base spans by kind and start, then those that the model adds.

    NULL and empty texts have no spans. Repeated rows stay. An empty model adds nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.from_bytes(sent.value) if sent.value else None
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            column = batch.column(len(carried))
            for first, rows, data, offsets in shared.text_slices(column):
                anchors = np.flatnonzero((data == 64) | ((data >= 48) & (data <= 57)))
                texts = {int(i): column[first + int(i)].as_py() for i in (np.unique(shared.per_row(offsets, anchors)) if len(anchors) else [])}
                decoded = _decoded(tagger, texts) if tagger else {}
                for i, text in texts.items():
                    base = base_spans(text)
                    more = added_spans(text, base, decoded.get(i, []))
                    spans[first + i] = [{"kind": k, "start": a, "end": b, "base": c} for s, c in ((base, True), (more, False)) for k, a, b in s]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(spans, pa.list_(span))], names=[*carried, name])

    schema = shared.schema_of(docs, carried, f"{name} array<struct<kind: string, start: int, end: int, base: boolean>>")
    return docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(run, schema)


def redact(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; other columns and rows stay."""
    whole, spans, done = shared.own_names(docs, "whole", "spans", "done")
    found = find(docs.withColumn(whole, F.col("text")), model, [*[c for c in docs.columns if c != "text"], whole], spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    kept = lambda s, a: F.substring(F.col(whole), a + 1, s - a)
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["text"], kept(s["start"], acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("text"), s["end"].alias("at"))
    )
    found = found.withColumn(done, F.aggregate(ordered, begin, step))
    text = F.concat(F.col(f"{done}.text"), kept(F.length(whole), F.col(f"{done}.at")))
    return found.withColumn("text", F.when(F.col(whole).isNotNull(), text)).select(*shared.columns_of(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card, n_phone count base spans; n_added counts those of the model."""
    docs = shared.table(spark, sf_dir, "documents")
    found = find(docs, fit(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    of_kind = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)
