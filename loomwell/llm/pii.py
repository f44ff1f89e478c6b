"""Personal data: fixed patterns and a linear-chain conditional random field.

Base spans are those of the four patterns below (leftmost, non-overlapping, checked, no
retries).  The field adds spans that the patterns miss, such as `jane (at) mail (dot) org`,
`(555) 010-4477` or a card number grouped by dots; an added span never touches a base span.

Field: labels are O and B/I of each kind.  Features of a token are its word shape (letters x/X,
digits d, runs cut to two, other signs kept), length class, marker words, and the shapes of its
neighbours.  It is trained on a small labelled table that labelled_rows() writes by rule
(maximum likelihood with forward-backward in numpy, fixed steps, so always the same weights).

Decoding: a token can only be part of a span if it lies within REACH tokens of a trigger (a
digit, `@`, or a bracketed at/dot); elsewhere the label is O by definition.  The stretches
around triggers are the sequences; they are decoded by Viterbi in padded numpy batches.  A
decoded span is kept only if it has the least content of its kind (LEAST).

Null text is empty; no text is cut.  Offsets are code points, ends exclusive.  Repeated rows are
read again, null ids are passed on, an empty table gives an empty result; extra columns are
ignored by find() and kept by mask().
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if not _HAS_DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


_HAS_DIGIT = re.compile(r"[0-9]")

# --- the field: tokens and features ----------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 3
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]", re.I)
#: Longest stretch between two triggers that is still one sequence, in characters.
GAP = 24


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 5)}"
    if token[0].isalpha():
        return ("X" if token[0].isupper() else "x") + ("s" if len(token) <= 3 else "l")
    return token


def features(tokens: list[str], glued: list[bool]) -> list[list[str]]:
    """Feature names of each token; glued: no white space before it."""
    shapes = [shape(t) for t in tokens]
    low = [t.lower() if t.lower() in ("at", "dot", "tel", "phone", "call", "card", "mail", "email", "ip", "host", "com", "org", "net") else "" for t in tokens]
    digits = "".join(t for t in tokens if t[0].isdigit())
    out = []
    for i, s in enumerate(shapes):
        f = ["s0=" + s, f"g={glued[i]}", f"g+={glued[i + 1] if i + 1 < len(tokens) else '-'}"]
        for d in (-3, -2, -1, 1, 2, 3):
            f.append(f"s{d}=" + (shapes[i + d] if 0 <= i + d < len(shapes) else "-"))
            if 0 <= i + d < len(low) and low[i + d]:
                f.append(f"w{d}=" + low[i + d])
        f.append(f"p={shapes[i - 1] if i else '-'}|{s}")
        f.append(f"n={s}|{shapes[i + 1] if i + 1 < len(shapes) else '-'}")
        f.append(f"t={shapes[i - 1] if i else '-'}|{s}|{shapes[i + 1] if i + 1 < len(shapes) else '-'}")
        if low[i]:
            f.append("w0=" + low[i])
        f.append(f"digits={min(len(digits), 20) // 3}")
        out.append(f)
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """(from, to) of the parts of the text around triggers, REACH tokens on either side."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= GAP:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    wide: list[tuple[int, int]] = []
    for a, b in out:
        a = _back(text, a)
        b = _ahead(text, b)
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
        else:
            wide.append((a, b))
    return wide


def _back(text: str, at: int, words: int = REACH) -> int:
    for _ in range(words):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _ahead(text: str, at: int, words: int = REACH) -> int:
    n = len(text)
    for _ in range(words):
        while at < n and not text[at].isspace():
            at += 1
        while at < n and text[at].isspace():
            at += 1
    while at < n and not text[at].isspace():
        at += 1
    return at


def tokenize(text: str, start: int, end: int):
    """(tokens, spans, glued) of text[start:end]."""
    found = list(TOKEN.finditer(text, start, end))
    spans = [m.span() for m in found]
    glued = [i > 0 and spans[i - 1][1] == s for i, (s, _) in enumerate(spans)]
    return [m.group() for m in found], spans, glued


# --- the labelled table ----------------------------------------------------------------------


def labelled_rows(rows: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Small labelled table: (text, spans), written by rule."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        d = pick("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def email():
        at = pick([" (at) ", " [at] ", "(at)", "[at]", " {at} ", "@", "@", " @ "])
        dot = pick([" (dot) ", " [dot] ", "(dot)", "[dot]", "."] if "@" not in at else [".", "."])
        return word() + pick(["", "." + word(), num(2), "_" + word()]) + at + word() + dot + pick(["com", "org", "net", "example.com"])

    def ip():
        sep = pick([".", ".", "[.]", "(.)", " . "])
        return sep.join(str(int(rng.integers(0, 256))) for _ in range(4))

    def grouped():
        c = card()
        return pick([" ", "-", ".", "", "/", " - "]).join([c[:4], c[4:8], c[8:12], c[12:]])

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"00{num(2)} {a} {b}{c}", f"1-{a}-{b}-{c}"])

    def harmless():
        return pick([
            num(4), num(2) + "/" + num(2) + "/" + num(4), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(2)}", f"${num(3)},{num(3)}", num(2) + "%",
            f"v{num(1)}.{num(1)}.{num(1)}", "".join(pick("0123456789abcdef") for _ in range(40)), f"@{word()}", f"{num(3)}-{num(4)}", num(6), num(9), f"#{num(5)}", f"({num(4)})", f"{num(1)}) ", f"p. {num(3)}", f"{word()} (at) {word()}",
            f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)}-{num(4)}", f"id {num(12)}", f"key = \"{num(8)}{word()}{num(7)}\"", f"{num(1)},{num(3)},{num(3)}", f"{num(2)}+{num(2)}={num(2)}", f"x{num(2)}y{num(3)}",
        ])

    makers = {"email": email, "ip": ip, "card": grouped, "phone": phone}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 3))):
            text += " ".join(word().capitalize() if rng.random() < 0.15 else word() for _ in range(int(rng.integers(2, 7)))) + pick([" ", " ", ": ", ", ", " - "])
            if rng.random() < 0.55:
                kind = pick(KINDS)
                value = makers[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = harmless()
            text += value + pick([" ", ". ", ", ", "; ", "### ", "&&& "])
        text += word()
        out.append((text, spans))
    return out


# Syllables of the filler words.
_SYLLABLES = "an ber con da en for ge ha in la lo ma men na on or pa qui re sa ti tra un ver zu".split()


# --- training and decoding -------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _forbidden() -> np.ndarray:
    """-inf like score where I would follow another kind or O; last row: the start."""
    k = len(LABELS)
    out = np.zeros((k + 1, k))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate([*LABELS, "O"]):
                if a[2:] != b[2:] or a == "O":
                    out[i, j] = -1e4
    return out


class Field:
    def __init__(self, index: dict, emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for i, f in enumerate(feats):
            ids = [self.index[x] for x in f if x in self.index]
            if ids:
                out[i] = self.emit[ids].sum(axis=0)
        return out

    def viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence; sequences of like length are decoded together."""
        out: list = [np.empty(0, np.int64)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        while order:
            room = max(1, 200_000 // max(1, len(seqs[order[-1]])))
            some, order = order[-room:], order[:-room]
            n = max(len(seqs[i]) for i in some)
            e = np.zeros((len(some), n, len(LABELS)))
            size = np.array([len(seqs[i]) for i in some])
            for r, i in enumerate(some):
                e[r, : size[r]] = seqs[i]
            best = e[:, 0] + self.move[-1]
            back = np.zeros((len(some), n, len(LABELS)), np.int8)
            stay = np.arange(len(LABELS), dtype=np.int8)
            for t in range(1, n):
                step = best[:, :, None] + self.move[None, :-1]
                frm = step.argmax(axis=1)
                live = (t < size)[:, None]
                back[:, t] = np.where(live, frm, stay)
                best = np.where(live, np.take_along_axis(step, frm[:, None], 1)[:, 0] + e[:, t], best)
            at = best.argmax(axis=1)
            path = np.zeros((len(some), n), np.int64)
            rows = np.arange(len(some))
            for t in range(n - 1, -1, -1):
                path[:, t] = at
                at = back[rows, t, at]
            for r, i in enumerate(some):
                out[i] = path[r, : size[r]]
        return out


def _truth(spans, marked) -> np.ndarray:
    out = np.zeros(len(spans), np.int64)
    for kind, a, b in marked:
        first = True
        for i, (s, e) in enumerate(spans):
            if s >= a and e <= b:
                out[i] = LABELS.index(("B-" if first else "I-") + kind)
                first = False
    return out


@lru_cache(maxsize=2)
def train(rows: int = 600, steps: int = 80) -> Field:
    """Maximum likelihood with Adam over the whole labelled table at every step."""
    seqs = []
    for text, marked in labelled_rows(rows):
        for a, b in stretches(text):
            tokens, spans, glued = tokenize(text, a, b)
            if tokens:
                seqs.append((features(tokens, glued), _truth(spans, marked)))
    seen: dict = {}
    for feats, _ in seqs:
        for f in feats:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n > 1))}
    seqs.sort(key=lambda s: -len(s[1]))  # at each position the live sequences are the first ones
    k, n = len(LABELS), max(len(y) for _, y in seqs)
    size = np.array([len(y) for _, y in seqs])
    truth = np.zeros((len(seqs), n), np.int64)
    seq_id, pos, feat = [], [], []
    for r, (feats, y) in enumerate(seqs):
        truth[r, : len(y)] = y
        for t, f in enumerate(feats):
            ids = [index[x] for x in f if x in index]
            seq_id += [r] * len(ids)
            pos += [t] * len(ids)
            feat += ids
    cell, feat = np.array(seq_id) * n + np.array(pos), np.array(feat)
    live = np.arange(n)[None, :] < size[:, None]
    count = live.sum(axis=0)  # live sequences at each position
    fixed = _forbidden()
    emit, move = np.zeros((len(index), k)), np.zeros((k + 1, k))
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    one = np.eye(k)[truth] * live[..., None]
    for step in range(1, steps + 1):
        e = np.zeros((len(seqs) * n, k))
        for j in range(k):
            e[:, j] = np.bincount(cell, emit[feat, j], len(e))
        e = e.reshape(len(seqs), n, k)
        trans = move + fixed
        step_to = np.exp(trans[:-1])

        def summed(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            top = x.max(axis=1, keepdims=True)
            return top + np.log(np.exp(x - top) @ by + 1e-300)

        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + trans[-1]
        for t in range(1, n):
            m = count[t]
            alpha[:m, t] = summed(alpha[:m, t - 1], step_to) + e[:m, t]
        last = alpha[np.arange(len(seqs)), size - 1]
        total = _logsum(last, 1)
        pair = np.zeros((k + 1, k))
        for t in range(n - 2, -1, -1):
            m = count[t + 1]
            after = e[:m, t + 1] + beta[:m, t + 1]
            high, low = alpha[:m, t].max(axis=1), after.max(axis=1)
            scale = np.exp(high + low - total[:m])[:, None]
            pair[:-1] += step_to * ((np.exp(alpha[:m, t] - high[:, None]) * scale).T @ np.exp(after - low[:, None]))
            beta[:m, t] = summed(after, step_to.T)
        prob = np.exp(np.clip(alpha + beta - total[:, None, None], -50, 0)) * live[..., None]
        pair[-1] = prob[:, 0].sum(axis=0)
        gone = (one - prob).reshape(-1, k)
        g_emit = np.stack([np.bincount(feat, gone[cell, j], len(index)) for j in range(k)], axis=1) - 0.05 * emit
        real = np.zeros((k + 1, k))
        np.add.at(real, (truth[:, :-1][live[:, 1:]], truth[:, 1:][live[:, 1:]]), 1)
        real[-1] = one[:, 0].sum(axis=0)
        g_move = real - pair - 0.05 * move
        for x, g, m, v in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move + fixed)


#: Least content of an added span: digits from, to; other test.
LEAST = {"ip": (4, 12), "card": (13, 19), "phone": (9, 15), "email": (0, 99)}


def _plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    low, high = LEAST[kind]
    if not low <= len(digits) <= high:
        return False
    if kind == "email":
        return bool(re.search(r"\w\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?\w", text, re.I)) and bool(re.search(r"\w\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?[A-Za-z]{2,}$", text, re.I))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return luhn(digits)
    return len(re.findall(r"[0-9]+", text)) >= 2


class Finder:
    def __init__(self, field: Field):
        self.field = field

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """(kind, start, end, base) of each text, by kind as listed, then start."""
        out, seqs, where = [], [], []
        for n, text in enumerate(texts):
            base = base_spans(text)
            out.append([(*s, True) for s in base])
            for a, b in stretches(text):
                tokens, spans, glued = tokenize(text, a, b)
                seqs.append(self.field.scores(features(tokens, glued)))
                where.append((n, spans))
        for (n, spans), path in zip(where, self.field.viterbi(seqs)):
            i = 0
            while i < len(path):
                label = LABELS[path[i]]
                if label[0] != "B":
                    i += 1
                    continue
                j = i + 1
                while j < len(path) and LABELS[path[j]] == "I-" + label[2:]:
                    j += 1
                a, b = spans[i][0], spans[j - 1][1]
                if all(b <= s or a >= e for _, s, e, _ in out[n]) and _plausible(label[2:], texts[n][a:b]):
                    out[n].append((label[2:], a, b, False))
                i = j
        for spans in out:
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        return out


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are
    of base spans, `spans` has all."""
    field = field or train()

    def run(batches):
        finder = Finder(field)
        for part in slices(batches):
            found = finder.find([t or "" for t in part.column(1).to_pylist()])
            cols = [part.column(0)]
            cols += [pa.array([sum(s[0] == k and s[3] for s in row) for row in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(_listed(s for s in row if s[3]).encode()).hexdigest() for row in found], pa.string()))
            cols.append(pa.array([_listed(row) for row in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def mask_text(text: str, spans) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns, personal data masked in `text`, n_chars (if there) made new."""
    field = field or train()
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        finder = Finder(field)
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            found = finder.find([t or "" for t in texts])
            new = [None if t is None else mask_text(t, s) for t, s in zip(texts, found)]
            cols = list(part.columns)
            cols[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([None if t is None else len(t) for t in new], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(trimmed(run), docs.schema)
