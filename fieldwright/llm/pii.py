"""Personal data: patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field reads white-space words. What it knows of a word is its shape (runs of lower and upper letters, digits and marks),
its number of digits, and the shapes beside it. It is trained from a small labelled table (``labelled_table``) and decoded by
Viterbi in numpy batches. A sequence is a stretch of a text that begins at a word of letters only, at least 32 words after
the one before, so that no run of number words is cut.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import field
from .common import map_texts, texts_in_chunks
from .field import sequences

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The look-behinds skip starts inside a run of digits, where the match from the run's
# beginning has failed already, so that long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches. A match holds one @; its local part reaches back to the run's beginning or the
    match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))  # each character is looked at once, however long the run
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in order; ends exclusive; code points."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if not _DIGIT.search(text):
        return out
    small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
    out[1] = [m.span() for m in _IP.finditer(text) if all(small(part) for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out[3].append(m.span())
    return out


# --- the labelled table -------------------------------------------------------------------------------------------------

def labelled_table() -> list[tuple[str, list[str]]]:
    """The field's training rows: (text, label of each white-space word). Made by rule from the forms below with a fixed seed:
    personal data in several ways of writing between plain words, and numbers that are none."""
    rng = np.random.default_rng(4)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    plain = lambda: "".join(pick(*"abcdefghilmnoprstuvz") for _ in range(rng.integers(1, 12)))
    word = lambda: pick(plain(), plain(), plain().capitalize(), plain() + ",", plain() + ".", plain().upper() + "!!", plain() + "***", "|", plain() + "$$$")
    forms = {
        "email": lambda: pick(f"{plain()}.{num(2)}@{plain()}{num(1)}.{plain()}.com", f"{plain()}@{plain()}.org", f"{plain()}_{plain()}@{plain()}.net", f"{plain()}[at]{plain()}.com", f"{plain()}(at){plain()}.org"),
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": lambda: pick("4" + num(15), "5" + num(15), f"4{num(3)}-{num(4)}-{num(4)}-{num(4)}", f"5{num(3)} {num(4)} {num(4)} {num(4)}"),
        "phone": lambda: pick(f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+49 {num(3)} {num(7)}", f"+{num(11)}", f"{num(3)}.{num(3)}.{num(4)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"),
        "O": lambda: pick(num(4), num(2), f"{num(1)}.{num(1)}", f"Version {num(1)}.{num(1)}.", f"CC BY-NC {num(1)}.{num(1)}.", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"${num(2)}.{num(2)}", f"{num(2)}:{num(2)}", f"{num(3)}%", f"password={plain()}{num(4)}{plain()}{num(3)}", f"AKIA{plain().upper()}{num(3)}{plain().upper()}", f"{plain()}{num(2)}", f"p.{num(3)}", f"@{plain()}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(5)}", f"{num(6)}", f"no. {num(7)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(25)}"),
    }
    rows = []
    for i in range(900):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            n = int(rng.integers(0, 8))
            words += [word() for _ in range(n)]
            labels += ["O"] * n
            kind = pick("email", "ip", "card", "phone", "O", "O", "O") if i % 3 else "O"
            made = forms[kind]().split()
            if rng.random() < 0.25:
                made[-1] += pick(".", ",", ";")
            words += made
            labels += [kind] * len(made)
        n = int(rng.integers(0, 8))
        rows.append((" ".join(words + [word() for _ in range(n)]), labels + ["O"] * n))
    return rows


# --- word shapes ---------------------------------------------------------------------------------------------------------

SHAPES = 4096
DIGITS = 24
LABELS = ("O", *KINDS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _classes() -> np.ndarray:
    """Per code point: 0 white space, 1 lower or other letter, 2 upper, 3 digit, else 4 + an ASCII mark's code; other marks 4."""
    out = np.full(0x110000, 4, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        if s.isspace():
            out[c] = 0
        elif s.isalpha():
            out[c] = 2 if s.isupper() else 1
        elif c < 128:
            out[c] = 3 if s.isdigit() else 4 + c
    return out


def shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each white-space word: start, end, shape (0 to SHAPES - 1), digits (DIGITS - 1 at most), and whether it is of letters
    with at most marks after them."""
    k = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (k > 0).view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(bool)
    changed = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.cumsum(changed)
    rank -= np.concatenate([np.zeros(start[0], rank.dtype), np.repeat(rank[start], np.diff(np.append(start, len(k))))])
    value = np.where(changed & (k > 0), (k.astype(np.uint64) + np.uint64(1)) * (rank.astype(np.uint64) * np.uint64(2) + np.uint64(0x51ED27)) * _STEP, np.uint64(0))
    value ^= value >> np.uint64(29)
    shape = ((np.add.reduceat(value, start) * _STEP) >> np.uint64(52)).astype(np.int64)
    digits = np.add.reduceat((k == 3).astype(np.int64), start)
    letter = np.concatenate([[0], np.cumsum((k == 1) | (k == 2))])
    letters = letter[end] - letter[start]
    plain = (digits == 0) & (letters > 0)
    at = np.concatenate([[0], np.cumsum(k == 4 + ord("@"))])
    plain &= at[end] == at[start]
    return start, end, shape, np.minimum(digits, DIGITS - 1), plain


# --- the field ------------------------------------------------------------------------------------------------------------

def _codes(shape: np.ndarray, digits: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """What the field knows of each word; first: positions that begin a sequence."""
    before = np.concatenate([[SHAPES], shape[:-1]])
    after = np.concatenate([shape[1:], [SHAPES]])
    before[first] = SHAPES
    after[first[first > 0] - 1] = SHAPES
    return {"own": shape, "digits": digits, "before": before, "after": after}


def _emissions(p: dict, shape: np.ndarray, digits: np.ndarray, first: np.ndarray) -> np.ndarray:
    return field.emissions(p, _codes(shape, digits, first))


def train_field(rows: list[tuple[str, list[str]]], rounds: int = 100, decay: float = 2e-3, rate: float = 0.15) -> dict:
    """The field's weights after training on all rows."""
    parts = [shapes(t) for t, _ in rows]
    shape, digits = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])
    sizes = np.array([len(x[0]) for x in parts])
    first = np.cumsum(sizes) - sizes
    y = np.array([LABELS.index(a) for _, labels in rows for a in labels])
    codes = {"own": SHAPES + 1, "digits": DIGITS, "before": SHAPES + 1, "after": SHAPES + 1}
    return field.fit(_codes(shape, digits, first), codes, y, first, len(LABELS), rounds, decay, rate)


def decode(p: dict, shape: np.ndarray, digits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every word."""
    return field.best_labels(_emissions(p, shape, digits, first), p["move"], first)


_TRIM = ".,;:!?\"'*#$%&|<>"


def field_spans(p: dict, texts: list[str]) -> list[list[list[tuple[int, int]]]]:
    """The field's own spans of each text, by kind: words of one label that stand side by side, without marks at their ends;
    an e-mail needs an "at" or @, the other kinds digits in their number and no letter."""
    parts = [shapes(t) for t in texts]
    base = np.cumsum([0] + [len(x[0]) for x in parts])
    out: list = [[[] for _ in KINDS] for _ in texts]
    if not base[-1]:
        return out
    first = np.concatenate([sequences(x[4]) + b for x, b in zip(parts, base, strict=False)]).astype(np.int64)
    label = decode(p, np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts]), first)
    hit = np.flatnonzero(label)
    doc = np.searchsorted(base, hit, side="right") - 1
    before = None
    for w, d in zip(hit.tolist(), doc.tolist(), strict=True):
        k = int(label[w]) - 1
        s, e = int(parts[d][0][w - base[d]]), int(parts[d][1][w - base[d]])
        if before == (w - 1, d, k) and k in (2, 3):  # cards and phones may be written in several words
            out[d][k][-1] = (out[d][k][-1][0], e)
        else:
            out[d][k].append((s, e))
        before = (w, d, k)
    for t, kinds in zip(texts, out, strict=True):
        for k, spans in enumerate(kinds):
            clean = []
            for s, e in spans:
                while e > s and t[e - 1] in _TRIM:
                    e -= 1
                while s < e and t[s] in _TRIM:
                    s += 1
                n, bare = sum(c.isdigit() for c in t[s:e]), not any(c.isalpha() for c in t[s:e])
                if (k == 0 and "at" in t[s:e] + ("at" if "@" in t[s:e] else "")) or (bare and (k == 1 and n >= 4 or k == 2 and 13 <= n <= 19 or k == 3 and 7 <= n <= 15)):
                    clean.append((s, e))
            kinds[k] = clean
    return out


def all_spans(p: dict, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and added spans) by kind. A span of the field that overlaps a base span of any kind is not added."""
    out = []
    for t, extra in zip(texts, field_spans(p, texts), strict=True):
        base = base_spans(t)
        ends, begins = [-1], [len(t) + 1]  # the stretches that base spans cover, apart from each other
        for s, e in sorted(s for spans in base for s in spans):
            if s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                begins.insert(-1, s)
                ends.append(e)
        free = lambda s, e, begins=begins, ends=ends: ends[(k := bisect_right(begins, s, hi=len(begins) - 1))] <= s and begins[k] >= e
        out.append((base, [sorted(b + [x for x in more if free(*x)]) for b, more in zip(base, extra, strict=True)]))
    return out


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans, strict=True) for s, e in own)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added.

    Offsets are code points of the whole text, ends exclusive. A null or empty text has no spans; time and memory grow with the length
    of a text, not with its square. Repeated rows give a row each, an empty table an empty result. Other columns are not used."""
    hold = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))

    def run(texts: list[str]) -> dict:
        found = all_spans(hold.value, texts)
        return {
            **{f"n_{k}": [len(b[i]) for b, _ in found] for i, k in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
            "spans": [joined(a) for _, a in found],
            "n_added": [sum(map(len, a)) - sum(map(len, b)) for b, a in found],
        }

    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return map_texts(docs, ["doc_id"], run, schema)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in angle brackets, e.g. <email>. Overlapping spans
    become one, named by the first. Null and empty texts stay as they are, long ones are read whole; n_chars, if there, is the new length.
    Repeated rows, rows without id and other columns stay as they are, an empty table stays empty."""
    hold = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))
    schema = docs.schema

    def hide(text: str, spans: list) -> str:
        out, done = [], 0
        for s, e, kind in sorted((s, e, kind) for kind, own in zip(KINDS, spans, strict=True) for s, e in own):
            if s >= done:
                out += [text[done:s], f"<{kind}>"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            texts = [t or "" for t in raw]
            masked: list = []
            for i, j in texts_in_chunks(texts):
                masked += [hide(t, a) for t, (_, a) in zip(texts[i:j], all_spans(hold.value, texts[i:j]), strict=True)]
            masked = [None if r is None else m for r, m in zip(raw, masked, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
