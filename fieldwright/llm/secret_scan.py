"""Secrets: patterns, and a linear-chain conditional random field that tags tokens as a secret's begin, inside or outside.

A token is a run of letters, digits and underscores, or a run of one mark. The field knows of a token its shape (length, kinds of
characters, how often they change), its word, the words and marks beside it, the word that names it (the nearest before
it, as in ``password: "..."``), the white space in front, and of its file how much of it is marks and digits. It is trained from a
small table made by rule and decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import field
from .common import map_texts, texts_in_chunks

KINDS = ("assign", "access", "hex")
#: What the field adds has a kind of its own, listed last.
ADDED = "secret"
# The base patterns. Case counts in none of the first one's letters.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more are just the matches that stay
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in order; ends exclusive; code points."""
    low = text.lower()  # only to see whether a name occurs at all
    assign = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(n in low for n in _NAMES) else []
    access = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    return [assign, access, [m.span() for m in _HEX.finditer(text)]]


# --- the labelled table -------------------------------------------------------------------------------------------------

OUT, BEGIN, INSIDE = 0, 1, 2


def labelled_table(seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """The field's training rows: (text, spans of its secrets). Made by rule from the forms below: secrets in several ways
    of writing between plain words and lines of code, and numbers, addresses and names that are none. Another seed gives other rows."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    num = lambda n: chars(digit, n)
    size = lambda a, b: int(rng.integers(a, b))
    plain = lambda: chars(lower, size(2, 12))
    word = lambda: pick(plain(), plain(), plain(), plain().capitalize(), plain() + ",", plain() + ".", plain().upper() + "!!", plain() + "***", "|", plain() + "$$$", "the", "of", "token", "password", "key", "secret", plain() + "###", plain() + "%%%", "_".join((plain(), plain())))
    mixed = lambda: chars(lower + upper + digit, size(10, 40))
    strong = lambda: plain().capitalize()[:size(3, 8)] + pick("!", "@", "#", "$", "_", "-", "") + num(size(2, 6)) + chars(lower + upper, size(2, 6))
    key = lambda: pick(mixed(), mixed(), strong(), chars(lower + digit, size(12, 32)), chars(upper + digit, size(12, 24)), f"{mixed()}/{mixed()}+{mixed()}==", f"{mixed()}.{mixed()}.{mixed()}", f"{mixed()}-{mixed()}_{mixed()}")
    name = lambda: pick("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "access_token", "client_secret", "private_key", "PASSWORD", "Pwd", "DB_PASS", "signing_key", "AUTH_TOKEN")
    made = [
        lambda: (f'{name()}{pick("=", ": ", " = ", ":", " := ", " -> ", " is ", " => ")}', key(), ""),
        lambda: (f'"{name()}"{pick(": ", ":", " : ")}"', key(), '"'),
        lambda: (f"{name()}{pick(' = ', '=', ': ')}'", key(), "'"),
        lambda: (pick("Authorization: Bearer ", "authorization: token ", "Bearer ", "X-Auth-Key: ", "-H 'X-Api-Token: "), key(), ""),
        lambda: (f"{pick('postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb')}://{plain()}:", pick(strong(), mixed()), f"@{plain()}.{plain()}.com/{plain()}"),
        lambda: ("", pick("ghp_", "gho_", "glpat-", "xoxb-", "sk-", "sk_live_", "AIza", "npm_", "hf_") + chars(lower + upper + digit, size(24, 44)), ""),
        lambda: ("", "AKIA" + chars(upper + digit, 16), ""),
        lambda: ("", chars("0123456789abcdef", pick(32, 40, 64)), ""),
        lambda: (f"{pick('my', 'the', 'your')} {pick('password', 'passphrase', 'pwd', 'token')} {pick('is', 'was', 'now is')} ", strong(), ""),
    ]
    none = [
        lambda: num(size(1, 17)), lambda: f"{num(1)}.{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: ".".join(str(size(0, 256)) for _ in range(4)),
        lambda: f"{plain()}.{num(2)}@{plain()}{num(1)}.{plain()}.com", lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"4{num(3)} {num(4)} {num(4)} {num(4)}", lambda: f"https://{plain()}.com/{plain()}/{plain()}{num(2)}?{plain()}={plain()}",
        lambda: f"{plain()}{num(2)}", lambda: f"{plain()} = {plain()}({plain()}, {num(2)})", lambda: f"{name()} = {plain()}", lambda: f"{name()}: {pick('required', 'none', 'string', 'optional', plain())}", lambda: f"#{chars('0123456789abcdef', 6)}",
        lambda: f"commit {chars('0123456789abcdef', 7)}", lambda: f"{plain().capitalize()}{plain().capitalize()}{plain().capitalize()}", lambda: f"<{plain()}=\"{plain()}\">", lambda: f"the {pick('password', 'token', 'secret', 'key')} {pick('was', 'is', 'must be')} {plain()}",
        lambda: f"{num(5)}", lambda: f"p. {num(3)}", lambda: f"{num(25)}", lambda: f"SPDX-License-Identifier: {plain().upper()}-{num(1)}.{num(1)}", lambda: f"CC BY-NC {num(1)}.{num(1)}", lambda: f"{name()} {plain()} {num(4)}", lambda: f"{plain()}_{plain()}_{num(2)}",
        lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: plain() + plain() + plain(),
    ]
    rows = []
    for i in range(1200):
        text, spans = " ".join(word() for _ in range(size(0, 8))), []
        for _ in range(size(1, 4)):
            text += pick(" ", " ", "\n") if text else ""
            if i % 3 and rng.random() < 0.6:
                front, secret, back = pick(*made)()
                spans.append((len(text) + len(front), len(text) + len(front) + len(secret)))
                text += front + secret + back + pick("", "", ",", ";", ".")
            else:
                text += pick(*none)() + pick("", "", ",", ".")
            text += " " + " ".join(word() for _ in range(size(0, 6)))
        rows.append((text, spans))
    return rows


# --- tokens --------------------------------------------------------------------------------------------------------------

WORD_CODES = NONE = 1 << 15
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48])
_CHANGES = np.array([1, 2, 3, 5, 9])
OWN_CODES = 12 * 8 * 6 + 129
#: Tokens on either side that a token's codes read.
REACH = 4
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: By class: lower 1, upper 2, digit 4.
_BITS = np.array([0, 1, 2, 4] + [0] * 252, np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    """Per code point: 0 white space, 1 lower or other letter, 2 upper, 3 digit, 4 underscore, else 5 + an ASCII mark's code; other marks 5."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        if s.isspace():
            out[c] = 0
        elif s.isalpha():
            out[c] = 2 if s.isupper() else 1
        elif c < 128:
            out[c] = 3 if s.isdigit() else 4 if s == "_" else 5 + c
    return out


@functools.lru_cache(4)
def _powers(bits: int) -> np.ndarray:
    out = np.full(1 << bits, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tokens:
    """The tokens of a text: start, end, kinds of their characters, and whether they are marks or plain words in small letters."""

    def __init__(self, u: np.ndarray, k: np.ndarray):
        self.u, self.k = u, k
        group = np.where((k > 0) & (k < 5), np.uint8(1), k)
        edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if len(k) else np.zeros(0, np.int64)
        end = np.append(edge[1:], len(k))
        real = group[edge] > 0
        self.start, self.end = edge[real], end[real]
        self.kinds = np.bitwise_or.reduceat(_BITS[k], edge)[real] if len(k) else np.zeros(0, np.uint8)
        self.mark = group[self.start] > 4
        self.gap = self.start - np.concatenate([[0], self.end[:-1]])
        self.plain = ~self.mark & (self.kinds == 1) & (self.gap > 0)

    def codes(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """The codes of tokens at (ascending positions, with those within REACH of the ones that count) in each slot."""
        u, k, start = self.u, self.k, self.start[at]
        length, mark = self.end[at] - start, self.mark[at]
        first = np.cumsum(length) - length
        flat = np.arange(int(length.sum())) + np.repeat(start - first, length)
        place = flat - np.repeat(start, length)
        c, kind = u[flat].astype(np.uint64), k[flat]
        changed = (kind[1:] != kind[:-1]) & (place[1:] > 0)
        changes = np.add.reduceat(np.concatenate([[0], changed]), first) if len(at) else first
        size = np.searchsorted(_LENGTHS, length)
        own = np.where(mark, 12 * 8 * 6 + np.minimum(k[start].astype(np.int64) - 5, 128), (size * 8 + self.kinds[at]) * 6 + np.searchsorted(_CHANGES, changes))
        c += ((c >= 65) & (c <= 90)).astype(np.uint64) * np.uint64(32)
        value = (c + np.uint64(1)) * _powers(max(int(length.max(initial=1)), 2).bit_length())[place]
        words = ((np.add.reduceat(value, first) * _STEP) >> np.uint64(49)).astype(np.int64) if len(at) else first

        def beside(a: np.ndarray, by: int, none: int) -> np.ndarray:
            """What stands by places further; none beyond the text."""
            there = np.arange(len(at)) + by
            ok = (there >= 0) & (there < len(at))
            there = np.where(ok, there, 0)
            return np.where(ok & (at[there] == at + by), a[there], none) if len(at) else a

        named, only_words = np.full(len(at), NONE), np.where(mark, NONE, words)
        for by in range(-REACH, 0):  # the nearest word before, over at most three marks
            near = beside(only_words, by, NONE)
            named = np.where(near != NONE, near, named)
        gap = np.minimum(self.gap[at], 1)
        for i in np.flatnonzero(gap):
            gap[i] += 10 in u[start[i] - self.gap[at[i]]:start[i]]
        share = lambda mask, low: int(np.searchsorted([low, 2 * low, 4 * low], mask.mean()))
        file = share(k > 4, 0.04) * 4 + share(k == 3, 0.01)
        return {
            "own": own, "word": words, "before": beside(words, -1, NONE), "before2": beside(words, -2, NONE), "after": beside(words, 1, NONE), "named": named,
            "shape_before": beside(own, -1, OWN_CODES - 1), "gap": gap * 12 + size, "file": np.full(len(at), file),
        }


def chars_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return u, _classes()[u]


def possible(k: np.ndarray) -> np.ndarray:
    """Where words (between white space) begin that can hold a span: LEAST characters, a letter and a digit. Others have none."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (k > 0).view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    kinds = np.bitwise_or.reduceat(_BITS[k], start) if len(start) else start
    ok = (end - start >= LEAST) & (kinds & 3 > 0) & (kinds & 4 > 0)
    return start[ok]


SIZES = {"own": OWN_CODES, "word": WORD_CODES + 1, "before": WORD_CODES + 1, "before2": WORD_CODES + 1, "after": WORD_CODES + 1, "named": WORD_CODES + 1, "shape_before": OWN_CODES, "gap": 36, "file": 16}


#: Characters of an added span at least.
LEAST = 8


def train_field(rows: list[tuple[str, list[tuple[int, int]]]], rounds: int = 40, decay: float = 1e-3, rate: float = 0.15) -> dict:
    """The field's weights after training on all rows."""
    parts = [Tokens(*chars_of(t)) for t, _ in rows]
    made = [x.codes(np.arange(len(x.start))) for x in parts]
    codes = {slot: np.concatenate([x[slot] for x in made]) for slot in SIZES}
    sizes = np.array([len(x.start) for x in parts])
    y = []
    for x, (_, spans) in zip(parts, rows, strict=True):
        own = np.zeros(len(x.start), np.int64)
        for s, e in spans:
            at = np.flatnonzero((x.start >= s) & (x.end <= e))
            own[at], own[at[:1]] = INSIDE, BEGIN
        y.append(own)
    return field.fit(codes, SIZES, np.concatenate(y), np.cumsum(sizes) - sizes, 3, rounds, decay, rate)


def field_spans(p: dict, texts: list[str]) -> list[list[tuple[int, int]]]:
    """The field's own spans of each text: from a begin over what is inside. Spans hold no white space, LEAST characters, a letter and a
    digit at least; marks at their ends go. Sequences without a word that can hold such a span are not decoded."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    todo: list[tuple] = []  # (text, start and end of its live tokens), their emissions and where their sequences begin
    scores, begins, held = [], [], 0
    for d, text in enumerate(texts):
        u, k = chars_of(text)
        spots = possible(k)
        if not len(spots):
            continue
        x = Tokens(u, k)
        first = field.sequences(x.plain)
        live = np.unique(np.searchsorted(first, np.searchsorted(x.start, spots), side="right") - 1)
        ends = np.append(first[1:], len(x.start))
        on = np.zeros(len(x.start) + 1, np.int64)
        np.add.at(on, first[live], 1), np.add.at(on, ends[live], -1)
        on = np.cumsum(on[:-1]) > 0
        near = np.zeros(len(x.start) + 1, np.int64)
        np.add.at(near, np.maximum(first[live] - REACH, 0), 1), np.add.at(near, np.minimum(ends[live] + REACH, len(x.start)), -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        keep = on[at]
        scores.append(field.emissions(p, {slot: c[keep] for slot, c in x.codes(at).items()}))
        at = at[keep]
        begins.append(np.searchsorted(at, first[live]) + held)
        held += len(at)
        todo.append((d, x.start[at], x.end[at]))
    if not held:
        return out
    label = field.best_labels(np.concatenate(scores), p["move"], np.concatenate(begins))
    done = 0
    for d, start, end in todo:
        own = label[done:done + len(start)]
        done += len(start)
        spans: list[list[int]] = []
        for i in np.flatnonzero(own).tolist():
            if own[i] == INSIDE and spans and spans[-1][1] == start[i]:
                spans[-1][1] = int(end[i])
            else:
                spans.append([int(start[i]), int(end[i])])
        for s, e in spans:
            t = texts[d][s:e]
            s, e = s + len(t) - len(t.lstrip(_TRIM)), e - len(t) + len(t.rstrip(_TRIM))
            t = texts[d][s:e]
            if e - s >= LEAST and any(c.isdigit() and c.isascii() for c in t) and any(c.isalpha() for c in t):
                out[d].append((s, e))
    return out


_TRIM = ".,;:!?\"'*#$%&|<>()[]{}"


def all_spans(p: dict, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]]:
    """(base spans by kind, added spans). A span of the field that overlaps a base span is not added."""
    out = []
    for t, extra in zip(texts, field_spans(p, texts), strict=True):
        base = base_spans(t)
        taken = np.array(sorted(s for spans in base for s in spans), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]  # spans of several kinds may overlap
        free = []
        for s, e in extra:
            at = int(np.searchsorted(taken[:, 0], e))  # those that begin before the end
            if not at or reach[at - 1] <= s:
                free.append((s, e))
        out.append((base, free))
    return out


def joined(base: list[list[tuple[int, int]]], added: list[tuple[int, int]] = ()) -> str:
    rows = [(s, i, e, kind) for i, (kind, own) in enumerate(zip((*KINDS, ADDED), [*base, added], strict=True)) for s, e in own]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(rows))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex (of the patterns), base_sha256, spans, n_added.

    Offsets are code points of the whole text, ends exclusive; spans of the field are of the kind "secret". A null or empty text has no
    spans; time and memory grow with the length of a text. Repeated rows give a row each, an empty table an empty result. Other columns are
    not used."""
    hold = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))

    def run(texts: list[str]) -> dict:
        found = all_spans(hold.value, texts)
        return {
            **{f"n_{k}": [len(b[i]) for b, _ in found] for i, k in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
            "spans": [joined(b, a) for b, a in found], "n_added": [len(a) for _, a in found],
        }

    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"
    return map_texts(docs, ["doc_id"], run, schema)


def mask_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every secret in text replaced by mark; overlapping spans become one. Null and empty texts stay as they are, long ones are read
    whole; n_chars, if there, is the new length. Repeated rows, rows without id and other columns stay, an empty table stays empty."""
    hold = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))

    def hide(text: str, base: list, added: list) -> str:
        out, done = [], 0
        for s, e in sorted(s for own in (*base, added) for s in own):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            texts = [t or "" for t in raw]
            masked: list = []
            for i, j in texts_in_chunks(texts):
                masked += [hide(t, *found) for t, found in zip(texts[i:j], all_spans(hold.value, texts[i:j]), strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([None if r is None else m for r, m in zip(raw, masked, strict=True)], batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
