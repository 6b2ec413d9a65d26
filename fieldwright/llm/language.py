"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a letter n-gram binds (multiplies) those of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams, a language's
prototype those of its texts. The language of a text is that of the prototype with the largest cosine.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, map_texts, texts_in_chunks

DIMENSIONS = 1024
CACHED_GRAMS = 16_384
SYMBOLS = 2048


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> symbol, 0 if not a letter or a mark on one. Cases fold; letters beyond U+02FF share symbols."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x20000):
        s = chr(c)
        if s.isalpha() or unicodedata.category(s) == "Mn":
            low = ord(s.lower()[0])
            out[c] = low if low < 768 else 768 + low % (SYMBOLS - 768)
    out[0x20000:0x323B0] = 768 + np.arange(0x20000, 0x323B0) % (SYMBOLS - 768)
    return out


@functools.cache
def _alphabetic() -> np.ndarray:
    """Which code points are letters; marks on letters are none."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row a symbol; row 0 stands for a word's edge."""
    return (np.random.default_rng(2).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_codes(text: str) -> np.ndarray:
    """The letter trigrams of a text as numbers, repeats included, word edges included; empty if it has no letter."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _alphabetic()[u].any():
        return np.zeros(0, np.int64)
    s = np.concatenate([[0], _letters()[u], [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one edge between words
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return (s[:-2] * SYMBOLS * SYMBOLS + s[1:-1] * SYMBOLS + s[2:])[s[1:-1] != 0]


class GramVectors:
    """Vectors of trigrams, made when first needed; at most CACHED_GRAMS are remembered beyond one call's."""

    def __init__(self, dimensions: int = DIMENSIONS):
        base = letter_vectors(dimensions)
        self.first, self.second, self.third = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros((0, dimensions), np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """codes: distinct and ascending."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(self.codes) + len(new) > CACHED_GRAMS:
            self.codes, self.rows, new = self.codes[:0], self.rows[:0], codes
        if len(new):
            a, b, c = new // (SYMBOLS * SYMBOLS), new // SYMBOLS % SYMBOLS, new % SYMBOLS
            made = (self.first[a] * self.second[b] * self.third[c]).astype(np.float32)
            all_codes = np.concatenate([self.codes, new])
            order = np.argsort(all_codes)
            self.codes, self.rows = all_codes[order], np.concatenate([self.rows, made])[order]
        return self.rows[np.searchsorted(self.codes, codes)]


def text_vectors(texts: list[str], grams: GramVectors) -> np.ndarray:
    """One bundled vector a text."""
    out = np.zeros((len(texts), grams.rows.shape[1]), np.float32)
    each = [gram_codes(t) for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) for x in each])
    if not len(owner):
        return out
    both = np.sort(owner << 34 | np.concatenate(each))
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(start, len(both)))
    doc, code = both[start] >> 34, both[start] & ((1 << 34) - 1)
    used, col = np.unique(code, return_inverse=True)
    for a in range(0, len(used), 4096):  # a slice of the n-grams at a time: bounds the table of counts
        part = (col >= a) & (col < a + 4096)
        table = np.zeros((len(texts), min(4096, len(used) - a)), np.float32)
        table[doc[part], col[part] - a] = count[part]
        out += table @ grams(used[a:a + 4096])
    return out


def train_languages(docs: DataFrame, modulus: int = 3, held: int = 1, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, of length 1, from every text with a language and crc32(doc_id) mod 3 not 1.

    Sums are of whole numbers, so they do not depend on the order of tasks. Only the prototypes reach the driver."""
    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for lang, rows in pdf.groupby("lang")["text"]:
                texts = rows.tolist()
                for i, j in texts_in_chunks(texts):
                    code, n = np.unique(np.concatenate([gram_codes(t) for t in texts[i:j]]), return_counts=True)
                    old = counts.get(lang, (code[:0], n[:0]))
                    code, at = np.unique(np.concatenate([old[0], code]), return_inverse=True)
                    counts[lang] = code, np.bincount(at, np.concatenate([old[1], n]), len(code)).astype(np.int64)
        for lang, (code, n) in counts.items():
            grams, total = GramVectors(dimensions), np.zeros(dimensions)
            for i in range(0, len(code), 4096):
                total += n[i:i + 4096] @ grams(code[i:i + 4096])
            yield pd.DataFrame({"lang": lang, "at": np.arange(dimensions), "v": np.rint(total).astype(np.int64)})

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (bucket_of("doc_id", modulus) != held)).select("text", F.col("lang").cast("string"))
    made = rows.mapInPandas(bundle, "lang string, at int, v bigint").groupBy("lang", "at").agg(F.sum(F.col("v").cast("double")).alias("v")).toPandas()
    langs = sorted(made["lang"].unique())
    protos = np.zeros((len(langs), dimensions))
    for k, lang in enumerate(langs):
        own = made[made["lang"] == lang]
        protos[k, own["at"]] = own["v"]
    size = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs, protos / np.where(size > 0, size, 1)


def language_predictions(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (cosine with the prototype, 0 at least).

    A null text or one without a letter (marks alone are none) is "und" with score 0; so is every text if there is nothing to learn from.
    Ties go to the language that sorts first. Texts of any length are read whole; repeated rows give a row each, an empty table an
    empty result. Other columns are not used."""
    langs, protos = train_languages(docs, dimensions=dimensions)
    hold = docs.sparkSession.sparkContext.broadcast((langs, protos.astype(np.float32)))
    own: list[GramVectors] = []

    def predict(texts: list[str]) -> dict:
        if not own:
            own.append(GramVectors(dimensions))
        return predicted(texts, *hold.value, own[0])

    scored = map_texts(docs, ["doc_id"], predict, "doc_id " + dict(docs.dtypes)["doc_id"] + ", lang_pred string, score double")
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def predicted(texts: list[str], names: list[str], known: np.ndarray, grams: GramVectors) -> dict:
    """lang_pred and score of each text by the prototypes known, of length 1, of the languages names."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    for i in range(0, len(texts), 512):
        v = text_vectors(texts[i:i + 512], grams)
        size = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v))
        if not names:
            continue
        cos = (v @ known.T) / np.where(size > 0, size, 1)[:, None]
        best[i:i + 512] = np.where(size > 0, cos.argmax(1), -1)
        score[i:i + 512] = np.where(size > 0, np.clip(cos.max(1), 0, 1), 0)
    return {"lang_pred": [names[k] if k >= 0 else "und" for k in best], "score": score}
