"""SentencePiece encoding and decoding by batched numpy Viterbi.

The pieces, scores and normaliser of a SentencePiece model are read; a text's segmentation is the one of largest total score, as that
library's unigram model defines it, bytes standing for characters without a piece. (A BPE model's scores are ranks of its merges; its own
segmentation merges by rank instead, so the ids differ from the library's for such a model, and decode to the same text.) Words of equal length advance together: at
each end position the hashes of all their substrings probe the sorted hashes of the pieces, and the best of each word
is kept with its start. Long runs without spaces are probed at all places at once, and cut where no piece spans a place.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers at most, and how long they may be: some 100 MB at worst. Longer ones are segmented each time.
CACHED_WORDS, CACHED_LENGTH = 250_000, 64
#: Cells (words x positions) that advance together.
BATCH_CELLS = 400_000
_BASE = np.uint64(0x100000001B3)
_UNBASE = np.uint64(pow(0x100000001B3, -1, 2**64))
#: Characters of a long run that are looked at together, at least.
RUN = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LEAD = np.uint64(44)
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    """Sorted hashes of the pieces of a model file, with their ids and scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = self.model = SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto.FromString(model.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("pieces that end in a space are not supported")
        self.front = SPACE if spec.add_dummy_prefix else ""
        self.plain = spec.escape_whitespaces and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        scores = {i: model.get_score(i) for i in normal}
        self.longest = max((len(self.pieces[i]) for i in normal), default=1)
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(self.longest):
            self.power[k + 1:] *= _BASE
        keys = np.array([self._hash_one(self.pieces[i]) for i in normal], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(normal, np.int64)[order]
        self.scores = np.array([scores[i] for i in normal], np.float64)[order]
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.keys >> _LEAD] = True
        self.unknown_score = float(self.scores.min(initial=0.0)) - UNKNOWN_PENALTY
        self.known: dict[str, bytes] = {}

    def _hash_one(self, s: str) -> np.uint64:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return np.uint64((h ^ len(s)) * int(_MIX) & (2**64 - 1))

    def normal(self, text: str) -> str:
        """The text as the model's own normaliser gives it: spaces as U+2581, one more in front if the model wants it so."""
        if not text:
            return ""
        return self.front + text.replace(" ", SPACE) if self.plain else self.model.normalize(text)

    def expected(self, text: str) -> str:
        """What decoding the ids of a text gives: the normalised text."""
        return self.normal(text).removeprefix(self.front).replace(SPACE, " ")

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in key a piece was found, and its position in the sorted keys. Only hashes whose leading bits some piece has
        are searched."""
        row, col = np.nonzero(self.leading[key >> _LEAD])
        look = key[row, col]
        at = np.minimum(np.searchsorted(self.keys, look), len(self.keys) - 1)
        ok = self.keys[at] == look
        return row[ok], col[ok], at[ok]

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; all words have the same length."""
        n, length = len(words), len(words[0])
        u = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * _BASE + u[:, i] + np.uint64(1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            spans = np.arange(min(self.longest, end), 0, -1)  # longest first: of equal scores the earliest start stays
            starts = end - spans
            key = (prefix[end] - prefix[starts] * self.power[spans][:, None]) ^ spans.astype(np.uint64)[:, None]
            row, found_in, at = self.probe(key * _MIX)
            score = np.full(key.shape, -np.inf)
            ids = np.full(key.shape, self.unknown)
            score[-1] = self.unknown_score
            score[row, found_in], ids[row, found_in] = self.scores[at], self.ids[at]
            score += best[starts]
            pick = score.argmax(0)
            col = np.arange(n)
            best[end], back[end], piece[end] = score[pick, col], starts[pick], ids[pick, col]
        out, at, col = [], np.full(n, length), np.arange(n)
        while (at > 0).any():
            out.append((np.where(at > 0, piece[at, col], -1), at.copy()))
            at = np.where(at > 0, back[at, col], 0)
        table = np.stack([x for x, _ in out[::-1]], axis=1)
        ends = np.stack([x for _, x in out[::-1]], axis=1)
        result, used = [], table >= 0
        flat, stop = table[used].astype("<u4"), np.cumsum(used.sum(1)).tolist()
        unknown = (table == self.unknown).any(1).tolist()
        for k, begin in enumerate([0, *stop[:-1]]):
            ids = flat[begin:stop[k]]
            if unknown[k] and self.bytes:
                spread: list[int] = []
                for i, e in zip(table[k].tolist(), ends[k].tolist(), strict=True):
                    if i == self.unknown:
                        spread += [self.bytes[b] for b in words[k][e - 1].encode("utf-8", "surrogatepass")]
                    elif i >= 0:
                        spread.append(i)
                ids = np.array(spread, "<u4")
            result.append(ids)
        return result

    def matches(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, position in the sorted keys) of every piece within a run of code points, all places at once."""
        n = len(u)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _UNBASE)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((u.astype(np.uint64) + np.uint64(1)) * back[1:])]) * power  # modulo 2^64
        starts, lengths, found = [], [], []
        for s in range(1, min(self.longest, n) + 1):
            key = ((prefix[s:] - prefix[:-s] * self.power[s]) ^ np.uint64(s)) * _MIX
            row = np.flatnonzero(self.leading[key >> _LEAD])
            at = np.minimum(np.searchsorted(self.keys, key[row]), len(self.keys) - 1)
            ok = self.keys[at] == key[row]
            starts.append(row[ok]), lengths.append(np.full(int(ok.sum()), s)), found.append(at[ok])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)

    def segment_long(self, word: str) -> np.ndarray:
        """The ids of a long run without spaces: cut wherever no piece spans the place, which loses nothing; parts of up to CACHED_LENGTH
        characters go with the short words, in longer ones each place looks at the pieces that end there."""
        u = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        out, begin, size = [], 0, RUN
        while begin < len(word):
            block = u[begin:begin + size]
            start, length, at = self.matches(block)
            inside = np.zeros(len(block) + 2, np.int64)
            np.add.at(inside, start + 1, 1), np.add.at(inside, start + length, -1)
            free = np.flatnonzero(np.cumsum(inside[:len(block) + 1]) == 0)
            if begin + len(block) < len(word):  # what the block's end cuts off may hold pieces that span its last places
                free = free[free <= len(block) - self.longest]
                if free[-1] == 0:
                    size *= 2
                    continue
            ends = free[1:].tolist()
            parts = [word[begin + a:begin + b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            short = {p for p in parts if len(p) <= CACHED_LENGTH}
            made = self.learn(short, remember=False)
            order = np.lexsort((-length, start + length))
            start, length, at, stop = start[order], length[order], at[order], (start + length)[order]
            a = 0
            for p, b in zip(parts, ends, strict=True):
                if len(p) <= CACHED_LENGTH:
                    out.append(self.known.get(p) or made[p])
                else:
                    lo, hi = np.searchsorted(stop, [a + 1, b + 1])
                    out.append(self._best_path(p, (start[lo:hi] - a).tolist(), (stop[lo:hi] - a).tolist(), at[lo:hi]))
                a = b
            begin, size = begin + ends[-1], RUN
        return np.frombuffer(b"".join(out), "<u4")

    def _best_path(self, word: str, start: list[int], stop: list[int], at: np.ndarray) -> bytes:
        """Viterbi over the pieces found in a part, by end and falling length."""
        score, ids = self.scores[at].tolist(), self.ids[at].tolist()
        best, back, piece = [0.0] + [0.0] * len(word), [0] * (len(word) + 1), [self.unknown] * (len(word) + 1)
        k = 0
        for end in range(1, len(word) + 1):
            top, frm, own, single = -np.inf, end - 1, self.unknown, False
            while k < len(stop) and stop[k] == end:
                single = start[k] == end - 1
                v = best[start[k]] + score[k]
                if v > top:
                    top, frm, own = v, start[k], ids[k]
                k += 1
            if not single and best[end - 1] + self.unknown_score > top:
                top, frm, own = best[end - 1] + self.unknown_score, end - 1, self.unknown
            best[end], back[end], piece[end] = top, frm, own
        out, end = [], len(word)
        while end:
            if piece[end] == self.unknown and self.bytes:
                out += [self.bytes[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece[end])
            end = back[end]
        return np.array(out[::-1], "<u4").tobytes()

    def learn(self, words: set[str], remember: bool = True) -> dict[str, bytes]:
        """The ids of each word that is not known yet; short ones are remembered, but for parts of longer ones."""
        if remember and len(self.known) + len(words) > CACHED_WORDS:
            self.known = {}
        made: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > CACHED_LENGTH:
                made[w] = self.segment_long(w).tobytes()
            elif w not in self.known:
                by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, BATCH_CELLS // (length * self.longest))
            for i in range(0, len(group), step):
                for w, ids in zip(group[i:i + step], self.segment(group[i:i + step]), strict=True):
                    made[w] = ids.tobytes()
        if remember and len(made) <= CACHED_WORDS:
            self.known.update((w, ids) for w, ids in made.items() if len(w) <= CACHED_LENGTH)
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, normalised. No piece has U+2581 after another character, so words that begin with it are segmented on
        their own."""
        words = [_WORD.findall(self.normal(t)) for t in texts]
        made = self.learn({w for ws in words for w in ws})
        known = self.known | made if len(made) > len(self.known) else self.known
        get = lambda w: known.get(w) or made[w]
        return [np.frombuffer(b"".join([get(w) for w in ws]), "<u4") for ws in words]

    @functools.cached_property
    def _shown(self) -> list[str]:
        return [p.replace(SPACE, " ") for p in self.pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that the model puts in front."""
        shown = self._shown
        if not self.byte_of:
            return "".join([shown[i] for i in ids.tolist()])[len(self.front):]
        out: list[str] = []
        run = bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(shown[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)[len(self.front):]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model: str | None = None, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols, ids (array of int) of every whole text, whatever its length. A null or empty text has none, repeated rows give a row each, an
    empty table gives an empty result. Other columns are not used."""
    path, held = model or default_model(), []
    kinds = dict(docs.dtypes)

    def run(texts: list[str]) -> dict:
        if not held:
            held.append(PieceModel(path))
        return {"ids": [x.astype(np.int32) for x in held[0].encode(texts)]}

    return map_texts(docs, list(id_cols), run, ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", ids array<int>", text_col)


def decode_ids(encoded: DataFrame, model: str | None = None, id_cols: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """id_cols, text of every row's ids, whatever their number. Null or no ids give an empty text, repeated rows a row each, an empty table an
    empty result. Other columns are not used."""
    path, held = model or default_model(), []
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(PieceModel(path))
        for batch in batches:
            texts = [held[0].decode(np.asarray(x)) if x is not None else "" for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in id_cols}, "text": pa.array(texts, pa.string())})

    return encoded.select(*id_cols, ids_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", text string")


def encoded_and_decoded(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32 (unsigned, of the ids as little-endian 32-bit numbers), decoded_chars
    and decoded_crc32 (of its UTF-8) of the decoded text, and round_trip: whether decoding gives the (normalised) text again (U+2581 counts
    as a space, as in the library); with_ids, also the ids. A null text counts as empty and has no piece, texts of any length are read
    whole. Repeated rows give a row each, an empty table an empty result. Other columns are not used."""
    path, held = model or default_model(), []

    def run(texts: list[str]) -> dict:
        if not held:
            held.append(PieceModel(path))
        ids = held[0].encode(texts)
        back = [held[0].decode(x) for x in ids]
        return {
            "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "decoded_chars": [len(b) for b in back],
            "decoded_crc32": [zlib.crc32(b.encode("utf-8", "surrogatepass")) for b in back],
            "round_trip": [b == held[0].expected(t) for b, t in zip(back, texts, strict=True)],
        } | ({"ids": [x.astype(np.int32) for x in ids]} if with_ids else {})

    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", n_pieces bigint, ids_crc32 bigint, decoded_chars bigint, decoded_crc32 bigint, round_trip boolean"
    return map_texts(docs, ["doc_id"], run, schema + (", ids array<int>" if with_ids else ""))
