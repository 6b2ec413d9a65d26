"""Phrase collocations from a weighted de Bruijn graph.

Nodes are runs of four words, edges the runs of five that join two of them, weighted by their number in the corpus. Only
those longest grams are counted, and the shorter ones at which a piece ends: a shorter phrase's number is the flow out of it
(the numbers of its continuations) and the pieces that end with it. Unary paths (through nodes that one edge enters and one
leaves, all of equal number) are compacted, and all that lies inside a path is told from it at once.

A phrase of at least ``least`` occurrences holds only words, pairs and triples of words of as many. Pieces are therefore cut at
rarer words, then at rarer pairs and triples, which leaves the number of every such phrase as it is. Which those are is told by
bitmaps of a fixed size: they let some rarer ones through, which costs work and changes no number. Words travel as 64-bit
hashes; that no two words share one that counts is checked on the corpus, and other hashes are taken if they do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the maps of frequent words, pairs and triples (16 MB each); bytes of text that are split at once; keys held before they are sent on.
MAP_BITS, CHUNK, HELD = 27, 4_000_000, 1_500_000
#: Words that a worker remembers at most, and how long they may be.
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
#: Edges of a compacted path at most: paths are cut at one edge in 16 or so, by hash, and after so many.
PATH_EDGES = 64
# Where pieces end, and the white space between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(_ENDS, b"." * len(_ENDS))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hash(salt: str) -> Callable[[bytes], int]:
    """XXH64 of the word with the salt in front, as Spark's xxhash64 gives it."""
    front = salt.encode()
    return lambda w: xxhash.xxh64_intdigest(front + w, 42)


class _Hashes(dict):
    """Hashes of words, made when they are first asked for. The stop between pieces is 0."""

    def __init__(self, salt: str):
        super().__init__()
        self.make, self[b"."] = word_hash(salt), 0

    def __missing__(self, w: bytes) -> int:
        h = self.make(w)
        if len(w) <= CACHED_LENGTH:
            if len(self) > CACHED_WORDS:
                self.clear()
                self[b"."] = 0
            self[w] = h
        return h


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts in lower case with "." for every end of a piece), some CHUNK bytes at a time; longer texts are cut at ends of
    pieces."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            line = (text or b"").lower().translate(_TO_STOP)
            while line:
                at = len(line) if len(line) <= CHUNK else line.find(b".", CHUNK) + 1 or len(line)
                held.setdefault(lang, []).append(line[:at])
                sizes[lang] += at
                line = line[at:]
                if sizes[lang] >= CHUNK:
                    yield lang, b" . ".join(held.pop(lang))
                    del sizes[lang]
        for lang, parts in held.items():
            yield lang, b" . ".join(parts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), added up over a part of the table as far as memory allows."""
    seen: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.binary()).cast(pa.string()), "n": pa.array(list(words.values()), pa.int64()),
            })
        seen.clear()

    for lang, line in _lines(batches):
        seen.setdefault(lang, Counter()).update(line.replace(b".", b" ").split())
        if sum(map(len, seen.values())) > 500_000:
            yield from rows()
    yield from rows()


class Bitmap:
    """2^MAP_BITS bits, by the leading bits of 64-bit keys: those of the keys that are frequent, and of some more."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int):
        """parts: of each value of the leading bits, if some key with it is frequent, the bits for what follows."""
        self.bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        size = 1 << (MAP_BITS - bits - 3)
        for k, part in parts:
            self.bits[k * size:(k + 1) * size] = np.frombuffer(part, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - MAP_BITS)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _of_language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))


def gram_keys(h: np.ndarray, m: int, lang: str) -> np.ndarray:
    """Of each run of m words: a 64-bit key of them and the language."""
    n = max(0, len(h) - m + 1)
    key = np.full(n, _of_language(lang))
    for j in range(m):
        key = (key ^ h[j:j + n]) * _M1
        key ^= key >> np.uint64(29)
    return key * _M2


class Frequent:
    """What is known so far of the grams that may be frequent: a map for each length from 1 on."""

    def __init__(self, salt: str, maps: list[Bitmap]):
        self.salt, self.maps = salt, maps

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[np.ndarray]]]:
        """(language, word hashes with stops between pieces, and for each length that a map knows: where such grams begin)."""
        known = _Hashes(self.salt)
        for lang, line in _lines(batches):
            tokens = line.replace(b".", b" . ").split()
            h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
            ok = h > 0
            begins = []
            for m, found in enumerate(self.maps, 1):
                ok = ok[:1] if m > len(h) else ok if m == 1 else ok[:-1] & ok[1:]
                ok = ok[:max(0, len(h) - m + 1)].copy()
                ok[ok] = found.has(gram_keys(h, m, lang)[ok])
                begins.append(ok)
            yield lang, h, begins

    def next_map(self, docs: DataFrame, least: int, words: int) -> Bitmap:
        """The map of the grams one word longer: where two known ones overlap, keys are counted. They travel in packs by their leading bits, sorted,
        40 bits of each and its number up to least."""
        m, bits = len(self.maps) + 1, _pack_bits(words)
        small = np.uint8 if least < 256 else np.uint32
        hold = docs.sparkSession.sparkContext.broadcast(self)

        def packs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lead = (keys >> np.uint64(64 - bits)).astype(np.int64)
            own, start = np.unique(lead, return_index=True)
            ends = np.append(start[1:], len(keys))
            rest = np.ascontiguousarray((keys >> np.uint64(24 - bits) & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5])
            n = np.minimum(n, least).astype(small)
            return pa.RecordBatch.from_pydict({
                "k": own.astype(np.int32), "keys": pa.array([rest[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
            })

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, numbers, held = [], [], 0
            for lang, h, begins in hold.value.runs(batches):
                last = begins[-1]
                k, n = np.unique(gram_keys(h, m, lang)[last[:-1] & last[1:]] if len(h) >= m else np.zeros(0, np.uint64), return_counts=True)
                keys.append(k), numbers.append(n)
                held += len(k)
                if held > HELD:
                    yield packs(*_added(keys, numbers))
                    keys, numbers, held = [], [], 0
            if held:
                yield packs(*_added(keys, numbers))

        def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
            packed = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 5)
            keys = np.zeros((len(packed), 8), np.uint8)
            keys[:, :5] = packed
            keys, n = _added([keys.view("<u8").ravel()], [np.frombuffer(b"".join(pdf["n"]), small)])
            on = np.zeros(1 << (MAP_BITS - bits), bool)
            on[keys[n >= least] >> np.uint64(40 - MAP_BITS + bits)] = True
            return pd.DataFrame({"k": pdf["k"].iloc[:1].to_numpy(), "bits": [np.packbits(on, bitorder="little").tobytes()] if on.any() else [None]})

        made = docs.mapInArrow(count, "k int, keys binary, n binary").groupBy("k").applyInPandas(add_up, "k int, bits binary")
        return Bitmap([tuple(r) for r in made.where("bits is not null").collect()], bits)  # 2^MAP_BITS bits at most


def _added(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, np.concatenate(numbers), len(unique)).astype(np.int64)


def grams(h: np.ndarray, begins: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of most hashes, numbers): the distinct longest grams. One begins at each word that begins a known pair, and goes on as long as
    all in it is known, most words at most; zeros fill up what is shorter, which is an end of a piece."""
    known = len(begins)
    at = np.flatnonzero(begins[1])
    rows = np.zeros((len(at), most), np.uint64)
    rows[:, 0], rows[:, 1], on = h[at], h[at + 1], np.ones(len(at), bool)
    for k in range(2, most):
        m = min(k + 1, known)  # the longest known gram that ends with word k
        last = np.concatenate([begins[m - 1], np.zeros(most, bool)])
        on = on & last[at + k + 1 - m]
        rows[on, k] = h[at[on] + k]
    return distinct_rows(rows, np.ones(len(rows), np.int64))


def distinct_rows(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[new], np.add.reduceat(n, new)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text): every word of each language."""
    return docs.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def salt_without_clash(words: DataFrame, least: int) -> str:
    """The first salt for which no two words of a language, together as frequent as asked, have one hash."""
    for salt in ("", *(f"\t{i}\t" for i in range(100))):  # no word holds a tab
        h = F.xxhash64(F.concat(F.lit(salt), "word")).alias("h")
        if words.select("lang", h, "n").groupBy("lang", "h").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).where((F.col("n") >= least) & ((F.col("words") > 1) | (F.col("h") == 0))).isEmpty():
            return salt
    raise RuntimeError("no hash tells the words apart")


def longest_grams(docs: DataFrame, frequent: DataFrame, salt: str, most: int, least: int, words: int) -> DataFrame:
    """(lang, g, n): the edges of the graph (g of most word hashes) and the shorter grams that end a piece, with their numbers. frequent: lang
    and word of the frequent words; words: the number of all. Pieces are cut at words, pairs and triples that occur less than least times."""
    known = Frequent(salt, [_word_map(frequent, salt)])
    for _ in range(2, min(most, 3) + 1):
        known = Frequent(salt, [*known.maps, known.next_map(docs, least, words)])
    hold = docs.sparkSession.sparkContext.broadcast(known)

    bits = _pack_bits(words)

    def packed(lang: str, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lead = np.zeros(len(rows), np.uint64)
        for c in rows.T:
            lead = (lead ^ c) * _M1
            lead ^= lead >> np.uint64(29)
        lead = (lead * _M2 >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(lead, kind="stable")
        own, start = np.unique(lead[order], return_index=True)
        parts = list(zip(start, [*start[1:], len(rows)], strict=True))
        rows, n = np.ascontiguousarray(rows[order]), n[order].astype("<i8")
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(own), pa.string()), "k": own,
            "rows": pa.array([rows[a:b].tobytes() for a, b in parts], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in parts], pa.binary()),
        })

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, h, begins in hold.value.runs(batches):
            if len(h) < 2:
                continue
            rows, n = grams(h, begins, most)
            if not len(rows):
                continue
            if lang in held:
                rows, n = distinct_rows(np.concatenate([held[lang][0], rows]), np.concatenate([held[lang][1], n]))
            held[lang] = rows, n
            if sum(len(n) for _, n in held.values()) > HELD // 4:
                for name, part in held.items():
                    yield packed(name, *part)
                held.clear()
        for name, part in held.items():
            yield packed(name, *part)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, n = np.frombuffer(b"".join(pdf["rows"]), np.uint64).reshape(-1, most), np.frombuffer(b"".join(pdf["n"]), "<i8")
        rows, n = distinct_rows(rows, n)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(rows), "g": [r[r != 0].view(np.int64) for r in rows], "n": n})

    made = docs.mapInArrow(emit, "lang string, k int, rows binary, n binary")
    return made.groupBy("lang", "k").applyInPandas(add_up, "lang string, g array<bigint>, n bigint")


def _pack_bits(words: int) -> int:
    """Leading bits by which keys are packed, so that a pack's group holds those of a million words or so, whatever the table's size."""
    return min(max((words >> 20).bit_length(), 5), MAP_BITS - 13)


def _word_map(frequent: DataFrame, salt: str) -> Bitmap:
    """The map of the frequent words, put together by leading bits: a row for each part of the map comes to the driver."""
    bits = 10

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = word_hash(salt)
        for pdf in batches:
            h = np.array([make(w.encode()) for w in pdf["word"]], np.uint64)
            keys = np.concatenate([gram_keys(h[i:i + 1], 1, lang) for i, lang in enumerate(pdf["lang"])] or [np.zeros(0, np.uint64)])
            yield pd.DataFrame({"k": (keys >> np.uint64(64 - bits)).astype(np.int32), "at": (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64) & (1 << (MAP_BITS - bits)) - 1})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << (MAP_BITS - bits), bool)
        on[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"k": pdf["k"].iloc[:1].to_numpy(), "bits": [np.packbits(on, bitorder="little").tobytes()]})

    made = frequent.select("lang", "word").mapInPandas(run, "k int, at bigint").distinct().groupBy("k").applyInPandas(add_up, "k int, bits binary")
    return Bitmap([tuple(r) for r in made.collect()], bits)


def flows(longest: DataFrame, most: int) -> dict[int, DataFrame]:
    """By length from most to 2: (lang, g, n) of all grams. The number of a shorter gram is the flow out of it, one word on, and
    the pieces that end with it."""
    of = {most: longest.where(F.size("g") == most)}
    for m in range(most - 1, 1, -1):
        out = of[m + 1].select("lang", F.slice("g", 1, m).alias("g"), "n").unionByName(longest.where(F.size("g") == m))
        of[m] = cut(out.groupBy("lang", "g").agg(F.sum("n").alias("n")))
    return of


def unary_paths(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(lang, words, n): the edges (lang, g, n) with those that follow each other through a unary node joined, PATH_EDGES at most.

    A node (lang, g, n) is unary if one edge brings and one takes all that passes it: its number is that of both. A path begins where an
    edge has no such node before it, and at one edge in 16, so that cycles are cut too. Edges find their path's beginning by doubling
    the distance each round; those that have not after the last round are paths of their own."""
    edges = cut(edges.select("lang", "g", "n").withColumn("id", F.monotonically_increasing_id()))
    side = lambda start, name: edges.select("lang", F.slice("g", start, most - 1).alias("v"), F.col("n").alias("m"), F.col("id").alias(name))
    at = nodes.select("lang", F.col("g").alias("v"), F.col("n").alias("m"))
    linked = cut(side(2, "before").join(at, ["lang", "v", "m"]).join(side(1, "id"), ["lang", "v", "m"]).select("id", "before"))
    start = F.col("before").isNull() | (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(16)) == 0)
    hops = edges.select("id").join(linked, "id", "left").select("id", F.when(~start, F.col("before")).alias("to"), F.when(start, F.col("id")).alias("head"), F.when(start, 0).otherwise(1).alias("d"))
    hops = cut(hops)
    for _ in range(PATH_EDGES.bit_length() - 1):
        if hops.where("head is null").isEmpty():
            break
        far = hops.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("head").alias("head2"), F.col("d").alias("d2"))
        on = hops.where("head is null").join(far, "to").select("id", F.col("to2").alias("to"), F.col("head2").alias("head"), (F.col("d") + F.col("d2")).alias("d"))
        hops = cut(hops.where("head is not null").unionByName(on))
    placed = hops.select("id", F.coalesce("head", "id").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(F.col("d")).alias("d")).join(edges, "id")
    path = placed.groupBy("head").agg(F.first("lang").alias("lang"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "g"))).alias("e"))
    rest = F.transform(F.slice("e", 2, PATH_EDGES + 1), lambda x: F.element_at(x["g"], -1))
    return path.select("lang", F.concat(F.col("e")[0]["g"], rest).alias("words"), "n")


def _inside(words: str, lengths: list[int]) -> Column:
    """All runs of those lengths in an array of words that are shorter than the whole."""
    def runs(m: int) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(words) - m + 1, F.lit(1)))
        return F.when(F.size(words) > m, F.transform(begins, lambda i: F.slice(words, i, F.lit(m)))).otherwise(F.array().cast("array<array<bigint>>"))

    return F.array_distinct(F.concat(*map(runs, lengths)))


def ranked_first(df: DataFrame, by: str, order: list[Column], top: int, spread: str) -> DataFrame:
    """df with rank: the rows of each by that rank among its first top, rows that tie with the last included. Ranked in 64 parts first, so that
    a class that holds most rows is not one task's."""
    part = F.pmod(F.xxhash64(spread, F.lit(23)), F.lit(64))
    some = df.withColumn("__part", part).withColumn("__r", F.rank().over(Window.partitionBy(by, "__part").orderBy(*order))).where(F.col("__r") <= top).drop("__part", "__r")
    return some.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def phrase_candidates(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(candidates, words). candidates: lang, words (hashes), a, l, r, n, score, before any cut at a rank; words: lang, h, word of the
    frequent words."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = cut(word_counts(docs))
    salt = salt_without_clash(counted, least)
    frequent = cut(counted.where(F.col("n") >= least).withColumn("h", F.xxhash64(F.concat(F.lit(salt), "word"))))
    totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))

    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    longest = cut(longest_grams(docs, frequent, salt, most, least, n_words))
    counts = frequent.select("lang", F.array("h").alias("g"), "n")
    levels = flows(longest, most)
    for of in levels.values():
        counts = counts.unionByName(of.where(F.col("n") >= least))
    counts = cut(counts)
    long_enough = counts.where(F.size("g") > 1)

    paths = unary_paths(counts.where(F.size("g") == most), counts.where(F.size("g") == most - 1), most)
    longer = paths.select("lang", F.explode(_inside("words", list(range(2, most)))).alias("g"), "n").unionByName(
        long_enough.where(F.size("g") < most).select("lang", F.explode(_inside("g", list(range(2, most - 1)))).alias("g"), "n")
    )
    longer = cut(longer.groupBy("lang", "g").agg(F.max("n").alias("__longer")))
    stays = cut(long_enough.join(longer, ["lang", "g"], "left").where("__longer is null or __longer < n").select("lang", "g", F.col("n").alias("a")))

    cuts = stays.select("lang", "g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.select("lang", F.col("g").alias("words"), "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("x"), F.slice("g", F.col("k") + 1, F.size("g") - F.col("k")).alias("y"))
    number = lambda key, name: counts.select("lang", F.col("g").alias(key), F.col("n").alias(name))
    parts = cut(cuts.join(number("x", "l"), ["lang", "x"])).join(number("y", "r"), ["lang", "y"])
    parts = cut(parts.select("lang", "words", "a", "k", "l", "r")).join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    parts = parts.withColumn("up", whole["a"] * whole["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("down", whole["l"] * whole["r"])
    parts = parts.withColumn("score", F.expr("up div down"))  # whole numbers of up to 38 digits, no rounding
    best = parts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "words", "a", "m.l", "m.r", "n", "m.score"), frequent.select("lang", "h", "word")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of 2 to most words of each language.

    Texts are lower-cased (A-Z), cut into pieces at the marks . , ; : ! ? and line ends, and pieces into words at spaces and tabs. a counts all
    occurrences within pieces, overlaps included; phrases of least occurrences or more are candidates, unless they lie in a longer candidate
    of as many. score is floor(1000 * a * n / (l * r)) for the cut into two parts, of l and r occurrences, that scores lowest (ties: the
    earliest); n is the language's number of words. Numbers are exact at any size. Ranked by score, a, then phrase (bytes).

    Null and empty texts have no words, a null language is und, texts of any length are read whole, repeated rows count each. An empty table,
    or one without a frequent phrase, gives an empty result. Other columns are not used."""
    found, words = phrase_candidates(docs, lang_col, text_col, most, least)
    first = cut(ranked_first(found, "lang", [F.desc("score"), F.desc("a")], top, "words").drop("rank").withColumn("id", F.monotonically_increasing_id()))
    spelled = cut(first.select("id", "lang", F.posexplode("words").alias("pos", "h"))).join(words, ["lang", "h"])
    phrase = spelled.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w")).select("id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = first.join(phrase, "id").withColumn("rank", F.row_number().over(place).cast("bigint")).where(F.col("rank") <= top)
    return named.select("lang", "rank", "phrase", *[F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")])


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*)::HUGEINT AS f FROM spot, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
inner_of AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(f) AS f
  FROM (SELECT c.lang, c.w, c.f, c.m, k, unnest(range(1, c.m - k + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS k) WHERE k < c.m) GROUP BY ALL),
stays AS (SELECT c.* FROM c LEFT JOIN inner_of USING (lang, phrase) WHERE inner_of.f IS NULL OR 100 * inner_of.f < 100 * c.f),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, array_to_string(list_slice(s.w, 1, k), ' ') AS x, array_to_string(list_slice(s.w, k + 1, s.m), ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM stays) s),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, total.n, k, (1000 * a * total.n) // (x.f * y.f) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN g y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
