"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits its variants within half the radius; fingerprints that share a variant are compared. With
``parts`` = 1 the variants are those of the whole 64-bit word: radius 4 means all 2,081 words within 2 bits. With
``parts`` = 2 each half of the word is hashed so: two words that differ in 4 or 5 bits at most differ in 2 bits at most
in one of the halves, and 2 bits of a half meet at the variants within 1 bit, so 66 variants a fingerprint find
exactly the same links. Both are exact; the second shuffles 1/31 as much and is what the queries use.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, cut, forest, gathered, group_starts, join_one, lightest, map_texts, pairs_of_groups, shared_keys, whole_groups, written

#: Texts whose shingles are counted to tell common ones, how many common ones are told apart, rows that are broadcast at most.
SAMPLE, COMMON, SENT = 4_000, 100_000, 500_000
#: Columns of what rules pairs out before their texts travel: the sketch and the parities.
SIGNS = ["s1", "s2", "p1", "p2", "p3", "p4"]
#: Members of a large key's group that each text of it is compared with before all that is left.
MEMBERS = [0] + [int(x) for x in np.random.default_rng(6).integers(0, 2**62, 7)]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of the word shingles in order, repeats included; of the whole sequence when it has
    fewer words; of nothing when it has none. A-Z are lower-cased; words end at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    n = len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    first = [0, *ends[: n - 1].tolist()]
    return np.array([digest(line[a:b], 42) for a, b in zip(first, (ends[words - 1:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if set in more than half of the hashes; 0 for none. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 50_000):
        block = hashes[i:i + 50_000].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str = "text", words: int = 4) -> DataFrame:
    """id_cols and fp (signed long) over the shingles of so many words."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", fp bigint"
    return map_texts(docs, id_cols, lambda texts: {"fp": [fingerprint(shingle_hashes(t, words)) for t in texts]}, schema, text_col)


def _variants(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(part, mask of the part, bits to flip): what each fingerprint emits."""
    width = 64 // parts
    out = []
    for p in range(parts):
        bits = range(p * width, 64 if p == parts - 1 else (p + 1) * width)
        mask = sum(1 << k for k in bits)
        for n in range((radius // parts + 1) // 2 + 1):
            out += [(p, mask, sum(1 << k for k in c)) for c in combinations(bits, n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(p, signed(m), signed(f)) for p, m, f in out]


def _grow(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect one large group: each row reached asks only for rows not reached yet."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            ok = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            found, left = left[ok], left[~ok]
            queue.extend(found)
            a.extend([at] * len(found))
            b.extend(found)
    return a, b


def _balls(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """The variants of distinct fingerprints (column fp) that several of them have, those of one variant side by side."""
    v = F.explode(F.lit([list(x) for x in _variants(radius, parts)])).alias("v")
    keyed = nodes.select("fp", v).select(
        "fp", F.col("v")[0].cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("v")[1]).bitwiseXOR(F.col("v")[2]).alias("key")
    )
    return shared_keys(keyed, ["part", "key"], "fp")


def linked(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that differ in at most radius bits. No group's pairs
    are all emitted: a task returns a spanning forest of what it has compared."""
    small = 48

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = ["part", "key", "bi", "bj"]
        for pdf in whole_groups(batches, at):
            starts, ids = group_starts(pdf, at), pdf["fp"].to_numpy()
            fp = ids.view(np.uint64)
            i, j = pairs_of_groups(starts, small)
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            a, b = [i[ok]], [j[ok]]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > small:
                    x, y = _grow(fp[s:e], radius)
                    a.append(np.array(x, np.int64) + s)
                    b.append(np.array(y, np.int64) + s)
            i, j = np.concatenate(a), np.concatenate(b)
            x, y = forest(ids, i, j)
            yield pd.DataFrame({"a": x, "b": y})

    return _balls(nodes, radius, parts).mapInPandas(compare, "a bigint, b bigint")


def nearest(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """(a, b): of each distinct fingerprint a (column fp) with lower ones that differ in at most radius bits, the one of fewest such bits, of
    several the lowest. All that share a variant are compared; a task returns one row a fingerprint."""
    small = 48

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = ["part", "key", "bi", "bj"]
        for pdf in whole_groups(batches, at):
            starts, ids = group_starts(pdf, at), pdf["fp"].to_numpy()

            def best(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
                bits = np.bitwise_count((ids[i] ^ ids[j]).view(np.uint64)).astype(np.int32)  # noqa: B023
                ok = bits <= radius
                x, y = ids[i[ok]], ids[j[ok]]  # noqa: B023
                out = pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y), "bits": bits[ok]})
                return out.sort_values(["a", "bits", "b"]).drop_duplicates("a")

            found = [best(*pairs_of_groups(starts, small))]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                for k in range(s, e if e - s > small else s, 256):
                    i, j = np.meshgrid(np.arange(k, min(k + 256, e)), np.arange(k, e), indexing="ij")
                    found.append(best(i[i < j], j[i < j]))
            yield pd.concat(found).sort_values(["a", "bits", "b"]).drop_duplicates("a")

    found = _balls(nodes, radius, parts).mapInPandas(compare, "a bigint, b bigint, bits int")
    return found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", "m.b")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, parts: int = 2
) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id.

    Rows with fingerprints at most radius bits apart are linked; component_id is the smallest id that links reach.
    A null or empty text, or one of white space only, has fingerprint zero and links like any other. Equal
    fingerprints are one node with its smallest id, so copies are never paired. A row without id is kept and gets
    the component of its fingerprint; a fingerprint without any id has a null component_id. Repeated rows give a row each, a
    text of any length is read whole, an empty table gives an empty result. Other columns are not used.
    """
    fps = cut(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), ["__id"], "__text", words))
    nodes = cut(fps.groupBy("fp").agg(F.min("__id").alias("low"), F.count(F.lit(1)).alias("n")))
    found = components(linked(nodes.select("fp"), radius, parts))
    named = cut(nodes.join(found, nodes.fp == found.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    total, n_nodes = named.agg(F.sum("n"), F.count(F.lit(1))).first()
    by_fp = join_one(named.select("fp", "root"), lowest.drop("n"), "root", lowest, n_nodes, "fp").select("fp", "component_id")
    return join_one(fps, by_fp, "fp", named.select("fp", "n"), total or 0, "__id").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def prefix(hashes: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The first of the distinct hashes in an order that all texts share: those not in common (sorted) by value, then common ones
    by rank; and how many of the former. Sets of similarity least have a hash of both prefixes in common, whatever the order."""
    n = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    if not len(hashes) or not len(common):
        return hashes[:n], min(n, len(hashes))
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    known = common[at] == hashes
    return np.concatenate([hashes[~known], hashes[known][np.argsort(rank[at[known]])]])[:n], min(n, int((~known).sum()))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 bits as two numbers: of each bin, the lowest bit of the smallest of the mixed hashes that fall into it, 0 for an empty bin.
    Bits of two texts differ with half of what their similarity lacks to 1, so pairs are ruled out before their texts travel."""
    if not len(hashes):
        return np.zeros(2, np.int64)
    bins = np.arange(128, dtype=np.uint64)
    mixed = np.sort(hashes * np.uint64(0x9E3779B97F4A7C15))
    low = mixed[np.minimum(np.searchsorted(mixed, bins << np.uint64(57)), len(mixed) - 1)]
    return np.packbits((low & np.uint64(1) > 0) & (low >> np.uint64(57) == bins)).view(np.int64)


def lone(least: float) -> float:
    """Of the sizes of two sets of the similarity together, the share that only one of them may have."""
    return (1 - least) / (1 + least)


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: of each bin, whether an odd number of the distinct hashes falls into it. Two sets' bits differ in no more
    places than the sets have hashes that only one of them has."""
    bins = (hashes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
    return np.packbits((np.bincount(bins.astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def apart(least: float, errors: float | None) -> int:
    """Bits that pairs of the similarity may differ in: the mean and so many standard errors, or all without a number."""
    p = (1 - least) / 2
    return 128 if errors is None else int(128 * p + errors * (128 * p * (1 - p)) ** 0.5)


def _common(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and their ranks, rarest first. They order the prefixes and tell the keys
    that many texts may have: which texts are sampled changes the work, never the result."""
    n = max(1, slim.count())
    some = slim.where(F.pmod(F.xxhash64("__id", F.lit(13)), F.lit(n)) < SAMPLE)
    found = map_texts(some, ["__id"], lambda texts: {"s": [shingle_set(t, shingle).view(np.int64) for t in texts]}, f"__id {dict(slim.dtypes)['__id']}, s array<bigint>", "__text")
    top = found.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    hashes = top["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], -order


def profiles(slim: DataFrame, least: float, shingle: int) -> DataFrame:
    """__id, k1, k2, words_hash (equal for texts of the same words), SimHash fingerprint, number of distinct shingles, their prefix, how many
    of it are no common ones, the sketch as s1 and s2, and the parities as p1 to p4."""
    sent = slim.sparkSession.sparkContext.broadcast(_common(slim, shingle))

    def run(texts: list[str]) -> dict:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        sets = [np.unique(h) for h in hashes]
        firsts, signs = [prefix(s, least, *sent.value) for s in sets], [np.concatenate([sketch(s), parities(s)]) for s in sets]
        return {
            "words_hash": [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) for t in texts],
            "fp": [fingerprint(h) for h in hashes], "size": [len(s) for s in sets], "prefix": [p.view(np.int64) for p, _ in firsts], "rare": [n for _, n in firsts],
            **{c: [int(x[k]) for x in signs] for k, c in enumerate(SIGNS)},
        }

    schema = f"__id {dict(slim.dtypes)['__id']}, k1 bigint, k2 bigint, words_hash binary, fp bigint, size bigint, prefix array<bigint>, rare bigint, " + ", ".join(f"{c} bigint" for c in SIGNS)
    return map_texts(slim, ["__id", "k1", "k2"], run, schema, "__text")


def _possible(size: F.Column, rest: F.Column, other: F.Column, other_rest: F.Column, least: float) -> F.Column:
    """Whether two texts of so many shingles, so many of them from a shared one on, can have the similarity if it is their first."""
    return F.least(rest, other_rest) >= least / (1 + least) * (size + other) - 1e-6


def _beside(pairs: DataFrame, n: int, one: DataFrame, col: str) -> DataFrame:
    """pairs (a, b) with col of both texts as x and y. A text that very many are paired with is no task's alone."""
    counts = {side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")) for side in "ab"}
    for side, name, other in (("a", "x", "b"), ("b", "y", "a")):
        pairs = join_one(pairs, one.select(F.col("id").alias(side), F.col(col).alias(name)), side, counts[side], n, other)
    return pairs


def _similar(pairs: DataFrame, named: DataFrame, slim: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have the similarity, exactly. Texts travel, as they pack better than hashes."""
    pairs = cut(pairs)
    n = pairs.count()
    pairs = gathered(pairs, n)
    asked = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(named, "id").select("id", "low.k1", "low.k2"))
    send = F.broadcast if asked.count() <= SENT else (lambda x: x)
    scratch = Scratch(slim.sparkSession)
    texts = scratch.written(slim.join(send(asked), ["k1", "k2"]).select("id", "__text").dropDuplicates(["id"]), "near-copies-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}  # of texts that are paired again: half a million hashes and one text's at most
        held = 0

        def of(i: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if i not in sets:
                if held > 500_000:
                    sets.clear()
                    held = 0
                sets[i] = shingle_set(text.as_py(), shingle)
                held += len(sets[i])
            return sets[i]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in "ab"], *[batch.column(c) for c in "xy"], strict=True):
                x, y = of(a, x), of(b, y)
                n = len(x) + len(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                both = int((both[1:] == both[:-1]).sum())
                ok.append(both / (n - both) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = cut(_beside(pairs, n, texts, "__text").mapInArrow(compare, "a bigint, b bigint"))
    scratch.drop()
    return found


def _meeting(shared: DataFrame, least: float, most: int, turn: int | None = None) -> DataFrame:
    """The distinct pairs (a, b) of different groups g that a key of both prefixes and the sketches leave possible: the first key that two
    texts share bounds what they have in common by what follows it. With a turn, of all the pairs of a task only as many as connect the
    groups that all of them connect, so fewer than it has rows: the most alike on turn 0, some others on each later one. n adds up to how many
    were possible (a pair counts once a key)."""
    rows = shared_keys(shared, ["key"], "id", 512)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = ["key", "bi", "bj"]
        for pdf in whole_groups(batches, at):
            starts = group_starts(pdf, at)
            ids, g, size, rest = (pdf[c].to_numpy() for c in ("id", "g", "size", "rest"))
            signs = [pdf[c].to_numpy().view(np.uint64) for c in SIGNS]  # of a negative number, bitwise_count counts the absolute value's bits
            differ = lambda i, j, some: sum(np.bitwise_count(s[i] ^ s[j]).astype(int) for s in some)

            def possible(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
                ok = (g[i] != g[j]) & (np.minimum(rest[i], rest[j]) >= least / (1 + least) * (size[i] + size[j]) - 1e-6)  # noqa: B023
                i, j = i[ok], j[ok]
                odd, room = differ(i, j, signs[2:]), lone(least) * (size[i] + size[j]) + 1e-6  # noqa: B023
                ok = odd <= room
                i, j, far = i[ok], j[ok], (odd / room)[ok]
                bits = differ(i, j, signs[:2])  # noqa: B023
                ok = bits <= most
                i, j, far = i[ok], j[ok], (far + bits / 32)[ok]
                x, y = ids[i], ids[j]  # noqa: B023
                found = pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y), "n": 1})
                return found.drop_duplicates().assign(n=0) if turn is None else found.assign(ga=g[i], gb=g[j], far=far + turn * noise(x ^ y))  # noqa: B023

            def noise(x: np.ndarray) -> np.ndarray:
                return (((x.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) / 2**27  # up to 1/8

            def few(pairs: pd.DataFrame) -> pd.DataFrame:
                stay = pairs.iloc[lightest(*(pairs[c].to_numpy() for c in ("ga", "gb", "far")))]
                return stay.assign(n=np.where(np.arange(len(stay)) == 0, pairs["n"].sum(), 0))

            def found() -> Iterator[pd.DataFrame]:
                yield possible(*pairs_of_groups(starts, 48))  # noqa: B023
                for s, e in zip(starts[:-1], starts[1:], strict=True):  # noqa: B023
                    if e - s > 48:
                        for k in range(s, e, 256):
                            i, j = np.meshgrid(np.arange(k, min(k + 256, e)), np.arange(k, e), indexing="ij")
                            yield possible(i[i < j], j[i < j])

            yield from found() if turn is None else [few(pd.concat(map(few, found())))[["a", "b", "n"]]]

    return rows.mapInPandas(compare, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _in_balls(classes: DataFrame, radius: int, parts: int) -> DataFrame:
    """Pairs (a, b) of classes (id, fp) that the SimHash method finds: each with the lowest of its fingerprint, and that one with the lowest of
    the nearest lower fingerprint in its ball. One or two pairs a class at most."""
    heads = cut(classes.groupBy("fp").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    n = classes.count()
    same = join_one(classes, heads.select("fp", "head"), "fp", heads.select("fp", "n"), n, "id").where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    near = cut(nearest(heads.select("fp"), radius, parts))
    found = _beside(near, n, heads.select(F.col("fp").alias("id"), "head"), "head").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return same.union(found)


def row_key(df: DataFrame) -> list[F.Column]:
    """128 bits that tell rows of different contents apart, wherever and in whatever order they are read."""
    kinds = dict(df.dtypes)
    cells = [F.coalesce(F.xxhash64(F.col(f"`{c}`"), F.lit(i)), F.lit(0)) for i, c in enumerate(df.columns) if "map<" not in kinds[c] and kinds[c] != "variant"]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"k{seed}") for seed in (1, 2)]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, errors: float | None = 6.0, radius: int = 4, parts: int = 2) -> DataFrame:
    """The rows of docs less near copies: one stays of each group linked by similarity on five-word shingles.

    Two texts are linked if their sets of shingles (64-bit hashes) have the Jaccard similarity. First comes the SimHash method: the fingerprint of a
    text's shingles, met in the middle with those within radius bits (see the module), and the exact similarity of what is nearest there. A pair
    of the similarity may be further apart than any radius that tells it from others, so the links are completed without loss: such texts
    share a shingle of their prefixes (see prefix). Each text is compared with the lowest and the highest of those it shares most with, then
    with some members of the largest group that shares a shingle with it. While more pairs than texts are then possible, and half as many
    each time, only so many are compared as would join the groups in question, the most alike first; in the end every other pair that
    shares a shingle and is not yet in one group is. The number of pairs goes by a large group's square only where its texts are no links
    and what follows cannot tell that. Parities spare pairs the comparison without loss (see parities), and 128-bit
    sketches those further apart than the bound's mean and errors standard errors. At 0.8 and 6 that is over 33 bits, which a pair at the bound
    itself passes with probability 8.5e-8 (binomial), a closer one with less; errors=None compares all, and then nothing is lost.

    Texts with the same words are one class. The row with the smallest id of a group stays (of repeated ids the one of the lowest row_key,
    of rows equal in every column but maps one). Null and empty texts and those without a word are left alone, as are rows without id:
    neither has anything to compare or to be named by. Texts are read whole, an empty table stays empty, columns of any name stay as
    they are. docs is read several times, so it should be a table; rows go by their contents, so their order may differ each time.
    """
    cols, keys, scratch, most = docs.columns, row_key(docs), Scratch(docs.sparkSession), apart(similarity, errors)
    slim = docs.select(*keys, F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where("__id is not null")
    rows = scratch.written(profiles(slim, similarity, shingle).where("size > 0").withColumn("row", F.monotonically_increasing_id()), "near-copies-profiles")
    low = F.min(F.struct("__id", "k1", "k2", "row"))
    named = cut(rows.groupBy("words_hash").agg(low.alias("low")).select("words_hash", F.col("low.row").alias("id"), "low"))
    again = cut(rows.select("words_hash", "row").join(named.select("words_hash", "id"), "words_hash").where("row != id").select("row"))
    classes = rows.join(F.broadcast(again) if again.count() <= SENT else again, "row", "left_anti").withColumnRenamed("row", "id")

    keyed = classes.select("id", "size", "rare", F.posexplode("prefix").alias("pos", "key")).select("key", "id", "size", (F.col("size") - F.col("pos")).alias("rest"), (F.col("pos") >= F.col("rare")).alias("hot"))
    of_key, ends = Window.partitionBy("key"), F.struct("id", "size", "rest")
    known = keyed.where("hot").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("lo"), F.max(ends).alias("hi"))
    met = (
        keyed.where("not hot").withColumns({"n": F.count(F.lit(1)).over(of_key), "lo": F.min(ends).over(of_key), "hi": F.max(ends).over(of_key)})
        .unionByName(keyed.where("hot").join(F.broadcast(known), "key"))  # at most COMMON rows
        .where("n > 1")
    )
    two_fit = _possible(F.col("lo.size"), F.col("lo.rest"), F.col("hi.size"), F.col("hi.rest"), similarity)
    head = lambda x: F.when((F.col("id") != F.col(f"{x}.id")) & _possible(F.col("size"), F.col("rest"), F.col(f"{x}.size"), F.col(f"{x}.rest"), similarity), F.col(f"{x}.id")).alias(x)
    shared = scratch.written(met.where((F.col("n") > 2) | two_fit).select("key", "id", "size", "rest", head("lo"), head("hi")), "near-copies-keys")

    heads = [
        shared.where(f"{x} is not null").groupBy("id", x).count().groupBy("id").agg(F.max(F.struct("count", x)).alias("m"))
        .select(F.greatest("id", f"m.{x}").alias("a"), F.least("id", f"m.{x}").alias("b"))
        for x in ("lo", "hi")
    ]
    signs = cut(classes.select("id", F.struct("size", *SIGNS).alias("s")))

    def tried(pairs: DataFrame) -> DataFrame:
        """Links of the pairs (a, b) that their sketches leave possible."""
        pairs = cut(pairs)
        differ = lambda some: sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in some), F.lit(0))
        may = (differ(SIGNS[:2]) <= most) & (differ(SIGNS[2:]) <= lone(similarity) * (F.col("x.size") + F.col("y.size")) + 1e-6)
        n = pairs.count()
        near = _beside(gathered(pairs, n), n, signs, "s").where(may).select("a", "b")
        return _similar(near, named, slim, similarity, shingle)

    def placed(links: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of rows of keys that more than one group has: the rows with their group g, and the keys with n rows and some members."""
        group = components(links)
        rows = rows.join(group, rows.id == group.node, "left").select("key", "id", "size", "rest", F.coalesce("root", "id").alias("g"))
        some = [F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"m{k}") for k, m in enumerate(MEMBERS)]
        keys = rows.groupBy("key").agg(F.min("g").alias("one"), F.max("g").alias("other"), F.count(F.lit(1)).alias("n"), *some).where("one != other")
        keys = cut(keys.select("key", "n", F.array(*[f"m{k}" for k in range(len(MEMBERS))]).alias("members")))
        return scratch.written(join_one(rows, keys.select("key", "n"), "key", keys, n_shared, "id"), "near-copies-open"), keys

    ball = cut(_in_balls(classes.select("id", "fp"), radius, parts))
    links = tried(ball)
    n_shared = shared.count()
    links = cut(links.union(tried(heads[0].union(heads[1]).distinct().join(ball, ["a", "b"], "left_anti"))))
    open_rows, open_keys = placed(links, shared)
    widest = cut(open_rows.groupBy("id").agg(F.max(F.struct("n", "key")).alias("m"), F.first("g").alias("g")).select("id", "g", "m.key"))
    sizes = widest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = cut(join_one(widest, open_keys.select("key", "members"), "key", sizes, n_shared, "id").select("id", "g", F.explode("members").alias("m")).where("id != m").distinct())
    members = join_one(asked, widest.select(F.col("id").alias("m"), F.col("g").alias("mg")), "m", asked.groupBy("m").agg(F.count(F.lit(1)).alias("n")), n_shared, "id")
    more = tried(members.where("g != mg").select(F.greatest("id", "m").alias("a"), F.least("id", "m").alias("b")).distinct())
    links = cut(links.union(more))

    def meeting(turn: int | None) -> DataFrame:
        return _meeting(open_rows.drop("n").join(signs.select("id", *[f"s.{c}" for c in SIGNS]), "id"), similarity, most, turn)

    open_rows, _ = placed(links, open_rows.drop("g", "n"))
    seen, n_texts, before = links, classes.count(), float("inf")
    for turn in count():  # as long as each leaves half as many possible pairs
        pairs = cut(meeting(turn))
        possible = pairs.agg(F.sum("n")).first()[0] or 0
        if possible <= n_texts or 2 * possible > before:
            break
        before = possible
        pairs = cut(pairs.select("a", "b").join(seen, ["a", "b"], "left_anti"))
        more = _similar(pairs, named, slim, similarity, shingle)
        if more.isEmpty():
            break
        seen, links = cut(seen.union(pairs)), cut(links.union(more))
        open_rows, _ = placed(links, open_rows.drop("g", "n"))
    left = meeting(None).select("a", "b").join(seen, ["a", "b"], "left_anti")
    more = _similar(left, named, slim, similarity, shingle)

    found = components(links.union(more))
    groups = named.join(found, named.id == found.node, "left").select("low", F.coalesce("root", "id").alias("root"))
    stays = groups.groupBy("root").agg(F.min("low").alias("low")).select("low.k1", "low.k2", F.lit(True).alias("once"))
    # a key that is not here stays; one that goes, and one of a row that stays once of several equal ones
    verdict = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).join(stays, ["k1", "k2"], "left")
    verdict = written(verdict.where("once is null or n > 1").select("k1", "k2", F.coalesce("once", F.lit(False)).alias("once")), "near-copies-verdict")
    scratch.drop()
    send = F.broadcast if verdict.count() <= SENT else (lambda x: x)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), *keys)
    out = marked.join(send(verdict), ["k1", "k2"], "left_anti")
    repeated = verdict.where("once")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(send(repeated.drop("once")), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    return out.select("r.*")
