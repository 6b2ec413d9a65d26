"""Embedding and SimHash near-duplicates, sharding and decontamination against brute force."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldwright.llm import common, decontam, embeddings, shards, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- op1

VECS = "vec_id long, embedding array<float>, label int, n_links string"


def brute_vectors(rows, least=0.93):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab, _ in rows if v is not None and lab is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    n, links = defaultdict(int), []
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    r = roots([x[0] for x in rows], links)
    return {i: (n[i], r[i], r[i] == i) for i, *_ in rows}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(40, 64))
    for k in range(40):
        rows.append((len(rows), (base[k] / np.linalg.norm(base[k])).tolist(), k % 3))
        for _ in range(k % 5):  # neighbours around the bound
            v = base[k] / np.linalg.norm(base[k]) + rng.normal(size=64) * rng.uniform(0.01, 0.06)
            rows.append((len(rows), v.tolist(), k % 3))
    hot = rng.normal(size=64)
    for _ in range(60):
        rows.append((len(rows), (hot + rng.normal(size=64) * 0.05).tolist(), 1))
    rows += [(len(rows) + i, hot.tolist(), 1) for i in range(5)]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 10, hot.tolist(), None), (n + 11, (hot * 3).tolist(), 2)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab, "clash") for i, v, lab in rows]


def test_embeddings_match_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, VECS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_components(df).collect()}
    want = brute_vectors(vectors)
    assert set(got) == set(want)
    links = sum(w[0] for w in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * links > 0
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the bound
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


@pytest.mark.parametrize(("block", "split", "sent"), [(8, 1024, 1000), (16_384, 4, 1000), (8, 4, 0)])
def test_embedding_blocks_count_each_pair_once(spark, vectors, monkeypatch, block, split, sent):
    """Long lists cut into blocks, and read by their second pivot, give the same links."""
    df = spark.createDataFrame(vectors, VECS)
    want = sorted(map(tuple, embeddings.embedding_components(df).collect()))
    for name, value in (("LIST_BLOCK", block), ("SPLIT_ROWS", split), ("SENT_LISTS", sent), ("CELLS", 50)):
        monkeypatch.setattr(embeddings, name, value)
    assert sorted(map(tuple, embeddings.embedding_components(df).collect())) == want


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    """80 lengths, a near pair in each; two rows of one id with other vectors, each with a partner of its own."""
    rng = np.random.default_rng(4)
    rows = []
    for d in range(3, 83):
        v = rng.normal(size=d)
        rows += [(2 * d, v.tolist(), 1, ""), (2 * d + 1, (v * 1.5).tolist(), 1, "")]
    a, b = rng.normal(size=(2, 64))
    rows += [(1000, a.tolist(), 2, ""), (1001, (2 * a).tolist(), 2, ""), (1000, b.tolist(), 2, ""), (1002, (2 * b).tolist(), 2, "")]
    got = sorted(tuple(r)[:3] for r in embeddings.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string")).collect())
    want = [(i, 1, i - i % 2) for i in range(6, 166)] + [(1000, 1, 1000), (1000, 1, 1000), (1001, 1, 1000), (1002, 1, 1000)]
    assert got == want


@pytest.mark.parametrize("pivots", [64, 512])
def test_recall_near_the_bound(pivots):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    index = embeddings.Pivots({64: x[:2000]}, pivots)
    for cosine in (0.93, 0.95, 0.98):
        y = cosine * x + (1 - cosine**2) ** 0.5 * u
        a, b = (index.nearest(v, 5) for v in (x, y))
        assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= 2).mean() >= 0.9


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, None, 1, ""), (2, [0.0], 1, "")], VECS)
    assert sorted(map(tuple, embeddings.embedding_components(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embeddings.embedding_components(df.limit(0)).count() == 0


# --- op6


def brute_fingerprint(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def some_texts(rng, n=60):
    vocab = ["the", "of", "Straße", "ÉTÉ", "x\x0by", "a b", "und"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 60))) for _ in range(n)]
    long = [" ".join(rng.choice(vocab, 400)) for _ in range(4)]
    near = []
    for t in long:
        for _ in range(6):
            w = t.split(" ")
            w[rng.integers(len(w))] = "changed"
            near.append(" ".join(w))
    return texts + long + near + texts[:5] + [None, "", " \t\n", "one", "ONE", " ", "z" * 100_000, "Q " * 30_000]


@pytest.mark.parametrize("parts", [1, 2])
def test_simhash_matches_brute_force(spark, parts):
    texts = some_texts(np.random.default_rng(6))
    df = spark.createDataFrame([(i, t, "fingerprint", "component_id", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df, parts=parts).collect()}
    fp = [brute_fingerprint(t, 4) for t in texts]
    links = [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    want = roots(range(len(fp)), links)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in range(len(fp))}
    assert len(links) > 10


@pytest.mark.parametrize(("radius", "parts"), [(4, 1), (4, 2), (5, 2), (3, 2), (8, 3)])
def test_every_pair_within_the_radius_meets(radius, parts):
    rng = np.random.default_rng(radius)
    flips = simhash._variants(radius, parts)
    for _ in range(300):
        x = int(rng.integers(2**63))
        y = x
        for k in rng.choice(64, rng.integers(1, radius + 1), replace=False):
            y ^= 1 << int(k)
        keys = [{(p, (v & m & (2**64 - 1)) ^ (f & (2**64 - 1))) for p, m, f in flips} for v in (x, y)]
        assert keys[0] & keys[1]


def test_simhash_of_an_empty_table_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b c", "", "", 0), (2**60 + 1, "a b c", "", "", 0)], DOCS)
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()} == {(None, 2**60 + 1), (2**60 + 1, 2**60 + 1)}


def test_near_copies_keep_one_of_each_group(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(8)]
    rows, group = [], []
    for g, t in enumerate(base):
        for _ in range(4):
            w = t.split()
            w[rng.integers(200)] = "other"
            rows.append(" ".join(w))
            group.append(g)
    rows += [base[0].upper(), base[0], None, "", None]
    df = spark.createDataFrame([(i, t, "x", "__row", 1) for i, t in enumerate(rows)], DOCS)
    kept = simhash.drop_near_copies(df)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns
    assert ids == {0, 4, 8, 12, 16, 20, 24, 28} | {34, 35, 36}


def test_clean_texts_of_common_words_stay(spark):
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(["the", "of", "and", "to", "in"], 80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    assert simhash.drop_near_copies(df).count() == 60


def similarity_roots(texts):
    """Brute force over five-word shingles: the smallest row of each group at 0.8 or more; None of texts without a word."""
    sets = []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return roots(range(len(texts)), links), sets


def kept_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id for r in simhash.drop_near_copies(df).collect()}


def test_every_pair_of_a_large_group_counts(spark):
    """The middle text is unlike the others, which are near copies of each other: more than 16 such groups share their words."""
    rng = np.random.default_rng(21)
    words = [f"word{x}" for x in range(60)]
    texts = []
    for _ in range(12):
        lead = list(rng.permutation(words))
        texts += [" ".join(lead), " ".join(rng.permutation(lead)), " ".join(lead[:-1] + ["other"])]
    want, _ = similarity_roots(texts)
    assert len(set(want.values())) == 24
    assert kept_of(spark, texts) == set(want.values())


def test_near_copies_of_one_bag_of_words(spark):
    """B and C have A's words in another order and are near copies; D is like B alone. Only A's class has the smallest id."""
    rng = np.random.default_rng(22)
    texts = []
    for g in range(8):
        a = [f"item{g}x{x}" for x in range(80)]
        b = list(rng.permutation(a))
        c = b[:76] + b[76:][::-1]
        texts += [" ".join(a), " ".join(b), " ".join(c), " ".join(b[:-1] + ["different"])]
    want, _ = similarity_roots(texts)
    assert kept_of(spark, texts) == set(want.values()) == {i for g in range(8) for i in (4 * g, 4 * g + 1)}


@pytest.mark.parametrize("n", [14, 20, 40, 80, 300])
def test_near_copies_are_found_at_every_length(spark, n):
    rng = np.random.default_rng(n)
    texts = []
    for _ in range(40):
        w = [f"ab{x}" if x % 3 else f"longer{x}" for x in rng.integers(0, 4000, n)]
        texts.append(" ".join(w))
        for at in (0, n - 1, n // 2):
            texts.append(" ".join(w[:at] + [f"replaced{at}"] + w[at + 1:]))
    want, _ = similarity_roots(texts)
    assert len(set(want.values())) < len(texts)
    assert kept_of(spark, texts) == set(want.values())


def test_the_bound_of_similarity_is_exact(spark):
    """Pairs of 100 to 104 shingles with 0.74 to 0.86 of them in common, many at the very bound."""
    texts = []
    for g in range(40):
        w = [f"g{g}w{x}" for x in range(104)]
        n = 84 + g % 16
        texts += [" ".join(w), " ".join(w[:n] + [f"g{g}z{x}" for x in range(n, 104 - g % 5)])]
    want, sets = similarity_roots(texts)
    share = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(texts), 2)]
    assert min(share) < 0.77 and max(share) > 0.83 and 0 < len(set(want.values())) < len(texts)
    assert kept_of(spark, texts) == set(want.values())


def test_common_passages_and_orders_lose_no_pair(spark, monkeypatch):
    """Passages that many texts share, and any sample for the order, leave the result as it is."""
    rng = np.random.default_rng(23)
    lines = [" ".join(f"line{k}w{x}" for x in range(30)) for k in range(3)]
    texts = []
    for _ in range(90):
        w = " ".join(f"w{x}" for x in rng.integers(0, 9000, rng.integers(5, 90)))
        texts.append(f"{lines[rng.integers(3)]} {w}")
        if rng.random() < 0.5:
            texts.append(f"{texts[-1]} {' '.join(f'v{x}' for x in rng.integers(0, 9000, rng.integers(1, 25)))}")
    want = set(similarity_roots(texts)[0].values())
    assert kept_of(spark, texts) == want
    monkeypatch.setattr(simhash, "SAMPLE", 5)
    monkeypatch.setattr(simhash, "SENT", 0)
    assert kept_of(spark, texts) == want


def test_the_nearest_of_a_ball_is_found_and_compared(spark):
    """Random words and such with bits flipped, 60 of them with one half in common; then texts of which one word in 300 differs."""
    rng = np.random.default_rng(31)
    flip = lambda x, bits: x ^ sum(1 << int(b) for b in set(bits))
    base = [int(x) for x in rng.integers(0, 2**63, 250)]
    words = base + [flip(x, rng.integers(0, 64, rng.integers(1, 6))) for x in base[:150]] + [flip(base[0], rng.integers(0, 32, 2)) for _ in range(60)]
    words = sorted({x - (1 << 64) if x >> 63 else x for x in words})
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {a: min(near)[1] for a in words if (near := [(apart(a, b), b) for b in words if b < a and apart(a, b) <= 4])}
    assert len(want) > 100
    assert {r.a: r.b for r in simhash.nearest(spark.createDataFrame([(x,) for x in words], "fp long"), 4, 2).collect()} == want
    texts = [[f"w{k}x{x}" for x in rng.integers(0, 4000, 300)] for k in range(6)]
    texts = [" ".join(w) for w in texts] + [" ".join(w[:150] + ["other"] + w[151:]) for w in texts]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts]
    near = {(k + 6, k) for k in range(6) if apart(fps[k], fps[k + 6]) <= 4}
    assert near and {(r.a, r.b) for r in simhash._in_balls(spark.createDataFrame(list(enumerate(fps)), "id long, fp long"), 4, 2).collect()} == near


def test_signs_rule_out_no_pair_of_the_similarity(spark):
    """Numbers with the highest bit set count as their bits; parities never differ more than the sets do."""
    rows = [(1, k, k, 20, 20, *[(1 - 2**63) * (k == c) for c in range(1, 7)]) for k in range(7)]
    pairs = simhash._meeting(spark.createDataFrame(rows, "key long, id long, g long, size long, rest long, " + ", ".join(f"{c} long" for c in simhash.SIGNS)), 0.8, 33)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(7) for b in range(a)}
    rng = np.random.default_rng(32)
    for n in (0, 1, 7, 60, 400, 5000):
        a, b = (np.unique(np.concatenate([rng.integers(0, 2**64, n // 9, np.uint64), np.arange(n, dtype=np.uint64)])) for _ in range(2))
        bits = np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_few_pairs_connect_what_all_connect():
    rng = np.random.default_rng(33)
    for n, m in ((2, 1), (30, 20), (40, 400), (300, 3000)):
        a, b, weight = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7, rng.random(m)
        taken = common.lightest(a, b, weight)
        nodes = set(a) | set(b)
        want, got = (roots(nodes, list(zip(a[k], b[k], strict=True))) for k in (slice(None), taken))
        assert got == want and len(taken) == len(nodes) - len(set(want.values()))
        held, least = {x: x for x in nodes}, 0.0  # Kruskal
        for k in np.argsort(weight):
            if held[a[k]] != held[b[k]]:
                old, least = held[a[k]], least + weight[k]
                held = {x: held[b[k]] if r == old else r for x, r in held.items()}
        assert weight[taken].sum() == pytest.approx(least)
    assert not len(common.lightest(*[np.zeros(0, np.int64)] * 2, np.zeros(0)))


def test_pairs_of_a_large_group_do_not_go_by_its_square(spark, monkeypatch):
    """300 near copies of one text, of which a part of the pairs has the similarity: no more are told at first than texts, and no link is lost."""
    rng = np.random.default_rng(34)
    base = [f"base{x}" for x in range(150)]
    texts = []
    for k in range(300):
        w = list(base)
        for x in rng.choice(30, rng.choice((2, 3)), replace=False):
            w[5 * x + rng.integers(5)] = f"own{k}x{x}"
        texts.append(" ".join(w))
    told, meeting = [], simhash._meeting

    def met(*args):
        told.append(common.cut(meeting(*args)))
        return told[-1]

    monkeypatch.setattr(simhash, "_meeting", met)
    want, _ = similarity_roots(texts)
    assert kept_of(spark, texts) == set(want.values())
    assert len(told) > 1 and 0 < told[0].count() < 300


def test_rows_go_by_a_key_that_is_read_once(spark):
    """A source that gives its rows in another order each time it is read, as after a lost executor."""
    def reordered(batches):
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "little"))

    texts = [" ".join(f"t{k // 2}w{x}" for x in range(30)) for k in range(40)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    shuffled = df.mapInPandas(reordered, df.schema)
    for _ in range(3):
        assert {r.doc_id for r in simhash.drop_near_copies(shuffled).collect()} == set(range(0, 40, 2))


# --- shared parts


def test_a_hot_key_is_dealt_over_tasks(spark):
    """One star of 200,000 leaves over 200 partitions: no task holds a twentieth of its links."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200_000).selectExpr("1L AS a", "id + 5 AS b").union(spark.range(1000).selectExpr("id + 7000000 AS a", "id + 8000000 AS b"))
        counts = rows.groupBy("a").count().withColumnRenamed("count", "n")
        one = rows.groupBy("a").min("b").withColumnRenamed("min(b)", "m")
        joined = common.join_one(rows, one, "a", counts, 201_000, "b").withColumn("p", F.spark_partition_id())
        assert joined.count() == 201_000 and joined.where("m != least(m, b)").count() == 0
        assert joined.groupBy("p").count().agg(F.max("count")).first()[0] < 10_000
        got = common.components(rows)
        assert got.where("root = 1").count() == 200_000 and got.count() == 201_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 900)] + [(3, 3), (9, 8), (8, 9)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert {i: got.get(i, i) for i in want} == want


# --- op9


def test_shards_are_even_gapless_and_stable(spark):
    rows = [(i if i % 50 else None, None if i % 9 == 0 else "é" * (i % 7), "l", "shard", i) for i in range(1003)] + [(5, "same", "l", "s", 1)] * 7
    df = spark.createDataFrame(rows, DOCS)
    out = shards.uniform_shards(df, 13, rows_per_partition=100).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 1010 and len(sizes) == 13 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    again = shards.uniform_shards(df.repartition(7), 13, rows_per_partition=100).toPandas()
    key = ["doc_id", "text", "n_chars", "shard", "slot"]
    assert out[key].sort_values(key[2:]).fillna(-1).values.tolist() == again[key].sort_values(key[2:]).fillna(-1).values.tolist()
    other = shards.uniform_shards(df, 13, seed=7).toPandas()
    assert (other.sort_values("n_chars")["shard"].to_numpy() != out.sort_values("n_chars")["shard"].to_numpy()).mean() > 0.5


def test_shuffle_is_uniform(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    place = np.zeros((4, 4))
    for seed in range(40):
        out = shards.uniform_shards(df, 4, seed=seed).toPandas()
        place += np.histogram2d(out["doc_id"] // 50, out["shard"], bins=(4, 4))[0]
    assert np.abs(place / 40 - 12.5).max() < 2.5


def test_shard_columns(spark):
    df = spark.createDataFrame([(1, "né", "", "", 0), (2, None, "", "", 0)], DOCS)
    got = {r.doc_id: r for r in shards.sharded_documents(df).collect()}
    assert (got[1].size, got[1].text_crc32, got[1].law) == (19, zlib.crc32("né".encode()), "rows") and (got[2].size, got[2].text_crc32) == (16, 0)
    assert shards.sharded_documents(df.limit(0)).count() == 0


def test_matrix_keeps_both_margins():
    m = np.array(shards.communication_matrix([5, 0, 17, 300], shards.shard_sizes(322, 7), 1))
    assert m.sum(1).tolist() == [5, 0, 17, 300] and m.sum(0).tolist() == shards.shard_sizes(322, 7) and (m >= 0).all()


def test_draws_are_exact(spark):
    """Against the probabilities of small draws, and mean and variance of one of 10^10 rows."""
    from math import comb

    rng = np.random.default_rng(3)
    for good, bad, n in ((5, 9, 6), (1, 300, 40), (40, 3, 20), (7, 0, 4)):
        seen = np.bincount([shards.hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1) / 20_000
        want = [comb(good, x) * comb(bad, n - x) / comb(good + bad, n) for x in range(n + 1)]
        assert np.abs(seen[: n + 1] - want).max() < 0.015
    good, bad, n = 250_000_000, 9_750_000_000, 4_000_000
    x = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(3000)])
    mean, var = n * 0.025, n * 0.025 * 0.975 * (1 - n / 1e10)
    assert abs(x.mean() - mean) < 5 * (var / 3000) ** 0.5 and abs(x.var() / var - 1) < 0.15
    sizes = shards.shard_sizes(10**10 + 7, 40)
    m = np.array(shards.communication_matrix([10**10 // 50] * 49 + [10**10 + 7 - 49 * (10**10 // 50)], sizes, 1))
    assert m.sum(0).tolist() == sizes and m.sum(1)[:49].tolist() == [10**10 // 50] * 49 and (m >= 0).all()


def test_all_documents_are_sharded_by_the_contract(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = shards.sharded_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t) + 16, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert set(held) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1 and len(rows) == len(docs)


def test_own_columns_of_the_same_names_survive(spark):
    df = spark.createDataFrame([(i, i * 2, i * 3) for i in range(50)], "doc_id long, __k long, __p long")
    out = shards.uniform_shards(df, 4).collect()
    assert {(r["doc_id"], r["__k"], r["__p"]) for r in out} == {(i, i * 2, i * 3) for i in range(50)}
    texts = [(i, f"some text of its own number {i}", i * 2, "x") for i in range(6)] + [(7, "some text of its own number 0", 1, "y")]
    kept = simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string, __row long, k1 string"))
    assert {tuple(r) for r in kept.collect()} == set(texts[:6])


# --- op7


def brute_contamination(text, items, size=10):
    low = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[k:k + n]:
                    hit |= set(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(7)
    vocab = ["the", "of", "É", "é", "İx", "a1"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([12, 30, 9, 1, 0, 10, 25])] + [(9, None), (None, "null item id with quite some words in it here"), (1, "the same id again with ten words or more of it")]
    texts = [" ".join(rng.choice(vocab, 40)) for _ in range(15)]
    for i, t in items:
        if t:
            texts += [f"pre, {t.upper() if i == 0 else t}! post {t}", t[: len(t) // 2], f"{t} {t}"]
    texts += [None, "", "...", "w1 " * 5000, texts[-1]]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "__id", "w", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10_000, 0):
        rows = decontam.contamination(docs, bench, broadcast_windows=limit).collect()
        want = sorted(str((i if i != 3 else None, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0)) for i, (n, h, f) in enumerate(brute_contamination(t, items) for t in texts))
        assert sorted(str(tuple(r)) for r in rows) == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(brute_contamination(t, items)[1] == 0 for t in texts)


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "", "", 0)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(docs, bench).collect()] == [False]
    assert decontam.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_contamination_runs_no_python(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontam.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
