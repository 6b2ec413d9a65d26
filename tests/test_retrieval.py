"""Dense retrieval over cells and BM25 over bounded postings against brute force."""

import numpy as np
import pytest

from fieldwright.operators import dense, retrieve, sparse

ROWS = "i long, vector array<double>, c string"


def clustered(rng, n, d=24, groups=40, spread=0.08):
    centre = rng.normal(size=(groups, d))
    return centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


def brute(q, items, k, least=None):
    """{(query, item): score} by comparing all."""
    out = {}
    for qi, qv, qc in q:
        if qv is None or any(x is None or not np.isfinite(x) for x in qv):
            continue
        own = [(i, v) for i, v, c in items if c == qc and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        if not own:
            continue
        s = np.round(dense.unit(np.array([v for _, v in own])) @ dense.unit(np.array([qv]))[0], 10)
        ids = np.array([i for i, _ in own])
        for j in np.lexsort((ids, -s))[:k]:
            if least is None or s[j] >= least:
                out[qi, int(ids[j])] = float(s[j])
    return out


def test_cells_out_of_reach_are_skipped():
    rng = np.random.default_rng(2)
    x, q = clustered(rng, 6000), None
    q = dense.unit(clustered(np.random.default_rng(2), 6500)[6000:])
    centroids = dense.choose_centroids(dense.unit(x[:1500]), 77)
    block = dense.Block(np.arange(6000), x, (dense.unit(x) @ centroids.T).argmax(1), centroids)
    row, at, v, done = block.search(q, 10, None)
    score = np.round(q @ dense.unit(x).T, 10)
    for n in range(len(q)):
        want = np.lexsort((np.arange(6000), -score[n]))[:10]
        assert block.ids[at[row == n]].tolist() == want.tolist()
    assert done < 0.25 * score.size
    row, at, v, done = block.search(q, 300, 0.9)
    assert sorted(zip(row.tolist(), block.ids[at].tolist())) == sorted(zip(*(a.tolist() for a in np.nonzero(score >= 0.9)))) and done < 0.25 * score.size


def test_search_holds_little_beside_the_block():
    """What a search holds does not grow with its queries times cells, and copies of one vector are compared as often as they can be hits."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, q = clustered(rng, 20_000, 8, 200), dense.unit(clustered(np.random.default_rng(3), 30_000, 8, 200))
    x[::2] = x[0]
    centroids = dense.choose_centroids(dense.unit(x[:1500]), 141)
    cell = (dense.unit(x) @ centroids.T).argmax(1)
    ids = np.random.default_rng(5).permutation(20_000)
    block = dense.Block(ids, x, cell, centroids, 5)
    assert len(block.ids) == 10_005
    tracemalloc.start()
    row, at, v, _ = block.search(q, 5, None)
    assert tracemalloc.get_traced_memory()[1] < 90e6  # 30,000 x 141 numbers alone are 34 MB, of which five tables were held
    tracemalloc.stop()
    assert len(row) == 150_000
    for n in range(0, 30_000, 997):
        score = np.round(dense.unit(x) @ q[n], 12)
        want = np.lexsort((ids, -score))[:5]
        assert block.ids[at[row == n]].tolist() == ids[want].tolist() and np.allclose(v[row == n], score[want])


@pytest.mark.parametrize("least", [None, 0.7])
@pytest.mark.parametrize("blocks", [False, True])
def test_topk_equals_brute_force(spark, least, blocks):
    rng = np.random.default_rng(4)
    x = clustered(rng, 500, 6, 9)
    x[:150] = x[0]  # a third are one vector
    items = [(i, [float(c) for c in v], ["a", "b"][i % 5 == 0]) for i, v in enumerate(x)]
    items += [(900, None, "a"), (901, [0.0] * 6, "a"), (902, [float("nan")] * 6, "a"), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], "b"), (904, [1.0] * 6, None), (905, [2.0] * 6, "alone")]
    q = [(i, [float(c) for c in v], "abz"[i % 3]) for i, v in enumerate(clustered(np.random.default_rng(4), 60, 6, 9))] + [(100, None, "a"), (101, [0.0] * 6, "b"), (102, [1.0] * 6, None), (103, [float("inf")] * 6, "a"), (104, [1.0] * 6, "alone")]
    q = [(i + 1000, v, c) for i, v, c in q]
    args = dict(query_rows=7, block_numbers=150) if blocks else {}
    got = retrieve.topk_cosine(spark.createDataFrame(q, ROWS).withColumnRenamed("i", "q"), spark.createDataFrame(items, ROWS), 12, "q", "i", by="c", least=least, **args).collect()
    want = brute(q, items, 12, least)
    assert {(r.q, r.i): round(r.score, 6) for r in got} == {k: round(v, 6) for k, v in want.items()} and len(got) == len(want) > 100


def test_queries_skip_blocks_out_of_reach(spark):
    """Of clustered vectors a query goes to few of the blocks, and float vectors without classes work as well."""
    rng = np.random.default_rng(6)
    x = clustered(rng, 3000, 16, 30)
    items = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "i long, vector array<float>")
    q = items.where("i % 50 = 0").withColumnRenamed("i", "q")
    met = []
    plain = retrieve.topk_cosine(q, items, 8, "q", "i")
    real = dense.small

    def counted(df, *rows):
        if "parts" in df.columns:
            met.append(df.count())
        return real(df, *rows)

    try:
        dense.small = counted
        blocks = retrieve.topk_cosine(q, items, 8, "q", "i", block_numbers=16 * 100)
    finally:
        dense.small = real
    assert sorted(map(tuple, blocks.select("q", "i").collect())) == sorted(map(tuple, plain.select("q", "i").collect()))
    assert plain.count() == 60 * 8 and plain.where("q = i and abs(score - 1) < 1e-6").count() == 60 and sum(met) > 0


# --- BM25


def test_postings_of_a_token_that_all_share_are_mostly_unread():
    """Ranked postings against adding all up, and how many are read."""
    rng = np.random.default_rng(9)
    n, words = 20_000, [np.arange(20_000)] + [np.sort(rng.choice(20_000, size, replace=False)) for size in (40, 60, 90, 300, 2_000)]
    doc = np.concatenate(words)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    v = rng.random(len(doc)) * np.repeat([0.02, 9.0, 8.0, 7.0, 3.0, 0.5], [len(w) for w in words])
    held = sparse.Postings(doc, word, v)
    for asked in ([0, 1], [0, 1, 2, 3], [0, 4, 5], [0], [5, 0, 3, 77], [99], []):
        held.read = 0
        total = np.bincount(doc, v * np.isin(word, asked), n)
        hit, score = held.search(np.array(asked, np.int64), 10)
        order = np.lexsort((hit, -score))[:10]
        some = np.flatnonzero(total > 0)
        want = some[np.lexsort((some, -total[some]))[:10]]
        assert held.ids[hit[order]].tolist() == want.tolist() and np.allclose(score[order], total[want])
        if len(asked) > 1 and 0 in asked:
            assert held.read < 3_000
    assert not held.score.any()


def test_documents_that_tie_are_not_all_held():
    """Every document ties for every query: what is kept of a query are its k, not all of them."""
    held = sparse.Postings(np.arange(50_000), np.zeros(50_000, np.int64), np.full(50_000, 0.5))
    asked = [np.array([0, n], np.int64) for n in range(1, 400)]
    got = [held.best(a, 3) for a in asked]
    assert all(docs.tolist() == [0, 1, 2] and score.tolist() == [0.5] * 3 for docs, score in got)
    assert held.read == 50_000  # all ask the block for the same word


@pytest.mark.parametrize("blocks", [False, True])
def test_bm25_equals_plain_sums(spark, blocks):
    rng = np.random.default_rng(10)
    texts = [(i, " ".join(f"w{int(rng.zipf(1.5)) % 50}" for _ in range(rng.integers(0, 30))) + " all", ["a", "b"][i % 4 == 0]) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, "all all", None)]
    asked = [(i, f"all w{i % 7} w{i % 50} w{i % 7} nowhere", "abz"[i % 3]) for i in range(40)] + [(100, None, "a"), (101, "", "b")]
    args = dict(query_rows=7, block_postings=400) if blocks else {}
    got = retrieve.bm25(spark.createDataFrame(asked, "q long, text string, c string"), spark.createDataFrame(texts, "i long, text string, c string"), 6, "q", "i", by="c", **args).collect()
    want = {}
    for cls in "ab":
        own = {i: (t or "").split() for i, t, c in texts if c == cls}
        avg = sum(map(len, own.values())) / len(own)
        for q, t, c in asked:
            if c == cls and t:
                score = {}
                for w in set(t.split()):
                    having = [i for i, x in own.items() if w in x]
                    for i in having:
                        tf = own[i].count(w)
                        score[i] = score.get(i, 0) + np.log(1 + (len(own) - len(having) + 0.5) / (len(having) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own[i]) / avg))
                for r, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 9), i))[:6]):
                    want[q, i] = (r + 1, round(score[i], 6))
    assert {(r.q, r.i): (r["rank"], round(r.score, 6)) for r in got} == want and len(want) > 100
