"""Sparse retrieval by BM25: ranked postings with bounds.

Documents are dealt into blocks, and a task searches one block for a part of the queries. A query's tokens are taken by the
largest contribution that they make in the block, strongest first. Once the k-th score is above all that the tokens left can
add up to, no further document can enter: the rest of the postings, those of the frequent tokens, are then only looked up
for the documents still in the running.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .joins import join_one, small

#: Queries that one task searches a block for; postings of a block.
QUERY_ROWS, BLOCK_POSTINGS = 4096, 1 << 21
#: Scores are compared to so many digits.
DIGITS, SLACK = 9, 1e-8


def tokens(text: F.Column | str) -> F.Column:
    """Lower-cased Latin words and numbers, and the character bigrams of CJK runs (a single character stands alone)."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit("[a-z0-9à-öø-ÿœß]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(words, grams)


class Postings:
    """Postings (document, word, contribution) of a block: by word, documents ascending, with each word's largest contribution."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, v: np.ndarray):
        self.ids, doc = np.unique(ids, return_inverse=True)
        order = np.lexsort((doc, words))
        self.doc, self.v = doc[order], v[order]
        self.words, self.start = np.unique(words[order], return_index=True)
        self.end = np.append(self.start[1:], len(doc))
        self.most = np.maximum.reduceat(self.v, self.start) if len(doc) else self.v
        self.score = np.zeros(len(self.ids))
        self.read = 0
        self.told: dict = {}

    def search(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): those that may be among the k best, all of these and those that tie with the last included."""
        at = np.searchsorted(self.words, asked)
        at = at[at < len(self.words)][self.words[at[at < len(self.words)]] == asked[at < len(self.words)]]
        at = at[np.argsort(-self.most[at], kind="stable")]
        left = np.append(np.cumsum(self.most[at][::-1])[::-1], 0.0)  # what the words from here on can add
        docs, kth, n = np.zeros(0, np.int64), -np.inf, 0
        for n, w in enumerate(at):
            if kth > left[n] + SLACK:
                break
            own = slice(self.start[w], self.end[w])
            new = self.doc[own][self.score[self.doc[own]] == 0]
            self.score[self.doc[own]] += self.v[own]
            self.read += len(self.doc[own])
            docs = np.concatenate([docs, new])
            if len(docs) >= k:
                kth = np.partition(self.score[docs], -k)[-k]
        else:
            n = len(at)
        held = docs
        for j in range(n, len(at)):
            docs = docs[self.score[docs] + left[j] >= kth - SLACK]
            w, own = at[j], slice(self.start[at[j]], self.end[at[j]])
            place = self.start[w] + np.searchsorted(self.doc[own], docs)
            there = place < self.end[w]
            there[there] = self.doc[place[there]] == docs[there]
            self.score[docs[there]] += self.v[place[there]]
            self.read += len(docs)
            kth = np.partition(self.score[docs], -k)[-k]
        docs = docs[self.score[docs] >= kth - SLACK] if np.isfinite(kth) else docs
        score = self.score[docs]
        self.score[held] = 0
        return docs, score

    def best(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best, by document where scores tie to DIGITS. Very many documents may tie, so nothing else is kept; queries that
        ask the block for the same words are searched once."""
        key = asked[np.isin(asked, self.words)].tobytes()
        if key not in self.told:
            docs, score = self.search(asked, k)
            rank = np.lexsort((docs, -np.round(score, DIGITS)))[:k]
            self.told[key] = docs[rank], score[rank]
        return self.told[key]


def bm25(
    queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, query_text: str = "text", doc_text: str = "text", by: str | None = None, k1: float = 1.2, b: float = 0.75,
    query_rows: int = QUERY_ROWS, block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query by BM25 (ties to 9 digits: smaller id), within the class by if given.
    Each distinct query token counts once; idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over the class. Texts are tokenised once; only postings of
    tokens that some query has are kept. A token that very many documents have is dealt over several tasks, and its postings are mostly unread
    (see the module). Tokens go as 64-bit hashes of token and class. Null texts have no tokens."""
    cls = lambda: (F.col(by) if by else F.lit(0)).alias("c")
    word = lambda t: F.transform(t, lambda x: F.xxhash64(x, F.col(by) if by else F.lit(0)))
    d = kept(docs.select(F.col(doc_id).alias("i"), cls(), word(tokens(doc_text)).alias("t")).withColumn("len", F.size("t")))
    q = kept(queries.select(F.col(query_id).alias("q"), cls(), word(F.array_distinct(tokens(query_text))).alias("t")))
    stats = d.groupBy("c").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg"))
    asked = kept(q.select(F.explode("t").alias("w")).distinct())
    sent = small(asked)
    terms = d.select("i", "c", "len", F.explode("t").alias("w"))
    if sent:
        terms = terms.join(F.broadcast(asked), "w")
    else:
        counts = terms.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        terms = join_one(terms, asked, "w", counts, d.agg(F.sum("len")).first()[0] or 0, "i")
    postings = kept(terms.groupBy("w", "c", "i", "len").agg(F.count(F.lit(1)).alias("tf")))
    n_postings = postings.count()
    df = postings.groupBy("w", "c").agg(F.count(F.lit(1)).alias("df"))
    df = kept(df.join(stats, "c").select("w", F.col("df").alias("n"), F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg"))
    of_word = df.select("w", "idf", "avg")
    weighted = postings.join(F.broadcast(of_word), "w") if sent else join_one(postings, of_word, "w", df.select("w", "n"), n_postings, "i")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    weighted = weighted.select("c", "i", "w", weight.alias("v"))
    schema = f"q {dict(q.dtypes)['q']}, i {dict(d.dtypes)['i']}, score double"

    def add_up(qs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(block):
            return pd.DataFrame({"q": qs["q"][:0], "i": block["i"][:0], "score": np.zeros(0)})
        held = Postings(block["i"].to_numpy(), block["w"].to_numpy(), block["v"].to_numpy())
        got = [held.best(np.asarray(t, np.int64), k) for t in qs["t"]]
        row = np.repeat(np.arange(len(got)), [len(hit) for hit, _ in got])
        col, val = np.concatenate([hit for hit, _ in got]), np.concatenate([score for _, score in got])
        return pd.DataFrame({"q": qs["q"].to_numpy()[row], "i": held.ids[col], "score": val})

    parts, blocks = max(1, -(-q.count() // query_rows)), max(1, -(-n_postings // block_postings))
    left = q.withColumn("part", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(parts)).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = weighted.withColumn("blk", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["c", "blk", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(add_up, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", DIGITS).desc(), "i"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("i").alias(doc_id), "score", "rank")
