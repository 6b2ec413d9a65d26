"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

The words of each item window are ordered by their number in the corpus, rarest first. Containment is exact, so the
necessary prefix is one word: a text that holds the window holds its rarest word. Only the texts' occurrences of
those prefix words are joined; length and position bound where the window would have to stand, and the words there are
compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A window takes some 200 bytes: up to so many are sent to every executor (40 MB); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: What the contract takes as a word, upper case included as A-Z are lower-cased afterwards.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def line_of(words: Column) -> Column:
    """Words as one comparable text: A-Z lower-cased; no word holds a space."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(line, n, words, items): every distinct window once, with the sorted ids of the items that hold it. A window is size
    consecutive words; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(size)))
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    w = w.select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("words"))
    w = w.select("item", "n", line_of(F.col("words")).alias("line"))
    return w.groupBy("line").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("item")).alias("items"))


def find_windows(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits: __id, __h (hash of the text), start (0-based word), n, line: one row per distinct place at
    which a window occurs in a text. Rows of docs that share id and text share their hits."""
    windows = cut(item_windows(items, item_id_col, item_text_col, size))
    small = windows.count() <= broadcast_windows
    send = F.broadcast if small else (lambda x: x)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), words_of(F.col(text_col)).alias("w")
    )
    # lower() also folds letters beyond A-Z: a superset that only serves to find candidates
    spots = windows.select("line", "n", F.posexplode(F.split("line", " ")).alias("off", "word")).withColumn("word", F.lower("word"))
    vocabulary = spots.select("word").distinct()
    seen = (
        texts.select(F.explode("w").alias("word")).select(F.lower("word").alias("word"))
        .join(send(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("rare"))
    )
    rarest = spots.join(seen, "word", "left").groupBy("line").agg(
        F.min(F.struct(F.coalesce("rare", F.lit(0)).alias("rare"), "word", "off")).alias("p"), F.first("n").alias("n")
    ).where("p.rare > 0").select("line", "n", F.col("p.word").alias("word"), F.col("p.off").alias("off"))
    start = (F.col("pos") - F.col("off")).alias("start")
    if small:
        words = texts.select("__id", "__h", "w", F.posexplode("w").alias("pos", "raw"))
        met = words.join(
            F.broadcast(rarest),
            (F.lower("raw") == F.col("word")) & (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("n") <= F.size("w")),
        ).where(line_of(F.slice("w", F.greatest(F.col("pos") - F.col("off"), F.lit(0)) + 1, F.col("n"))) == F.col("line"))
        hits = met.select("__id", "__h", start, "n", "line")
    else:
        slim = texts.select("__id", "__h", F.size("w").alias("size"), F.posexplode("w").alias("pos", "raw")).withColumn("word", F.lower("raw"))
        met = slim.join(rarest, "word").where("pos >= off and pos - off + n <= size").select("__id", "__h", start, "n", "line")
        full = texts.withColumnsRenamed({"__id": "__i", "__h": "__j"})
        hits = met.join(full, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__j"))).where(
            line_of(F.slice("w", F.col("start") + 1, F.col("n"))) == F.col("line")
        ).select("__id", "__h", "start", "n", "line")
    return cut(hits.distinct()), windows


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit. A null or empty text has no words and no hits, a text of any length is read
    whole. Items without text have no window; items without id hit words but are not counted. Rows of equal id and text get equal
    results; rows of one id with other texts, or without id, get their own. An empty table of documents gives an empty result, one of
    items no hits. Other columns of either table are not used.
    """
    hits, windows = find_windows(docs, items, id_col, text_col, item_id_col, item_text_col, size, broadcast_windows)
    per_doc = Window.partitionBy("__id", "__h").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(per_doc.rowsBetween(Window.unboundedPreceding, -1))
    places = hits.groupBy("__id", "__h", "start").agg(F.max("n").alias("n")).withColumn("__from", F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = places.groupBy("__id", "__h").agg(F.sum(F.greatest(F.col("start") + F.col("n") - F.col("__from"), F.lit(0))).alias("n_hit"))
    send = F.broadcast if windows.count() <= broadcast_windows else (lambda x: x)
    found = (
        hits.select("__id", "__h", "line").distinct().join(send(windows.select("line", "items")), "line")
        .select("__id", "__h", F.explode("items").alias("item")).distinct()
        .groupBy("__id", "__h").agg(F.sort_array(F.collect_list("item")).alias("found"))
    )
    one = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"),
    )
    out = one
    for t in (covered, found):
        t = t.withColumnsRenamed({"__id": "__i", "__h": "__j"})
        out = out.join(t, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__j")), "left").drop("__i", "__j")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    found_items = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(found_items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs in which no window of an item occurs, as they are: repeated rows, rows without id and columns of any name too.
    Null and empty texts and those without words stay; texts are read whole. Without items all rows stay, an empty table stays empty."""
    hits, _ = find_windows(docs, items, id_col, text_col, size=size)
    bad = hits.select("__id", "__h").distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(id_col).alias("__i"), F.xxhash64(text_col).alias("__j"))
    return marked.join(bad, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__j") == F.col("__h")), "left_anti").select("r.*")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS pos FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos + 1, pos + n), ' ') AS line FROM s),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT rid, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS pos FROM d, lens),
h AS (SELECT p.rid, p.pos, p.n, win.item_id FROM (SELECT rid, pos, n, array_to_string(list_slice(w, pos + 1, pos + n), ' ') AS line FROM p) p JOIN win ON p.line = win.line AND p.n = win.n),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.found, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN f USING (rid)
"""
