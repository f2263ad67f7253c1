"""Benchmark decontamination: short test items found inside long documents, by DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import BROADCAST_ROWS, WORD, ascii_lower, broadcast_if_small, table, written

WORDS = 5
#: An item is found in a document that holds 100 * shared >= CONTAINED * its shingles.
CONTAINED = 80
#: Retained values of an item: all of up to 16, else 16 or an eighth of its size class.
SKETCH, SHARE = 16, 8
#: Of an item's retained values a quarter must stand in a document: of 16, fewer than 4 do with a chance of 1e-7.
HITS = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _once(value: Column) -> Column:
    """The value as the only row of a generator: the optimizer then can't copy its expression into filters and lambdas,
    where it would be worked out again for each word."""
    return F.explode(F.array(value))


def _shingles(words: str, shingle: Callable[[int], str], short: Sequence[int]) -> Column:
    """The different shingles of WORDS words, or the whole sequence of fewer, and those of each length in ``short``."""
    every = [f"transform(sequence(1, greatest(size({words}) - {WORDS - 1}, 1)), i -> {shingle(WORDS)})"]
    every += [f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> {shingle(n)}) ELSE array() END" for n in short]
    return F.expr(f"CASE WHEN size({words}) > 0 THEN array_distinct(concat({', '.join(every)})) ELSE array() END")


def hashed_shingles(df: DataFrame, *keep: str, short: Sequence[int] = ()) -> DataFrame:
    """``keep``, the number of words and hashes: the different shingles of ``text``, each as a 64-bit hash of its words'
    hashes. ``short``: lengths below five words whose shingles are added."""
    hashed = df.select(*keep, _once(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))

    def places(n: int) -> str:
        return "xxhash64(" + ", ".join(f"get(h, i + {j - 1})" for j in range(n)) + ")"

    return hashed.select(*keep, F.size("h").alias("words"), _once(_shingles("h", places, short)).alias("hashes"))


def spelled_shingles(df: DataFrame, *keep: str, short: Sequence[int] = ()) -> DataFrame:
    """``keep`` and shingles: the different shingles of ``text`` as text."""
    split = df.select(*keep, _once(words_of(F.col("text"))).alias("w"))
    return split.select(*keep, _once(_shingles("w", lambda n: f"array_join(slice(w, i, {n}), ' ')", short)).alias("shingles"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which ``items`` (item_id, text) stand in which ``docs`` (doc_id, text).

    Columns: doc_id, item_id, n_item_shingles, n_shared, containment. An item is found where a document holds at
    least 80 % of its different 5-word shingles; A-Z count as a-z. An item of fewer words has one shingle, its whole
    sequence, and is found wherever these words stand one after the other: documents are also shingled at the lengths
    below five that items have. Null and empty texts hold nothing and are found nowhere. Rows of one doc_id are one document, rows of one item_id one item with the most of what is found; null ids
    are left out, as are extra columns. Empty tables give an empty result.

    Items are parted by size: each size class has its own number of retained values, the least hashes of an item's
    set, and its own number of them that a document must hold. A document's shingles meet the retained values in one
    pass over the text; only pairs with enough of them are looked at again, and only their documents' texts are spelled
    out. The retained values are broadcast after a count of their rows, and so are the pairs and, by the number of
    their shingles, the items; beyond the bound these joins shuffle. Very long texts are read whole. A passage that many documents share costs one row for each of them.
    """
    items = items.where("item_id is not null").select("item_id", "text")
    sized = written(hashed_shingles(items, "item_id").withColumn("n", F.size("hashes")).where("n > 0"), "items")
    short = sorted(r.words for r in sized.where(F.col("words") < WORDS).select("words").distinct().collect())  # four at most
    # the size class is the power of two at or above the size
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    kept = F.least(F.col("n"), F.greatest(F.lit(SKETCH), F.floor(upper / SHARE).cast("int")))
    need = F.when(F.col("n") <= SKETCH, F.ceil(F.col("n") * (CONTAINED / 100))).otherwise(F.floor(kept * HITS / SKETCH)).cast("int")
    retained = written(sized.select("item_id", kept.alias("k"), need.alias("need"), "hashes").select("item_id", "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("k"))).alias("h")), "retained")
    named = docs.where("doc_id is not null").select("doc_id", "text")
    seen = hashed_shingles(named, "doc_id", short=short).select("doc_id", F.explode("hashes").alias("h"))
    retained_rows = retained.count()  # no fewer than the items
    hits = seen.join(_small(retained, retained_rows), "h").groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("hits"))
    pairs = written(hits.where("hits >= need").select("doc_id", "item_id"), "pairs")
    found = spelled_shingles(named.join(_small(pairs, pairs.count()), "doc_id"), "doc_id", "item_id", short=short)
    listed = spelled_shingles(items, "item_id").select("item_id", F.col("shingles").alias("wanted"))
    both = found.join(_small(listed, retained_rows * SHARE), "item_id")  # no more shingles than that
    counted = both.select("doc_id", "item_id", F.size("wanted").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("wanted", "shingles")).cast("long").alias("n_shared"))
    held = counted.where(f"100 * n_shared >= {CONTAINED} * n_item_shingles")
    best = held.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item_shingles", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item_shingles", "m.n_shared", "m.containment")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows without an id stay."""
    bad = written(contained_items(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad), "doc_id", "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM t),
s AS (
  SELECT kind, id, list_distinct(CASE WHEN len(words) = 0 THEN [] ELSE list_transform(range(1, 1 + greatest(len(words) - 4, 1)), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w),
d AS (SELECT id AS doc_id, unnest(shingles) AS shingle FROM s WHERE kind = 'd'),
b AS (SELECT id AS item_id, CAST(len(shingles) AS BIGINT) AS n, unnest(shingles) AS shingle FROM s JOIN w USING (kind, id) WHERE kind = 'b' AND len(w.words) >= 5)
SELECT x.id AS doc_id, y.id AS item_id, 1::BIGINT AS n_item_shingles, 1::BIGINT AS n_shared, 1.0::DOUBLE AS containment
FROM w x JOIN w y ON x.kind = 'd' AND y.kind = 'b' AND len(y.words) BETWEEN 1 AND 4
  AND contains(' ' || array_to_string(x.words, ' ') || ' ', ' ' || array_to_string(y.words, ' ') || ' ')
UNION ALL
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM b JOIN d USING (shingle) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""
