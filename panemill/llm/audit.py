"""How filters interact: what each one removes after which others, by the potential of the removal game."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panemill.llm.common import table

#: A separator of words: a space or one of the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: So many groups do rows without a doc_id go to, which all have the same key otherwise.
SALTS = 1024
#: Filters of one audit: 2^n coalitions and n! orders are worked out for each part.
MOST = 7


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of the production filters that judge a text by itself, by their letters."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: Column) -> DataFrame:
    """(part, mask, good, toxic, n): rows by the filters that they fail, bit i for the i-th one; the last is repetition.

    ``filters`` may use the column ``text``, which is never null. A row fails the last filter, which is none of these, if
    a row with a smaller doc_id has the same text.
    """
    bits = F.lit(0)
    for i, fails in enumerate(filters.values()):
        bits = bits + F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("bits"))
    # rows without an id have no labels: their salt spreads them
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").na.fill(False, ["good", "toxic"])
    # equal rows first, then texts by part: a text with any number of copies is one row for each part and label
    kind = ["digest", "part", "bits", "good", "toxic"]
    ids = joined.groupBy("doc_id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    # a text has no more rows here than there are parts and labels
    placed = copies.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    new = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    last = 1 << len(filters)
    split = placed.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("mask"), new.alias("n")), F.struct((F.col("bits") + last).alias("mask"), (F.col("n") - new).alias("n")))).alias("c"))
    return split.where("c.n > 0").groupBy("part", "c.mask", "good", "toxic").agg(F.sum("c.n").alias("n"))


def removal_games(masks: DataFrame, n_filters: int) -> DataFrame:
    """(part, total, removed, good, toxic) of (part, mask, good, toxic, n): at place S of each array, how many documents
    (all, good or toxic ones) the filters of coalition S remove together."""
    games = {"removed": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = [F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, n).otherwise(0)) for s in range(1 << n_filters)]).alias(name) for name, n in games.items()]
    return masks.groupBy("part").agg(F.sum("n").alias("total"), *sums)


def potentials(game: Column, n_filters: int) -> Column:
    """The potential of a game and of all its subgames, times lcm(1, ..., n): an array with a place for each coalition.

    P(S) is the value of S and the potentials of S without each of its members, over the number of members. Coalitions
    come in the order of their numbers, so that those without a member come first; the multiple makes all quotients whole.
    """
    scale = lcm(*range(1, n_filters + 1))

    def with_next(found: Column, s: Column) -> Column:
        member = [s.bitwiseAND(1 << i) != 0 for i in range(n_filters)]
        below = [F.when(m, F.get(found, s - (1 << i))).otherwise(0) for i, m in enumerate(member)]
        members = reduce(Column.__add__, [m.cast("long") for m in member])
        return F.concat(found, F.array(F.call_function("div", F.get(game, s) * scale + reduce(Column.__add__, below), members)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), with_next)


def interactions(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], repeated: str, part: Column) -> DataFrame:
    """What each filter removes in each order of all filters: one row for each part, order and step.

    ``docs``: doc_id, text; ``labels``: doc_id, quality, toxic; ``filters``: failure conditions over the column ``text``
    by their letters; ``repeated``: the letter of the filter that removes texts which a smaller doc_id has, in the whole
    table; ``part``: a Column of ``docs`` that parts the result. Columns: part, filter_order (letters, from the first on),
    step (from 1; its filter is that letter), kept, removed, redundant (fails this filter, but was removed before),
    unique_fails (fails this filter alone), good_lost, toxic_lost (of the removed ones), shapley (removed by this
    filter, summed over all orders, at any step).

    Nulls: null text is empty, a condition that is null does not fail, a null doc_id is no smaller than any and has no
    labels. Repeated rows count each, and none is smaller than another with its doc_id; of several labels of one doc_id one
    is enough. Extra columns are not looked at; texts are judged whole, whatever their length; an empty table gives no rows.

    Documents shrink to the filters that they fail and a digest of their text. Labels meet them by doc_id; copies are
    counted by text, part and label before they meet their first one, so that a text that a third of all rows have is a few
    rows. Each part then is one count for each set of failed filters: removals of all coalitions are sums of these, the
    Shapley value is the potential of the removal game less the potential without the filter, and an order's steps are
    differences of coalitions. No order is ever run over documents.
    """
    letters = "".join([*filters, repeated])
    n = len(letters)
    if n != len(set(letters)) or n != len(filters) + 1 or n > MOST:
        raise ValueError(f"filters have different single letters, and are {MOST} at most")
    whole = (1 << n) - 1
    games = removal_games(marked(docs, labels, filters, part), n)
    rated = games.withColumn("potential", potentials(F.col("removed"), n))
    share = factorial(n) // lcm(*range(1, n + 1))
    shapley = F.array(*[(F.get("potential", F.lit(whole)) - F.get("potential", F.lit(whole - (1 << i)))) * share for i in range(n)])
    rated = rated.withColumn("shapley", shapley)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    steps = rated.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = F.instr(F.lit(letters), F.expr("substring(filter_order, step, 1)")) - 1
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    before = reduce(Column.__add__, [F.when(F.instr(earlier, letter) > 0, 1 << i).otherwise(0) for i, letter in enumerate(letters)])
    steps = steps.select("*", bit.alias("bit"), before.alias("before")).withColumn("own", F.call_function("shiftleft", F.lit(1), F.col("bit")))
    after = F.col("before") + F.col("own")

    def gain(game: str) -> Column:
        return F.get(game, after) - F.get(game, F.col("before"))

    removed = gain("removed")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("removed", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("removed", F.col("own")) - removed).alias("redundant"),
        (F.get("removed", F.lit(whole)) - F.get("removed", F.lit(whole) - F.col("own"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("bit")).alias("shapley"),
    )


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), F.coalesce(F.col("source").cast("string"), F.lit(""))
    return interactions(docs, table(spark, sf_dir, "labels"), text_filters(F.col("text")), "E", part)


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
f AS (
  SELECT w.doc_id, part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(p, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, x.i AS step, p[x.i] AS own, p[1:x.i - 1] AS earlier
  FROM o, x),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail,
    len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS alone
  FROM g, s),
t AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed,
    sum(n) FILTER (fail AND gone) AS redundant, sum(n) FILTER (fail AND alone) AS unique_fails,
    sum(n) FILTER (fail AND NOT gone AND good) AS good_lost, sum(n) FILTER (fail AND NOT gone AND toxic) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + """,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM t"""
