"""Near-duplicate groups by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import Scratch, broadcast_if_small, give_back, slices, table, utf8
from panemill.llm.components import components
from panemill.llm.shingles import shingle_sets

#: Links join sets with 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Values of a sketch, and of the finer sketch of a document that the first lists leave open, which holds most sets whole.
SKETCH, FINE = 64, 4096
#: Neighbouring retained values that make the key of an inverted list.
RUN = 3
#: Of the keys of two linked sketches so many agree at least (fewer: a chance of 3e-7 at a similarity of 0.8).
HITS = 5
#: The size of a sketch that holds any set whole.
WHOLE = 1 << 30
#: Bytes of text whose shingles are hashed at once.
PORTION = 1 << 19


def agreeing(size: int) -> int:
    """How many values of the union's sketch of ``size`` two linked sets share at least.

    Each is shared with a chance of 0.8. Six standard deviations below the mean: 32 of 64 values, 3,123 of 4,096.
    """
    share = SIMILAR / 100
    return int(size * share - 6 * (size * share * (1 - share)) ** 0.5)


def sketches(docs: DataFrame, *, words: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, text_hash, n, id, sketch): the shingle set's size, a 128-bit hash of the whole set and its least values."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, PORTION):
                sets = shingle_sets(*utf8(some.column(2)), words)
                ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                kept = [s[:size] for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), ids, values], names=["doc_id", "text_hash", "n", "id", "sketch"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, n long, id binary, sketch array<long>")


def run_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n): a hash of each three neighbouring values of a sketch, in the order of the values.

    Where the union of two sets has three neighbours that both share, both sketches have them side by side. Sets that a
    sketch holds as a whole share such a run for certain if they are linked and their union has six values or more;
    smaller ones also have keys of two neighbours.
    """

    def runs(length: int) -> str:
        values = ", ".join(f"sketch[i + {j}]" for j in range(length))
        return f"transform(sequence(0, size(sketch) - {length}), i -> xxhash64({length}, {values}))"

    keys = F.expr(f"explode(CASE WHEN n <= 6 THEN concat({runs(RUN)}, {runs(2)}) ELSE {runs(RUN)} END)")
    return classes.where(f"n > {RUN}").select(keys.alias("key"), "id", "n")


def keys_needed(n: Column) -> Column:
    """How many keys a set of ``n`` shingles has in common with any that it is linked to, at least.

    If sketches hold both as a whole: the union has n values or more, of which d, a fifth at most, aren't shared; these
    cut the others into d + 1 runs, and a run of r values has r - 2 keys.
    """
    return F.when(n * 100 <= SKETCH * SIMILAR, F.greatest(F.ceil(n * (3 * SIMILAR - 200) / 100) - 2, F.lit(1))).otherwise(HITS)


def blocks(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(center, n_center, id, n): each member of a list of several (key, id, n) beside the list's center, once.

    A class that has too few keys in such lists to be linked at all is left out first. The center is the member with
    the most keys: it is nearest to what the others are copies of, and the same in most lists of a group, so that
    members that share lists share few centers. Keys are counted before the shuffle.
    """
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    held = scratch.written(keys.join(broadcast_if_small(scratch.written(several, "several")), "key", "left_semi"), "held")
    enough = held.groupBy("id").agg(F.count(F.lit(1)).alias("keys"), F.first("n").alias("n")).where(F.col("keys") >= keys_needed(F.col("n"))).select("id", "keys")
    lists = scratch.written(held.join(enough, "id"), "lists")
    centers = lists.groupBy("key").agg(F.max(F.struct("keys", "id", "n")).alias("c")).select("key", F.col("c.id").alias("center"), F.col("c.n").alias("n_center"))
    found = scratch.written(lists.join(centers, "key").select("center", "n_center", "id", "n").distinct(), "blocks")
    scratch.drop("several", "held", "lists")
    return found


def _sizes_fit(n: str, other: str) -> Column:
    return F.expr(f"100 * {n} >= {SIMILAR} * {other} AND 100 * {other} >= {SIMILAR} * {n}")


def _sketches_fit(size: int, n: str, values: str, other_n: str, other_values: str) -> Column:
    """Whether the union's sketch shares enough values; of sets that sketches hold as a whole this is the similarity."""
    both = f"array_intersect({values}, {other_values})"
    whole = f"100 * size({both}) >= {SIMILAR} * ({n} + {other_n} - size({both}))"
    union = f"slice(array_sort(array_union({values}, {other_values})), 1, {size})"
    return F.expr(f"CASE WHEN {n} <= {size} AND {other_n} <= {size} THEN {whole} ELSE size(array_intersect({union}, {both})) >= {agreeing(size)} END")


def star_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b): each member of a block with its center, for thousands of near copies join through a few."""
    return blocks.where((F.col("id") != F.col("center")) & _sizes_fit("n", "n_center")).select(F.col("center").alias("a"), F.col("id").alias("b"))


def likely(pairs: DataFrame, sketched: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sketches of ``size`` (id, n, sketch) fit."""
    side = [sketched.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").where(_sketches_fit(size, "n_a", "s_a", "n_b", "s_b")).select("a", "b")


def _first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, doc_id, text): one document's text for each class (id, doc_id, text_hash)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return named.join(broadcast_if_small(rows), ["doc_id", "text_hash"]).select("id", "doc_id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough, from two texts of these classes."""
    pairs = scratch.written(pairs, f"{name}_pairs")
    wanted = scratch.written(classes.select("id", "doc_id", "text_hash").join(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_semi"), f"{name}_wanted")
    texts = _first_rows(docs, wanted).groupBy("id").agg(F.first("text").alias("text"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (part for half in slices(batch, 2, PORTION) for part in slices(half, 3, PORTION)):
                keep = []
                for x, y in zip(shingle_sets(*utf8(some.column(2)), words), shingle_sets(*utf8(some.column(3)), words), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    found = scratch.written(both.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"), f"{name}_links")
    scratch.drop(f"{name}_pairs", f"{name}_wanted")
    return found


def open_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(center, id, c) of the blocks whose members lie in several components c so far."""
    placed = blocks.join(known.withColumnRenamed("node", "id"), "id", "left").select("center", "id", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("center").agg((F.min("c") != F.max("c")).alias("open")).where("open").select("center")
    return placed.join(several, "center", "left_semi")


def shared_by(x: str, y: str, size: int) -> str:
    """How many values two linked sets of ``x`` and ``y`` shingles share in sketches of ``size``, at least: exactly, if
    the sketches hold both as a whole."""
    return f"CASE WHEN {x} <= {size} AND {y} <= {size} THEN ({SIMILAR} * ({x} + {y}) + {99 + SIMILAR}) div {100 + SIMILAR} ELSE {agreeing(size)} END"


def rarest_entries(fine: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(value, id, c, n, len, pos): the rarest values of each sketch (id, c, n, sketch), as many as links have to show in.

    Values are put in one order, by how many sketches hold them. Two sets that share at least so many values share one
    among the first values of each: of len values, the last that can be the first common one has the place len less that
    number. A value that no other sketch holds comes before all others, and only takes up a place: where these fill
    the first places, as in pages that share a template but not the rest, a set has no entries and meets no other.
    """
    values = fine.select("id", F.explode("sketch").alias("value"))
    several = broadcast_if_small(scratch.written(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared"))
    # a partner is no smaller than four fifths
    least = f"CASE WHEN n <= {size} THEN ({SIMILAR} * n + 99) div 100 ELSE {agreeing(size)} END"
    needed = fine.select("id", "c", "n", F.size("sketch").alias("len"), F.expr(least).alias("need"))
    # most sets share too little with all others: they are counted out before any values are put in order
    counts = values.join(several, "value").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    able = scratch.written(needed.join(counts, "id").where("times >= need").drop("times"), "able")
    few = broadcast_if_small(able.select("id"))
    held = values.join(few, "id", "left_semi").join(several, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    rows = able.join(held, "id")
    first = F.expr("slice(shared, 1, greatest(0, CAST(size(shared) - need + 1 AS INT)))")
    placed = rows.select("id", "c", "n", "len", (F.col("len") - F.size("shared")).alias("own"), F.posexplode(first).alias("at", "v"))
    return placed.select("v.value", "id", "c", "n", "len", (F.col("own") + F.col("at")).alias("pos"))


def prefix_pairs(fine: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(a, b) of different components c whose rarest values show that they may be linked; see ``rarest_entries``.

    For two sets of known sizes the places are narrower than for one alone: each common value is held against both. Lists
    of a value whose members are all of one component are left out first.
    """
    entries = scratch.written(rarest_entries(fine, size, scratch), "entries")
    several = entries.groupBy("value").agg((F.min("c") != F.max("c")).alias("open")).where("open").select("value")
    lists = scratch.written(entries.join(broadcast_if_small(several), "value", "left_semi"), "prefixes")
    need = shared_by("x.n", "y.n", size)
    met = f"x.value = y.value AND x.c <> y.c AND (x.n < y.n OR (x.n = y.n AND x.id < y.id)) AND 100 * x.n >= {SIMILAR} * y.n AND x.pos <= x.len - ({need}) AND y.pos <= y.len - ({need})"
    pairs = lists.alias("x").join(lists.alias("y"), F.expr(met))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def grouped_rows(docs: DataFrame, *, words: int, exact: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its group: doc_id, text_hash, n_shingles, component, component_id, n_links.

    text_hash is Spark's xxhash64 of the text; component names the group by a hash (null without words or doc_id).
    See near_duplicates.
    """
    scratch = Scratch(docs.sparkSession)
    each = scratch.written(sketches(docs, words=words), "sketches")
    named = each.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.written(classes.select("id", "row.*", "n", "sketch"), "classes")
    ids = classes.select("id")
    if exact:
        # no lists of runs and no centers: all classes are open
        links, known = ids.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), ids.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
        left = classes.select("id", "doc_id", "text_hash", F.col("id").alias("c"))
    else:
        near = blocks(run_keys(classes), scratch)
        links = confirmed(likely(star_pairs(near), classes, SKETCH), docs, classes, words, scratch, "star")
        known = components(links)
        placed = open_blocks(near, known).select("id", "c").distinct()
        left = scratch.written(classes.select("id", "doc_id", "text_hash").join(placed, "id"), "left")
        scratch.drop("blocks")
    size = WHOLE if exact else FINE
    texts = _first_rows(docs, left.drop("c")).dropDuplicates(["id"])
    fine = scratch.written(sketches(texts, words=words, size=size).select("id", "n", "sketch").join(left.select("id", "c"), "id"), "fine")
    pairs = likely(prefix_pairs(fine, size, scratch), fine, size)
    more = confirmed(pairs, docs, classes, words, scratch, "other")
    scratch.drop("left", "fine", "shared", "able", "entries", "prefixes")
    placed = classes.select("id", "doc_id").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    if not more.isEmpty():
        # the links that were found last join components
        ends = [known.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
        joins = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        placed = placed.join(components(joins).select(F.col("node").alias("c"), F.col("component").alias("root")), "c", "left").withColumn("c", F.coalesce("root", "c"))
    counts = links.union(more).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    placed = placed.join(counts, "id", "left").select("id", "doc_id", F.col("c").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = scratch.written(placed.drop("doc_id").join(first, "component"), "labels")
    scratch.drop("classes", "star_links", "other_links")
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id"))
    joined = each.select("doc_id", "text_hash", "n", key.alias("id")).join(labels, "id", "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, *, words: int, exact: bool = False) -> DataFrame:
    """Group ``docs`` (doc_id, text) by links; columns doc_id, n_shingles, component_id, kept, n_links.

    Two documents are linked if their sets of ``words``-word shingles have 100 * intersection >= 80 * union; A-Z
    count as a-z. component_id is the smallest doc_id that links lead to, the document's own included; kept tells
    whether it is the document itself. n_links counts the links that were confirmed for the document's class.
    Documents without words (null or empty text among them) have n_shingles 0 and no links. Each row is judged by its own
    text, also where rows share a doc_id; equal rows get equal results. A null doc_id is never linked: its component_id
    is null and it is kept. Very long texts are read whole. Extra columns are left out; an empty table gives an empty result.

    Documents with one set form a class, found by a hash of the whole set; only a class goes on. Inverted lists of
    neighbouring retained values bring classes together; a class that has too few keys in common with any others leaves
    them. Each member of a list is first paired with its center, so that thousands of near copies meet in one component.
    Members that share a center but lie in different components then get finer sketches, and meet where a value is among
    the rarest of both: pages that share a template and differ in the rest do not meet at all. Sketches filter the
    pairs and the texts confirm them. No step gathers a list, a group or a component in one place.

    Sketches of 64 values miss a link with a chance of 3e-7, those of 4,096 with one of 1e-9, and only where they don't hold
    the sets whole. ``exact`` leaves these out: every class has its whole set as its sketch, and every two linked sets
    share one of their rarest values for certain. It costs an entry for each shingle of each class.
    """
    rows = grouped_rows(docs, words=words, exact=exact)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_links")


def without_near_duplicates(docs: DataFrame, *, words: int) -> DataFrame:
    """One row of each group: that with the least doc_id (of several, the least hash of its text), once.

    All columns stay as they are. Rows without words or doc_id are in no group and stay. Rows are told apart by doc_id
    and text, so that a row stays if another one with its doc_id goes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(grouped_rows(docs, words=words).where("component IS NOT NULL").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")), "groups")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("component", "best")
    gone = scratch.written(rows.join(best, "component").where("struct(doc_id, text_hash) <> best").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")), "gone")
    again = scratch.written(rows.where("times > 1").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")), "again")
    scratch.drop("groups")
    # the row goes into a struct, so that no column of its own can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id").cast("long") == F.col("g_id")) & (F.xxhash64("row.text") == F.col("g_hash"))
    kept = held.join(broadcast_if_small(gone), same, "left_anti")
    whole = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if again.isEmpty():
        return kept.select(*whole)
    once = kept.join(broadcast_if_small(again), same, "left_semi").select("row", F.col("row.doc_id").alias("g_id"), F.xxhash64("row.text").alias("g_hash")).dropDuplicates(["g_id", "g_hash"]).select("row")
    return kept.join(broadcast_if_small(again), same, "left_anti").union(once).select(*whole)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("n_links")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles
  FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""
