"""Ranked lexical search: a block-compressed index of whole texts, searched by Block-Max MaxScore shard by shard."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panemill.llm.common import BROADCAST_ROWS, ascii_lower, give_back, table, written

#: A term of lower-cased UTF-8, and the same in SQL and Java: ASCII letters and digits and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text of a shard, postings of a block, and bytes of text whose terms are held at once.
SHARD, BLOCK, PIECE = 16 << 20, 64, 1 << 20
#: Results of an item, and items that a shard answers in one group.
TOP, ITEMS = 10, 256
#: The term of the row that holds a shard's documents; no text has it.
DOCS = ""
INDEX = "shard long, term string, block int, first int, last int, n int, total long, impacts binary, payload binary"


# The index


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term stands in a lower-cased text; terms are cut out piece by piece, so that only counts are held."""
    found: Counter[bytes] = Counter()
    first = 0
    while first < len(text):
        end = first + PIECE
        if end < len(text):  # no term is cut: go on to where the one at the border ends
            inside = TERM.match(text, end)
            end = inside.end() if inside else end
        found.update(TERM.findall(text, first, end))
        first = end
    return found


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, the lowest first, and how many bytes each one takes."""
    sizes = 1 + sum((values >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(5):
        some = sizes > j
        low = (values[some] >> (7 * j)) & 127
        out[(ends - sizes)[some] + j] = low | np.where(sizes[some] > j + 1, 128, 0)
    return out, sizes


def numbers(payload: np.ndarray) -> np.ndarray:
    """The numbers of ``varints``."""
    if not len(payload):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(payload < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(payload)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((payload & 127).astype(np.int64) << (7 * place), starts)


@dataclass
class Shard:
    """Documents whose postings are gathered: document, frequency, document, ... for each term."""

    ids: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    postings: dict[bytes, list[int]] = field(default_factory=dict)
    size: int = 0

    def add(self, doc_id: int, text: bytes) -> None:
        counts = term_counts(text)
        place = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        for term, tf in counts.items():
            self.postings.setdefault(term, []).extend((place, tf))
        self.size += len(text)

    def rows(self, number: int) -> pa.RecordBatch:
        """The shard's blocks: for each term its documents in blocks, and what each block's postings can score at most.

        ``impacts`` are the pairs (frequency, document length) of a block that no other pair beats in both: whatever the
        whole table's mean length is, one of them has the block's highest score.
        """
        terms = sorted(self.postings)
        counts = np.array([len(self.postings[t]) // 2 for t in terms], np.int64)
        flat = np.fromiter((x for t in terms for x in self.postings[t]), np.int64, int(counts.sum()) * 2)
        docs, tfs = flat[0::2], flat[1::2]
        blocks = -(-counts // BLOCK)
        of_term = np.repeat(np.arange(len(terms)), blocks)
        within = np.arange(len(of_term)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(counts) - counts, blocks) + within * BLOCK
        n = np.minimum(np.repeat(counts, blocks) - within * BLOCK, BLOCK)
        ends = starts + n
        of_block = np.repeat(np.arange(len(n)), n)
        gaps = np.diff(docs, prepend=0)
        gaps[starts] = 0
        # a block's gaps and then its frequencies
        both = np.empty(2 * len(docs), np.int64)
        at = np.arange(len(docs)) + np.repeat(starts, n)
        both[at], both[at + np.repeat(n, n)] = gaps, tfs
        payload, sizes = varints(both)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        bounds = sums[np.concatenate([2 * starts, [len(both)]])]
        lengths = np.array(self.lengths, np.int64)
        order = np.lexsort((-tfs, lengths[docs], of_block))
        tops = of_block[order] * (int(tfs.max(initial=0)) + 1) + tfs[order]
        best = np.concatenate([[-1], np.maximum.accumulate(tops)[:-1]])
        kept = order[(tops > best) | np.concatenate([[True], np.diff(of_block[order]) > 0])[: len(order)]]
        pairs = np.stack([tfs[kept], lengths[docs[kept]]], 1).astype("<i8")
        pair_ends = np.concatenate([[0], np.cumsum(np.bincount(of_block[kept], minlength=len(n)))]) * 16
        names = pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()).take(pa.array(of_term))
        size = len(n)
        found = [pa.array(np.full(size, number)), names, pa.array(within.astype(np.int32)), pa.array(docs[starts].astype(np.int32)), pa.array(docs[ends - 1].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.zeros(size, np.int64)), _binary(pairs.tobytes(), pair_ends), _binary(payload.tobytes(), bounds)]
        held = np.array(self.ids, "<i8").tobytes() + lengths.astype("<i8").tobytes()
        own = [[number], [DOCS], [0], [0], [len(self.ids) - 1], [int((lengths > 0).sum())], [int(lengths.sum())], [b""], [held]]
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(o, f.type), f]) for o, f in zip(own, found, strict=True)], names=names)


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def build_index(docs: DataFrame, *, shard_bytes: int = SHARD) -> DataFrame:
    """The index of every row of ``docs`` (doc_id, text): rows (shard, term, block, first, last, n, total, impacts, payload).

    A task puts its rows into shards of some 16 MB of text, so that nothing is shuffled and a shard is all that it holds;
    a row that is longer is a shard of its own. A term's postings in a shard are blocks of 64: the first and the last
    document's place in the shard, how many there are, what they can score at most, and gaps and frequencies in bytes of
    seven bits. One row of each shard, with the empty term, has its documents: n of them have terms, ``total`` all told;
    its payload are their ids and lengths. Rows without a doc_id are left out; null and empty texts have no terms.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, held = (task.partitionId() if task else 0) << 32, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held.ids and held.size + (len(text.as_buffer()) if text.is_valid else 0) > shard_bytes:
                    yield held.rows(number)
                    number, held = number + 1, Shard()
                held.add(doc_id, text.as_buffer().to_pybytes().lower() if text.is_valid else b"")
        if held.ids:
            yield held.rows(number)
        give_back()

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shards, INDEX)


# The search


@dataclass
class Lists:
    """A term's blocks in one shard, and its postings as far as anything has asked for them."""

    weight: int
    first: np.ndarray
    last: np.ndarray
    n: np.ndarray
    tops: np.ndarray
    payload: list[bytes]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.top = int(self.tops.max(initial=0))


class ShardSearch:
    """Searches one shard: its documents' ids and norms, and the lists of the terms that any item has."""

    def __init__(self, documents: bytes, n_docs: int, n_terms: int) -> None:
        found = np.frombuffer(documents, "<i8")
        self.ids, lengths = found[: len(found) // 2], found[len(found) // 2 :]
        self.n_docs, self.n_terms = n_docs, n_terms
        self.norms = self.norm(lengths)
        self.decoded = 0

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """100 - 90 + 90 * n * N div L, times 8 as the score takes it; whole numbers of any size on the way."""
        different, place = np.unique(lengths, return_inverse=True)
        return np.array([8 * (10 + 90 * n * self.n_docs // max(self.n_terms, 1)) for n in different.tolist()], np.int64)[place]

    @staticmethod
    def parts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + norms)

    def lists(self, rows: pd.DataFrame) -> Lists:
        """One term's rows in the order of their blocks."""
        impacts = np.frombuffer(b"".join(rows["impacts"]), "<i8").reshape(-1, 2)
        sizes = np.array([len(x) // 16 for x in rows["impacts"]])
        tops = np.maximum.reduceat(self.parts(impacts[:, 0], self.norm(impacts[:, 1])), np.cumsum(sizes) - sizes)
        return Lists(int(rows["weight"].iloc[0]), rows["first"].to_numpy(), rows["last"].to_numpy(), rows["n"].to_numpy(), tops * int(rows["weight"].iloc[0]), list(rows["payload"]))

    def postings(self, lists: Lists, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of some blocks, in their order, and what the term adds to each one's score."""
        missing = [b for b in blocks.tolist() if b not in lists.held]
        if missing:
            self.decoded += len(missing)
            values = numbers(np.frombuffer(b"".join(lists.payload[b] for b in missing), np.uint8))
            at = 0
            for b in missing:
                n = int(lists.n[b])
                docs = np.cumsum(values[at : at + n]) + int(lists.first[b])
                lists.held[b] = docs, self.parts(values[at + n : at + 2 * n], self.norms[docs]) * lists.weight
                at += 2 * n
        parts = [lists.held[b] for b in blocks.tolist()]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def best(self, item: list[Lists], k: int) -> list[tuple[int, int]]:
        """The k highest (score, place) above 0, equal scores by ascending doc_id.

        Lists go by what they can add at most. As long as the lists that are left can together reach the k-th best sum
        so far, they are essential: the next one brings its documents in. From then on no list brings in documents: a list
        is asked only for those that can still reach the k-th best, first by what it can add at most, then by the maximum of the
        block in which the document would stand; only blocks that are left are decompressed. Sums never fall, so that the
        k-th best sum is a bound of the result at any time; what just reaches it stays, for its doc_id may be smaller.
        """
        lists = sorted((x for x in item if x.top > 0), key=lambda x: -x.top)
        rest = np.cumsum([x.top for x in lists][::-1])[::-1].tolist() + [0]
        sums = np.zeros(len(self.ids), np.int64)
        bound, met, i = 0, np.zeros(0, np.int64), 0
        while i < len(lists) and rest[i] >= max(bound, 1):
            docs, adds = self.postings(lists[i], np.arange(len(lists[i].n)))
            sums[docs] += adds
            met = np.flatnonzero(sums)
            bound = int(np.partition(sums[met], -k)[-k]) if len(met) >= k else 0
            i += 1
        for j in range(i, len(lists)):
            each = lists[j]
            met = met[sums[met] + rest[j] >= bound]
            block = np.searchsorted(each.last, met)
            inside = block < len(each.last)
            inside[inside] = each.first[block[inside]] <= met[inside]
            most = np.where(inside, each.tops[np.minimum(block, len(each.last) - 1)], 0)
            met = met[able := sums[met] + most + rest[j + 1] >= bound]
            wanted = np.unique(block[able & inside])
            if len(wanted):
                docs, adds = self.postings(each, wanted)
                place = np.searchsorted(docs, met)
                there = place < len(docs)
                there[there] = docs[place[there]] == met[there]
                sums[met[there]] += adds[place[there]]
            bound = max(bound, int(np.partition(sums[met], -k)[-k])) if len(met) >= k else bound
        order = np.lexsort((self.ids[met], -sums[met]))[:k]
        return [(int(sums[d]), int(d)) for d in met[order]]


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM_TEXT), F.lit(0)))


def weighted_terms(items: DataFrame, index: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, items, weight, of) of all items (item_id, text): a term's weight and, in blocks of items, who has it.

    Also how many documents have terms, and how many terms they have. The frequencies are sums over the blocks of these
    terms alone; of the index only the terms and counts are read.
    """
    wanted = items.where("item_id IS NOT NULL").select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    wanted = written(wanted.withColumn("of", F.pmod(F.xxhash64("item_id"), F.lit(-(-max(items.count(), 1) // ITEMS)))), "item_terms")
    lists = written(wanted.groupBy("term", "of").agg(F.collect_list("item_id").alias("items")), "term_items")
    n_docs, n_terms = index.where(F.col("term") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    terms = lists.select("term").distinct()
    held = index.select("term", "n").join(_small(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2.0 + 1)) * 1000).cast("long")
    return lists.join(held.select("term", weight.alias("weight")), "term").where("weight > 0"), n_docs, n_terms


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shard_tops(index: DataFrame, weighted: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): of each shard each item's ``top`` best documents."""
    asked = written(weighted, "weighted_terms")
    blocks = index.where(F.col("term") != DOCS).join(_small(asked), "term")
    columns = ["shard", "of", "term", "block", "first", "last", "n", "weight", "items", "impacts", "payload"]
    # every block of items that a shard has terms of also gets the shard's documents
    documents = index.where(F.col("term") == DOCS).join(F.broadcast(asked.select("of").distinct()))
    documents = documents.withColumns({"weight": F.lit(0).cast("long"), "items": F.array().cast(asked.schema["items"].dataType)})

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["term"] == DOCS
        shard = ShardSearch(rows.loc[own, "payload"].iloc[0], n_docs, n_terms)
        items: dict[int, list[Lists]] = {}
        for _, each in rows[~own].sort_values(["term", "block"]).groupby("term", sort=False):
            found = shard.lists(each)
            for item in each["items"].iloc[0]:
                items.setdefault(item, []).append(found)
        best = [(item, int(shard.ids[d]), score) for item, lists in items.items() for score, d in shard.best(lists, top)]
        return pd.DataFrame(best, columns=["item_id", "doc_id", "score"])

    rows = blocks.select(*columns).unionByName(documents.select(*columns))
    return rows.groupBy("shard", "of").applyInPandas(search, f"item_id {asked.schema['items'].dataType.elementType.simpleString()}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP, shard_bytes: int = SHARD) -> DataFrame:
    """Each item's ``top`` documents: (item_id, rank, doc_id, score), ranks from 1, equal scores by ascending doc_id.

    ``docs``: doc_id, text; ``items``: item_id, text. Terms are maximal runs of ASCII letters, digits and other than
    ASCII characters, A-Z as a-z; a document's score sums, over the item's different terms, the term's weight times a
    quotient that grows with its frequency and falls with the document's length (see ``ShardSearch``); only scores above 0
    are given. Null texts have no terms; rows without a doc_id or item_id are left out; rows of one item_id are one item
    with the terms of all; rows of one doc_id are documents of their own, each with a rank. Texts are indexed whole;
    extra columns are not looked at; empty tables give an empty result.

    The index is written once and then read by columns: for counts, and for the blocks of terms that items have. A shard's
    blocks meet in one group for each 256 items, whose size the shard bounds; each group gives its heap of ``top``, and
    the heaps of an item merge before and after one shuffle.
    """
    index = written(build_index(docs, shard_bytes=shard_bytes), "index")
    weighted, n_docs, n_terms = weighted_terms(items, index)
    found = shard_tops(index, weighted, n_docs, n_terms, top)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_TEXT}') AS terms
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_TEXT}')) AS term
  FROM benchmark),
p AS (SELECT doc_id, n_own, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n_own, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n_own * s.n) // s.l)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}"""
