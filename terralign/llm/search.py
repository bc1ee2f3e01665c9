"""Ranked lexical search by a length-stratified index.

The score of a term in a document depends on its count tf there and on the document's
length normaliser m alone. Documents of equal m are a stratum; large strata are cut into
blocks. In a block the postings of a term are grouped by tf, and what a tf is worth there is
computed once. The largest tf of every term bounds the score that any document of the
block can have for an item: blocks of high bounds are visited first, and afterwards only
blocks whose bound reaches the k-th score found there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import looked_up, written

#: Bytes of ASCII that separate terms become blanks, A-Z become lower case; all other bytes are parts of terms.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
#: Items searched at once hold at most so many different terms together (or are one item); more are searched block by block.
VOCABULARY = 200_000
#: Items at once.
ITEMS = 10_000
#: Postings of a block, about.
POSTINGS = 250_000
#: Blocks that an item visits first.
FIRST = 8


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII of a whole text, A-Z lowered."""
    return (text or b"").translate(LETTERS).split()


@dataclass
class Items:
    """Items to be searched at once: ids, vocabulary (term -> number), and the numbers of each item's terms."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    def weights(self, df: dict[int, int], documents: int) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
        return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)


def items_of(items: DataFrame, item: str, text: str) -> Iterator[Items]:
    """Items in blocks of bounded vocabulary; the driver holds one block at a time."""
    now = Items([], {}, [])
    for row in items.select(item, text).toLocalIterator():
        own = sorted(set(terms((row[1] or "").encode("utf-8", "surrogatepass"))))
        if now.ids and (len(now.ids) >= ITEMS or len(now.vocabulary) + len(own) > VOCABULARY):
            yield now
            now = Items([], {}, [])
        now.ids.append(row[0])
        now.terms.append(np.array([now.vocabulary.setdefault(t, len(now.vocabulary)) for t in own], np.int64))
    if now.ids:
        yield now


def counted(docs: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """Every document: doc, n (all its terms), and those of the vocabulary with their counts: terms, tfs."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, found, counts = [], [], []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(value)
                sizes.append(len(words))
                known = np.array([t for t in map(number, words) if t is not None], np.int32)
                own, tf = np.unique(known, return_counts=True)
                found.append(own)
                counts.append(tf)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def index(told: DataFrame, documents: int, length: int) -> DataFrame:
    """The stratified index of counted() documents with at least one term: a row for each block.

    m and part name the block; docs has its documents. terms, tfs and ends have one place
    for each term and tf of the block, by term and descending tf; the documents of place k are
    those of postings (numbers in docs) from ends[k - 1] to ends[k]. N * n must be less
    than 2^63 / 50.
    """
    m = (50 + F.expr(f"(50L * n * {documents}L) div {max(length, 1)}L")).cast("long")
    rows = told.where("n > 0 and size(terms) > 0").withColumn("m", m)
    strata = written(rows.groupBy("m").agg(F.sum(F.size("terms")).alias("_postings"), F.count("*").alias("_docs")))
    parts = looked_up(rows, strata, ["m"], "_docs")
    parts = parts.select("m", F.pmod(F.xxhash64("doc", "terms"), F.ceil(F.col("_postings") / POSTINGS)).cast("int").alias("part"), "doc", "terms", "tfs")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
        doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
        order = np.lexsort((doc, -tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        last = np.flatnonzero(np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True))
        lists = [table.column("doc").combine_chunks(), *(pa.array(x.astype(np.int32)) for x in (term[last], tf[last], last + 1, doc))]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        first = [pa.array([table.column(c)[0].as_py()], kind) for c, kind in (("m", pa.int64()), ("part", pa.int32()))]
        return pa.Table.from_arrays([*first, *columns], names=["m", "part", "docs", "terms", "tfs", "ends", "postings"])

    return parts.groupBy("m", "part").applyInArrow(build, "m long, part int, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, postings array<int>")


class Block:
    """A row of the index, ready to be searched with items of given weights."""

    def __init__(self, m: int, weight: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray):
        self.terms, self.ends, self.begins = terms, ends, np.append(0, ends[:-1])
        each, of = np.unique(tfs.astype(np.int64), return_inverse=True)
        self.impact = weight[terms] * (1_000_000_000 * each // (1000 * each + 20 * m))[of]  # computed once for each tf
        self.first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))  # the largest tf of each term
        self.most = np.zeros(len(weight), np.int64)
        self.most[terms[self.first]] = self.impact[self.first]
        self.place = np.full(len(weight), -1)
        self.place[terms[self.first]] = np.arange(len(self.first))
        self.value: np.ndarray | None = None

    def bounds(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The highest score possible here for each item; flat has the terms of all items, starts where each begins (and the end)."""
        sums = np.concatenate([[0], np.cumsum(self.most[flat])])
        return sums[starts[1:]] - sums[starts[:-1]]

    def scores(self, item: np.ndarray, postings: np.ndarray, size: int) -> np.ndarray:
        """The score of every document of the block for an item."""
        if self.value is None:
            self.value = np.repeat(self.impact, self.ends - self.begins)
            self.edge = np.append(self.first, len(self.ends))
        held = self.place[item]
        held = held[held >= 0]
        low, high = self.begins[self.edge[held]], self.ends[self.edge[held + 1] - 1]
        out = np.zeros(size, np.int64)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            out[postings[a:b]] += self.value[a:b]  # a term has a document once
        return out


def _best(docs: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending doc (null first)."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((docs[some], ~null[some], -scores[some]))[:k]]
    return np.lexsort((docs, ~null, -scores))[:k]


def searched(index: DataFrame, items: Items, weight: np.ndarray, k: int, least: np.ndarray, only: dict[tuple[int, int], list[int]] | None = None) -> DataFrame:
    """The k best documents of each item among the blocks that a task reads: item (a number), doc, score, visited (blocks).

    least: a score that the k-th best document of each item is known to have, at least. Blocks that can't
    reach it for an item are passed over. only: the items that visit a block, if not all.
    """
    flat, starts = np.concatenate([np.zeros(0, np.int64), *items.terms]), np.concatenate([[0], np.cumsum([len(t) for t in items.terms])])
    shared = index.sparkSession.sparkContext.broadcast((items.terms, flat, starts, weight, least, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, flat, starts, weight, known, only = shared.value
        least = known.copy()
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        visited = np.zeros(len(terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                m, part = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                if only is not None and (m, part) not in only:
                    continue
                docs_ = batch.column(2)[r].values
                docs, null = docs_.fill_null(0).to_numpy(), docs_.is_null().to_numpy(zero_copy_only=False)
                block = Block(m, weight, *(batch.column(c)[r].values.to_numpy() for c in (3, 4, 5)))
                postings = batch.column(6)[r].values.to_numpy()
                bounds = block.bounds(flat, starts)
                asked = np.flatnonzero((bounds >= least) & (bounds > 0)) if only is None else only[m, part]
                for i in asked:
                    visited[i] += 1
                    scores = block.scores(terms[i], postings, len(docs))
                    some = np.flatnonzero(scores >= least[i])
                    if not len(some):
                        continue
                    own = docs[some], null[some], scores[some]
                    if i in held:
                        own = tuple(np.concatenate(x) for x in zip(held[i], own, strict=True))
                    top = _best(*own, k)
                    held[i] = tuple(x[top] for x in own)
                    if len(top) == k:
                        least[i] = max(least[i], held[i][2][-1])
        for i, (docs, null, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)), pa.array(docs, pa.int64(), mask=null), pa.array(scores), pa.array(np.full(len(docs), visited[i]))], names=["item", "doc", "score", "visited"])

    return index.mapInArrow(run, "item int, doc long, score long, visited long")


def first_visits(index: DataFrame, items: Items, weight: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """The FIRST blocks of highest bound for each item: block -> items. At most FIRST rows for each item and task leave a task, and FIRST for each item reach the driver."""
    flat, starts = np.concatenate([np.zeros(0, np.int64), *items.terms]), np.concatenate([[0], np.cumsum([len(t) for t in items.terms])])
    shared = index.sparkSession.sparkContext.broadcast((flat, starts, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, weight = shared.value
        n = len(starts) - 1
        bound, where = np.full((FIRST, n), -1, np.int64), np.zeros((FIRST, n, 2), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                own = Block(name[0], weight, *(batch.column(c)[r].values.to_numpy() for c in (2, 3, 4))).bounds(flat, starts)
                low = bound.argmin(axis=0)
                better = np.flatnonzero(own > bound[low, np.arange(n)])
                bound[low[better], better], where[low[better], better] = own[better], name
        f, i = np.nonzero(bound > 0)
        if len(f):
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(bound[f, i]), pa.array(where[f, i, 0]), pa.array(where[f, i, 1].astype(np.int32))], names=["item", "bound", "m", "part"])

    tops = written(index.select("m", "part", "terms", "tfs", "ends").mapInArrow(run, "item int, bound long, m long, part int"), 16)
    out: dict[tuple[int, int], list[int]] = {}
    for r in top(tops, ["bound desc", "m", "part"], FIRST).collect():
        out.setdefault((r["m"], r["part"]), []).append(r["item"])
    return out


def top(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows of each item, with rank; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("rank", F.expr(f"row_number() over (partition by item order by {', '.join(order)})")).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0 (all, if fewer): item_id, rank (from 1), doc_id, score, visited.

    Terms and scores are those of the module. With N documents that have a term, L terms in all of
    them, n in one, tf times a term there and df documents with it: m = 50 + (50 n N) div L,
    and a document's score is the sum over an item's different terms of floor(1000 ln((2 N + 2)
    / (2 df + 1))) * ((10^9 tf) div (1000 tf + 20 m)). Equal scores rank by ascending doc_id.

    visited counts the blocks of the index that were scored for the item in the task that found the row.
    Null and empty texts have no terms: such a document counts nowhere, such an item finds nothing. A null
    doc_id is ranked before others of its score; rows equal in doc_id are documents each; rows of items
    with one item_id are ranked each. Very long texts are whole; other columns are ignored; empty tables
    give no rows.

    Only postings of the items' terms are kept. All documents are counted once for each
    block of items (see items_of).
    """
    spark = docs.sparkSession
    out = None
    for block in items_of(items, item, item_text):
        told = written(counted(docs, key, text, block), 512)
        documents, length = told.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["n"] for r in told.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # as many as the vocabulary
        weight = block.weights(df, documents)
        strata = written(index(told, documents, length))
        none = np.ones(len(block.ids), np.int64)
        visits = first_visits(strata, block, weight)
        # Of the documents found at the first visits the k-th score is a floor for the rest.
        floor = written(searched(strata, block, weight, k, none, visits), 16)
        least = none.copy()
        for r in top(floor, ["score desc", "doc"], k).where(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
        found = top(written(searched(strata, block, weight, k, least), 16), ["score desc", "doc"], k)
        named = spark.createDataFrame(list(enumerate(block.ids)), f"item int, {item} {items.schema[item].dataType.simpleString()}")
        found = found.join(F.broadcast(named), "item").select(item, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score", "visited")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{item} {items.schema[item].dataType.simpleString()}, rank int, {key} long, score long, visited long")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the 50 best documents for every benchmark item."""
    found = ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB's SQL.
ORACLE = r"""WITH docs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
items AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
tf AS (SELECT doc_id, t, count(*) AS tf FROM docs GROUP BY ALL), len AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM len), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // l AS m FROM len, totals),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM items JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 50"""
