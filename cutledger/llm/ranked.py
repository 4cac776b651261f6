"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are read once per block of items: each keeps its length and how often it holds the
block's terms. Every task then cuts its documents into blocks, lays the terms of a block out as
impact lists, and answers each item from them. Lists are read at their best position, the last one
up to which every position was seen; a document found there is accessed directly in all lists of
the item, which moves the best positions of the others. No unseen document scores more than the
impacts at the best positions together, so reading ends once that is strictly below the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import KEY, keyed, stored, text_of
from cutledger.llm.tokens import runs

TOP = 50
#: Item terms handled in one reading of the documents; more items take more readings.
ITEM_TERMS = 200_000
#: Postings of one block of documents in a task.
POSTINGS = 1_000_000
#: Positions that the first access to a list takes; each next one takes twice as many.
STEP = 32

_TABLE = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in range(256)
)
_ITEMS = f"{KEY} bigint, terms array<binary>"
_POSTED = f"{KEY} bigint, id bigint, n bigint, terms array<int>, tfs array<int>"
_HITS = f"item bigint, {KEY} bigint, id bigint, score bigint"


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII; A to Z lower-cased."""
    return text.encode().translate(_TABLE).split()


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(x))) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=[KEY, "terms"])


def _post(known: dict[bytes, int], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document that has a term: its length, and the known terms it holds."""
    width = len(known) + 1
    for batch in batches:
        texts = batch.column(2)
        for a, b in runs(pc.utf8_length(texts).to_pylist()):
            sizes, found = [], []
            for i, text in enumerate(texts.slice(a, b - a).to_pylist()):
                words = terms_of(text)
                sizes.append(len(words))
                ids = np.fromiter(filter(None, map(known.get, words)), np.int64)
                found.append(ids + i * width)
            both, tf = np.unique(np.concatenate(found), return_counts=True)
            ends = np.searchsorted(both, np.arange(b - a + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (both % width - 1, tf)]
            n = pa.array(sizes, pa.int64())
            rows = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), n, *lists], names=[KEY, "id", "n", "terms", "tfs"])
            yield rows.filter(pc.greater(n, 0))


class Best:
    """The k best documents met so far, by score, then id (null last), then key."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((4, 0), np.int64)

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        rows = np.concatenate((self.rows, np.stack((scores, none, ids, keys))), axis=1)
        self.rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], -rows[0]))[: self.k]]


class Lists:
    """Impact lists of one block of documents, and each document's places in them."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.terms, self.impacts, self.n_terms = terms, impacts, n_terms
        self.row_ends = np.concatenate(([0], np.cumsum(sizes)))
        docs = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.place = np.empty(len(terms), np.int64)
        self.place[order] = np.arange(len(terms)) - self.starts[terms[order]]
        self.accessed = 0

    def search(self, item: np.ndarray, k: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best, `before` being scores met elsewhere."""
        item = item[self.starts[item + 1] > self.starts[item]]
        start, length = self.starts[item], self.starts[item + 1] - self.starts[item]
        offset = np.cumsum(length) - length
        which = np.full(self.n_terms, -1)
        which[item] = np.arange(len(item))
        seen = np.zeros(int(length.sum()), bool)
        best = np.zeros(len(item), np.int64)  # contiguous seen positions of each list
        open_ = list(range(len(item)))
        docs, scores, top, step = [], [], before, STEP
        while open_:
            want = []
            for j in open_:
                at = offset[j] + best[j]
                free = np.flatnonzero(~seen[at : min(at + 2 * step, offset[j] + length[j])])[:step]
                want.append(self.list_docs[start[j] + best[j] + free])
            new = np.unique(np.concatenate(want))
            self.accessed += len(new)
            # Direct access: the rows of these documents hold their place in every list.
            first, n = self.row_ends[new], self.row_ends[new + 1] - self.row_ends[new]
            begin = np.cumsum(n) - n
            at = np.repeat(first - begin, n) + np.arange(n.sum())
            list_of = which[self.terms[at]]
            mine = list_of >= 0
            score = np.add.reduceat(np.where(mine, self.impacts[at], 0), begin)
            seen[offset[list_of[mine]] + self.place[at[mine]]] = True
            docs.append(new)
            scores.append(score)
            top = np.concatenate((top, score))
            if len(top) > k:
                top = np.partition(top, len(top) - k)[-k:]
            still, bound = [], 0
            for j in open_:
                rest = seen[offset[j] + best[j] : offset[j] + length[j]]
                gap = int(rest.argmin())
                if rest[gap]:
                    continue  # seen to its end: what is unseen is not in this list
                best[j] += gap
                still.append(j)
                bound += int(self.list_impacts[start[j] + max(best[j] - 1, 0)])
            open_ = still
            if len(top) == k and bound < top.min():
                break
            step *= 2
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = (scores > 0) & (scores >= (top.min() if len(top) == k else 0))
        return docs[good], scores[good]


def impact(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _search(items, weights, n_docs: int, n_terms: int, k: int, most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of the task's documents for each item; memory holds one block and the best."""
    items, weights = items.value, weights.value
    found = {key: Best(k) for key, _ in items}
    held, n_held = [], 0

    def answer() -> None:
        table = pa.Table.from_batches(held)
        key, ids, n = (table.column(i).combine_chunks() for i in (0, 1, 2))
        none, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
        terms, tfs = (table.column(i).combine_chunks() for i in (3, 4))
        sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
        terms, tfs = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        lists = Lists(sizes, terms, impact(tfs, np.repeat(n.to_numpy(), sizes), weights[terms], n_docs, n_terms), len(weights))
        key = key.to_numpy()
        for item, wanted in items:
            docs, scores = lists.search(wanted, k, found[item].rows[0])
            found[item].add(scores, none[docs], ids[docs], key[docs])

    for batch in batches:
        for a, b in runs(pc.list_value_length(batch.column(3)).to_pylist(), most):
            part = batch.slice(a, b - a)
            n = len(part.column(3).flatten())
            if n_held and n_held + n > most:
                answer()
                held, n_held = [], 0
            held.append(part)
            n_held += n
    if held:
        answer()
    for item, best in found.items():
        score, none, ids, keys = best.rows
        if len(score):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item)), pa.array(keys), pa.array(ids, mask=none.astype(bool)), pa.array(score)], names=["item", KEY, "id", "score"]
            )


def _blocks(items: DataFrame, most: int) -> Iterator[list]:
    """The items with terms in blocks of about `most` terms, dealt by hash of their key."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // most)
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64(KEY), F.lit(n)) == b).where(F.size("terms") > 0).collect()


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = TOP, item_terms: int = ITEM_TERMS, postings: int = POSTINGS,
) -> DataFrame:
    """The k best documents of each row of `items`: item_id, rank, doc_id, score (above 0).

    Terms are runs of ASCII letters, digits and other scripts, A to Z lower-cased; a null text has
    none. An item's terms count once. Equal scores go by ascending id, null ids last, then by row.
    Each row of `items` is an item of its own, also where its id is null or comes again; so is
    each row of `docs`. Items or tables without terms give no rows. Other columns are ignored.

    Items are worked on in blocks of about `item_terms` terms, which is what travels to the tasks.
    A task holds `postings` postings at a time and carries the k best scores from one block of
    documents to the next, so only k rows of each item leave it; each task's rows are cut to k
    again before they meet by item.
    """
    rows = keyed(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "id").select(KEY, F.col("id").cast("bigint").alias("id"), "text")
    asked = keyed(items.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text")), "item_id")
    named = stored(asked.select(KEY, "text").mapInArrow(_item_terms, _ITEMS), "items")
    context, results = docs.sparkSession.sparkContext, []
    for block in _blocks(named, item_terms):
        known = {t: i + 1 for i, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
        posted = stored(rows.mapInArrow(partial(_post, known), _POSTED), "postings")
        n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(known), np.int64)
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # no more than the block's terms
            df[r["t"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        asks = [(r[KEY], np.array([known[bytes(t)] - 1 for t in r["terms"]], np.int64)) for r in block]
        task = partial(_search, context.broadcast(asks), context.broadcast(weights), n_docs, n_terms, k, postings)
        results.append(stored(posted.mapInArrow(task, _HITS), "hits"))
    if not results:
        results = [docs.sparkSession.createDataFrame([], _HITS)]
    hits = results[0]
    for more in results[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), KEY)
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col(KEY).alias("item"), "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN i USING (term) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
