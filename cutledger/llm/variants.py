"""Spelling variants by a dictionary of trie-node pairs.

All words lie in two tries, one read forwards and one backwards. A word without its character at i
is the pair (node of what is before i, node of what is after i); a word cut at i is such a pair
too. Words that differ by one replaced character share a pair with a hole, and a word with one
more character has a pair with a hole that is the other word's cut. So near words meet by equality
of two integers, exactly, and a pair of words meets once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import stored, text_of
from cutledger.llm.tokens import runs

SHORTEST, LEAST = 5, 3
#: One run in so many loses a character before words are counted.
EVERY = 97
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run_words(text: str) -> list[str]:
    """The runs of Latin letters (and the two signs among them), A to Z lower-cased."""
    return _RUN.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def thinned(doc: str, run: str, every: int) -> str:
    """The run, without one character where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if every and h % every == 0:
        i = h % len(run)
        return run[:i] + run[i + 1 :]
    return run


def _count(shortest: int, every: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in runs(pc.utf8_length(texts).to_pylist(), 4_000_000):
            total: Counter[str] = Counter()
            for doc, text in zip(docs[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                for run, n in Counter(run_words(text)).items():
                    word = thinned(doc, run, every)
                    if len(word) >= shortest:
                        total[word] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n: words of at least `shortest` code points and `least` occurrences in all texts.

    One of `every` runs, by checksum of its document's id (null: empty) and itself, loses a
    character first; 0 leaves all as they are.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), text_of(text_col).alias("text"))
    counted = rows.mapInArrow(partial(_count, shortest, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common_prefix(a: str, b: str) -> int:
    """How many characters two words share at their beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _across(part: int, depth: int) -> int:
    """The number of a node that words on both sides of the beginning of a part share."""
    return -(part << 32 | depth) - 1


def _edges(edges: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int], int, str]]:
    """For each part: what its first word shares with the word before, the nodes along that, the next part and its first word.

    A node that goes on over several parts has the number it got at the first of their borders.
    """
    out, path = {}, [0]
    for k, (part, first, last) in enumerate(edges):
        before = edges[k - 1][2] if k else ""
        n = common_prefix(before, first)
        path = [0] + [path[i] if i < len(path) else _across(part, i) for i in range(1, n + 1)]
        after = edges[k + 1][:2] if k + 1 < len(edges) else (0, "")
        out[part] = (before[:n], path, *after)
        path = path[: common_prefix(before[:n], last) + 1]
    return out


def _number(edges: dict[int, tuple[str, list[int], int, str]], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, at, word, path: the trie's nodes along each word, from sorted words; memory holds one path."""
    part, word, path, border, after, fresh, at = None, "", [0], 0, "", 0, 0
    for batch in batches:
        rows, size = [], 0
        for p, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part:
                part, (word, path, border, after), fresh, at = p, edges[p], 0, 0
            keep, across = common_prefix(word, w), common_prefix(w, after)
            path = path[: keep + 1]
            for depth in range(len(path), len(w) + 1):
                fresh += 1
                path.append(_across(border, depth) if depth <= across else (p + 1) << 40 | fresh)
            rows.append((p, at, w, path))
            word, at, size = w, at + 1, size + len(w)
            if size > 500_000:
                yield _paths(rows)
                rows, size = [], 0
        if rows:
            yield _paths(rows)


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "at", "word", "path"])


def trie(words: DataFrame, col: str) -> DataFrame:
    """part, at, word (of `col`, distinct), path: numbers of the trie's nodes from the root to the word's end.

    Words are dealt to parts by range and sorted. Numbers of nodes within a part are its own; a
    node that reaches over the borders of parts is named by the first border and its depth, found
    from each part's first and last word, two words a part. `part`, then `at`, give the words' order.
    """
    ranged = words.select(F.col(col).alias("word")).repartitionByRange("word").select(F.spark_partition_id().cast("bigint").alias("part"), "word")
    laid = stored(ranged, "ranges")
    edges = [tuple(r) for r in laid.groupBy("part").agg(F.min("word").alias("a"), F.max("word").alias("b")).orderBy("part").collect()]
    sorted_ = laid.repartition("part").sortWithinPartitions("part", "word")
    return stored(sorted_.mapInArrow(partial(_number, _edges(edges)), "part bigint, at bigint, word string, path array<bigint>"), "trie")


def near_words(words: DataFrame) -> DataFrame:
    """id, word, n, n_near, near_n, near_id: how many words of `words` (word, n) are near each, and the nearest by count.

    Ids go in code-point order of the words. Near words differ by exactly one inserted, deleted or
    replaced code point; of those, the one of the largest n, then the first in order. A word that
    none is near has n_near 0 and nulls.

    A group of one pair holds at most one cut word and one word for each character of the alphabet,
    so what is gathered is bounded by that. A deleted character of a run of equal ones is counted
    at the run's beginning only.
    """
    forward = trie(words, "word").select(F.expr("part << 40 | at").alias("id"), "word", F.col("path").alias("before"))
    backward = trie(words.select(F.reverse("word").alias("drow")), "drow").select(F.reverse("word").alias("word"), F.col("path").alias("after"))
    table = stored(forward.join(words, "word").join(backward, "word"), "paths")
    letters = table.select("id", "n", "before", "after", F.split("word", "").alias("c"), F.expr("size(before) - 1").alias("l"))
    holes = letters.select("*", F.explode(F.expr("sequence(0, l - 1)")).alias("i")).select(
        F.expr("before[i]").alias("p"),
        F.expr("after[l - i - 1]").alias("s"),
        # 1: also stands for the deletion of its character; 2: for a replacement only.
        F.when(F.expr("i > 0 AND get(c, i - 1) = c[i]"), 2).otherwise(1).alias("kind"),
        "id",
        "n",
    )
    cuts = table.select("id", "n", F.posexplode("before").alias("i", "p"), "after").select("p", F.expr("after[size(after) - 1 - i]").alias("s"), F.lit(0).alias("kind"), "id", "n")
    groups = holes.unionByName(cuts).groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "kind"))).alias("m")).where("size(m) > 1")
    parts = groups.select(
        "m",
        F.expr("filter(m, x -> x.kind > 0)").alias("holes"),
        F.expr("get(filter(m, x -> x.kind = 1), 0)").alias("longer"),
        F.expr("size(filter(m, x -> x.kind = 1))").alias("n_longer"),
        F.expr("get(filter(m, x -> x.kind = 0), 0)").alias("cut"),
    )
    of_hole = "CASE WHEN x.id = holes[0].id THEN get(holes, 1) ELSE holes[0] END"
    found = parts.select(
        F.explode(
            F.expr(
                f"""transform(m, x -> CASE WHEN x.kind = 0 THEN named_struct('id', x.id, 'c', n_longer, 'best', longer)
                WHEN x.kind = 1 AND cut IS NOT NULL THEN named_struct('id', x.id, 'c', size(holes), 'best', coalesce(least({of_hole}, cut), cut))
                ELSE named_struct('id', x.id, 'c', size(holes) - 1, 'best', {of_hole}) END)"""
            )
        ).alias("f")
    )
    best = found.where("f.c > 0").groupBy("f.id").agg(F.sum("f.c").alias("n_near"), F.min(F.struct("f.best.less", "f.best.id")).alias("best"))
    return table.select("id", "word", "n").join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-F.col("best.less")).alias("near_n"), F.col("best.id").alias("near_id")
    )


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of `words` (word, n; words distinct).

    A word's form is its near word of the largest n, if that is at least twice its own. Counts grow
    along forms, so a root is reached in as many steps as n can double; each round halves what is
    left of the way of all words at once.
    """
    near = stored(near_words(words), "near-words")
    near = near.withColumn("form_id", F.when(F.col("near_n") >= 2 * F.col("n"), F.col("near_id")))
    ways = stored(near.select("id", F.coalesce("form_id", "id").alias("to")), "forms")
    while True:
        onward = ways.select(F.col("id").alias("to"), F.col("to").alias("then"))
        further = stored(ways.join(onward, "to").select("id", F.col("then").alias("to"), (F.col("to") != F.col("then")).alias("moved")), "roots")
        ways = further.select("id", "to")
        if further.where("moved").limit(1).count() == 0:
            break
    names = near.select(F.col("id").alias("of"), F.col("word").alias("name"))
    form, root = names.toDF("form_id", "form"), names.toDF("to", "root")
    return near.join(ways, "id").join(root, "to").join(form, "form_id", "left").select(
        "word", "form", "root", "n", "n_near", F.when(F.col("form_id").isNotNull(), F.col("near_n")).alias("form_n")
    )


def query(docs: DataFrame) -> DataFrame:
    return grouped(stored(word_counts(docs), "words"))
