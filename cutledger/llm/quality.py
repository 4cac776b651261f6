"""Quality by nearest neighbours among labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import text_of
from cutledger.llm.shingles import mixed, word_hashes

#: Labelled texts kept per label (chosen by a hash of the id), dimensions, neighbours that vote.
SAMPLE, RANK, NEIGHBOURS = 1000, 48, 25
#: A neighbour's vote is its similarity to this power.
SHARPNESS = 8
#: Documents multiplied with all labelled vectors at once.
BLOCK = 256

#: Kinds of bytes whose runs of three are terms: fixed values.
_KINDS = np.full(256, 14, np.uint8)
for _kind, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"#$%&*", b"|<>", b"'\"`", b"()[]{}", b"-_=+/\\@^~"]):
    _KINDS[list(_bytes)] = _kind
_KINDS[0x80:0xC0], _KINDS[0xC0:] = 12, 13
_TRIGRAMS, _WORDS, _AGAIN = 16**3, 1024, 2
#: Repetition is two terms among thousands; it weighs this much more.
_STRESS = 4.0
TERMS = _TRIGRAMS + _WORDS + _AGAIN


def counts_of(text: bytes) -> np.ndarray:
    """How often each term occurs: runs of three kinds of bytes, words by hash, words that come
    right again, and words that came before."""
    out = np.zeros(TERMS)
    for at in range(0, max(len(text) - 2, 0), 1 << 20):
        k = _KINDS[np.frombuffer(text, np.uint8, min(len(text) - at, (1 << 20) + 2), at)].astype(np.int32)
        out[:_TRIGRAMS] += np.bincount(k[:-2] * 256 + k[1:-1] * 16 + k[2:], minlength=_TRIGRAMS)
    words = word_hashes(text.lower())
    if len(words):
        out[_TRIGRAMS : _TRIGRAMS + _WORDS] = np.bincount((mixed(words) & np.uint64(_WORDS - 1)).astype(np.int64), minlength=_WORDS)
        out[-_AGAIN:] = (words[1:] == words[:-1]).sum(), len(words) - len(np.unique(words))
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


@dataclass
class Model:
    """weights: of the terms; space: terms to dimensions; vectors: of the labelled texts, of length
    one; labels: theirs; worth: what a vote of each counts, so that labels weigh as in the corpus."""

    weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    worth: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        v = damped(counts) * self.weights
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) @ self.space
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the nearest labelled texts; of all, where none is near."""
        prior = float((self.worth * self.labels).sum() / self.worth.sum()) if len(self.labels) else 0.5
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(counts), prior)
        near = self.place(counts) @ self.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** SHARPNESS * self.worth[top]
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300), prior).clip(0, 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        counts = [counts_of(x.as_py()) for x in texts]
        used = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([u.astype("<i4").tobytes() for u in used], pa.binary()), pa.array([c[u].astype("<f4").tobytes() for c, u in zip(counts, used, strict=True)], pa.binary()), batch.column(2)],
            names=["id", "terms", "counts", "label"],
        )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """From `docs` (id, text) and `labels` (id, label: 0 or 1; null: none).

    At most about `sample` ids per label are chosen by hash; only their texts are read, and only
    their term counts come to the driver. An id with several labels counts as 1 if at least half
    of them are. Term weights are inverse document frequencies; the space is spanned by the
    leading right singular vectors of the weighted counts.
    """
    once = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    chosen = once.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * share)
    found = docs.join(F.broadcast(chosen), "id").select("id", text_of("text").alias("text"), "label")
    rows = found.mapInArrow(_count, "id bigint, terms binary, counts binary, label int").collect()
    rows.sort(key=lambda r: (r["id"], r["terms"], r["counts"]))
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["terms"], "<i4")] = np.frombuffer(r["counts"], "<f4")
    label = np.array([r["label"] for r in rows], int)
    if not len(rows):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), label, np.zeros(0))
    weights = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    weights[-_AGAIN:] *= _STRESS
    x = damped(counts) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    values, left = np.linalg.eigh((x @ x.T).astype(float))
    lead = np.argsort(-values)[: min(rank, len(rows))]
    lead = lead[values[lead] > 1e-9] if (values[lead] > 1e-9).any() else lead[:1]
    space = x.T @ (left[:, lead] / np.sqrt(np.maximum(values[lead], 1e-9)))
    model = Model(weights, space, np.zeros(0), label, np.array([sizes[x] / max(1, (label == x).sum()) for x in label], float))
    model.vectors = model.place(counts)
    return model


def _score(model: Model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, scores = batch.column(1).cast(pa.binary()), []
        for at in range(0, len(texts), BLOCK):
            scores.append(model.score(np.stack([counts_of(x.as_py()) for x in texts.slice(at, BLOCK)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row and its whole text; a null or empty text, which has no
    terms, gets the share of label 1. The labelled vectors travel with the tasks: their number and
    size are bounded by SAMPLE and RANK."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_score, model), "doc_id bigint, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = labels.where(~held_out).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = learn(docs.select(F.col("doc_id").alias("id"), "text"), known)
    got = score(docs, model)
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
