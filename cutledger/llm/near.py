"""Near-duplicate documents: MinHash bands find candidates, odd sketches verify them, full sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import KEY, keyed, packed, stored, text_of, without
from cutledger.llm.components import components
from cutledger.llm.shingles import mixed, shingle_set, similar

PERCENT = 75
#: At the least similarity a pair misses all bands with probability (1 - 0.75^4)^32 < 1e-5.
BANDS, ROWS = 32, 4
#: MinHash samples for the sketch: the smallest hash in each of so many ranges of the hash.
SAMPLES, BITS = 1024, 2048
#: Standard deviations by which an estimate must clear the threshold to count as beyond it.
SIGMA = 5
#: Members of a bucket compared in one task; larger buckets are cut into parts of about half.
CROWD = 2048

_RNG = np.random.default_rng(75)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "_row_key bigint, id bigint, n_shingles bigint, digest binary, bands array<bigint>, n_samples int, sketch binary"


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A key per band: the minima of its four hash functions over the whole set, folded."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[None, i : i + 2048] ^ _XOR) * _ODD).min(axis=1, keepdims=True))
    folded = (mixed(least.reshape(BANDS, ROWS)) * _FOLD).sum(axis=1, dtype=np.uint64)
    return mixed(folded + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch_of(shingles: np.ndarray) -> tuple[int, bytes]:
    """The samples' number and their parity bitmap: a bit is set if an odd number of samples fall on it."""
    bins = shingles >> np.uint64(64 - SAMPLES.bit_length() + 1)
    samples = shingles[np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))]
    at = (mixed(samples ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(BITS - 1)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: the size and digest of its set, its bands and its sketch."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _SIGNED.split(", ")]
    for batch in batches:
        keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        rows = []
        for i, text in enumerate(texts):
            s = shingle_set(text.as_py())
            if len(s):
                rows.append((keys[i], ids[i], len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands_of(s), *sketch_of(s)))
            else:
                rows.append((keys[i], ids[i], 0, None, None, None, None))
            if len(rows) == 1000 or i + 1 == len(texts):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []


class _Bucket:
    """The members of one bucket, compared by their sketches."""

    def __init__(self, keys, sizes, samples, sketches, parts):
        self.keys, self.parts = keys, parts
        self.sizes, self.samples = sizes.astype(float), samples.astype(float)
        self.bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(keys), -1)

    def compare(self, p: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of p and each other: may they be similar, are they so beyond doubt, and by how much."""
        odd = np.bitwise_count(self.bits[others] ^ self.bits[p]).sum(axis=1, dtype=np.int64)
        left = np.maximum(1 - 2 * odd / BITS, 1e-3)
        apart = -BITS / 2 * np.log(left)  # samples in one set only
        both = (self.samples[others] + self.samples[p] - apart) / 2
        # What both would be, were the sets just similar enough.
        j = percent / 100
        union = (self.sizes[others] + self.sizes[p]) / (1 + j)
        bins = SAMPLES * -np.expm1(-union / SAMPLES)
        # Noise: of the samples drawn from the union, and of samples that fall on one bit.
        drawn = bins * j * (1 - j) * np.maximum(1 - bins / union, 0)
        expected = np.maximum(self.samples[others] + self.samples[p] - 2 * j * bins, 0)
        folded = BITS / 4 * -np.expm1(-4 * expected / BITS) - expected * np.exp(-4 * expected / BITS)
        slack = SIGMA * np.sqrt(drawn + folded * np.exp(4 * expected / BITS) / 4) + 1
        fits = np.minimum(self.sizes[others], self.sizes[p]) >= j * np.maximum(self.sizes[others], self.sizes[p])
        over = both - j * bins
        return fits & (over >= -slack), fits & (over >= slack), over

    def first(self, percent: int) -> Iterator[tuple[int, int]]:
        """Pairs to confirm first, fewer than there are members: a tree over each cluster of members
        similar beyond doubt, and from each cluster the pair with an earlier one that looks most so."""
        todo = np.arange(len(self.keys))
        best, who = np.full(len(self.keys), -np.inf), np.zeros(len(self.keys), int)
        while len(todo):
            queue, todo, cluster = [todo[0]], todo[1:], []
            while queue:
                p = queue.pop()
                cluster.append(p)
                if not len(todo):
                    continue
                may, sure, over = self.compare(p, todo, percent)
                yield from ((p, q) for q in todo[sure])
                better = may & ~sure & (over > best[todo])
                best[todo[better]], who[todo[better]] = over[better], p
                queue.extend(todo[sure])
                todo = todo[~sure]
            # What was noted from within the cluster is no pair with an earlier one.
            own = set(cluster)
            outside = [q for q in cluster if best[q] > -np.inf and who[q] not in own]
            if outside:
                q = max(outside, key=lambda q: best[q])
                yield who[q], q

    def apart(self, p: int, part: np.ndarray, percent: int) -> np.ndarray:
        """Later members that may be similar to p and belong to another part."""
        others = np.arange(p + 1, len(self.keys))
        others = others[part[others] != part[p]]
        return others[self.compare(p, others, percent)[0]] if len(others) else others


def _buckets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, whose rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        ids = table.column("bucket").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1]).to_batches()  # it may go on in the next batch
    if held:
        yield pa.Table.from_batches(held)


def _bucket(rows: pa.Table) -> _Bucket:
    key, size, samples, part = (rows.column(c).to_numpy() for c in ("rep", "n_shingles", "n_samples", "part"))
    return _Bucket(key, size, samples, rows.column("sketch").to_pylist(), part)


def _pairs_out(pairs: Iterator[tuple[int, int]], names: tuple[str, str], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    while found := list(islice(pairs, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=list(names))


def _trees(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: the pairs of each bucket to confirm first."""

    def pairs() -> Iterator[tuple[int, int]]:
        for rows in _buckets_of(batches):
            bucket = _bucket(rows)
            for p, q in bucket.first(percent):
                yield min(bucket.keys[p], bucket.keys[q]), max(bucket.keys[p], bucket.keys[q])

    yield from _pairs_out(pairs(), ("a", "b"))


def _open(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, rep: members that may be similar to one of another component."""

    def members() -> Iterator[tuple[int, int]]:
        for rows in _buckets_of(batches):
            bucket, wanted = _bucket(rows), np.zeros(rows.num_rows, bool)
            for p in range(rows.num_rows - 1):
                others = bucket.apart(p, bucket.parts, percent)
                wanted[others] = True
                wanted[p] |= len(others) > 0
            yield from ((rows.column("bucket")[0].as_py(), k) for k in bucket.keys[wanted])

    yield from _pairs_out(members(), ("bucket", "rep"))


def _settle(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: links on full sets that bring together components which meet in a bucket."""

    def links() -> Iterator[tuple[int, int]]:
        for rows in _buckets_of(batches):
            bucket, part = _bucket(rows), rows.column("part").to_numpy().copy()
            sets = [shingle_set(x.as_py().encode()) for x in rows.column("text")]
            for p in range(rows.num_rows - 1):
                for q in bucket.apart(p, part, percent):
                    if part[p] != part[q] and similar(sets[p], sets[q], percent):
                        part[part == part[q]] = part[p]
                        yield bucket.keys[p], bucket.keys[q]

    yield from _pairs_out(links(), ("a", "b"))


def _confirm(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: the pairs whose full sets are similar enough."""
    last, last_set = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(i) for i in range(4))
        linked = []
        for i, key in enumerate(a.to_pylist()):
            if key != last:
                last, last_set = key, shingle_set(ta[i].as_py().encode())
            linked.append(similar(last_set, shingle_set(tb[i].as_py().encode()), percent))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs` (which carries KEY): KEY, n_shingles, component_id, kept.

    Documents are linked when their sets of five-word shingles share at least `percent` hundredths
    of their union, and belong together when links lead from one to the other. The row with the
    smallest id (then key) of each component stays. A null or wordless text has no shingles and
    stands alone.

    Copies of one set fold to one representative first, so a group of copies of any size is one
    row from there on. Representatives meet where a band agrees; a crowded bucket is cut by hash
    into parts and every two parts meet, so no task holds more than CROWD members and no pair of a
    bucket is left out. Inside a bucket odd sketches rule out what is too far apart. A first pass
    confirms on full sets a tree per cluster; a second pass takes every pair of a bucket that may
    be similar and that the first did not bring together, and settles it on full sets where the
    bucket's members lie, so that only links leave the task. Only pairs within one component are
    never looked at.
    """
    rows = docs.select(KEY, F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    signed = stored(rows.mapInArrow(_sign, _SIGNED), "signatures")
    classes = stored(signed.where("n_shingles > 0").groupBy("digest").agg(F.min(KEY).alias("rep")), "classes")
    reps = signed.join(classes.select("rep"), F.col(KEY) == F.col("rep"), "left_semi").select(F.col(KEY).alias("rep"), "n_shingles", "n_samples", "sketch", "bands")
    reps = stored(reps, "representatives")
    buckets = stored(_buckets(reps), "buckets")
    sketched = stored(buckets.join(reps.drop("bands"), "rep"), "sketched")

    pairs = stored(_laid(sketched.withColumn("part", F.lit(0).cast("bigint"))).mapInArrow(partial(_trees, percent), "a bigint, b bigint").distinct(), "pairs")
    links = stored(_checked(pairs, rows, percent), "links")
    parts = components(links)
    labelled = stored(sketched.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component"), "labelled")
    several = labelled.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket")
    unsettled = stored(_laid(labelled.join(several, "bucket", "left_semi")).mapInArrow(partial(_open, percent), "bucket bigint, rep bigint"), "unsettled")
    if unsettled.limit(1).count():
        texts = unsettled.join(_texts(rows, unsettled.select("rep")), "rep").join(labelled, ["bucket", "rep"])
        more = stored(_laid(texts, "text").mapInArrow(partial(_settle, percent), "a bigint, b bigint"), "more-links")
        if more.limit(1).count():
            parts = components(links.unionByName(more))

    # Back to all rows: row -> representative -> component.
    member = signed.select(KEY, "id", "n_shingles", "digest").join(classes, "digest", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    member = stored(member.select(KEY, "id", "n_shingles", F.coalesce("component", "rep", KEY).alias("component")), "members")
    first = member.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(KEY).alias("key"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "firsts")  # so that the rows of a large component are split where they meet it
    return member.join(first, "component", "left").select(
        KEY,
        "n_shingles",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        F.coalesce(F.col("first.key") == F.col(KEY), F.lit(True)).alias("kept"),
    )


def _buckets(reps: DataFrame) -> DataFrame:
    """bucket, rep: representatives that share a band, once for each set of members."""
    met = reps.select(F.explode("bands").alias("band"), "rep")
    sizes = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(sizes, "band")
    count = F.expr(f"int(ceil(n / {CROWD // 2}))")
    at = F.pmod(F.xxhash64("rep"), F.when(count > 2, count).otherwise(1))
    met = met.withColumns({"parts": F.when(count > 2, count).otherwise(1), "at": at})
    two = F.explode(F.expr("transform(sequence(0, parts - 1), i -> struct(least(at, i) AS i, greatest(at, i) AS j))"))
    sets = met.select("band", "rep", two.alias("two")).groupBy("band", "two").agg(F.sort_array(F.collect_list("rep")).alias("members"))
    # Many bands bring the same members together; each such set is looked at once.
    once = sets.select("members").where(F.size("members") > 1).distinct()
    return once.select(F.xxhash64("members", F.reverse("members")).alias("bucket"), F.explode("members").alias("rep"))


def _laid(members: DataFrame, *more: str) -> DataFrame:
    """The members of each bucket side by side."""
    cols = ["bucket", "rep", "n_shingles", "n_samples", "sketch", "part", *more]
    return members.select(*cols).repartition("bucket").sortWithinPartitions("bucket", "rep")


def _texts(rows: DataFrame, keys: DataFrame, few: int = 200_000) -> DataFrame:
    """rep, text of the listed keys: up to `few` keys travel to the texts, else both are shuffled."""
    listed = stored(keys.distinct(), "wanted")
    small = F.broadcast(listed) if listed.count() <= few else listed
    return rows.select(F.col(KEY).alias("rep"), "text").join(small, "rep", "left_semi")


def _checked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on full sets."""
    texts = _texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return two.mapInArrow(partial(_confirm, percent), "a bigint, b bigint")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of every component; all columns stay as they are, whatever their names."""
    rows = keyed(docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id")
    dropped = decide(rows, "id").where(~F.col("kept"))
    return without(rows, dropped).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text"))
    return rows.select(KEY, "doc_id").join(decide(rows), KEY).select("doc_id", "n_shingles", "component_id", "kept")
