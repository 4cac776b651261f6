"""Fingerprints, similarity and near-duplicate search over images and vectors.

Numpy runs inside Arrow batches; Spark partitions and shuffles the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cutledger.operators import ordered
from cutledger.operators.qc import hamming
from cutledger.schema import POSITIONS
from cutledger.session import materialize

K = ["show_id", "cut_id"]
SHOT = [*K, "tcid"]
WORDS = ["h_start", "h_mid", "h_end"]


# --- image fingerprints ----------------------------------------------------------------------


@lru_cache(maxsize=256)
def _area_weights(n_in: int, n_out: int) -> np.ndarray:
    """Rows of an area-average resize from n_in to n_out cells."""
    edges = np.linspace(0, n_in, n_out + 1)
    cells = np.arange(n_in)
    cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    cover = np.clip(cover, 0, None)
    return cover / cover.sum(1, keepdims=True)


def _resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    tall = np.tensordot(_area_weights(a.shape[0], h), a, axes=(1, 0))
    return np.moveaxis(np.tensordot(tall, _area_weights(a.shape[1], w), axes=(1, 1)), -1, 1)


def _dct_rows(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2.0 / n)
    m[0] /= np.sqrt(2.0)
    return m


def _word(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(bool).ravel()).view(">i8")[0])


def _decode(row) -> np.ndarray:
    """BGR pixels of one image-source struct."""
    px = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return (px if px.shape[2] >= 3 else np.repeat(px, 3, 2))[:, :, :3].astype(np.float64)


def _gray(bgr: np.ndarray) -> np.ndarray:
    return bgr @ np.array([0.114, 0.587, 0.299])


#: Pictures that a task turns to arrays, and hands on, at once.
PICTURES = 64


def by_slices(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = PICTURES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInPandas for mapInArrow: it gets a few rows at a time, whatever an Arrow batch holds.

    A batch has thousands of pictures, and as Python objects they take several times its bytes.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (b.slice(i, rows).to_pandas() for b in batches for i in range(0, b.num_rows, rows))
        for pdf in run(few):
            yield pa.RecordBatch.from_pandas(pdf, kinds, preserve_index=False)

    return sliced


def image_features(images: DataFrame, crop_top: float = 0.0, top_keep: float = 0.74) -> DataFrame:
    """Per image: DCT hash, average hash, difference hash, colour layout, its deviation, row luma
    and a small gray picture.

    ``images``: show_id, cut_id, tcid, pos, image (a struct of the image source). Filter before
    calling: no predicate passes the decoding step.
    """
    dct = _dct_rows(32, 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for im in pdf["image"]:
                bgr = _decode(im)
                gray = _gray(bgr)
                h = gray.shape[0]
                band = slice(int(h * crop_top), max(int(h * top_keep), int(h * crop_top) + 1))
                block = dct @ _resize(gray[band], 32, 32) @ dct.T
                block[0, 0] = 0.0
                layout = _resize(bgr[band], 8, 8) / 255.0
                small = _resize(gray, 8, 8)
                wide = _resize(gray, 8, 9)
                out.append(
                    (
                        _word(block > np.median(block)),
                        _word(small > small.mean()),
                        _word(wide[:, :-1] > wide[:, 1:]),
                        layout.ravel().astype(np.float32).tolist(),
                        float(layout.std()),
                        gray.mean(1).tolist(),
                        np.clip(np.rint(_resize(gray, 108, 192)), 0, 255).astype(np.uint8).tobytes(),
                    )
                )
            cols = ["phash", "ahash", "dhash", "layout", "layout_std", "row_luma", "gray"]
            feats = pd.DataFrame(out, columns=cols, index=pdf.index)
            yield pd.concat([pdf.drop(columns="image"), feats], axis=1)

    schema = (
        "show_id bigint, cut_id bigint, tcid string, pos string, phash bigint, ahash bigint, dhash bigint,"
        " layout array<float>, layout_std double, row_luma array<double>, gray binary"
    )
    return images.select(*SHOT, "pos", "image").mapInArrow(by_slices(run, schema), schema)


def dark(std: list[Column]) -> Column:
    """Dark shot: mean deviation over the three positions below 0.06, a missing one counts zero."""
    return sum(F.coalesce(s, F.lit(0.0)) for s in std) / 3 < 0.06


def fingerprints(images: DataFrame, crop_top: float = 0.0, top_keep: float = 0.74) -> DataFrame:
    """Per shot: three hash words, colour layout of all positions, dark flag.

    A shot whose frames are all missing has no row here and so no fingerprint.
    """
    feats = image_features(images, crop_top, top_keep)
    wide = feats.groupBy(*SHOT).agg(
        *[F.max(F.when(F.col("pos") == p, F.struct("phash", "layout", "layout_std"))).alias(p) for p in POSITIONS]
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 192)
    return wide.select(
        *SHOT,
        *[F.coalesce(F.col(f"{p}.phash"), F.lit(0)).cast("bigint").alias(f"h_{p}") for p in POSITIONS],
        F.concat(*[F.coalesce(F.col(f"{p}.layout"), zeros) for p in POSITIONS]).alias("color"),
        dark([F.col(f"{p}.layout_std") for p in POSITIONS]).alias("dark"),
    )


def sampled(frames: DataFrame, sample: int = 80) -> DataFrame:
    """Every k-th frame of a cut, ``sample`` of them at most. Frames carry frame_pos from 0."""
    n = frames.groupBy(*K).agg(F.count("*").alias("_n"))
    rows = ordered.salted_lookup(frames, n, K, ["frame_pos"])
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / sample))
    rows = rows.withColumn("_step", step.cast("bigint"))
    kth = (F.col("frame_pos") % F.col("_step") == 0) & (F.floor(F.col("frame_pos") / F.col("_step")) < sample)
    return rows.filter((F.col("_n") <= sample) | kth).drop("_n", "_step")


def letterbox(row_luma: DataFrame, thr: float = 12.0, inset: int = 1) -> DataFrame:
    """Active picture rows of a cut from the row means of all its frames.

    ``row_luma``: show_id, cut_id, row_luma array<double>. The largest mean of each row combines
    before the shuffle, so all frames cost one pass; ``sampled`` picks some first where that is meant.
    """
    per_row = row_luma.select(*K, F.posexplode("row_luma").alias("y", "luma")).groupBy(*K, "y").agg(F.max("luma").alias("luma"))
    got = per_row.groupBy(*K).agg(
        F.max("y").alias("_h1"),
        F.min(F.when(F.col("luma") > thr, F.col("y"))).alias("_top"),
        F.max(F.when(F.col("luma") > thr, F.col("y"))).alias("_bot"),
    )
    top = F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.least(F.col("_top") + inset, F.col("_h1")))
    return got.withColumn("top", top.cast("bigint")).select(
        *K,
        "top",
        F.when(F.col("_bot").isNull(), F.col("_h1"))
        .otherwise(F.greatest(F.col("_bot") - inset, F.col("top")))
        .cast("bigint")
        .alias("bottom"),
    )


def tiles(images: DataFrame, grid: DataFrame, crop: DataFrame) -> DataFrame:
    """Cropped thumbnails resized to their grid cells. ``grid``: tcid, x0, y0, x1, y1."""
    placed = images.join(grid, SHOT).join(crop, K, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for im, top, bot, w, h in zip(
                pdf["image"], pdf["top"], pdf["bottom"], pdf["x1"] - pdf["x0"], pdf["y1"] - pdf["y0"]
            ):
                bgr = _decode(im)
                if top == top and bot == bot:
                    bgr = bgr[int(top) : int(bot) + 1]
                data.append(np.rint(_resize(bgr, int(h), int(w))).astype(np.uint8).tobytes())
            keep = [*SHOT, "x0", "y0", "x1", "y1"]
            yield pdf[keep].assign(pixels=data)

    schema = "show_id bigint, cut_id bigint, tcid string, x0 bigint, y0 bigint, x1 bigint, y1 bigint, pixels binary"
    return placed.select(*SHOT, "x0", "y0", "x1", "y1", "top", "bottom", "image").mapInArrow(by_slices(run, schema), schema)


def gray_differences(grays: DataFrame) -> DataFrame:
    """Mean absolute gray differences of a shot: to the previous shot, start-mid and mid-end.

    ``grays``: show_id, cut_id, tcid, seq, g_start, g_mid, g_end (binary, null if missing). They are
    stored first, since the search for the previous shot reads them twice and each picture behind
    them would be opened and decoded as often.
    """
    grays = materialize(grays.select(*SHOT, "seq", "g_start", "g_mid", "g_end"))
    near = ordered.neighbour(grays, K, ["seq"], ["g_end"], "_p")

    def mad(a: bytes | None, b: bytes | None) -> float | None:
        if a is None or b is None:
            return None
        x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
        return float(np.abs(x - y).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = {
                "d_prev": [mad(a, b) for a, b in zip(pdf["p_end"], pdf["g_start"])],
                "d_startmid": [mad(a, b) for a, b in zip(pdf["g_start"], pdf["g_mid"])],
                "d_midend": [mad(a, b) for a, b in zip(pdf["g_mid"], pdf["g_end"])],
            }
            yield pd.concat([pdf[SHOT], pd.DataFrame(got, index=pdf.index, dtype="float64")], axis=1)

    cols = [*SHOT, "g_start", "g_mid", "g_end", F.col("_p.g_end").alias("p_end")]
    schema = "show_id bigint, cut_id bigint, tcid string, d_prev double, d_startmid double, d_midend double"
    return near.select(*cols).mapInArrow(by_slices(run, schema), schema)


# --- similarity ------------------------------------------------------------------------------


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two numeric arrays in double; a zero norm counts as one."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    def norm(x: Column) -> Column:
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    return dot(a, b) / (norm(a) * norm(b))


def hash_similarity(aa: Column, ab: Column, da: Column, db: Column) -> Column:
    """Half average-hash and half difference-hash agreement."""
    return 0.5 * (1 - hamming(aa, ab) / 64.0) + 0.5 * (1 - hamming(da, db) / 64.0)


#: Later than any rank; centres of blocks that travel together; blocks of a first look.
FREE, CENTRES, LOOKS = 1 << 62, 1024, 4


def _vector_blocks(side: DataFrame, group: list[str], size: int, cols: dict[str, Column], name: str) -> DataFrame:
    """Vectors of a group in rows of at most ``size``, those that look alike together.

    A code of which component exceeds the next puts them in order; groups of any size spread. One
    that is no larger than a block is one, and its vectors move once.
    """
    each = F.collect_list(F.struct("id", "pos", "vec", *cols)).alias(f"_v{name}")
    side = side.select(*group, "id", "pos", "vec", *(c.alias(n) for n, c in cols.items()))
    large = materialize(side.groupBy(*group).count().filter(F.col("count") > size).select(*group))
    whole = lambda rows: rows.groupBy(*group, F.lit(0).cast("bigint").alias(f"_b{name}")).agg(each)
    if large.isEmpty():
        return whole(side)
    code = F.expr("aggregate(transform(slice(vec, 1, 16), (x, i) -> IF(x > coalesce(get(vec, i + 1), 0), shiftleft(1, 15 - i), 0)), 0, (a, b) -> a + b)")
    rows = side.join(large, group, "left_semi").withColumn("_code", code.cast("bigint"))
    numbered = ordered.ordinal(rows, group, ["_code", "pos"], "_n", blocks=[F.floor(F.col("_code") / 256)])
    blk = F.floor((F.col("_n") - 1) / size).cast("bigint")
    return numbered.groupBy(*group, blk.alias(f"_b{name}")).agg(each).unionByName(whole(side.join(large, group, "left_anti")))


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v["vec"], np.float64) for v in vectors])
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def _centres(blocks: DataFrame, group: list[str]) -> DataFrame:
    """The centre of every block and how far its vectors lie from it, CENTRES blocks to a row."""
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *g, blk, vs in pdf[[*group, "_bb", "_vb"]].itertuples(index=False, name=None):
                u = _unit(vs)
                c = u.mean(0)
                out.append((*g, blk, c.tolist(), float(np.sqrt(((u - c) ** 2).sum(1).max()))))
            yield pd.DataFrame(out, columns=[*group, "_bb", "centre", "radius"])

    schema = ", ".join([f"{g} {kinds[g]}" for g in group] + ["_bb bigint", "centre array<double>", "radius double"])
    each = blocks.select(*group, "_bb", "_vb").mapInPandas(run, schema)
    pack = F.floor(F.col("_bb") / CENTRES)
    return each.groupBy(*group, pack.alias("_pack")).agg(F.collect_list(F.struct("_bb", "centre", "radius")).alias("_c"))


def _scored(va, vb, sims: np.ndarray) -> np.ndarray:
    """Scores of two blocks; what an earlier proposer holds is out of reach."""
    since = np.array([v["since"] for v in va], np.int64)
    until = np.array([v["until"] for v in vb], np.int64)
    return np.where(until[None, :] > since[:, None], np.round(sims, 12), -np.inf)


def top_similar(
    new: DataFrame, master: DataFrame, group: list[str], k: int, block: int = 1024, floor: float | None = None, tallies: list | None = None
) -> DataFrame:
    """The ``k`` most similar items of every proposer, best first, ties to the first item.

    Both sides: group, id, pos, vec. Optional: ``k`` of a proposer in its place; ``since`` of a
    proposer and ``until`` of an item, which meet only where until > since (null: always).

    The pairs are never rows, and few blocks meet. A first look multiplies each block of proposers
    with the LOOKS blocks of items whose centres most of them are nearest to, and notes each
    proposer's k-th score there. By
    Cauchy-Schwarz no vector of a block scores more than the block's centre plus its radius, so a
    block whose bound is below the k-th score of all proposers of a block is skipped; only the
    others' vectors move. ``tallies`` gets (pairs of blocks that met, all pairs of blocks).
    """
    has = {c: c in side.columns for side, cs in ((new, ("k", "since")), (master, ("until",))) for c in cs}
    a_cols = {"k": F.col("k").cast("int") if has["k"] else F.lit(k), "since": F.coalesce("since", F.lit(0)).cast("bigint") if has["since"] else F.lit(0).cast("bigint")}
    b_cols = {"until": F.coalesce("until", F.lit(FREE)).cast("bigint") if has["until"] else F.lit(FREE).cast("bigint")}
    a = materialize(_vector_blocks(new, group, block, a_cols, "a"))
    b = materialize(_vector_blocks(master, group, block, b_cols, "b"))
    kinds = dict(new.dtypes) | {"item": dict(master.dtypes)["id"]}
    keys = ", ".join(f"{g} {kinds[g]}" for g in group)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *g, ba, va, cs in pdf.itertuples(index=False, name=None):
                near = _unit(va) @ np.array([c["centre"] for c in cs]).T
                votes = np.bincount(near.argmax(1), np.maximum(near.max(1), 1e-9), len(cs))
                out.extend((*g, ba, cs[int(j)]["_bb"], float(votes[j])) for j in np.argsort(-votes)[:LOOKS] if votes[j] > 0)
            yield pd.DataFrame(out, columns=[*group, "_ba", "_bb", "near"])

    def kth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *g, ba, va, vb in pdf.itertuples(index=False, name=None):
                s = -np.sort(-_scored(va, vb, _unit(va) @ _unit(vb).T), axis=1)
                out.append((*g, ba, [float(s[i, v["k"] - 1]) if v["k"] <= s.shape[1] else -np.inf for i, v in enumerate(va)]))
            yield pd.DataFrame(out, columns=[*group, "_ba", "low"])

    def open_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *g, ba, va, low, cs in pdf.itertuples(index=False, name=None):
                bound = _unit(va) @ np.array([c["centre"] for c in cs]).T + np.array([c["radius"] for c in cs]) + 1e-9
                wanted = (bound >= np.maximum(np.array(low), -np.inf if floor is None else floor)[:, None]).any(0)
                out.extend((*g, ba, c["_bb"]) for c, w in zip(cs, wanted) if w)
            yield pd.DataFrame(out, columns=[*group, "_ba", "_bb"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *g, va, low, vb in pdf.itertuples(index=False, name=None):
                s = _scored(va, vb, _unit(va) @ _unit(vb).T)
                pos_b, out = np.array([v["pos"] for v in vb]), []
                least = np.maximum(np.full(len(va), -np.inf) if low is None else np.array(low), -np.finfo(float).max if floor is None else floor)
                for i, v in enumerate(va):
                    hit = np.flatnonzero(s[i] >= least[i])
                    if len(hit) > v["k"]:
                        hit = hit[s[i, hit] >= -np.partition(-s[i, hit], v["k"] - 1)[v["k"] - 1]]
                    for j in hit[np.lexsort((pos_b[hit], -s[i, hit]))[: v["k"]]]:
                        out.append((*g, v["id"], vb[j]["id"], pos_b[j], float(s[i, j]), v["k"]))
                yield pd.DataFrame(out, columns=[*group, "proposer", "item", "item_pos", "score", "k"])

    every = a.select(*group, "_ba").join(b.select(*group, "_bb"), group)
    if (b.agg(F.max("_bb")).first()[0] or 0) < LOOKS:
        # A first look would multiply all blocks; they are multiplied once.
        noted, ids = a.withColumn("low", F.lit(None).cast("array<double>")), every
    else:
        centres = materialize(_centres(b, group))
        met = a.join(centres, group).select(*group, "_ba", "_va", "_c").mapInPandas(nearest, f"{keys}, _ba bigint, _bb bigint, near double")
        w = Window.partitionBy(*group, "_ba").orderBy(F.desc("near"), "_bb")
        first = met.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= LOOKS).select(*group, "_ba", "_bb")
        pair = lambda ids: ids.join(a, [*group, "_ba"]).join(b, [*group, "_bb"])
        seen = pair(first).select(*group, "_ba", "_va", "_vb").mapInPandas(kth, f"{keys}, _ba bigint, low array<double>")
        highest = F.reduce(F.collect_list("low"), F.array().cast("array<double>"), lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(F.coalesce(p, q), q)))
        lows = materialize(seen.groupBy(*group, "_ba").agg(highest.alias("low")))
        noted = a.join(lows, [*group, "_ba"])
        ids = noted.join(centres, group).select(*group, "_ba", "_va", "low", "_c").mapInPandas(open_blocks, f"{keys}, _ba bigint, _bb bigint")
        ids = materialize(ids)
    if tallies is not None:
        tallies.append((ids.count(), every.count()))
    work = ids.join(noted, [*group, "_ba"]).join(b, [*group, "_bb"])
    schema = f"{keys}, proposer {kinds['id']}, item {kinds['item']}, item_pos bigint, score double, k int"
    pairs = work.select(*group, "_va", "low", "_vb").mapInPandas(best, schema)
    w = Window.partitionBy(*group, "proposer").orderBy(F.desc("score"), "item_pos")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k")).drop("k")


# --- near duplicates over the library --------------------------------------------------------


def _bits(words: list[str], lo: int, hi: int) -> Column:
    """Bits lo..hi-1 of the concatenated hash words as one number."""
    got, at = F.lit(0).cast("bigint"), lo
    while at < hi:
        w, off = divmod(at, 64)
        n = min(hi - at, 64 - off)
        piece = F.shiftrightunsigned(F.col(words[w]), off).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
        got = got.bitwiseOR(F.shiftleft(piece, at - lo))
        at += n
    return got


def _edges(lo: int, hi: int, n: int) -> list[int]:
    return [lo + (hi - lo) * i // n for i in range(n + 1)]


def band_signatures(words: list[str], bits: int, bands: int) -> Column:
    """array<struct<band, value>>: two hashes within ``bands - 1`` bits share at least one."""
    e = _edges(0, bits, bands)
    return F.array(
        *[
            F.struct(F.lit(i).alias("band"), _bits(words, e[i], e[i + 1]).alias("value"), F.lit(0).cast("bigint").alias("sub"))
            for i in range(bands)
        ]
    )


def _cut_finer(words: list[str], bits: int, bands: int, schema: str):
    """Rows of crowded buckets, once per piece of the bits that their bucket does not yet agree in.

    ``path`` names the pieces agreed in so far; each cuts what was left into ``bands`` pieces.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def left(path: tuple[int, ...]) -> list[np.ndarray]:
        rest = np.arange(bits)
        for p in path:
            e = _edges(0, len(rest), bands)
            rest = np.concatenate([rest[: e[p]], rest[e[p + 1] :]])
        e = _edges(0, len(rest), bands)
        return [rest[e[j] : e[j + 1]] for j in range(bands)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, rows in pdf.groupby(pdf["path"].map(tuple), sort=False):
                flat = rows[words].to_numpy(np.int64).view(np.uint64)
                on = np.concatenate([(flat[:, [w]] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) for w in range(len(words))], axis=1).astype(np.uint8)
                for j, piece in enumerate(left(path)):
                    value = [x.tobytes() for x in np.packbits(on[:, piece], axis=1)]
                    yield rows.assign(path=[[*path, j]] * len(rows), value=value)[names]

    return run


def distance(words: list[str], left: str, right: str) -> Column:
    return sum(hamming(F.col(f"{left}.{w}"), F.col(f"{right}.{w}")) for w in words)


def close_pairs(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    words: list[str],
    max_bits: int,
    same_side: bool = False,
    crowd: int = 512,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of distinct hashes within ``max_bits`` of each other inside a group; exact.

    Both sides: group, fid (unique in the group) and the hash words. Hashes meet that agree in a
    band. A bucket of more than ``crowd`` hashes is cut by what its members agree in besides: all
    other bits are cut into as many pieces again, and two hashes that are near agree in one of
    them. This goes on, bucket by bucket, for as long as it at least halves the pairs to compare;
    what then is still crowded is a crowd of hashes near each other. Returns group, a, b, bits; a
    and b are structs of fid, words and ``carry``.
    """
    bits, bands = 64 * len(words), max_bits + 1
    cols = [*group, "fid", *words, *carry]
    sides = [left] if same_side else [left, right]
    marked = [d.select(*cols, F.lit(i).alias("side")) for i, d in enumerate(sides)]
    rows = reduce(DataFrame.unionByName, marked).withColumn("_s", F.explode(band_signatures(words, bits, bands)))
    rows = rows.select(*cols, "side", F.array("_s.band").alias("path"), F.xxhash64("_s.band", "_s.value").alias("sub"))
    key, settled = [*group, "sub"], []
    out = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + ["value binary"])
    while True:
        rows = materialize(rows)
        counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
        crowded = materialize(counts.filter(F.col("n") > crowd))
        settled.append(rows.join(crowded, key, "left_anti"))
        if crowded.isEmpty():
            break
        hot = materialize(rows.join(crowded.select(*key), key, "left_semi"))
        finer = hot.mapInPandas(_cut_finer(words, bits, bands, out), out)
        finer = materialize(finer.withColumnRenamed("sub", "was").withColumn("sub", F.xxhash64("was", "path", "value")).drop("value"))
        sizes = finer.groupBy(*group, "was", "sub").agg(F.count("*").alias("m")).groupBy(*group, "was").agg(F.sum(F.col("m") * F.col("m")).alias("after"))
        pays = crowded.join(sizes.withColumnRenamed("was", "sub"), key).filter(2 * F.col("after") <= F.col("n") * F.col("n")).select(*key)
        pays = materialize(pays)
        settled.append(hot.join(pays, key, "left_anti"))
        rows = finer.join(pays.withColumnRenamed("sub", "was"), [*group, "was"], "left_semi").drop("was")
    spread = materialize(reduce(DataFrame.unionByName, settled).select(*key, "side", F.struct("fid", *words, *carry).alias("v")))
    a = spread.filter(F.col("side") == 0).select(*key, F.col("v").alias("a"))
    b = spread.filter(F.col("side") == len(sides) - 1).select(*key, F.col("v").alias("b"))
    met = a.join(b, key)
    if same_side:
        met = met.filter(F.col("a.fid") < F.col("b.fid"))
    near = met.withColumn("bits", distance(words, "a", "b")).filter(F.col("bits") <= max_bits)
    return near.select(*group, "a", "b", "bits").dropDuplicates([*group, "a", "b"])


def copies(fp: DataFrame, group: list[str], words: list[str] = WORDS) -> DataFrame:
    """Distinct hashes of a group: the first shot holding it as id, and how many do."""
    return fp.groupBy(*group, *words).agg(F.count("*").alias("n"), F.min("shot").alias("fid"))


def near_duplicates(fp: DataFrame, max_bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate search over a whole library.

    ``fp``: shot (a sortable key), h_start, h_mid, h_end. Exact copies fold into one hash first:
    the first table maps every shot to its hash, the second pairs distinct hashes by distance
    with the number of shots behind each, so copies never multiply into pairs. The distinct hashes
    are stored, so that one that very many shots share is split where these meet it.
    """
    base = fp.withColumn("library", F.lit(0))
    one = materialize(copies(base, ["library"]))
    members = fp.join(one.select("fid", *WORDS), WORDS).select("shot", "fid")
    pairs = close_pairs(one, one, ["library"], WORDS, max_bits, same_side=True, carry=("n",))
    return members, pairs.select(
        F.col("a.fid").alias("a_shot"),
        F.col("b.fid").alias("b_shot"),
        F.col("a.n").alias("a_n"),
        F.col("b.n").alias("b_n"),
        "bits",
    )
