"""Fingerprints, real image files, near duplicates, similarity, walks, board plans."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutledger.operators import vision as V
from cutledger.operators import wall
from cutledger.sources.artifacts import scan_images

K = "show_id bigint, cut_id bigint"


def png(path, a):
    """An RGB array as a PNG file."""
    h, w, _ = a.shape
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h=60, w=80):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, (6, 8, 3))
    return np.kron(coarse, np.ones((h // 6, w // 8, 1))).astype(np.uint8)


def test_images_from_files(spark, tmp_path):
    base = f"{tmp_path}/show_id=1/cut_id=2"
    bright = np.clip(picture(1).astype(int) + 6, 0, 255).astype(np.uint8)
    for pos, img in (("start", picture(1)), ("mid", bright), ("end", picture(2))):
        png(f"{base}/thumbs/SHW_00000101-{pos}.png", img)
    png(f"{base}/frames/SHW_00000101-mid.png", picture(9))
    png(f"{base}/frames/SHW_00000202-mid.png", np.zeros((60, 80, 3), np.uint8))
    with open(f"{base}/frames/SHW_00000303-mid.png", "wb") as f:
        f.write(b"no image")
    images = scan_images(spark, str(tmp_path)).cache()
    assert sorted((r["tcid"], r["pos"]) for r in images.collect()) == [("00000101", "end"), ("00000101", "mid"), ("00000101", "start"), ("00000202", "mid")]
    fp = {r["tcid"]: r for r in V.fingerprints(images).collect()}
    a = fp["00000101"]
    near = bin((a["h_start"] ^ a["h_mid"]) & (2**64 - 1)).count("1")
    far = bin((a["h_start"] ^ a["h_end"]) & (2**64 - 1)).count("1")
    assert near <= 6 < far and len(a["color"]) == 576 and not a["dark"]
    assert fp["00000202"]["dark"] and fp["00000202"]["h_start"] == 0


def test_letterbox_and_tiles(spark):
    bars = [0.0] * 4 + [80.0] * 10 + [1.0] * 4
    rows = [(1, 1, i, bars if i else [0.0] * 18) for i in range(200)] + [(2, 1, 0, [1.0] * 18)]
    df = spark.createDataFrame(rows, f"{K}, frame_pos bigint, row_luma array<double>")
    assert {r["show_id"]: (r["top"], r["bottom"]) for r in V.letterbox(df).collect()} == {1: (5, 12), 2: (0, 17)}
    picked = sorted(r["frame_pos"] for r in V.sampled(df.filter("show_id = 1")).collect())
    assert picked == list(range(0, 160, 2))


@pytest.mark.parametrize("crowd", [2, 512])
def test_near_duplicates_lose_nothing(spark, crowd):
    """A small crowd limit sends most band values through the finer cut."""
    rng = random.Random(4)
    base = [[rng.getrandbits(64) for _ in range(3)] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(3)] ^= 1 << rng.randrange(64)
        rows.append((i, *[w - 2**64 if w >= 2**63 else w for w in words]))
    df = spark.createDataFrame(rows, "shot bigint, h_start bigint, h_mid bigint, h_end bigint")
    one = V.copies(df.withColumn("g", F.lit(0)), ["g"])
    got = {(r["a"]["fid"], r["b"]["fid"], r["bits"]) for r in V.close_pairs(one, one, ["g"], V.WORDS, 12, True, crowd).collect()}
    first = {}
    for r in rows:
        first.setdefault(r[1:], r[0])
    dist = lambda x, y: sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y))
    want = {(a, b, dist(x, y)) for x, a in first.items() for y, b in first.items() if a < b and dist(x, y) <= 12}
    assert got == want and want
    members, _ = V.near_duplicates(df)
    assert {r["shot"]: r["fid"] for r in members.collect()} == {r[0]: first[r[1:]] for r in rows}


def test_top_similar_over_blocks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(23, 6)), rng.normal(size=(31, 6))
    b[7] = b[3]
    schema = "g bigint, id bigint, pos bigint, vec array<double>"
    da = spark.createDataFrame([(1, i, i, v.tolist()) for i, v in enumerate(a)], schema)
    db = spark.createDataFrame([(1, i, i, v.tolist()) for i, v in enumerate(b)], schema)
    s = ((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T).round(12)
    want = {i: [int(j) for j in np.lexsort((np.arange(31), -s[i]))[:4]] for i in range(23)}
    got = {}
    for r in sorted(V.top_similar(da, db, ["g"], 4, block=8).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["proposer"], []).append(r["item"])
    assert got == want


def test_gray_differences(spark):
    g = lambda v: bytes([v] * 20)
    df = spark.createDataFrame([(1, 1, "a", 1, g(10), g(12), g(40)), (1, 1, "b", 2, g(45), None, g(0))], f"{K}, tcid string, seq bigint, g_start binary, g_mid binary, g_end binary")
    got = {r["tcid"]: (r["d_prev"], r["d_startmid"], r["d_midend"]) for r in V.gray_differences(df).collect()}
    assert got == {"a": (None, 2.0, 28.0), "b": (5.0, None, None)}


@pytest.mark.parametrize("block", [4, 4096])
def test_walk(spark, block):
    rng = np.random.default_rng(8)
    cuts = {c: rng.normal(size=(n, 3)) + [1, 0, 0] for c, n in ((1, 19), (2, 6))}
    cuts[1][5] = 0
    rows = [(1, c, f"s{i}", i, v.tolist()) for c, vs in cuts.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, f"{K}, code string, order bigint, vec array<double>")
    want = {}
    for c, vs in cuts.items():
        col, cur = 0, []
        for i, v in enumerate(vs):
            if cur:
                m = np.mean(cur, axis=0)
                if m @ v / ((np.linalg.norm(m) or 1) * (np.linalg.norm(v) or 1)) < 0.6:
                    col, cur = col + 1, []
            cur.append(v)
            want[c, i] = col
    assert {(r["cut_id"], r["order"]): r["column"] for r in wall.walk(df, 0.6, block).collect()} == want


def board(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "show_id bigint, code string, tc string, status string, label string, thumbnail string")


def test_board_plans(spark):
    rows = [("b", "00:00:01:00", "VFX", "B", '=IMAGE("https://x/b.jpg")'), ("a", "00:00:01:00", "Online", "A", "http://x/a.jpg"), ("c", "", "", "C", "http://x/c.jpg"), ("d", "00:00:00;12", "Omit", "D", "")]
    shots = wall.order(wall.usable(board(spark, rows))).cache()
    assert [r["code"] for r in shots.orderBy("order").collect()] == ["a", "b", "c"]
    empty = spark.createDataFrame([], "show_id bigint, code string, frame_id string, image_id string, group_id string, order bigint, title_now string, status string")
    plan = {r["code"]: (r["x"], r["y"], r["staged"], r["colour"]) for r in wall.push_plan(shots, empty).collect()}
    assert plan == {"a": (-1700, -400, False, "#FFE0B2"), "b": (-1360, -400, False, "#D6E4FF"), "c": (-1020, -400, False, "#E9E9E9")}
    state = spark.createDataFrame([(1, "a", "f1", "i1", "g1", 0, "old", "Online"), (1, "z", "f2", "i2", None, 12, "Z", "VFX"), (1, "y", "f3", "i3", "g3", 1, "Y", "")], empty.schema)
    plan = {r["code"]: (r["x"], r["y"], r["staged"]) for r in wall.push_plan(shots, state).collect()}
    assert plan == {"b": (-1700, -400 + 4 * 310, True), "c": (-1360, -400 + 4 * 310, True)}
    acts = sorted((r["code"], r["action"]) for r in wall.resync(shots, state).collect())
    assert acts == [("a", "rename"), ("b", "new"), ("c", "new"), ("y", "missing"), ("z", "missing")]
    groups = spark.createDataFrame([(1, "g1", "f1"), (1, "g1", "i1"), (1, "g3", "f3")], "show_id bigint, group_id string, item string")
    assert {r["code"]: r["verdict"] for r in wall.verify(state, groups).collect()} == {"a": "ok", "y": "bad", "z": "no-group"}


def test_walk_carries_over_blocks_without_rows_and_columns_have_no_gaps(spark):
    v = [(1, 1, str(o), o, [1.0, 0.0] if o % 2 else [0.0, 1.0]) for o in (0, 1, 4, 5)]
    df = spark.createDataFrame(v, "show_id bigint, cut_id bigint, code string, order bigint, vec array<double>")
    for block in (2, 100):
        assert sorted((r["order"], r["column"]) for r in wall.walk(df, 0.75, block).collect()) == [(0, 0), (1, 1), (4, 2), (5, 3)]


def test_pictures_are_taken_from_a_batch_a_few_at_a_time(spark):
    import pyarrow as pa

    seen = []

    def run(batches):
        for pdf in batches:
            seen.append(len(pdf))
            yield pdf

    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(1000), pa.int64()), "v": [[1.0]] * 1000})
    got = list(V.by_slices(run, "n bigint, v array<double>")(iter([batch])))
    assert max(seen) <= V.PICTURES and [x for b in got for x in b["n"].to_pylist()] == list(range(1000))
    for name in ("image_features", "tiles", "gray_differences"):
        assert "mapInPandas" not in getattr(V, name).__code__.co_names


def test_gray_differences_make_their_pictures_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    schema = f"{K}, tcid string, seq bigint, g_start binary, g_mid binary, g_end binary"
    df = spark.createDataFrame([(1, 1, f"{i:02d}", i, bytes([i] * 4), None, bytes([i + 1] * 4)) for i in range(12)], schema)
    got = {r["tcid"]: r["d_prev"] for r in V.gray_differences(df.mapInPandas(run, schema)).collect()}
    assert got == {"00": None} | {f"{i:02d}": 0.0 for i in range(1, 12)} and made.value == 12
