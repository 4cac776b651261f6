"""Encoding, token records and packing: exact round trips against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutledger.llm import pack, records, tokens
from cutledger.session import scratch_path

DOCS = "doc_id bigint, text string, start bigint, sequence_id string"
ENCODER = tokens.encoder(tokens.vocabulary_path())


def direct(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z\n\t.'s1é# 　\x00<|"), max_size=12), min_size=1, max_size=4))
def test_word_memory_never_changes_ids(texts):
    for x, got in zip(texts, ENCODER(texts), strict=True):
        assert np.frombuffer(got, ENCODER.dtype).tolist() == direct(x)


def test_the_string_of_a_special_token_is_one_id():
    (got,) = ENCODER(["a<|endoftext|>b"])
    assert np.frombuffer(got, ENCODER.dtype).tolist() == [64, 50256, 65]


def test_every_vocabulary_gives_its_own_ids():
    """A vocabulary that is written otherwise takes no shortcut."""
    from public_tokenizers import path

    own, plain = tokens.Encoder(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["It's a naïve señor, 12.5", "then then THEN\nthen", ""]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_memory_is_bounded():
    e = tokens.Encoder(tokens.vocabulary_path(), most=50)
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(30))
        assert np.frombuffer(e([text])[0], e.dtype).tolist() == direct(text)
        assert len(e.pieces) + len(e.words) <= 50


def rows():
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))
    out = [(i, text(rng.choice([0, 1, 3, 50, 400, 1500])), 5, "x") for i in range(150)]
    return [*out, (150, None, None, None), (151, "", 1, "y"), (152, "z" * 30_000, 1, "y"), (-4, "a\n\n b  <|endoftext|>", 2, "q")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


def test_records_hold_all_ids_in_order(spark, docs):
    files = records.write(docs, scratch_path(spark, "t"))
    got = {r.doc_id: r for r in records.read(files).collect()}
    at = 0
    for key, text, *_ in sorted(rows()):
        ids = [*direct(text or ""), 0]
        assert (got[key].start, got[key].n_tokens) == (at, len(ids)) and np.frombuffer(got[key].ids, "<u4").tolist() == ids
        at += len(ids)
    assert len(got) == len(rows())


def test_index_finds_records_in_any_order_and_broken_ones_are_seen(spark, docs):
    files = records.write(docs, scratch_path(spark, "t")).where("n_docs > 0").collect()
    name = files[0].path.removeprefix("file:")
    index = np.fromfile(name.removesuffix(".rec") + ".idx", "<u8")
    assert len(index) == files[0].n_docs
    with open(name, "rb") as f:
        for at in reversed(index.tolist()):
            f.seek(at)
            assert records.payload_at(f) is not None
    data = bytearray(open(name, "rb").read())
    data[14] ^= 1
    open(name, "wb").write(data)
    with open(name, "rb") as f, pytest.raises(ValueError):
        records.payload_at(f)


def test_single_records_through_the_index_in_any_order(spark, docs):
    files = records.write(docs, scratch_path(spark, "t"))
    whole = {r.doc_id: bytes(r.ids) for r in records.read(files).collect()}
    places = records.places(files)
    assert places.count() == len(rows())
    some = places.filter("number % 7 = 3").orderBy(F.desc("at"))
    got = records.fetch(some).collect()
    assert 0 < len(got) == some.count() and all(whole[r.doc_id] == bytes(r.ids) and 4 * r.n_tokens == len(r.ids) for r in got)
    orders = [[r.doc_id for r in records.shuffled(files, seed, 4).collect()] for seed in ("a", "a", "b")]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == sorted(whole)


def test_records_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "n", 0, ""), (1, "b", 0, ""), (1, "a", 0, ""), (1, "a", 0, "")], DOCS)
    got = sorted(records.read(records.write(df, scratch_path(spark, "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and [r.start for r in got] == [0, 2, 4, 6]


@pytest.mark.parametrize("fn", [lambda d: records.read(records.write(d, scratch_path(d.sparkSession, "t"))), pack.pack])
def test_empty_table(docs, fn):
    assert fn(docs.where("false")).collect() == []


def test_pieces_hold_each_id_once_and_fill_sequences(docs):
    by, seq = defaultdict(list), defaultdict(list)
    for r in pack.pack(docs).collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    total = 0
    for key, text, *_ in rows():
        ids, at = [*direct(text or ""), 0], 0
        for r in sorted(by[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(seq) <= total / 1024 * 1.03 + docs.rdd.getNumPartitions()


def test_differencing_brings_windows_close_and_their_number_rises():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 400))]
        dealt = pack.windows(sizes, 1024)
        sums = [sum(sizes[i] for i in w) for w in dealt]
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes))) and max(sums) <= 1024
        assert len(dealt) <= -(-sum(sizes) // 1024) + 1
    assert len(pack.windows([600, 600, 600], 1024)) == 3
    assert pack.windows([], 1024) == []


def test_rows_without_a_clash_of_names(docs):
    assert pack.pack(docs.withColumn("offset", F.lit("mine"))).columns[0] == "doc_id"
