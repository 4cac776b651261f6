"""Exact dedup, chat formatting, quality rules and mixing on small tables with every odd case."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cutledger.llm import chat, exact, mix, near, rules
from cutledger.llm.common import KEY, keyed

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine"))


def odd_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "x", "###", "|"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 9, 10, 30, 200])))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "é"]), len(text)))
    rows += [(i + 200, r[1].replace(" ", "  \n"), r[2], r[3], 0) for i, r in enumerate(rows[:30])]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n", "en", "a", 3), (303, "y " * 50_000, "en", "a", 100_000)]
    return rows


def test_exact_against_a_plain_loop(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(WHITE)].append(r)
    want = {}
    for key, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        for r in g:
            want[r[0]] = (best, len(g), r[0] == best, hashlib.sha256(key.encode()).hexdigest())
    got = exact.query(table(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_only_rows_that_another_agrees_with_are_picked_out(spark):
    """Whatever the number of keys: the filter holds back all but them and few others."""
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias(KEY), F.col("id").cast("string").alias("text"))
    got = exact.survivors(rows, rows.where(f"{KEY} % 10 = 0").select(KEY))
    assert got.where(f"{KEY} % 10 = 0").count() == n // 10 and got.count() < n // 10 + n // 5
    # A filter too small for its list lets more through, and still loses none.
    tight = exact.survivors(rows, rows.where(f"{KEY} % 3 = 0").select(KEY), chunks=1)
    assert tight.where(f"{KEY} % 3 = 0").count() == n // 3 and tight.columns == rows.columns


def test_what_is_hashed_on_a_real_table(spark, monkeypatch):
    sizes, plain = {}, exact.stored

    def stored(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(exact, "stored", stored)
    docs = [(i, f"text number {i} " + "x" * (i % 90), "en", "a", 0) for i in range(3000)] + [(5000 + i, "copy of one", "en", "a", 0) for i in range(40)]
    assert exact.query(table(spark, docs)).where("kept").count() == 3001
    assert sizes["lengths"] == 3040 and 40 <= sizes["hashed"] < 500


def test_a_hot_text_is_split_where_it_meets_its_group(spark):
    """Most rows are one text: the join back to it must not be one task."""
    conf = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.advisoryPartitionSizeInBytes": "1k", "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionFactor": "2"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        rows = [(i, "hot" if i % 20 else f"cold {i} " + str(i) * (i % 7), "en", "a", 0) for i in range(30_000)]
        rows += [(40_000 + r[0], r[1], "en", "a", 0) for r in rows if r[1] != "hot"]
        got = exact.decide(keyed(table(spark, rows).repartition(40)))
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(f"spark.sql.{k}")


@pytest.mark.parametrize("fn", [exact.dedup, rules.keep_good, mix.mixed, near.dedup])
def test_a_callers_columns_of_any_name_stay(spark, fn):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(30)), "en", "a", 0) for i in range(60)]
    df = table(spark, rows).withColumns({KEY: F.lit(77), "id": F.lit("i"), "row": F.lit(1), "a.b": F.lit(2), "_q_n_words": F.lit(3)})
    got = fn(df)
    assert got.columns == df.columns and got.where(f"{KEY} = 77 AND id = 'i' AND row = 1 AND `a.b` = 2 AND _q_n_words = 3").count() == got.count() > 0


@pytest.mark.parametrize("fn", [rules.keep_good, mix.mixed])
def test_null_ids_and_repeated_rows_stay(spark, fn):
    text = " ".join(f"word{k}" for k in range(30))
    df = table(spark, [(None, text, "en", "a", 0)] * 3 + [(1, text, None, None, 0)] * 2)
    got = fn(df).select("doc_id", "text").collect()
    assert {r.doc_id for r in got} == {None, 1} and all(r.text and r.text in text for r in got)


def test_exact_with_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "ab", "en", "s", 2), (None, "c", "en", "s", 1), (2, "d", "en", "s", 1)]
    got = sorted(map(tuple, exact.dedup(table(spark, rows)).select("doc_id", "text").collect()), key=str)
    assert got == [(1, "a b"), (2, "d"), (None, "c")]
    out = exact.dedup(table(spark, rows))
    assert out.columns == table(spark, rows).columns and {r.kept for r in out.collect()} == {"mine"}


@pytest.mark.parametrize("fn", [exact.query, exact.dedup, rules.query, rules.keep_good, mix.query, mix.mixed])
def test_empty_table(spark, fn):
    assert fn(table(spark, [])).collect() == []


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_reads_back_what_went_in(spark):
    marks = ["<s>", "</s>", "<t>", "\\", "\\e", "\\b", "<", "/s>", "[INST]", "\n", "é", "", "t>"]
    rng, rows = random.Random(9), []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "x\\n<s>"]), rng.choice([None, "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))])))
    rows += [(500, i, "assistant" if i % 3 else "user", "w" * 10) for i in range(600)]
    rows += [(501, 0, "user", "same"), (501, 0, "user", "same"), (501, None, None, None), (None, 1, "assistant", "q"), (502, 0, "user", "z" * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [x[1:] for x in turns]
        assert got[c].learned == [x[2] for x in turns if x[1] == "assistant"]
    assert len(got) == len(by)


def test_a_long_conversation_takes_time_in_proportion(spark):
    """20,000 turns, merged or not, are read back in seconds."""
    roles = {1: lambda i: "user" if i % 2 else "assistant", 2: lambda i: "assistant"}
    rows = [(c, i, role(i), f"turn </s> {i} " + "y" * 40) for c, role in roles.items() for i in range(20_000)]
    df = spark.createDataFrame(rows, TURNS)
    start = time.time()
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert time.time() - start < 60
    for c, role in roles.items():
        assert [(t.role, t.text) for t in got[c].turns] == [r[2:] for r in rows if r[0] == c]
        assert got[c].learned == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]


def test_a_mask_that_does_not_fit_is_an_error(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "d")], TURNS))
    moved = df.withColumn("mask", F.transform("mask", lambda r: F.struct((r["n_chars"] + 1).alias("n_chars"), r["in_loss"].alias("in_loss"))))
    with pytest.raises(Exception, match="mask"):
        chat.read_back(moved).collect()


def test_chat_mask_covers_the_whole_and_an_empty_table_gives_nothing(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<s>"), (1, 1, "assistant", "b"), (1, 2, "assistant", "</s>")], TURNS)
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>user\na\\s</s><s>assistant\nb<t>\\e</s>"
    assert sum(x.n_chars for x in r.mask) == len(r.formatted)
    assert chat.format_chats(df.where("false")).count() == 0


def plain_counts(text):
    words = (text or "").split()
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_plain_loops(spark):
    rows = odd_rows() + [(400, "a b c d e f a b c d e\na b c d e\n\na b c d e", "en", "a", 1)]
    got = {r.doc_id: tuple(r) for r in rules.query(table(spark, rows)).collect()}
    for r in rows:
        n, *rest = plain_counts(r[1])
        assert got[r[0]][1:6] == (n, *rest)
        assert got[r[0]][6] == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (got[r[0]][6] and got[r[0]][7])


def test_rules_reject_what_stands_out_and_keep_the_rest(spark):
    rng = random.Random(2)
    clean = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(60))
    rows = [(i, clean(), "en", "big" if i % 3 else "small", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in clean().split()), "en", "big", 0) for i in range(20)] + [(1100, clean().upper(), "en", "alone", 0)]
    out = {r.doc_id for r in rules.keep_good(table(spark, rows + bad)).collect()}
    assert out == set(range(300))


def test_a_rare_language_with_long_words_stays(spark):
    """Five clean texts of a language, whose words are far longer than those of all others."""
    rng = random.Random(2)
    text = lambda lo, hi: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(lo, hi))) for _ in range(60))
    rows = [(i, text(2, 8), "en", "big", 0) for i in range(300)]
    rare = [(1000 + i, text(14, 22), "th", "big", 0) for i in range(5)] + [(1100, text(14, 22), None, "x", 0)]
    bad = [(2000, " ".join(f"{w}###" for w in text(14, 22).split()), "th", "big", 0)]
    out = {r.doc_id for r in rules.keep_good(table(spark, rows + rare + bad)).collect()}
    assert out == {r[0] for r in rows + rare}


def test_fences_move_without_a_step(spark):
    """One text more never moves a fence by more than its share."""
    def high(n):
        rows = [(i, " ".join(("" if i < n else "longer") + f"w{i}x{k}" for k in range(20)), "en", "a" if i < n else "b", 0) for i in range(300)]
        return rules.fences(rules.measure(table(spark, rows))).where("source = 'a'").first().high_word_length

    got = [high(n) for n in (49, 50, 51)]
    assert max(abs(a - b) for a, b in zip(got, got[1:])) < 100


def test_sketch_merges_in_any_order(spark):
    v = spark.range(5000).select((F.col("id") * 37 % 9001).alias("v")).withColumn("b", rules.bucket(F.col("v")))
    assert v.where("b > v OR 32 * (v - b) >= v AND v >= 64 OR v < 64 AND b <> v").count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), "en", rng.choice(["hot"] * 9 + ["b", "c", None, "é"]), 0) for i in range(900)]
    rows += [(2000, "one two three", "en", "tiny", 0), (2001, None, "en", "void", 0)]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    got = mix.query(table(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=2)
    assert sorted(map(tuple, mix.query(table(spark, rows).repartition(7)).collect())) == sorted(map(tuple, got))


def test_mix_rows_hold_the_words_taken(spark):
    rng = random.Random(5)
    rows = [(i, "  " + " \n".join(f"w{i}x{k}" for k in range(rng.randint(1, 50))), "en", rng.choice("abcd"), 7) for i in range(80)]
    docs = table(spark, rows)
    taken = {r.doc_id: r.taken for r in mix.query(docs).collect()}
    out = mix.mixed(docs).collect()
    got, text = Counter(), {r[0]: r[1] for r in rows}
    for r in out:
        got[r.doc_id] += len(r.text.split())
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text) and r.kept == "mine"
    assert got == {k: v for k, v in taken.items() if v}


def test_apportionment_equals_dealing_seat_by_seat(spark):
    rng = random.Random(8)
    for n, seats in ((1, 5), (7, 100), (40, 333)):
        votes = {i: rng.choice([0, 1, 5, rng.randint(1, 10_000)]) for i in range(n)}
        votes[0] += 1
        won = Counter()
        for _ in range(seats):
            won[max((i for i in votes if votes[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        df = spark.createDataFrame([("g", i, v, seats, seats) for i, v in votes.items()], "g string, i bigint, v bigint, seats bigint, most bigint")
        got = {r.i: r.quota for r in mix._apportion(df, ["g"], ["i"], "v", "seats", "most", F.col("i")).collect()}
        assert got == {i: won[i] for i in votes}


def test_keys(spark):
    assert keyed(table(spark, odd_rows())).where(F.col(KEY) != F.col("doc_id")).count() == 0
    assert keyed(table(spark, [(1, "a", None, None, 0)] * 3)).select(KEY).distinct().count() == 3
