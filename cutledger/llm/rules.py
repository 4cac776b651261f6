"""Quality rules with thresholds that adapt to each language and source, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import bare, stored, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Each rule: measure, as (numerator, denominator) in thousandths; slack added above the upper
#: fence and taken below the lower one (None: no such fence). Slack keeps a group of equal,
#: clean texts from rejecting what differs from them by a little.
RULES = {
    "symbols": ("n_symbols", "word_chars", None, 40),
    "dup_lines": ("n_dup_lines", "n_lines", None, 400),
    "capitals": ("n_capitals", "word_chars", None, 200),
    "word_length": ("word_chars", "n_words", 1500, 3000),
}
#: A fence is this many times the distance between the quartiles beyond the nearer quartile.
REACH = 3
#: A group's quartiles count as many times as it has texts, those of its language this often; in
#: the same way a language leans on all texts, but only in what does not depend on the language.
PRIOR = 50
SHARED = ["symbols", "dup_lines"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PRIVATE = "_q_"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of every whole text under private names, all in one pass without a shuffle."""
    p = PRIVATE
    text = text_of(text_col)
    has_word = lambda line: F.length(bare(line)) > 0
    rows = docs.withColumns({f"{p}w": words(text), f"{p}lines": F.filter(F.split(text, "\n"), has_word), f"{p}bare": bare(text)})
    # The hash of five words stands for the window that begins at the first of them.
    at = ", ".join(f"{p}w[i + {k}]" for k in range(WINDOW))
    hashes = F.expr(f"IF(size({p}w) < {WINDOW}, array(), transform(sequence(0, size({p}w) - {WINDOW}), i -> xxhash64({at})))")
    rows = rows.withColumn(f"{p}h", hashes)
    # Only a text with a window that comes again is looked at more closely: windows in order of
    # hash put equal ones side by side; then each position counts until the next one or five words.
    again = F.size(F.array_distinct(f"{p}h")) < F.size(f"{p}h")
    rows = rows.withColumn(
        f"{p}s", F.when(again, F.expr(f"sort_array(transform({p}h, (h, i) -> struct(h AS h, i AS i)))"))
    ).withColumn(
        f"{p}at",
        F.expr(f"sort_array(transform(filter({p}s, (x, k) -> get({p}s, k - 1).h <=> x.h OR get({p}s, k + 1).h <=> x.h), x -> x.i))"),
    )
    covered = F.expr(f"aggregate(transform({p}at, (a, k) -> least({WINDOW}, coalesce(get({p}at, k + 1) - a, {WINDOW}))), 0, (x, y) -> x + y)")
    b = F.col(f"{p}bare")
    counts = {
        "n_words": F.size(f"{p}w"),
        "word_chars": F.length(b),
        "n_symbols": F.length(b) - F.length(F.translate(b, SYMBOLS, "")),
        "n_capitals": F.length(b) - F.length(F.translate(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "n_lines": F.size(f"{p}lines"),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    rows = rows.withColumns({p + k: v.cast("bigint") for k, v in counts.items()}).drop(*(f"{p}{x}" for x in ("w", "lines", "bare", "h", "s", "at")))
    failed = (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words"))
    return rows.withColumn(f"{p}base_failed", failed)


def value(rule: str) -> Column:
    over, under = RULES[rule][:2]
    return F.expr(f"1000 * {PRIVATE}{over} div nullif({PRIVATE}{under}, 0)")


def bucket(v: Column) -> Column:
    """Lower end of the value's bucket: exact below 64, above that six leading bits are kept.

    Counts per bucket are a quantile sketch with a relative error below 1/32; two of them merge by
    adding counts, in any order, with the same result.
    """
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def fences(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per language and source: its lower and upper fence for each rule.

    Quartiles move with the number of texts from the language's to the group's own, with no step
    at any number: (own * n + language's * prior) / (n + prior).
    """
    p = PRIVATE
    keys = [F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bucket(value(r)).alias("bucket")) for r in RULES)))
    sketch = stored(
        measured.where(~F.col(f"{p}base_failed")).select(*keys, pairs.alias("v")).groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count("*").alias("n")), "sketches"
    )
    levels = {"own": ["lang", "source"], "lang": ["lang"], "all": []}
    by = {name: _quartiles(sketch, cols, name) for name, cols in levels.items()}
    table = by["own"]
    for name in ("lang", "all"):
        on = F.lit(True)
        for c in ["rule", *levels[name]]:
            on = on & table[c].eqNullSafe(by[name][c])
        table = table.join(by[name], on, "left").select(table["*"], *(by[name][f"{name}_{x}"] for x in ("n", "q1", "q3")))
    shared = F.col("rule").isin(SHARED)
    for x in ("q1", "q3"):
        table = table.withColumn(f"lang_{x}", F.when(shared, F.expr(f"(lang_n * lang_{x} + {prior} * all_{x}) div (lang_n + {prior})")).otherwise(F.col(f"lang_{x}")))
        table = table.withColumn(x, F.expr(f"(own_n * own_{x} + {prior} * lang_{x}) div (own_n + {prior})"))
    reach = REACH * (F.col("q3") - F.col("q1"))
    low, high = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for rule, (_, _, below, above) in RULES.items():
        if below is not None:
            low = F.when(F.col("rule") == rule, F.col("q1") - reach - below).otherwise(low)
        high = F.when(F.col("rule") == rule, F.col("q3") + reach + above).otherwise(high)
    table = table.withColumns({"low": low, "high": high})
    at = {f"{side}_{r}": F.max(F.when(F.col("rule") == r, F.col(side))) for r in RULES for side in ("low", "high")}
    return table.groupBy("lang", "source").agg(*(v.alias(k) for k, v in at.items()))


def _quartiles(sketch: DataFrame, cols: list[str], name: str) -> DataFrame:
    merged = sketch.groupBy(*cols, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*cols, "rule")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    return run.groupBy(*cols, "rule").agg(
        F.max("total").alias(f"{name}_n"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias(f"{name}_q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias(f"{name}_q3"),
    )


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None, few: int = 50_000) -> DataFrame:
    """`carry` columns of `docs` (all by default, as one struct `row`), the counts and the verdict, under private names.

    A text fails the base rules with fewer than ten words or over a fifth of them in repeated
    windows. Of the others, each language and source (null being one of each) keeps a mergeable
    sketch of every measure; a text beyond a fence of its group is rejected. One rule holds for
    groups of any size, see fences(): a small group leans on its language, and a language on all
    texts, but never in the length of words or in capitals. Counts are stored once and read twice.
    Fences join by broadcast up to `few` groups, else by a shuffle. A null text has no words and
    fails the base rules.
    """
    cols = docs.columns if carry is None else carry
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), text_of(text_col).alias(f"{PRIVATE}text"), F.col(lang_col).alias(f"{PRIVATE}lang"), F.col(source_col).alias(f"{PRIVATE}source"))
    rows = stored(measure(packed, f"{PRIVATE}text").drop(f"{PRIVATE}text"), "measured")
    table = stored(fences(rows, f"{PRIVATE}lang", f"{PRIVATE}source"), "fences")
    small = F.broadcast(table) if table.count() <= few else table
    joined = rows.join(small, rows[f"{PRIVATE}lang"].eqNullSafe(small["lang"]) & rows[f"{PRIVATE}source"].eqNullSafe(small["source"]), "left")
    outlier = F.lit(False)
    for r in RULES:
        outlier = outlier | F.coalesce((value(r) < F.col(f"low_{r}")) | (value(r) > F.col(f"high_{r}")), F.lit(False))
    return joined.select(
        "row", *(F.col(PRIVATE + c) for c in COUNTS), f"{PRIVATE}base_failed", (~F.col(f"{PRIVATE}base_failed") & ~outlier).alias(f"{PRIVATE}kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """`docs` without the rejected rows; all columns stay as they are."""
    return judge(docs).where(F.col(f"{PRIVATE}kept")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    got = judge(docs.select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return got.select(
        F.col("row")["doc_id"].alias("doc_id"), *(F.col(PRIVATE + c).alias(c) for c in COUNTS), F.col(f"{PRIVATE}base_failed").alias("base_failed"), F.col(f"{PRIVATE}kept").alias("kept")
    )


_BUCKET = "((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0))"
_SHARED = ", ".join(f"'{r}'" for r in SHARED)
_VALUE = {r: f"1000 * {o} // {u}" for r, (o, u, _, _) in RULES.items()}
SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS b FROM t),
p AS MATERIALIZED (SELECT doc_id, g, array_to_string(ws[g:g + {WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(g)),
r AS (SELECT doc_id, g FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
n AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - g, {WINDOW})))::BIGINT AS reps FROM (SELECT doc_id, g, lead(g) OVER (PARTITION BY doc_id ORDER BY g) AS nxt FROM r) GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(b) AS word_chars, (length(b) - length(translate(b, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  length(b) - length(translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(reps, 0) AS n_repeat_words
  FROM w LEFT JOIN n USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
v AS MATERIALIZED ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, ({x})::BIGINT AS v FROM m WHERE NOT base_failed" for r, x in _VALUE.items())}),
k AS MATERIALIZED (SELECT lang, source, rule, {_BUCKET} AS bucket, count(*) AS n FROM v GROUP BY ALL),
{", ".join(f'''q_{name} AS (SELECT {cols} rule, max(total) AS n, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3
  FROM (SELECT {cols} rule, bucket, sum(n) OVER (PARTITION BY {cols} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {cols} rule) AS total FROM (SELECT {cols} rule, bucket, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY ALL)''' for name, cols in (("own", "lang, source,"), ("lang", "lang,"), ("all", "")))},
h AS (SELECT l.lang, l.rule, {", ".join(f"CASE WHEN l.rule IN ({_SHARED}) THEN (l.n * l.{x} + {PRIOR} * a.{x}) // (l.n + {PRIOR}) ELSE l.{x} END AS {x}" for x in ("q1", "q3"))} FROM q_lang l JOIN q_all a USING (rule)),
q AS (SELECT o.lang, o.source, o.rule, {", ".join(f"(o.n * o.{x} + {PRIOR} * h.{x}) // (o.n + {PRIOR}) AS {x}" for x in ("q1", "q3"))} FROM q_own o JOIN h ON o.rule = h.rule AND o.lang IS NOT DISTINCT FROM h.lang),
s AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {'NULL::BIGINT' if b is None else b}, {a})" for r, (_, _, b, a) in RULES.items())}) AS x(rule, below, above)),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN q ON v.rule = q.rule AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source JOIN s ON s.rule = v.rule
  WHERE v.v > q3 + {REACH} * (q3 - q1) + above OR v.v < q1 - {REACH} * (q3 - q1) - below)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""
