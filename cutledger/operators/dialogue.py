"""Dialogue on shots, chunking for text models, and reading their replies back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutledger.functions import grammar as g
from cutledger.functions import timecode as tc
from cutledger.operators import ordered
from cutledger.session import materialize
from cutledger.sources.artifacts import pending

K = ["show_id", "cut_id"]
SHOT = [*K, "tcid"]


def to_shots(segments: DataFrame, shots: DataFrame, bucket_s: float = 10.0, prefix: str = "SHW") -> DataFrame:
    """Dialogue per shot: every segment that overlaps it, joined in segment order.

    ``segments``: show_id, cut_id, idx, start, end, text in seconds. Shots and segments meet in
    time buckets; a pair counts only in the first bucket both touch, so no pair appears twice. A
    segment that ends on a shot's start does not touch it.
    """
    spans = shots.withColumns(
        {"start": (F.col("start_frame") - 1) / F.col("fps"), "end": F.col("end_frame") / F.col("fps")}
    )

    def buckets(lo: str, hi: str):
        at = F.floor(F.col(lo) / bucket_s)
        return F.explode(F.sequence(at, F.greatest(at, F.floor(F.col(hi) / bucket_s))))

    s = spans.select(*SHOT, F.col("start").alias("s0"), F.col("end").alias("s1"), buckets("start", "end").alias("b"))
    d = segments.select(*K, "idx", "text", F.col("start").alias("d0"), F.col("end").alias("d1"), buckets("start", "end").alias("b"))
    first_common = F.floor(F.greatest("s0", "d0") / bucket_s)
    hits = s.join(d, [*K, "b"]).filter(
        (F.col("b") == first_common) & (F.col("d0") < F.col("s1")) & (F.col("d1") > F.col("s0"))
    )
    texts = hits.groupBy(*SHOT).agg(ordered_text("idx", "text").alias("dialogue"))
    code = F.concat(F.lit(prefix + "_"), "tcid").alias("shot_code")
    return spans.join(texts, SHOT, "left").select(
        *SHOT, code, "start", "end", F.trim(F.coalesce("dialogue", F.lit(""))).alias("dialogue")
    )


def ordered_text(order: str, text: str, sep: str = " "):
    """Texts of a group joined in their input order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def transcript(segments: DataFrame) -> DataFrame:
    """One line per segment: ``[start --> end] text``."""
    line = F.concat(F.lit("["), tc.seconds_tc("start"), F.lit(" --> "), tc.seconds_tc("end"), F.lit("] "), F.col("text"))
    return segments.select(*K, "idx", line.alias("line"))


def chunks(shots: DataFrame, size: int = 25, overlap: int = 3) -> DataFrame:
    """Shots repeated into overlapping chunks: chunk number, place in it, context flag."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = max(1, size - overlap)
    n = shots.groupBy(*K).agg(F.count("*").alias("_n"))
    rows = ordered.salted_lookup(ordered.ordinal(shots, K, ["seq"], "_r"), n, K, ["seq"])
    r = F.col("_r") - 1
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step))
    lo = F.greatest(F.lit(0), F.floor((r - size) / step) + 1)
    hi = F.least(F.floor(r / step), last)
    at = F.col("_r") - 1 - F.col("chunk") * step
    out = rows.withColumn("chunk", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    context = (F.col("chunk") > 0) & F.lit(size > overlap) & (at < overlap)
    return out.withColumns({"place": at, "is_context": context}).drop("_r", "_n")


def chunks_with_work(chunked: DataFrame, todo: DataFrame) -> DataFrame:
    """Chunks that hold at least one shot still to do."""
    busy = chunked.join(todo.select(*SHOT), SHOT, "left_semi").select(*K, "chunk").distinct()
    return chunked.join(busy, [*K, "chunk"], "left_semi")


def first_heard(chunked: DataFrame, dialogue: DataFrame) -> DataFrame:
    """Each name a cut's dialogue addresses, with the first chunk that holds it."""
    said = chunked.select(*SHOT, "chunk").join(dialogue.select(*SHOT, "dialogue"), SHOT)
    heard = said.withColumn("name", F.explode(g.addressed_names("dialogue")))
    return heard.groupBy(*K, "name").agg(F.min("chunk").alias("chunk"))


def known_names(chunked: DataFrame, dialogue: DataFrame) -> DataFrame:
    """Names heard up to each chunk, sorted.

    Names fold to their first chunk, and the chunks of a cut that bring a new name are numbered. A
    name then goes to its own number and all later ones, so every list is gathered by itself and a
    cut of any length spreads by number; all chunks find their list through the running count of
    such chunks. What is gathered is what comes out.
    """
    heard = materialize(first_heard(chunked, dialogue))
    fresh = heard.select(*K, "chunk").distinct()
    fresh = materialize(ordered.ordinal(fresh, K, ["chunk"], "_k"))
    last = fresh.groupBy(*K).agg(F.max("_k").alias("_last"))
    own = heard.join(fresh, [*K, "chunk"]).join(last, K).select(*K, "name", F.explode(F.sequence("_k", "_last")).alias("_k"))
    grown = own.groupBy(*K, "_k").agg(F.array_sort(F.collect_list("name")).alias("_names"))
    rows = chunked.select(*K, "chunk").distinct().join(fresh.select(*K, "chunk", F.lit(1).alias("_f")), [*K, "chunk"], "left")
    own = F.coalesce("_f", F.lit(0))
    counted = ordered.running(rows, K, ["chunk"], {"_before": own})
    listed = counted.withColumn("_k", (F.col("_before") + own).cast("bigint"))
    got = ordered.salted_lookup(listed, grown, [*K, "_k"], ["chunk"])
    empty = F.array().cast("array<string>")
    return got.select(*K, "chunk", F.coalesce("_names", empty).alias("names"))


CAPTION_PROMPT = (
    "Describe this film frame for a shot list in a single factual line: who or what is seen, what "
    "happens, where, and how wide the framing is. State only what the picture shows; leave out "
    "names, feelings and guesses."
)
STORY_RULES = (
    "These are consecutive shots of one film, each with a caption and any spoken line. Rewrite "
    "every caption as one factual line that fits the story. Use a person's name only if the "
    "dialogue here speaks it."
)
STORY_FORMAT = (
    "Answer with a line 'STORY_STATE: ' and a short summary so far, then a line 'REVISED:', then "
    "one line '<shot code>: <description>' per shot in this order."
)


def prompts(chunked: DataFrame, names: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Prompt text per chunk. ``chunked`` carries place, shot_code, visual_caption, dialogue.

    A chunk holds a fixed number of shots, so the collected lines are bounded.
    """
    said = F.when(
        F.coalesce("dialogue", F.lit("")) != "", F.concat(F.lit(' | dialogue: "'), F.col("dialogue"), F.lit('"'))
    ).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), F.col("shot_code"), F.lit(": "), F.coalesce("visual_caption", F.lit("")), said)
    body = chunked.withColumn("_line", line).groupBy(*K, "chunk").agg(ordered_text("place", "_line", "\n").alias("_body"))
    rows = body.join(names, [*K, "chunk"], "left")
    if states is not None:
        rows = rows.join(states.select(*K, "chunk", "story_state"), [*K, "chunk"], "left")
    else:
        rows = rows.withColumn("story_state", F.lit(None).cast("string"))
    heard = F.when(F.size("names") > 0, F.concat(F.lit("Names heard so far: "), F.array_join("names", ", ")))
    state = F.when(F.trim(F.coalesce("story_state", F.lit(""))) != "", F.trim("story_state")).otherwise(
        F.lit("(start of the film)")
    )
    text = F.concat_ws(
        "\n", F.lit(STORY_RULES), heard, F.concat(F.lit("Story so far: "), state), F.lit("Shots:"), "_body", F.lit(STORY_FORMAT)
    )
    return rows.select(*K, "chunk", text.alias("prompt"))


def parse_replies(replies: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Story state per chunk, and the last revised line of every code the chunk holds."""
    text = F.regexp_replace("reply", "\r\n?", "\n")
    state = F.trim(F.regexp_extract(text, r"(?is)STORY_STATE:\s*(.+?)(?:\nREVISED:|\z)", 1))
    states = replies.select(*K, "chunk", state.alias("story_state"))
    lines = replies.select(*K, "chunk", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", g.strip("line")).filter(F.col("line").contains(":"))
    code = g.strip(F.regexp_replace(g.strip(F.substring_index("line", ":", 1)), "^-+", ""))
    rest = g.strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))
    found = lines.select(*K, "chunk", "line_no", code.alias("shot_code"), rest.alias("revised"))
    known = found.join(codes.select(*K, "chunk", "shot_code"), [*K, "chunk", "shot_code"], "left_semi")
    last = known.groupBy(*K, "chunk", "shot_code").agg(F.max_by("revised", "line_no").alias("revised"))
    return states, last


def latest_revision(chunked: DataFrame, revised: DataFrame) -> DataFrame:
    """Revised description per shot: the last chunk that answered wins, else the caption stays."""
    rows = chunked.join(revised, [*K, "chunk", "shot_code"], "left")
    text = F.when(F.coalesce("revised", F.lit("")) != "", F.col("revised"))
    return rows.groupBy(*SHOT).agg(
        F.max("shot_code").alias("shot_code"),
        F.max("visual_caption").alias("visual_caption"),
        F.coalesce(
            F.max_by(text, F.when(text.isNotNull(), F.col("chunk"))), F.max("visual_caption"), F.lit("")
        ).alias("revised_description"),
    )


def infer(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType | str,
    keys: list[str],
    done: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """Run a caller's model over Arrow batches of the rows that have no finished output yet."""
    todo = df if done is None else pending(df, done, keys, force)
    return todo.mapInPandas(fn, schema)
