"""Slate, take, code and name grammar as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the burn-in grammar.
NON_SLATE = r"(?i)(\b(stock|camera-roll|cameraroll|placeholder|slutscen|wip)\b|work in progress|\.mov\b|\.mp4\b|\.mxf\b)"
CONFUSABLE_FROM = "sSoO&lI|BgqZe"
CONFUSABLE_TO = "5500811189926"
TAKE_HEAD = r"^([IVXLCivxlc1|!]*)"
ROMAN = {"I": 1, "V": 5, "X": 10, "C": 100}
CODE = r"^([A-Za-z0-9]+)_(\d+)_(\d+)_(\d+)$"
PROTECTED = "new cut|manual|added"
VOCATIVE = r"(?:^|[,\.\!\?]\s*)((?:Mrs?\.|Ms\.|Dr\.)?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*[,\.\!\?]"
NOT_NAMES = ["The", "A", "An", "It", "This", "That", "He", "She", "They", "We", "You", "I"]
TRUE_WORDS = ["1", "true", "yes", "y"]
FALSE_WORDS = ["", "0", "false", "no", "n"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: str | Column) -> Column:
    """Without white space at both ends. Behind a rare line end, the pattern may match before it."""
    t = F.coalesce(_c(x), F.lit(""))
    rare = F.right(t, F.lit(1)).isin("\x85", "\u2028", "\u2029")
    return F.when(rare, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(" \t\n\x0b\f\r")))


def code_parts(code: str | Column) -> Column:
    """struct<prefix, slate, take, counter>, null where the code does not parse."""
    c = F.coalesce(_c(code), F.lit(""))
    part = [F.regexp_extract(c, CODE, i) for i in range(1, 5)]
    return F.when(
        c.rlike(CODE),
        F.struct(
            part[0].alias("prefix"),
            part[1].try_cast("bigint").alias("slate"),
            part[2].try_cast("bigint").alias("take"),
            part[3].try_cast("bigint").alias("counter"),
        ),
    )


def official_code(slate: Column, take: Column, nth: Column, prefix: str | Column = "SHW") -> Column:
    """``PFX_slate_take_counter`` with the counter ten per occurrence; blank without a number."""
    n = slate.try_cast("bigint")
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    take = F.greatest(F.coalesce(take.cast("bigint"), F.lit(0)), F.lit(0))
    return F.when(n.isNull(), F.lit("")).otherwise(
        F.format_string("%s_%04d_%02d_%03d", p, n, take, nth.cast("bigint") * 10)
    )


def is_protected(revision: str | Column) -> Column:
    return F.lower(F.coalesce(_c(revision), F.lit(""))).rlike(PROTECTED)


def is_true(x: str | Column) -> Column:
    return F.lower(strip(_c(x).cast("string"))).isin(TRUE_WORDS)


def is_flagged(x: str | Column) -> Column:
    return ~F.lower(strip(_c(x).cast("string"))).isin(FALSE_WORDS)


def is_unreliable(raw: str | Column) -> Column:
    return F.coalesce(_c(raw), F.lit("")).rlike(NON_SLATE)


def roman_value(text: Column) -> Column:
    """Subtractive value of a text over the letters I V X C."""
    table = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(F.split(F.reverse(text), ""), lambda ch: F.element_at(table, ch))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    return F.aggregate(
        values,
        start,
        lambda a, v: F.struct(
            (a["total"] + F.when(v < a["top"], -v).otherwise(v)).alias("total"),
            F.greatest(a["top"], v).alias("top"),
        ),
        lambda a: a["total"],
    )


def _roman_text(text: Column) -> Column:
    """Take letters at the head of a field, look-alikes of I mapped to I; may be empty."""
    token = F.regexp_extract(text, r"^\s*(\S*)", 1)
    head = F.regexp_extract(F.regexp_replace(token, r"[*.,\-]+$", ""), TAKE_HEAD, 1)
    return F.translate(F.upper(head), "1L|!", "IIII")


def roman(text: str | Column) -> Column:
    """Roman numeral of the leading take in a field, '' where there is none.

    Well-formed numerals are positive by shape; only others need their value worked out.
    """
    formed = r"^(X{1,3}(IX|IV|V?I{0,8})|IX|IV|VI{0,8}|I{1,9})$"
    return let(
        _roman_text(F.coalesce(_c(text), F.lit(""))),
        lambda r: F.when((r == "") | r.rlike(formed) | (roman_value(r) > 0), r).otherwise(F.lit("")),
    )


def roman_take(text: str | Column) -> Column:
    """struct<roman, value> of the leading take in a field; ('', 0) where there is none."""
    return let(
        roman(text),
        lambda r: F.struct(r.alias("roman"), F.when(r == "", 0).otherwise(roman_value(r)).alias("value")),
    )


def _unpad(digits: Column) -> Column:
    d = F.regexp_replace(digits, "^0+", "")
    return F.when(d == "", F.lit("0")).otherwise(d)


def slate_token(token: str | Column) -> Column:
    """Slate number of one token: plain digits, then letters dropped, then look-alikes mapped."""

    def read(t: Column) -> Column:
        digits = F.regexp_replace(t, "[A-Za-z]", "")
        nd, nl = F.length(digits), F.length(t) - F.length(digits)
        mapped = F.translate(t, CONFUSABLE_FROM, CONFUSABLE_TO)
        return (
            F.when(t.rlike(r"^[0-9]+$"), F.when(F.length(t) <= 5, _unpad(t)))
            .when(t.rlike(r"^[A-Za-z0-9]+$") & nd.between(2, 5) & (nl <= nd), _unpad(digits))
            .when(mapped.rlike(r"^[0-9]{1,4}$") & (roman(t) == ""), _unpad(mapped))
        )

    return let(strip(token), read)


def slate_field(field: str | Column) -> Column:
    """struct<slate, take> of one slash field; slate is null where it is no slate field."""
    none = F.struct(F.lit(None).cast("string").alias("slate"), F.lit("").alias("take"))

    def out(slate: Column, rest: Column) -> Column:
        take = F.when(F.size(rest) > 0, roman(F.element_at(rest, -1))).otherwise(F.lit(""))
        return let(slate, lambda s: F.when(s.isNull(), none).otherwise(F.struct(s.alias("slate"), take.alias("take"))))

    def from_tokens(tokens: Column) -> Column:
        first = F.get(tokens, F.lit(0))
        # Number of leading pure-digit tokens.
        run = F.aggregate(
            tokens,
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, t: F.struct(
                (a["n"] + F.when(a["on"] & t.rlike("^[0-9]+$"), 1).otherwise(0)).alias("n"),
                (a["on"] & t.rlike("^[0-9]+$")).alias("on"),
            ),
            lambda a: a["n"],
        )

        def joined(n: Column) -> Column:
            text = F.concat_ws("", F.slice(tokens, F.lit(1), n))

            def fitted(t: Column) -> Column:
                fits = F.length(t) <= 5
                used = F.when(fits, n).otherwise(F.lit(1))
                digits = F.when(fits, _unpad(t)).when(F.length(first) <= 5, _unpad(first))
                return out(digits, F.slice(tokens, used + 1, F.size(tokens)))

            return let(text, fitted)

        return F.when(first.rlike("^[0-9]+$"), let(run, joined)).otherwise(
            out(slate_token(first), F.slice(tokens, F.lit(2), F.size(tokens)))
        )

    def read(f: Column) -> Column:
        scene_ref = F.lower(f).contains("pt") | f.contains("+")
        return F.when((f == "") | scene_ref, none).otherwise(let(F.split(f, r"\s+"), from_tokens))

    return let(strip(field), read)


def slate_line(raw: str | Column) -> Column:
    """struct<scene, slate, take, extra> of one burn-in line ``scene / slate / take extra``."""

    def row(scene: Column, slate: Column, take: Column, extra: Column) -> Column:
        return F.struct(
            scene.alias("scene"),
            slate.cast("string").alias("slate"),
            take.alias("take"),
            extra.alias("extra"),
        )

    blank, null = F.lit(""), F.lit(None).cast("string")

    def with_slate(fields: Column, hit: Column) -> Column:
        scene = strip(F.concat_ws("/", F.slice(fields, F.lit(1), hit["i"])))
        tail = strip(F.concat_ws("/", F.slice(fields, hit["i"] + 2, F.size(fields))))

        def finish(t: Column) -> Column:
            return let(
                roman(t),
                lambda tk: F.when(
                    tk != "", row(scene, hit["f"]["slate"], tk, strip(F.regexp_extract(t, r"(?s)^\S+\s+(.*)$", 1)))
                ).otherwise(row(scene, hit["f"]["slate"], hit["f"]["take"], t)),
            )

        return let(tail, finish)

    def without_slate(fields: Column) -> Column:
        takes = F.filter(
            F.transform(F.slice(fields, F.lit(2), F.size(fields)), roman),
            lambda t: t != "",
        )
        return row(F.get(fields, F.lit(0)), null, F.coalesce(F.try_element_at(takes, F.lit(-1)), blank), blank)

    def from_fields(fields: Column) -> Column:
        later = F.filter(
            F.transform(F.slice(fields, F.lit(3), F.size(fields)), lambda f, i: F.struct((i + 2).alias("i"), slate_field(f).alias("f"))),
            lambda x: x["f"]["slate"].isNotNull(),
        )
        first = F.struct(F.lit(1).alias("i"), slate_field(F.get(fields, F.lit(1))).alias("f"))
        # Mostly the second field is the slate, and the others need not be looked at.
        found = let(first, lambda x: F.when(x["f"]["slate"].isNotNull(), x).otherwise(F.get(later, F.lit(0))))
        return let(
            found,
            lambda hit: F.when(hit.isNull(), without_slate(fields)).otherwise(with_slate(fields, hit)),
        )

    # The ordinary line, scene / digits / tail, needs no field list.
    clean = r"^([^/]*)/\s*([0-9]{1,5})\s*/([^/]*)$"

    def ordinary(text: Column) -> Column:
        scene, digits = strip(F.regexp_extract(text, clean, 1)), _unpad(F.regexp_extract(text, clean, 2))
        after = lambda t: F.regexp_extract(t, r"(?s)^\S+\s+(.*)$", 1)
        return let(
            strip(F.regexp_extract(text, clean, 3)),
            lambda t: let(roman(t), lambda tk: row(scene, digits, tk, F.when(tk != "", after(t)).otherwise(t))),
        )

    # Inside let() the branches are no part of the generated method, which would be too long to compile.
    def read(text: Column) -> Column:
        return (
            F.when(~text.contains("/"), row(blank, null, blank, blank))
            .when(is_unreliable(text), row(text, null, blank, blank))
            .when(text.rlike(clean), ordinary(text))
            .otherwise(let(F.transform(F.split(text, "/"), strip), from_fields))
        )

    return let(strip(raw), read)


def clean_slate_change(a: str | Column, b: str | Column) -> Column:
    """True where two slate numbers differ by more than a misread digit would explain."""
    a, b = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    x, y = a.try_cast("bigint"), b.try_cast("bigint")
    return (
        F.when((a == "") | (b == "") | (a == b), False)
        .when(a.contains(b) | b.contains(a), False)
        .when(x.isNull() | y.isNull(), True)
        .otherwise(F.abs(x - y) > 1)
    )


def norm_note(raw: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(_c(raw), F.lit(""))), "[^A-Z0-9 ]", ""))


def addressed_names(text: str | Column) -> Column:
    """Sorted distinct names that a line of dialogue addresses."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(VOCATIVE), F.lit(1)), strip)
    kept = F.filter(
        found,
        lambda n: (F.length(n) >= 2)
        & ~F.regexp_replace(F.get(F.split(n, r"\s+"), F.lit(0)), r"\.+$", "").isin(NOT_NAMES),
    )
    return F.array_sort(F.array_distinct(kept))


def first_url(text: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"""(https?://[^\s"')]+)""", 1)
