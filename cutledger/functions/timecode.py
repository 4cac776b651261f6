"""Timecode arithmetic as Columns.

Frames are 1-based and end-inclusive in shot tables, 0-based in manifests. SMPTE text counts with
the nominal (rounded) rate, seconds with the real one; there is no drop-frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nominal(fps: str | Column) -> Column:
    return F.bround(_c(fps)).cast("bigint")


def _parts(tc: str | Column) -> Column:
    return F.split(F.translate(F.ltrim(F.trim(_c(tc)), F.lit("'")), ";", ":"), ":")


def tc_seconds(tc: str | Column) -> Column:
    """``HH:MM:SS.mmm`` to seconds."""
    p = _parts(tc)
    return (
        F.get(p, 0).cast("bigint") * 3600 + F.get(p, 1).cast("bigint") * 60 + F.get(p, 2).cast("double")
    )


def seconds_tc(sec: str | Column) -> Column:
    """Seconds to ``HH:MM:SS.mmm``; negatives clamp to zero and milliseconds carry."""
    s = F.greatest(_c(sec), F.lit(0.0))
    ms = F.floor(s) * 1000 + F.bround((s - F.floor(s)) * 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3600000),
        F.pmod(F.floor(ms / 60000), F.lit(60)),
        F.pmod(F.floor(ms / 1000), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def frames_smpte(frames: str | Column, fps: str | Column, clamp: bool = True) -> Column:
    """Frame count to ``HH:MM:SS:FF``; without clamp the frame part is a floor modulo."""
    n = nominal(fps)
    fr = _c(frames).cast("bigint")
    fr = F.greatest(fr, F.lit(0).cast("bigint")) if clamp else fr
    # Four uses of ``fr``, not a chain of remainders: nested timecodes must not blow up the plan.
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        F.floor(fr / (n * 3600)),
        F.pmod(F.floor(fr / (n * 60)), F.lit(60)),
        F.pmod(F.floor(fr / n), F.lit(60)),
        F.pmod(fr, n),
    )


def smpte_frames(tc: str | Column, fps: str | Column) -> Column:
    """``HH:MM:SS:FF`` (``;`` allowed before the frames) to a frame count, null if malformed."""
    p = _parts(tc)
    n = [F.get(p, i).try_cast("bigint") for i in range(4)]
    return ((n[0] * 60 + n[1]) * 60 + n[2]) * nominal(fps) + n[3]


def seconds_smpte(sec: str | Column, fps: str | Column) -> Column:
    return frames_smpte(F.bround(_c(sec) * _c(fps)).cast("bigint"), fps)


def tcid_from_tc(tc: str | Column, fps: str | Column) -> Column:
    """``HH:MM:SS.mmm`` to ``HHMMSSFF``: frame rounds half to even and stays below the rate."""
    p = _parts(tc)
    sec = F.get(p, 2).cast("double")
    whole = F.floor(sec).cast("bigint")
    ff = F.least(F.bround((sec - whole) * _c(fps)).cast("bigint"), nominal(fps) - 1)
    return F.format_string(
        "%02d%02d%02d%02d", F.get(p, 0).cast("bigint"), F.get(p, 1).cast("bigint"), whole, ff
    )


def tcid_from_frames(frames: str | Column, fps: str | Column) -> Column:
    return F.regexp_replace(frames_smpte(frames, fps), ":", "")


def _digits(tcid: str | Column) -> list[Column]:
    t = _c(tcid)
    return [F.substring(t, i, 2).cast("bigint") for i in (1, 3, 5, 7)]


def tcid_seconds(tcid: str | Column, fps: str | Column) -> Column:
    h, m, s, f = _digits(tcid)
    return h * 3600 + m * 60 + s + f / _c(fps)


def tcid_frames(tcid: str | Column, fps: str | Column) -> Column:
    h, m, s, f = _digits(tcid)
    return ((h * 60 + m) * 60 + s) * nominal(fps) + f


def norm_tcid(x: str | Column) -> Column:
    """Key form of a tcid cell: trimmed, leading zeros gone, never empty."""
    s = F.regexp_replace(F.trim(_c(x).cast("string")), "^0+", "")
    return F.when(s == "", F.lit("0")).otherwise(s)


def tcid_of(code: str | Column) -> Column:
    """First run of eight digits in a shot code, else the text itself."""
    c = _c(code).cast("string")
    hit = F.regexp_extract(c, r"(\d{8})", 1)
    return F.when(hit != "", hit).otherwise(c)


def burnin_file_frames(show_tc: str | Column, offset_tc: str | Column, fps: str | Column) -> Column:
    """Burn-in minus offset in frames. Negative means a wrong offset: callers reject it."""
    return smpte_frames(show_tc, fps) - smpte_frames(offset_tc, fps)


def real_tc(file_tc: str | Column, offset_frames: str | Column, fps: str | Column) -> Column:
    return frames_smpte(smpte_frames(file_tc, fps) + _c(offset_frames).cast("bigint"), fps)


def out_tc(file_tc: str | Column, duration: str | Column, fps: str | Column, offset_frames: str | Column | None = None) -> Column:
    """Last frame of a shot that starts at ``file_tc`` and lasts ``duration`` frames."""
    last = smpte_frames(file_tc, fps) + _c(duration).cast("bigint") - 1
    if offset_frames is not None:
        last = last + _c(offset_frames).cast("bigint")
    return frames_smpte(last, fps)


def show_tc_frames(text: str | Column, fps: str | Column) -> Column:
    """Frames of a burned-in show timecode read, null unless it is a plausible HHMMSSFF."""
    d = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^0-9]", "")
    h, m, s, f = _digits(d)
    ok = (F.length(d) == 8) & (m <= 59) & (s <= 59) & (f < nominal(fps))
    return F.when(ok, ((h * 60 + m) * 60 + s) * nominal(fps) + f)
