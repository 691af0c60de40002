"""Small scalar rules: retries, sizes, names, parameters, orientation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("flag", "best_guess", "patch")
FLAG_RATE, FLOOR, CEILING = 0.10, 45.0, 75.0
BASELINE_LEAST, OSD_LEAST = 1.0, 2.0


def retry_delay(attempt: Column, first: int = 500, most: int = 8000) -> Column:
    """Milliseconds before a retry: doubling from ``first``, ``most`` at most."""
    doubled = F.lit(first).cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(attempt.cast("int") - 1, F.lit(30)))
    return F.least(doubled, F.lit(most).cast("bigint"))


def closeup_side(side: Column, fraction: Column) -> Column:
    """One side of a close-up that keeps ``fraction`` of the area: rounded half up, 1 to the side itself."""
    return F.least(F.greatest(F.floor(side * F.sqrt(fraction) + 0.5), F.lit(1)), side)


def valid_job_id(job: Column) -> Column:
    """Letters, digits, _ and - alone; a newline at the end is refused too."""
    return F.coalesce(job.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))


def new_job_id() -> Column:
    return F.concat(F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def page_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^page_([0-9]+)$", 1).try_cast("int")


def page_name(number: Column) -> Column:
    return F.format_string("page_%03d", number)


def frame_name(index: Column, suffix: Column) -> Column:
    return F.format_string("frame_%02d%s", index, suffix)


def resolve_mode(asked: Column, configured: Column) -> Column:
    """The mode asked for, else the configured one, else flag; a mode that is asked for must exist."""
    checked = F.when(asked.isNull() | asked.isin(*MODES), asked).otherwise(F.raise_error(F.concat(F.lit("no such mode: "), asked)))
    return F.coalesce(checked, configured, F.lit("flag"))


def job_mode(payload: Column) -> Column:
    """The mode named in a job's JSON, flag if it names none that exists."""
    mode = F.get_json_object(payload, "$.mode")
    return F.coalesce(F.when(mode.isin(*MODES), mode), F.lit("flag"))


def rails(rate: Column, floor: Column, ceiling: Column) -> Column:
    """struct(rate, floor, ceiling) with defaults; inverted rails are swapped."""
    low, high = F.coalesce(floor, F.lit(FLOOR)), F.coalesce(ceiling, F.lit(CEILING))
    return F.struct(F.coalesce(rate, F.lit(FLAG_RATE)).alias("rate"), F.least(low, high).alias("floor"), F.greatest(low, high).alias("ceiling"))


def orientation(hint: Column, baseline: Column, baseline_conf: Column, osd: Column, osd_conf: Column, width: Column, height: Column) -> Column:
    """struct(method, rotate, warnings): a hint, else a sure baseline, else a sure OSD reading, else none."""
    by_hint, by_baseline = hint.isNotNull(), baseline.isNotNull() & (baseline_conf >= BASELINE_LEAST)
    by_osd = osd.isNotNull() & (osd_conf >= OSD_LEAST)
    method = F.when(by_hint, "hint").when(by_baseline, "baseline").when(by_osd, "osd").otherwise("none")
    turn = F.when(by_hint, hint).when(by_baseline, baseline).when(by_osd, osd).otherwise(0)
    undecided = ~by_hint & ~F.coalesce(by_baseline, F.lit(False))
    warnings = F.array_compact(F.array(
        F.when(undecided & osd.isNull(), "osd_unavailable"),
        F.when(undecided & osd.isNotNull() & (F.coalesce(osd_conf, F.lit(0.0)) < OSD_LEAST), "osd_low_conf"),
        F.when((method == "none") & (width > height), "landscape"),
    ))
    return F.struct(method.alias("method"), F.pmod(turn, F.lit(360)).alias("rotate"), warnings.alias("warnings"))


def mirrored(exif: Column) -> Column:
    """Whether an EXIF orientation mirrors the image; pure rotations are not trusted."""
    return F.coalesce(exif.isin(2, 4, 5, 7), F.lit(False))
