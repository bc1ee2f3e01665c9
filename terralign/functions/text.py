"""Parsing and naming of run logs, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_parts(scene: Column) -> Column:
    """batch, date and sid of a scene name batch/date/sid."""
    part = F.split(scene, "/")
    return F.struct(part[0].alias("batch"), part[1].alias("date"), part[2].alias("sid"))


def scene_paths(scene: Column, root: str, raster: str = "raster.dat", cloud: str = "cloud.las") -> Column:
    """Raster and point-cloud files of a scene below root."""
    return F.struct(F.concat_ws("/", F.lit(root), scene, F.lit(raster)).alias("raster"), F.concat_ws("/", F.lit(root), scene, F.lit(cloud)).alias("cloud"))


def tag(name: Column) -> Column:
    """A name for files: / and + become _."""
    return F.translate(name, "/+", "__")


def _found(line: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind)


def telemetry_fields(line: Column, utc_offset: str = "+0000") -> list[Column]:
    """t, ram_mb, power_mw, tj and util_pct of a telemetry line, each null if it isn't there. As columns of their own, each is parsed once."""
    stamp = F.nullif(F.regexp_extract(line, r"^(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})", 1), F.lit(""))
    t = F.try_to_timestamp(F.concat(stamp, F.lit(utc_offset)), F.lit("MM-dd-yyyy HH:mm:ssxx"))
    ram = _found(line, r"RAM (\d+)/\d+MB", "int")
    return [t.alias("t"), ram.alias("ram_mb"), _found(line, r"VDD_IN (\d+)mW", "int").alias("power_mw"), _found(line, r"tj@([\d.]+)C", "double").alias("tj"), _found(line, r"GR3D_FREQ (\d+)%", "int").alias("util_pct")]


def telemetry(line: Column, utc_offset: str = "+0000") -> Column:
    """One telemetry line as (t, ram_mb, power_mw, tj, util_pct); null unless time and memory are there, the rest may be null."""
    t, ram, *rest = telemetry_fields(line, utc_offset)
    return F.when(t.isNotNull() & ram.isNotNull(), F.struct(t, ram, *rest))


def classify(name: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Group of a name by the first rule (kind, pattern, group) that holds, kind being prefix, infix or suffix. No rule: an error."""
    test = {"prefix": name.startswith, "infix": name.contains, "suffix": name.endswith}
    out = F.raise_error(F.concat(F.lit("no rule for "), name)).cast("string")
    for kind, pattern, group in reversed(rules):
        out = F.when(test[kind](pattern), F.lit(group)).otherwise(out)
    return out


def lower_bound_ratio(a: Column, b: Column) -> Column:
    """a / b cut to two decimals and never above the true ratio; null where b is 0."""
    x, y = a.cast("decimal(18,4)"), b.cast("decimal(18,4)")
    cut = F.floor(F.try_divide(x, y) * 100).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    cut = cut.cast("decimal(20,2)")
    return F.when(cut * y <= x, cut).otherwise(cut - F.lit("0.01").cast("decimal(3,2)"))


def p50_line(line: Column) -> Column:
    """Median of a profiler's summary line 'GPU Compute Time: ... median = x ms'."""
    return _found(line, r"GPU Compute Time:.*?median = ([\d.]+) ms", "double")


def device_snapshot(line: Column) -> Column:
    """A device status line of comma-separated values."""
    return F.from_csv(line, "name string, sm_mhz int, mem_mhz int, temp_c int, power_w double, util_pct int", {"ignoreLeadingWhiteSpace": "true"})
