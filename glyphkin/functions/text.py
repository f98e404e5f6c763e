"""Names, signatures and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def best_label(scores: Column) -> Column:
    """The label of the largest score in a map; the first in alphabetical order on ties, `?` for none."""
    entries = F.array_sort(F.map_entries(scores), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return F.coalesce(F.get(entries, F.lit(0))["key"], F.lit("?"))


def signature_pattern(signature: Column) -> Column:
    """The catalogue signature as a LIKE pattern for file names, its own `%`, `_` and `\\` taken literally."""
    plain = F.replace(signature, F.lit("/"), F.lit("-"))
    escaped = F.regexp_replace(plain, r"([\\%_])", r"\\$1")
    # ? stands for one character, as in file patterns
    return F.concat(F.lit("%"), F.replace(F.replace(escaped, F.lit("?"), F.lit("_")), F.lit("*"), F.lit("%")), F.lit(".pdf"))


def short_name(name: Column, mode: str = "last_word", names: dict[str, str] | None = None) -> Column:
    """A printer's display name: by table, else the last word, else as it is."""
    words = F.split(F.trim(name), r"\s+")
    rule = F.when(F.trim(name) == "", name).otherwise(F.element_at(words, -1)) if mode == "last_word" else name
    if not names:
        return rule
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.get(F.array(F.try_element_at(table, name)), F.lit(0)), rule)


def normal_remark(printer: Column, remark: Column) -> Column:
    """`known` where a known printer has no remark or a hidden one; `nan` for no remark."""
    remark = F.coalesce(remark, F.lit("nan"))
    remark = F.when((printer != "unknown") & (remark == "nan"), F.lit("known")).otherwise(remark)
    return F.when(remark == "hidden", F.lit("known")).otherwise(remark)


def printer_or_unknown(printer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(printer), F.lit("")), F.lit("unknown"))


def rounded_dpi(median: Column, step: int = 50, fallback: int = 150) -> Column:
    """A resolution rounded (half to even) to steps, one step at least; the fallback for none."""
    rounded = F.greatest((F.rint(median / step) * step).cast("int"), F.lit(step))
    return F.when(median.isNotNull(), rounded).otherwise(F.lit(fallback))


def resize_scale(target: Column, original: Column, tolerance: float = 0.01) -> Column:
    """target / original, or 1 where resizing would change next to nothing."""
    scale = target / original
    return F.when(F.abs(scale - 1) > tolerance, scale).otherwise(F.lit(1.0))


def network_size(height: Column, width: Column, target: int, divisor: int = 128) -> Column:
    """(h, w) of a page scaled to a target height, each rounded half to even to a multiple of the divisor."""
    scale = height / F.lit(float(target))
    fit = lambda c: (F.rint(c / scale / divisor) * divisor).cast("int")
    return F.struct(fit(height).alias("h"), fit(width).alias("w"))
