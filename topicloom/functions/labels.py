"""Labels of one fix record held in a variant: where it was fixed, what triggered it, what went wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_or_array(value: Column, path: str) -> Column:
    """A field that is one string or an array of strings, as a distinct array."""
    many = F.try_variant_get(value, path, "array<string>")
    one = F.try_variant_get(value, path, "string")
    return F.array_distinct(F.coalesce(many, F.array(one)))


def head(value: Column) -> Column:
    """The part before the first colon."""
    return F.split_part(value, F.lit(":"), F.lit(1))


def location_parts(locations: Column) -> Column:
    """Path parts of each fixed file. Split once: what a lambda is given is not computed again."""
    return F.transform(locations, lambda location: F.split(head(location), "/"))


def directory_level(parts: Column, level: int) -> Column:
    """Directory at a level from 1; ``.`` where the path is shorter. The last part is the file."""
    directory = F.when(F.size(parts) > level, F.get(parts, F.lit(level - 1))).otherwise(F.lit("."))
    return F.get(parts, F.lit(0)) if level == 1 else directory


def _location_labels(parts: Column) -> Column:
    first, second, third = (directory_level(parts, level) for level in (1, 2, 3))
    return F.array_compact(
        F.array(
            F.concat(F.lit("fixedloc:"), first),
            F.concat(F.lit("fixedsubloc-"), first, F.lit(":"), second),
            F.when(F.size(parts) > 2, F.concat(F.lit("fixedsubsubloc-"), first, F.lit("-"), second, F.lit(":"), third)),
        )
    )


def _error_labels(error: Column) -> Column:
    # colons at the end part nothing; an empty part before another one stays empty
    parts = F.split(F.regexp_replace(error, ":+$", ""), ":")
    detail = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.lit("None"))
    return F.array_compact(
        F.array(
            F.concat(F.lit("error:"), head(error)),
            F.when(head(error) == "crash", F.concat(F.lit("crash:"), detail)),
        )
    )


def fix_labels(fix: Column) -> Column:
    """Distinct labels of a fix; a build failure has only its class. Error classes are joined later."""
    site = head(F.try_variant_get(fix, "$.when", "string"))
    locations = string_or_array(fix, "$.fix")
    triggers = string_or_array(fix, "$.if")
    errors = string_or_array(fix, "$.errors")
    trigger_labels = F.transform(
        triggers, lambda t: F.concat(F.lit("trigger:"), F.when(t == "", F.lit("None")).otherwise(head(t)))
    )
    bug = F.concat(
        F.array(F.lit("fixclass:bug"), F.concat(F.lit("failuresite:"), site)),
        F.flatten(F.transform(location_parts(locations), _location_labels)),
        trigger_labels,
        F.flatten(F.transform(errors, _error_labels)),
    )
    return F.array_distinct(F.when(site == "build", F.array(F.lit("fixclass:build"))).otherwise(bug))
