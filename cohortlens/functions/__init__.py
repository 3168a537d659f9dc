from cohortlens.functions.labels import (
    classify_flags,
    map_by_contains,
    map_by_list,
    map_by_regex,
    text_flags,
)
from cohortlens.functions.numbers import abnormal_flag, bin_index, to_number_lenient
from cohortlens.functions.times import (
    age_years,
    days_between_dates,
    elapsed_days,
    elapsed_minutes,
    half_hour_bucket,
    los_days,
    shift_of,
)

__all__ = [
    "abnormal_flag",
    "age_years",
    "bin_index",
    "classify_flags",
    "days_between_dates",
    "elapsed_days",
    "elapsed_minutes",
    "half_hour_bucket",
    "los_days",
    "map_by_contains",
    "map_by_list",
    "map_by_regex",
    "shift_of",
    "text_flags",
    "to_number_lenient",
]
