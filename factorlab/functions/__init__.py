from factorlab.functions.nulls import finite, gated_avg, masked_last, ratio
from factorlab.functions.stats import (
    hash_int,
    normal_two_sided_p,
    significance_stars,
    student_two_sided_p,
)

__all__ = [
    "finite",
    "gated_avg",
    "hash_int",
    "masked_last",
    "normal_two_sided_p",
    "ratio",
    "significance_stars",
    "student_two_sided_p",
]
