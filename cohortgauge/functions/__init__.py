from cohortgauge.functions.keys import canonical_image_key, hash_hex, hash_unit, stratum_key
from cohortgauge.functions.maths import (
    log1p_exp,
    logit,
    normal_cdf,
    ratio,
    share,
    sigmoid,
    two_sided_p,
)

__all__ = [
    "canonical_image_key",
    "hash_hex",
    "hash_unit",
    "log1p_exp",
    "logit",
    "normal_cdf",
    "ratio",
    "share",
    "sigmoid",
    "stratum_key",
    "two_sided_p",
]
