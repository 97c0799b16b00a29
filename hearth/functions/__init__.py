"""Column expressions: cleaning, rounding and index formulas."""

from .numeric import (clip, exact_mean, falsy_to, mean_round_half_up, nonzero,
                      round_half_even, round_half_up, to_int, to_num)
from .clean import (clean_county, extract_zip, fuzzy_key, state_abbreviation,
                    state_from_county_name, strip_state_suffix, upper_trim, zfill5)

__all__ = [
    "clip", "exact_mean", "falsy_to", "mean_round_half_up", "nonzero",
    "round_half_even", "round_half_up", "to_int", "to_num", "clean_county",
    "extract_zip", "fuzzy_key", "state_abbreviation", "state_from_county_name",
    "strip_state_suffix", "upper_trim", "zfill5",
]
