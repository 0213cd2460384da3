from fumarole.functions.hashing import key_bits
from fumarole.functions.maths import (
    back_transform,
    clip,
    confidence_band,
    floor_at,
    null_nan,
    residual,
    round_even,
    safe_divide,
    safe_log1p,
    share_of,
)
from fumarole.functions.text import company_key, country_code, strip

__all__ = [
    "back_transform", "clip", "company_key", "confidence_band", "country_code", "floor_at",
    "key_bits", "null_nan", "residual", "round_even", "safe_divide", "safe_log1p",
    "share_of", "strip",
]
