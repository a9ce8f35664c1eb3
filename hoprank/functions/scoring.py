"""Hybrid score parts as column expressions.

All of them are plain Catalyst expressions, so they fuse into the
surrounding whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's (final version; first version in brackets)
ABV_ALPHA = 0.05        # penalty weight (0.03 in the first version)
ZERO_ABV_WEIGHT = 2.0   # penalty for a zero-alcohol wish: -2 * abs(abv)
STYLE_BONUS = 0.05      # bonus for a subgenre match (0.1 in the first version)
CF_EPS = 1e-8           # added to the sum of absolute similarities
BETA_BASE, BETA_SPAN = 0.55, 0.45       # beta = 0.55 + 0.45 / (1 + ln n)
BETA_LINEAR_BASE, BETA_LINEAR_SLOPE = 0.6, 0.004   # beta = 0.6 + 0.004 * percent of zero predictions
FIXED_BETA = 0.85       # fixed-weight set-up: 0.85 text, 0.15 CF


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def penalty_shape(diff: Column, want: Column, kind: str) -> Column:
    """H1/H3 shapes of the abv distance (before the minus sign and alpha)."""
    a = F.abs(diff)
    shapes = {
        "scaled_square": diff * diff / (F.pow(want, 1.5) + 1),
        "square": diff * diff,
        "linear": diff,
        "log": F.log1p(a),
        "log_scaled": F.log1p(a / want),
        "linear_scaled": a / want,
    }
    return shapes[kind]


def wish_given(want: Column, zero_is_wish: bool) -> Column:
    """Whether an abv wish is present.  The final version tests the wish for
    truth, so a wish of 0 counts as none; ``zero_is_wish`` gives the variant
    where 0 asks for an alcohol-free item."""
    return want.isNotNull() if zero_is_wish else (want.isNotNull() & (want != 0))


def abv_penalty(abv, want, kind: str = "scaled_square", alpha: float = ABV_ALPHA,
                zero_is_wish: bool = False) -> Column:
    abv, want = _c(abv), _c(want)
    given = wish_given(want, zero_is_wish)
    return (F.when(~given, F.lit(0.0))
            .when(want == 0, -ZERO_ABV_WEIGHT * F.abs(abv - want))
            .otherwise(-F.lit(alpha) * penalty_shape(abv - want, want, kind)))


def abv_diff(abv, want, zero_is_wish: bool = False) -> Column:
    """H4: absolute distance to the wish, 0 without a wish."""
    abv, want = _c(abv), _c(want)
    return F.when(wish_given(want, zero_is_wish), F.abs(abv - want)).otherwise(F.lit(0.0))


def style_bonus(subgenre, want, weight: float = STYLE_BONUS) -> Column:
    """H5: bonus when the item's subgenre equals a non-empty wish."""
    subgenre, want = _c(subgenre), _c(want)
    hit = want.isNotNull() & (want != "") & (subgenre == want)
    return F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))


def beta_log(n) -> Column:
    """weight of the text score from the user's activity; n=0 -> 0.55."""
    n = _c(n).cast("double")
    return F.when(n > 0, BETA_BASE + BETA_SPAN / (1 + F.log(n))).otherwise(F.lit(BETA_BASE))


def beta_linear(zero_pct) -> Column:
    """F16: beta from the share (in percent) of zero predictions."""
    return BETA_LINEAR_BASE + BETA_LINEAR_SLOPE * _c(zero_pct)


def hybrid_score(text_score, cf_score, beta, abv_weight, bonus) -> Column:
    """H6: beta * text + (1 - beta) * cf + abv penalty + style bonus."""
    beta = _c(beta)
    return beta * _c(text_score) + (1 - beta) * _c(cf_score) + _c(abv_weight) + _c(bonus)
