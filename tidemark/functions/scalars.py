"""Scalar derivations on event columns and on probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidemark.config import EPS

# Words that mark an acute, one-off condition; one word excludes it again.
ACUTE_WORDS = (
    "fracture", "sprain", "laceration", "whiplash", "concussion", "sinusitis",
    "bronchitis", "pharyngitis", "sore throat",
)
ACUTE_EXCLUDED = "pathological"
# Fixed value: the class word a condition name may carry in brackets.
CLASS_SUFFIX = r" \((disorder|finding|situation)\)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_token(kind, code) -> Column:
    return F.concat_ws("_", _col(kind), _col(code).cast("string"))


def numeric_value(value, value_type) -> Column:
    """The value where the row is declared numeric and the text parses, else null."""
    return F.when(_col(value_type) == "numeric", _col(value).try_cast("double"))


def normalise_reason(text) -> Column:
    """Whole numbers as exact text, however long; a zero fraction is cut off, anything else is null."""
    return F.nullif(F.regexp_extract(F.trim(_col(text).cast("string")), r"^([+-]?[0-9]+)(?:\.0*)?$", 1), F.lit(""))


def first_cost(*costs) -> Column:
    present = [_col(c).try_cast("double") for c in costs]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def kind_rank(kind, order: Sequence[str]) -> Column:
    """Position of the kind in the declared order; kinds that are not declared come last."""
    pos = F.array_position(F.array(*[F.lit(k) for k in order]), _col(kind)).cast("int")
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(order)))


def clip_prob(p) -> Column:
    return F.least(F.greatest(_col(p), F.lit(EPS)), F.lit(1.0 - EPS))


def logit(p) -> Column:
    q = clip_prob(p)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def clean_name(name) -> Column:
    return F.regexp_replace(_col(name), CLASS_SUFFIX, "")


def is_acute(name) -> Column:
    low = F.lower(_col(name))
    return low.rlike("|".join(ACUTE_WORDS)) & ~low.contains(ACUTE_EXCLUDED)


def bin_of(edges, value) -> Column:
    """Number of edges at or below the value."""
    value = _col(value)
    return F.size(F.filter(_col(edges), lambda e: e <= value))


def tidy(x, digits: int = 6) -> Column:
    """Rounded for reporting, with negative zero folded into zero."""
    return F.round(_col(x), digits) + F.lit(0.0)


def as_day(ts) -> Column:
    return _col(ts).cast("date").cast("string")
