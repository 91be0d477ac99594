"""Dense-vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def blank_to_zero(term, vec, dim: int) -> Column:
    """A blank term (``''``) or a term without a vector gets ``dim`` zeros."""
    z = zero_vector(dim)
    return F.when(_c(term) == "", z).otherwise(F.coalesce(_c(vec), z))


def last_layer(layers, index: int = 2) -> Column:
    """Pick layer ``index`` (0-based) of a layered encoding."""
    return F.element_at(_c(layers), index + 1)


def first_token(encoding) -> Column:
    """``e[0][0]``: first token vector of the first sentence."""
    return F.element_at(F.element_at(_c(encoding), 1), 1)


def concat_vectors(cols) -> Column:
    """Concatenate vectors in the order given."""
    return F.concat(*[_c(c) for c in cols])


def reshape3(c, d0: int, d1: int, d2: int) -> Column:
    """Reshape a flat vector of d0*d1*d2 floats into nested arrays."""
    v = _c(c)
    return F.transform(
        F.sequence(F.lit(0), F.lit(d0 - 1)),
        lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(d1 - 1)),
            lambda j: F.slice(v, i * (d1 * d2) + j * d2 + 1, F.lit(d2))))
