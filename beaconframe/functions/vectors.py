"""Vector expressions over array columns, evaluated in double precision in the JVM.

Null vectors give null.  Vectors without components give null pools and a norm of 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def _divided(v: Column, n: Column) -> Column:
    """Each component over ``n``, which is evaluated once; inside a lambda it would be for each component."""
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, y: x / y)


def l2_normalize(v: Column | str, eps: float = EPS) -> Column:
    """v / max(|v|, eps): a zero vector stays zero."""
    return _divided(_col(v), F.greatest(norm(v), F.lit(eps)))


def l2_normalize_additive(v: Column | str, eps: float = EPS) -> Column:
    """v / (|v| + eps)."""
    return _divided(_col(v), norm(v) + F.lit(eps))


def masked_mean_pool(hidden: Column | str, mask: Column | str | None = None) -> Column:
    """The mean of the token vectors with mask 1, over max(sum of the mask, 1e-6); the plain mean for a null mask."""
    h = _col(hidden)
    m = F.coalesce(_col(mask), F.transform(h, lambda _: F.lit(1))) if mask is not None else F.transform(h, lambda _: F.lit(1))
    m = m.cast("array<double>")
    weight = F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), F.lit(1e-6))
    zero = F.transform(F.element_at(h, 1), lambda x: x * 0.0)
    total = F.aggregate(F.arrays_zip(h.alias("h"), m.alias("m")), zero, lambda s, t: F.zip_with(s, t["h"], lambda a, x: a + x * t["m"]))
    return F.transform(total, lambda x: x / weight)


def cls_pool(hidden: Column | str) -> Column:
    return F.try_element_at(_col(hidden), F.lit(1))


def last_token_pool(hidden: Column | str, mask: Column | str | None = None) -> Column:
    """The vector of the last token with mask 1, wherever the padding is; the last of all for a null mask."""
    h = _col(hidden)
    if mask is None:
        return F.try_element_at(h, F.lit(-1))
    places = F.filter(F.transform(_col(mask), lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull())
    return F.try_element_at(h, F.coalesce(F.array_max(places), F.when(_col(mask).isNull(), F.size(h)), F.lit(1)).cast("int"))


def last_token_pool_right(hidden: Column | str, mask: Column | str | None = None) -> Column:
    """The vector at place sum(mask), at least the first: right for right padding only."""
    h = _col(hidden)
    if mask is None:
        return F.try_element_at(h, F.lit(-1))
    n = F.aggregate(_col(mask), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.try_element_at(h, F.coalesce(F.greatest(n, F.lit(1)), F.size(h)).cast("int"))


def process_weight(s: Column, proc: str, p: int, clamp_min: float | None) -> Column:
    """A similarity before it is normalized: clamped, and raised to ``p`` for asif."""
    if proc not in ("none", "norm", "asif"):
        raise ValueError(f"unknown proc {proc!r}")
    v = s if clamp_min is None else F.greatest(s, F.lit(float(clamp_min)))
    return F.pow(v, F.lit(float(p))) if proc == "asif" else v


#: Storage and compute precisions, with the aliases that configurations use.
PRECISIONS = {"float32": "float", "fp32": "float", "float": "float", "float64": "double", "fp64": "double", "double": "double"}


def precision(name: str) -> str:
    """The Spark element type of a precision; half formats have none."""
    kind = PRECISIONS.get(name.lower())
    if kind is None:
        raise ValueError(f"precision {name!r} isn't supported; choose from {', '.join(sorted(PRECISIONS))}")
    return kind
