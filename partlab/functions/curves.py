"""Space-filling curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import InvalidOrder
from .numeric import scale_factor

# For each state and quadrant (2 x + y): the quadrant's place on the curve, the state inside it.
_PLACE_2D, _NEXT_2D = "0132" "0312" "2310" "2130", "1030" "0211" "2123" "3302"
# For each state and octant (4 x + 2 y + z), likewise.
_PLACE_3D = "013276452534160747305621231054670374126543527061071634252156304745763201651274036170524367541023"
_NEXT_3D = "64345939836683979b9366aa202a7071078766aaaa0b970b420b110b55114b43b4a4b919551102828342835526287578"


def _digits(text: str) -> Column:
    return F.array(*[F.lit(int(c, 16)) for c in text])


def to_grid(x: Column, lo: float, hi: float, order: int) -> Column:
    """[lo, hi] to 0 ... 2**order - 1; an empty interval to 0."""
    f = scale_factor(hi - lo, order)
    return (F.lit(f) * (x - F.lit(lo))).cast("bigint")


def _walk(octant: list[Column], order: int, place: str, following: str) -> Column:
    """Index along a curve: level by level from the coarsest, carrying the state."""
    d = len(octant)
    places, states = _digits(place), _digits(following)
    bit = lambda c, i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1).cast("bigint")).cast("int")

    def step(acc: Column, i: Column) -> Column:
        at = acc["state"] * (1 << d) + sum((bit(c, i) * (1 << (d - 1 - k)) for k, c in enumerate(octant)), F.lit(0)) + 1
        return F.struct((acc["h"] * (1 << d) + F.element_at(places, at)).alias("h"), F.element_at(states, at).alias("state"))

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def hilbert_2d(x: Column, y: Column, order: int) -> Column:
    """BIGINT index of a grid cell; orders 1 to 31 (62 bits)."""
    if not 1 <= order <= 31:
        raise InvalidOrder(f"order {order}: 1 to 31 can be held in 64 signed bits")
    return _walk([x, y], order, _PLACE_2D, _NEXT_2D)


def hilbert_3d(x: Column, y: Column, z: Column, order: int) -> Column:
    """BIGINT index of a grid cell; orders 1 to 20 and 21 (63 bits)."""
    if not 1 <= order <= 21:
        raise InvalidOrder(f"order {order}: 1 to 21 can be held in 64 bits")
    return _walk([x, y, z], order, _PLACE_3D, _NEXT_3D)


def z_order(coords: list[Column], p_min: list[float], p_max: list[float], order: int) -> Column:
    """BIGINT of ``order`` octants, the coarsest first; bit i of an octant is set iff
    coordinate i is over the cell's centre. D * order must be 62 at most."""
    d = len(coords)
    if not 1 <= order or d * order > 62:
        raise InvalidOrder(f"order {order} in {d} dimensions doesn't fit 62 bits")

    def step(acc: Column, _: Column) -> Column:
        mid = [(acc[f"l{i}"] + acc[f"h{i}"]) / 2 for i in range(d)]
        over = [acc[f"x{i}"] > mid[i] for i in range(d)]
        octant = sum((F.when(over[i], 1 << i).otherwise(0) for i in range(d)), F.lit(0))
        ends = [c for i in range(d) for c in (acc[f"x{i}"].alias(f"x{i}"), F.when(over[i], mid[i]).otherwise(acc[f"l{i}"]).alias(f"l{i}"), F.when(over[i], acc[f"h{i}"]).otherwise(mid[i]).alias(f"h{i}"))]
        return F.struct((acc["key"] * (1 << d) + octant).cast("bigint").alias("key"), *ends)

    start = F.struct(F.lit(0).cast("bigint").alias("key"), *[c for i in range(d) for c in (coords[i].cast("double").alias(f"x{i}"), F.lit(float(p_min[i])).alias(f"l{i}"), F.lit(float(p_max[i])).alias(f"h{i}"))])
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step, lambda acc: acc["key"])
