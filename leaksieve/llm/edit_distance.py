"""Banded bit-parallel edit distance of two strings, with built-in expressions only.

Common beginnings and ends are cut off first, and a pair that can't be near by what is left goes. Of the rest, the longer string runs down and the other across the matrix
of distances; a word of 2 * edits + 1 bits holds the vertical differences along the band around the diagonal, and one
character of the shorter string moves all of it by a few word operations. Cells outside the band are taken as one more than
their neighbour inside, which never lies below the truth, so distances up to ``edits`` are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(most: Column) -> Column:
    """Halving steps that find any length up to most (below 2 ** 24)."""
    powers = [F.lit(1 << k) for k in range(23, -1, -1)]
    return F.when(most < 256, F.array(*powers[-8:])).otherwise(F.array(*powers))


def common_start(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning of two strings that have ``most`` characters at least."""
    step = lambda at, k: F.when((at + k <= most) & (F.substring(a, at + 1, k) == F.substring(b, at + 1, k)), at + k).otherwise(at)
    return F.aggregate(_steps(most), F.lit(0), step)


def common_end(a: Column, b: Column, na: Column, nb: Column, most: Column) -> Column:
    same = lambda at, k: F.substring(a, na - at - k + 1, k) == F.substring(b, nb - at - k + 1, k)
    step = lambda at, k: F.when((at + k <= most) & same(at, k), at + k).otherwise(at)
    return F.aggregate(_steps(most), F.lit(0), step)


def _may_be_near(a: Column, b: Column, at: Column, ra: Column, rb: Column, edits: int) -> Column:
    """What follows for the middles (at, ra and rb characters long) from the cut: both ends of an alignment are edits.

    With two edits to spend, all between the first and the last character of the middles must then be equal, at one of the
    places where replacing, deleting or inserting at either end leaves it.
    """
    if edits != 2:
        return F.lit(True)
    ways = ((1, 1), (1, 0), (0, 1))
    inner = lambda i, k, j, m: (ra - i - j == rb - k - m) & (F.substring(a, at + i + 1, ra - i - j) == F.substring(b, at + k + 1, rb - k - m))
    return reduce(lambda x, y: x | y, (inner(i, k, j, m) for i, k in ways for j, m in ways))


def _banded(longer: Column, shorter: Column, edits: int) -> Column:
    """Distance of two arrays of characters; above ``edits`` it may be any number above it."""
    width, mask = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    bit = lambda r: F.lit(1 << r).cast("int")
    equal = lambda c, j: sum((F.when(F.get(longer, j + (r - edits)) == c, bit(r)).otherwise(0) for r in range(width)), F.lit(0))

    def moved(state: Column, diagonal: Column) -> Column:
        """State after a column: diagonal has a bit where a cell equals its neighbour up and to the left."""
        across = F.lit(1).bitwiseOR(F.shiftleft(state["vn"].bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(state["vp"]))), 1))  # plus one, a row down

        def out(plus: Column) -> Column:
            up = F.shiftleft(diagonal.bitwiseAND(state["vp"]), 1).bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(plus))).bitwiseAND(F.lit(mask))
            down = diagonal.bitwiseAND(plus).bitwiseAND(F.lit(mask))
            # the band goes a row down with the next column
            return F.struct(
                F.shiftright(up, 1).bitwiseOR(bit(width - 1)).alias("vp"),
                F.shiftright(down, 1).alias("vn"),
                (state["distance"] + 1 - F.shiftright(diagonal, edits).bitwiseAND(F.lit(1))).alias("distance"),
                (state["at"] + 1).alias("at"),
            )

        return let(across, out)

    def diagonal_of(state: Column, char: Column) -> Column:
        x = equal(char, state["at"]).bitwiseOR(state["vn"])
        return let(x, lambda x: (x.bitwiseAND(state["vp"]) + state["vp"]).bitwiseXOR(state["vp"]).bitwiseOR(x).bitwiseAND(F.lit(mask)))

    def step(state: Column, char: Column) -> Column:
        # the last rows give back ``edits`` at most of what the diagonal has
        return F.when(state["distance"] > 2 * edits, state).otherwise(let(diagonal_of(state, char), lambda d: moved(state, d)))

    start = F.struct(F.lit(mask - (1 << edits) + 1).alias("vp"), F.lit((1 << edits) - 1).alias("vn"), F.lit(0).alias("distance"), F.lit(0).alias("at"))
    rest = F.size(longer) - F.size(shorter)  # rows below the diagonal's end
    below = F.call_function("shiftleft", F.lit(1), rest) - 1
    ones = lambda x: F.bit_count(F.shiftright(x, edits).bitwiseAND(below))
    return F.aggregate(shorter, start, step, lambda s: s["distance"] + ones(s["vp"]) - ones(s["vn"]))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` edits apart (insert, delete or replace a character)."""
    na, nb = F.length(a), F.length(b)

    def between(at: Column) -> Column:
        """Whether the middles are near, the common beginning being known."""
        end = common_end(a, b, na, nb, F.least(na, nb) - at)

        def judged(tail: Column) -> Column:
            ra, rb = na - at - tail, nb - at - tail
            ma, mb = F.split(F.substring(a, at + 1, ra), ""), F.split(F.substring(b, at + 1, rb), "")
            sides = F.when(ra >= rb, F.struct(ma.alias("longer"), mb.alias("shorter"))).otherwise(F.struct(mb.alias("longer"), ma.alias("shorter")))
            exact = let(sides, lambda s: _banded(s["longer"], s["shorter"], edits) <= edits)
            hopeless = (F.least(ra, rb) == 0) | ~_may_be_near(a, b, at, ra, rb, edits)
            return F.when(F.greatest(ra, rb) <= edits, True).when(hopeless, False).otherwise(exact)

        return let(end, judged)

    return F.when(F.abs(na - nb) > edits, False).otherwise(let(common_start(a, b, F.least(na, nb)), between))
