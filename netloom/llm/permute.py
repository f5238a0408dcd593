"""A keyed permutation of 0 to n - 1 as a Spark column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUNDS = 4
_STEPS = 48


def feistel(index: Column, n: Column, key: Column) -> Column:
    """Where a keyed Feistel network sends index, walked along its cycle until the result is below n.

    The network adds hashes of one half to the other, modulo a and b, the least integers with a = ceil(sqrt(n)) and
    a * b >= n. Fewer than a of its values lie outside, so a walk of more than a few steps is rare: 48 steps always
    suffice up to n = 2,300 (there are fewer values outside than steps), and beyond fail with chance under 1e-80.
    """
    a = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")
    b = F.greatest(F.when(a * b < n, b + 1).otherwise(b), F.lit(1).cast("long"))

    def once(x: Column) -> Column:
        left, right = F.call_function("div", x, b), F.pmod(x, b)
        for r in range(0, _ROUNDS, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(key, F.lit(r), right), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(key, F.lit(r + 1), left), b), b)
        return left * b + right

    first = once(index)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)
