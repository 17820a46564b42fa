"""Order statistics: the k-th key of a table by refined counts, without sorting or moving its rows; and keyed permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may come to the driver at once, and cuts that one pass counts.
KEYS, WAYS = 4_096, 64


@dataclass(frozen=True)
class Cut:
    """A key as a literal, how many rows lie below it and how many hold it; key is null where no row is meant."""

    key: Column | None
    below: int
    equal: int


def _key(order: tuple[Column, ...]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def kth_key(df: DataFrame, k: int, *order: Column, keys: int = KEYS, ways: int = WAYS) -> Cut:
    """The k-th smallest key (k from 1; the greatest where there are fewer rows) by ``order``, nulls first.

    Each pass draws a few hundred keys of the range that holds the k-th one, counts the rows up to
    each of at most ``ways`` of them in one aggregate, and keeps the range between two; that is 64 times
    smaller in the mean, so a trillion rows need some five passes over the order's columns. The last
    ``keys`` keys come to the driver. A key that many rows share is recognised by a range of one key.
    """
    rows = df.select(_key(order).alias("o"))
    fields = rows.schema["o"].dataType.fields
    lit = lambda row: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
    total = rows.count()
    if not total or k < 1:
        return Cut(None, 0, 0)
    k = min(k, total)
    low, high, below, upto = None, None, 0, total
    part = rows
    while upto - below > keys:
        part = rows
        for bound, above in ((low, True), (high, False)):
            if bound is not None:
                part = part.filter(F.col("o") > lit(bound) if above else F.col("o") <= lit(bound))
        drawn = part.filter(F.rand(7) < 8.0 * ways / (upto - below)).select("o").distinct().orderBy("o").limit(64 * ways).collect()
        ends = [r.o for r in (*drawn, part.agg(F.max("o").alias("o")).first())]
        ends = list(dict.fromkeys(ends[:: max(1, len(ends) // ways)] + ends[-1:]))
        counts = [below + n for n in part.agg(*[F.count_if(F.col("o") <= lit(e)).alias(f"n{i}") for i, e in enumerate(ends)]).first()]
        at = next(i for i, n in enumerate(counts) if n >= k)
        before, after = (counts[at - 1] if at else below), counts[at]
        single = part.filter(F.col("o") == lit(ends[at])).count()
        if before + single == after or k > after - single:  # the range's last key is the one
            return Cut(lit(ends[at]), after - single, single)
        # what is left lies below that key
        low, high, below, upto = (ends[at - 1] if at else low), ends[at], before, after
    part = rows
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            part = part.filter(F.col("o") > lit(bound) if above else F.col("o") <= lit(bound))
    left = [r.o for r in part.orderBy("o").collect()]  # keys at most
    key = left[k - below - 1]
    return Cut(lit(key), below + left.index(key), left.count(key))


def up_to(cut: Cut, *order: Column) -> Column:
    """Whether a row's key lies at the cut or below."""
    return F.lit(False) if cut.key is None else _key(order) <= cut.key


def first_rows(df: DataFrame, k: int, *order: Column, keys: int = KEYS) -> DataFrame:
    """Exactly the first ``k`` rows of ``df`` by ``order`` (all where there are fewer), as a filter; rows aren't moved.

    Where several rows hold the k-th key, which of them are taken is open.
    """
    cut = kth_key(df, k, *order, keys=keys)
    if cut.key is None:
        return df.limit(0)
    if cut.below + cut.equal <= k:
        return df.filter(up_to(cut, *order))
    return df.filter(_key(order) < cut.key).unionByName(df.filter(_key(order) == cut.key).limit(k - cut.below))


def permuted(number: Column, n: int, key: str, rounds: int = 6, walk: int = 120) -> Column:
    """The place of ``number`` (0 to n - 1) in a permutation of 0 to n - 1 that ``key`` names.

    An alternating Feistel network over the bits that n takes, applied again while its result is n or more
    (cycle walking): the domain is below 2 n, so each step ends with a chance of a half or more; all
    but 2**-walk of the numbers end within ``walk`` steps, and one that doesn't is an error.
    """
    bits = max(2, (max(n, 1) - 1).bit_length())
    low = bits // 2
    masks = ((1 << low) - 1, (1 << (bits - low)) - 1)

    def step(x: Column, k: Column) -> Column:
        def drawn(half: Column) -> Column:
            return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(key), k.cast("string"), half.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")

        upper, lower = F.shiftright(x, low), x.bitwiseAND(F.lit(masks[0]))
        return F.when(k % 2 == 0, x.bitwiseXOR(F.shiftleft(drawn(lower).bitwiseAND(F.lit(masks[1])), low))).otherwise(
            x.bitwiseXOR(drawn(upper).bitwiseAND(F.lit(masks[0])))
        )

    once = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a walk didn't end")).cast("long")))[0]
