"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised by quantiles of its values, so each cell range holds about as
many rows; the cells' index along the Hilbert curve orders the rows, and runs of that
order become shards of equal row counts. Rows that are near in all dimensions are
near on the curve, so a shard covers a small box and file statistics prune on every
dimension. Equal texts take the place of their lowest row, so a group of copies stays
together and is split only where a cut falls inside it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.session import broadcast_within, via_table


def value_bounds(rows: DataFrame, name: str, parts: int) -> list[str]:
    """Strings that cut the rows of a column, in order of value, into ``parts`` of about equal size.

    Distinct values are counted and sorted by ranges; a running count per range, and one row
    per range for what lies before it, tell which value each cut falls on. Nulls do not count.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ordered = via_table(
        counts.repartitionByRange(spread, "value")
        .sortWithinPartitions("value")
        .select("value", "n", F.monotonically_increasing_id().alias("row")),
        "values",
    ).withColumn("part", F.shiftright("row", 33))
    sums = ordered.groupBy("part").agg(F.sum("n").alias("here"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per range of the sort.
    bases = sums.select(
        "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"), F.sum("here").over(everything).alias("total")
    )
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("row"))
    placed = ordered.join(F.broadcast(bases), "part").withColumn("upto", upto)
    after, until = F.floor(F.col("upto") * parts / F.col("total")), F.floor((F.col("upto") - F.col("n")) * parts / F.col("total"))
    cuts = placed.where((after > until) & (until < parts - 1)).select("value").collect()  # at most one per cut
    return sorted((r.value for r in cuts), key=lambda v: v.encode())


def quantised(column: Column, bounds: list[float] | list[str]) -> Column:
    """Number of ``bounds`` (ascending) at or below the value; a null is below all."""
    if not bounds:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= column)).cast("long")


def _bit(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level).bitwiseAND(1)


def _below(level: Column) -> Column:
    """All bits below a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _turned(state: Column, level: Column, i: int, n: int) -> Column:
    """Where dimension ``i`` has its bit set, invert the lower bits of the first, else swap."""
    others = [state[j] for j in range(1, n)]
    inverted = F.array(state[0].bitwiseXOR(_below(level)), *others)
    if i == 0:
        return F.when(_bit(state[0], level) == 1, inverted).otherwise(state)
    differ = state[0].bitwiseXOR(state[i]).bitwiseAND(_below(level))
    swapped = [state[j].bitwiseXOR(differ) if j in (0, i) else state[j] for j in range(n)]
    return F.when(_bit(state[i], level) == 1, inverted).otherwise(F.array(*swapped))


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point with ``bits`` bits in each dimension.

    Works on the transposed form: from the highest bit down, a dimension whose bit is set
    inverts the lower bits of the first one, any other swaps them with the first; then
    the dimensions are Gray-encoded and their bits interleaved.
    """
    n = len(cells)
    upper = F.array(*[F.lit(level) for level in range(bits - 1, 0, -1)]).cast("array<int>")
    every = F.array(*[F.lit(level) for level in range(bits - 1, -1, -1)])

    def turn(state: Column, level: Column) -> Column:
        def by(i: int):
            return lambda s: _turned(s, level, i, n)

        for i in range(n):
            state = _let(state, by(i))
        return state

    def gray(state: Column) -> Column:
        coded = [state[0]]
        for i in range(1, n):
            coded.append(coded[-1].bitwiseXOR(state[i]))
        return F.array(*coded)

    def flips(state: Column) -> Column:
        """Lower bits to flip: those below every set bit of the last dimension."""
        return F.aggregate(
            upper,
            F.lit(0).cast("long"),
            lambda t, level: F.when(_bit(state[n - 1], level) == 1, t.bitwiseXOR(_below(level))).otherwise(t),
        )

    def woven(state: Column) -> Column:
        return F.aggregate(
            every,
            F.lit(0).cast("long"),
            lambda index, level: F.aggregate(state, index, lambda i, x: i * 2 + _bit(x, level)),
        )

    start = F.array(*[c.cast("long") for c in cells])
    coded = _let(F.aggregate(upper, start, turn), gray)
    flipped = _let(coded, lambda s: _let(flips(s), lambda t: F.transform(s, lambda x: x.bitwiseXOR(t))))
    return _let(flipped, woven)


def hilbert_shards(
    rows: DataFrame,
    dimensions: dict[str, Column],
    shards: int = 16,
    bits: int = 5,
    group: str | None = None,
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1), ``slot`` (gapless from 0) and ``curve``.

    ``dimensions`` are columns of numbers, or of strings, which are taken whole in the order of
    their UTF-8 bytes; null counts as the lowest. ``group`` names a
    column whose equal values lie together; ``tie`` orders rows of one place.
    Shard counts differ by one row at most, also with fewer rows than shards; no rows give
    an empty table.
    """
    names = [f"__d{i}" for i in range(len(dimensions))]
    numbered = rows.select("*", *[c.alias(n) for n, c in zip(names, dimensions.values())])
    text = {n for n in names if numbered.schema[n].dataType.typeName() == "string"}
    numbered = numbered.withColumns({n: F.col(n).cast("double") for n in names if n not in text})
    numbered = via_table(numbered, "dimensions")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = numbered.agg(
        F.lit(0), *[F.percentile_approx(n, steps, 10_000).alias(n) for n in names if n not in text]
    ).first()
    bounds = {n: value_bounds(numbered, n, 1 << bits) if n in text else sorted(set(cuts[n] or [])) for n in names}
    cells = [quantised(F.col(n), bounds[n]) for n in names]
    placed = numbered.withColumn("curve", hilbert_index(cells, bits)).drop(*names)
    if group is not None:
        lead = placed.groupBy(group).agg(F.min("curve").alias("__lead"), F.count("*").alias("__copies"))
        # Only groups of two or more rows need to be told where their lowest row lies.
        lead = broadcast_within(via_table(lead.where("__copies > 1").drop("__copies"), "leads"))
        placed = placed.join(lead, group, "left").withColumn("curve", F.coalesce("__lead", "curve")).drop("__lead")
    keys = ["curve", *([group] if group is not None else []), *tie]
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = via_table(
        placed.repartitionByRange(spread, *keys)
        .sortWithinPartitions(*keys)
        .select("*", F.monotonically_increasing_id().alias("__row")),
        "ordered",
    )
    # The written id has the partition in its upper bits and the row in it below.
    ordered = ordered.withColumn("__part", F.shiftright("__row", 33))
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per partition of the sort.
    bases = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(everything).alias("__all")
    )
    rank = F.col("__base") + F.col("__row").bitwiseAND((1 << 33) - 1)
    shard = F.floor(((rank + 1) * shards - 1) / F.col("__all"))
    first = F.floor(shard * F.col("__all") / shards)
    return (
        ordered.join(F.broadcast(bases), "__part")
        .withColumns({"shard": shard.cast("int"), "slot": (rank - first).cast("long")})
        .drop("__part", "__row", "__base", "__all")
    )
