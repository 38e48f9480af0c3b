"""Facts as they were known at many cutoffs: every probe has its own two clocks.

A fact holds from one time and is known from another; a probe asks for the facts of its key that hold before its time and were known by its
cutoff. Such a question has two dimensions, and no single order answers it. The known time, in ticks, is therefore cut into dyadic ranges: a cutoff
is a union of such ranges, one for each bit that is set in it, and a fact lies in one range of each size. Facts and probes meet in a union by
(key, range), ordered by the time they hold, in which sums run and last values are carried. A fact becomes half as many rows as the
ticks have bits, and so does a probe, but only after both are shuffled by key; no probe ever meets a fact in a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import ratio
from tessera.operators.sequences import carried, running


# Rows of a key beyond which it is dealt out over several tasks, and rows that a task is given before it makes those of the ranges.
LARGE, ROWS_A_TASK = 200_000, 100_000


def day_number(at: Column) -> Column:
    """Days since 1970 as a tick."""
    return F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date"))


def _measured(both: DataFrame, keys: list[str]) -> tuple[int, int, int, list]:
    """The first known tick, the bits that their span needs, the number of rows, and the keys that are dealt out, of which there is one in LARGE rows at most; one row comes to the driver."""
    key, fact = F.struct(*keys), F.when(F.col("__kind") == 1, F.col("__tick"))
    sizes = both.groupBy(*keys).agg(F.count("*").alias("n"), F.min(fact).alias("low"), F.max(fact).alias("high"))
    low, high, n, large = sizes.agg(F.min("low"), F.max("high"), F.sum("n"), F.collect_list(F.when(F.col("n") > LARGE, key))).first()
    return (0, 1, n or 0, large) if low is None else (low, max(1, int(high - low + 1).bit_length()), n, large)


def _met(rows: DataFrame, low: int, bits: int) -> DataFrame:
    """rows, each once for each dyadic range (__node: its number times 64 and its level) that a fact lies in or a probe asks for."""
    level = F.sequence(F.lit(0), F.lit(bits))
    shifted = lambda x, j: F.call_function("shiftright", x, j)
    number = lambda j, block: block * 64 + j
    tick = F.col("__tick") - low
    # how many ticks the cutoff allows, from none to all
    allowed = F.when(F.col("__tick").isNotNull(), F.greatest(F.lit(0), F.least(tick + 1, F.lit(2**bits)))).cast("long")
    lies = F.transform(F.filter(level, lambda j: shifted(tick, j) % 2 == 0), lambda j: number(j, shifted(tick, j)))
    asked = F.transform(F.filter(level, lambda j: shifted(allowed, j) % 2 == 1), lambda j: number(j, shifted(allowed, j) - 1))
    # a probe always has a row at a place without facts, so that one that nothing answers stays
    nodes = F.when(F.col("__kind") == 1, lies).otherwise(F.concat(F.array(F.lit(-1).cast("long")), F.coalesce(asked, F.array().cast("array<bigint>"))))
    return rows.withColumn("__node", F.explode(nodes)).drop("__tick")


def as_of(
    facts: DataFrame, probes: DataFrame, keys: list[str], holds: str, known: Column, before: str, cutoff: Column, sums: dict[str, Column], values: dict[str, str], tie: str | None = None, bucket: Column | None = None
) -> DataFrame:
    """Each probe with `totals_as_of` and `last_as_of` in one: both sides are shuffled once, by key, and their rows for the ranges are made, sorted and summed up where they are.

    A key of more than LARGE rows is dealt to its ranges and, with a bucket, to buckets of them.
    """
    added = {f"__v_{k}": F.coalesce(c.cast("long"), F.lit(0)) for k, c in sums.items()}
    order = ["__at", "__kind"]
    if values:
        added["__fact"] = F.struct(F.col(holds).alias("__holds"), F.col(tie).alias("__tie"), *[F.col(old).alias(new) for old, new in values.items()])
        order.append("__t")
    others = [c for c in probes.columns if c not in keys]
    at = F.coalesce(F.col(before), F.lit("0001-01-01").cast(facts.schema[holds].dataType))  # a probe without a time is before all facts
    left = facts.filter(F.col(holds).isNotNull() & known.isNotNull()).select(*keys, F.col(holds).alias("__at"), F.lit(1).alias("__kind"), known.cast("long").alias("__tick"), *[c.alias(k) for k, c in added.items()])
    right = probes.select(*keys, at.alias("__at"), F.lit(0).alias("__kind"), cutoff.cast("long").alias("__tick"), *[F.col(c).alias(f"__p_{c}") for c in others])
    both = left.unionByName(right, allowMissingColumns=True)
    low, bits, n, large = _measured(both, keys)

    def answered(rows: DataFrame, deal: Column | None) -> DataFrame:
        met = _met(rows, low, bits)
        met = met.withColumn("__t", F.col("__fact.__tie")) if values else met
        met = running(met, [*keys, "__node"], order, {k: F.col(f"__v_{k}") for k in sums}, deal) if sums else met
        met = carried(met, [*keys, "__node"], order, "__fact", "__last", deal) if values else met
        found = [F.sum(k).alias(k) for k in sums] + ([F.max("__last").alias("__last")] if values else [])
        out = met.filter("__kind = 0").groupBy(*keys, *[f"__p_{c}" for c in others]).agg(*found)
        return out.select(*[F.col(c if c in keys else f"__p_{c}").alias(c) for c in probes.columns], *sums, *[F.col(f"__last.{new}").alias(new) for new in values.values()])

    if not large:
        return answered(both.repartition(max(1, -(-n // ROWS_A_TASK)), *keys), None)
    hubs = F.broadcast(facts.sparkSession.createDataFrame(large, facts.select(*keys).schema))
    same = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
    of = lambda how: both.alias("__l").join(hubs.alias("__r"), same, how)
    return answered(of("left_anti").repartition(max(1, -(-n // ROWS_A_TASK)), *keys), None).unionByName(answered(of("left_semi"), bucket))


def totals_as_of(
    facts: DataFrame, probes: DataFrame, keys: list[str], holds: str, known: Column, before: str, cutoff: Column, sums: dict[str, Column], bucket: Column | None = None
) -> DataFrame:
    """Each probe with sums over the facts of its key that hold strictly before `before` and were known at tick `cutoff` or earlier.

    `known` and `cutoff` are ticks (integers). A fact without a time or a known tick is never seen; a probe without a time or a cutoff sees none. Probes
    must differ from each other. A bucket, a non-decreasing function of the column __at, deals keys of any size out, see sequences.running.
    """
    return as_of(facts, probes, keys, holds, known, before, cutoff, sums, {}, None, bucket)


def last_as_of(
    facts: DataFrame, probes: DataFrame, keys: list[str], holds: str, known: Column, before: str, cutoff: Column, values: dict[str, str], tie: str, bucket: Column | None = None
) -> DataFrame:
    """Each probe with values of the last fact of its key that holds strictly before `before` and was known at tick `cutoff` or earlier, null where there is none; `tie` orders facts of one time.

    Otherwise as `totals_as_of`.
    """
    return as_of(facts, probes, keys, holds, known, before, cutoff, {}, values, tie, bucket)


#: Prior contests beyond which experience counts in full, and the weight of the share of wins.
FULL_EXPERIENCE, WIN_WEIGHT = 30, 0.5


def entering_quality(wins: Column, losses: Column, draws: Column, contests: Column) -> Column:
    """Quality 0 to 1 of a record on entering a contest: half its share of wins among decided contests (0 without any), half its experience. Null without a record."""
    share = F.coalesce(ratio(wins, wins + losses + draws), F.when(contests.isNotNull(), 0.0))
    return WIN_WEIGHT * share + (1 - WIN_WEIGHT) * F.least(contests, F.lit(FULL_EXPERIENCE)) / FULL_EXPERIENCE
