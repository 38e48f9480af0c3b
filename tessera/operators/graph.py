"""Career graphs: whether an appearance under a name is a known person, told by the person's other contests, and bindings that unlock each other.

Appearances: app_id, event_id, date, commission, venue, hometown, weight, debut, opponent_id (null while unknown), bout_id, bout_order, may_create. Contests of known persons: entity_id, bout_id, event_id,
date, complete, commission, venue, opponent_id, weight, bout_order. Pairs: app_id and entity_id with the name evidence of `resolution.name_evidence`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import names as nm
from tessera.sources.shared import cut

# Days within which contests are at one time or close, days and pounds of comparable weights, kinds of support that a match without continuity needs.
SAME_FIGHT_DAYS, SIMULTANEOUS_DAYS, CLOSE_DAYS, WEIGHT_DAYS = 1, 2, 13, 400
NEEDED, ONE_OF = ["hometown", "weight"], ["jurisdiction", "venue", "opponent_graph"]
EXACT_FORMS = ["exact", "reordered", "joined"]
# Signs for a person, against one and those that rule one out, in the order in which they are told.
FAMILIES = ["hometown", "jurisdiction", "opponent_graph", "venue", "weight"]
SOFT = ["suffix_missing", "hometown_different_city", "possible_duplicate_event", "fought_within_13_days", "weight_incompatible"]
HARD = ["suffix_conflict", "candidate_is_the_opponent", "simultaneous_event_elsewhere", "debut_after_recorded_bout"]
#: Appearances and persons of one name beyond which it is dealt to tiles, and pairs that a task is given.
TILE, PAIRS_A_TASK = 1_000, 500_000


def city(hometown: Column) -> Column:
    """A hometown that names a place and where it lies, folded; null for a country or state alone."""
    parts = F.filter(F.transform(F.split(F.lower(hometown), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(parts, ", "))


def evidence(pairs: DataFrame, appearances: DataFrame, bouts: DataFrame, hometowns: DataFrame) -> DataFrame:
    """pairs with families, soft and hard signs, same_fight, repeat_pairing, tier (A to D) and confidence.

    An appearance meets a person's contests by time: dealt to buckets of WEIGHT_DAYS, so that a person with many contests is no hub. What may lie at any
    time (a place, a commission or an opponent met before) comes from counts of each person's, less what is the same event or fight.
    """
    col, no = F.col, F.lit(False)
    a = appearances.select("app_id", *[col(c).alias(f"a_{c}") for c in appearances.columns if c != "app_id"])
    p = pairs.join(a, "app_id")
    bucket = lambda d: F.floor(F.date_diff(d, F.lit("1970-01-01").cast("date")) / WEIGHT_DAYS)
    asked = p.select("app_id", "entity_id", *[f"a_{c}" for c in ("event_id", "date", "commission", "venue", "opponent_id", "bout_id", "bout_order")]).withColumn("__b", F.explode(F.array(*[bucket(col("a_date")) + i for i in (-1, 0, 1)])))
    met = asked.join(bouts.withColumn("__b", bucket(col("date"))), ["entity_id", "__b"]).withColumn("days", F.abs(F.date_diff("date", "a_date"))).filter(col("days") <= WEIGHT_DAYS)
    true = lambda c: F.coalesce(c, no)
    same_event = true(col("event_id") == col("a_event_id"))
    one_fight = true(col("opponent_id") == col("a_opponent_id")) & (col("days") <= SAME_FIGHT_DAYS)
    again = one_fight & same_event & (true(col("bout_id") != col("a_bout_id")) | true(col("bout_order") != col("a_bout_order")))
    met = met.withColumns({"fight": one_fight & ~again, "again": again, "other": ~same_event & ~one_fight})
    elsewhere = true(col("commission") != col("a_commission")) | true(col("venue") != col("a_venue"))
    at_once = col("other") & (col("days") <= SIMULTANEOUS_DAYS)
    less = lambda c: F.count_if(~col("other") & (col(c) == col(f"a_{c}"))).alias(f"less_{c}")
    near = met.groupBy("app_id", "entity_id").agg(
        F.bool_or("fight").alias("same_fight"), F.bool_or("again").alias("repeat_pairing"), F.bool_or(at_once & elsewhere).alias("elsewhere"), F.bool_or(at_once & ~elsewhere).alias("twice"),
        F.bool_or(col("other") & (col("days") > SIMULTANEOUS_DAYS) & (col("days") <= CLOSE_DAYS)).alias("close"), F.min_by("weight", F.when(col("other") & col("weight").isNotNull(), F.struct("days", "bout_id"))).alias("weighed"),
        less("commission"), less("venue"), less("opponent_id"),
    )
    out = p.join(near, ["app_id", "entity_id"], "left")
    for c in ("commission", "venue", "opponent_id"):
        known = bouts.filter(col(c).isNotNull()).groupBy("entity_id", col(c).alias(f"a_{c}")).agg(F.count("*").alias(f"n_{c}"))
        out = out.join(known, ["entity_id", f"a_{c}"], "left")
    first = bouts.filter("complete").groupBy("entity_id").agg(F.min("date").alias("__first"))
    towns = hometowns.select("entity_id", city(col("hometown")).alias("town")).filter("town IS NOT NULL").groupBy("entity_id").agg(F.collect_set("town").alias("towns"))
    out = out.join(first, "entity_id", "left").join(towns, "entity_id", "left")
    own_town, gap = city(col("a_hometown")), F.abs(col("a_weight") - col("weighed"))
    met_before = lambda c: F.coalesce(col(f"n_{c}"), F.lit(0)) > F.coalesce(col(f"less_{c}"), F.lit(0))
    facts = {
        "hometown": F.array_contains("towns", own_town), "jurisdiction": met_before("commission"), "opponent_graph": met_before("opponent_id"), "venue": met_before("venue"), "weight": _comparable(gap, col("a_weight")),
        "hometown_different_city": own_town.isNotNull() & col("towns").isNotNull() & ~F.array_contains("towns", own_town), "possible_duplicate_event": col("twice"), "fought_within_13_days": col("close"), "weight_incompatible": _incompatible(gap, col("a_weight")),
        "candidate_is_the_opponent": col("entity_id") == col("a_opponent_id"), "simultaneous_event_elsewhere": col("elsewhere"), "debut_after_recorded_bout": col("a_debut") & (F.date_diff("a_date", "__first") > 1),
        "same_fight": col("same_fight"), "repeat_pairing": col("repeat_pairing"), "suffix_missing": col("suffix_missing"), "suffix_conflict": col("suffix_conflict"),
    }
    out = judged(out.withColumns({k: F.coalesce(v, no) for k, v in facts.items()} | _name_marks()))
    return out.select("app_id", "entity_id", "level", _signs(FAMILIES).alias("families"), _signs(SOFT).alias("soft"), _signs(HARD).alias("hard"), "same_fight", "repeat_pairing", "tier", "confidence")


def _comparable(gap: Column, weight: Column) -> Column:
    return gap <= F.greatest(F.lit(8.0), 0.05 * weight)


def _incompatible(gap: Column, weight: Column) -> Column:
    return gap > F.greatest(F.lit(20.0), 0.12 * weight)


def _name_marks() -> dict[str, Column]:
    return {"strong": F.col("level").isin(nm.STRONG), "exact": F.col("level").isin(EXACT_FORMS) & ~F.col("given_differs") & ~F.col("suffix_missing")}


def _signs(names: list[str], of: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(F.col(of + k), k) for k in names]))


def judged(facts: DataFrame) -> DataFrame:
    """facts, a boolean column for each sign beside strong, exact, same_fight and repeat_pairing, with tier and confidence."""
    col = F.col
    n = lambda names: sum((col(k).cast("int") for k in names[1:]), col(names[0]).cast("int"))
    clear, ruled = n(SOFT) == 0, n(HARD) > 0
    supported = col(NEEDED[0]) & col(NEEDED[1]) & (col(ONE_OF[0]) | col(ONE_OF[1]) | col(ONE_OF[2]))
    tier = F.when(ruled, "D").when((col("same_fight") | col("repeat_pairing")) & col("strong") & clear, "A").when(col("exact") & clear & supported, "B").otherwise("C")
    told = F.least(F.when(tier == "B", 95).otherwise(79), 40 + F.when(col("exact"), 20).when(col("strong"), 10).otherwise(0) + n(FAMILIES) * 9 - n(SOFT) * 15)
    return facts.withColumns({"tier": tier, "confidence": F.when(tier == "D", 0).when(tier == "A", 98).otherwise(F.greatest(told, F.lit(0)))})


def decided(appearances: DataFrame, found: DataFrame) -> DataFrame:
    """(app_id, decision, tier, entity_id, confidence, reason, candidates): matched, created, review or none; only one candidate whose name is alike and that nothing rules out can be matched."""
    similar = found.filter(F.col("level").isin([*nm.STRONG, *nm.WEAK]))
    live = F.col("tier") != "D"
    order = F.when(live, F.struct(-F.col("confidence"), "entity_id"))
    best = F.struct("entity_id", "tier", "confidence", "families", "soft", "repeat_pairing")
    per = similar.groupBy("app_id").agg(F.count("*").alias("similar"), F.count_if(live).alias("live"), F.min_by(best, order).alias("best"))
    return _told(appearances.select("app_id", F.coalesce("may_create", F.lit(False)).alias("may_create")).join(per, "app_id", "left"))


def _told(met: DataFrame) -> DataFrame:
    """The decisions, from how many candidates are similar and live and the best of these."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none, ruled, several, sure = n("similar") == 0, n("live") == 0, n("live") > 1, F.col("best.tier").isin("A", "B")
    joined = F.array_join("best.families", "+")
    decision = F.when(none, "none").when(ruled, F.when(F.col("may_create"), "created").otherwise("review")).when(several, "review").when(sure, "matched").otherwise("review")
    reason = (
        F.when(none, "no_name_similar_candidates").when(ruled, F.when(F.col("may_create"), "every_name_similar_candidate_conflicts").otherwise("every_candidate_conflicts_source_cannot_create")).when(several, "more_than_one_plausible_candidate")
        .when(F.col("best.tier") == "A", F.when(F.col("best.repeat_pairing"), "repeat_pairing_identity_continuity").otherwise("same_fight_already_on_record")).when(sure, F.concat(F.lit("graph:"), joined))
        .when(F.size("best.soft") > 0, F.concat(F.lit("contradiction:"), F.array_join("best.soft", "+"))).otherwise(F.concat(F.lit("insufficient_graph_evidence:"), F.when(joined == "", "none").otherwise(joined)))
    )
    tier = F.when(none, None).when(ruled, F.when(F.col("may_create"), "D").otherwise("C")).when(several, "C").when(sure, F.col("best.tier")).otherwise("C")
    confidence = F.when(none, None).when(ruled, F.when(F.col("may_create"), 90).otherwise(0)).otherwise(F.col("best.confidence"))
    return met.select("app_id", decision.alias("decision"), tier.alias("tier"), F.when(decision == "matched", F.col("best.entity_id")).alias("entity_id"), confidence.cast("int").alias("confidence"), reason.alias("reason"), n("similar").alias("candidates"))


def decided_by_names(appearances: DataFrame, persons: DataFrame, alike: DataFrame, bouts: DataFrame, hometowns: DataFrame, sizes: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """What `decided` tells of all pairs of an appearance and a person whose names are alike, and no pair is shuffled.

    appearances have `name` as printed, persons (entity_id, known) and bouts `known`, their one name; alike has (name, known) with the name evidence of names that are alike. Appearances, persons and contests are shuffled by the
    known name, a name of more than `tile` of either to tiles of both; there pairs are made, judged and counted, so that only a row for each appearance and tile leaves. `sizes` (name, n) is a bound of the appearances of each name,
    for who knows one more cheaply. The pairs themselves grow with the square of those that share a name; tasks are as many as they need.
    """
    col, no, key = F.col, F.lit(False), ["known", "__i", "__j"]
    asked = (appearances.groupBy("name").agg(F.count("*").alias("n")) if sizes is None else sizes).join(alike.select("name", "known"), "name").groupBy("known").agg(F.sum("n").alias("n_apps"))
    each = cut(asked.join(persons.groupBy("known").agg(F.count("*").alias("n_persons")), "known"))
    pairs, = each.agg(F.sum(col("n_apps") * col("n_persons"))).first()
    n = max(int(appearances.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // PAIRS_A_TASK))
    parts = lambda c: F.ceil(col(c) / tile).cast("int")
    # at most one name for each `tile` appearances or persons
    hot = F.broadcast(each.filter((col("n_apps") > tile) | (col("n_persons") > tile)).select("known", parts("n_apps").alias("__is"), parts("n_persons").alias("__js")))
    dealt = lambda df: df.join(hot, "known", "left").withColumns({"__is": F.coalesce("__is", F.lit(1)), "__js": F.coalesce("__js", F.lit(1))})
    at = lambda id_, of: F.pmod(F.xxhash64(id_), col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), col(of) - 1))
    a = appearances.select("app_id", "name", F.coalesce("may_create", no).alias("may_create"), city(col("hometown")).alias("a_town"), *[col(c).alias(f"a_{c}") for c in ("event_id", "date", "commission", "venue", "opponent_id", "weight", "bout_id", "bout_order", "debut")])
    marks = alike.select("name", "known", "suffix_missing", "suffix_conflict", *[v.alias(k) for k, v in _name_marks().items()])
    # appearances of no known name meet nobody, and lie anywhere
    a = dealt(a.join(marks, "name", "left").drop("name")).withColumn("__i", F.when(col("known").isNull(), F.pmod(F.xxhash64("app_id"), F.lit(n)).cast("int")).otherwise(at("app_id", "__is"))).withColumn("__j", all_of("__js")).drop("__is", "__js").repartition(n, *key)
    towns = hometowns.select("entity_id", city(col("hometown")).alias("town")).filter("town IS NOT NULL").groupBy("entity_id").agg(F.collect_set("town").alias("towns"))
    own = ["event_id", "date", "complete", "commission", "venue", "opponent_id", "weight", "bout_id", "bout_order"]
    # a row for each person, with the towns, and one for each contest
    rows = persons.select("entity_id", "known").join(towns, "entity_id", "left").unionByName(bouts.select("entity_id", "known", *own), allowMissingColumns=True)
    rows = dealt(rows).withColumn("__j", at("entity_id", "__js")).withColumn("__i", all_of("__is")).drop("__is", "__js").repartition(n, *key)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key, "entity_id").orderBy("bout_id")).cast("long"))
    true = lambda c: F.coalesce(c, no)
    days = F.abs(F.date_diff("date", "a_date"))
    m = a.join(rows, key, "left").withColumns({"days": days, "near": true(days <= WEIGHT_DAYS), "same_event": true(col("event_id") == col("a_event_id"))})
    m = m.withColumn("one_fight", true(col("opponent_id") == col("a_opponent_id")) & true(col("days") <= SAME_FIGHT_DAYS))
    again = col("one_fight") & col("same_event") & (true(col("bout_id") != col("a_bout_id")) | true(col("bout_order") != col("a_bout_order")))
    other, near = ~col("same_event") & ~col("one_fight"), col("near")
    at_once, elsewhere = near & other & true(col("days") <= SIMULTANEOUS_DAYS), true(col("commission") != col("a_commission")) | true(col("venue") != col("a_venue"))
    gap = F.abs(col("a_weight") - col("weight"))
    # the nearest contest of a known weight, the first by its id of equals, and what its weight says, in one number that is aggregated in place
    said = F.when(_comparable(gap, col("a_weight")), 1).when(_incompatible(gap, col("a_weight")), 2).otherwise(0)
    weighed = F.min(F.when(near & other & col("weight").isNotNull(), col("days").cast("long") * 2**40 + col("__rank") * 4 + said))
    any_ = lambda c: F.bool_or(true(c))
    met_before = lambda c: any_((col(c) == col(f"a_{c}")) & (other | ~near))
    pair = m.groupBy(*key, "app_id", "entity_id", "strong", "exact", "suffix_missing", "suffix_conflict", "may_create").agg(
        any_(near & col("one_fight") & ~again).alias("same_fight"), any_(near & again).alias("repeat_pairing"), any_(at_once & elsewhere).alias("simultaneous_event_elsewhere"), any_(at_once & ~elsewhere).alias("possible_duplicate_event"),
        any_(near & other & (col("days") > SIMULTANEOUS_DAYS) & (col("days") <= CLOSE_DAYS)).alias("fought_within_13_days"), weighed.alias("weighed"), met_before("commission").alias("jurisdiction"), met_before("venue").alias("venue"),
        met_before("opponent_id").alias("opponent_graph"), any_(F.array_contains("towns", col("a_town"))).alias("hometown"), any_(col("towns").isNotNull() & ~F.array_contains("towns", col("a_town"))).alias("hometown_different_city"),
        any_(col("a_debut") & col("complete") & (F.date_diff("a_date", "date") > 1)).alias("debut_after_recorded_bout"), any_(col("entity_id") == col("a_opponent_id")).alias("candidate_is_the_opponent"),
    )
    pair = judged(pair.withColumns({"weight": true(col("weighed") % 4 == 1), "weight_incompatible": true(col("weighed") % 4 == 2)}))
    there = col("entity_id").isNotNull()
    live = there & (col("tier") != "D")
    best = F.struct("entity_id", "tier", "confidence", "repeat_pairing", *FAMILIES, *SOFT)
    per = pair.groupBy("app_id").agg(F.max("may_create").alias("may_create"), F.count_if(there).alias("similar"), F.count_if(live).alias("live"), F.min_by(best, F.when(live, F.struct(-col("confidence"), "entity_id"))).alias("best"))
    signs = {"families": _signs(FAMILIES, "best."), "soft": _signs(SOFT, "best.")}
    return _told(per.withColumn("best", F.when(col("best").isNotNull(), F.struct("best.entity_id", "best.tier", "best.confidence", "best.repeat_pairing", *[v.alias(k) for k, v in signs.items()]))))


def fixed_point(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], most: int = 4) -> DataFrame:
    """start and what `step` adds to it, pass by pass, with `found_in`, the pass a row came in (0 for start).

    A pass gets the rows that the last pass added and all rows so far, and gives rows; those whose keys are there already are dropped. It ends on a pass that adds nothing, or after
    `most`. Each pass's rows are cut from their lineage, so that a lost executor repeats one pass and plans stay small.
    """
    held = cut(start.dropDuplicates(keys).withColumn("found_in", F.lit(0)))
    delta = held
    for n in range(1, most + 1):
        new = step(delta.drop("found_in"), held.drop("found_in")).dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")
        delta = cut(new.withColumn("found_in", F.lit(n)))
        if delta.isEmpty():
            break
        held = held.unionByName(delta)
    return held


def bound_in_passes(pairs: DataFrame, appearances: DataFrame, bouts: DataFrame, hometowns: DataFrame, most: int = 4) -> DataFrame:
    """(app_id, entity_id, found_in): appearances bound to persons, pass by pass, until a pass binds none.

    `appearances` have other_app, the appearance in the other corner, beside opponent_id. A binding makes the appearance a contest of its person and tells the other corner its opponent. After the first pass only
    those are looked at again that the last pass's bindings touch: the other corners, and appearances one of whose candidates has a new contest.
    """
    own = appearances.columns

    def with_bound(held: DataFrame) -> tuple[DataFrame, DataFrame]:
        other = held.select(F.col("app_id").alias("other_app"), F.col("entity_id").alias("__other"))
        told = appearances.join(other, "other_app", "left").withColumn("opponent_id", F.coalesce("opponent_id", "__other")).select(*own)
        more = told.join(held.select("app_id", "entity_id"), "app_id").select(
            "entity_id", "bout_id", "event_id", "date", F.lit(True).alias("complete"), "commission", "venue", "opponent_id", "weight", "bout_order"
        )
        return told, bouts.unionByName(more)

    def step(delta: DataFrame, held: DataFrame) -> DataFrame:
        told, known = with_bound(held)
        open_ = told.join(held.select("app_id"), "app_id", "left_anti")
        touched = delta.join(appearances.select("app_id", "other_app"), "app_id").select(F.col("other_app").alias("app_id")).union(pairs.join(delta.select("entity_id").distinct(), "entity_id", "left_semi").select("app_id")).distinct()
        open_ = open_.join(touched, "app_id", "left_semi")
        mine = pairs.join(open_.select("app_id"), "app_id", "left_semi")
        return decided(open_, evidence(mine, open_, known, hometowns)).filter("decision = 'matched'").select("app_id", "entity_id")

    first = decided(appearances, evidence(pairs, appearances, bouts, hometowns)).filter("decision = 'matched'").select("app_id", "entity_id")
    return fixed_point(first, step, ["app_id"], most - 1).withColumn("found_in", F.col("found_in") + 1)
