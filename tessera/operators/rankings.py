"""Changes between two lists of one board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import names as nm

# The kinds of change in the order they are told, and the labels of a champion's place.
CHANGE_ORDER = [
    "champion_changed", "title_vacant_in_ranking", "became_champion", "no_longer_champion", "new_champion_listed",
    "moved_up", "moved_down", "new_entrant", "removed", "designation_changed", "mandatory_changed",
]
CHAMPION_LABEL = "(?i)^(c|champion|super champion|sc)$"


def entry_key(entity: Column, name: Column) -> Column:
    """The entity where it is resolved, else the printed name without accents, particles and generation suffix; null without both."""
    full = nm.parsed(nm.romanised(name))["full"]
    return F.coalesce(F.concat(F.lit("id:"), entity.cast("string")), F.concat(F.lit("name:"), F.nullif(full, F.lit(""))))


def ranking_changes(old: DataFrame, new: DataFrame, board: list[str]) -> DataFrame:
    """(board, type, type_order, key, position, rank, previous_rank, places, unresolved): what changed from the old list of each board to the new.

    Both lists have board, entity_id, source_name, position, rank, rank_label, is_champion, is_vacant, designation, mandatory. A board without a new list tells nothing; one without an old list
    has entrants only. Vacant places are no entries; of entries with one key the last place counts. A place moves only if neither list has it as champion and both give a rank; the mandatory mark is
    compared only if both lists state it. Entries of both lists meet in one aggregation by key, so a board may be of any length; only its champions are gathered.
    """
    columns = [*board, "position", "rank", "rank_label", "designation", "mandatory"]
    side = lambda df, is_new: df.select(
        *columns, entry_key(F.col("entity_id"), F.col("source_name")).alias("key"), F.coalesce("is_champion", F.lit(False)).alias("champion"), F.coalesce("is_vacant", F.lit(False)).alias("vacant"),
        F.col("entity_id").isNull().alias("unresolved"), F.lit(is_new).alias("is_new"),
    )
    rows = side(old, False).union(side(new, True))
    entry = F.struct("position", "rank", "champion", "designation", "mandatory", "unresolved")
    last = lambda is_new: F.max_by(F.when(F.col("is_new") == is_new, entry), F.when(F.col("is_new") == is_new, F.struct("position", "rank", "rank_label", "designation")))
    entries = rows.filter("NOT vacant AND key IS NOT NULL").groupBy(*board, "key").agg(last(False).alias("p"), last(True).alias("n"))

    champions = lambda is_new: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("is_new") == is_new) & F.col("champion") & ~F.col("vacant"), F.struct("position", "key")))), lambda x: F.coalesce(x.key, F.lit(""))), ",")
    empty_slot = F.bool_or(F.col("is_new") & F.col("vacant") & F.coalesce(F.col("rank_label").rlike(CHAMPION_LABEL), F.lit(False)))
    boards = rows.groupBy(*board).agg(F.bool_or("is_new").alias("listed"), champions(False).alias("before"), champions(True).alias("after"), empty_slot.alias("empty_slot")).filter("listed")

    p, n, both = F.col("p"), F.col("n"), F.col("p").isNotNull() & F.col("n").isNotNull()
    steady = both & (n.champion == p.champion)
    first = (
        F.when(p.isNull(), F.when(n.champion, "new_champion_listed").otherwise("new_entrant")).when(n.isNull(), "removed").when(~steady, F.when(n.champion, "became_champion").otherwise("no_longer_champion"))
        .when(~n.champion & (n["rank"] < p["rank"]), "moved_up").when(~n.champion & (n["rank"] > p["rank"]), "moved_down")
    )
    marks = [F.when(both & ~n.designation.eqNullSafe(p.designation), "designation_changed"), F.when(both & (n.mandatory != p.mandatory), "mandatory_changed")]
    told = entries.join(boards.select(*board), board, "left_semi").withColumn("type", F.explode(F.array_compact(F.array(first, *marks))))
    moved = F.col("type").isin("moved_up", "moved_down")
    own = lambda name: F.coalesce(n[name], p[name])
    told = told.select(
        *board, "type", "key", own("position").alias("position"), F.when(n.isNotNull(), n["rank"]).otherwise(p["rank"]).alias("rank"), F.when(moved, p["rank"]).alias("previous_rank"),
        F.when(moved, F.abs(n["rank"] - p["rank"])).alias("places"), own("unresolved").alias("unresolved"),
    )
    slot = F.when((F.col("before") != "") & (F.col("after") == "") & F.col("empty_slot"), "title_vacant_in_ranking").when((F.col("before") != "") & (F.col("after") != "") & (F.col("before") != F.col("after")), "champion_changed")
    none = lambda like: F.lit(None).cast(told.schema[like].dataType).alias(like)
    slots = boards.withColumn("type", slot).filter("type IS NOT NULL").select(*board, "type", none("key"), none("position"), none("rank"), none("previous_rank"), none("places"), F.lit(False).alias("unresolved"))
    order = F.array_position(F.array(*map(F.lit, CHANGE_ORDER)), F.col("type")).cast("int")
    return told.union(slots).withColumn("type_order", order)


def chain_changes(lists: DataFrame, board: list[str], at: str, last: DataFrame | None = None) -> DataFrame:
    """What changed from each list of a board to the next of its chain, `at` being the later one: all neighbouring lists in one pass, as each entry stands once as new and once as old.

    Columns as of `ranking_changes`, with `at`. The first list of a chain tells nothing by itself. `last` holds the last list of each board that was seen before, with the same columns: then only new lists are read, and
    a board's first new one is compared with it.
    """
    held = lists if last is None else lists.unionByName(last)
    found = held.select(*board, at).distinct()
    following = found.withColumn("__next", F.lead(at).over(Window.partitionBy(*board).orderBy(at))).filter("__next IS NOT NULL")
    old = held.join(following, [*board, at]).drop(at).withColumnRenamed("__next", at)
    new = held.join(following.select(*board, F.col("__next").alias(at)), [*board, at], "left_semi")
    return ranking_changes(old, new, [*board, at])
