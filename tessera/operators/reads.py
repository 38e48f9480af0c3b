"""Reads for people and checks: pages, facets, coverage, ledgers and violated rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import all_of


def searched(df: DataFrame, columns: list[str], needle: str | None) -> DataFrame:
    """Rows that hold the needle, cleaned of wildcards, in one of the columns; all rows without one."""
    clean = (needle or "").replace("%", "").replace("_", "").replace("\\", "").strip().lower()
    return df.filter(reduce(lambda a, b: a | b, [F.lower(c).contains(clean) for c in columns])) if clean else df


def page(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 100) -> DataFrame:
    """One page by a total order, with the total of all rows; limit and offset are clamped."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))
    return rows.crossJoin(F.broadcast(total))  # one row


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for several columns in one pass: a grouping set for each."""
    sets = ", ".join(f"(`{c}`)" for c in columns)
    names = F.expr("CASE " + " ".join(f"WHEN grouping(`{c}`) = 0 THEN '{c}'" for c in columns) + " END")
    values = F.coalesce(*[F.when(F.expr(f"grouping(`{c}`) = 0"), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in columns])
    return df.groupingSets([[c] for c in columns], *columns).agg(names.alias("facet"), values.alias("value"), F.count("*").alias("n")).select("facet", "value", "n") if sets else df


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()])


def ledger(parts: dict[str, tuple[DataFrame, Column, Column, Column]]) -> DataFrame:
    """One ledger (kind, ref, at, amount) of several fact tables."""
    rows = [df.select(F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), at.cast("timestamp_ntz").alias("at"), amount.cast("double").alias("amount")) for kind, (df, ref, at, amount) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): how many rows break each rule; a rule that holds is told with 0."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations") for k, df in checks.items()])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def changed_frozen(old: DataFrame, new: DataFrame, keys: list[str], frozen: list[str]) -> DataFrame:
    """Rows of `new` in which a frozen column is not what it was, null-safe, with the names of those columns."""
    was = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in frozen])
    diff = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in frozen]))
    return new.join(was, keys).withColumn("changed", F.array_join(diff, ",")).filter("changed <> ''").select(*keys, "changed")


def illegal_moves(df: DataFrame, keys: list[str], order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """State changes of a key that the state machine does not allow."""
    from tessera.operators.sequences import consecutive

    pairs = consecutive(df, keys, order, {state: "from_state"})
    legal = reduce(lambda a, b: a | b, [(F.col("from_state") == k) & F.col(state).isin(v) for k, v in allowed.items()], F.lit(False))
    return pairs.filter(~(F.col("from_state") == F.col(state)) & ~legal)


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with `problems`, the names of the rules they break, comma-joined; a rule that cannot be told counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("problems", F.array_join(broken, ","))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, days: int) -> DataFrame:
    """Rows of equal keys whose dates are at most `days` apart."""
    near = F.abs(F.date_diff(F.col(left_at), F.col(right_at))) <= days
    return left.join(right, all_of([left[k] == right[k] for k in keys]) & near)


def sharing_pairs(df: DataFrame, id_: str, members: str, within: list[str]) -> DataFrame:
    """(*within, a, b, shared), a < b: rows of one group whose arrays overlap, with the number of distinct members they share.

    Rows meet by group and member, an equi-join; a member that most rows of a group have makes as many pairs as its answer has.
    """
    each = df.select(*within, F.col(id_).alias("id"), F.explode(F.array_distinct(members)).alias("m"))
    a, b = each.withColumnRenamed("id", "a"), each.withColumnRenamed("id", "b")
    return a.join(b, [*within, "m"]).filter("a < b").groupBy(*within, "a", "b").agg(F.count("*").alias("shared"))


def in_scope(scope: Column, at: Column, status: Column, today: Column) -> Column:
    """Whether a row belongs to a named scope: upcoming (from today on, unless complete), results (before today, or complete), and all rows to any other scope or none. Cancelled rows belong nowhere."""
    open_, done = ~status.eqNullSafe("complete"), status.eqNullSafe("complete")
    inside = F.when(scope == "upcoming", (at >= today) & open_).when(scope == "results", (at < today) | done).otherwise(True)
    return F.coalesce(inside, F.lit(False)) & ~status.eqNullSafe("cancelled")


# A page has 1 to 100 rows, 40 by default.
PAGE, MOST_ROWS = 40, 100


def scoped_page(df: DataFrame, scope: str | None, at: str, status: str, name: str, today: Column, limit: int | None = PAGE, offset: int | None = 0) -> DataFrame:
    """A page of a scope's rows with `place`, from 1: upcoming ones from the next on, others from the latest back, then by name; null dates last. limit and offset are held to what a page may be."""
    kept = df.filter(in_scope(F.lit(scope), F.col(at), F.col(status), today))
    order = [F.asc_nulls_last(at)] if scope == "upcoming" else []
    order = [*order, F.desc_nulls_last(at), F.asc(name)]
    size, skip = max(1, min(PAGE if limit is None else limit, MOST_ROWS)), max(0, offset or 0)
    page = kept.orderBy(*order).limit(skip + size).withColumn("__page", F.lit(1))
    ranked = page.withColumn("place", F.row_number().over(Window.partitionBy("__page").orderBy(*order))).drop("__page")
    return ranked.filter(F.col("place") > skip)


def year_coverage(events: DataFrame, bouts: DataFrame, members: DataFrame | None, decisions: DataFrame, appearance: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, year, events, live, replaced, total, linked, held, events_with_held) of each source and year with events or held bouts, and (source, year, event_date, held).

    events: event, source, event_date; bouts: bout, event, status, external_id; members: bout, member, or none if bouts have theirs in an array `members`; decisions: source, appearance (or the columns named so), external_id (that begins
    with its event's date), seq, decision. A bout is held if the last decision of an appearance in it is review and no bout of its source carries its id. Where the appearance's columns hold what decisions are dealt by already, they aren't shuffled.
    """
    e = events.select("event", "source", F.year("event_date").alias("year"))
    b = bouts.join(e, "event").withColumn("live", ~F.col("status").eqNullSafe("replaced"))
    counted = e.groupBy("source", "year").agg(F.count("*").alias("events"))
    by_bout = b.groupBy("source", "year").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("replaced"), F.count("*").alias("total"))
    each = b.filter("live").select("source", "year", F.explode("members").alias("member")) if members is None else b.filter("live").join(members, "bout")
    linked = each.groupBy("source", "year").agg(F.count_distinct("member").alias("linked"))
    last = decisions.groupBy("source", *(appearance or ["appearance"])).agg(F.max_by(F.struct("external_id", "decision"), "seq").alias("x")).select("source", "x.*")
    open_ = last.filter("decision = 'review'").select("source", "external_id").distinct()
    held = open_.join(b.select("source", "external_id").filter("external_id IS NOT NULL").distinct(), ["source", "external_id"], "left_anti")
    held = held.withColumn("year", F.substring("external_id", 1, 4).cast("int")).withColumn("event_date", F.substring("external_id", 1, 10))
    by_event = held.groupBy("source", "year", "event_date").agg(F.count("*").alias("held"))
    by_year = by_event.groupBy("source", "year").agg(F.sum("held").alias("held"), F.count("*").alias("events_with_held"))
    key = ["source", "year"]
    told = counted.join(by_bout, key, "left").join(linked, key, "left").join(by_year, key, "full_outer")
    return told.fillna(0, ["events", "live", "replaced", "total", "linked", "held", "events_with_held"]), by_event
