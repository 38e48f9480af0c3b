"""What a published card changes in the one on record: bouts are matched in stages, then every difference is one typed change.

Cards on record: events (event_id, event_date, start_at, status, venue, commission, deferred), bouts (event_id, bout_id, external_id, status, bout_order, segment, rounds, weight, weight_class, a, b the active
corners, titles array<struct<title, eligible>>, officials array<struct<official, role, slot>>). Documents: events (the same without deferred), bouts (event_id, n their place, the same fields, and class_contradicted,
officials_complete). A field a document leaves null says nothing, titles and officials too; absence of a bout is not its cancellation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import names as nm


CHANGE = "array<struct<type:string,before:string,after:string>>"
# States of a bout that no replacement concerns.
CLOSED = ["cancelled", "complete"]
#: Days within which a provider's event and a bout can be one.
NEAR_DAYS = 2


def pair(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def matched(docs: DataFrame, bouts: DataFrame) -> DataFrame:
    """(event_id, n, bout_id, matched_by): which bout on record each bout of a document is.

    Stages, each of which takes away what it matched on both sides: the source's own id; then the unordered pair, for a document bout with an id only among bouts that have none from this source, for one
    without an id among all that are left. Bouts of one pair on one card are taken in their order. What is left is new.
    """
    return _staged(docs, bouts).filter(F.col("__doc") & F.col("__m").isNotNull()).select("event_id", "n", F.col("__m").alias("bout_id"), "matched_by")


def _staged(docs: DataFrame, bouts: DataFrame, lying: bool = False) -> DataFrame:
    """The rows of both sides (__doc tells which) with all columns of a document bout in `d` and of a bout in `s`, and the bout_id `__m` that a document bout is, with matched_by. Both are shuffled by card once, or not at all if `lying`: dealt to as many tasks by event_id already."""
    doc, bout, known = F.col("__doc"), ~F.col("__doc"), F.col("external_id").isNotNull() & F.col("event_id").isNotNull()
    whole = lambda df: F.struct(*[c for c in df.columns if c not in ("event_id", "n", "bout_id")])
    d = docs.select("event_id", "n", "external_id", pair(F.col("a"), F.col("b")).alias("__pair"), F.lit(True).alias("__doc"), whole(docs).alias("d"))
    s = bouts.select("event_id", "bout_id", "external_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), pair(F.col("a"), F.col("b"))).alias("__pair"), F.lit(False).alias("__doc"), whole(bouts).alias("s"))
    # both sides lie together by card, once for all stages, which only sort them
    both = d.unionByName(s, allowMissingColumns=True)
    rows = both if lying else both.repartition("event_id")
    same = Window.partitionBy("event_id", "external_id")
    first, asked = F.min(F.when(bout & known, F.col("bout_id"))).over(same), F.max(doc & known).over(same)
    rows = rows.withColumns({"__first": first, "__asked": asked})
    rows = rows.withColumns({"__m": F.when(doc & known, F.col("__first")), "__gone": bout & known & F.col("__asked") & (F.col("bout_id") == F.col("__first"))})
    rows = rows.withColumns({"__gone": F.coalesce("__gone", F.lit(False)), "matched_by": F.when(F.col("__m").isNotNull(), "external_id")})
    for with_id in (True, False):
        open_ = F.when(doc, F.col("external_id").isNotNull() == with_id).otherwise(~F.col("__gone") & (F.col("external_id").isNull() if with_id else F.lit(True)))
        rows = rows.withColumn("__in", open_ & F.col("__m").isNull() & F.col("__pair").isNotNull() & F.col("event_id").isNotNull())
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("event_id", "__pair", "__in", "__doc").orderBy("n", "bout_id")))
        met = Window.partitionBy("event_id", "__pair", "__in", "__k")
        rows = rows.withColumns({"__b": F.max("bout_id").over(met), "__l": F.max("__doc").over(met)})
        found = F.col("__in") & doc & F.col("__b").isNotNull()
        rows = rows.withColumns({"__m": F.when(found, F.col("__b")).otherwise(F.col("__m")), "matched_by": F.when(found, "pair").otherwise(F.col("matched_by")), "__gone": F.col("__gone") | (F.col("__in") & bout & F.col("__l"))})
    return rows


def _change(kind: Column | str, holds: Column, before: Column, after: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(kind.alias("type"), before.cast("string").alias("before"), after.cast("string").alias("after")))


def _many(items: Column) -> Column:
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast(CHANGE))


def nothing() -> Column:
    return F.lit(None).cast("string")


def event_changes(docs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, ref null, type, before, after) and (event_id, reason, detail): what changes in events, and what a deferring event (another owns its facts) only disagrees about."""
    d = docs.select("event_id", *[F.col(c).alias(f"d_{c}") for c in ("event_date", "start_at", "status", "venue", "commission")])
    s = events.withColumn("existed", F.lit(True))
    m = d.join(s, "event_id", "left").withColumns({"existed": F.coalesce("existed", F.lit(False)), "deferred": F.coalesce("deferred", F.lit(False))})
    col = F.col
    own, there = ~col("deferred"), col("existed")
    date_differs = ~col("d_event_date").eqNullSafe(col("event_date"))
    moved = own & there & col("d_event_date").isNotNull() & (date_differs | (col("d_start_at").isNotNull() & ~col("d_start_at").eqNullSafe(col("start_at"))))
    at = lambda day, start: F.coalesce(start, day.cast("timestamp_ntz"))
    later = at(col("d_event_date"), col("d_start_at")) > at(col("event_date"), col("start_at"))
    status = there & (col("d_status") != F.coalesce("status", F.lit("")))
    other = lambda c: col(f"d_{c}").isNotNull() & ~col(f"d_{c}").eqNullSafe(col(c))
    changes = F.array_compact(F.array(
        _change("event_announced", ~there, nothing(), col("d_event_date")), _change(F.when(F.coalesce(later, F.lit(False)), "event_postponed").otherwise("event_date_changed"), moved, at(col("event_date"), col("start_at")), at(col("d_event_date"), col("d_start_at"))),
        _change(F.when(col("d_status") == "cancelled", "event_cancelled").otherwise("event_status_changed"), own & status, col("status"), col("d_status")),
        _change("venue_changed", own & other("venue"), col("venue"), col("d_venue")), _change("commission_changed", own & other("commission"), col("commission"), col("d_commission")),
    ))
    reason = lambda c, needs: F.when(F.coalesce(col("deferred") & other(c) & (col(c).isNotNull() if needs else F.lit(True)), F.lit(False)), F.concat(F.lit(f"{c}: "), F.coalesce(col(c).cast("string"), F.lit("none")), F.lit(" or "), col(f"d_{c}").cast("string")))
    odd = F.array_compact(F.array(reason("event_date", False), reason("status", False), reason("venue", True), reason("commission", True)))
    told = m.select("event_id", nothing().alias("ref"), F.explode(changes).alias("c")).select("event_id", "ref", "c.*")
    return told, m.select("event_id", F.lit("event_field_disagreement").alias("reason"), F.explode(odd).alias("detail"))


def bout_changes(docs: DataFrame, bouts: DataFrame, lying: bool = False) -> tuple[DataFrame, DataFrame]:
    """(event_id, ref, type, before, after) and (event_id, reason, detail): what a document changes in the bouts, and new pairings that may be replacements. If `lying`, both sides are dealt to as many tasks by event_id already, and stay there."""
    # a document bout is told its bout where both lie
    one = Window.partitionBy("event_id", F.coalesce("__m", "bout_id"))
    m = _staged(docs, bouts, lying).withColumn("s", F.first(F.when(~F.col("__doc"), F.col("s")), ignorenulls=True).over(one)).filter("__doc")
    m = m.select("event_id", "n", F.col("__m").alias("bout_id"), "matched_by", "d.*", *[F.col(f"s.{c}").alias(f"s_{c}") for c in bouts.columns if c not in ("event_id", "bout_id")])
    col, old = F.col, lambda c: F.col(f"s_{c}")
    new_pair = pair(col("a"), col("b"))
    ref = F.coalesce("bout_id", F.concat(F.lit("ext:"), "external_id"), F.concat(F.lit("pair:"), new_pair))
    new = col("bout_id").isNull()
    titled = lambda t: F.concat_ws(":", t.title, F.coalesce(t.eligible, F.lit("-")))
    posted = lambda o: F.concat_ws(":", o.role, F.coalesce(o.slot.cast("string"), F.lit("-")), o.official)
    added = F.concat(
        F.array(_change("bout_added", F.lit(True), nothing(), new_pair)), _many(F.transform("titles", lambda t: _change("title_added", F.lit(True), nothing(), titled(t)))),
        _many(F.transform("officials", lambda o: _change("official_assigned", F.lit(True), nothing(), posted(o)))),
    )
    corners, known = F.array("a", "b"), F.array_compact(F.array("s_a", "s_b"))
    incoming, outgoing = F.filter(corners, lambda x: ~F.array_contains(known, x)), F.filter(known, lambda x: ~F.array_contains(corners, x))
    replaced = F.filter(F.arrays_zip(outgoing.alias("o"), incoming.alias("i")), lambda x: x.o.isNotNull() & x.i.isNotNull())
    status = F.when(col("status") == "cancelled", "bout_cancelled").when(col("status") == "postponed", "bout_postponed").otherwise("bout_status_changed")
    differs = lambda c: col(c).isNotNull() & ~col(c).eqNullSafe(old(c))
    plain = [("card_order_changed", "bout_order"), ("card_segment_changed", "segment"), ("scheduled_rounds_changed", "rounds"), ("contracted_weight_changed", "weight"), ("weight_class_changed", "weight_class")]
    cleared = ~differs("weight_class") & F.coalesce("class_contradicted", F.lit(False)) & old("weight_class").isNotNull()
    of = lambda items, same: F.get(F.filter(items, same), F.lit(0))
    at_stake = F.coalesce("s_titles", F.array().cast("array<struct<title:string,eligible:string>>"))
    title = F.transform("titles", lambda t: F.when(~F.exists(at_stake, lambda x: x.title == t.title), _change("title_added", F.lit(True), nothing(), titled(t))).otherwise(
        _change("title_eligibility_changed", ~of(at_stake, lambda x: x.title == t.title).eligible.eqNullSafe(t.eligible), titled(of(at_stake, lambda x: x.title == t.title)), titled(t))))
    untitled = F.when(col("titles").isNotNull(), F.transform(at_stake, lambda x: _change("title_removed", ~F.exists("titles", lambda t: t.title == x.title), titled(x), nothing())))
    posts = F.coalesce("s_officials", F.array().cast("array<struct<official:string,role:string,slot:int>>"))
    here = lambda o: of(posts, lambda x: (x.role == o.role) & x.slot.eqNullSafe(o.slot))
    serves = lambda o: F.exists(posts, lambda x: (x.official == o.official) & (x.role == o.role))
    official = F.transform("officials", lambda o: F.when(serves(o), None).when(here(o).isNotNull(), _change("official_replaced", F.lit(True), posted(here(o)), posted(o))).otherwise(_change("official_assigned", F.lit(True), nothing(), posted(o))))
    withdrawn = F.when(F.coalesce("officials_complete", F.lit(False)), F.transform(posts, lambda x: _change("official_removed", ~F.exists("officials", lambda o: (o.official == x.official) & (o.role == x.role)), posted(x), nothing())))
    changed = F.concat(
        F.when(col("matched_by") == "external_id", _many(F.transform(replaced, lambda x: _change("opponent_replaced", F.lit(True), x.o, x.i)))).otherwise(F.array().cast(CHANGE)),
        F.array_compact(F.array(_change(status, differs("status"), old("status"), col("status")), *[_change(k, differs(c), old(c), col(c)) for k, c in plain], _change("weight_class_changed", cleared, old("weight_class"), nothing()))),
        _many(title), _many(untitled), _many(official), _many(withdrawn),
    )
    told = m.select("event_id", ref.alias("ref"), F.explode(F.when(new, added).otherwise(changed)).alias("c")).select("event_id", "ref", "c.*")
    open_ = bouts.filter(~F.coalesce(F.col("status").isin(CLOSED), F.lit(False))).select("event_id", "bout_id", F.explode(F.array_compact(F.array("a", "b"))).alias("__f"))
    asked = m.filter(new & col("external_id").isNull()).select("event_id", ref.alias("ref"), F.explode(corners).alias("__f"))
    replacing = asked.join(open_, ["event_id", "__f"]).groupBy("event_id", "ref").agg(F.array_join(F.array_sort(F.collect_set("bout_id")), ",").alias("bouts"))
    return told, replacing.select("event_id", F.lit("possible_replacement_without_external_id").alias("reason"), F.concat("ref", F.lit(" for "), "bouts").alias("detail"))


def card_changes(doc_events: DataFrame, doc_bouts: DataFrame, events: DataFrame, bouts: DataFrame, lying: bool = False) -> tuple[DataFrame, DataFrame]:
    """All changes and all that a person must look at. Cards are told apart by event_id; nothing is gathered beyond the titles and officials of one bout. See bout_changes for `lying`."""
    (a, x), (b, y) = event_changes(doc_events, events), bout_changes(doc_bouts, bouts, lying)
    return a.unionByName(b), x.unionByName(y)


def listing_delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(*key, change, was, is_): what a source's listing of a card changed from the one before, by the printed names of the corners (a, b, in their order), with rounds, titles and bout_order.

    A listing of which one corner stays is a changed opponent, another is new; one that is gone without such a successor is removed.
    """
    side = lambda df, p: df.select(*key, F.lower("a").alias("__a"), F.lower("b").alias("__b"), F.concat_ws(" vs ", "a", "b").alias(f"{p}_pair"), *[F.col(c).alias(f"{p}_{c}") for c in ("rounds", "titles", "bout_order")])
    both = side(old, "o").join(side(new, "n"), [*key, "__a", "__b"], "full_outer")
    kept, gone, came = F.col("o_pair").isNotNull() & F.col("n_pair").isNotNull(), F.col("n_pair").isNull(), F.col("o_pair").isNull()
    differs = lambda c: kept & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    marks = F.array_compact(F.array(*[_change(k, differs(c), F.col(f"o_{c}"), F.col(f"n_{c}")) for k, c in (("CHANGED_ROUNDS", "rounds"), ("CHANGED_TITLE", "titles"), ("CHANGED_CARD_POSITION", "bout_order"))]))
    same = both.filter(kept).select(*key, F.explode(marks).alias("c")).select(*key, F.col("c.type").alias("change"), F.col("c.before").alias("was"), F.col("c.after").alias("is_"))

    def swaps(left: DataFrame, right: DataFrame, pair_: str, other: str) -> DataFrame:
        """left rows with the first listing of right that has one of their corners at its place."""
        at = lambda df, names: df.select(*key, F.explode(F.array(F.concat(F.lit("a:"), "__a"), F.concat(F.lit("b:"), "__b"))).alias("__c"), *names)
        met = at(left, ["__a", "__b"]).join(at(right, [F.col(pair_).alias("__p"), F.struct(other, pair_).alias("__order")]), [*key, "__c"])
        return met.groupBy(*key, "__a", "__b").agg(F.min_by("__p", "__order").alias("__p"))

    came_, gone_, previous, current = both.filter(came), both.filter(gone), both.filter("o_pair IS NOT NULL"), both.filter("n_pair IS NOT NULL")
    cond = [*key, "__a", "__b"]
    fresh = came_.join(swaps(came_, previous, "o_pair", "o_bout_order"), cond, "left").select(*key, F.when(F.col("__p").isNull(), "NEW_BOUT").otherwise("CHANGED_OPPONENT").alias("change"), F.col("__p").alias("was"), F.col("n_pair").alias("is_"))
    lost = gone_.join(swaps(gone_, current, "n_pair", "n_bout_order"), cond, "left_anti").select(*key, F.lit("REMOVED_BOUT").alias("change"), F.col("o_pair").alias("was"), nothing().alias("is_"))
    return same.unionByName(fresh).unionByName(lost)


def corner_of(name: Column, a: Column, b: Column) -> Column:
    """Which of a bout's two corners (parsed names a and b) a parsed name stands for: the only one it is like at all, by first name too; null if neither or both."""

    def fits(corner: Column) -> Column:
        x = nm.compared(name, corner, F.lit(False))
        return F.transform(F.array(x), lambda r: F.struct(((r.level != "none") & ~r.suffix_conflict).alias("fits"), r.given_differs.alias("odd")))[0]

    told = F.transform(F.array(F.struct(fits(a).alias("a"), fits(b).alias("b"))), lambda r: F.when(r.a.fits & ~r.b.fits & ~r.a.odd, "a").when(r.b.fits & ~r.a.fits & ~r.b.odd, "b"))
    return told[0]


def two_corner_match(events: DataFrame, bouts: DataFrame, corners: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """(event, bout_id, home_side, outcome): the one bout near in time whose two different corners an event's two names stand for, else why none.

    events: event, at, mapped (a bout that an earlier match stands for, or null); bouts: bout_id, starts_at; corners: event, bout_id, home, away (the side that each name stands for, see corner_of) of bouts
    and events that share a name and are near in time, or that an earlier match has made one; others may be there and don't count. Events never meet bouts by time alone: whether any bout is near is asked of the days' first and last starts. A mapping is verified each time.
    """
    width = days * 86_400
    sec = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    day = lambda c: F.floor(c / 86_400)
    starts = bouts.filter("starts_at IS NOT NULL").select("bout_id", sec("starts_at").alias("__s"))
    told = events.select("event", sec("at").alias("__t"), "mapped")
    per_day = starts.groupBy(day(F.col("__s")).alias("__d")).agg(F.min("__s").alias("__first"), F.max("__s").alias("__last"))
    asked = told.filter("__t IS NOT NULL").select("event", "__t", F.explode(F.sequence(day(F.col("__t") - width), day(F.col("__t") + width))).alias("__d"))
    near_any = asked.join(per_day, "__d").filter((F.col("__last") >= F.col("__t") - width) & (F.col("__first") <= F.col("__t") + width)).select("event").distinct().withColumn("any_near", F.lit(True))
    met = corners.join(starts, "bout_id").join(told, "event").withColumn("near", F.abs(F.col("__s") - F.col("__t")) <= width)
    ok = F.col("home").isNotNull() & F.col("away").isNotNull() & (F.col("home") != F.col("away"))
    some = F.col("home").isNotNull() | F.col("away").isNotNull()
    is_map = F.col("bout_id") == F.col("mapped")
    found = met.groupBy("event").agg(
        F.count_if(F.col("near") & ok).alias("hits"), F.min_by(F.struct("bout_id", "home"), F.when(F.col("near") & ok, F.col("bout_id"))).alias("hit"), F.count_if(F.col("near") & ~ok & some).alias("partial"),
        F.min_by("home", F.when(is_map & ok, F.col("bout_id"))).alias("map_side"),
    )
    alive = bouts.select(F.col("bout_id").alias("mapped"), F.lit(True).alias("alive"))
    out = told.join(found, "event", "left").join(near_any, "event", "left").join(alive, "mapped", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_map = F.col("mapped").isNotNull()
    outcome = (
        F.when(F.col("__t").isNull(), "invalid_time").when(has_map & F.col("alive").isNull(), "mapped_bout_not_schedulable").when(has_map, F.when(F.col("map_side").isNotNull(), "existing_mapping").otherwise("mapped_bout_participant_mismatch"))
        .when(n("hits") == 1, "both_corners_resolved").when(n("hits") > 1, "ambiguous_multiple_bouts").when(F.col("any_near").isNull(), "no_candidate_bout_in_window").when(n("partial") > 0, "no_bout_with_both_fighters").otherwise("participants_not_found")
    )
    one, kept = outcome == "both_corners_resolved", outcome == "existing_mapping"
    return out.select("event", F.when(one, F.col("hit.bout_id")).when(kept, F.col("mapped")).alias("bout_id"), F.when(one, F.col("hit.home")).when(kept, F.col("map_side")).alias("home_side"), outcome.alias("outcome"))
