import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as gr

APP = "app_id string, event_id string, date date, commission string, venue string, hometown string, weight double, debut boolean, opponent_id string, bout_id string, bout_order int, may_create boolean, other_app string"
BOUT = "entity_id string, bout_id string, event_id string, date date, complete boolean, commission string, venue string, opponent_id string, weight double, bout_order int"
PAIR = "app_id string, entity_id string, level string, suffix_missing boolean, given_differs boolean, suffix_conflict boolean"
D = dt.date(2020, 6, 1)


def app(id_, **more):
    return {"app_id": id_, "event_id": f"e-{id_}", "date": D, "commission": "NV", "venue": "v1", "hometown": "Lodz, Poland", "weight": 150.0, "debut": False, "opponent_id": None, "bout_id": None, "bout_order": None, "may_create": True, "other_app": None, **more}


def bout(who, days, **more):
    return {"entity_id": who, "bout_id": f"{who}{days}", "event_id": f"x{who}{days}", "date": D + dt.timedelta(days=days), "complete": True, "commission": "NV", "venue": "v1", "opponent_id": "z", "weight": 151.0, "bout_order": None, **more}


def run(spark, apps, bouts, levels, towns=(("k", "lodz,  poland"),)):
    pairs = [(a, e, lv, False, False, False) if isinstance(lv, str) else (a, e, *lv) for a, e, lv in levels]
    args = spark.createDataFrame(pairs, PAIR), spark.createDataFrame(apps, APP), spark.createDataFrame(bouts, BOUT), spark.createDataFrame(list(towns), "entity_id string, hometown string")
    return args, {r.app_id: r for r in gr.decided(args[1], gr.evidence(*args)).collect()}


CASES = [  # appearance, contests of k, name, decision, tier, reason
    (app("full"), [bout("k", -90)], "exact", "matched", "B", "graph:hometown+jurisdiction+venue+weight"),
    (app("nothing", hometown=None), [], "exact", "review", "C", "insufficient_graph_evidence:none"),
    (app("town only", weight=None), [bout("k", -900, commission="TX", venue="v2")], "exact", "review", "C", "insufficient_graph_evidence:hometown"),
    (app("weak name"), [bout("k", -90)], "fuzzy", "review", "C", "insufficient_graph_evidence:hometown+jurisdiction+venue+weight"),
    (app("surname"), [bout("k", -90)], "surname", "none", None, "no_name_similar_candidates"),
    (app("same fight", opponent_id="z"), [bout("k", 1, event_id="other")], "transliteration", "matched", "A", "same_fight_already_on_record"),
    (app("again", opponent_id="z", event_id="one", bout_id="b|2"), [bout("k", 0, event_id="one", bout_id="b")], "exact", "matched", "A", "repeat_pairing_identity_continuity"),
    (app("same sheet", opponent_id="z", event_id="one", bout_id="b"), [bout("k", 0, event_id="one", bout_id="b")], "exact", "matched", "A", "same_fight_already_on_record"),
    (app("elsewhere"), [bout("k", -2, venue="v9")], "exact", "created", "D", "every_name_similar_candidate_conflicts"),
    (app("elsewhere, no new", may_create=False), [bout("k", 2, commission="TX")], "exact", "review", "C", "every_candidate_conflicts_source_cannot_create"),
    (app("twice"), [bout("k", -2)], "exact", "review", "C", "contradiction:possible_duplicate_event"),
    (app("close"), [bout("k", 13)], "exact", "review", "C", "contradiction:fought_within_13_days"),
    (app("not close"), [bout("k", 14)], "exact", "matched", "B", "graph:hometown+jurisdiction+venue+weight"),
    (app("heavier"), [bout("k", -90, weight=175.0)], "exact", "review", "C", "contradiction:weight_incompatible"),
    (app("weight between"), [bout("k", -90, weight=165.0)], "exact", "review", "C", "insufficient_graph_evidence:hometown+jurisdiction+venue"),
    (app("nearest weight"), [bout("k", -90), bout("k", -30, weight=175.0)], "exact", "review", "C", "contradiction:weight_incompatible"),
    (app("old weight"), [bout("k", -401)], "exact", "review", "C", "insufficient_graph_evidence:hometown+jurisdiction+venue"),
    (app("other town", hometown="Riga, Latvia"), [bout("k", -90)], "exact", "review", "C", "contradiction:hometown_different_city"),
    (app("country only", hometown="Poland"), [bout("k", -90)], "exact", "review", "C", "insufficient_graph_evidence:jurisdiction+venue+weight"),
    (app("debut", debut=True), [bout("k", -90)], "exact", "created", "D", "every_name_similar_candidate_conflicts"),
    (app("rematch", opponent_id="z", commission="TX", venue="v7"), [bout("k", -90)], "exact", "matched", "B", "graph:hometown+opponent_graph+weight"),
    (app("is the opponent", opponent_id="k"), [bout("k", -90)], "exact", "created", "D", "every_name_similar_candidate_conflicts"),
    (app("suffix"), [bout("k", -90)], ("containment", True, False, False), "review", "C", "contradiction:suffix_missing"),
    (app("twin"), [bout("k", -90)], ("transliteration", False, True, False), "review", "C", "insufficient_graph_evidence:hometown+jurisdiction+venue+weight"),
]


@pytest.mark.parametrize("case", [CASES[0:12], CASES[12:]])
def test_decisions(spark, case):
    apps, bouts, levels, towns = [], [], [], []
    for i, (a, own, level, *_) in enumerate(case):  # each case has a person of its own
        apps.append({**a, "opponent_id": f"k{i}" if a["opponent_id"] == "k" else a["opponent_id"]})
        bouts += [{**b, "entity_id": f"k{i}"} for b in own]
        levels.append((a["app_id"], f"k{i}", level))
        towns.append((f"k{i}", "lodz,  poland"))
    _, got = run(spark, apps, bouts, levels, towns)
    for a, _, _, *want in case:
        r = got[a["app_id"]]
        assert [r.decision, r.tier, r.reason] == want, (a["app_id"], r)


def test_two_candidates_and_none(spark):
    _, got = run(spark, [app("a"), app("b")], [bout("k", -90), bout("m", -90)], [("a", "k", "exact"), ("a", "m", "exact")])
    assert (got["a"].decision, got["a"].reason, got["a"].candidates) == ("review", "more_than_one_plausible_candidate", 2)
    assert (got["b"].decision, got["b"].candidates) == ("none", 0)


def test_passes_equal_full_recomputation(spark):
    rnd = random.Random(7)
    apps, levels, bouts, towns = [], [], [], []
    people = [f"p{i}" for i in range(40)]
    for p in people:
        towns.append((p, f"town{p}, X"))
        if rnd.random() < 0.7:
            bouts.append(bout(p, rnd.randrange(-300, 1900), opponent_id=rnd.choice(people), commission=rnd.choice("AB"), venue=rnd.choice("vw")))
    for n in range(120):
        a, b = rnd.sample(people, 2)
        day = D + dt.timedelta(days=16 * n)
        for side, who in (("a", a), ("b", b)):
            own = f"{n}{side}"
            apps.append(app(own, other_app=f"{n}{'b' if side == 'a' else 'a'}", date=day, event_id=f"ev{n}", hometown=f"town{who}, X", commission=rnd.choice("AB"), venue=rnd.choice("vw"), bout_id=f"b{n}", bout_order=1))
            levels.append((own, who, "exact"))
            if rnd.random() < 0.3:
                levels.append((own, rnd.choice(people), "exact"))
    (pairs, frame, known, homes), _ = run(spark, apps, bouts, list(dict.fromkeys(levels)), towns)
    got = {r.app_id: (r.entity_id, r.found_in) for r in gr.bound_in_passes(pairs, frame, known, homes, most=4).collect()}

    held, want = {}, {}
    for n in range(1, 5):  # every pass looks at everything again
        rows = [dict(r.asDict(), opponent_id=held.get(r.other_app)) for r in frame.collect()]
        more = [{**{k: r[k] for k in ("bout_id", "event_id", "date", "commission", "venue", "opponent_id", "weight", "bout_order")}, "entity_id": held[r["app_id"]], "complete": True} for r in rows if r["app_id"] in held]
        open_ = spark.createDataFrame([r for r in rows if r["app_id"] not in held], APP)
        all_ = known.unionByName(spark.createDataFrame(more, BOUT)) if more else known
        found = gr.decided(open_, gr.evidence(pairs.join(open_.select("app_id"), "app_id", "left_semi"), open_, all_, homes)).filter("decision = 'matched'").collect()
        if not found:
            break
        held |= {r.app_id: r.entity_id for r in found}
        want |= {r.app_id: (r.entity_id, n) for r in found}
    assert got == want and len({n for _, n in got.values()}) >= 3


def test_fixed_point_ends(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a int, b int")
    step = lambda delta, held: delta.join(edges, delta.n == edges.a).select(F.col("b").alias("n"))
    start = spark.createDataFrame([(0,), (6,), (6,)], "n int")
    got = {r.n: r.found_in for r in gr.fixed_point(start, step, ["n"], 4).collect()}
    assert got == {0: 0, 6: 0, 1: 1, 7: 1, 2: 2, 8: 2, 3: 3, 9: 3, 4: 4}
    assert {r.n for r in gr.fixed_point(start, step, ["n"], 40).collect()} == set(range(10))
    assert gr.fixed_point(start.limit(0), step, ["n"]).count() == 0


def test_pairs_of_names_are_decided_where_they_lie(spark):
    """decided_by_names tells what evidence and decided tell of the same pairs, in tiles of any size; what is shuffled are appearances and persons, not pairs."""
    rnd = random.Random(11)
    names = {"a": ["ann", "anna"], "a, a": ["ann"], "b": ["bob"], "d": ["dan"], "z": []}
    levels = {("a", "ann"): ("exact", False, False, False), ("a", "anna"): ("fuzzy", False, True, False), ("a, a", "ann"): ("containment", True, False, False), ("b", "bob"): ("transliteration", False, False, False), ("d", "dan"): ("exact", False, False, False)}
    of = {f"p{i}": ("ann", "anna", "bob", "cat")[i % 4] for i in range(24)} | {"p24": "dan"}
    towns = [(p, f"town{i % 3}, X") for i, p in enumerate(of) if i % 5 or i == 0] + [("p1", "town9, X")]
    bouts = [{**bout(p, rnd.choice([-900, -401, -400, -90, -13, -2, -1, 0, 1, 14, 300]), opponent_id=rnd.choice(["z", "p0", None]), commission=rnd.choice("AB"), venue=rnd.choice("vw"), event_id=rnd.choice(["ev0", "ev1", "ev2"]), weight=rnd.choice([None, 151.0, 165.0, 190.0]),
        complete=rnd.random() < 0.7), "bout_id": f"b{n}"} for n, p in enumerate(rnd.choices([p for p in of if p != "p2"], k=90)) if p != "p24"]
    bouts.append(bout("p24", -90, commission="A"))
    apps = [app(f"x{n}", name=rnd.choice(list(names)), date=rnd.choice([D, D, D + dt.timedelta(days=5), None]), event_id=rnd.choice(["ev0", "ev1", None]), hometown=rnd.choice(["Town0, X", "town1, x", "X", None]), commission=rnd.choice("AB"), venue=rnd.choice("vw"),
        debut=rnd.random() < 0.2, opponent_id=rnd.choice(["z", "p0", None]), bout_id=rnd.choice(["b1", None]), weight=rnd.choice([150.0, None]), may_create=rnd.choice([True, False, None])) for n in range(150)]
    frame, known, homes = spark.createDataFrame(apps, APP + ", name string"), spark.createDataFrame(bouts, BOUT), spark.createDataFrame(towns, "entity_id string, hometown string")
    pairs = spark.createDataFrame([(a["app_id"], p, *levels[a["name"], k]) for a in apps for p, k in of.items() if k in names[a["name"]]], PAIR)
    want = sorted(map(tuple, gr.decided(frame, gr.evidence(pairs, frame, known, homes)).collect()))
    assert len({r[1] for r in want}) == 4 and len({r[5] for r in want}) >= 8
    persons = spark.createDataFrame(list(of.items()), "entity_id string, known string")
    alike = spark.createDataFrame([(*k, *v) for k, v in levels.items()], "name string, known string, level string, suffix_missing boolean, given_differs boolean, suffix_conflict boolean")
    for tile in (1_000, 4, 1):
        found = gr.decided_by_names(frame, persons, alike, known.join(persons, "entity_id"), homes, tile=tile)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    paired = plan[: plan.index("__rank")]
    assert paired.count("Exchange") <= 1
    assert gr.decided_by_names(frame.limit(0), persons, alike, known.join(persons, "entity_id"), homes).count() == 0
