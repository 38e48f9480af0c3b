import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import names as nm
from tessera.operators import resolution as rs

ATTRIBUTES = "dob date, sex string, nationalities array<string>, stance string, height int, reach int, divisions array<int>, hometown string, promoter string"
ENTITY = f"entity_id string, names array<struct<text: string, kind: string, state: string>>, {ATTRIBUTES}, bouts array<struct<opponent: string, date: date>>, identities array<struct<namespace: string, external_id: string, state: string>>"
OBSERVED = f"obs_id string, namespace string, external_id string, names array<string>, dob_precision string, {ATTRIBUTES}, opponents array<string>, bout_opponent string, bout_date date, scope array<string>, may_create boolean"
BORN = dt.date(1994, 3, 5)


def entity(id_, *names, bouts=(), ids=(), **more):
    given = {"dob": None, "sex": None, "nationalities": None, "stance": None, "height": None, "reach": None, "divisions": None, "hometown": None, "promoter": None, **more}
    return {"entity_id": id_, "names": [(n, "name", "verified") if isinstance(n, str) else n for n in names], "bouts": list(bouts), "identities": list(ids), **given}


ENTITIES = [
    entity("ana", "Pavel Ruzicka", dob=BORN, nationalities=["CZ"], divisions=[9], sex="male", ids=[("reg", "1", "verified")]),
    entity("bob", "Pavel Ruzicka", dob=dt.date(1988, 1, 1), nationalities=["US"], divisions=[12], sex="male"),
    entity("cia", "Ivo Mertens Sr.", dob=dt.date(1960, 1, 1)),
    entity("dan", "Ivo Mertens Jr.", dob=dt.date(1990, 7, 7), nationalities=["BE"]),
    entity("eve", "Solomon Achterberg", ("The Crane", "nickname", "verified"), dob=dt.date(1991, 2, 3), nationalities=["NL"], divisions=[18], ids=[("reg", "5", "rejected"), ("feed", "77", "verified")]),
    entity("fay", "Olexiy Hrabovsky", "Олексій Грабовський", dob=dt.date(1993, 9, 30), bouts=[("x1", dt.date(2020, 5, 5)), ("x2", dt.date(2021, 1, 1))]),
    entity("gus", "Dorota Lindholm", dob=dt.date(1996, 12, 1), nationalities=["PL"], sex="female"),
    entity("hal", "Viktor Brandauer", stance="orthodox", height=180, reach=185, hometown="Linz", divisions=[13]),
]
CASES = [  # what is observed, outcome, reason, entity, verification
    (dict(names=["Pavel Růžička"], dob=BORN), "matched", "name_exact", "ana", "verified"),
    (dict(names=["Ruzicka, Pavel"], dob=BORN), "matched", "name_exact", "ana", "verified"),
    (dict(names=["Pavel Ruzicka"]), "review", "ambiguous", None, None),
    (dict(names=["Pavel Ruzicka"], dob=dt.date(2001, 6, 6)), "created", "distinct_from_candidates", None, "verified"),
    (dict(names=["Pavel Ruzicka"], dob=dt.date(2001, 6, 6), may_create=False), "unresolved", "all_candidates_conflict", None, None),
    (dict(names=["Ivo Mertens Jr"], dob=dt.date(1990, 7, 7)), "matched", "name_exact", "dan", "verified"),
    (dict(names=["Ivo Mertens"]), "review", "ambiguous", None, None),
    (dict(names=["Ivo Mertens Sr"]), "review", "insufficient_evidence", None, None),
    (dict(names=["The Crane"], dob=dt.date(1991, 2, 3), nationalities=["nl"], divisions=[17]), "matched", "name_nickname", "eve", "probable"),
    (dict(names=["The Crane"], nationalities=["NL"]), "review", "weak_name_only", None, None),
    (dict(names=["Олексій Грабовський"], dob=dt.date(1993, 9, 30)), "matched", "name_exact", "fay", "verified"),
    (dict(names=["Aleksey Grabovsky"], dob=dt.date(1993, 9, 30)), "review", "given_name_variant", None, None),
    (dict(names=["Aleksey Grabovsky"], opponents=["x1", "x2", "x9"]), "matched", "name_transliteration", "fay", "probable"),
    (dict(names=["Olexiy Hrabovsky"], bout_opponent="x2", bout_date=dt.date(2021, 1, 4)), "matched", "name_exact", "fay", "probable"),
    (dict(names=["Olexiy Hrabovsky"], bout_opponent="x2", bout_date=dt.date(2021, 1, 5)), "review", "insufficient_evidence", None, None),
    (dict(names=["Pavel Ruzicka"], dob=dt.date(1994, 3, 6)), "review", "dob_mismatch", None, None),
    (dict(names=["Dorota Nowak"], dob=dt.date(1996, 12, 1), nationalities=["PL"]), "review", "possible_name_change", None, None),
    (dict(names=["Dorota Lindholm"], dob=dt.date(1996, 12, 1), sex="male"), "review", "contradictory_evidence", None, None),
    (dict(names=["Dorota Lindholm"], dob=dt.date(1996, 12, 1), nationalities=["GB"]), "review", "nationality_conflict", None, None),
    (dict(names=["Viktor Brandauer"], stance="southpaw"), "review", "attribute_conflict", None, None),
    (dict(names=["Viktor Brandauer"], divisions=[3]), "review", "attribute_conflict", None, None),
    (dict(names=["Viktor Brandauer"], stance="orthodox", height=182, reach=186, hometown="linz", divisions=[14]), "review", "insufficient_evidence", None, None),
    (dict(names=["V. Brandauer"], may_create=False), "review", "weak_name_only", None, None),
    (dict(names=["V. Brandauer"], may_create=False, scope=["hal", "gus"]), "matched", "bout_scope", "hal", "probable"),
    (dict(names=["Brandauer"], may_create=False, scope=["hal", "gus"]), "matched", "bout_scope", "hal", "probable"),
    (dict(names=["Pavel Ruzicka"], may_create=False, scope=["hal", "gus"]), "unresolved", "no_candidates", None, None),
    (dict(names=["Any Other"], namespace="reg", external_id="1"), "matched", "external_id", "ana", "verified"),
    (dict(names=["Pavel Ruzicka"], namespace="reg", external_id="1", dob=dt.date(1970, 1, 1)), "review", "mapped_identity_conflict", None, None),
    (dict(names=["Pavel Ruzicka"], namespace="reg", external_id="9", dob=BORN), "review", "namespace_id_conflict", None, None),
    (dict(names=["Solomon Achterberg"], namespace="reg", external_id="5", dob=dt.date(1991, 2, 3)), "created", "distinct_from_candidates", None, "verified"),
    (dict(names=["Viktor Brandauer"], dob_precision="year"), "review", "insufficient_evidence", None, None),
    (dict(names=["Viktor Brandaver"]), "created", "no_candidates", None, "verified"),  # near, but of no key in common
    (dict(names=["Nobody Like This"]), "created", "no_candidates", None, "verified"),
    (dict(names=["  --- "]), "rejected", "invalid_observation", None, None),
    (dict(names=["Pavel Ruzicka"], sex="other?"), "rejected", "invalid_observation", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i, (given, *_) in enumerate(CASES):
        row = {"obs_id": f"{i:02d}", "namespace": "feed2", "external_id": f"f{i}", "dob_precision": "day", "may_create": True}
        row |= {c.split()[0]: None for c in ("dob", "sex", "nationalities", "stance", "height", "reach", "divisions", "hometown", "promoter", "opponents", "bout_opponent", "bout_date", "scope")}
        rows.append(row | given)
    return spark.createDataFrame(rows, OBSERVED), spark.createDataFrame(ENTITIES, ENTITY)


def test_decisions(tables):
    got = {r.obs_id: r for r in rs.resolve(*tables).collect()}
    assert len(got) == len(CASES)
    for i, (given, *want) in enumerate(CASES):
        r = got[f"{i:02d}"]
        assert (r.outcome, r.reason, r.entity_id, r.verification) == tuple(want), (given, r)
        assert r.outcome != "review" or r.candidates >= 1


def test_hot_keys_and_order_change_nothing(tables):
    observations, entities = tables
    want = sorted(map(tuple, rs.resolve(observations, entities).collect()), key=str)
    assert sorted(map(tuple, rs.resolve(observations.repartition(7), entities.orderBy("entity_id", ascending=False), hot=1).collect()), key=str) == want


def test_nothing_known(tables):
    observations, entities = tables
    got = rs.resolve(observations, entities.limit(0)).groupBy("outcome").count().collect()
    assert {r.outcome for r in got} == {"created", "unresolved", "rejected"}
    assert rs.resolve(observations.limit(0), entities).count() == 0


def test_a_name_whose_words_have_one_skeleton_against_the_sql(spark, tmp_path):
    """karel amadeus quoriwex and karel quoriyel, both of one birthday: the skeletons of the second are one word twice."""
    import duckdb

    from tessera.plans import identities

    duck = duckdb.connect()
    for name, rows in (("customer", "SELECT k AS c_custkey, 3 AS c_nationkey FROM (VALUES (28450::BIGINT), (70450)) t(k)"), ("orders", "SELECT 255653::BIGINT AS o_orderkey, 28450::BIGINT AS o_custkey")):
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    want = duck.execute(identities.RESOLVED).fetchall()
    assert [tuple(r) for r in identities.identity_resolve(spark, str(tmp_path)).collect()] == want and want[0][1:3] == ("review", "ambiguous")
    names = spark.createDataFrame([("karel amadeus quoriwex", "karel quoriyel")], "a string, b string").select(nm.parsed(nm.romanised("a")).alias("a"), nm.parsed(nm.romanised("b")).alias("b"))
    level = lambda counted: names.select(nm.compared(F.col("a"), F.col("b"), F.lit(False), counted).level).first()[0]
    assert (level(True), level(False)) == ("none", "containment")


def test_pairs_are_decided_where_they_lie(spark, tables):
    """Only one exchange lies above the join of the keys: a row for each observation and key, no pairs. Of several names the best one counts, also where only a birthday is shared."""
    observations, entities = tables
    row = observations.filter("obs_id = '00'").first().asDict()
    born = lambda id_, *names, **more: {**row, "obs_id": id_, "names": list(names), **more}
    asked = spark.createDataFrame([born("a", "Nobody Here", "Pavel Ruzicka"), born("b", "Pavle Ruzickaa Jr", "Dorota Lindholm", dob=dt.date(1990, 7, 7)), born("c", "Pavel Ruzicka", "Ruzicka, Pavel", dob=None), born("d", "Pavel Ruzickax", nationalities=["CZ"], divisions=[9])], OBSERVED)
    for hot in (1_000, 1):
        found = rs.resolve(asked, entities, hot=hot)
        got = {r.obs_id: (r.outcome, r.reason, r.entity_id, r.candidates) for r in found.collect()}
        assert got == {"a": ("matched", "name_exact", "ana", 1), "b": ("created", "distinct_from_candidates", None, 3), "c": ("review", "ambiguous", None, 2), "d": ("matched", "name_fuzzy", "ana", 0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan[: plan.index("Join")].count("Exchange") == 1
