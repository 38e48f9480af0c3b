"""Changes between two lists, by stated cases."""

from tessera.operators.rankings import ranking_changes

SCHEMA = "board int, entity_id string, source_name string, position int, rank int, rank_label string, is_champion boolean, is_vacant boolean, designation string, mandatory boolean"


def listed(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def place(position, label, entity, champion=None, designation=None, mandatory=None, name=None, vacant=None, board=1):
    return board, entity, name, position, int(label) if label.isdigit() else None, label, champion, vacant, designation, mandatory


def told(df):
    return [f"{r.type}:{(r.key or '').removeprefix('id:')}" for r in df.orderBy("type_order", "position").collect()]


def test_every_kind(spark):
    old = listed(spark, place(1, "C", "champ", True), place(2, "1", "x"), place(3, "2", "y", mandatory=False), place(4, "3", "z"))
    new = listed(spark, place(1, "C", "x", True), place(2, "1", "y", designation="Mandatory", mandatory=True), place(3, "2", "new"), place(4, "3", "champ"))
    assert told(ranking_changes(old, new, ["board"])) == [
        "champion_changed:", "became_champion:x", "no_longer_champion:champ", "moved_up:y", "new_entrant:new", "removed:z", "designation_changed:y", "mandatory_changed:y",
    ]


def test_vacant_slot_and_names(spark):
    old = listed(spark, place(1, "C", "champ", True), place(2, "1", None, name="Unmatched Person"))
    new = listed(spark, place(1, "C", None, vacant=True), place(2, "1", "champ"), place(3, "2", None, name="Unmatched  person "))
    got = ranking_changes(old, new, ["board"])
    assert told(got) == ["title_vacant_in_ranking:", "no_longer_champion:champ", "moved_down:name:unmatched person"]
    assert [r.unresolved for r in got.filter("type = 'moved_down'").collect()] == [True]


def test_missing_lists_and_marks(spark):
    none = listed(spark).limit(0)
    some = listed(spark, place(1, "C", "a", True), place(2, "1", "b", mandatory=True), place(3, "2", None))
    assert told(ranking_changes(some, none, ["board"])) == [] and told(ranking_changes(none, none, ["board"])) == []
    assert told(ranking_changes(none, some, ["board"])) == ["new_champion_listed:a", "new_entrant:b"]
    assert told(ranking_changes(some, some, ["board"])) == []
    unstated = listed(spark, place(1, "C", "a", True), place(2, "1", "b"), place(3, "9", "b"))  # the last place of a key counts
    assert told(ranking_changes(some, unstated, ["board"])) == ["moved_down:b"]
