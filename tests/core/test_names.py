import pytest
from pyspark.sql import functions as F

from tessera.operators import names as nm


@pytest.fixture(scope="module")
def parse(spark):
    def run(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", nm.romanised("t"))
        return [r.p for r in df.select("i", nm.parsed(F.col("f")).alias("p")).orderBy("i").collect()]

    return run


def test_letters(parse):
    got = parse("José  Núñez", "Seán O'Brien", "Łukasz Różański", "Олександр Гвозденко", "井上 尚弥", "Straße ÆØ", "  ---  ", "Anna Smith-Jones", "Anna SmithJones")
    assert [p.full for p in got[:6]] == ["jose nunez", "sean obrien", "lukasz rozanski", "oleksandr gvozdenko", "井上 尚弥", "strasse aeo"]
    assert got[6].core == [] and got[6].keys == [] and got[7].core == ["anna", "smith", "jones"] and got[7].joined == got[8].joined


def test_parts(parse):
    a, b, c, d, e, f, g, h = parse("Rafael Mendoza, Jr.", "Robert Lee III", 'Emmanuel "The Hammer" Okafor', "Kofi Boateng (Iron)", "Oscar De La Torre", "Núñez, José Ramón", "J. Smith", "Jr")
    assert (a.full, a.suffix, b.full, b.suffix) == ("rafael mendoza", "jr", "robert lee", "iii")
    assert c.full == "emmanuel okafor" and "nick:tg gmr" in c.keys and "nick:arn" in d.keys
    assert e.core == ["oscar", "torre"] and e.joined == "oscardelatorre" and f.full == "jose ramon nunez"
    assert g.initial == "j" and (h.core, h.suffix) == (["jr"], None)
    assert {"full:rafael mendoza", "part:mendoza rafael", "init:r mndz"} <= set(a.keys)


def test_skeletons(spark):
    alike = [("oleksandr", "alexander"), ("hvozdyk", "gvozdik"), ("mykhailo", "mikhail"), ("kowalski", "kovalski"), ("petroff", "petrov"), ("yevgeny", "evgenii")]
    got = spark.createDataFrame([*alike, ("smith", "jones")], "a string, b string").select((nm.skeleton(F.col("a")) == nm.skeleton(F.col("b"))).alias("same")).collect()
    assert [r.same for r in got] == [True] * 6 + [False]


CASES = [  # seen, known, level, suffix conflict, suffix missing, first names differ
    ("Naoya Inoue", "Inoue Naoya", "reordered", False, False, False),
    ("José Núñez", "jose nunez", "exact", False, False, False),
    ("Anna Smith-Jones", "Anna Smithjones", "joined", False, False, False),
    ("Carlos Gutierrez", "Carlos Andrés Gutiérrez Salazar", "containment", False, False, False),
    ("J. Smith", "John Smith", "initial", False, False, False),
    ("Smith", "John Smith", "surname", False, False, False),
    ("Tomasz Wieczorkek", "Tomasz Wieczorek", "transliteration", False, False, False),
    ("Samuel Adeyeni", "Samuel Adeyemi", "fuzzy", False, False, False),
    ("Samuil Adeyeni", "Samuel Adeyemi", "none", False, False, False),
    ("Darian Vance", "Dorian Vance", "transliteration", False, False, True),
    ("Aleksandr Gvozdenko", "Oleksandr Hvozdenko", "transliteration", False, False, True),
    ("Rafael Mendoza", "Rafael Mendoza Jr.", "containment", False, True, False),
    ("Rafael Mendoza Sr", "Rafael Mendoza Jr.", "none", True, False, False),
    ("Peter Long", "Maria Short", "none", False, False, False),
    ("---", "Maria Short", "none", False, False, False),
    ("de la Cruz", "Oscar Cruz", "none", False, False, False),
]


def test_levels(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], "i int, a string, b string").withColumns({"a": nm.romanised("a"), "b": nm.romanised("b")})
    df = df.select("i", nm.parsed(F.col("a")).alias("a"), nm.parsed(F.col("b")).alias("b"))
    got = df.select("i", nm.compared(F.col("a"), F.col("b"), F.lit(False)).alias("x"), nm.compared(F.col("a"), F.col("b"), F.lit(True)).alias("nick")).orderBy("i").collect()
    assert [tuple(r.x) for r in got] == [c[2:] for c in CASES]
    nick = spark.createDataFrame([("The Hammer",), ('Emmanuel "The Hammer" Okafor',), ("Hammer Man",)], "a string").select(nm.parsed(nm.romanised("a")).alias("a"), nm.parsed(nm.romanised(F.lit("The Hammer"))).alias("b"))
    assert [r.x.level for r in nick.select(nm.compared(F.col("a"), F.col("b"), F.lit(True)).alias("x")).collect()] == ["nickname", "nickname", "none"]
