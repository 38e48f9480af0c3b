"""Entity resolution that fails closed: names become keys, keys become candidates, one candidate or none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(name: Column) -> Column:
    """Lower case without accents; a vectorised function, as Spark has no Unicode normalisation."""

    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if not unicodedata.combining(c)))

    return F.pandas_udf(fold, "string")(name)


SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]  # fixed values: generation suffixes


def tokens(name: Column) -> Column:
    """Words of letters and digits of a folded name, without generation suffixes."""
    words = F.split(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(SUFFIXES))


def first_last(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1)))


def name_keys(words: Column) -> Column:
    """Blocking keys `kind:key`: the whole name, its sorted words, first and last word, initial and last word."""
    last = F.element_at(words, -1)
    keys = F.array(
        F.concat(F.lit("full:"), F.array_join(words, " ")), F.concat(F.lit("sorted:"), F.array_join(F.array_sort(words), " ")),
        F.concat(F.lit("ends:"), first_last(words)), F.concat(F.lit("initial:"), F.substring(F.element_at(words, 1), 1, 1), F.lit(" "), last),
    )
    return F.when(F.size(words) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def contained(short: Column, long: Column) -> Column:
    """Whether all words of the shorter name stand in the longer one in order, both beginning with the same word."""
    rest = F.aggregate(short, F.struct(long.alias("left"), F.lit(True).alias("ok")), lambda acc, w: F.struct(
        F.slice(acc.left, F.array_position(acc.left, w).cast("int") + 1, F.greatest(F.size(acc.left), F.lit(0))).alias("left"), (acc.ok & F.array_contains(acc.left, w)).alias("ok"),
    ))
    return (F.size(short) > 0) & (F.get(short, F.lit(0)).eqNullSafe(F.get(long, F.lit(0)))) & rest.ok


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as a shuffle has, however small it is: where few rows make very many, few partitions would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Words of 64 bits of a row's bitmap of trigrams.
WORDS = 4


def similar_pairs(df: DataFrame, id_: str, text: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs with trigram Jaccard of at least `least`, complete by prefix filtering; ids are unique.

    In a common rare-first order of trigrams a pair that similar shares one of the first n - ceil(least n) + 1 of the larger and of the first n - ceil(2 least / (1 + least) n) + 1 of the smaller one, so only those meet, and
    common trigrams, which stand last, hardly ever do. Rows bring their trigrams along as numbers and as a bitmap: a pair is decided where its first common trigram meets, and no candidates are shuffled.
    """
    grams = df.select(F.col(id_).alias("id"), trigrams(F.col(text)).alias("grams")).filter(F.size("grams") > 0)
    each = grams.select("id", F.explode("grams").alias("g"))
    # a trigram's number orders by how often it stands, then by its three signs; there are 37 ** 3 at most
    sign = lambda i: F.ascii(F.substring("g", i, 1)).cast("long")
    ranks = each.groupBy("g").agg(F.count("*").alias("n")).select("g", (F.col("n") * 2**21 + sign(1) * 2**14 + sign(2) * 2**7 + sign(3)).alias("r"))
    ordered = each.join(F.broadcast(ranks), "g").groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("o")).withColumn("n", F.size("o"))
    # trigrams as a bitmap: each bit that two bitmaps differ in is a trigram at least that only one of them has, so that hardly any pair's trigrams must be compared themselves
    bit = lambda r: F.pmod(F.xxhash64(r), F.lit(64 * WORDS))
    word = lambda i: F.aggregate(F.filter("o", lambda r: F.floor(bit(r) / 64) == i), F.lit(0).cast("long"), lambda have, r: have.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(r) % 64).cast("int"))))
    ordered = ordered.withColumns({f"w{i}": word(i) for i in range(WORDS)})
    least = least - 1e-6  # what rounds up to it

    def begun(share: float, to: str) -> DataFrame:
        """Rows for each trigram of the prefix that a share of common trigrams needs."""
        prefix = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * share).cast("int") + 1)
        return spread(ordered.select(F.col("id").alias(f"{to}_id"), F.col("n").alias(f"{to}_n"), F.col("o").alias(f"{to}_o"), *[F.col(f"w{i}").alias(f"{to}_w{i}") for i in range(WORDS)], F.posexplode(prefix).alias(f"{to}_at", "g")), "g")

    x, y = begun(2 * least / (1 + least), "x"), begun(least, "y")
    col = F.col
    smaller = (col("x_n") < col("y_n")) | ((col("x_n") == col("y_n")) & (col("x_id") < col("y_id")))
    # were this the first common trigram, so many could follow
    needed = (col("x_n") + col("y_n")) * (least / (1 + least))
    possible = (col("x_n") >= col("y_n") * least) & (F.least(col("x_n") - col("x_at"), col("y_n") - col("y_at")) >= needed)
    differing = sum((F.bit_count(col(f"x_w{i}").bitwiseXOR(col(f"y_w{i}"))) for i in range(1, WORDS)), F.bit_count(col("x_w0").bitwiseXOR(col("y_w0"))))
    cheap = smaller & possible & (differing <= col("x_n") + col("y_n") - 2 * needed)
    common = F.array_intersect("x_o", "y_o")
    similarity = F.round(F.size(common) / (col("x_n") + col("y_n") - F.size(common)), 6)
    # one condition: of several filters the last is asked first, and trigrams were compared before the cheap conditions
    alike = F.when(cheap, (F.get(common, F.lit(0)) == col("g")) & (F.size(common) >= needed) & (similarity >= least + 1e-6)).otherwise(F.lit(False))
    met = x.join(y, "g").filter(alike)
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), similarity.alias("similarity"))


def one_candidate(probes: DataFrame, entities: DataFrame, keys: list[str], probe_id: str, entity_id: str) -> DataFrame:
    """(probe, outcome, entity): matched where exactly one entity has the probe's keys, else ambiguous or unmatched."""
    met = probes.join(entities, keys, "left").groupBy(probe_id).agg(F.count_distinct(entity_id).alias("n"), F.min(entity_id).alias("one"))
    outcome = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return met.select(probe_id, outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias(entity_id), F.col("n").alias("candidates"))


def canonical(df: DataFrame, merges: DataFrame, id_: str, old: str = "merged_id", new: str = "into_id") -> DataFrame:
    """Ids with one hop of merges applied."""
    m = merges.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, df[id_] == m["__old"], "left").withColumn(id_, F.coalesce("__new", id_)).drop("__old", "__new")


# What sources print where no name is known yet, and how long a name is.
UNNAMED, UNNAMED_PHRASES, NO_ONE = ["tbd", "tba", "tbc"], ["to be announced", "to be confirmed", "to be determined"], "opponent"
LEAST_LETTERS, MOST_CHARACTERS = 4, 120


def name_quality(name: Column) -> Column:
    """ok, or why a printed name is no name: placeholder (also without letters and digits), short or long.

    A placeholder names no one word by word: after one leading `opponent` it begins with a word or phrase that stands for a name, and goes on with such words or `opponent` only. Letters that stand apart are read as one
    word, and a word may be several such words run together.
    """
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    apart = F.forall(words, lambda w: w.rlike("^[a-z]$"))
    whole = F.when(apart & (F.size(words) > 0), F.array(F.array_join(words, ""))).otherwise(words)
    later = F.when((F.size(whole) > 1) & (F.get(whole, F.lit(0)) == NO_ONE), F.slice(whole, F.lit(2), F.size(whole) - 1)).otherwise(whole)
    phrase = F.array_join(F.slice(later, 1, 3), " ").isin(UNNAMED_PHRASES)
    begins, rest = phrase | F.get(later, F.lit(0)).isin(UNNAMED), F.slice(later, F.when(phrase, 4).otherwise(2), F.greatest(F.size(later), F.lit(1)))
    one = F.get(whole, F.lit(0))
    run_together = (F.size(whole) == 1) & ((one == NO_ONE) | (F.length(one) % 3 == 0) & F.forall(F.sequence(F.lit(1), F.length(one) - 2, F.lit(3)), lambda i: F.substring(one, i, F.lit(3)).isin(UNNAMED)))
    unnamed = (F.size(words) == 0) | run_together | (begins & F.forall(rest, lambda w: w.isin([*UNNAMED, NO_ONE])))
    letters = F.length(F.array_join(words, ""))
    return F.when(F.coalesce(unnamed, F.lit(False)), "placeholder").when(letters < LEAST_LETTERS, "short").when(letters + F.size(words) - 1 > MOST_CHARACTERS, "long").otherwise("ok")


def edit_pairs(df: DataFrame, value: str, edits: int) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different values at most `edits` edits apart; nulls pair with nothing.

    A value is cut into edits + 1 pieces, one of which stands unchanged in any value so near, moved by at most half of `edits` and of the difference in length: the pieces meet in an equi-join, and what meets is measured. Values of at
    most `edits` characters have no such pieces and meet by their lengths.
    """
    d = edits
    v = spread(df.select(F.col(value).alias("v")).filter("v IS NOT NULL").distinct(), "v").withColumn("m", F.length("v"))
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("m") * i / (d + 1)).cast("int").alias("at"), F.floor(F.col("m") * (i + 1) / (d + 1)).cast("int").alias("to")) for i in range(d + 1)])
    base = v.filter(F.col("m") > d).select(F.col("v").alias("a"), F.col("m").alias("n"), F.explode(pieces).alias("p"))
    base = base.select("a", "n", F.col("p.i").alias("i"), F.substring("a", F.col("p.at") + 1, F.col("p.to") - F.col("p.at")).alias("piece"))
    # the shorter one's pieces are looked for in the longer one; a piece moved by s leaves at least |s| edits before it and |m - n - s| behind it
    asked = v.filter(F.col("m") > d).select("v", "m", F.explode(F.sequence(F.greatest(F.lit(d + 1), F.col("m") - d), F.col("m"))).alias("n"))
    longer = F.col("m") - F.col("n")
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumn("shift", F.explode(F.sequence(-F.floor((d - longer) / 2), F.floor((d + longer) / 2))))
    at = F.floor(F.col("n") * F.col("i") / (d + 1)).cast("int")
    size = F.floor(F.col("n") * (F.col("i") + 1) / (d + 1)).cast("int") - at
    asked = asked.withColumn("at", at + F.col("shift")).withColumn("size", size).filter("at >= 0 AND at + size <= m")
    asked = asked.select("v", "n", "i", F.substring("v", (F.col("at") + 1).cast("int"), F.col("size")).alias("piece"))
    met = base.join(asked, ["n", "i", "piece"]).select("a", F.col("v").alias("b"))
    short = v.filter(F.col("m") <= d).select(F.col("v").alias("a"), F.explode(F.sequence(F.lit(0), F.col("m") + d)).alias("m"))
    met = met.union(short.join(v, "m").select("a", F.col("v").alias("b"))).filter("a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", d).cast("long")).filter("distance >= 0")


def scrubbed(text: Column) -> Column:
    """Mail addresses, IPv4 addresses and long digit runs replaced by their kind."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[mail]")
    out = F.regexp_replace(out, r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "[ip]")
    return F.regexp_replace(out, r"[0-9]{9,}", "[number]")


def date_likeness(seen: Column, known: Column, seen_digits: Column | None = None, known_digits: Column | None = None) -> Column:
    """How two dates of one thing compare: exact, typo_like (day and month exchanged, a day apart, or one digit differs), conflict, or unknown where one is null. Their digits (yyyyMMdd) can be given for who has them at hand."""
    digits = lambda c: F.date_format(c, "yyyyMMdd")
    a, b = digits(seen) if seen_digits is None else seen_digits, digits(known) if known_digits is None else known_digits
    exchanged = (F.year(seen) == F.year(known)) & (F.month(seen) == F.day(known)) & (F.day(seen) == F.month(known))
    differing = sum(((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(2, 9)), (F.substring(a, 1, 1) != F.substring(b, 1, 1)).cast("int"))
    return F.when(seen.isNull() | known.isNull(), "unknown").when(seen == known, "exact").when(exchanged | (F.abs(F.date_diff(seen, known)) <= 1) | (differing == 1), "typo_like").otherwise("conflict")


# Digits of a hashed id, and how many of its first an address may have.
ID_DIGITS, LEAST_DIGITS = 32, 12


def by_id_prefix(asked: DataFrame, prefix: str, entities: DataFrame, id_: str) -> DataFrame:
    """asked with outcome, the entity whose hashed id begins with `prefix`, and how many do: matched where one does, ambiguous where several, unmatched; also where `prefix` isn't LEAST_DIGITS to ID_DIGITS lower-case hex digits.

    Both sides meet by their first LEAST_DIGITS digits, an equi-join and not LIKE; what goes on differently is dropped then.
    """
    whole = F.substring(F.sha2(F.col(id_).cast("string"), 256), 1, ID_DIGITS)
    ids = entities.select(whole.alias("__whole"), F.col(id_).alias("__id")).distinct().withColumn("__first", F.substring("__whole", 1, LEAST_DIGITS))
    refs = asked.select(F.col(prefix).alias("__ref")).distinct().filter(F.col("__ref").rlike(f"^[0-9a-f]{{{LEAST_DIGITS},{ID_DIGITS}}}$"))
    met = refs.withColumn("__first", F.substring("__ref", 1, LEAST_DIGITS)).join(ids, "__first").filter(F.startswith(F.col("__whole"), F.col("__ref")))
    found = met.groupBy("__ref").agg(F.count("*").alias("candidates"), F.min("__id").alias("__one"))
    out = asked.join(found, asked[prefix] == found["__ref"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    outcome = F.when(F.col("candidates") == 1, "matched").when(F.col("candidates") > 1, "ambiguous").otherwise("unmatched")
    return out.withColumn("outcome", outcome).withColumn(id_, F.when(F.col("candidates") == 1, F.col("__one"))).drop("__ref", "__one")
