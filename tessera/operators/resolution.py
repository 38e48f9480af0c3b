"""Who is meant: observations meet candidates by keys, evidence is weighed for and against each, and one decision is taken, or none.

Observations: obs_id, namespace, external_id, names array<string> (the displayed one first), dob, dob_precision, sex, nationalities, stance, height, reach, divisions array<int> (places in their order),
hometown, promoter, opponents array<string>, bout_opponent, bout_date, scope array<string> (the only ones it can be, or null), may_create. Entities: entity_id, names array<struct<text, kind, state>> (the
displayed one first, kind name or nickname), the same attributes, bouts array<struct<opponent, date>>, identities array<struct<namespace, external_id, state>>. Attributes may be null: what is not known counts
neither for nor against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import place_in
from tessera.operators import names as nm
from tessera.operators.identity import date_likeness
from tessera.sources.shared import cut

# What a strong, a medium and a soft contrary sign count, the most a score can be, and days between two reports of one contest.
STRONG_SCORE, MEDIUM_SCORE, SOFT_SCORE, MOST, SAME_CONTEST_DAYS = 25, 4, 15, 99, 3
#: Names, observations or entities of one key beyond which it is dealt out, and pairs that a task is given.
HOT, PAIRS_A_TASK = 1_000, 500_000
# Signs that rule a candidate out, speak against it, and for it, strongly or less so.
HARD = ["suffix_conflict", "dob_conflict", "sex_conflict", "previously_rejected"]
SOFT = ["suffix_missing", "dob_typo_like", "namespace_id_conflict", "nationality_conflict", "stance_conflict", "physical_conflict", "division_conflict"]
STRONG = ["dob_exact", "opponents_overlap_2plus", "bout_context"]
MEDIUM = ["dob_year_match", "nationality_match", "stance_match", "physical_match", "division_match", "hometown_match", "promoter_match", "opponents_overlap"]
SEXES = ["male", "female", "other", "unknown"]


def named(df: DataFrame, id_: str, texts: Column) -> DataFrame:
    """(id, at, kind, p): the parsed names of each row, in order. texts is an array of struct<text, kind>."""
    each = df.select(id_, F.posexplode(texts).alias("at", "n")).filter("n.text IS NOT NULL").select(id_, "at", "n.kind", nm.romanised(F.col("n.text")).alias("folded"))
    return each.select(id_, "at", "kind", nm.parsed(F.col("folded")).alias("p"))


def name_evidence(pairs: DataFrame, seen: DataFrame, known: DataFrame, counted: bool = True) -> DataFrame:
    """pairs with level, suffix_missing and given_differs of their best names (the first of equals) and suffix_conflict of any."""
    o = seen.select("obs_id", F.col("at").alias("__o"), F.col("p").alias("__seen"))
    c = known.select("entity_id", F.col("at").alias("__c"), "kind", F.col("p").alias("__known"))
    met = pairs.join(o, "obs_id").join(c, "entity_id").select("obs_id", "entity_id", "__o", "__c", nm.compared(F.col("__seen"), F.col("__known"), F.col("kind") == "nickname", counted).alias("x"))
    better = F.when(~F.col("x.suffix_conflict") & (F.col("x.level") != "none"), F.struct(place_in(nm.LEVELS, F.col("x.level")), "__o", "__c"))
    found = met.groupBy("obs_id", "entity_id").agg(F.min_by("x", better).alias("best"), F.bool_or("x.suffix_conflict").alias("suffix_conflict"))
    out = pairs.join(found, ["obs_id", "entity_id"], "left")
    no = F.lit(False)
    return out.select(
        "obs_id", "entity_id", F.coalesce("best.level", F.lit("none")).alias("level"), F.coalesce("best.suffix_missing", no).alias("suffix_missing"), F.coalesce("best.given_differs", no).alias("given_differs"),
        F.coalesce("suffix_conflict", no).alias("suffix_conflict"),
    )


def _texts(names: DataFrame) -> DataFrame:
    """(text, kind, p, keys): each different name once, parsed."""
    folded = names.filter("text IS NOT NULL").distinct().withColumn("folded", nm.romanised(F.col("text")))
    return cut(folded.select("text", "kind", nm.parsed(F.col("folded")).alias("p"))).select("text", "kind", F.col("p").dropFields("keys").alias("p"), F.col("p.keys").alias("keys"))


def alike_texts(said: DataFrame, known: DataFrame, hot: int, counted: bool) -> DataFrame:
    """(said, known, kind, x): observed and known names that share a key, once, and how they compare. A key of more than `hot` known names is dealt to parts, and who asks for it asks each part."""
    nick, plain = F.filter("keys", lambda k: k.startswith("nick:")), F.filter("keys", lambda k: ~k.startswith("nick:"))
    # nicknames are met by whole observed names and nicknames; a known ordinary name of several words has no such key
    of_known = F.when(F.col("kind") == "nickname", nick).when(F.size("p.core") == 1, F.col("keys")).otherwise(F.concat(plain, F.slice(nick, F.lit(2), F.greatest(F.size(nick) - 1, F.lit(0)))))
    index, asks = known.select(F.col("text").alias("known"), "kind", F.explode(of_known).alias("key")), said.select(F.col("text").alias("said"), F.explode("keys").alias("key"))
    parts = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    dealt = index.join(parts, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("known"), F.col("parts")).cast("int"), F.lit(0)))
    asking = asks.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = asking.join(dealt.drop("parts"), ["key", "part"]).select("said", "known", "kind").distinct()
    met = met.join(said.select(F.col("text").alias("said"), F.col("p").alias("__seen")), "said").join(known.select(F.col("text").alias("known"), "kind", F.col("p").alias("__known")), ["known", "kind"])
    return met.select("said", "known", "kind", nm.compared(F.col("__seen"), F.col("__known"), F.col("kind") == "nickname", counted).alias("x"))


def _with_names(df: DataFrame, id_: str, table: DataFrame) -> DataFrame:
    """df with `__names` instead of names (array of struct<text, kind>): a struct of the place and the table's columns for each name, in order. Only rows of several names are gathered."""
    n = F.coalesce(F.size("names"), F.lit(0))

    def told(rows: DataFrame) -> DataFrame:
        found = rows.withColumns({"text": F.col("n.text"), "kind": F.col("n.kind")}).drop("n").join(table, ["text", "kind"], "left")
        return found.withColumn("__x", F.when(F.col("text").isNotNull(), F.struct("at", *table.columns))).drop("at", *table.columns)

    first = told(df.withColumns({"at": F.lit(0), "n": F.get("names", F.lit(0))}))
    rest = told(df.filter(n > 1).select(id_, F.posexplode("names").alias("at", "n")).filter("at > 0 AND n.text IS NOT NULL")).groupBy(id_).agg(F.sort_array(F.collect_list("__x")).alias("__rest"))
    alone = first.filter(n <= 1).withColumn("__names", F.array_compact(F.array("__x")))
    own = F.array_compact(F.array("__x"))
    several = first.filter(n > 1).join(rest, id_, "left").withColumn("__names", F.when(F.col("__rest").isNull(), own).otherwise(F.concat(own, "__rest"))).drop("__rest")
    return alone.unionByName(several).drop("__x", "names")


# A pair is taken where the first of its common keys lies, and keys order by their first sign.
def _name_key(text: Column, kind: Column) -> Column:
    return F.concat_ws(":", F.lit("1"), kind, text)


def _birth_key(dob: Column) -> Column:
    return F.concat(F.lit("2:"), dob.cast("string"))


def _id_key(namespace: Column, id_: Column) -> Column:
    return F.concat_ws(":", F.lit("3"), namespace, id_)


def _entity_key(id_: Column) -> Column:
    return F.concat(F.lit("4:"), id_)


COMPARED = "struct<level:string,suffix_conflict:boolean,suffix_missing:boolean,given_differs:boolean>"


def _keyed(df: DataFrame, keys: Column) -> DataFrame:
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def met_pairs(observations: DataFrame, entities: DataFrame, hot: int = HOT, counted: bool = True) -> DataFrame:
    """Observations (o_ columns) and entities (c_ columns) that share a key, each pair once, with what their best names say; an observation that meets nobody has a row without entity_id.

    Keys are known names that share a part with an observed one, date of birth, identities, and the scope, which is all there is beside these where there is one. Both sides are shuffled by key, a key that more than `hot` of one side
    have to tiles of both. Pairs are made there and never shuffled; tasks are as many as the pairs need. Names are parsed and compared once for each different text.
    """
    col, none = F.col, F.array().cast("array<string>")
    live = F.filter("names", lambda n: ~n.state.eqNullSafe("rejected"))
    e = entities.withColumn("names", F.transform(live, lambda n: F.struct(n.text.alias("text"), n.kind.alias("kind"))))
    o = observations.withColumn("names", F.transform("names", lambda t: F.struct(t.alias("text"), F.lit("name").alias("kind"))))
    each_name = lambda df: df.select(F.explode("names").alias("n")).select("n.text", "n.kind")
    known, said = _texts(each_name(e)), _texts(each_name(o))
    alike = cut(alike_texts(said, known, hot, counted).select("said", _name_key(col("known"), col("kind")).alias("key"), "x"))
    # ids of a namespace that no entity has meet nobody; namespaces are few
    spaces = F.broadcast(e.select(F.explode("identities.namespace").alias("namespace")).distinct().withColumn("__listed", F.lit(True)))
    o = o.join(spaces, "namespace", "left")
    free, listed = col("scope").isNull(), col("__listed") & col("external_id").isNotNull()
    others = F.concat(
        F.when(free & col("dob").isNotNull(), F.array(_birth_key(col("dob")))).otherwise(none), F.when(listed, F.array(_id_key(col("namespace"), col("external_id")))).otherwise(none),
        F.when(~free, F.transform(F.array_distinct("scope"), _entity_key)).otherwise(none),
    )
    ids = F.coalesce(F.transform("identities", lambda i: _id_key(i.namespace, i.external_id)), none)
    held = lambda names: F.array_sort(F.array_distinct(F.array_compact(F.concat(names, F.array(_birth_key(col("dob")), _entity_key(col("entity_id"))), ids))))
    # how many ask for a key and have it
    asking = each_name(o.filter(free)).groupBy(col("text").alias("said")).agg(F.count("*").alias("n")).join(alike, "said").select("key", "n").unionByName(_keyed(o, others)).groupBy("key").agg(F.sum("n").alias("n_o"))
    having = _keyed(e, held(F.coalesce(F.transform("names", lambda n: F.when(n.text.isNotNull(), _name_key(n.text, n.kind))), none))).withColumnRenamed("n", "n_e")
    sizes = cut(asking.join(having, "key"))
    pairs, = sizes.agg(F.sum(col("n_o") * col("n_e"))).first()
    n = max(int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // PAIRS_A_TASK))
    parts = lambda c: F.ceil(col(c) / hot).cast("int")
    # at most one key for each `hot` rows
    tiles = F.broadcast(sizes.filter((col("n_o") > hot) | (col("n_e") > hot)).select("key", parts("n_o").alias("__is"), parts("n_e").alias("__js")))
    dealt = lambda df: df.join(tiles, "key", "left").withColumns({"__is": F.coalesce("__is", F.lit(1)), "__js": F.coalesce("__js", F.lit(1))})
    part = lambda id_, of: F.pmod(F.xxhash64(id_), col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), col(of) - 1))
    upper = lambda x: F.transform(x, lambda v: F.upper(v))
    digits = F.date_format("dob", "yyyyMMdd")

    met_texts = said.select("text", "kind", "p").join(alike.groupBy(col("said").alias("text")).agg(F.collect_list(F.struct("key", "x")).alias("alike")), "text", "left")
    o = _with_names(o.withColumns({"__others": others, "nationalities": upper("nationalities"), "digits": digits}).drop("__listed"), "obs_id", met_texts)
    no_x = F.lit(None).cast(COMPARED)
    plain_ask = lambda k: F.struct(k.alias("key"), no_x.alias("x"))
    no_asks = F.array().cast(f"array<struct<key:string,x:{COMPARED}>>")
    # of several names, which is the best is told by the pair
    by_name = F.when(F.size("__names") == 1, F.coalesce(F.get("__names", F.lit(0))["alike"], no_asks)).otherwise(F.array_distinct(F.transform(F.flatten(F.transform("__names", lambda x: F.coalesce(x.alike, no_asks))), lambda a: plain_ask(a.key))))
    o = o.withColumn("__asks", F.concat(F.when(free, by_name).otherwise(no_asks), F.transform("__others", plain_ask))).withColumn("__names", F.transform("__names", lambda x: F.struct(x.at.alias("at"), x.p.alias("p"))))
    o = o.withColumn("__keys", F.transform("__asks", lambda a: a.key)).select("*", F.explode_outer("__asks").alias("__a")).drop("__asks", "__others").select("*", "__a.key", "__a.x").drop("__a")
    o = dealt(o).withColumn("__i", F.when(col("key").isNull(), F.pmod(F.xxhash64("obs_id"), F.lit(n)).cast("int")).otherwise(part("obs_id", "__is"))).withColumn("__j", all_of("__js")).drop("__is", "__js").repartition(n, "key", "__i", "__j")
    e = _with_names(e.withColumns({"nationalities": upper("nationalities"), "digits": digits, "namespaces": F.col("identities.namespace")}), "entity_id", known.select("text", "kind", "p"))
    e = e.withColumn("__held", held(F.transform("__names", lambda x: _name_key(x.text, x.kind)))).withColumn("__names", F.transform("__names", lambda x: F.struct(x.at.alias("at"), x.kind.alias("kind"), x.p.alias("p"))))
    e = e.select("*", F.posexplode("__held").alias("__at", "key")).withColumn("__before", F.slice("__held", F.lit(1), col("__at"))).drop("__held", "__at")
    e = dealt(e).withColumn("__j", part("entity_id", "__js")).withColumn("__i", all_of("__is")).drop("__is", "__js").repartition(n, "key", "__i", "__j")
    lies = ["key", "__i", "__j"]
    o = o.select("obs_id", "x", *[col(k).alias(f"o_{k}") for k in o.columns if k not in ("obs_id", "x")])
    c = e.select("entity_id", *[col(k).alias(f"c_{k}") for k in e.columns if k != "entity_id"])
    same = [col(f"o_{k}") == col(f"c_{k}") for k in lies]
    met = o.join(c, same[0] & same[1] & same[2] & ~F.arrays_overlap("c___before", "o___keys"), "left")

    # those who share no key of their names are seldom alike: one name each of several words, neither within the other, whose letters differ too much, needs no further look
    a, b = F.get("o___names", F.lit(0)), F.get("c___names", F.lit(0))
    single = (F.size("o___names") == 1) & (F.size("c___names") == 1)
    longest = F.greatest(F.length(a["p"]["sorted"]), F.length(b["p"]["sorted"]))
    edits = F.ceil(longest * (1 - nm.NEAR)).cast("int")
    far = (F.abs(F.length(a["p"]["sorted"]) - F.length(b["p"]["sorted"])) > edits) | (F.call_function("levenshtein", a["p"]["sorted"], b["p"]["sorted"], edits) < 0)
    words = F.size(a["p"]["core"])
    begun = lambda k: F.get(a["p"][k], F.lit(0)) == F.get(b["p"][k], F.lit(0))
    within = (words != F.size(b["p"]["core"])) & (begun("core") | begun("skeletons"))
    unlike = col("o_scope").isNull() & (b["kind"] != "nickname") & (words >= 2) & (F.size(b["p"]["core"]) >= 2) & ~within & F.coalesce(a["p"]["suffix"] == b["p"]["suffix"], F.lit(True)) & far
    nothing = F.struct(F.lit("none").alias("level"), F.lit(False).alias("suffix_conflict"), F.lit(False).alias("suffix_missing"), F.lit(False).alias("given_differs"))

    def compared_all() -> Column:
        tried = F.flatten(F.transform("o___names", lambda s: F.transform("c___names", lambda k: F.struct(s.at.alias("o"), k.at.alias("c"), nm.compared(s.p, k.p, k.kind == "nickname", counted).alias("x")))))
        ranked = lambda r: F.struct(place_in(nm.LEVELS, r.x.level).alias("place"), r.o.alias("o"), r.c.alias("c"), r.x.alias("x"))

        def best(r: Column) -> Column:
            fit = F.array_min(F.transform(F.filter(r, lambda v: ~v.x.suffix_conflict & (v.x.level != "none")), ranked))["x"]
            return F.struct(
                F.coalesce(fit["level"], F.lit("none")).alias("level"), F.exists(r, lambda v: v.x.suffix_conflict).alias("suffix_conflict"), F.coalesce(fit["suffix_missing"], F.lit(False)).alias("suffix_missing"),
                F.coalesce(fit["given_differs"], F.lit(False)).alias("given_differs"),
            )

        return F.get(F.transform(F.array(tried), best), F.lit(0))

    # a name that is none tells nothing but a conflict of suffixes
    told = F.when(col("x.suffix_conflict") | (col("x.level") == "none"), F.struct(F.lit("none").alias("level"), col("x.suffix_conflict").alias("suffix_conflict"), F.lit(False).alias("suffix_missing"), F.lit(False).alias("given_differs"))).otherwise(col("x"))
    x = F.when(col("entity_id").isNull() | (F.size("o___names") == 0) | (F.size("c___names") == 0), nothing).when(single & col("x").isNotNull(), told).when(single & unlike, nothing).otherwise(compared_all())
    return met.withColumn("x", x).withColumn("o_valid", F.coalesce((a["at"] == 0) & (F.size(a["p"]["core"]) > 0), F.lit(False))).select("*", "x.*").drop("x", "o___names", "c___names", "o___keys", "c___before", "o_key", "c_key")


def scored(met: DataFrame) -> DataFrame:
    """met_pairs with mapped, a boolean column for each sign, the numbers of `hard`, `soft`, `strong` and `medium` ones, confidence (0 to 99), and `there`: false where there is no entity, or none of the scope."""
    col, no = F.col, F.lit(False)
    holds = lambda c: F.coalesce(c, no)
    year = col("o_dob_precision").eqNullSafe("year")
    likeness = date_likeness(col("o_dob"), col("c_dob"), col("o_digits"), col("c_digits"))
    dob = F.when(year, F.when(col("o_dob").isNull() | col("c_dob").isNull(), "unknown").when(F.year("o_dob") == F.year("c_dob"), "year_match").otherwise("conflict")).otherwise(likeness)
    known_ = lambda x: col(x).isNotNull() & (col(x) != "unknown")
    same_id = lambda i: (i.namespace == col("o_namespace")) & (i.external_id == col("o_external_id"))
    # lists are gone through only where there is something to find
    ours = holds(F.array_contains("c_namespaces", col("o_namespace")))
    where = lambda c, x: F.when(c, x).otherwise(no)
    mapped = where(ours, F.exists("c_identities", lambda i: same_id(i) & ~i.state.eqNullSafe("rejected")))
    rejected = where(ours, F.exists("c_identities", lambda i: same_id(i) & i.state.eqNullSafe("rejected")))
    other = where(ours, F.exists("c_identities", lambda i: (i.namespace == col("o_namespace")) & (i.external_id != col("o_external_id")) & ~i.state.eqNullSafe("rejected")))
    both = holds((F.size("o_nationalities") > 0) & (F.size("c_nationalities") > 0))
    apart = lambda a: F.abs(col(f"o_{a}") - col(f"c_{a}"))
    gap = F.when(col("o_divisions").isNotNull() & col("c_divisions").isNotNull(), F.array_min(F.flatten(F.transform("o_divisions", lambda a: F.transform("c_divisions", lambda b: F.abs(a - b))))))
    overlap = F.when(holds(F.size("o_opponents") > 0), F.size(F.array_intersect("o_opponents", F.transform("c_bouts", lambda b: b.opponent))))
    context = F.when(col("o_bout_opponent").isNotNull(), F.exists("c_bouts", lambda b: (b.opponent == col("o_bout_opponent")) & (F.abs(F.date_diff(b.date, col("o_bout_date"))) <= SAME_CONTEST_DAYS)))
    free = ~col("mapped")  # a mapped identity's other ids say nothing against it
    met = met.withColumns({"dob": F.coalesce(dob, F.lit("unknown")), "mapped": holds(mapped), "overlap": F.coalesce(overlap, F.lit(0)), "gap": gap, "shared": where(both, F.arrays_overlap("o_nationalities", "c_nationalities")), "rejected": holds(rejected), "other": holds(other)})
    signs = {
        "suffix_conflict": col("suffix_conflict"), "dob_conflict": col("dob") == "conflict", "sex_conflict": known_("o_sex") & known_("c_sex") & (col("o_sex") != col("c_sex")), "previously_rejected": free & col("rejected"),
        "suffix_missing": col("suffix_missing"), "dob_typo_like": col("dob") == "typo_like", "namespace_id_conflict": free & col("other"), "nationality_conflict": both & ~col("shared"),
        "stance_conflict": known_("o_stance") & known_("c_stance") & (col("o_stance") != col("c_stance")) & (col("o_stance") != "switch") & (col("c_stance") != "switch"),
        "physical_conflict": holds(apart("height") > 8) | holds(apart("reach") > 10), "division_conflict": col("gap") >= 5,
        "dob_exact": col("dob") == "exact", "opponents_overlap_2plus": col("overlap") >= 2, "bout_context": context,
        "dob_year_match": col("dob") == "year_match", "nationality_match": both & col("shared"), "stance_match": known_("o_stance") & (col("o_stance") == col("c_stance")), "physical_match": (apart("height") <= 3) & (apart("reach") <= 4),
        "division_match": col("gap") <= 2, "hometown_match": F.lower("o_hometown") == F.lower("c_hometown"), "promoter_match": F.lower("o_promoter") == F.lower("c_promoter"), "opponents_overlap": col("overlap") >= 1,
    }
    met = met.withColumns({k: holds(v) for k, v in signs.items()})
    n = lambda names: sum((col(k).cast("int") for k in names[1:]), col(names[0]).cast("int"))
    met = met.withColumns({"hard": n(HARD), "soft": n(SOFT), "strong": n(STRONG), "medium": n(MEDIUM)})
    base = F.lit(0)
    for level, points in nm.SCORES.items():
        base = F.when(col("level") == level, points).otherwise(base)
    score = base + col("strong") * STRONG_SCORE + col("medium") * MEDIUM_SCORE - col("soft") * SOFT_SCORE
    confidence = F.when(col("hard") > 0, 0).otherwise(F.least(F.greatest(score, F.lit(0)), F.lit(MOST)))
    inside = col("o_scope").isNull() | col("mapped") | F.array_contains("o_scope", col("entity_id"))
    own = ["obs_id", "entity_id", "level", "given_differs", "mapped", "hard", "soft", "strong", "medium", "dob_exact", "previously_rejected", *SOFT]
    told = {"confidence": confidence, "scoped": col("o_scope").isNotNull(), "may_create": holds(col("o_may_create")), "valid": col("o_valid") & holds(col("o_sex").isin(SEXES) | col("o_sex").isNull()), "there": col("entity_id").isNotNull() & holds(inside)}
    return met.select(*own, *[v.alias(k) for k, v in told.items()])


def decided(pairs: DataFrame) -> DataFrame:
    """(obs_id, outcome, reason, entity_id, verification, confidence, candidates): matched, created, review, unresolved or rejected; one combined aggregation over the scored pairs.

    A live mapping decides, unless it contradicts. Else one candidate must stand out: a strong name and a strong sign, or a weak name, a strong and two medium signs, with nothing against it. What is
    only similar goes to review; a new one is made only where every candidate is ruled out. `candidates` counts those a review would see.
    """
    col, no = F.col, F.lit(False)
    hard, strong_name, weak_name, there = col("hard") > 0, col("level").isin(nm.STRONG), col("level").isin(nm.WEAK), col("there")
    strong, medium = col("strong"), col("medium")
    in_scope = (col("level") != "none") & (col("soft") == col("suffix_missing").cast("int"))
    beyond_birth = strong > col("dob_exact").cast("int")
    at_large = (col("soft") == 0) & (~col("given_differs") | beyond_birth) & ((strong_name & (strong >= 1)) | (weak_name & (strong >= 1) & (medium >= 2)))
    rows = pairs.withColumns({"mapped": there & col("mapped"), "eligible": there & ~hard & F.when(col("scoped"), in_scope).otherwise(at_large) & ~col("mapped")})
    contrary = hard & ~col("previously_rejected") & strong_name & (strong > 0)
    renamed = col("dob_exact") & (col("soft") == 0) & (medium >= 1)
    rows = rows.withColumn("nominated", there & ~col("mapped") & (contrary | (~hard & ((col("level") != "none") | renamed))))
    # ids are strings; the smaller id comes first among equals
    order = lambda where: F.when(where, F.struct(-col("confidence"), col("entity_id")))
    any_ = lambda c: F.coalesce(F.bool_or(col("nominated") & c), no)
    best = F.struct("entity_id", "level", "dob_exact", "confidence")
    found = rows.groupBy("obs_id").agg(
        F.min_by(F.struct("entity_id", "hard"), F.when(col("mapped"), col("entity_id"))).alias("mapped"), F.count_if("eligible").alias("eligible"), F.min_by(best, order(col("eligible"))).alias("best"), F.count_if("nominated").alias("nominated"),
        F.min_by("confidence", order(col("nominated"))).alias("nominee"), F.count_if(col("nominated") & strong_name).alias("strong_names"), F.count_if(there & hard & (col("level") != "none") & ~col("mapped")).alias("ruled_out"),
        F.count_if(there & ~col("mapped") & ((col("level") != "none") | (strong > 0))).alias("others"), any_(hard).alias("hard"), any_(col("given_differs")).alias("given"), any_(col("level") != "none").alias("named"),
        *[any_(col(s)).alias(s) for s in SOFT], *[F.bool_or(c).alias(c) for c in ("scoped", "may_create", "valid")],
    )
    met, invalid = found, ~col("valid")
    n = lambda c: F.coalesce(c, F.lit(0))
    is_mapped, one, several, some = col("mapped").isNotNull(), n("eligible") == 1, n("eligible") > 1, n("nominated") > 0
    why = (
        F.when(col("hard"), "contradictory_evidence").when((col("nominated") > 1) & (col("strong_names") > 1), "ambiguous").when(col("given"), "given_name_variant").when(col("dob_typo_like"), "dob_mismatch")
        .when(col("nationality_conflict"), "nationality_conflict").when(col("suffix_missing"), "suffix_missing").when(~col("named"), "possible_name_change").when(col("strong_names") == 0, "weak_name_only")
        .when(col("stance_conflict") | col("physical_conflict") | col("division_conflict"), "attribute_conflict").when(col("namespace_id_conflict"), "namespace_id_conflict").otherwise("insufficient_evidence")
    )
    contradicted = col("mapped.hard") > 0
    held = F.when(col("scoped"), "unresolved").otherwise("review")
    closed = col("scoped") | ~col("may_create")
    outcome = F.when(invalid, "rejected").when(is_mapped, F.when(contradicted, "review").otherwise("matched")).when(one, "matched").when(several | some, held).when(closed, "unresolved").otherwise("created")
    ruled = n("ruled_out") > 0
    reason = (
        F.when(invalid, "invalid_observation").when(is_mapped, F.when(contradicted, "mapped_identity_conflict").otherwise("external_id")).when(one, F.when(col("scoped"), "bout_scope").otherwise(F.concat(F.lit("name_"), "best.level")))
        .when(several, "ambiguous").when(some, why).when(closed, F.when(ruled, "all_candidates_conflict").otherwise("no_candidates")).otherwise(F.when(ruled, "distinct_from_candidates").otherwise("no_candidates"))
    )
    sure = ~col("scoped") & col("best.level").isin("exact", "reordered", "joined") & col("best.dob_exact")
    matched = outcome == "matched"
    verification = F.when(matched & is_mapped, "verified").when(matched, F.when(sure, "verified").otherwise("probable")).when(outcome == "created", "verified")
    confidence = F.when(invalid, None).when(is_mapped, F.when(contradicted, 0).otherwise(100)).when(one, F.when(col("scoped"), F.greatest("best.confidence", F.lit(70))).otherwise(col("best.confidence"))).when(several, 0).when(some, col("nominee")).when(closed, 0).otherwise(100)
    shown = F.when(invalid, 0).when(is_mapped, F.when(contradicted, n("others") + 1).otherwise(0)).when(one, n("others") - 1).when(several, col("eligible")).when(some, col("nominated")).otherwise(n("ruled_out"))
    return met.select(
        "obs_id", outcome.alias("outcome"), reason.alias("reason"), F.when(matched, F.when(is_mapped, col("mapped.entity_id")).otherwise(col("best.entity_id"))).alias("entity_id"),
        verification.alias("verification"), confidence.cast("int").alias("confidence"), shown.cast("long").alias("candidates"),
    )


def resolve(observations: DataFrame, entities: DataFrame, hot: int = HOT, counted: bool = True) -> DataFrame:
    """A decision for each observation; see `decided`, and `counted` in names.compared. obs_id and entity_id are unique strings; repeated observations are decided alike."""
    return decided(scored(met_pairs(observations, entities, hot, counted)))
