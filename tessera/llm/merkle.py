"""Document fingerprints: Merkle trees over the pieces, paragraphs and sections of a text.

Paragraphs stand between line ends and are cut into pieces of at most eight words that end with a sentence, so that pieces fall into step again behind an edit. A piece's node is the SHA-256
of its text, a paragraph's that of its pieces' nodes. Sections are runs of paragraphs that end where a paragraph's node begins with a zero digit, sixteen on average and WIDEST at most, sections of sections are made alike, up to
one root: what stands where decides where a section ends, not a count, so an edit changes the nodes above it and leaves the others as they are, whatever the layout. Nothing of the text is lost in the
cuts, so equal roots mean equal texts as far as SHA-256 does. Likeness is the share of common leaves, and an edit is found by going down below nodes that differ. Native functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Up to seven words that don't end a sentence, then a word of any kind; with the spaces behind them.
PIECE = r"(?!\z)(?:[^ ]*+(?<![.!?]) ){0,7}+[^ ]*+ ?"
#: Levels of sections below the root, the most children of one, and runs of nodes as they are joined: up to one that begins with a zero, or WIDEST others.
LEVELS, WIDEST = 4, 64
GROUP = rf"(?:[1-9a-f][0-9a-f]{{63}}\.){{0,{WIDEST - 1}}}+0[0-9a-f]{{63}}\.|(?:[1-9a-f][0-9a-f]{{63}}\.){{1,{WIDEST}}}+"
#: Buckets are cut at quantiles of a sample of ids, as Spark's own range partitioning is; where the cuts lie changes no result.
BUCKETS_PER_PARTITION, SAMPLED_PER_BUCKET = 8, 20


def pieces_of(text: Column) -> Column:
    """The nodes of the pieces of each paragraph: array<array<string>>."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256)))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: F.concat(x.node, F.lit("."))), "")


def _grouped(level: Column) -> Column:
    """The nodes of the level above: runs of nodes up to one that begins with a zero digit, with the place of their first child and how many they have."""
    runs = F.transform(F.regexp_extract_all(_joined(level), F.lit(GROUP), F.lit(0)), lambda g: F.struct(F.sha2(g, 256).alias("node"), F.floor(F.length(g) / 65).cast("int").alias("n")))
    before = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda acc, x: acc + x.n)
    return F.transform(runs, lambda x, i: F.struct(x.node.alias("node"), before(i).alias("at"), x.n.alias("n")))


def tree(pieces: Column) -> Column:
    """All levels, paragraphs first, the root alone last: array<array<struct<node, at, n>>>; at and n tell a node's children in the level below (a paragraph's are its pieces)."""
    paragraphs = F.transform(pieces, lambda p: F.struct(F.sha2(F.array_join(p, "."), 256).alias("node"), F.lit(0).alias("at"), F.size(p).alias("n")))
    up = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(paragraphs), lambda levels, _: F.concat(levels, F.array(_grouped(F.element_at(levels, -1)))))
    whole = F.transform(F.array(up), lambda levels: F.concat(levels, F.array(F.array(F.struct(F.sha2(_joined(F.element_at(levels, -1)), 256).alias("node"), F.lit(0).alias("at"), F.size(F.element_at(levels, -1)).alias("n"))))))
    return whole[0]


def root(tree_: Column) -> Column:
    """The root's node, 64 hex digits."""
    return F.element_at(tree_, -1)[0]["node"]


def leaves(pieces: Column) -> Column:
    """Hashes of the different leaves."""
    return F.array_distinct(F.transform(F.flatten(pieces), lambda x: F.xxhash64(x)))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the common leaves of two trees; 1 for two without a leaf."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def descended(a: Column, b: Column) -> Column:
    """struct(gone, came, visited): the paragraph nodes that only a, and only b, has below nodes that differ, and how many nodes were looked at. Both trees are gone down from the root level by level, below differing nodes alone.

    A paragraph that moves stays where its old and its new section both differ, which is where it moved.
    """
    none = F.array().cast("array<struct<node:string,at:int,n:int>>")

    def below(open_: Column, level: Column) -> Column:
        return F.flatten(F.transform(open_, lambda g: F.slice(level, g["at"] + 1, g["n"])))

    def only(own: Column, other: Column) -> Column:
        odd = F.array_except(own["node"], other["node"])
        return F.when(F.size(odd) == F.size(own), own).otherwise(F.filter(own, lambda x: F.array_contains(odd, x.node)))

    def step(acc: Column, k: Column) -> Column:
        met = F.array(F.struct(below(acc["a"], F.element_at(a, k)).alias("a"), below(acc["b"], F.element_at(b, k)).alias("b")))
        return F.transform(met, lambda m: F.struct(only(m.a, m.b).alias("a"), only(m.b, m.a).alias("b"), (acc["visited"] + F.size(m.a) + F.size(m.b)).alias("visited")))[0]

    same = root(a) == root(b)
    start = F.struct(F.when(same, none).otherwise(F.element_at(a, -1)).alias("a"), F.when(same, none).otherwise(F.element_at(b, -1)).alias("b"), F.lit(2).alias("visited"))
    down = F.aggregate(F.sequence(F.lit(LEVELS + 1), F.lit(1), F.lit(-1)), start, step)
    told = F.transform(F.array(down), lambda d: F.struct(F.array_distinct(d.a["node"]).alias("gone"), F.array_distinct(d.b["node"]).alias("came"), d.visited.alias("visited")))
    return told[0]


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first paragraph (from 0) in which two trees differ, null if they are equal: on each level the first differing child of the node found on the one above."""

    def first(x: Column, y: Column) -> Column:
        """How many nodes two lists begin with alike."""
        at = F.array_position(F.zip_with(x["node"], y["node"], lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")

    def step(acc: Column, k: Column) -> Column:
        # acc is the place, the same in both trees, of the first differing node of the level above; -1 where one tree has no such node
        up_a, up_b = F.element_at(a, k + 1), F.element_at(b, k + 1)
        x, y = F.get(up_a, acc), F.get(up_b, acc)
        at = F.coalesce(x["at"], y["at"])
        children = lambda level, g: F.coalesce(F.slice(level, at + 1, g["n"]), F.array().cast("array<struct<node:string,at:int,n:int>>"))
        return at + first(children(F.element_at(a, k), x), children(F.element_at(b, k), y))

    return F.when(root(a) != root(b), F.aggregate(F.sequence(F.lit(LEVELS + 1), F.lit(1), F.lit(-1)), F.lit(0), step).cast("long"))


def fingerprinted(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """docs with {prefix}leaves, {prefix}tree and {prefix}fingerprint of a text."""
    rows = docs.withColumn(f"{prefix}pieces", pieces_of(text))
    rows = rows.withColumns({f"{prefix}leaves": leaves(F.col(f"{prefix}pieces")), f"{prefix}tree": tree(F.col(f"{prefix}pieces"))}).drop(f"{prefix}pieces")
    return rows.withColumn(f"{prefix}fingerprint", root(F.col(f"{prefix}tree")))


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many bounds are below the id, found in two steps of about a square root of them each."""
    step = max(1, isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda x: x < id_))
    part = F.least(below(lit([p[-1] for p in parts])), F.lit(len(parts) - 1))
    return part * step + below(F.element_at(F.array(*map(lit, parts)), part + 1))


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and next_text, that of the next row in descending doc_id; after the last comes the first.

    Rows with one doc_id stand by the text's hash. A null doc_id has no place in the order and next_text null.
    Texts move once: doc_ids are cut at about the quantiles, a bounded list, and the first row of each bucket is
    copied to the one above it, so that a window within buckets sees every successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(spark) * BUCKETS_PER_PARTITION
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL")
    share = min(1.0, n * SAMPLED_PER_BUCKET / max(1, ids.count()))
    bounds = (ids if share == 1.0 else ids.sample(share, 42)).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [0]
    spread = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(n))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), spread).otherwise(_bucket(F.col("doc_id"), sorted(set(bounds)))).cast("long"))
    heads = rows.filter("doc_id IS NOT NULL").groupBy("bucket").agg(F.max("doc_id").alias("head"))  # a row a bucket
    above = Window.orderBy("bucket")
    lowest = heads.agg(F.min("bucket").alias("lowest"))
    heads = heads.withColumn("to", F.lead("bucket").over(above)).crossJoin(F.broadcast(lowest)).select("head", F.coalesce("to", "lowest").alias("to"))
    guests = rows.join(F.broadcast(heads), rows.doc_id == heads["head"]).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    all_ = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).union(guests).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("h"))
    found = all_.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0")
    return found.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("next_text")).alias("next_text"))


def edit_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form (its second half replaced by the next document's beginning) and their likeness.

    Null texts count as empty. Where there is no next document (a null doc_id) the second half is cut off and near_next is 0. Repeated rows
    stay and an empty table gives an empty one. first_edited is the first paragraph that differs, n_removed and n_added count the different paragraphs that the edit took away and
    brought, n_visited the nodes looked at to find them. Other columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, text).withColumns({
        "n_chars": F.length("text").cast("long"),
        "edited": F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 2))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)),
    })
    rows = fingerprinted(rows, F.col("text"))
    rows = rows.withColumn("near_next", F.when(F.col("next_text").isNotNull(), likeness(F.col("leaves"), leaves(pieces_of(F.col("next_text"))))).otherwise(0.0)).drop("text", "next_text")
    rows = fingerprinted(rows, F.col("edited"), "edited_").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.withColumn("descent", descended(F.col("tree"), F.col("edited_tree")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), "near_next",
        first_difference(F.col("tree"), F.col("edited_tree")).alias("first_edited"),
        F.size("descent.gone").alias("n_removed"), F.size("descent.came").alias("n_added"), F.col("descent.visited").alias("n_visited"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
