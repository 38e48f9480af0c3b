"""Texts, names and semi-structured columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import identity as idn
from tessera.sources.tables import load, parsed_json

from .catalog import named


@named("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures read from JSON by a declared schema; what does not conform is kept apart."""
    good, _ = parsed_json(load(spark, sf_dir, "events"), "props", "k BIGINT")
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("parsed.k").alias("k_sum"), F.max("parsed.k").alias("k_max"))


@named("""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token HAVING count(*) >= 50
""")
def explode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of the documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    once = d.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n >= 50")


@named("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)
SELECT DISTINCT p_partkey, unnest(['full:' || array_to_string(t, ' '), 'sorted:' || array_to_string(list_sort(t), ' '), 'ends:' || t[1] || ' ' || t[-1], 'initial:' || t[1][1] || ' ' || t[-1]]) AS key FROM w
""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking keys of the parts' names."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(idn.name_keys(idn.tokens(idn.folded(F.col("p_name"))))).alias("key"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).distinct()


@named("""
WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^ -~]', '?', 'g') AS t FROM pages)
SELECT a.t AS a, b.t AS b, levenshtein(a.t, b.t) AS distance FROM p a JOIN p b ON a.t < b.t AND levenshtein(a.t, b.t) <= 4
""")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different titles of pages at most four edits apart, what is not ASCII counted as one sign."""
    return idn.edit_pairs(_titles(spark, sf_dir).select(F.regexp_replace("title", "[^ -~]", "?").alias("title")), "title", 4)


TRIGRAMS = """
p AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), v AS (SELECT t, unnest(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM p),
g AS (SELECT DISTINCT t, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT t, w, unnest(range(1, CAST(length(w) + 2 AS BIGINT))) AS i FROM v WHERE w <> '')),
n AS (SELECT t, count(*) AS n FROM g GROUP BY t)
"""


@named(f"""
WITH {TRIGRAMS}, c AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.t < b.t GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE round(c / (x.n + y.n - c), 6) >= 0.6
""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different titles of pages whose trigrams are alike."""
    p = _titles(spark, sf_dir).select(F.col("title").alias("id"), F.col("title").alias("text"))
    return idn.similar_pairs(p, "id", "text", 0.6)


MAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"
SCRUB = f"regexp_replace(regexp_replace(regexp_replace(text, '{MAIL}', '[mail]', 'g'), '{IP}', '[ip]', 'g'), '[0-9]{{9,}}', '[number]', 'g')"


@named(f"SELECT doc_id, sha256({SCRUB}) AS scrubbed FROM documents WHERE {SCRUB} <> text")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that scrubbing changes, by the hash of what is left."""
    d = load(spark, sf_dir, "documents").withColumn("s", idn.scrubbed(F.col("text")))
    return d.filter(F.col("s") != F.col("text")).select("doc_id", F.sha2("s", 256).alias("scrubbed"))


@named(f"SELECT doc_id, regexp_matches(text, '{MAIL}') AS mail, regexp_matches(text, '{IP}') AS ip FROM documents WHERE regexp_matches(text, '{MAIL}') OR regexp_matches(text, '{IP}')")
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold mail or network addresses."""
    return load(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(MAIL).alias("mail"), F.col("text").rlike(IP).alias("ip")).filter("mail OR ip")


@named(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(^|\n)[^|\n]+ \| [^|\n]+ \| ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shouted'
  WHEN regexp_matches(text, '(?i)\blicensed under\b') THEN 'licensed' ELSE 'plain' END AS family FROM documents
""")
def title_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an ordered list of patterns that a document matches."""
    t = F.col("text")
    family = (
        F.when(t.rlike(r"(^|\n)[^|\n]+ \| [^|\n]+ \| "), "table").when(t.rlike(r"[#$%&*]{3}"), "symbols").when(t.rlike("[A-Z]{4,}!!"), "shouted")
        .when(t.rlike(r"(?i)\blicensed under\b"), "licensed").otherwise("plain")
    )
    return load(spark, sf_dir, "documents").select("doc_id", family.alias("family"))


@named("""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_chars, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages
""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that patterns read from pages."""
    p, get = load(spark, sf_dir, "pages"), lambda c, r: F.regexp_extract(c, r, 1)
    return p.select(
        "page_id", get("html", '<html lang="([a-z]+)"').alias("lang"), F.length(get("html", "<title>([^<]*)</title>")).cast("long").alias("title_chars"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), get("url", "^https?://([^/:]+)").alias("host"),
    )


@named("""
SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn = 1
""")
def appearance_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest turn of each conversation."""
    from tessera.operators.temporal import latest_per_key

    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return latest_per_key(c, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@named("""
WITH k AS (SELECT p_partkey, p_name, p_brand FROM part), c AS (SELECT a.p_partkey, b.p_partkey AS other FROM k a LEFT JOIN k b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
SELECT p_partkey, CASE WHEN count(DISTINCT other) = 1 THEN 'matched' WHEN count(DISTINCT other) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, CASE WHEN count(DISTINCT other) = 1 THEN min(other) END AS other, count(DISTINCT other) AS candidates FROM c GROUP BY p_partkey
""")
def entity_match_one_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches only where exactly one other part has the same name and brand."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    groups = p.groupBy("p_name", "p_brand").agg(F.count_distinct("p_partkey").alias("n"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    met = p.join(groups, ["p_name", "p_brand"])
    outcome = F.when(F.col("n") == 2, "matched").when(F.col("n") > 2, "ambiguous").otherwise("unmatched")
    other = F.when(F.col("n") == 2, F.when(F.col("low") == F.col("p_partkey"), F.col("high")).otherwise(F.col("low")))
    return met.select("p_partkey", outcome.alias("outcome"), other.alias("other"), (F.col("n") - 1).alias("candidates"))


@named("""
SELECT lang, count(*) AS docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, round(CAST(count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS DOUBLE) / count(*), 6) AS share FROM documents GROUP BY lang
""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language have a label."""
    d, l = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    met = d.join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count("has").alias("labelled"))
    return met.withColumn("share", F.round(F.col("labelled") / F.col("docs"), 6))


@named("""
WITH m AS (SELECT c_custkey AS merged_id, c_custkey - 1 AS into_id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey > 0)
SELECT coalesce(into_id, o_custkey) AS o_custkey, count(*) AS n FROM orders LEFT JOIN m ON o_custkey = merged_id GROUP BY 1
""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted by customer after one hop of merges."""
    m = load(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY' AND c_custkey > 0").select(F.col("c_custkey").alias("merged_id"), (F.col("c_custkey") - 1).alias("into_id"))
    return idn.canonical(load(spark, sf_dir, "orders").select("o_custkey"), m, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@named("""
WITH s AS (SELECT CASE p_partkey % 14 WHEN 0 THEN 'TBD' WHEN 1 THEN 'T.B.C.' WHEN 2 THEN 'Opponent TBA' WHEN 3 THEN 'To be announced' WHEN 4 THEN 'Li' WHEN 5 THEN repeat('ab', 61) WHEN 6 THEN '--' WHEN 7 THEN 'Zhilei' WHEN 8 THEN 'Tba Tbd Opponent' WHEN 9 THEN NULL WHEN 10 THEN 'TBATBD' WHEN 11 THEN 'Opponent to be determined tbc' ELSE p_name END AS name FROM part),
w AS (SELECT name, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM s),
x AS (SELECT w, CASE WHEN len(w) > 0 AND len(list_filter(w, lambda t: length(t) > 1 OR t >= '0' AND t <= '9')) = 0 THEN [array_to_string(w, '')] ELSE w END AS x FROM w),
y AS (SELECT w, x, CASE WHEN len(x) > 1 AND x[1] = 'opponent' THEN x[2:] ELSE x END AS y FROM x),
z AS (SELECT *, array_to_string(y[1:3], ' ') IN ('to be announced', 'to be confirmed', 'to be determined') AS phrase, length(array_to_string(w, '')) AS letters FROM y),
q AS (SELECT *, len(w) = 0 OR x = ['opponent'] OR (len(x) = 1 AND length(x[1]) % 3 = 0 AND len(list_filter(range(0, length(x[1]) // 3), lambda i: substr(x[1], CAST(3 * i + 1 AS INTEGER), 3) NOT IN ('tbd', 'tba', 'tbc'))) = 0)
  OR ((phrase OR y[1] IN ('tbd', 'tba', 'tbc')) AND len(list_filter(CASE WHEN phrase THEN y[4:] ELSE y[2:] END, lambda t: t NOT IN ('tbd', 'tba', 'tbc', 'opponent'))) = 0) AS unnamed FROM z)
SELECT quality, count(*) AS n FROM (SELECT CASE WHEN unnamed THEN 'placeholder' WHEN letters < 4 THEN 'short' WHEN letters + len(w) - 1 > 120 THEN 'long' ELSE 'ok' END AS quality FROM q) GROUP BY quality
""")
def name_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names are fit to be matched; most stand in for what is printed where no name is known."""
    printed = {0: "TBD", 1: "T.B.C.", 2: "Opponent TBA", 3: "To be announced", 4: "Li", 5: "ab" * 61, 6: "--", 7: "Zhilei", 8: "Tba Tbd Opponent", 9: None, 10: "TBATBD", 11: "Opponent to be determined tbc"}
    kind, name = F.col("p_partkey") % 14, F.col("p_name")
    for k, v in printed.items():
        name = F.when(kind == k, F.lit(v)).otherwise(name)
    return load(spark, sf_dir, "part").groupBy(idn.name_quality(name).alias("quality")).agg(F.count("*").alias("n"))
