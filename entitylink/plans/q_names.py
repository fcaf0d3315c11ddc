"""Queries on the match stages and harmonisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.operators import names as N
from entitylink.operators.row_ids import row_ids
from entitylink.plans.recipes import Recipe, harmonize_part
from entitylink.plans.views import INDEX, NAMES, NORM, RAW, WORD_INDEX, Tables, query

#: Queries of every kind of match for the three-source dictionary.
ASKED = "asked AS (SELECT DISTINCT said AS query FROM raw UNION SELECT 'SUPP:' || s_suppkey FROM supplier UNION SELECT 'cust-' || c_custkey FROM customer UNION SELECT 'unknown ' || n_name FROM nation UNION SELECT '--')"


def _asked(t):
    one = lambda df, *c: df.select(F.concat(*c).alias("query"))
    out = t.raw().select(F.col("said").alias("query")).union(one(t.supplier, F.lit("SUPP:"), F.col("s_suppkey").cast("string")))
    out = out.union(one(t.customer, F.lit("cust-"), F.col("c_custkey").cast("string"))).union(one(t.nation, F.lit("unknown "), F.col("n_name")))
    return out.union(t.region.select(F.lit("--").alias("query"))).distinct()


def _index(t):
    return N.fit_names(t.names(), source_col="source")


@query("normalize_name", f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", N.normalize_name(F.col("text")).alias("norm"))


@query("fit_names", f"WITH {NAMES} SELECT {NORM.format('t')} AS norm, id AS target, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT name AS t, id, source FROM names UNION ALL SELECT id, id, source FROM names) GROUP BY 1, 2")
def _(spark, d):
    return _index(Tables(spark, d))[0].select("norm", "target", F.array_join("sources", ",").alias("sources"))


@query("match_direct", f"WITH {RAW}, {NAMES}, {ASKED} SELECT query, id AS target FROM asked JOIN (SELECT DISTINCT id FROM names) ON query = id")
def _(spark, d):
    t = Tables(spark, d)
    return N.match_direct(_asked(t), _index(t)[1]).select("query", "target")


@query("match_exact", f"WITH {RAW}, {INDEX}, {ASKED} SELECT query, norm AS matched_name, id AS target FROM asked JOIN idx ON {NORM.format('query')} = norm")
def _(spark, d):
    t = Tables(spark, d)
    return N.match_exact(_asked(t), _index(t)[0]).select("query", "matched_name", "target")


SUBSTRING = f"(SELECT DISTINCT query, norm AS matched_name, id AS target FROM (SELECT query, {NORM.format('w')} AS w FROM (SELECT query, unnest(string_split(query, ' ')) AS w FROM {{}})) JOIN idx ON w = norm AND w <> '')"


@query("match_substring", f"WITH {WORD_INDEX} SELECT * FROM {SUBSTRING.format('(SELECT DISTINCT text AS query FROM documents UNION SELECT p_name FROM part)')}")
def _(spark, d):
    t = Tables(spark, d)
    asked = t.documents.select(F.col("text").alias("query")).union(t.part.select("p_name")).distinct()
    return N.match_substring(asked, N.fit_names(t.words())[0]).select("query", "matched_name", "target")


TYPOS = "asked AS (SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3) AS query FROM part UNION SELECT DISTINCT 'x1 ' || p_brand FROM part)"
PART_IDX = f"pn AS (SELECT DISTINCT p_name AS id, p_name AS name FROM part), idx AS (SELECT DISTINCT {NORM.format('name')} AS norm, id FROM pn)"
PARTIAL = f"""(SELECT query, norm AS matched_name, id AS target, dist::INT AS distance FROM (SELECT *, min(ratio) OVER (PARTITION BY query) AS best FROM
  (SELECT query, norm, id, levenshtein(q, norm) AS dist, levenshtein(q, norm) / greatest(length(q), length(norm)) AS ratio
   FROM (SELECT query, {NORM.format('query')} AS q FROM asked) JOIN idx ON q <> '') WHERE ratio <= 0.2) WHERE ratio = best)"""


def _typos(t):
    asked = t.part.select(F.concat(F.substring("p_name", 1, 1), F.expr("substr(p_name, 3)")).alias("query")).union(t.part.select(F.concat(F.lit("x1 "), "p_brand")))
    return asked.distinct(), N.fit_names(t.part.select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct())


@query("match_partial", f"WITH {PART_IDX}, {TYPOS} SELECT * FROM {PARTIAL}")
def _(spark, d):
    asked, (names, _) = _typos(Tables(spark, d))
    return N.match_partial(asked, names).select("query", "matched_name", "target", "distance")


@query("match_filtered_partial", f"WITH {PART_IDX}, {TYPOS} SELECT * FROM {PARTIAL} WHERE NOT regexp_matches(query, '^[a-zA-Z]*[0-9]+')")
def _(spark, d):
    asked, (names, _) = _typos(Tables(spark, d))
    return N.match_filtered_partial(asked, names).select("query", "matched_name", "target", "distance")


@query("best_name_ties", f"WITH {PART_IDX}, {TYPOS}, c AS (SELECT query, norm AS name, levenshtein({NORM.format('query')}, norm)::INT AS dist FROM asked JOIN idx ON true) SELECT query, name, dist FROM c QUALIFY dist = min(dist) OVER (PARTITION BY query)")
def _(spark, d):
    t = Tables(spark, d)
    asked, (names, _) = _typos(t)
    return N.nearest_names(asked, names)


CASCADE = f"""di AS (SELECT query, 'direct' AS match_type, NULL AS matched_name, id AS target FROM asked JOIN (SELECT DISTINCT id FROM names) ON query = id WHERE {NORM.format('query')} <> ''),
ex AS (SELECT query, 'exact' AS match_type, norm AS matched_name, id AS target FROM asked JOIN idx ON {NORM.format('query')} = norm WHERE query NOT IN (SELECT query FROM di)),
su AS (SELECT query, 'substring' AS match_type, matched_name, target FROM {SUBSTRING.format("(SELECT query FROM asked WHERE query NOT IN (SELECT query FROM di) AND query NOT IN (SELECT query FROM ex))")}),
found AS (SELECT * FROM di UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM su)"""


def _cascade(t, **options):
    names, ids = _index(t)
    return N.match_cascade(_asked(t), names, ids, ("direct", "exact", "substring"), **options)


@query("match_cascade", f"WITH {RAW}, {INDEX}, {ASKED}, {CASCADE} SELECT * FROM found")
def _(spark, d):
    return _cascade(Tables(spark, d)).drop("distance")


@query("match_extended_meta", f"WITH {RAW}, {INDEX}, {ASKED}, {CASCADE} SELECT query, match_type, target, lower(CASE split_part(target, ':', 1) WHEN 'SUPP' THEN 'supplier' WHEN 'NAT' THEN 'nation' ELSE 'customer' END) AS sources FROM found")
def _(spark, d):
    return _cascade(Tables(spark, d), extended=True).select("query", "match_type", "target", F.array_join("sources", ",").alias("sources"))


@query("harmonize_column", f"WITH {RAW}, {INDEX} SELECT raw_id, 'said' AS \"column\", said AS query, CASE WHEN id IS NULL THEN NULL ELSE 'exact' END AS match_type, id AS target, id IS NOT NULL AS harmonized FROM raw LEFT JOIN idx ON {NORM.format('said')} = norm")
def _(spark, d):
    t = Tables(spark, d)
    return N.harmonize(t.raw(), "raw_id", ["said"], *_index(t))


PAIR = "CASE WHEN l_returnflag = 'R' THEN said || ';missing' ELSE said END"


@query("harmonize_part", f"WITH {RAW}, {INDEX} SELECT DISTINCT raw_id, id AS target FROM raw JOIN idx ON {NORM.format('said')} = norm")
def _(spark, d):
    t = Tables(spark, d)
    raw = t.raw().withColumn("said", F.when(F.col("l_returnflag") == "R", F.concat("said", F.lit(";missing"))).otherwise(F.col("said")))
    return harmonize_part(raw, Recipe({"gene": ["said"]}, {"said": {"pat": ";"}}), "gene", t.names())[0]


@query("split_harmonized", f"WITH {RAW}, {WORD_INDEX} SELECT raw_id, id IS NOT NULL AS harmonized FROM raw LEFT JOIN idx ON {NORM.format('item')} = norm")
def _(spark, d):
    t = Tables(spark, d)
    yes, no = N.split_harmonized(N.harmonize(t.raw(), "raw_id", ["item"], *N.fit_names(t.words())))
    return yes.select("raw_id", "harmonized").union(no.select("raw_id", "harmonized"))


@query("sort_links", f"WITH {RAW} SELECT row_number() OVER (ORDER BY raw_id, l_suppkey::VARCHAR) AS nth, raw_id, 'SUPP:' || l_suppkey AS target FROM raw")
def _(spark, d):
    links = N.sort_links(Tables(spark, d).links()["supplier"], "raw_id", ["target"])
    return row_ids(links, "nth", ["raw_id", "target"])


@query("dedupe_links", "SELECT DISTINCT l_orderkey AS raw_id, 'SUPP:' || l_suppkey AS target FROM lineitem")
def _(spark, d):
    l = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("raw_id"), F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string")).alias("target"))
    return N.dedupe_links(l, "raw_id", ["target"])


@query("harmonizer_lookup", f"WITH {RAW}, {INDEX}, {ASKED}, {CASCADE}, e AS (SELECT DISTINCT id, CASE split_part(id, ':', 1) WHEN 'SUPP' THEN 1 WHEN 'NAT' THEN 2 ELSE 3 END AS entity_id FROM names) SELECT a.query, coalesce(match_type, 'none') AS match_type, matched_name, target, coalesce(entity_id, 0)::INT AS entity_id FROM asked a LEFT JOIN (SELECT * FROM found WHERE match_type <> 'substring') f USING (query) LEFT JOIN e ON e.id = target")
def _(spark, d):
    t = Tables(spark, d)
    names, ids = _index(t)
    kind = F.when(F.startswith("target", F.lit("SUPP")), 1).when(F.startswith("target", F.lit("NAT")), 2).otherwise(3)
    return N.lookup(_asked(t), names, ids, ids.select("target", kind.alias("id"))).withColumn("entity_id", F.coalesce("entity_id", F.lit(0)))


EXPECTED = "exp AS (SELECT said AS query, min('SUPP:' || l_suppkey) AS expected FROM raw GROUP BY said UNION ALL SELECT 'unknown ' || n_name, NULL FROM nation UNION ALL SELECT 'cust-' || c_custkey, 'CUST:' || (c_custkey + 1) FROM customer UNION ALL SELECT 'supp ' || s_suppkey || ' lost', 'SUPP:' || s_suppkey FROM supplier)"


def _found(t):
    exp = t.raw().groupBy(F.col("said").alias("query")).agg(F.min(F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string"))).alias("expected"))
    exp = exp.union(t.nation.select(F.concat(F.lit("unknown "), "n_name"), F.lit(None).cast("string")))
    exp = exp.union(t.customer.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")), F.concat(F.lit("CUST:"), (F.col("c_custkey") + 1).cast("string"))))
    exp = exp.union(t.supplier.select(F.concat(F.lit("supp "), F.col("s_suppkey").cast("string"), F.lit(" lost")), F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string"))))
    names, ids = _index(t)
    hits = N.match_cascade(exp.select("query"), names, ids).groupBy("query").agg(F.array_sort(F.collect_set("target")).alias("found"))
    return exp.join(hits, "query", "left")


GROUPED = f"f AS (SELECT query, list(DISTINCT id) AS found FROM (SELECT query, id FROM exp JOIN idx ON {NORM.format('query')} = norm) GROUP BY query), r AS (SELECT exp.query, expected, found FROM exp LEFT JOIN f USING (query))"


@query("match_assessment", f"WITH {RAW}, {INDEX}, {EXPECTED}, {GROUPED} SELECT CASE WHEN expected IS NULL THEN CASE WHEN found IS NULL THEN 'TN' ELSE 'FP' END WHEN list_contains(found, expected) THEN 'TP' WHEN found IS NULL THEN 'FN' ELSE 'FP' END AS label, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    return N.assess(_found(Tables(spark, d))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("match_evaluation", f"WITH {RAW}, {INDEX}, {EXPECTED}, {GROUPED} SELECT query, coalesce(list_contains(found, expected), false) AS correct FROM r")
def _(spark, d):
    df = _found(Tables(spark, d)).withColumn("expected", F.array("expected"))
    return N.evaluate(df).select("query", "correct")


@query("match_type_report", f"WITH {RAW}, {INDEX}, {ASKED}, {CASCADE} SELECT a.query, coalesce(any_value(match_type), 'none') AS match_type, coalesce(string_agg(DISTINCT matched_name, ';' ORDER BY matched_name), '') AS names, coalesce(string_agg(DISTINCT target, ';' ORDER BY target), '') AS targets FROM asked a LEFT JOIN found USING (query) GROUP BY a.query")
def _(spark, d):
    t = Tables(spark, d)
    return N.match_report(_cascade(t), _asked(t)).drop("distance")
