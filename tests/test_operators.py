"""Worked examples of the operators' semantics."""

import random

import pytest
from pyspark.sql import functions as F

from entitylink.functions import columns as C
from entitylink.functions import variants as V
from entitylink.operators import dictionary as D
from entitylink.operators import graph as G
from entitylink.operators import names as N
from entitylink.operators import serve as S
from entitylink.operators.row_ids import row_ids
from entitylink.plans.recipes import Recipe, harmonize_part
from entitylink.sources import files, ontology, vcf


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "norm"), [("5-Fluoro uracil", "5fluorouracil"), ("a_b[c] D-1", "a_b[c]d1"), ("###", ""), (None, None)])
def test_normalize_name(spark, text, norm):
    assert one(spark, N.normalize_name, text) == norm


DICTIONARY = [("HGNC:1", "A1BG"), ("HGNC:1", "alpha-1-B"), ("HGNC:2", "A2M"), ("HGNC:2", "A1BG")]


@pytest.fixture(scope="module")
def index(spark):
    return N.fit_names(spark.createDataFrame(DICTIONARY, "id string, name string"))


@pytest.mark.parametrize(("query", "types", "want"), [
    ("HGNC:1", "direct,exact", [("direct", None, "HGNC:1")]),
    ("hgnc-1", "direct,exact", [("exact", "hgnc1", "HGNC:1")]),
    ("a1bg", "direct,exact", [("exact", "a1bg", "HGNC:1"), ("exact", "a1bg", "HGNC:2")]),
    ("A2M antibody", "direct,exact", []),
    ("A2M antibody", "direct,exact,substring", [("substring", "a2m", "HGNC:2")]),
    ("alpha-1-C", "direct,exact,substring,partial", [("partial", "alpha1b", "HGNC:1")]),
    ("A1BX", "direct,exact,partial", []),
    ("--", "direct,exact,substring,partial", []),
])
def test_cascade(spark, index, query, types, want):
    got = N.match_cascade(spark.createDataFrame([(query,)], "query string"), *index, types.split(","))
    assert rows(got.select("match_type", "matched_name", "target")) == sorted(want, key=repr)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_names(seed, letters, most, n):
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))) for _ in range(n)}


def edited(name, edits, rnd):
    for _ in range(edits):
        i = rnd.randrange(len(name) + 1)
        name = rnd.choice([name[:i] + rnd.choice("ab9") + name[i:], name[:i] + name[i + 1 :], name[:i] + rnd.choice("ab9") + name[i + 1 :]])
    return name


def norm_index(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "norm string, target string")


@pytest.mark.parametrize(("letters", "most", "threshold"), [("abc", 14, 0.2), ("ab", 30, 0.2), ("abcdefgh", 9, 0.4), ("ab", 5, 0.6)])
def test_partial_equals_all_pairs(spark, letters, most, threshold):
    rnd = random.Random(3)
    names = some_names(1, letters, most, 110)
    asked = some_names(2, letters, most, 60) | {edited(n, rnd.randint(0, 7), rnd) for n in sorted(names)[:60]} - {""}
    want = []
    for q in asked:
        near = [(distance(q, n) / max(len(q), len(n)), n) for n in names]
        best = min(near)[0]
        want += [(q, n) for r, n in near if r == best and r <= threshold]
    got = N.match_partial(spark.createDataFrame([(q,) for q in asked], "query string"), norm_index(spark, names), threshold)
    assert rows(got.select("query", "matched_name")) == sorted(want)


def test_nearest_names_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = some_names(5, "abcdef", 12, 150)
    asked = some_names(6, "abcdefxyz", 16, 50) | {edited(n, rnd.randint(0, 5), rnd) for n in sorted(names)[:50]} | {"z" * 40, "--"}
    want = []
    for q in asked:
        near = [(distance(q.replace("-", ""), n), n) for n in names]
        want += [(q, n, d) for d, n in near if d == min(near)[0]]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    assert rows(N.nearest_names(queries, norm_index(spark, names))) == sorted(want)
    assert rows(N.nearest_names(queries, norm_index(spark, names).limit(0))) == []


def test_common_prefix_is_no_hot_key(spark):
    """Names that begin alike meet by what tells them apart, and few pairs are measured."""
    rnd = random.Random(8)
    names = sorted({f"customer{rnd.randrange(10**8):08d}" for _ in range(3000)})
    known = norm_index(spark, names).select(F.col("norm").alias("name"))
    asked = spark.createDataFrame([(edited(n, 1, rnd),) for n in rnd.sample(names, 200)], "q string").distinct().withColumn("reach", F.lit(4))
    for bound, share in ((1, 0.01), (2, 0.02)):
        reach = lambda n: F.floor(n / 4).cast("int")
        keys = N.name_keys(*N.spelled_names(known, bound, reach), bound)
        assert keys.groupBy("gram", "at", "size").count().agg(F.max("count")).first()[0] <= share * len(names)
    assert N.near_pairs(asked, known, 1, reach).count() < 0.05 * 200 * len(names)


def test_keyed_stages_are_one_join(spark, index):
    asked = spark.createDataFrame([("HGNC:1",), ("a2m",), ("A2M antibody",)], "query string")
    known = [N.materialize(x, "known") for x in index]  # of a known size
    plan = N.match_cascade(asked, *known, ("direct", "exact", "substring"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    # a query whose raw text is an id and whose name is another's keeps the earlier type
    names = N.fit_names(spark.createDataFrame([("a1", "x"), ("b", "A-1")], "id string, name string"))
    got = N.match_cascade(spark.createDataFrame([("a1",), ("A1",), ("x y",)], "query string"), *names, ("direct", "exact", "substring"))
    assert rows(got.select("query", "match_type", "target")) == [("A1", "exact", "a1"), ("A1", "exact", "b"), ("a1", "direct", "a1"), ("x y", "substring", "a1")]


def test_harmonize_all_equals_one_by_one(spark):
    raw = spark.createDataFrame([(1, "KRAS", ["brca", None], "lung x"), (2, "kras", None, "none"), (3, None, ["D1"], "Lung")], "raw_id long, g string, d array<string>, c string")
    given = {k: N.fit_names(spark.createDataFrame(v, "id string, name string")) for k, v in {"gene": [("G1", "KRAS")], "drug": [("D1", "brca"), ("D2", "kras")], "cancer_type": [("C1", "lung")]}.items()}
    cols = {"gene": ["g"], "drug": ["d", "g"], "cancer_type": ["c"]}
    got = N.harmonize_all(raw, "raw_id", cols, given)
    for kind in cols:
        want = N.harmonize(raw, "raw_id", cols[kind], *given[kind], N.DEFAULT_TYPES[kind])
        assert rows(got.where(F.col("kind") == kind).drop("kind").select(want.columns)) == rows(want)


def test_harmonize_keeps_one_null_row(spark, index):
    raw = spark.createDataFrame([(7, ["A1BG", "zzz", None]), (8, None)], "raw_id long, genes array<string>")
    out = N.harmonize(raw, "raw_id", ["genes"], *index)
    assert rows(out.select("raw_id", "query", "target")) == sorted([(7, "A1BG", "HGNC:1"), (7, "A1BG", "HGNC:2"), (7, "zzz", None)], key=repr)
    links, rest, queries = harmonize_part(raw, Recipe({"gene": ["genes"]}), "gene", spark.createDataFrame(DICTIONARY, "id string, name string"))
    assert rows(links) == [(7, "HGNC:1"), (7, "HGNC:2")]
    assert rows(rest.select("query")) == [("zzz",)]
    assert rows(queries) == [(7, "A1BG;zzz"), (8, "")]


def test_build_dict(spark):
    given = [("CHEMBL10", "x", "s1"), ("CHEMBL9", "y", "s1"), ("CHEMBL9", "y", "s2"), ("CHEMBL8", "", "s1"), ("CHEMBL7", "CHEMBL7", "s1")]
    entities, names = D.build_dict([spark.createDataFrame(given, "target string, name string, data_sources string")], "target", "CHEMBL")
    assert rows(entities) == [(1, "CHEMBL8"), (2, "CHEMBL9"), (3, "CHEMBL10")]
    assert rows(names) == [(1, "CHEMBL10", "x", "s1"), (2, "CHEMBL9", "y", "s1,s2")]


HGVS = [
    ("KRAS:c.35G>T", ("KRAS", "", "c", "35G>T", 0, "")),
    ("NM_000410.3:c.989G>T", ("NM_000410", "3", "c", "989G>T", 0, "")),
    ("BRAF:p.V600E", ("BRAF", "", "p", "Val600Glu", 2, "")),
    ("PDGFRA:p.asp842val", ("PDGFRA", "", "p", "asp842val", 0, "")),
    ("BRAF:V600E", ("BRAF", "", "p", "V600E", 1, "")),
    ("X:p.V600Efs*3", ("X", "", "p", "Val600Glu", 2, "")),
    ("X:p.600E", ("X", "", "p", "600Glu", 2, "")),
    ("X:gain", ("X", "", "g", "ain", 0, "")),
    ("X:Loss", ("X", "", "", "Loss", 0, "unknown_desc_type")),
    ("Amplification", ("", "", "", "", 0, "not_hgvs")),
    ("a:b:c", ("", "", "", "", 0, "not_hgvs")),
]


def test_harmonize_variants(spark):
    raw = spark.createDataFrame([(i, [t, None]) for i, (t, _) in enumerate(HGVS)], "raw_id long, v array<string>")
    out = V.harmonize_variants(raw, "raw_id", ["v"]).orderBy("raw_id").collect()
    assert [(r["ref"], r["ref_version"], r["desc_type"], r["desc"], r["modify_flags"], r["unmapped_type"]) for r in out] == [w for _, w in HGVS]
    assert all(r["harmonized"] == (r["unmapped_type"] == "") and r["column"] == "v" for r in out)


@pytest.mark.parametrize(("text", "want"), [("p.A1P", "p.Ala1Pro"), ("A1P", "Ala1Pro")])
def test_amino_acids(spark, text, want):
    assert one(spark, V.aa1_to_aa3, text) == want


@pytest.mark.parametrize(("kind", "desc", "want"), [("", "V600E", "p"), ("", "Val600Glu", "p"), ("", "Valu600Glu", ""), ("", "600E", ""), ("", "V600", ""), ("", "p.V6x", "p"), ("c", "V600E", "c"), ("", "", ""), ("", "*1*", "p")])
def test_guess_desc_type(spark, kind, desc, want):
    assert spark.createDataFrame([(kind, desc)], "a string, b string").select(V.guess_desc_type(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("p.*1X", "p.Ter1Xaa"), ("12A", "12Ala"), ("AB1C", "AB1C"), ("A1b", "A1b"), ("A10020P", "Ala10020Pro"), ("", ""), (None, None), ("B1Z", "1")])
def test_amino_acid_edges(spark, text, want):
    assert one(spark, V.aa1_to_aa3, text) == want


@pytest.mark.parametrize(("ref", "alt", "want"), [("A", "T", "T"), ("AC", "A", "-"), ("A", "ATG", "TG"), ("AC", "GT", "GT"), ("ACG", "ATG", "T")])
def test_csq_allele(spark, ref, alt, want):
    assert spark.createDataFrame([(ref, alt)], "a string, b string").select(V.csq_allele(F.col("a"), F.col("b"))).first()[0] == want


def test_clean_names(spark):
    assert one(spark, V.clean_hgvs_name, "NM_000410.3(HFE):c.989G>T (p.Arg330Met)") == "NM_000410.3:c.989G>T"
    assert one(spark, V.clean_hgvs_name, "NM_1(A)x(B):c.1") == "NM_1(A)x:c.1"
    assert one(spark, V.clean_hgvs_name, "NM_1:c.1 (a) (b)") == "NM_1:c.1 (b)"
    assert [one(spark, C.strip_transcript, x) for x in ("A_ENST1", "A_ENST1_ENST", "A_ENST1_ENST2", "_ENST1", "A_ENST", None)] == ["A", "A", "A_ENST1", "_ENST1", "A_ENST", None]
    assert one(spark, C.strip_qualifiers, "aspirin (USAN, INN)") == "aspirin"
    assert [C.normalize_column(c) for c in ("Gene name(s)", "Chromosome/Position", "proteinHGVS", "Start (GRCh38)", "IDs")] == ["gene_names", "chromosome_position", "protein_hgvs", "start_grch38", "ids"]


def test_cluster_variants(spark):
    pairs = spark.createDataFrame([(5, "a"), (5, "b"), (3, "b"), (9, "z")], "variant_id long, hgvs string")
    assert rows(G.cluster_variants(pairs)) == [("a", 1), ("b", 1), ("z", 2)]


def test_components_agree_with_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = G.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted(((x, find(x)) for x in parent), key=repr)
    assert rows(G.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert len(rows(G.closure(edges))) == 12
    assert rows(G.closure(edges, root="a").select("descendant").distinct()) == [("a",), ("b",), ("c",), ("d",)]


def test_closure_doubles_paths(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "materialize", lambda df, tag, f=G.materialize: (rounds.append(tag), f(df, tag))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2000)], "child long, parent long")
    got = G.closure(edges)
    assert got.count() == 1000 * 1001 // 2 + 4 and rounds.count("closure") <= 12
    assert rows(G.closure(edges, root=1000)) == sorted(((i, 1000) for i in range(1000)), key=repr)
    assert rows(G.closure(edges, root=2000)) == [(2000, 2000), (2001, 2000)]
    assert rows(G.closure(edges.limit(0))) == []


def test_extended_clusters_equal_clusters_from_scratch(spark):
    rnd = random.Random(9)
    sets = [[(rnd.randint(0, 30), f"n{rnd.randint(0, 45)}") for _ in range(n)] for n in (25, 12, 30)]
    frames = [spark.createDataFrame(s, "variant_id long, hgvs string") for s in sets]
    known = G.cluster_variants(frames[0])
    for i in (1, 2):
        before = known
        known, changed = G.extend_variant_sets(known, frames[i])
        moved = dict(rows(changed))
        old = {n: moved.get(v, v) for n, v in before.collect()}
        now = dict(known.collect())
        assert all(now[n] == v for n, v in old.items()) and known.count() == len(now)
        order = {v: k + 1 for k, v in enumerate(sorted(set(now.values())))}
        assert sorted((n, order[v]) for n, v in now.items()) == rows(G.merge_variant_sets(frames[: i + 1]))
    again, changed = G.extend_variant_sets(known, frames[0].limit(0))
    assert rows(again) == rows(known) and rows(changed) == []


def test_link_index(spark):
    from entitylink.operators import bitmap as B

    rnd = random.Random(2)
    link = lambda n, rows_, targets: [(rnd.randrange(rows_), f"T{rnd.randrange(targets)}") for _ in range(n)]
    given = {"P": {"gene": link(400, 300, 5), "drug": link(300, 300, 40)}, "Q": {"gene": link(50, 20, 3)}, "R": {"drug": link(9, 9, 2), "gene": [(1, "T0"), (None, "T0"), (2, None)]}}
    index = B.link_index({p: {k: spark.createDataFrame(v, "raw_id long, target string") for k, v in kinds.items()} for p, kinds in given.items()})
    assert index.where("kind = 'gene' and part = 'P'").count() < 60  # words, not links

    def want(core, values):
        out = {}
        for p, kinds in given.items():
            held = [{r for r, t in kinds.get(k, []) if t in v and r is not None} for k, v in values.items()]
            for r, t in {x for x in kinds.get(core, []) if None not in x and all(x[0] in h for h in held)}:
                out[p, t] = out.get((p, t), 0) + 1
        return sorted(((p, t, n) for (p, t), n in out.items()), key=repr)

    for values in ({}, {"drug": ["T1", "T2", "T30"]}, {"drug": ["T1", "T2"], "gene": ["T0"]}, {"drug": ["absent"]}, {"drug": []}):
        assert rows(B.explore_index(index, "gene", values)) == want("gene", values)
    pairs = {}
    for p, kinds in given.items():
        for r, a in {x for x in kinds["gene"] if None not in x}:
            for s, b in set(kinds.get("drug", [])):
                if r == s:
                    pairs[p, a, b] = pairs.get((p, a, b), 0) + 1
    assert rows(B.co_occurring(index, "gene", "drug")) == sorted(((*k, n) for k, n in pairs.items()), key=repr)


def test_changed_ranges(spark):
    old = spark.range(0, 5000).select("id", (F.col("id") * 7 % 11).alias("v"))
    new = old.where("id <> 77 and id <> 4999").withColumn("v", F.when(F.col("id") == 1234, 99).otherwise(F.col("v"))).union(spark.createDataFrame([(-3, 1), (9_000, 1)], "id long, v long"))
    for width, levels in ((10, 4), (16, 3), (1, 5)):
        low = lambda k, width=width: k // width * width
        got = {r["low"]: (r["high"], r["n_old"], r["n_new"]) for r in S.changed_ranges(old, new, "id", width, levels=levels).collect()}
        assert set(got) == {low(k) for k in (77, 4999, 1234, -3, 9_000)}
        assert got[low(9_000)] == (low(9_000) + width - 1, 0, 1)
    assert S.changed_ranges(old, old.repartition(7), "id", 64).count() == 0
    null = spark.createDataFrame([(None, 1)], "id long, v long")
    assert rows(S.changed_ranges(old, old.union(null), "id", 64)) == [(None, None, 0, 1)]
    # equal rows that come in pairs do not cancel out
    assert S.changed_ranges(old, old.union(old.where("id = 5")).union(old.where("id = 5")), "id", 64).count() == 1


def test_large_dictionary_is_met_by_likely_tokens_only(spark, index, monkeypatch):
    from entitylink.operators import semi

    asked = spark.createDataFrame([(f"word{i} a2m text{i} HGNC:1",) for i in range(200)] + [("HGNC:2",), ("a1bg",), (None,)], "query string")
    want = rows(N.match_cascade(asked, *index, ("direct", "exact", "substring")))
    monkeypatch.setattr(N, "BROADCAST_BYTES", -1)
    assert rows(N.match_cascade(asked, *index, ("direct", "exact", "substring"))) == want
    names = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("key"))
    tokens = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("key"), F.col("id").alias("__cell"))
    passed = semi.may_be_in(tokens.withColumnRenamed("__cell", "x"), ["key"], *semi.key_filter(names, ["key"]))
    assert passed.where("x < 3000").count() == 3000 and passed.count() < 3000 + 17_000 * 0.1
    assert semi.may_be_in(names, ["key"], *semi.key_filter(names.limit(0), ["key"])).count() == 0


def test_stored_links_join_without_exchange(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        raw = S.store_links(spark.range(500).select(F.col("id").alias("raw_id"), (F.col("id") * 3).alias("v")), "stored_raw", buckets=4)
        link = S.store_links(spark.range(1000).select((F.col("id") % 500).alias("raw_id"), F.concat(F.lit("T"), F.col("id") % 7).alias("target")), "stored_link", buckets=4)
        got = S.filter_by_entities(raw, {"gene": link}, {"gene": ["T1", "T2"]})
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == link.where("target in ('T1', 'T2')").select("raw_id").distinct().count()
        found = S.rows_by_ids(raw, S.store_links(spark.range(9).select(F.col("id").alias("raw_id")), "stored_ids", buckets=4))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merged_statistics(spark):
    link = lambda a, b: spark.range(a, b).select(F.concat(F.lit("T"), "id").alias("target"))
    parts = {"a": link(0, 60_000), "b": link(40_000, 100_000), "c": link(0, 10)}
    stored = S.stats_sketches(parts, ["target"])
    whole = S.merged_stats(stored).first()
    assert whole["n_rows"] == 120_010 and abs(whole["n_targets"] / 100_000 - 1) < 3 * 0.0082
    exact = {r["part"]: r["n_targets"] for r in S.entity_stats(parts, ["target"]).collect()}
    assert all(abs(r["n_targets"] / exact[r["part"]] - 1) < 3 * 0.0082 for r in S.merged_stats(stored, ["part"]).collect())


def test_statistics_merge_exactly(spark):
    link = lambda a, b: spark.range(a, b).select(F.when(F.col("id") != 7, F.concat(F.lit("T"), "id")).alias("target"))
    stored = S.target_counts({"a": link(0, 60_000), "b": link(40_000, 100_000), "c": link(0, 10)}, ["target"])
    assert rows(S.merged_counts(stored, ["target"])) == [(120_010, 99_999)]
    assert rows(S.merged_counts(stored, ["target"], ["part"])) == [("a", 60_000, 59_999), ("b", 60_000, 60_000), ("c", 10, 9)]
    assert rows(S.merged_counts(stored.limit(0), ["target"])) == [(0, 0)]


def test_merged_statistics_query(spark, tmp_path):
    from entitylink.plans.registry import queries

    n = F.col("id")
    spark.range(20_000).select(n.alias("s_suppkey"), F.lit("s").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1).select(n.alias("p_partkey"), F.lit("p").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1).select(n.alias("o_orderkey"), n.alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(20_000).select(n.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), n.alias("l_suppkey"), F.lit("N").alias("l_returnflag"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(queries()["entity_stats_merged"](spark, str(tmp_path))) == [(40_000, 20_000)]


LINK_RECIPE = Recipe({"gene": ["symbol", "number"], "drug": ["drugs"], "cancer_type": ["tumor", "more"], "variant": ["texts", "built"]})


def link_rows(spark, extra=()):
    plain = [(f"r{i}", f"GENE{i % 5}", f"HGNC:{(i + i % 2) % 5}", [f"drug{i % 3}", "none", f"CHEMBL{i % 3}"], "tumor1", f"DOID:{i % 2}", [f"G{i}:p.V1E", "x", f"G{i}:p.V1E"], f"G{i}:p.V{1 + i % 2}E") for i in range(40)]
    return spark.createDataFrame([*plain, *extra], "raw_id string, symbol string, number string, drugs array<string>, tumor string, more string, texts array<string>, built string")


def link_dictionaries(spark):
    one = lambda p, q, n: spark.range(n).select(F.concat(F.lit(p), "id").alias("id"), F.concat(F.lit(q), "id").alias("name"))
    return {"gene": one("HGNC:", "GENE", 5), "drug": one("CHEMBL", "drug", 9), "cancer_type": one("DOID:", "tumor", 2)}


@pytest.mark.parametrize("limit", [64 << 20, 1500, 0])
def test_links_are_distinct_whatever_the_rows(spark, monkeypatch, limit):
    from entitylink.plans.recipes import links_of

    monkeypatch.setattr(N, "BROADCAST_BYTES", limit)
    long = [f"drug{i}" for i in range(8)]
    extra = [
        ("r1", "GENE1", "GENE4", ["drug1"], None, "tumor1", ["G1:p.V1E"], "G9:p.V9E"), ("r1", "GENE1", "GENE4", ["drug1"], None, "tumor1", ["G1:p.V1E"], "G9:p.V9E"),
        ("long", None, None, long + long, "tumor0", "tumor0", None, None), (None, "GENE2", "GENE2", None, None, None, [None, "G2:p.V1E"], "G2:p.V1E"), (None, "GENE2", "GENE2", None, None, None, None, "G2:p.V1E"),
    ]
    raw, given = link_rows(spark, extra), link_dictionaries(spark)
    got = links_of(raw, LINK_RECIPE, given)
    for kind, df in got.items():
        target = "hgvs" if kind == "variant" else "target"
        want = harmonize_part(raw, LINK_RECIPE, kind, given.get(kind))[0].select("raw_id", target)
        assert rows(df.select("raw_id", target)) == rows(want), kind


def test_links_of_single_rows_take_no_distinct(spark):
    from entitylink.plans.recipes import links_of

    got = links_of(link_rows(spark), LINK_RECIPE, link_dictionaries(spark))
    assert all("Aggregate" not in df._jdf.queryExecution().toString() for df in got.values())


def test_pair_counts_make_only_pairs_that_stand_together(spark):
    link = lambda *x: spark.createDataFrame(list(x), "raw_id long, target string")
    parts = {"P": {"gene": link((1, "G1"), (1, "G1"), (1, "G2"), (2, "G1"), (None, "G3"), (4, None)), "drug": link((1, "D1"), (2, "D1"), (3, "D2"), (4, "D4"))}, "Q": {"drug": link((5, "D1"))}}
    assert rows(S.pair_counts(parts, "gene", "drug")) == [("P", "G1", "D1", 2), ("P", "G2", "D1", 1)]


def test_stored_buckets_grow_with_the_rows():
    assert [S.buckets_for(n) for n in (0, 1, 8 << 19, (8 << 19) + 1, 216_000_000)] == [8, 8, 8, 16, 512]


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_hgvs_search_measures_its_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "BROADCAST_BYTES", limit)
    raw = spark.range(50).select(F.col("id").alias("raw_id"), F.concat(F.lit("G"), F.col("id") % 7, F.lit(":p.V1E")).alias("hgvs"))
    link = V.harmonize_variants(raw, "raw_id", ["hgvs"]).where("harmonized")
    asked = spark.createDataFrame([("G3:p.V1E",), ("G5:p.Val1Glu",), ("G9:p.V1E",)], "hgvs string")
    got = S.filter_by_hgvs(raw.select("raw_id"), link, asked)
    assert rows(got) == sorted([(i,) for i in range(50) if i % 7 in (3, 5)], key=repr)
    assert not N.fits(spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(1_000_000))).alias("k")).select(F.col("k").cast("string")))


def test_mapping_normalises_distinct_texts(spark):
    from entitylink.operators import mapping as M

    calls = spark.sparkContext.accumulator(0)

    def norm(col):
        return F.udf(lambda x: calls.add(1) or x.lower())(col)

    plain, M.normalize_name = M.normalize_name, norm
    try:
        values = M.column_values(spark.range(100).select(F.concat(F.lit("A"), F.col("id") % 2).alias("c")), ["c"])
        assert rows(values) == [("c", "a0"), ("c", "a1")]
    finally:
        M.normalize_name = plain
    assert calls.value < 20  # once a distinct text (and filter), not once a row


def test_failed_load_keeps_the_table(spark):
    good = spark.createDataFrame([(1, "a"), (2, "")], "k long, v string")
    assert files.load_table(good, "loaded", ["v"]) == 2
    with pytest.raises(RuntimeError, match="unchanged"):
        files.load_table(good.limit(1), "loaded", check=lambda df: df.count() > 1)
    assert rows(spark.table("loaded")) == [(1, "a"), (2, None)] and not spark.catalog.tableExists("loaded__staging")
    assert files.load_table(spark.table("loaded").where("k = 2"), "loaded") == 1
    assert rows(spark.table("loaded")) == [(2, None)] and not spark.catalog.tableExists("loaded__old")


def test_mapping(spark):
    from entitylink.operators import mapping as M

    df = spark.createDataFrame([(f"Gene-{i}", [f"drug {i}", None], "x" if i % 2 else f"gene{i}") for i in range(300)], "a string, b array<string>, c string")
    names = {"gene": [f"gene{i}" for i in range(0, 300)], "drug": [f"drug{i}" for i in range(0, 300, 2)], "cancer": ["y"]}
    known = {k: spark.createDataFrame([(x,) for x in v], "norm string") for k, v in names.items()}
    exact = {(r["column"], r["kind"]): r for r in M.propose_mapping(df, known, exact=True).collect()}
    assert len(exact) == 9 and (exact["a", "gene"]["share"], exact["b", "drug"]["share"], exact["c", "gene"]["n"]) == (1.0, 0.5, 151)
    assert {k for k, r in exact.items() if r["chosen"]} == {("a", "gene"), ("b", "drug")}
    values = M.column_values(df, df.columns)
    sketch = {(r["column"], r["kind"]): r["share"] for r in M.containment(M.value_sketch(values, 100), known).collect()}
    assert all(abs(sketch[k] - r["share"]) <= 4 * 0.5 / 10 for k, r in exact.items())
    halves = [M.column_values(df.where(f"c {op} 'x'"), ["a"]) for op in ("=", "<>")]
    united = M.value_sketch(M.value_sketch(halves[0], 50).union(M.value_sketch(halves[1], 50)), 50)
    assert rows(united) == rows(M.value_sketch(M.column_values(df, ["a"]), 50))


def test_assignment_is_the_best_one_to_one():
    from itertools import permutations

    from entitylink.operators.mapping import assign

    rnd = random.Random(4)
    for _ in range(30):
        shares = {(f"c{i}", f"k{j}"): rnd.choice([0.0, 0.4, 0.5, 0.7, 0.9, 1.0]) for i in range(4) for j in range(3)}
        got = assign(shares)
        assert len(set(got.values())) == len(got) and all(shares[c, k] >= 0.5 for k, c in got.items())
        best = max(sum(x for k, c in zip("012", order, strict=True) if (x := shares[f"c{c}", f"k{k}"]) >= 0.5) for order in permutations(range(4), 3))
        assert abs(sum(shares[c, k] for k, c in got.items()) - best) < 1e-9
    assert assign({}) == {}


def test_filter_by_hgvs_levels(spark):
    link = spark.createDataFrame([(1, "A:c.1", "A", "1", "", "c", 0), (2, "A.2:c.1", "A", "1", "2", "c", 4), (3, "B:g.7", "B", "7", "", "g", 0), (4, None, None, None, None, None, 0)], "raw_id long, hgvs string, ref string, desc string, ref_version string, desc_type string, modify_flags int")
    raw, asked = link.select("raw_id"), spark.createDataFrame([("A:c.1",), ("B:7",), (None,), ("nothing",)], "hgvs string")
    found = lambda *levels, **o: [r[0] for r in rows(S.filter_by_hgvs(raw, link, asked, levels, **o))]
    assert (found("RAW"), found("HGVS1"), found("HGVS2"), found("HGVS3"), found("RAW", "HGVS1")) == ([1], [1, 2, 3], [1, 3], [1], [1, 2, 3])
    assert found("HGVS1", flag_mask=4) == [2]


def test_row_ids(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x"))
    assert sorted(rows(row_ids(df, "n", ["x"], start=5))) == [(i + 4, i) for i in range(1, 1001)]
    with pytest.raises(ValueError, match="exists"):
        row_ids(df, "x", ["x"])


def test_ragged_rows(spark):
    lines = spark.createDataFrame([("1\t7,9\tu1\tu2\trest",), ("2\t\t\trest",), ("3\t7\tu1\trest",)], "line string")
    out = files.repair_ragged(lines, ["id", "assertion_ids", "urls", "last"], "assertion_ids")
    assert rows(out) == [("1", "7,9", "u1,u2", "rest"), ("2", "", "", "rest"), ("3", "7", "u1", "rest")]


def test_vcf(spark):
    header = ["##INFO=<ID=AC,Number=A,Type=Integer,Description=x>", "##INFO=<ID=DB,Number=0,Type=Flag,Description=x>", "##INFO=<ID=DP,Number=1,Type=Integer,Description=x>", "##INFO=<ID=AX,Number=A,Type=String,Description=x>"]
    lines = spark.createDataFrame([("#CHROM",), ("1\t5\t.\tA\tT,C\t.\tPASS\tAC=3,1;DB;DP=9",), ("1\t6\trs1\tA\tT\t9.5\t.\t.",)], "line string")
    out = vcf.explode_alt(vcf.parse_vcf(lines, header), ["info_ac", "info_ax"])
    assert rows(out.select("pos", "alt", "info_ac", "info_ax", "info_db", "info_dp", F.size("alts"))) == [(5, "C", 1, "", True, 9, 2), (5, "T", 3, "", True, 9, 2), (6, "T", None, "", False, None, 1)]


def test_ontology(spark):
    text = '[Term]\nid: A:1\nname: one\nsynonym: "first \\"x\\"" EXACT []\nis_a: A:0 ! zero'
    terms, synonyms, edges = ontology.parse_obo(spark.createDataFrame([(text,), ("[Typedef]\nid: t",)], "stanza string"))
    assert (rows(terms), rows(synonyms), rows(edges)) == ([("A:1", "one")], [("A:1", 'first \\"x\\"', "EXACT")], [("A:1", "A:0")])


@pytest.mark.parametrize(("expected", "found", "label"), [(None, ["a"], "FP"), (None, [], "TN"), ("x", ["x", "y"], "TP"), ("x", [], "FN"), ("x", ["y"], "FP"), ("x", None, "FN")])
def test_assessment(spark, expected, found, label):
    df = spark.createDataFrame([(expected, found)], "expected string, found array<string>")
    assert N.assess(df).first()["label"] == label


def test_explore(spark):
    link = lambda *x: spark.createDataFrame(list(x), "raw_id long, target string")
    parts = {"P": {"gene": link((1, "G1"), (1, "G2"), (2, "G1")), "drug": link((1, "D1"))}, "Q": {"drug": link((5, "D1"))}}
    assert rows(S.explore(parts, "gene")) == [("P", "G1", 2), ("P", "G2", 1)]
    assert rows(S.explore(parts, "gene", {"drug": ["D1"]})) == [("P", "G1", 1), ("P", "G2", 1)]


def test_jdbc(spark):
    url = "jdbc:derby:memory:test;create=true"
    spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("v")).write.mode("overwrite").jdbc(url, "t", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = files.read_jdbc(spark, url, "t", "k", 0, 20, 3, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 3
    assert rows(C.normalize_columns(got)) == sorted([(i, f"n{i}") for i in range(20)], key=repr)


def test_small_helpers(spark):
    with pytest.raises(ValueError, match="missing"):
        C.check_columns(spark.range(1), ["absent"], hard=True)
    with pytest.raises(ValueError, match="prefix"):
        C.entity_modifier(spark.range(1), lambda df: df.withColumn("y", F.lit(1)))
    counts = S.table_counts({"a": spark.range(3), "b": spark.range(0)}, {"a": 3, "b": 0})
    assert rows(counts) == [("a", 3, True), ("b", 0, False)]


def test_stream_links(spark, index, tmp_path):
    from entitylink.streaming.links import stream_links

    spark.createDataFrame([(1, "a2m"), (2, "HGNC:1"), (3, "none")], "raw_id long, gene string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("raw_id long, gene string").parquet(str(tmp_path / "in"))
    q = stream_links(stream, "raw_id", "gene", *index).writeStream.format("memory").queryName("linked").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("linked").select("raw_id", "target")) == [(1, "HGNC:2"), (2, "HGNC:1")]


def test_fingerprint_of_many_rows(spark):
    from entitylink.operators.serve import fingerprint

    many = spark.range(3_000_000)
    assert fingerprint(many).first()["total"] == fingerprint(many.repartition(3)).first()["total"] != fingerprint(many.limit(2_999_999)).first()["total"]


def test_skipped_lines_go_by_position(spark, tmp_path):
    from entitylink.sources.files import read_delimited

    (tmp_path / "a.tsv").write_text("# made\na\tb\n1\t2\na\tb\n# made\n")
    (tmp_path / "b.tsv").write_text("# made\na\tb\n3\t4\na\tb\n")
    (tmp_path / "c.tsv").write_text("5\t6\n")
    got = read_delimited(spark, str(tmp_path), skip=1).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted([("1", "2"), ("a", "b"), ("# made", None), ("3", "4"), ("a", "b"), ("5", "6")])


def test_skipped_lines_may_be_empty(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#made\n\nc1\tc2\n1\ta\n\n2\tb\n")
    (tmp_path / "b.tsv").write_text("\n\n3\tc\n#made\td\n")
    got = files.read_delimited(spark, str(tmp_path), skip=2)
    # the second file's first two lines are empty too: the second repeats the preamble's second line
    assert (got.columns, rows(got)) == (["c1", "c2"], [("#made", "d"), ("1", "a"), ("2", "b"), ("3", "c")])
    assert rows(files.read_delimited(spark, str(tmp_path), skip=2, comment="#")) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_skipped_lines_of_headerless_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#made\n\n1\ta\n2\tb\n")
    got = files.read_delimited(spark, str(tmp_path), skip=2, names=["k", "v"])
    assert (got.columns, rows(got)) == (["k", "v"], [("1", "a"), ("2", "b")])


def test_declared_sources(spark):
    from entitylink.plans.recipes import curated, source

    genes = spark.createDataFrame([("HGNC:1", "KRAS")], "id string, name string")
    raw = spark.createDataFrame([(1, "KRAS", "NM_1.2", "G12D"), (2, "kras", "NM_1.2", "Fusion"), (3, None, None, "G12D")], "raw_id long, hugo_symbol string, ref_seq string, alteration string")
    got = curated(raw, source("annotated"), {"gene": genes})
    assert rows(got["gene"]) == [(1, "HGNC:1"), (2, "HGNC:1")]
    assert rows(got["variant"].select("raw_id", "hgvs")) == [(1, "NM_1.2:G12D")]
    pairs = spark.createDataFrame([(1, "KRAS", "NM:c.1A>T", "A", None), (2, "KRAS", "NM:c.2A>T", "A", "T")], "raw_id long, genename string, hgvsc string, aaref string, aaalt string").withColumn("hgvsp", F.lit(None).cast("string"))
    assert rows(curated(pairs, source("predictions"), {"gene": genes})["variant"].select("raw_id", "hgvs")) == [(2, "NM:c.2A>T")]


def test_display(spark):
    shown = C.display(spark.createDataFrame([(1, ["a", "b"])], "n long, l array<string>"), {"l": lambda c: F.array_join(c, ", "), "absent": F.upper})
    assert rows(shown) == [(1, "a, b")]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from entitylink.functions.storage import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        scratch(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x", getConf=lambda: conf), conf=conf))


def test_hgvs_split_is_the_patterns(spark):
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice("cgpN.:..12V9E*\n\r\x85\u2028é") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    end = "\n\r\x85\u2028\u2029"

    def split(x):
        ref, desc = x.partition(":")[0], x.rpartition(":")[2]
        versioned = re.search(rf"[^{end}]+\.[0-9]+(?:\r\n|[{end}])?\Z", ref)
        kind = re.match(rf"[cgmnopr](?=[^{end}])", desc)
        kind = kind[0] if kind else ""
        return (ref.split(".")[0] if versioned else ref, ref.split(".")[1] if versioned else "", kind, re.sub(rf"\A\.(?=[^{end}])", "", desc[len(kind) :]))

    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", V.hgvs_split(F.col("x")).alias("p")).collect()
    assert {r.x: tuple(r.p) for r in got} == {x: split(x) for x in texts}
    assert tuple(spark.sql("select cast(null as string) x").select(V.hgvs_split(F.col("x"))).first()[0]) == (None, "", None, None)


def test_references_are_asked_for_without_parsing_changes(spark, tmp_path):
    from entitylink.plans import registry

    raw = spark.createDataFrame([(1, "NM_1.2:c.5G>T"), (2, "GENE7:Loss"), (3, "no variant"), (4, None), (5, "A.B:p.V600E")], "raw_id long, hgvs string")
    assert rows(V.references(raw, "hgvs")) == sorted([("NM_1",), ("GENE7",), (None,), (None,), ("A.B",)], key=repr)
    spark.createDataFrame([(1, 2, 3, 1, 5.0, "R", "F"), (2, 2, 3, 5, 5.0, "A", "F"), (3, 9, 3, 1, 7.0, "R", "F"), (4, 2, 3, 1, 5.0, "R", "O")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    out = registry.queries()["map_ref_to_gene"](spark, str(tmp_path))
    assert rows(out) == sorted([("1-1-2-3", "HGNC:2", 6), ("3-1-9-3", "GENE9", 2)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", [0-9]+, 0)") == 1  # changes are parsed for the variants only


def test_names_expand_over_one_closure(spark, monkeypatch):
    from entitylink.plans import recipes as R

    rng = random.Random(8)
    # terms with several parents, a cycle under the root, terms beside the root and above it
    edges = [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 60) for _ in range(1 + i % 2)] + [("t7", "t50"), ("t50", "t7"), ("t0", "top"), ("t9", "side"), ("side", "top"), ("low", "side")]
    terms = [(f"t{i}", f"name {i % 20}") for i in range(60)] + [("side", "side"), ("top", "top"), ("low", "low"), ("t3", "")]
    synonyms = [("t5", "five", "EXACT"), ("t5", "vague", "RELATED")]
    made = []
    monkeypatch.setattr(G, "materialize", lambda df, tag, f=G.materialize: (made.append(tag), f(df, tag))[1])
    got = R.ontology_names(spark.createDataFrame(terms, "id string, name string"), spark.createDataFrame(synonyms, "id string, text string, scope string"), spark.createDataFrame(edges, "child string, parent string"), "t0", expand=True)
    above = {}
    for c, p in edges:
        above.setdefault(c, set()).add(p)
    while any([len(above[c]) < len(above[c].update(*[above.get(p, ()) for p in list(above[c])]) or above[c]) for c in above]):
        pass
    below = {c for c in above if "t0" in above[c]}
    own = {(i, n) for i, n in terms + [("t5", "five")] if n and i in below}
    want = own | {(c, n) for c in above for i, n in own if i in above[c]} | {(p, n) for i, n in own for p in above[i] if p in below}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert made.count("edges") == 1  # one closure tells what is under the root as well
