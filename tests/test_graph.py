import random

from lorequarry.operators import graph
from lorequarry.operators.resolve import best_matches


def test_substrings_equal_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abAB ") for _ in range(rng.randint(1, n)))
    left, right = {make(7) for _ in range(60)}, {make(12) for _ in range(60)}
    a, b = spark.createDataFrame([(x,) for x in [*left, None, ""]], "x string"), spark.createDataFrame([(y,) for y in [*right, None, ""]], "y string")
    for both in (True, False):
        got = {tuple(r) for r in graph.substring_matches(a, b, "x", "y", both).collect()}
        assert got == {(x, y) for x in left for y in right if x.lower() in y.lower() or both and y.lower() in x.lower()}


def test_cooccurrence_and_neighbours(spark):
    rows = [("c1", "Anna Roe met Bela Kun, then Edda Holt."), ("c2", "Anna Roe saw Bela Kun."), ("c3", "Edda Holt alone."), ("c2", "Anna Roe saw Bela Kun."), ("c4", None)]
    named = graph.chunk_entities(spark.createDataFrame(rows, "chunk_id string, text string"))
    edges = graph.cooccurrence(named)
    assert {tuple(r) for r in edges.collect()} == {("Anna Roe", "Bela Kun", 2), ("Anna Roe", "Edda Holt", 1), ("Bela Kun", "Edda Holt", 1)}
    assert graph.supported_by(named).count() <= graph.mentions(named).count()
    near = graph.graph_neighbours(spark.createDataFrame([("anna roe",)], "seed string"), graph.mentions(named).select("entity"), edges)
    assert near.orderBy("rank").first().name.startswith("Bela Kun")


def test_trails(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "d"), (5, "x", "x"), (6, "y", "z"), (7, "y", "z")], "edge_id int, subject string, object string")
    seeds = spark.createDataFrame([("a",), ("x",), ("y",), ("none",)], "seed string")
    got = {}
    for r in graph.trails(edges, seeds, 3).collect():
        got.setdefault(r.seed, []).append((r.hops, tuple(r.nodes)))
    assert sorted(h for h, _ in got["a"]) == [1, 1, 2, 2, 2, 3, 3, 3]
    assert got["x"] == [(1, ("x", "x"))] and sorted(h for h, _ in got["y"]) == [1, 1, 2, 2] and "none" not in got
    assert graph.trails(edges, seeds, 3, 2).filter("seed = 'a'").count() == 2


def test_paths_and_evidence(spark):
    edges = spark.createDataFrame([(1, "a", "b", "KNOWS", "a knows b", "c1"), (2, "b", "c", None, "", "c2")], "edge_id int, subject string, object string, predicate string, evidence string, chunk_id string")
    paths = graph.with_relationships(graph.trails(edges, spark.createDataFrame([("a",)], "seed string"), 2), edges)
    lines = {r.s for r in paths.select(graph.path_summary(paths.nodes, paths.relationships).alias("s")).collect()}
    assert lines == {"a -[KNOWS]-> b", "a -[KNOWS]-> b | b -[RELATED_TO]-> c"}
    assert sorted((r.chunk_id, r.score) for r in graph.graph_evidence(paths).collect()) == [("c1", 0.5), ("c1", 1.0)]


def test_claims_and_conflicts(spark):
    rows = [("s", "P", "o", "c", "old", "d", "wiki", 1), ("s", "P", "o", "c", "new", "d", "wiki", 2), ("s", "P", None, "c", "x", "d", None, 3), ("s", "P", "q", "c2", "", "d", None, 1), (None, "P", "o", "c", "", "d", None, 1)]
    claims = spark.createDataFrame(rows, "subject string, predicate string, object string, chunk_id string, evidence string, document_id string, source_type string, loaded_at int")
    edges = graph.claim_graph(claims)
    assert sorted((r.object, r.evidence) for r in edges.collect()) == [("o", "new"), ("q", "")]
    assert {tuple(r) for r in graph.claim_supports(edges).collect()} == {("c", "s"), ("c", "o"), ("c2", "s"), ("c2", "q")}
    assert [(r.subject, r.objects, r.n_claims) for r in graph.detect_conflicts(claims).collect()] == [("s", ["o", "q"], 4)]
    names = spark.createDataFrame([("o",)], "name string")
    assert [(r.other, r.predicate) for r in graph.claim_neighbours(edges, names).collect()] == [("s", "P")]


def test_best_matches_equal_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(3, 24))).strip() or "a" for _ in range(50)]
    asked = list(dict.fromkeys(p[:k] + rng.choice("abxy") + p[k + rng.randint(0, 1) :] for p in pool for k in [rng.randrange(len(p))]))
    names = spark.createDataFrame([(a,) for a in [*asked, None]], "name string")
    candidates = spark.createDataFrame([(c, i) for i, c in enumerate([*pool, None])], "candidate string, ord long")
    norm = lambda s: " ".join(s.strip().split()) if not s.strip().count("  ") else __import__("re").sub(r"\s+", " ", s.strip())
    for r in best_matches(names, candidates, 0.9).collect():
        ratios = [(SequenceMatcher(None, norm(r.name), norm(c)).ratio(), -i, c) for i, c in enumerate(pool)]
        top = max(ratios)
        assert r.match == (top[2] if top[0] >= 0.9 else r.name) or abs(top[0] - r.ratio) < 1e-9


def test_limited_trails_equal_all_trails_cut(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abcdefgh"), rng.choice("abcdefghijklmnopqrst")) for i in range(40)] + [(100 + i, "hub", f"n{i % 30}") for i in range(60)] + [(200, "x", "hub"), (201, "x", "y")]
    edges = spark.createDataFrame(rows, "edge_id int, subject string, object string")
    seeds = spark.createDataFrame([(s,) for s in ("a", "k", "hub", "x", "y", "n3", "none")], "seed string")
    every = {}
    for r in graph.trails(edges, seeds, 3, None).collect():
        every.setdefault(r.seed, []).append((r.hops, r.edge_ids, r.nodes))
    for limit in (1, 7, 50):
        got = {}
        for r in graph.trails(edges, seeds, 3, limit).collect():
            got.setdefault(r.seed, []).append((r.hops, r.edge_ids, r.nodes))
        assert {s: sorted(t) for s, t in got.items()} == {s: sorted(t)[:limit] for s, t in every.items()}


def test_hubs_do_not_multiply(spark):
    """Three hops over a hub of 2,000 edges, from each of its neighbours, at work no larger than the limit asks for."""
    edges = spark.createDataFrame([(i, "hub", f"n{i}") for i in range(2000)], "edge_id int, subject string, object string")
    seeds = edges.selectExpr("object AS seed")
    rows = graph.trails(edges, seeds, 3, 50).groupBy("hops").count().collect()
    assert {r.hops: r["count"] for r in rows} == {1: 2000, 2: 49 * 2000}


def test_resolution_knows_rare_subjects(spark, tmp_path):
    from lorequarry.queries import QUERIES

    rows = [("House Aldermoor", "House Aldermor"), ("Bela Kun of the North", None), (None, "Bela Kun of the Nort"), ("Bela Kun of the Nortth", "unlike any")]
    spark.createDataFrame(rows, "subject string, object string").write.parquet(f"{tmp_path}/claims.parquet")
    got = {r.name: r.match for r in QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got["House Aldermor"] == "House Aldermoor" and got["Bela Kun of the Nort"] == "Bela Kun of the North" and got["unlike any"] == "unlike any"
    assert got["Bela Kun of the Nortth"] == "Bela Kun of the Nortth" and set(got) == {x for r in rows for x in r if x}


def _archive(spark, rng):
    words = ["Anna", "anna", "ANNA ROE", "Roe", "In", "The Inn", "Edda Holt", "Holt", "Bela Kun", "Kun", "Of", "An", "Dora", "Ida", "Ina"]
    rows = [(f"c{i:03}", sorted({rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 6))})) for i in range(120)]
    return spark.createDataFrame(rows, "chunk_id string, entities array<string>")


def test_archive_neighbours_equal_neighbours_by_edges(spark):
    named = _archive(spark, random.Random(5))
    seeds = spark.createDataFrame([(s,) for s in ("anna", "Anna Roe in the Inn", "Holt", "nobody", "Kun", "KUN", "", "Annain")], "seed string")
    for both in (True, False):
        every = {tuple(r) for r in graph.graph_neighbours(seeds, graph.mentions(named).select("entity"), graph.cooccurrence(named), 3, both, ["Of"]).collect()}
        assert len(every) > 5
        for hub in (0, 12, 40, 1000):
            assert {tuple(r) for r in graph.archive_neighbours(seeds, named, 3, both, ["Of"], hub).collect()} == every


def test_archive_neighbours_meet_no_more_than_they_need(spark):
    """A hub of 3,000 neighbours and 3,000 seeds that contain it: edges by seeds would be 9 million rows."""
    rows = [(f"c{i}", ["In", f"N{i}", *[f"Often {k}" for k in range(20)]]) for i in range(3000)]
    named = spark.createDataFrame(rows, "chunk_id string, entities array<string>")
    seeds = spark.createDataFrame([(f"in {i}",) for i in range(3000)], "seed string")
    got = graph.archive_neighbours(seeds, named, 20)
    assert got.count() == 60_000 and got.filter("name NOT LIKE 'Often%' OR count <> 3000").count() == 0


def _moved(spark, last):
    """(rows that stages after ``last`` wrote for others, the last stage)."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > last), max([s.stageId() for s in stages], default=-1)


def test_archive_neighbours_add_up_a_hub_once(spark):
    """1,500 seeds of one hub with 1,500 neighbours that are all as frequent as the last within the limit: edges by seeds would be 2 million rows."""
    rows = [(f"c{i}", ["An", f"N{i % 1500:04}"]) for i in range(3000)]
    named = spark.createDataFrame(rows, "chunk_id string, entities array<string>")
    seeds = spark.createDataFrame([(f"an {i}",) for i in range(1500)], "seed string")
    _, last = _moved(spark, -1)
    got = graph.archive_neighbours(seeds, named, 20).groupBy("name", "rank", "count").agg({"seed": "count"}).collect()
    assert {tuple(r) for r in got} == {(f"N{i:04}", i + 1, 2, 1500) for i in range(20)}
    assert _moved(spark, last)[0] < 500_000


def test_evidence_search_equals_brute_force(spark):
    named = _archive(spark, random.Random(9))
    held = {r.chunk_id: r.entities for r in named.collect()}
    names = ["anna", "Holt of Kun", "Ida", "nobody", "Dora"]
    asked = spark.createDataFrame([(f"q{i % 3}", n) for i, n in enumerate(names)], "query_id string, name string")
    want = set()
    for i, n in enumerate(names):
        hit = {e for es in held.values() for e in es if n.lower() in e.lower() or e.lower() in n.lower()}
        near = {o for es in held.values() for e in es if e in hit for o in es if o != e}
        want |= {(f"q{i % 3}", c, r) for c, r in sorted((c, r) for c, es in held.items() for r in es if r in near)[:6] if r != "Of"}
    for first in (1, 3, 1000):
        assert {tuple(r) for r in graph.evidence_search(asked, named, 6, ["Of"], first).collect()} == want
