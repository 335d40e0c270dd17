"""Memory tiers, thoughts, online refinement, lookup and noise against brute force and small cases worked out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import registry
from weft.functions import names, parsing, predicates
from weft.functions import text as T
from weft.operators import graph as G
from weft.operators import learning as E
from weft.operators import lookup as L
from weft.operators import memory as M
from weft.operators import optimizer as Z
from weft.operators import thoughts as H
from weft.operators import vectors as X
from weft.plans import expressions, refine
from weft.sources import readers, writers
from weft.streaming import online


def plain_cache(requests, capacity, policy, ghosts=1024):
    """The policies by searching all entries each time."""
    held, gone, clock, out = {}, [], 1, []
    for key in requests:
        hit = key in held
        if hit:
            e = held[key]
            e["used"], e["freq"] = clock, e["freq"] + 1
            e["queue"] = "am" if policy == "2q" else ""
            clock += 1
            out.append((True, []))
            continue
        again = key in gone
        if policy == "2q" and again:
            gone.remove(key)
        held[key] = {"order": clock, "used": clock, "freq": 1, "queue": ("am" if again else "a1") if policy == "2q" else ""}
        clock += 1
        left = []
        while len(held) > capacity:
            rank = {"lru": lambda e: (e["used"], e["order"]), "lfu": lambda e: (e["freq"], e["used"], e["order"]), "2q": lambda e: (0, e["order"], e["used"]) if e["queue"] == "a1" else (1, e["used"], e["order"])}[policy]
            worst = min(held, key=lambda k: rank(held[k]))
            if policy == "2q" and held[worst]["queue"] == "a1":
                gone.append(worst)
                del gone[: max(0, len(gone) - ghosts)]
            left.append(worst)
            del held[worst]
        out.append((False, left))
    return out


@pytest.mark.parametrize("policy", ["lru", "lfu", "2q"])
def test_tiers(spark, policy):
    rng = random.Random(3)
    said = {t: [f"k{int(rng.paretovariate(0.7)) % 40}" for _ in range(300)] for t in ("a", "b")}
    rows = [(t, i, k, "answer") for t, keys in said.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "tier string, seq long, key string, answer string").repartition(5)
    found = {}
    for r in M.consulted(df, 7, policy).orderBy("tier", "seq").collect():
        found.setdefault(r.tier, []).append((r.hit, list(r.evicted)))
    assert found == {t: plain_cache(keys, 7, policy) for t, keys in said.items()}
    assert all(n <= 7 for n in (r["count"] for r in M.remaining(df, 7, policy).groupBy("tier").count().collect()))
    tier = M.Tier(3, policy, ghosts=2)
    for k in ("x", "y", "z", "w", "x", "v"):
        M.asked(tier, k, "a")
    again = M.Tier(3, policy, ghosts=2).loaded(tier.dumped())
    assert again.entries == tier.entries and again.ghosts == tier.ghosts and tier.put("", "a") == [] and tier.put("q", None) == []
    with pytest.raises(ValueError):
        M.Tier(3, "other")


def test_tier_on_a_stream(spark, tmp_path):
    rows = [("t", i, k, "a") for i, k in enumerate("abcabdacbd")]
    for at, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, "tier string, seq long, key string, answer string").coalesce(1).write.parquet(str(tmp_path / "in" / str(at)))
    stream = spark.readStream.schema("tier string, seq long, key string, answer string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    M.stream_consulted(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = [r.hit for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert found == [h for h, _ in plain_cache("abcabdacbd", 3, "lru")]


def test_trie_eviction(spark):
    paths = [("a",), ("a", "b"), ("a", "b", "c"), ("d",), ("d", "e")]
    rows = [("t", list(p), c, o, o, c, "") for o, (p, c) in enumerate(zip(paths, (5, 1, 3, 4, 2), strict=True))]
    df = spark.createDataFrame(rows, "trie string, path array<string>, count long, order long, last_used long, frequency long, queue string")
    # leaves only: d/e (2) before a/b/c (3); then a/b (1) is a leaf
    assert [r.path for r in M.trie_eviction(df, 2).collect()] == ["d/e", "a/b/c", "a/b"]


def test_depths_and_paths(spark):
    rng = random.Random(4)
    parent = {0: None, 1: None, 2: 99} | {i: rng.randrange(i) for i in range(3, 80)} | {200: 201, 201: 200}
    df = spark.createDataFrame([(f"n{i}", None if p is None else f"n{p}") for i, p in parent.items()], "id string, parent_id string")

    def up(i):
        out = [i]
        while parent.get(out[-1]) in parent and len(out) < 300:
            out.append(parent[out[-1]])
        return out[::-1]

    found = {r.id: (r.root, r.depth, r.leaf) for r in H.depths(df).collect()}
    want = {f"n{i}": (f"n{up(i)[0]}", len(up(i)) - 1, i not in parent.values()) for i in parent if i < 200}
    assert found == want
    ways = {r.id: list(r.path) for r in H.paths_to_root(df.where("id NOT IN ('n200', 'n201')"), df.select("id")).collect()}
    assert ways == {f"n{i}": [f"n{x}" for x in up(i)] for i in parent if i < 200}


def test_shortest_paths(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(34)})
    rows = [(f"e{i}", f"n{a}", f"n{b}", i) for i, (a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "id string, src string, dst string, seq long")
    pairs = [(f"n{a}", f"n{b}") for a, b in itertools.product(range(14), range(14))]
    found = {(r.start, r.end): (list(r.node_ids), list(r.edge_ids)) for r in H.shortest_paths(df, spark.createDataFrame(pairs, "start string, end string")).collect()}

    def first(start, end):
        came, queue = {start: None}, [start]
        for u in queue:
            for e, a, b, _ in rows:
                if a == u and b not in came:
                    came[b] = (u, e)
                    queue.append(b)
        if end not in came:
            return None
        nodes, used = [end], []
        while came[nodes[0]]:
            u, e = came[nodes[0]]
            nodes.insert(0, u)
            used.insert(0, e)
        return nodes, used

    assert found == {p: first(*p) for p in pairs if first(*p)}


def test_closure_of_long_chains_and_cycles(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(70)] + [(rng.randrange(100, 112), rng.randrange(100, 112)) for _ in range(18)]
    found = {(r.src, r.tgt) for r in G.closure(spark.createDataFrame(links, "src long, tgt long")).collect()}
    reach = set(links)
    while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= more
    assert found == reach


def test_two_section_in_blocks(spark):
    rng = random.Random(7)
    rows = sorted({(rng.randrange(60), rng.randrange(6)) for _ in range(200)})
    want = {}
    for e in range(6):
        for a, b in itertools.combinations(sorted(v for v, x in rows if x == e), 2):
            want[a, b] = want.get((a, b), 0) + 1
    for block in (4, 1024):
        assert {(r.a, r.b): r.n for r in G.two_section(spark.createDataFrame(rows, "vid long, eid long"), block).collect()} == want


def test_best_matches_upper(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(70, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    unit = v.astype(np.float32).astype(float)
    unit /= np.sqrt((unit**2).sum(1, keepdims=True)) + X.EPSILON
    score = unit @ unit.T
    found = {(r.left, r.right): r.score for r in X.pair_scores(df, df, upper=True).collect()}
    assert set(found) == {(i, j) for i in range(70) for j in range(i + 1, 70)} and all(abs(found[p] - score[p]) < 1e-9 for p in found)
    best = {(r.left, r.rank): r.right for r in X.best_matches(df, df, 2, upper=True).collect()}
    assert all(best[i, 1] == i + 1 + int(score[i, i + 1 :].argmax()) for i in range(69))


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch, capsys):
    """What is shuffled and written beside the result grows with the vectors, not with the pairs of their blocks; stripes end within blocks."""
    monkeypatch.setattr(X, "BLOCK_ROWS", 16)
    monkeypatch.setattr(X, "STRIPE_ROWS", 5)
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(150, 5)).astype(np.float32), rng.normal(size=(41, 5)).astype(np.float32)
    a, b = (spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vector array<double>") for m in (v, w))
    unit = lambda m: m / (np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True)) + X.EPSILON)
    pairs = X.pair_scores(a, b, digits=3)
    found = {(r.left, r.right): r.score for r in pairs.collect()}
    score = unit(v) @ unit(w).T
    assert len(found) == 150 * 41 and all(abs(found[i, j] - round(score[i, j], 3)) < 1e-12 for i in range(150) for j in range(41))
    capsys.readouterr()
    pairs.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Generate" not in plan and "SortMergeJoin" not in plan
    best = {(r.left, r.rank): r.right for r in X.best_matches(a, b, 3).collect()}
    assert all([best[i, k] for k in (1, 2, 3)] == list(np.argsort(-score[i])[:3]) for i in range(150))


def test_online_merge_and_split():
    g = online.ClassGraph([("p", "a", "r", 2.0), ("a", "c", "r", 2.0), ("b", "c", "r", 1.0)], {"a": ["a", "a2"]})
    assert g.ranks() == {"a": 1, "p": 2, "c": 0, "b": 0} and g.resolve("zz", ["a2"]) == "a" and not g.twins("a", "b")
    said = online.refine_graph(g, [{"source": "p", "target": "b"}], similar=lambda x, y: {x, y} == {"a", "b"})
    # b now stands where a stands; both are below p, but b's rank is not that of a, so only its own rank's classes are tried
    assert said[0]["lane"] == "applied" and ("p", "b", "no", 2.0) in g.edges()
    assert g.merge(["a", "b"]) == "a" and g.members["a"] == ["a", "a2", "b"] and g.edges() == [("a", "c", "r", 2.0), ("p", "a", "no", 2.0), ("p", "a", "r", 2.0)]
    assert g.split("a", {"b"}, "c") == "b" and g.resolve("b") == "b" and ("b", "c", "r", 2.0) in g.edges() and g.split("b", {"b"}, "x") is None
    late = online.refine_graph(online.ClassGraph([("top", "mid"), ("mid", "low")]), [{"source": "low", "target": "other"}, {"source": "mid", "target": "top"}, {"source": "low", "target": "top", "confidence": 1.0}])
    assert sorted(u["lane"] for u in late) == ["CYCLE", "LOW_CONFIDENCE", "applied"]
    worse = online.refine_graph(online.ClassGraph([("x", "y"), ("y", "z"), ("u", "v")]), [{"source": "v", "target": "x"}])
    assert [u["lane"] for u in worse] == ["INCONSISTENT_RANK"]
    twins = online.refine_graph(online.ClassGraph([("r", "t1")]), [{"source": "r", "target": "t2"}], similar=lambda x, y: x[0] == y[0] == "t")
    assert [(u["lane"], u["source"], u["target"]) for u in twins] == [("applied", "r", "t2"), ("merged", "t1", "t2")]


def test_readers_beyond_turtle(spark, tmp_path):
    (tmp_path / "a.nt").write_text('_:x <http://p> "caf\\u00e9 \\U0001F600 \\\\u0041" .\n# note\nbroken line\n<http://a> <http://p> _:x .\n', encoding="utf-8")
    (tmp_path / "b.nt").write_text("_:x <http://p> <http://b> .\n", encoding="utf-8")
    rows = readers.triples(spark, str(tmp_path / "*.nt"), "nt").collect()
    blanks = {r.s for r in rows if r.s.startswith("_:")}
    assert len(blanks) == 2 and {r.o for r in rows if r.kind == "literal"} == {"café 😀 \\u0041"}
    assert {r.o for r in rows if r.s == "http://a"} <= blanks
    assert [r.line for r in readers.malformed(spark, str(tmp_path / "*.nt")).collect()] == ["broken line"]
    (tmp_path / "g.trig").write_text("@prefix e: <http://e/> . e:g { e:a e:p e:b ; e:q [ e:r 1 ] } e:c e:p e:d .", encoding="utf-8")
    found = readers.triples(spark, str(tmp_path / "g.trig"))
    assert found.count() == 4 and {(r.s, r.o) for r in found.where("p = 'http://e/p'").collect()} == {("http://e/a", "http://e/b"), ("http://e/c", "http://e/d")}
    (tmp_path / "j.jsonld").write_text('{"@context": {"e": "http://e/", "knows": {"@id": "e:knows", "@type": "@id"}}, "@id": "e:a", "@type": "e:K", "knows": ["e:b", "e:c"], "e:n": {"e:m": 2}}', encoding="utf-8")
    found = [(r.s, r.p, r.o, r.kind) for r in readers.triples(spark, str(tmp_path / "j.jsonld")).collect()]
    assert ("http://e/a", "http://e/knows", "http://e/c", "iri") in found and sum(k == "bnode" for *_, k in found) == 1 and len(found) == 5
    (tmp_path / "t.trix").write_text("<TriX><graph><triple><uri>http://a</uri><uri>http://p</uri><typedLiteral datatype='x'>1</typedLiteral></triple></graph></TriX>", encoding="utf-8")
    assert [tuple(r) for r in readers.triples(spark, str(tmp_path / "t.trix")).collect()] == [("http://a", "http://p", "1", "literal")]


def test_class_expressions_nested(spark):
    turtle = """@prefix e: <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
    _:x a owl:Restriction ; owl:onProperty e:p ; owl:allValuesFrom [ owl:unionOf ( e:A [ owl:intersectionOf ( e:B [ a owl:Restriction ; owl:onProperty e:q ; owl:hasSelf "true" ] ) ] ) ] ."""
    df = spark.createDataFrame(list(readers.parse_turtle(turtle)), readers.TRIPLES)
    found = expressions.class_expressions(df, {"e": "http://e/"}).collect()
    assert [r.text for r in found] == ["e:p only (e:A or (e:B and e:q Self))"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a & b", "is_a", "http://x/c"), ("a & b", "likes", 'q"<')], "s string, p string, o string")
    for form in ("turtle", "nt", "xml"):
        path = str(tmp_path / form)
        writers.write_rdf(df, path, form, base="urn:t:")
        found = {(r.s, r.p, r.o) for r in readers.triples(spark, path, form).collect()}
        assert ("urn:t:a_b", writers.SUBCLASS, "http://x/c") in found and ("urn:t:likes", writers.TYPE, writers.PROPERTY) in found and len(found) == 3, form
    assert writers.load_snapshot(spark, str(tmp_path / "none")) is None
    writers.save_snapshot({"t": df}, str(tmp_path / "snap"), name="x")
    assert writers.load_snapshot(spark, str(tmp_path / "snap"), name="y") is None and writers.load_snapshot(spark, str(tmp_path / "snap"), name="x")["t"].count() == 2
    assert writers.digest(df) == writers.digest(df.union(df).repartition(3)) != writers.digest(df.limit(1))
    assert [r.value for r in writers.markdown(spark.createDataFrame([(1, "a|b")], "n int, t string")).orderBy("n").collect()] == ["| n | t |", "| --- | --- |", "| 1 | a\\|b |"]
    log = str(tmp_path / "log")
    for lsn, (name, made) in enumerate([("a", []), ("b", ["a"])]):
        writers.append_log(spark.createDataFrame([(lsn, name, made)], "lsn long, id string, derived_from array<string>"), log)
    assert [r.id for r in writers.log_records(spark, log).collect()] == ["a", "b"] and [r.id for r in writers.derived_from(spark, log, "b").collect()] == ["a"]


def test_names_and_parsing(spark):
    row = spark.createDataFrame([(" Žluťoučký ½ kůň ﬁn™ 日本 ",)], "t string").select(T.slug(F.col("t")).alias("s")).first()
    assert row.s == "Zlutoucky_12_kun_finTM"
    assert names.name_from_uuid("12345678-1234-5678-1234-567812345678").count("-") == 2
    assert names.name_from_uuid("00000000-0000-0000-0000-000000000001", "slug62") == "0" * 21 + "1"
    assert parsing.first_object('x {"a": "}"} y') == {"a": "}"} and parsing.first_object("[1]") is None and parsing.flattened({"b": {"c": 1, "d": [2]}, "a": None}) == {"a": None, "b.c": 1}
    assert parsing.coerced_call({"tool_name": "T", "arguments": {"max_results": "many"}}, {})["arguments"] == {"max_results": "many"}
    assert T.variables("{a} {{ b }}") == ["a", "b"]
    merged = predicates.DEFAULT.merged({"drop": ["x"]})
    assert "x" in merged.drop and predicates.DEFAULT.drop != merged.drop


def test_lookup(spark):
    nodes = spark.createDataFrame([("a", ["x1", "y"]), ("b", ["y"]), ("c", [])], "id string, members array<string>")
    some = lambda **o: {r.id for r in nodes.where(L.has_prefix(F.col("members"), ["x", "z"], **o)).collect()}
    assert some() == {"a"} and some(exclusive=True) == set()
    items = spark.createDataFrame([("neo4j", "N1", None, "heart", None, 1), ("neo4j", "n1", None, "heart", "pump", 2), ("db", None, "7", "heartbeat", None, 3)], "source string, iri string, id string, name string, summary string, seq int").withColumns({"uri": F.lit(None).cast("string"), "kg": F.lit(None).cast("string")})
    assert [(r.name, r.summary, r.score) for r in L.merged_items(items, "heart", 5).collect()] == [("heart", "pump", 11.0), ("heartbeat", None, 6.0)]
    assert {r.term: r.n for r in L.hits(spark.createDataFrame([("Big red dog, RED dog",), ("red",)], "text string"), spark.createDataFrame([("red",), ("Red Dog",), ("dogs",)], "term string")).collect()} == {"red": 2, "Red Dog": 1, "dogs": 0}
    assert {r.id: r.n for r in L.sampled(spark.range(50), 5).withColumn("n", F.lit(1)).collect()} == {r.id: 1 for r in L.sampled(spark.range(50).repartition(7), 5).collect()}


def test_noise(spark):
    rows = [(str(i), f"name {i}", [f"label {i} of many words", "second"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, name string, labels array<string>")
    quiet = E.noised_ontology(df, noise=E.Noise(record=0.0, swap=0.0))
    assert {(r.id, r.name, tuple(r.labels)) for r in quiet.collect()} == {(i, n, tuple(x)) for i, n, x in rows}
    loud = E.Noise(record=1.0, value=1.0, delete=0.5, swap=0.3)
    out = {r.id: r for r in E.noised_ontology(df, noise=loud).collect()}
    again = {r.id: r for r in E.noised_ontology(df.repartition(7), noise=loud).collect()}
    assert out == again and len(out) == 400
    swapped = {i: r.swapped_with for i, r in out.items() if r.swapped_with}
    assert swapped and all(swapped[j] == i for i, j in swapped.items()) and sum(bool(r.changed) for r in out.values()) > 380
    rng = random.Random(1)
    assert E.Noise(ocr=1.0, delete=0, insert=0, substitute=0, transpose=0, split=0, merge=0, case=0, blank=0, sound=0).text("   ", rng) == "   "


def test_centralities():
    path = np.zeros((4, 4))
    for a, b in ((0, 1), (1, 2), (2, 3)):
        path[a, b] = path[b, a] = 1.0
    degree, closeness, between, rank, harmonic, laplacian = E.graph_means(path)
    assert abs(degree - 0.5) < 1e-12 and abs(closeness - (2 * 0.5 + 2 * 0.75) / 4) < 1e-12 and abs(between - (0 + 2 / 3 + 2 / 3 + 0) / 4) < 1e-12
    assert abs(rank - 0.25) < 1e-9 and abs(harmonic - (2 * (1 + 1 / 2 + 1 / 3) + 2 * 2.5) / 3 / 4) < 1e-12
    # energy: squares of degrees and of weights; without an end 10 of 16 is left, without an inner node 4
    assert abs(laplacian - (2 * 6 / 16 + 2 * 12 / 16) / 4) < 1e-12


def test_optimizer(spark):
    nodes = [f"n{i}" for i in range(7)]
    links = [("n0", "n1"), ("n0", "n2"), ("n1", "n3"), ("n2", "n3"), ("n3", "n4"), ("n5", "n6")]
    ids, edges = spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(links, "src string, tgt string")
    found = {r.id: (r.rank, r.n_above, r.n_below, r.score) for r in Z.profiles(ids, edges).collect()}
    assert found["n3"] == (2, 3, 1, 6) and found["n0"] == (0, 0, 4, 12) and found["n6"] == (1, 1, 0, 0)
    left = {r.id for r in Z.candidates_left(ids, edges, spark.createDataFrame([("n3", True), ("n5", False)], "id string, yes boolean")).collect()}
    assert left == {"n3", "n4"}
    clusters = spark.createDataFrame([(n, "a" if n in ("n0", "n1", "n2") else "b") for n in nodes], "id string, cluster string")
    assert len(Z.chosen_queries(ids, edges, clusters, 3)) == 3
    far = {r.target: r.left for r in Z.expected_left(G.closure(edges), ids, ["n3"], ids).collect()}
    assert far["n4"] == 7 - 3 and far["n5"] == 7 - 2


def test_walks_follow_the_weights(spark):
    """Second steps on a small graph against the chances worked out by hand, with weights of several magnitudes."""
    graph = {("a", "b"): 1.0, ("b", "c"): 5.0, ("a", "c"): 2.0, ("b", "d"): 0.3, ("c", "e"): 1.0, ("b", "e"): 12.0, ("d", "d"): 1.0}
    side = {}
    for (x, y), w in graph.items():
        side.setdefault(x, {})[y] = side.setdefault(y, {})[x] = w
    edges = spark.createDataFrame([(x, y, w) for (x, y), w in graph.items()], "src string, tgt string, weight double")
    for p, q in ((0.5, 2.0), (4.0, 0.25), (1.0, 1.0)):
        paths = [r.path for r in E.walks(edges, 3, 6000, p=p, q=q).collect()]
        assert len(paths) == 6000 * len(side)
        ones, twos = {}, {}
        for u, v, x in paths:
            ones.setdefault(u, []).append(v)
            twos.setdefault((u, v), []).append(x)
        for u, got in ones.items():
            assert all(abs(got.count(v) / len(got) - w / sum(side[u].values())) < 0.035 for v, w in side[u].items())
        for (u, v), got in twos.items():
            chance = {x: w * (1 / p if x == u else 1.0 if x in side[u] else 1 / q) for x, w in side[v].items()}
            assert set(got) <= set(chance)
            assert all(abs(got.count(x) / len(got) - w / sum(chance.values())) < 2.5 / len(got) ** 0.5 for x, w in chance.items())
    with pytest.raises(ValueError):
        E.walks(edges, 3, 1, p=0.0)


def test_walks_do_not_list_neighbours(spark, monkeypatch):
    """Around hubs, no table that is cut has more than a few rows for each walk and edge."""
    sizes, real = [], E.cut

    def counted(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(E, "cut", counted)
    edges = spark.range(3000).selectExpr("concat('n', id) AS src", "concat('hub', id % 2) AS tgt")
    made, seen = [], type(edges).join

    def joined(self, other, *more, **named):
        out = seen(self, other, *more, **named)
        made.append(out)
        return out

    monkeypatch.setattr(type(edges), "join", joined)
    found = E.walks(edges, 4, 2, p=0.5, q=2.0).collect()
    assert len(found) == 2 * 3002 and all(len(r.path) == 4 for r in found)
    assert max(sizes) <= 2 * 3002 and max(df.count() for df in made) <= 8 * 2 * 3002


def test_node_vectors_of_a_hub(spark, monkeypatch):
    """Every node has a vector, and no join lists a hub's neighbours for each walk."""
    edges = spark.range(400).selectExpr("concat('n', id) AS src", "'hub' AS tgt")
    made, seen = [], type(edges).join

    def joined(self, *more, **named):
        made.append(seen(self, *more, **named))
        return made[-1]

    monkeypatch.setattr(type(edges), "join", joined)
    found = {r.id: r.vector for r in E.node_vectors(edges, 4, 3, 2).collect()}
    assert set(found) == {"hub", *(f"n{i}" for i in range(400))} and all(len(v) == 4 for v in found.values())
    assert made and max(df.count() for df in made) <= 8 * 2 * 401


def test_even_walks_and_their_vectors(spark, monkeypatch):
    """Without weights and bias no table is cut for a step; steps have equal chances; training is dealt over tasks."""
    cuts, fitted, real, made = [], [], E.cut, E.Word2Vec
    monkeypatch.setattr(E, "cut", lambda df, name: cuts.append(name) or real(df, name))
    monkeypatch.setattr(E, "Word2Vec", lambda **named: fitted.append(named["numPartitions"]) or made(**named))
    monkeypatch.setattr(E, "WORDS", 5000, raising=False)
    pairs = [(f"n{i}", "hub") for i in range(30)] + [("n0", "n1"), ("n2", "n2"), ("hub", "n3")]
    edges = spark.createDataFrame(pairs, "src string, tgt string")
    side = {}
    for a, b in pairs:
        side.setdefault(a, set()).add(b)
        side.setdefault(b, set()).add(a)
    paths = [r.path for r in E.walks(edges, 7, 300).collect()]
    assert len(paths) == 300 * 31 and all(len(p) == 7 and all(b in side[a] for a, b in itertools.pairwise(p)) for p in paths)
    left = [b for p in paths for a, b in itertools.pairwise(p) if a == "hub"]
    assert set(left) == side["hub"] and all(abs(left.count(x) / len(left) - 1 / 30) < 0.01 for x in side["hub"])
    assert len(cuts) < 6
    found = {r.id: r.vector for r in E.node_vectors(edges, 4, 7, 100).collect()}
    assert set(found) == set(side) and all(len(v) == 4 and np.isfinite(v).all() for v in found.values())
    assert fitted == [1 + 31 * 7 * 100 // 5000]


def test_registry(spark):
    r = registry.Registry("thing")
    r.register("A", lambda x: x + 1, about="one")
    assert r.create("a", 1) == 2 and "A" in r and list(r) == ["a"] and r.about("a") == {"about": "one"}
    with pytest.raises(ValueError):
        r.register("a", len)
    with pytest.raises(ValueError):
        r.get("b")
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "a int, b int")
    assert [(x.passed, x.offending, x.checked) for x in registry.checked(df).collect()] == [(False, 1, 3)]
    assert registry.Matching(df, df.limit(1), ("cosine",), ("table",), 0.5).threshold == 0.5
    with pytest.raises(ValueError):
        registry.Matching(df, df, ("cosine",), ("table",), 0.5)
    with pytest.raises(ValueError):
        registry.Suite.read({"experiments": [{"name": "a"}, {"name": "a"}]})


def test_refine_without_known_relations(spark):
    out = refine.refine(spark.createDataFrame([("a", "likes", "b")], "s string, p string, o string"))
    assert out.triples.count() == 1


def test_matched_answers(spark):
    from weft.operators import answers as A

    rng = random.Random(31)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    stored = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))) for i in range(40)]
    asked = []
    for i, t in stored:
        w = t.split()[: rng.randint(6, 20)]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at] = w[at][:-1]
        asked.append((i, " ".join(w)))
    index = lambda rows, key: A.indexed(spark.createDataFrame(rows, f"{key} int, text string"), key)
    found = {r.q: (r.a, round(r.score, 9)) for r in A.matched(index(asked, "q"), index(stored, "a")).collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    def fixed(q, a):
        gone = [w for w in q if w not in a]
        near = [x for x in set(a) if len(gone) == 1 and (x[:-1] == gone[0] or x == gone[0][:-1] or (len(x) == len(gone[0]) and sum(c != d for c, d in zip(x, gone[0], strict=True)) == 1))]
        return [near[0] if w == gone[0] else w for w in q] if len(gone) == 1 and len(near) == 1 and len(gone[0]) >= 5 else q

    def best(scores):
        ranked = sorted(scores, key=lambda x: (-x[0], x[1]))
        return (ranked[0][1], round(ranked[0][0], 9)) if ranked[0][0] >= T.OVERLAP and ranked[0][0] - ranked[1][0] >= T.MARGIN else None

    want = {}
    for q, text in asked:
        w = text.split()
        if len(grams(w)) < T.SHINGLES:
            continue
        share = lambda x, t: len(grams(x) & grams(t)) / len(grams(x))
        hit = best([(share(w, t.split()), a) for a, t in stored]) or best([(share(fixed(w, t.split()), t.split()), a) for a, t in stored])
        if hit:
            want[q] = hit
    assert found == want and len(want) > 30


def test_matched_answers_pass_over_common_shingles(spark, monkeypatch):
    """A line that every text has brings no two of them together; copies still do."""
    from weft.operators import answers as A

    sizes, real = {}, A.cut

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(A, "cut", counted)
    texts = [(i, "share this common line with everyone " + " ".join(f"own{i}word{k}" for k in range(25))) for i in range(60)]
    rows = A.indexed(spark.createDataFrame([*texts, (60, texts[3][1]), (61, texts[4][1].replace("own4word20", "own4other"))], "id int, text string"))
    found = {r.q: (r.a, r.score) for r in A.matched(rows.withColumnRenamed("id", "q"), rows.withColumnRenamed("id", "a")).collect()}
    assert found == {i: (i, 1.0) for i in range(60) if i not in (3, 4)}
    assert sizes["pairs" if "pairs" in sizes else "scores"] <= 62 + 2 + 2


def test_matched_answers_take_copies_as_one_and_shingles_packed(spark, monkeypatch):
    """What lies between is rows of packed shingles and pairs of different texts, not a row for each shingle or pair of copies."""
    from weft.operators import answers as A

    sizes, real = {}, A.cut

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(A, "cut", counted)
    said = lambda i: " ".join(f"own{i}word{k}" for k in range(200))
    stored = [*((i, said(0)) for i in range(40)), *((-i, said(i)) for i in range(1, 30)), (50, None), (51, ""), (None, said(1))]
    asked = [*((i, said(0)) for i in range(40)), (90, said(7).upper() + "?"), (91, said(7)), (92, said(8).replace("own8word9 ", "own8wordx9 ")), (93, said(99)), (94, None), (95, "too short"), (None, said(2))]
    rows = lambda given, key: A.indexed(spark.createDataFrame(given, f"{key} int, text string"), key)
    found = {r.q: (r.a, round(r.score, 3)) for r in A.matched(rows(asked, "q"), rows(stored, "a")).collect()}
    assert found == {90: (-7, 1.0), 91: (-7, 1.0), 92: (-8, 0.985)}
    assert sizes["pairs"] <= 4 and sizes["known"] < 2200
    assert A.matched(rows(asked[40:], "q"), rows([], "a")).collect() == [] == A.matched(rows([], "q"), rows(stored, "a")).collect()
