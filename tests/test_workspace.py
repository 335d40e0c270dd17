"""The workspace on a small ontology."""

from pyspark.sql import functions as F

from weft.__main__ import main
from weft.workspace import RunControl, Workspace

BODY = """@prefix e: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
e:heart a owl:Class ; rdfs:label "heart" ; rdfs:comment "a muscle that pumps blood" ; rdfs:subClassOf e:organ , e:thing .
e:lung a owl:Class ; rdfs:label "lung" ; rdfs:comment "takes air" ; rdfs:subClassOf e:organ .
e:organ rdfs:label "organ" ; rdfs:subClassOf e:thing . e:thing rdfs:label "anything" .
[] a owl:Restriction ; owl:onProperty e:partOf ; owl:someValuesFrom e:organ .
"""


def test_workspace(spark, tmp_path):
    (tmp_path / "body.ttl").write_text(BODY)
    space = Workspace(spark, str(tmp_path / "body.ttl"))
    # heart below thing follows from the rest, so it is reduced away
    assert {(r.s, r.o) for r in space.triples.collect()} == {("http://e/heart", "http://e/organ"), ("http://e/lung", "http://e/organ"), ("http://e/organ", "http://e/thing")}
    assert tuple(space.summary().first()) == (4, 1, 3)
    best = space.search(["pumps blood muscle"], 2).collect()
    assert best[0].id == "http://e/heart" and best[0].name == "heart"
    assert space.search(["lung"], 5, ["http://other/"]).count() == 0
    near = {(r.id, r.source) for r in space.context("takes air", 1, hops=1).collect()}
    assert near == {("http://e/lung", "concept"), ("http://e/organ", "neighborhood")}
    hot = spark.createDataFrame([("what is a heart", "a pump")], "key string, answer string")
    told = {r.question: r for r in space.ask(spark.createDataFrame([("What is a  heart?",), ("What takes air?",)], "question string"), [("hot", hot)]).collect()}
    assert (told["What is a  heart?"].answer, told["What is a  heart?"].source, told["What is a  heart?"].prompt) == ("a pump", "hot", None)
    assert "- lung | takes air" in told["What takes air?"].prompt and told["What takes air?"].answer is None
    gold = space.texts.select(F.col("id").alias("l"), F.col("id").alias("r"))
    assert space.evaluate(Workspace(spark, str(tmp_path / "body.ttl")), gold).first().f1 == 1.0
    with RunControl(spark, "look") as run:
        assert run.stage("read", 1, 2) == "read: 1/2" and "look" in spark.getTags()
    assert "look" not in spark.getTags()


def test_shell(spark, tmp_path):
    (tmp_path / "body.ttl").write_text(BODY)
    path = str(tmp_path / "body.ttl")
    assert "4" in main(["inspect", path], spark) and "http://e/lung" in main(["search", path, "air", "--k", "1"], spark)
    assert "some" in main(["expressions", path], spark)
