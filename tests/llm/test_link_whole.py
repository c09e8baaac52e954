"""No candidate is left out: partners that share a frequent word only, and those of weak edges."""

from test_link_blocks import SCHEMA

from wayline.llm import linkage
from wayline.llm.linkage import link


def test_records_that_share_nothing_but_a_frequent_word(spark, monkeypatch):
    df = lambda side: spark.createDataFrame([(f"{side}{i}", ["Zemphyr"], [], [], [], None, []) for i in range(30)], f"id string, {SCHEMA}")
    whole = sorted(map(tuple, link(df("a"), df("b")).collect()))
    assert [r[:2] for r in whole] == sorted((f"a{i}", "b0") for i in range(30))
    monkeypatch.setattr(linkage, "BUDGET", 4)
    assert sorted(map(tuple, link(df("a"), df("b")).collect())) == whole


def test_a_weak_edge_to_the_only_partner(spark):
    # a0 and b0, a1 and b1 share many words but nothing else; a0 and b1 only one word, but region, place and year
    many = ["Bravello Cinderox Dalmorin Estriva Fenwolda", "Gastovel Hibernox Ivoltane Jasperin Kelmonda"]
    here, there, far = (["R1"], [], ["xanthia"], 1900, []), (["R2"], [], ["molvania"], 1800, []), (["R3"], [], ["ruritan"], 1700, [])
    a = [("a0", [many[0], "Quorvex"], *here), ("a1", [many[1]], *far)]
    b = [("b0", [many[0]], *there), ("b1", [many[1], "Quorvex"], *here)]
    df = lambda rows: spark.createDataFrame(rows, f"id string, {SCHEMA}")
    assert [(r.a, r.b) for r in link(df(a), df(b)).collect()] == [("a0", "b1")]
