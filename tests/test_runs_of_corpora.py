"""Language, gates, layouts, abstractors and whole runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus.functions import embedders, sentences
from conspectus.operators import basis, corpus_run, gates, generators, graph, language, markers, selection, summarise
from conspectus.sources import documents

DOC = {
    "sections": [{"id": "s1", "title": "One"}, {"id": "s2", "title": "Two"}],
    "blocks": [
        {"id": "b1", "section_id": "s1", "text": "The Graph Index is here. The Graph Index of Ada Byron is fast. GNN GNN GNN."},
        {"id": "b2", "section_id": "s2", "text": "A Graph Index again and a GNN; ada byron and Ada Byron."},
    ],
    "bibliography": [{"title": "A very long title of a paper: with many more words than anyone could want to read at once"}],
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "a.json").write_text(json.dumps(DOC))
    return documents.load(spark, str(path))


def tagger():
    def tag(text):  # a closure travels to the workers by value
        words = text.replace(".", " .").replace(";", " ;").split()
        tokens = [(w, "PROPN" if w[0].isupper() else "ADJ" if w == "fast" else "X") for w in words]
        return tokens, [("Ada Byron", "person")] * text.count("Ada Byron") + [("GNN", "org")] * text.count("GNN")

    return tag


def test_chunks():
    assert language.chunks_from_pos([("big", "ADJ"), ("graph", "NOUN"), ("fast", "ADJ"), ("is", "VERB"), ("old", "ADJ"), ("x", "NOUN")]) == ["big graph", "old x"]
    assert language.chunks_from_pos([(c, "NOUN") for c in "abcdefg"]) == ["c d e f g"] and language.chunks_from_pos([("red", "ADJ")]) == []


def test_phrases_know_their_sections(corpus):
    got = {r.name: r for r in generators.phrases(corpus, least=2).collect()}
    assert got["Graph Index"].metadata["section_df"] == "2" and got["GNN"].frequency == 4 and got["Graph Index"].section_id is None
    one = {r.name: r for r in generators.phrases(corpus, least=2, tagger=tagger()).collect()}
    assert "Ada Byron" not in one and one["Graph Index"].frequency == 3 and one["Graph Index"].metadata["nlp_backend"] == "injected"
    found = {(r.name, r.kind) for r in generators.entities(corpus, tagger=tagger()).collect()}
    assert found == {("GNN", "entity_org")} and {(r.name, r.kind) for r in generators.entities(corpus, least=1, tagger=tagger(), labels=("PERSON",)).collect()} == {("Ada Byron", "entity_person")}


def test_abstractors(spark, corpus):
    with pytest.raises(ValueError):
        generators.get_abstractor("model")

    def call(prompt):
        if "Formula" in prompt:
            raise TimeoutError
        return ' "short  name" '

    mine = generators.model_abstractor(call)
    rows = spark.createDataFrame([(r"\sum_i x = 1", "one two three four five six seven eight nine ten"), ("", "brief")], "f string, t string")
    got = rows.select(mine["describe"](F.col("f"), F.lit("")).alias("d"), mine["shorten"](F.col("t"), 8).alias("s")).collect()
    assert [(r.d, r.s) for r in got] == [("summation over norm and equality", "short name"), ("", "brief")]
    assert [r.name for r in generators.bibliography(corpus, shorten=mine["shorten"]).collect()] == ["short name"]
    assert generators.get_abstractor()["shorten"] is generators.shorten_title


def test_suspect_characters(spark):
    assert sentences.suspects("a b​–é ") == ["U+00A0 NO-BREAK SPACE", "U+200B ZERO WIDTH SPACE", "U+2013 EN DASH"]
    (r,) = sentences.sanitised_fields(spark.createDataFrame([("a–b", "plain", None)], "x string, y string, z string"), "x", "y", "z").collect()
    assert (r.x, r.y, r.z, r.warnings) == ("a-b", "plain", "", ["x: normalised U+2013 EN DASH"])


def test_layouts(spark):
    rows = spark.createDataFrame([(f"s{i}", [float(i), float(i * i)], "v", f"t{i}") for i in range(5)], "sentence_id string, ces array<double>, basis_version string, text string").withColumn("hits", F.array(F.struct(F.lit("c").alias("label"))))
    got = selection.layout_projections(rows, 2).collect()
    assert len(got) == 5 and {r.group for r in got} == {"c"} and {r.backend for r in got} == {"pca"} and "pca" in selection.available_backends()
    assert {r.backend for r in selection.layout(rows, "sentence_id", "ces", 2, "umap").collect()} == {"pca"}
    selection.register_backend("flat", lambda df, i, v, d: df.select(i, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    try:
        assert {r.backend for r in selection.layout(rows, "sentence_id", "ces", 2, "auto").collect()} == {"flat"}
    finally:
        del selection.BACKENDS["flat"]
    with pytest.raises(ValueError):
        selection.layout_projections(rows.withColumn("basis_version", F.col("sentence_id")), 2)


def test_graph_accessors(spark):
    edges = spark.createDataFrame([("p", "b", 0), ("p", "a", 1), ("q", "a", 0)], "parent string, child string, ord int")
    names = lambda df: [r[0] for r in df.collect()]
    assert names(graph.children_of(edges, "p")) == ["b", "a"] and names(graph.siblings(edges, "p", "b")) == ["a"] and set(names(graph.parents_of(edges, "a"))) == {"p", "q"}
    assert names(graph.top_level(spark.createDataFrame([("x", 2), ("y", 3)], "node string, depth int"))) == ["x"]
    ranked = {r.parent: r.children for r in graph.children_ranked(edges).collect()}
    assert ranked == {"p": ["b", "a"], "q": ["a"]}


OBJECTS = [
    {"id": "s1", "type": "Section", "props": {"title": "Graph Search", "level": 1, "flow_index": 1}},
    {"id": "p1", "type": "Paragraph", "props": {"text": "Graph search walks over nodes. It ends at the goal.", "flow_index": 2}},
    {"id": "s2", "type": "Section", "props": {"title": "References", "level": 1, "flow_index": 3}},
    {"id": "p2", "type": "Paragraph", "props": {"text": "Many works are named here by us.", "flow_index": 4}},
    {"id": "s3", "type": "Section", "props": {"title": "Empty", "level": 1, "flow_index": 5}},
]


def test_a_whole_run(spark):
    files = spark.createDataFrame([(d, json.dumps({"objects": OBJECTS})) for d in ("d1", "d2")], "doc_id string, json string")
    tree = markers.build_tree(files)
    e = embedders.get_embedder("hash", 32)
    made = corpus_run.run(tree, summarise.make_summariser("title-only"), e, 0.9)
    records = {(r.doc_id, r.span_id): r for r in made.records.collect()}
    assert len(records) == 6 and records[("d1", "s3")].concepts == []
    first, second, aside = (records[k].concepts[0] for k in (("d1", "s1"), ("d2", "s1"), ("d1", "s2")))
    assert (first.merge_decision, second.merge_decision) == ("added", "merged") and first.row_id_assigned == second.row_id_assigned and second.merge_cosine == 1.0
    assert aside.row_id_assigned == basis.SINK and aside.merge_decision is None and records[("d1", "s2")].structural_class == "bibliography"
    rows = {r.row_id: r for r in made.basis.collect()}
    assert len(rows) == 2 and rows[first.row_id_assigned].support == 2 and rows[basis.SINK].support == 2
    expected = tree.markers.select("doc_id", F.col("marker_id").alias("span_id"))
    labels = expected.withColumn("structural", F.col("span_id") == "s2")
    verdict = gates.run_gates(made.records, expected, labels, ablation=True)
    assert all(g["passed"] for g in verdict.values()) and verdict["structural"]["tp"] == 2 and verdict["basis_text"]["checked"] == 4
    text = {r.doc_id: r.markdown for r in gates.concept_report(made.records).collect()}
    assert text["d1"].startswith("## Graph Search\n- Graph Search")


def test_gates_find_what_is_wrong(spark):
    flat = spark.createDataFrame([("d", "s", "Title", "a b c", "a b c d", "", r"1. \x"), ("d", "t", "T", None, None, None, None)], "doc_id string, span_id string, title_raw string, tier_label string, tier_abstraction string, tier_summary string, basis_text string")
    assert gates.schema_of(flat) == "flat"
    text = gates.gate_basis_text(flat).first()
    assert (text.concepts, text.checked, text.violations, text.passed) == (2, 1, 3, False) and text.clean_fraction == 0
    tiers = gates.gate_tiers(flat).first()
    assert (tiers.prefix_relations, tiers.overlaps, tiers.comparable, tiers.label_under, tiers.passed) == (1, 1, 1, 1, False)
    assert gates.report("tiers", gates.gate_tiers(flat)).startswith("tiers: FAIL\n  concepts: 2")
    assert np.isfinite(text.clean_fraction)
