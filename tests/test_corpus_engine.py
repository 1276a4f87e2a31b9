"""Trees, sentences, summaries, spaces, facade, questions and sidecars on small hand-made documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus import cli, facade
from conspectus.functions import embedders, routing
from conspectus.operators import basis, generators, markers, query_engine, scoring, sentence_rows, space, summaries, summarise
from conspectus.plans import texts
from conspectus.sources import documents, sidecars

OBJECTS = [
    {"id": "p0", "type": "Paragraph", "props": {"text": "A preamble that stands before all sections of the document.", "flow_index": 0}},
    {"id": "s1", "type": "Section", "props": {"caption": r"Graph \emph{Search}", "level": 1, "flow_index": 1}},
    {"id": "p1", "type": "Paragraph", "props": {"text": "We look at {{doc_FO0001||FO}} first. Then comes the rest of it all.", "flow_index": 2, "parent_section": "s1"}},
    {"id": "f1", "type": "Formula", "props": {"latex": r"a + b", "spoken": "a plus b", "flow_index": 2}},
    {"id": "s2", "type": "Heading", "props": {"title": "Index Trees", "level": "2", "flow_index": 3}},
    {"id": "e1", "type": "Equation", "props": {"spoken": "x equals y", "flow_index": 4}},
    {"id": "p2", "type": "Paragraph", "props": {"text": "Trees are searched from the root. [1] Aa bb [2] Bb cc [3] Cc dd", "flow_index": 5, "parent_section": "s1"}},
    {"id": "t1", "type": "Table", "props": {"text": "1 2"}},
    {"id": "u1", "type": "Picture", "props": {"caption": "https://x.org/a.png"}},
    {"id": "x1", "type": "Widget", "props": {"text": "?"}},
    {"id": "p3", "type": "Paragraph", "props": {"text": r"\noindent \vspace{3}"}},
    {"id": "p4", "type": "Footnote", "props": {"text": "not read here"}},
    {"id": "e2", "type": "Equation", "props": {"flow_index": 6}},
    {"id": "s3", "type": "Section", "props": {"title": "Appendix", "level": 1, "is_appendix": True, "flow_index": 20}},
]


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([("d1", json.dumps({"objects": OBJECTS})), ("d2", json.dumps({"objects": OBJECTS[1:3]})), ("d3", "{}")], "doc_id string, json string")
    return markers.build_tree(files)


def test_markers(built):
    rows = {r.marker_id: r for r in built.markers.where("doc_id = 'd1'").collect()}
    assert {k: (r.title, r.level, r.flow_index, r.is_appendix, r.parent) for k, r in rows.items()} == {
        "s1": ("Graph Search", 1, 1, False, None), "s2": ("Index Trees", 2, 3, False, "s1"), "s3": ("Appendix", 1, 20, True, None),
    }
    assert [r.marker_id for r in built.document_order().where("doc_id = 'd1'").orderBy("place").collect()] == ["s1", "s2", "s3"]
    assert [r.marker_id for r in built.by_level(2).collect()] == ["s2"]


def test_units_and_reasons(built):
    units = {r.unit_id: r for r in built.units.where("doc_id = 'd1'").collect()}
    assert units["p1"].text == "We look at a plus b first. Then comes the rest of it all." and units["p1"].marker_id == "s1"
    assert (units["p2"].text, units["p2"].marker_id, units["p2"].moved) == ("Trees are searched from the root.", "s2", True)
    assert units["e1"].text == "x equals y" and units["e1"].marker_id == "s2" and units["p0"].marker_id is None
    assert set(units) == {"p0", "p1", "p2", "e1"}
    reasons = {r.object_id: r.reason for r in built.skipped.where("doc_id = 'd1'").collect()}
    assert reasons["u1"] == "caption is only a URL" and reasons["x1"] == "unhandled object type 'widget'" and reasons["p4"] == "no text under content"
    assert reasons["f1"].startswith("inlined") and reasons["e2"] == "math object rendered to no prose" and reasons["p3"] == "text is only LaTeX markup" and reasons["t1"].startswith("tabular")
    (facts,) = built.accounting().where("doc_id = 'd1'").collect()
    assert (facts.objects, facts.unaccounted, facts.double_counted) == (14, [], [])


def test_tree_walks(built):
    depth = {(r.doc_id, r.marker_id): r.depth for r in built.depth().collect()}
    assert depth == {("d1", "s1"): 0, ("d1", "s2"): 1, ("d1", "s3"): 0, ("d2", "s1"): 0}
    text = {r.marker_id: r.text for r in built.subtree_text().where("doc_id = 'd1'").collect()}
    body = {r.marker_id: r.text for r in built.body_text().where("doc_id = 'd1'").collect()}
    assert body["s2"] == "x equals y\n\nTrees are searched from the root." and text["s1"] == body["s1"] + "\n\n" + body["s2"] and text["s3"] == ""
    assert {r.marker_id: r.children for r in built.children().where("doc_id = 'd1'").collect()} == {"s1": ["s2"], "s2": [], "s3": []}
    (s,) = built.stats().where("doc_id = 'd1'").collect()
    assert (s.markers, s.roots, s.appendix_markers, s.paragraphs, s.orphans, s.moved) == (3, 2, 1, 3, 1, 1)
    (residue,) = markers.math_residue(built.objects.where("doc_id = 'd1'")).collect()
    assert residue.math_objects == 3 and residue.spoken_macro_leak == 0


def test_reference_tails(spark):
    entries = [f"[{i}] Author {i} of a title" for i in range(4)]
    texts = ["no list", "Prose. " + " ".join(entries), " ".join(entries[:2]), "[9] Xx " + "y" * 700 + " " + " ".join(entries)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(markers.reference_tail("t")).collect()]
    assert got == [7, 7, len(texts[2]), texts[3].index("[0]")]


def test_sentences_from_trees(built):
    rows = sentence_rows.sentences_from_tree(built).where("doc_id = 'd1'")
    got = [(r.sentence_id, r.span_id) for r in rows.orderBy("flow_index", "source_id", "ordinal").collect()]
    assert got == [("p0#s0", None), ("p1#s0", "s1"), ("p1#s1", "s1"), ("p2#s0", "s2")]
    assert [r.span_id for r in sentence_rows.sentences_from_tree(built, (2,)).collect()] == ["s2"]
    assert sentence_rows.sentences_from_tree(built, include_orphans=False).where("doc_id = 'd1'").count() == 3
    (s,) = sentence_rows.sentence_stats(rows).collect()
    assert (s.sentences, s.sources, s.spans, s.orphaned) == (4, 3, 2, 1)


def test_sentence_stats_count_sentences_at_the_least_length(spark, tmp_path):
    """The second sentence has 20 characters with its first digit."""
    spark.createDataFrame([(1, "A sentence that is long enough. 1 is a shorter claim")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = texts.sentence_stats(spark, str(tmp_path)).collect()
    assert (r.sentences, r.words_min, r.words_max) == (2, 5, 6)


def test_summaries(spark, built, tmp_path):
    run = summarise.summarise_tree(built, summarise.make_summariser("extractive"))
    rows = {(r.doc_id, r.span_id): r for r in run.summaries.collect()}
    assert rows[("d1", "s1")].summary.startswith("We look at a plus b") and rows[("d1", "s1")].label.startswith("Graph Search. We look")
    (s,) = run.stats().collect()
    assert (s.spans, s.usable, s.cached, s.generated, s.empty) == (3, 3, 0, 3, 1)
    cache = summarise.SummaryCache(spark, str(tmp_path / "cache"))
    assert cache.load().count() == 0
    cache.put(run.fresh)
    (again,) = summarise.summarise_tree(built, summarise.make_summariser("extractive"), cache.load()).stats().collect()
    assert (again.cached, again.generated) == (3, 0)
    titles = summarise.summarise_tree(built, summarise.make_summariser("title-only"), levels=(2,)).summaries.collect()
    assert [(r.label, r.summary) for r in titles] == [("Index Trees", "")]

    def chat(prompt):
        if "Index" in prompt:
            raise TimeoutError("slow")
        return {"label": "a label", "summary": "a summary"}

    said = summarise.summarise_tree(built, summarise.Summariser("chat", summarise.injected(chat), False)).summaries.collect()
    assert {(r.span_id, r.label, r.usable, tuple(r.warnings)) for r in said if r.doc_id == "d1"} == {("s1", "a label", True, ()), ("s2", "", False, ("TimeoutError: slow",))}
    with pytest.raises(ValueError):
        summarise.make_summariser("extractive", measuring=True)
    checked = summarise.check_tiers(spark.createDataFrame([("a b c", "a b c d", "")], "label string, abstraction string, summary string"))
    assert checked.first().problems == ["label/abstraction prefix", "label/abstraction overlap"]
    with pytest.raises(Exception, match="depend"):
        summarise.assert_tiers(checked.drop("problems")).collect()


def test_prompts():
    assert summarise.bands_for(50) == {"summary": (28, 34), "abstraction": (24, 30), "label": (22, 28)}
    assert summarise.render_prompt("{ceiling} tokens, {ceiling_words} words, {label} or {label_low}") == "50 tokens, 35 words, 22-28 or 22"


def test_routing(spark):
    rows = spark.createDataFrame([("Paragraph",), ("equation",), ("paragraph",), ("code",), ("odd",)], "type string")
    assert {(r.model, tuple(r.types), r.n) for r in routing.group_by_model(rows).collect()} == {("sentencebert", ("odd", "paragraph"), 3), ("mathbert", ("equation",), 1), ("codebert", ("code",), 1)}
    assert {r.model for r in routing.group_by_model(rows, override="mine").collect()} == {"mine"}
    assert routing.routing_table(spark).where("dormant").count() == 4


def test_embedders(spark):
    assert embedders.resolve_name("SBERT") == "sentencebert" and embedders.get_embedder("hashing").name == "hash"
    with pytest.raises(ValueError):
        embedders.get_embedder("nothing")
    embedders.register("lengths", lambda: embedders.from_function("lengths", "1", 2, lambda texts: np.array([[len(t), 0] for t in texts])))
    got = spark.createDataFrame([("abc",), ("",), (None,)], "t string").select(embedders.get_embedder("lengths").encode(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


DOCS = {
    "a": {
        "sections": [{"id": "s1", "title": "1. Graph Search", "level": 1}, {"id": "s2", "title": "1.1 Index Trees", "level": 2, "parent_id": "s1"}],
        "blocks": [
            {"id": "b1", "section_id": "s1", "text": "Graph search walks over the nodes of a graph."}, {"id": "b2", "section_id": "s2", "text": "Index trees hold the keys of a graph search."},
            {"id": "b3", "section_id": "s2", "text": " "}, {"id": "b4", "type": "code", "text": "x = 1"},
        ],
        "bibliography": [{"title": "Learning deep maps of text", "year": "2020", "citations": "99"}],
    },
    "b": {"sections": [{"id": "s1", "title": "Image Filters", "level": 1}], "blocks": [{"id": "b1", "section_id": "s1", "text": "Image filters change the pixels of an image."}]},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("atlas")
    for name, doc in DOCS.items():
        (path / f"{name}.json").write_text(json.dumps(doc))
    (path / "c.json").write_text(json.dumps({"objects": OBJECTS}))
    return path


@pytest.fixture(scope="module")
def atlas(spark, folder):
    return facade.Atlas.load(spark, str(folder), embedder=embedders.get_embedder("hash", 64), sources=("heading", "bibliography"))


def short(doc_id):
    return doc_id.rsplit("/", 1)[-1]


def test_spaces_are_built(atlas):
    rows = {(short(r.doc_id), r.name): r for r in atlas.space.concepts.collect()}
    own = {n for d, n in rows if d == "a.json"}
    assert {"Graph Search", "Index Trees", "Graph Search › Index Trees", "Learning deep maps of text"} == own
    trees, search = rows[("a.json", "Index Trees")], rows[("a.json", "Graph Search")]
    assert trees.parent_id == search.concept_id and trees.concept_id in search.children and search.parent_id is None
    paper = rows[("a.json", "Learning deep maps of text")]
    assert paper.metrics["citation_importance"] == 0.4  # log10(100) / 4 and an old year
    info = {short(r.doc_id): r for r in atlas.info().collect()}
    assert (info["a.json"].size, info["a.json"].blocks, info["a.json"].prose_blocks, info["a.json"].code_blocks, info["a.json"].sections) == (4, 4, 2, 1, 2)
    assert info["a.json"].sources == {"heading": 3, "bibliography": 1} and atlas.space.by_level("document").count() == len(rows)
    assert [short(r.doc_id) for r in atlas.space.index_of(paper.concept_id).collect()] == ["a.json"]
    positions = sorted(r.position for (d, _), r in rows.items() if d == "a.json")
    assert positions == [0, 1, 2, 3]


def test_scores_equal_a_plain_rendering(atlas):
    rows = [r for r in atlas.scored.collect() if short(r.doc_id) == "a.json"]
    blocks = [r for r in atlas.corpus.blocks.withColumn("v", atlas.embedder.encode(F.col("text"))).collect() if short(r.doc_id) == "a.json" and r.block_id in ("b1", "b2")]
    for r in rows:
        hits = [float(np.dot(r.vector, b.v)) > scoring.THETA for b in blocks]
        assert r.matches == sum(hits) and r.purity == 0  # both blocks lie under one top section
        assert r.metrics["coverage"] == pytest.approx(np.interp(sum(hits) / 2, [0.01, 0.2, 0.4, 0.9], [0.1, 1, 1, 0.3]), abs=1e-6)
        assert r.information_gain == 0.5 and r.score == pytest.approx(sum(scoring.WEIGHTS[k] * v for k, v in r.metrics.items()), abs=2e-6)


def test_projection_of_documents(atlas):
    rows, skipped = atlas.project_document(2)
    found = {(short(r.doc_id), r.object_id): r for r in rows.collect()}
    one = found[("a.json", "b2")]
    assert [h["rank"] for h in one.hits] == [1, 2] and one.top1 == one.hits[0]["similarity"] and one.projection_id.startswith("prj_")
    assert ("a.json", "b3") not in found and one.margin == pytest.approx(one.hits[0]["similarity"] - one.hits[1]["similarity"], abs=1e-6)
    reasons = {(short(r.doc_id), r.object_id): r.reason for r in skipped.collect()}
    assert reasons[("a.json", "b3")] == "no text to embed"
    only, left = atlas.project_document(2, ["code"])
    assert {short(r.doc_id) for r in only.collect()} == {"a.json"} and left.where("reason like 'type not%'").count() > 3


def test_texts_are_explained(spark, atlas):
    ids = {short(r.doc_id): r.doc_id for r in atlas.corpus.blocks.select("doc_id").distinct().collect()}
    texts = spark.createDataFrame([(ids["a.json"], 1, "a graph search of the index trees"), (ids["b.json"], 1, "filters of an image")], "doc_id string, text_id int, text string")
    best = {short(r.doc_id): r.name for r in atlas.explain_text(texts, 1).collect()}
    assert best["b.json"] == "Image Filters" and best["a.json"] in ("Graph Search", "Index Trees", "Graph Search › Index Trees")
    sims = {short(r.doc_id): r.similarities for r in atlas.project_text(texts).collect()}
    assert len(sims["a.json"]) == 4 and max(sims["a.json"]) == pytest.approx(atlas.explain_text(texts, 1).where("doc_id like '%a.json'").first().similarity)


def test_spaces_are_refined_from_the_pool(spark, folder):
    small = facade.Atlas.load(spark, str(folder / "a.json"), True, embedder=embedders.get_embedder("hash", 64), sources=("heading", "bibliography"), max_concepts=2)
    doc = small.corpus.blocks.select("doc_id").first()[0]
    grown = small.refine(spark.createDataFrame([(doc, "deep maps of a text")], "doc_id string, text string"), 3)
    last = grown.concepts.orderBy(F.desc("position")).first()
    assert grown.concepts.count() == 3 and last.position == 2
    assert last.metadata["added_by"] == "refine_space"


def test_static_levels_stand_in_front(spark, folder):
    words = spark.createDataFrame([("science",), ("art",)], "name string")
    a = facade.Atlas.load(spark, str(folder / "b.json"), True, sources=("heading",), static_levels=[("domain", words)])
    assert [(r.name, r.level) for r in a.space.concepts.orderBy("position").collect()] == [("art", "domain"), ("science", "domain"), ("Image Filters", "document")]


def test_requests(spark, folder, tmp_path):
    path = folder / "a.json"
    made = facade.request_concepts(spark, path, sources=("heading",))
    assert made["status"] == "completed" and {c["name"] for c in made["concepts"]} == {"Graph Search", "Index Trees", "Graph Search › Index Trees"}
    assert facade.request_embedding(spark, ["a b", ""])["count"] == 2
    assert facade.request_projection(spark, path, 1, "graph", sources=("heading",))["concepts"][0]["rank"] == 1
    assert facade.request_projection(spark, folder / "none.json")["error_type"] == "FileNotFoundError"
    out = tmp_path / "out.json"
    first = facade.request_storage(spark, path, out, sources=("heading",))
    second = facade.request_storage(spark, path, out, sources=("heading",))
    assert (first["status"], first["changed"], second["status"], second["changed"]) == ("completed", True, "updated", False)
    assert facade.request_verification(out)["matches"] is True
    out.write_text(out.read_text().replace("Graph Search", "Graph Hunt", 1))
    assert facade.request_verification(out)["matches"] is False and facade.request_verification(tmp_path / "no")["status"] == "failed"


def test_command_line(spark, folder, tmp_path, capsys):
    path = str(folder / "b.json")
    assert cli.main(["project", path, "-s", "heading", "-o", str(tmp_path / "s.json")], spark) == 0
    assert cli.main(["verify", str(tmp_path / "s.json")], spark) == 0
    assert cli.main(["concepts", path, "-s", "heading", "--json"], spark) == 0
    assert "Image Filters" in capsys.readouterr().out
    assert cli.main([path, "--text", "image", "-s", "heading"], spark) == 0 and "Image Filters" in capsys.readouterr().out
    assert cli.main(["routing"], spark) == 0 and cli.main(["verify", "nothing"], spark) == 2
    assert cli.parse_weights(["purity=0.5"]) == {"purity": 0.5}
    for wrong in ("purity", "odd=1", "purity=x"):
        with pytest.raises(SystemExit):
            cli.parse_weights([wrong])


def test_questions(spark):
    e = embedders.get_embedder("hash", 64)
    given = spark.createDataFrame([(1, "graph search", "d1"), (1, "image filter", "d2"), (2, "index tree", "d1")], "level int, label string, document string").withColumn("vector", e.encode(F.col("label")))
    rows = basis.fold(given)
    texts = spark.createDataFrame([("d1", "t1", "a graph search is run"), ("d2", "t2", "the image filter is run"), ("d2", "t3", "")], "doc_id string, sentence_id string, text string")
    index = sentence_rows.project_sentences(texts, rows, e.encode, e.name, e.revision, 2, True)
    stored = {r.sentence_id: r for r in index.collect()}
    assert stored["t1"].hits[0]["label"] == "graph search" and len(stored["t1"].ces) == 3 and sentence_rows is not None
    assert {r.basis_version for r in stored.values()} == {basis.version(rows).first().basis_version}
    engine = query_engine.QueryEngine(rows, e, index.select("sentence_id", "text", F.col("doc_id").alias("document"), F.lit(None).cast("string").alias("span_id"), "ces", "hits"))
    asked = spark.createDataFrame([(1, "graph search"), (2, "filter of an image")], "query_id int, text string")
    got = {r.query: r for r in engine.query(asked, 1, 2).collect()}
    one = got["graph search"]
    assert one.categories[0]["label"] == "graph search" and one.neighbours[0]["sentence_id"] == "t1" and one.neighbours[0]["shared"] == ["graph search"]
    assert one.annotated == "graph search  [concepts: graph search]" and one.margin == 0.0
    assert got["filter of an image"].neighbours[0]["sentence_id"] == "t2"
    assert len(query_engine.QueryEngine(rows, e).query(asked).first().categories) == 3
    sink = basis.absorb_structural(given.select("label", "vector", "document"), 64)
    both = rows.unionByName(sink)
    assert basis.ordered(both).orderBy("ord").first().row_id == basis.SINK and basis.concept_rows(both).count() == 3 and basis.by_level(both, 2).count() == 1
    assert basis.position_of(both, basis.SINK).first().ord == 0


def test_proofs_and_facts(tmp_path):
    doc = tmp_path / "blob" / "model.json"
    doc.parent.mkdir()
    doc.write_text("{}")
    state = sidecars.register(doc, tmp_path / "ces.json", params={"b": 1, "a": 2}, evidence={"rows": 3})
    assert state.name == "blob.drill.json" and sidecars.has_fact(doc) and sidecars.capability_valid(doc)
    kept = json.loads(state.read_text())
    assert kept["evidence"] == {"ces_path": str(tmp_path / "ces.json"), "ces_rows": 3}
    state.write_text(json.dumps({**kept, "other": 1}))
    sidecars.register(doc, tmp_path / "ces.json")
    assert json.loads(state.read_text())["other"] == 1 and json.loads(state.read_text())["facts"] == [sidecars.FACT]
    doc.write_text("{ }")
    assert not sidecars.capability_valid(doc) and sidecars.verify_proof({"inputs": {str(doc): "md5:1"}})
    assert sidecars.params_hash({"a": 1, "b": 2}) == sidecars.params_hash({"b": 2, "a": 1}) and sidecars.file_hash(tmp_path / "no") is None
    assert sidecars.read_state(tmp_path / "no") == {} and str(sidecars.sidecar_path("x/y.json")).endswith("y.conspectus.json")
    made = sidecars.build_payload("s", {"m": {"concepts": [{"concept_id": "c1", "name": "n"}]}}, [])
    assert sidecars.resolve_concept(made, {"embedding_model": "m"}, "c1")["name"] == "n" and sidecars.resolve_concept(made, {"embedding_model": "m"}, "c2") is None
    assert sidecars.content_hash({**made, "created_at": "now"}) == made["content_hash"]


def test_artefacts_of_trees(built, tmp_path):
    doc = tmp_path / "blob" / "model.json"
    doc.parent.mkdir()
    doc.write_text("{}")
    assert sidecars.read_artefact(doc) is None and sidecars.artefact_stale(doc) is None
    made = sidecars.tree_payload(built, summarise.summarise_tree(built, summarise.make_summariser("title-only")), doc, "d1", "now")
    path = sidecars.save_artefact(made, doc, params={"tau": 0.75})
    assert sidecars.verify_sidecar(path)[0] and len(made["markers"]) == 3 and {x["unit_id"] for x in made["units"]} == {"p0", "p1", "p2", "e1"}
    assert sidecars.capability_valid(doc) and sidecars.artefact_stale(doc) is False and sidecars.read_artefact(doc)["model"] == "title-only"
    doc.write_text("{ }")
    assert sidecars.artefact_stale(doc) is True and not sidecars.capability_valid(doc)


def test_document_accessors(atlas):
    assert documents.blocks_of_type(atlas.corpus, "CODE").count() == 1
    text = {short(r.doc_id): r.text for r in documents.full_text(atlas.corpus, generators.PROSE).collect()}
    assert text["a.json"].count("\n\n") == 1 and [r.section_id for r in documents.sections_in_order(atlas.corpus).where("doc_id like '%a.json'").orderBy("place").collect()] == ["s1", "s2"]
    assert documents.section(atlas.corpus, "s2").count() == 2 and summaries.TIERS and space.describe({"purity": 0.9})["weights"]["purity"] == pytest.approx(0.5)
