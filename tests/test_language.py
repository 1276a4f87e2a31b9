"""Hand-computed cases of LaTeX cleaning, reply repair, label checks and candidate generators."""

import json

import pytest
from pyspark.sql import functions as F

from conspectus.functions import latex, replies, sentences, text
from conspectus.operators import candidates, generators
from conspectus.sources import documents


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_captions(spark):
    raw = (r"\ALG\ Application", r"\emph{Siblings} score", r"the $removeP$ parameter", r"the $\tau$ function", "  Plain \n title", "", None)
    assert values(spark, latex.clean_caption, *raw) == ["Application", "Siblings score", "the removeP parameter", "the tau function", "Plain title", "", ""]
    assert values(spark, lambda t: latex.lost_macros(t, latex.clean_caption(t)), *raw) == [["ALG"], [], [], [], [], [], []]


def test_body_text(spark):
    raw = ("of {{d_FO1||FO}} and {{d_REF_glove2||CIT}} here", "as shown in Eq. (ref), it holds", "{{x||ODD}}", None, "a  b")
    assert values(spark, latex.clean_body, *raw) == ["of formula and glove2 here", "as shown, it holds", "odd", "", "a b"]
    known = F.create_map(F.lit("d_FO1"), F.lit("X"))
    assert values(spark, lambda t: latex.clean_body(t, known), raw[0]) == ["of X and glove2 here"]
    assert values(spark, latex.dangling_refs, "see Fig. (ref) and <ref>", None) == [2, 0]


def test_formulas_are_read(spark):
    raw = (r"L = \sum_i y_i \log p_i", r"\alpha \leq \beta^2", r"A \subseteq B", "", None)
    assert values(spark, latex.read_aloud, *raw) == ["L equals the sum of i y i log p i", "alpha less than or equal to beta 2", "A subset of or equal to B", "", ""]
    assert latex.protect_identifiers(r"\begin{cases} AVERAGE_{s \in siblings} \end{cases}") == r"\begin{cases} \text{AVERAGE}_{s \in \text{siblings}} \end{cases}"
    assert latex.protect_identifiers(r"\text{ok} abc") == r"\text{ok} abc" and latex.protect_identifiers(None) == ""
    assert latex.strip_noop_macros(r"\ensuremath{X \to {Y}}\xspace \text{\textit{binary}}") == r"X \to {Y} \text{binary}"


def test_source_of_a_reading(spark):
    props = [({"spoken": " said "},), ({"latex": "a=b"},), ({"latex": "T"},), ({},), ({"latex": "bad=1"},)]
    rows = spark.createDataFrame(props, "p map<string,string>")
    speak = lambda tex: "[unspoken math]" if "bad" in tex else "spoken " + tex
    got = [tuple(r[0]) for r in rows.select(latex.math_text(F.col("p"))).collect()]
    assert got == [("said", "docmodel"), ("a equals b", "fallback"), ("", "none"), ("", "none"), ("bad equals 1", "fallback")]
    got = [tuple(r[0]) for r in rows.select(latex.math_text(F.col("p"), speak)).collect()]
    assert got == [("said", "docmodel"), ("spoken a=b", "speech"), ("", "none"), ("", "none"), ("bad equals 1", "fallback")]


@pytest.mark.parametrize(
    ("raw", "title", "want"),
    [
        (r"\section*{2 Related Work} Prominent \emph{nested {deep} ones} \cite{x}.", "Related Work", "Prominent nested deep ones ."),
        ("3.1 Method. 3.1 Method text", "3.1 Method", "Method text"),
        (r"a % note" + "\n" + r"b \tau{}c \foo[opt]{kept}", "", "a b tau c kept"),
        (r"\emph{open", "", "open"),
        (r"Some 50\% of $x$ & y~z", "", "Some 50 of x y z"),
        ("A framework for it", "", "A framework for it"),
        (None, None, ""),
    ],
)
def test_basis_text(spark, raw, title, want):
    rows = spark.createDataFrame([(raw, title)], "t string, h string")
    (got,) = [r[0] for r in latex.with_basis_text(rows, "t", "h").select("basis").collect()]
    assert (got.text, got.problems) == (want, [])


def test_basis_text_reports_rules_and_problems(spark):
    rows = spark.createDataFrame([(r"\cite{a} \emph{b}", ""), (None, None), ("Fine  Method: of it", "fine METHOD")], "t string, h string")
    got = [r[0] for r in latex.with_basis_text(rows, "t", "h").select("basis").collect()]
    assert got[0].rules == ["collapse-whitespace", "drop-command:cite", "unwrap-command:emph"] and got[1].text == ""
    assert got[2].text == "of it" and "strip-leading-title:normalized" in got[2].rules
    shown = [r[0] for r in latex.with_basis_text(rows.withColumn("g", F.lit("2. Head")), "t", "g", True).select("basis").collect()]
    assert shown[2].text == "Head. Fine Method: of it" and "prepend-title" in shown[2].rules
    found = spark.createDataFrame([(r"1. \x", ""), ("Method of", "method"), (None, "")], "t string, h string").select(latex.basis_problems(F.col("t"), F.col("h"))).collect()
    assert [r[0] for r in found] == [["character", "command", "ordinal"], ["title"], ["none"]]


def test_sanitising_keeps_lines():
    assert sentences.sanitise("a ‑b​ \t“c”\n\n\n\nd\x07…") == 'a -b "c"\n\nd ...'


def test_replies(spark):
    good = ('```json\n{"a": 1}\n```', "{a: 1}", r'{"a": "\sum x"}', 'Sure: {"a": {"b": "}"}} done', '[1, {"a": 2}]', "[1]", "none", None, '{"a": 1} {"b": 2}', 'x {bad} {"b": 2}')
    got = [None if x is None else json.loads(x) for x in values(spark, replies.parse_reply, *good)]
    assert got == [{"a": 1}, {"a": 1}, {"a": r"\sum x"}, {"a": {"b": "}"}}, {"a": 2}, None, None, None, {"a": 1}, {"b": 2}]
    assert values(spark, replies.repair_escapes, r'"\sum \n"') == [r'"\\sum \n"'] and values(spark, replies.repair_keys, "{a: 1, b2 : 2}") == ['{"a": 1, "b2" : 2}']
    assert values(spark, replies.control_corruption, "a\tb", "ok\n", None) == [["\\t..."], [], []]


def test_banned_constructions(spark):
    got = values(spark, text.banned_constructions, "This  section outlines it", "Our paper motivates; the present work", "the chapterhouse", None)
    assert got == [["this section", "outlines"], ["the present work", "document subject 'our paper'"], [], []]
    row = spark.range(1).select(text.tier_problems(F.lit("This paper (ABC)"), F.lit(None).cast("string"), F.lit(" ")).alias("t")).first()["t"]
    assert (row.label, row.abstraction, row.summary) == (["below", "this paper", "acronym"], ["absent"], ["empty"])


DOC = {
    "sections": [{"id": "s1", "title": "1 Graph Search"}, {"id": "s2", "title": "1.1 Index Trees", "level": 2, "parent": "s1"}, {"id": "s3", "title": "Notation"}, {"id": "s4", "title": "Introduction"}],
    "blocks": [
        {"id": "b1", "type": "definition", "name": "Concept Drift", "text": "Drift is change."},
        {"id": "b2", "text": "Definition 3.1 (Data Lake). A lake holds data.", "section": "s1"},
        {"id": "b3", "type": "theorem", "text": "Theorem 2. The vector space is complete."},
        {"id": "b4", "text": "edge weight — cost of an edge\nnothing here", "section": "s3"},
        {"id": "b5", "text": "It stopped. We use a Graph Neural Network (GNN) and a Graph Neural Network (GNN). However we go (WG)."},
        {"id": "e1", "type": "equation", "text": r"x = \sum_i y_i + 1"},
        {"id": "e2", "type": "equation", "text": r"z = \sum_j w_j + 2"},
        {"id": "e3", "type": "equation", "text": "k"},
        {"id": "b6", "text": "Closing words follow. GNN GNN GNN"},
    ],
    "bibliography": ["[3] Smith, J. and Doe, A.: Learning deep maps of text. In Proceedings of X (2019)", "short one", {"title": "A broad title of a paper: with many more words than anyone could ever want to read", "year": "2020", "keywords": ["k"]}],
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "a.json").write_text(json.dumps(DOC))
    return documents.generic(documents.read_files(spark, str(path)))


def test_headings(corpus):
    got = {r.name: (r.kind, r.tau) for r in generators.headings(corpus).collect()}
    assert got == {"Graph Search": ("heading", "Graph Search"), "Index Trees": ("heading", "Index Trees"), "Graph Search › Index Trees": ("heading_path", "Index Trees, Graph Search")}


def test_glossary(corpus):
    got = {r.name: r for r in generators.glossary(corpus).collect()}
    assert {n: r.kind for n, r in got.items()} == {"Concept Drift": "definition", "Data Lake": "definition", "vector space": "theorem", "edge weight": "term", "Graph Neural Network": "acronym"}
    assert got["edge weight"].metadata["description"] == "cost of an edge" and got["Graph Neural Network"].metadata["alias"] == "GNN"
    assert generators.glossary(corpus, False, False, False).count() == 0


def test_bibliography(corpus):
    got = {r.name: r for r in generators.bibliography(corpus).collect()}
    assert set(got) == {"Learning deep maps of text", "broad title of a paper"}
    assert got["broad title of a paper"].metadata["year"] == "2020" and got["broad title of a paper"].tau.startswith("A broad")


def test_equations(corpus):
    (row,) = generators.equations(corpus).collect()
    assert (row.name, row.frequency, row.metadata["example_object_id"]) == ("summation over norm and equality", 2, "e1")
    seen = lambda formula, context: F.concat(F.lit("about "), F.substring(context, -4, 4))
    assert [(r.name, r.frequency) for r in generators.equations(corpus, describe=seen).collect()] == [("GNN", 2)]


def test_phrases_and_entities(corpus):
    assert {(r.name, r.frequency) for r in generators.entities(corpus).collect()} == {("GNN", 5)}
    assert ("GNN", 5) in {(r.name, r.frequency) for r in generators.phrases(corpus).collect()}


def test_generated_candidates_merge(spark, corpus):
    rows = generators.generate(corpus)
    merged = {r.key: r for r in candidates.merge_candidates(rows, ("doc_id",)).collect()}
    assert merged["gnn"].sources == ["ner", "nounphrase"] and merged["gnn"].frequency == 10
    with pytest.raises(ValueError):
        generators.generate(corpus, ["nothing"])
    empty = documents.Corpus(*[df.where("false") for df in (corpus.blocks, corpus.sections, corpus.bibliography, corpus.skipped)])
    assert generators.generate(empty).count() == 0


def test_absorption_ignores_case_and_keeps_to_its_keys(spark):
    rows = spark.createDataFrame([("d", "Deep Hashing", 5), ("d", "deep hashing model", 5), ("d", "deep hashing code", 6), ("e", "deep hashing model", 1)], "doc_id string, name string, frequency long")
    got = {(r.doc_id, r.name) for r in candidates.absorb(rows, keys=("doc_id",)).collect()}
    assert got == {("d", "Deep Hashing"), ("d", "deep hashing code"), ("e", "deep hashing model")}
