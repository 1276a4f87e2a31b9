"""Hand-computed cases of the engine's operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus.functions import ids, sentences, structural, text
from conspectus.operators import basis, candidates, graph, projection, scoring, selection, summaries, tree
from conspectus.plans import trees
from conspectus.sources import documents, stores


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_parents_are_nearest_lower_markers_of_the_run(spark):
    rows = [("d", f, f, lv, a) for f, lv, a in [(1, 1, False), (2, 2, False), (3, 4, False), (4, 2, False), (5, 1, False), (6, 3, True), (7, 4, True)]]
    got = tree.link_parents(spark.createDataFrame(rows, "doc_id string, flow_index int, marker_id int, level int, is_appendix boolean")).orderBy("flow_index").collect()
    assert [r.parent for r in got] == [None, 1, 2, 1, None, None, 6]


def test_last_marker_before_or_at(spark):
    markers = spark.createDataFrame([("d", 1, "m1"), ("d", 5, "m2")], "doc_id string, flow_index int, marker_id string")
    units = spark.createDataFrame([("d", f, f"u{f}") for f in (0, 1, 3, 5, 9)], "doc_id string, flow_index int, unit_id string")
    owners = lambda inc: [r.owner for r in tree.last_marker(markers, units, inclusive=inc).orderBy("flow_index").collect()]
    assert owners(False) == [None, None, "m1", "m1", "m2"]
    assert owners(True) == [None, "m1", "m1", "m2", "m2"]


def test_closure_survives_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "parent string, child string")
    got = {(r.ancestor, r.node): r.depth for r in tree.closure(spark, edges).collect()}
    assert got[("a", "c")] == 2 and got[("b", "b")] == 0 and got[("c", "b")] == 1


@pytest.fixture
def few_recursive_rows(spark):
    """A row limit for recursion as the big tables meet it."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key)
    spark.conf.set(key, "100")
    yield
    spark.conf.set(key, old)


def test_closure_has_no_limit_of_rows_or_levels(spark, few_recursive_rows):
    chain = [(i, i + 1) for i in range(12)] + [(0, 2), (3, 3), (12, None)]
    leaves = [(5, 100 + i) for i in range(50)]
    got = {(r.ancestor, r.node): r.depth for r in tree.closure(spark, spark.createDataFrame(chain + leaves + leaves[:9], "parent int, child int")).collect()}
    own = lambda a, n: n - a - (a == 0 and n >= 2)
    want = {(a, n): own(a, n) for a in range(13) for n in range(a, 13)} | {(None, None): 0}
    want |= {(100 + i, 100 + i): 0 for i in range(50)} | {(a, 100 + i): own(a, 5) + 1 for a in range(6) for i in range(50)}
    assert got == want


def _family(spark, folder, n):
    """Tables of one region, two nations and n customers."""
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0), (1, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", i % 2, float(i)) for i in range(n)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double"),
    }
    for name, (made, schema) in rows.items():
        spark.createDataFrame(made, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_descendants_of_more_rows_than_recursion_takes(spark, few_recursive_rows, tmp_path):
    got = {tuple(r) for r in trees.descendants(spark, _family(spark, tmp_path, 60)).collect()}
    assert got == {("r0", 62, 2), ("n0", 30, 1), ("n1", 30, 1)}


def test_section_paths_of_more_rows_than_recursion_takes(spark, few_recursive_rows, tmp_path):
    got = {r.node: r.path for r in trees.section_paths(spark, _family(spark, tmp_path, 60)).collect()}
    assert len(got) == 63 and got["r0"] == "R" and got["n1"] == "R > M" and got["c7"] == "R > M > C7"


def test_subtree_balance_of_more_rows_than_recursion_takes(spark, few_recursive_rows, tmp_path):
    got = {tuple(r) for r in trees.subtree_balance(spark, _family(spark, tmp_path, 60)).collect()}
    assert got == {("r0", 60, 1770.0), ("n0", 30, 870.0), ("n1", 30, 900.0)}


def test_top_level_of_more_rows_than_recursion_takes(spark, few_recursive_rows, tmp_path):
    assert [tuple(r) for r in trees.top_level(spark, _family(spark, tmp_path, 60)).collect()] == [("r0", 63)]


def test_coverage_curve(spark):
    got = [one(spark, text.coverage_curve(F.lit(f))) for f in (0.0, 0.01, 0.1, 0.3, 0.65, 0.9, 1.0)]
    assert got == pytest.approx([0.1, 0.1, 0.526316, 1, 0.65, 0.3, 0.3], abs=1e-6)


def test_match_metrics(spark):
    labels = spark.createDataFrame([("A", 2), ("B", 2)], "label string, n long")
    rows = [("all", b, lb) for b, lb in enumerate("AABB")] + [("both", 0, "A"), ("both", 1, "A"), ("one", 0, "A")]
    got = {r.candidate: r for r in scoring.match_metrics(spark.createDataFrame(rows, "candidate string, block int, label string"), labels).collect()}
    assert got["both"].information_gain == 1 and got["one"].information_gain == pytest.approx(0.311278) and got["all"].information_gain == 0
    assert got["all"].purity == 0.5 and got["both"].purity == 0


def test_citation_and_reusability(spark):
    assert one(spark, scoring.citation_importance(F.lit(100000), F.lit(2017))) == 0.8
    assert one(spark, scoring.citation_importance(F.lit(None).cast("int"), F.lit(2024))) == 0.5
    words = F.array(F.lit("graph"), F.lit("network"))
    assert one(spark, scoring.reusability(words, F.array(F.lit(3), F.lit(0)), F.lit(7))) == pytest.approx(0.716667)


def test_basis_fold(spark):
    rows = [(1, "a", [1.0, 0.0], "d1"), (1, "b", [0.8, 0.6], "d2"), (1, "c", [0.0, 1.0], "d3"), (2, "b", [0.8, 0.6], "d4"), (1, "z", [0.0, 0.0], "d5")]
    got = {(r.level, r.label): r for r in basis.fold(spark.createDataFrame(rows, "level int, label string, vector array<double>, document string")).collect()}
    assert set(got) == {(1, "a"), (1, "c"), (2, "b")}
    assert got[(1, "a")].support == 2 and got[(1, "a")].documents == ["d1", "d2"] and got[(1, "a")].vector == pytest.approx([0.948683, 0.316228], abs=1e-6)
    same = [(1, "A", [1.0, 0.0], "d1"), (1, " a ", [0.0, 1.0], "d2")]
    assert [r.support for r in basis.fold(spark.createDataFrame(same, "level int, label string, vector array<double>, document string")).collect()] == [2]


def test_ids(spark):
    assert one(spark, ids.row_id(F.lit(2), F.lit("Concept  Space"))) == "row_0d6e2ee7f200"
    assert one(spark, ids.concept_id(F.lit("document"), F.lit("heading"), F.lit("Concept Space"))) == "cpt_641452277b78"
    assert one(spark, ids.version_of(F.array(F.lit("row_a"), F.lit("row_b")))) == "f8527b5b2ab2bbca"
    assert one(spark, ids.query_id(F.lit("abc"), F.lit("what is x"))) == "3e5d388ed5d54a1d"
    assert ids.content_hash({"b": 1, "a": {"created_at": 5, "c": [1]}}) == ids.content_hash({"a": {"c": [1]}, "b": 1})


def test_row_order_and_version(spark):
    rows = spark.createDataFrame([(1, "r1", "z", 5), (1, "r2", "b", 3), (1, "r3", "a", 3)], "level int, row_id string, label string, support int")
    assert [r.label for r in basis.ordered(rows).orderBy("ord").collect()] == ["z", "a", "b"]


def test_margins(spark):
    hits = spark.createDataFrame([(1, "c", 0.9, 1), (2, "c", 0.9, 1), (2, "d", 0.5, 2)], "id int, concept string, similarity double, rank int")
    got = {r.id: (r.margin, r.sentence_margin) for r in projection.confidence(hits, "id").collect()}
    assert got == {1: (0.9, 0.0), 2: (0.4, 0.4)}


def test_neighbours_in_concept_coordinates(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.2, 0.2]), (2, [0.9, 0.0])], "id long, ces array<double>")
    got = projection.neighbours(rows.where("id = 0"), rows, 2, "id").orderBy("rank").collect()
    assert [(r.neighbour, r.similarity) for r in got] == [(2, 1.0), (1, 0.707107)]


def test_top_k_by_blocks_equals_by_matrix(spark, monkeypatch):
    rng = np.random.default_rng(0)
    objects = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(40)], "id long, v array<double>")
    concepts = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(30)], "concept long, vector array<double>")
    whole = {tuple(r) for r in projection.top_k(objects, concepts, 4, "id", "v").collect()}
    monkeypatch.setattr(projection, "fits", lambda *a: False)
    assert {tuple(r) for r in projection.top_k(objects, concepts, 4, "id", "v", block=7).collect()} == whole


def test_sibling_scores(spark):
    edges = spark.createDataFrame([("p", "c"), ("q", "c"), ("p", "s1"), ("p", "s2"), ("q", "s2"), ("r", "only")], "parent string, child string")
    got = {(r.parent, r.child): r.sibscore for r in graph.sibling_scores(edges).collect()}
    assert got[("p", "c")] == 0.75 and got[("r", "only")] == 1.0


def _plain_scores(edges):
    """Mean over siblings of the share of the child's parents that the sibling has too, pair by pair."""
    above, below = {}, {}
    for p, c in set(edges):
        above.setdefault(c, set()).add(p)
        below.setdefault(p, set()).add(c)
    out = {}
    for p, c in set(edges):
        shares = [len(above[c] & above[s]) / len(above[c]) for s in below[p] - {c}]
        out[(p, c)] = (len(shares), sum(shares) / len(shares) if shares else 1.0)
    return out


def test_sibling_scores_of_parents_over_batches(spark):
    """Parents of one child, and one whose children fill several batches."""
    rng = np.random.default_rng(3)
    edges = [(int(p), int(c)) for p, c in zip(rng.integers(0, 40, 600), rng.integers(0, 90, 600), strict=True)] + [(99, c) for c in range(90)] + [(200 + i, 500 + i) for i in range(9)]
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {(r.parent, r.child): (r.siblings, r.sibscore) for r in graph.sibling_scores(spark.createDataFrame(edges + edges[:50], "parent long, child long")).collect()}
    finally:
        spark.conf.set(key, old)
    want = _plain_scores(edges)
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - s) <= 5.1e-7 for k, (n, s) in want.items())


def test_sibling_scores_join_no_pairs_of_parents(spark):
    edges = spark.createDataFrame([(1, 2)], "parent long, child long")
    assert "Join" not in graph.sibling_scores(edges)._jdf.queryExecution().optimizedPlan().toString()


def test_sibling_scores_round_as_sql_does(spark):
    """323 / 2 / 320 is 0.5046875, which SQL rounds down in binary."""
    edges = [(0, c) for c in range(321)] + [(1, c) for c in range(4)]
    got = {(r.parent, r.child): r.sibscore for r in graph.sibling_scores(spark.createDataFrame(edges, "parent long, child long")).collect()}
    assert got[(0, 0)] == 0.504687


def test_children_ranked_joins_no_pairs_of_parents(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert "Join" not in trees.children_ranked(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_children_ranked_ranks_all_children(spark, tmp_path):
    edges = [(0, c) for c in range(6)] + [(1, 4), (1, 5), (2, 5)]
    spark.createDataFrame(edges + edges, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in trees.children_ranked(spark, str(tmp_path)).orderBy("parent", "rank").collect()]
    assert got == [(0, i + 1, c) for i, c in enumerate((0, 1, 2, 3, 4, 5))] + [(1, 1, 4), (1, 2, 5), (2, 1, 5)]


def test_refinement_adds_half_of_the_children_and_stops(spark):
    edges = spark.createDataFrame([("a", "a1", 0), ("a", "a2", 1), ("a", "a3", 2), ("b", "b1", 0)], "parent string, child string, ord int")
    vectors = spark.createDataFrame([(c, [x, 0.0]) for c, x in (("a", 1.0), ("a1", 0.5), ("a2", 0.4), ("a3", 0.9), ("b", 1.0), ("b1", 2.0))], "concept string, vector array<double>")
    contexts = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],)], "vector array<double>")
    table = graph.expansion_table(edges, vectors, contexts, 2)
    out = graph.refine(table, ["a"], 10)
    assert out.concepts == ["a", "a1", "a2"] and out.stopped.endswith("(all leaves)") and out.steps == [("a", 2.0, ("a1", "a2"), 3)]
    both = graph.refine(table, ["a", "b"], 3)
    assert both.concepts == ["a", "b", "b1"] and both.stopped == "reached target size"  # of equals the greatest id first
    assert graph.refine(table, ["a"], 10, drop_parent=True).concepts == ["a1", "a2"]
    assert graph.refine(table, [], 3).stopped == "no starting concepts" and graph.refine(table, ["a"], 3, rounds=0).stopped == "iteration limit reached"
    pure = graph.refine(table, ["a", "b"], 3, purity=lambda space: {"a": -1.0, "b": -9.0}, blend=0.5)
    assert pure.steps[0][:2] == ("a", 0.5)
    with pytest.raises(ValueError):
        graph.refine(table, ["a"], 3, most=2)
    own = graph.purities(spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "y"), (3, [0.0, 1.0], "x")], "context int, vector array<double>, label string"), spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "concept string, vector array<double>"), "label")
    assert {r.concept: r.purity for r in own.collect()} == {"p": -1.0, "q": 0.0}


def test_diverse_selection(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.8, [1.0, 0.0]), (1, "c", 0.7, [0.0, 1.0])], "g int, name string, score double, vector array<double>")
    assert [r.name for r in selection.select_diverse(rows, "g").orderBy("position").collect()] == ["a", "c"]


def test_pca_layout_equals_numpy(spark):
    m = np.random.default_rng(2).normal(size=(50, 4)) * [5, 2, 1, 0.1]
    got = {r.id: (r.x, r.y) for r in selection.pca_layout(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>"), "id", "v", 4).collect()}
    c = m - m.mean(0)
    _, _, axes = np.linalg.svd(c)
    axes = np.array([a * np.sign(a[np.abs(a).argmax()]) for a in axes[:2]])
    assert np.allclose([got[i] for i in range(50)], c @ axes.T, atol=1e-5)


def test_candidates_merge_and_absorb(spark):
    rows = spark.createDataFrame([("Graph Index", "heading", 1), ("graph  index", "nounphrase", 4)], "name string, source string, frequency int")
    (r,) = candidates.merge_candidates(rows).collect()
    assert (r.name, r.source, r.frequency, r.sources) == ("Graph Index", "heading", 5, ["heading", "nounphrase"])
    phrases = spark.createDataFrame([("deep hashing", 5), ("deep hashing model", 5), ("deep hashing code", 6)], "name string, frequency int")
    assert {r.name for r in candidates.absorb(phrases).collect()} == {"deep hashing", "deep hashing code"}


SENTENCES = [
    ("See Fig. 3 for it. Shown by A. Smith et al. The next holds. Value 0.85 is low.", ["See Fig. 3 for it.", "Shown by A. Smith et al.", "The next holds.", "Value 0.85 is low."]),
    ("One line\n\nother line", ["One line", "other line"]),
    (None, []),
    ('He said "Stop!" Then e.g. Bob (cf. Eve) left.  "Why?" (2 did.) So it was vs. The rest... And 3. Then', ['He said "Stop!', "Then e.g. Bob (cf. Eve) left.", '"Why?', "(2 did.", "So it was vs. The rest...", "And 3. Then"]),
    ("? Yes. It is. x", ["? Yes.", "It is. x"]),
    ("see i.e. The one. etc. The last", ["see i.e. The one. etc.", "The last"]),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", sentences.sentences(F.col("t")).alias("s")).collect()}
    for i, (_, want) in enumerate(SENTENCES):
        assert got[i] == want


def test_sentences_keep_digits_at_their_ends(spark):
    """A sentence's place among the others is no set of characters to trim."""
    texts = ["Go on. 148.9 is it. 2381604611877803 is a card. 37", "Zero. One. Two. Three. 44 of 44", "0 of 0"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sentences.sentences(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [["Go on.", "148.9 is it.", "2381604611877803 is a card.", "37"], ["Zero.", "One.", "Two.", "Three.", "44 of 44"], ["0 of 0"]]


def test_sanitising():
    assert sentences.sanitise("a‑b c​d “é” τ") == 'a-b cd "é" τ'


def _plain_sanitise(value):
    """Character by character."""
    import re
    import unicodedata

    folded = unicodedata.normalize("NFKC", value).translate(sentences._FOLD)
    kinds = ((c, unicodedata.category(c)) for c in folded)
    out = "".join(" " if kind == "Zs" else c for c, kind in kinds if kind not in ("Cf", "Co", "Cs"))
    out = re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", " ", out))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def test_sanitising_looks_at_a_character_once(monkeypatch):
    every = "".join(map(chr, range(0x3100))) + "\ue000\udc00\U0001d400 \t  \t\n\n\n\n x"
    for value in (every, every[::-1], every[:128], "a\t\tb \t c\n\n\n d", "\t", ""):
        assert sentences.sanitise(value) == _plain_sanitise(value)
    asked = []
    monkeypatch.setattr(sentences.unicodedata, "category", lambda c: asked.append(c) or "Ll")
    assert sentences.sanitise("plain text " * 99) == ("plain text " * 99).strip() and not asked
    sentences.sanitise("\u1e9f" * 99)
    assert len(asked) <= 1


def test_hash_vectors_are_units():
    v = sentences.hash_vector("graph index graph")
    assert np.isclose(v @ v, 1) and not sentences.hash_vector(" ").any()


def test_hash_vectors_make_a_hash_once(monkeypatch):
    """Feature by feature, to the last bit; a second text makes no hash anew."""
    import hashlib
    import math
    from collections import Counter

    def plain(low, dim, gram, salt):
        words, flat, out = sentences._TOKEN.findall(low), " ".join(low.split()), np.zeros(dim)
        counts = Counter(f"w:{w}" for w in words)
        counts.update(f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False))
        counts.update(f"c:{flat[i : i + gram]}" for i in range(len(flat) - gram + 1))
        for feature, n in counts.items():
            h = int.from_bytes(hashlib.blake2b(f"{salt}\x1f{feature}".encode(), digest_size=8).digest(), "big")
            out[h % dim] += (1.0 if h >> 63 else -1.0) * (1.0 + math.log(n))
        return out / math.sqrt(float(out @ out))

    value = "the graph of a graph, 12 {0} trees in the graph tree_a b tree a_b ümlaut\\alpha " * 9 + "end"
    for dim, gram, salt in ((64, 4, "s"), (7, 3, "t"), (1, 2, "s")):
        assert sentences.hash_vector(value, dim, gram, salt).tolist() == plain(value, dim, gram, salt).tolist()
    assert sentences.hash_vector("ab", 8).any() and not sentences.hash_vector(None, 8).any() and not sentences.hash_vector("?", 8).any()
    monkeypatch.setattr(sentences, "hashlib", None)
    assert sentences.hash_vector(value, 64, 4, "s").any()


def test_absorbing_makes_phrases_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    phrases = spark.createDataFrame([("a b", 2), ("a", 3), ("b c", 4), ("c", 1)], "name string, frequency long").mapInArrow(seen, "name string, frequency long")
    assert {r.name for r in candidates.absorb(phrases).collect()} == {"a", "b c", "c"}
    assert made.value == 4


def test_headings_and_phrases(spark):
    strip = lambda s: one(spark, text.strip_numbering(F.lit(s)))
    assert [strip("3.2 Method"), strip("IV. Results"), strip("A framework")] == ["Method", "Results", "framework"]
    assert one(spark, text.normalise_phrase(F.lit(" the  (graph of index) and "))) == "(graph of index)"  # edge marks go before edge words
    assert one(spark, text.is_acceptable_phrase(F.lit("graph index"))) and not one(spark, text.is_acceptable_phrase(F.lit("ab")))
    assert one(spark, text.is_acceptable_phrase(F.lit("AB"))) and not one(spark, text.is_acceptable_phrase(F.lit("of the")))


def test_structural_titles(spark):
    rows = spark.createDataFrame([("7. REFERENCES",), ("Box 12",), ("#1",), ("Anhang B: Werte",), ("Method",), (None,), ("Förderung",)], "t string")
    got = [r[0] for r in rows.select(structural.structural_class(structural.normalise_title(F.col("t")))).collect()]
    assert got == ["bibliography", "float", "artifact", "appendix", None, "untitled", "funding"]


def test_label_problems(spark):
    assert one(spark, text.label_problems(F.lit("Figure 3 is shown"))) == ["below", "copula", "float"]
    assert one(spark, text.label_problems(F.lit(" "))) == ["empty"]


def test_tiers(spark):
    tiers = lambda *t: one(spark, summaries.tier_pairs(*[F.lit(x) for x in t]))
    assert tiers("a b c", "a b c d e f g", None) == ["label/abstraction prefix"]
    assert tiers("a b c d e f g h i j", "k a b c d e f g h i", "x y") == ["label/abstraction overlap"]
    assert tiers("a b c", "d e f", "g") == []
    got = one(spark, summaries.words_upto(F.array(F.lit("a b"), F.lit("c d"), F.lit("e")), 4))
    assert got == "a b c d"


def test_gates(spark):
    spans = spark.createDataFrame([("s1", "x"), ("s2", None), ("s2", "y"), ("s9", "z")], "span_id string, label string")
    wanted = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "span_id string")
    r = summaries.gate_persistence(spans, wanted, ["label"]).first()
    assert (r.expected, r.got, r.missing, r.extra, r.repeated, r.incomplete, r.passed) == (3, 3, 1, 1, 1, 1, False)


def test_accounting(spark):
    a = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    b = spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    assert tuple(tree.accounting(a, b).first()) == (3, 2, 1, 1)


GENERIC = {"meta": {"title": "T"}, "sections": [{"title": "One"}, {"id": "s2", "title": "Two", "level": 2, "parent": "sec_0"}], "blocks": [{"text": "hello", "section": "s2"}, {"id": "b", "type": "Equation", "content": "x=1"}, {"text": " "}], "bibliography": ["A title", {"title": "B", "year": "2020", "citations": "12x", "keywords": ["k"]}]}
OBJECTS = {"objects": [{"id": "h", "type": "Section", "props": {"title": "Intro", "level": "2"}, "parent": "nowhere"}, {"id": "p", "type": "Paragraph", "props": {"text": "body"}, "parent": "h"}, {"id": "i", "type": "ListItem", "props": {"content": "J. Smith, Proceedings of X, 2019"}, "parent": "h"}, {"id": "e", "type": "DisplayEquation", "props": {"latex": "a^2"}}, {"id": "n", "type": "Paragraph", "props": {"text": ""}}]}


def test_document_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GENERIC))
    (tmp_path / "b.json").write_text(json.dumps(OBJECTS))
    files = documents.read_files(spark, str(tmp_path)).withColumn("typed", documents.is_object_model(F.col("json")))
    assert sorted(r.typed for r in files.collect()) == [False, True]
    g = documents.generic(files.where("not typed"))
    assert [(r.block_id, r.type, r.text, r.section_id) for r in g.blocks.orderBy("ord").collect()] == [("blk_0", "paragraph", "hello", "s2"), ("b", "equation", "x=1", None), ("blk_2", "paragraph", "", None)]
    assert [(r.section_id, r.level, r.parent_id) for r in g.sections.orderBy("ord").collect()] == [("sec_0", 1, None), ("s2", 2, "sec_0")]
    assert [(r.bib_id, r.title, r.year, r.citations) for r in g.bibliography.orderBy("ord").collect()] == [("bib_0", "A title", None, None), ("bib_1", "B", 2020, None)]
    o = documents.objects(files.where("typed"))
    assert [(r.block_id, r.type) for r in o.blocks.orderBy("ord").collect()] == [("p", "paragraph"), ("i", "bibitem"), ("e", "equation")]
    assert [(r.section_id, r.level, r.parent_id) for r in o.sections.collect()] == [("h", 2, None)]
    assert [(r.object_id, r.object_type) for r in o.skipped.collect()] == [("n", "paragraph")] and o.bibliography.first().year == 2019


def test_store_refuses_other_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r1", "a", [1.0, 0.0], 1)], "level int, row_id string, label string, vector array<double>, support int")
    store = stores.CorpusStore(spark, str(tmp_path))
    version = store.save_basis(rows, embedding_model="hash")
    assert store.load_basis().first().embedding_model == "hash"
    good = spark.createDataFrame([("s", [0.5], version), ("t", None, version)], "sentence_id string, ces array<double>, basis_version string")
    store.save_projections(good, version)
    assert store.load_index(version).count() == 1
    with pytest.raises(stores.VersionMismatch):
        store.save_projections(good.withColumn("basis_version", F.lit("x")), version)
    with pytest.raises(stores.VersionMismatch):
        store.load_index("x")
    spark.read.parquet(f"{tmp_path}/basis").withColumn("row_id", F.lit("other")).write.parquet(f"{tmp_path}/bad/basis")
    with pytest.raises(stores.VersionMismatch):
        stores.CorpusStore(spark, f"{tmp_path}/bad").load_basis()


def test_log_and_cache(spark, tmp_path):
    log = stores.Log(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("v1", "what", 0.1), ("v2", "who", 0.2)], "basis_version string, query string, margin double"))
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    assert log.read().count() == 2 and log.read("v1").first().query == "what"
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    embed = lambda c: F.array(F.char_length(c).cast("double"))
    empty = spark.createDataFrame([], "key string, vector array<double>")
    out, fresh = stores.encode_cached(texts, empty, embed, "m", "r")
    assert out.count() == 3 and fresh.count() == 2
    assert stores.encode_cached(texts, fresh, embed, "m", "r")[1].count() == 0
    with pytest.raises(ValueError):
        stores.conform(texts, {"span_id": "string"})


def test_files_are_fingerprinted(spark, tmp_path):
    (tmp_path / "f.txt").write_text("abc")
    known = stores.fingerprint(spark, str(tmp_path))
    assert known.first().bytes == 3 and not stores.stale(spark, str(tmp_path), known).first().stale


def test_stream_projects_onto_the_basis(spark, tmp_path):
    from conspectus.streaming.incremental import project_stream

    rows = spark.createDataFrame([(1, "r1", "a", [1.0, 0.0], 1), (1, "r2", "b", [0.0, 1.0], 1)], "level int, row_id string, label string, vector array<double>, support int")
    store = stores.CorpusStore(spark, str(tmp_path / "store"))
    store.save_basis(rows)
    spark.createDataFrame([(7, [0.9, 0.1])], "sentence_id long, vector array<double>").write.parquet(str(tmp_path / "in"))
    query = project_stream(spark.readStream.schema("sentence_id long, vector array<double>").parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"), 1)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "store" / "hits")).first().row_id == "r1"


def test_entry_points(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) >= 60
    assert __spark_entry__.entry(spark).count() > 0
