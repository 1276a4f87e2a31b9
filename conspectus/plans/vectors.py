"""Queries over embeddings: projection, neighbours, profiles, basis, selection, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import vectors as V
from ..operators import basis, graph, projection, scoring, selection, space

DIM = 64

_CENTROIDS = """
dims AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
parts AS (SELECT label, i, avg(v[i]) AS x FROM dims, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
means AS (SELECT label, list(x ORDER BY i) AS v FROM parts GROUP BY label),
concepts AS (SELECT label AS concept, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vector FROM means),
sims AS (SELECT d.vec_id, d.label, c.concept, list_dot_product(d.v, c.vector) / sqrt(list_dot_product(d.v, d.v)) AS s FROM dims d, concepts c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, concept) AS rank FROM sims)
"""
_PAIRS = """
u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
pairs AS (SELECT a.label = b.label AS within, round(list_dot_product(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND (b.vec_id % 100 <> 0 OR a.vec_id < b.vec_id))
"""


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _concepts(spark, sf):
    means = _vectors(spark, sf).select("label", V.doubles("embedding").alias("v")).groupBy("label").agg(V.mean_vector(F.col("v"), DIM).alias("v"))
    return means.select(F.col("label").alias("concept"), V.unit(F.col("v")).alias("vector"))


def project_topk(spark, sf):
    return projection.top_k(_vectors(spark, sf), _concepts(spark, sf), 3, "vec_id", "embedding")


def project_margin(spark, sf):
    return projection.confidence(project_topk(spark, sf), "vec_id")


def project_full_ces(spark, sf):
    found = projection.coordinates(_vectors(spark, sf), _concepts(spark, sf), "vec_id", "embedding")
    return found.select("vec_id", F.posexplode("ces").alias("concept", "s")).select("vec_id", "concept", F.round("s", 6).alias("similarity"))


def _ces(spark, sf):
    return projection.coordinates(_vectors(spark, sf), _concepts(spark, sf), "vec_id", "embedding")


def query_neighbours_ces(spark, sf):
    rows = _ces(spark, sf)
    return projection.neighbours(rows.where("vec_id % 100 = 0"), rows, 5, "vec_id")


def shared_concepts(spark, sf):
    hits = project_topk(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "concept"))).alias("h")).select("vec_id", F.transform("h", lambda x: x["concept"]).alias("h"))
    near = query_neighbours_ces(spark, sf)
    q, n = hits.select(F.col("vec_id").alias("query"), F.col("h").alias("qh")), hits.select(F.col("vec_id").alias("neighbour"), F.col("h").alias("nh"))
    return near.join(q, "query").join(n, "neighbour").select("query", "neighbour", F.array_join(F.array_intersect("nh", "qh").cast("array<string>"), ",").alias("shared"))


def _counts(spark, sf):
    return basis.pair_counts(_vectors(spark, sf), "vec_id", "label", "embedding")


def cosine_profile(spark, sf):
    """Cosines of the vectors whose id is divisible by 100 with all others."""
    return basis.profile(_counts(spark, sf))


def calibrate_tau(spark, sf):
    return basis.calibrate(_counts(spark, sf))


def tau_fraction_sweep(spark, sf):
    taus = (0.1, 0.2, 0.25, 0.3, 0.4)
    agg = _counts(spark, sf).agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("s") >= t, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, t in enumerate(taus)])
    return agg.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"c{i}").alias("at_least")) for i, t in enumerate(taus)])).alias("x")).select("x.tau", "x.at_least", F.round(F.col("x.at_least") / F.col("n"), 6).alias("fraction"))


def near_parallel(spark, sf):
    return _counts(spark, sf).where(F.abs("s") >= 0.3).groupBy("within").agg(F.sum("n").alias("pairs"), F.round(F.max(F.abs("s")), 6).alias("greatest"))


def ces_gravity(spark, sf):
    from pyspark.sql.window import Window

    best = project_topk(spark, sf).where("rank = 1").groupBy("concept").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "concept")
    everything = Window.partitionBy()
    return best.select("concept", "n", F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(everything), 6).alias("cumulative"))


def nearest_class_accuracy(spark, sf):
    own = _vectors(spark, sf).select("vec_id", "label")
    return own.join(project_topk(spark, sf).where("rank = 1"), "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("concept")).alias("right"), F.round(F.avg((F.col("label") == F.col("concept")).cast("double")), 6).alias("accuracy"))


def projection_stats(spark, sf):
    c = project_margin(spark, sf)
    # upper median: entry n // 2 of the rising values, which is the discrete median of the falling ones
    upper = lambda x: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")
    return c.agg(F.count("*").alias("n"), F.min("top1").alias("top1_min"), upper("top1").alias("top1_median"), F.max("top1").alias("top1_max"), upper("margin").alias("margin_median"), F.count_distinct("best").alias("concepts_used"))


def metric_matches(spark, sf, theta=0.2):
    hits = project_full_ces(spark, sf).where(F.col("similarity") > theta)
    own = _vectors(spark, sf).select("vec_id", (F.col("label") % 4).alias("label"), V.doubles("embedding").alias("v"))
    return hits.join(own, "vec_id").select(F.col("concept").alias("candidate"), "vec_id", "label", "v")


def match_metrics(spark, sf):
    labels = _vectors(spark, sf).groupBy((F.col("label") % 4).alias("label")).agg(F.count("*").alias("n"))
    return scoring.match_metrics(metric_matches(spark, sf), labels)


def embedding_variance(spark, sf):
    return scoring.embedding_variance(metric_matches(spark, sf), "v", DIM)


def quality_score(spark, sf):
    m = match_metrics(spark, sf).join(embedding_variance(spark, sf), "candidate")
    score = scoring.quality({"structural": F.lit(0.3), "coverage": F.col("coverage"), "purity": F.col("purity"), "information_gain": F.col("information_gain"), "embedding_variance": F.col("embedding_variance"), "citation_importance": F.lit(None).cast("double"), "reusability": F.lit(None).cast("double")})
    return m.select("candidate", score.alias("score"))


def content_ids(spark, sf):
    v = _vectors(spark, sf)
    name = F.concat(F.lit(" Concept  "), F.col("vec_id").cast("string"))
    return v.select("vec_id", ids.concept_id(F.lit("document"), F.lit("heading"), name).alias("concept_id"), ids.row_id(F.col("label"), name).alias("row_id"), ids.query_id(F.lit("v1"), name).alias("query_id"))


def basis_version(spark, sf):
    v = _vectors(spark, sf)
    name = F.concat(F.lit("concept "), F.col("vec_id").cast("string"))
    return basis.version(v.select(F.col("label").alias("level"), name.alias("label"), F.lit(1).alias("support"), ids.row_id(F.col("label"), name).alias("row_id")))


def _candidates(spark, sf):
    return _vectors(spark, sf).select((F.col("label") % 3 + 1).cast("int").alias("level"), F.format_string("c%06d", "vec_id").alias("label"), F.col("embedding").alias("vector"), F.format_string("d%02d", "label").alias("document"))


def basis_fold(spark, sf):
    return basis.fold(_candidates(spark, sf), 0.25).select("level", "row_id", "label", "support", F.size("documents").cast("long").alias("n_documents"))


def basis_stats(spark, sf):
    return basis.stats(basis.fold(_candidates(spark, sf), 0.25))


def basis_tau_sweep(spark, sf):
    return basis.sweep(_candidates(spark, sf), (0.2, 0.25, 0.3, 0.45, 0.75))


def select_diverse(spark, sf):
    v = _vectors(spark, sf).select("vec_id", "label", F.format_string("c%06d", "vec_id").alias("name"), F.col("embedding").alias("vector"), ((F.col("vec_id") * 37) % 101 / 101.0).alias("score"))
    return selection.select_diverse(v, "label", threshold=0.2, most=20).select("label", "name", "position")


def pca_layout(spark, sf):
    return selection.pca_layout(_vectors(spark, sf), "vec_id", "embedding", DIM)


def refine_space(spark, sf):
    """Refinement over labels as parents of their vectors' ids modulo 7; all vectors are contexts."""
    v = _vectors(spark, sf).select("vec_id", "label", V.doubles("embedding").alias("vector"))
    low = v.groupBy("label", (F.col("vec_id") % 7).alias("part")).agg(V.mean_vector(F.col("vector"), DIM).alias("vector"))
    child = F.concat_ws(".", F.concat(F.lit("L"), "label"), "part")
    edges = low.select(F.concat(F.lit("L"), "label").alias("parent"), child.alias("child"), F.col("part").alias("ord"))
    vectors = _concepts(spark, sf).select(F.concat(F.lit("L"), "concept").alias("concept"), "vector").union(low.select(child, "vector"))
    table = graph.expansion_table(edges, vectors, v.select("vector"), DIM)
    start = [r["parent"] for r in edges.select("parent").distinct().orderBy("parent").collect()]  # ten labels
    out = graph.refine(table, start, 30)
    return spark.createDataFrame([(i, pick, round(w, 6), ",".join(added), size) for i, (pick, w, added, size) in enumerate(out.steps)], "step int, expanded string, weight double, added string, size int")


def quality_metrics(spark, sf):
    """Coverage, purity and gain by matrices, a document being a label modulo 2: each group's centroids against its vectors."""
    v = _vectors(spark, sf).select((F.col("label") % 2).cast("string").alias("doc_id"), "label", (F.col("label") % 4).cast("string").alias("section"), V.unit(V.doubles("embedding")).alias("vector"))
    own = _concepts(spark, sf).select((F.col("concept") % 2).cast("string").alias("doc_id"), F.col("concept").cast("string").alias("key"), "vector")
    return space.block_metrics(own, v.select("doc_id", F.col("section").alias("label"), "vector"), 0.2)


def document_hits(spark, sf):
    """The two best concepts of each vector in the space of its own document (label modulo 2)."""
    v = _vectors(spark, sf).select((F.col("label") % 2).cast("string").alias("doc_id"), "vec_id", V.unit(V.doubles("embedding")).alias("vector"))
    c = _concepts(spark, sf).select((F.col("concept") % 2).cast("string").alias("doc_id"), F.col("concept").alias("position"), F.concat(F.lit("id"), "concept").alias("concept_id"), F.concat(F.lit("c"), "concept").alias("name"), "vector")
    return space.best_concepts(v, c, 2, "vec_id").select("doc_id", "vec_id", F.inline("hits"))


QUERIES = {f.__name__: f for f in (project_topk, project_margin, project_full_ces, query_neighbours_ces, shared_concepts, cosine_profile, calibrate_tau, tau_fraction_sweep, near_parallel, ces_gravity, nearest_class_accuracy, projection_stats, match_metrics, embedding_variance, quality_score, content_ids, basis_version, basis_fold, basis_stats, basis_tau_sweep, select_diverse, pca_layout, refine_space, quality_metrics, document_hits)}

_MARGIN = """
two AS (SELECT vec_id, max(CASE WHEN rank = 1 THEN concept END) AS best, max(CASE WHEN rank = 1 THEN round(s, 6) END) AS top1, max(CASE WHEN rank = 2 THEN round(s, 6) END) AS second FROM ranked WHERE rank <= 2 GROUP BY vec_id),
margins AS (SELECT vec_id, best, top1, round(top1 - coalesce(second, 0), 6) AS margin, round(CASE WHEN second IS NULL THEN 0 ELSE top1 - second END, 6) AS sentence_margin FROM two)
"""
_METRICS = """
hits AS (SELECT concept AS candidate, vec_id, label % 4 AS label FROM sims WHERE round(s, 6) > 0.2),
labels4 AS (SELECT label % 4 AS label, count(*) AS n FROM embeddings GROUP BY 1),
total AS (SELECT sum(n) AS big, (SELECT sum(-(n / t) * log2(n / t)) FROM labels4, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM labels4)) AS h FROM labels4),
grid AS (SELECT c.candidate, l.label, l.n, count(x.vec_id) AS hit FROM (SELECT DISTINCT candidate FROM hits) c CROSS JOIN labels4 l LEFT JOIN hits x ON x.candidate = c.candidate AND x.label = l.label GROUP BY ALL),
full_ AS (SELECT *, CAST(sum(hit) OVER (PARTITION BY candidate) AS DOUBLE) AS hits, CAST(sum(n) OVER (PARTITION BY candidate) AS DOUBLE) AS nn FROM grid),
agg AS (SELECT candidate, any_value(hits) AS hits, any_value(nn) AS nn, max(hit) AS top,
  sum(CASE WHEN hit > 0 THEN -(hit / hits) * log2(hit / hits) ELSE 0 END) AS hi,
  sum(CASE WHEN n > hit THEN -((n - hit) / (nn - hits)) * log2((n - hit) / (nn - hits)) ELSE 0 END) AS ho FROM full_ GROUP BY candidate),
m AS (SELECT candidate, CAST(hits AS BIGINT) AS matches, hits / nn AS f, 1 - top / hits AS purity, greatest(0, least(1, (h - (hits / nn * hi + (1 - hits / nn) * ho)) / h)) AS gain FROM agg, total),
mm AS (SELECT candidate, matches, round(CASE WHEN f <= 0.01 THEN 0.1 WHEN f < 0.2 THEN 0.1 + (f - 0.01) * 0.9 / 0.19 WHEN f <= 0.4 THEN 1.0 WHEN f < 0.9 THEN 1.0 - (f - 0.4) * 0.7 / 0.5 ELSE 0.3 END, 6) AS coverage, round(purity, 6) AS purity, round(gain, 6) AS information_gain FROM m),
vars AS (SELECT h.candidate, i, var_pop(d.v[i]) AS x, count(*) AS n FROM hits h JOIN dims d ON d.vec_id = h.vec_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY h.candidate, i),
ev AS (SELECT candidate, round(CASE WHEN max(n) < 2 THEN 0.5 ELSE greatest(0, least(1, 1 - sum(x) / 2)) END, 6) AS embedding_variance FROM vars GROUP BY candidate)
"""
_CES = """
ces AS (SELECT vec_id, list(s ORDER BY concept) AS v FROM sims GROUP BY vec_id),
near AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v)) AS s FROM ces q JOIN ces r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
best AS (SELECT query, neighbour, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, neighbour) AS rank FROM near)
"""
_HASH = "sha256(concat_ws(chr(31), {}))"

# the fold, step by step: candidates of a level in order meet the level's rows so far
_FOLD = """
cand AS (SELECT CAST(label % 3 + 1 AS INTEGER) AS level, 'c' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS name, 'd' || lpad(CAST(label AS VARCHAR), 2, '0') AS doc, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY doc, name) AS n FROM cand),
taus AS (SELECT unnest({taus}::DOUBLE[]) AS tau),
walk AS (
  SELECT tau, level, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(name VARCHAR, v DOUBLE[], support INTEGER, docs VARCHAR[])[]) AS basis FROM taus, (SELECT DISTINCT level FROM cand)
  UNION ALL
  SELECT tau, level, n, CASE WHEN spot IS NULL THEN list_append(basis, {{'name': name, 'v': v, 'support': CAST(1 AS INTEGER), 'docs': [doc]}})
    ELSE list_concat(list_concat(basis[1:spot - 1], [{{'name': basis[spot].name, 'v': list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))), 'support': CAST(basis[spot].support + 1 AS INTEGER), 'docs': CASE WHEN list_contains(basis[spot].docs, doc) THEN basis[spot].docs ELSE list_append(basis[spot].docs, doc) END}}]), basis[spot + 1:]) END
  FROM (SELECT *, list_transform(range(1, 65), lambda i: coalesce((basis[spot].v[i] * basis[spot].support + v[i]) / (basis[spot].support + 1), 1.0)) AS mean
    FROM (SELECT w.tau, w.level, c.n, w.basis, c.name, c.doc, c.v, CASE WHEN list_max(list_transform(w.basis, lambda r: list_dot_product(r.v, c.v))) >= w.tau
        THEN list_position(list_transform(w.basis, lambda r: list_dot_product(r.v, c.v)), list_max(list_transform(w.basis, lambda r: list_dot_product(r.v, c.v)))) END AS spot
      FROM walk w JOIN ranked_ c ON c.level = w.level AND c.n = w.n + 1))),
folded AS (SELECT tau, level, arg_max(basis, n) AS basis, max(n) AS seen FROM walk GROUP BY tau, level)
"""
_ROW_ID = "'row_' || substr(sha256(concat_ws(chr(31), CAST(level AS VARCHAR), r.name)), 1, 12)"
_ONE = _FOLD.format(taus="[0.25]")

ORACLE_SQL = {
    "project_topk": f"WITH {_CENTROIDS} SELECT vec_id, concept, round(s, 6) AS similarity, rank FROM ranked WHERE rank <= 3",
    "project_margin": f"WITH {_CENTROIDS}, {_MARGIN} SELECT * FROM margins",
    "project_full_ces": f"WITH {_CENTROIDS} SELECT vec_id, concept, round(s, 6) AS similarity FROM sims",
    "query_neighbours_ces": f"WITH {_CENTROIDS}, {_CES} SELECT query, neighbour, similarity, rank FROM best WHERE rank <= 5",
    "shared_concepts": f"WITH {_CENTROIDS}, {_CES}, h AS (SELECT vec_id, list(concept ORDER BY rank) AS h FROM ranked WHERE rank <= 3 GROUP BY vec_id) SELECT query, neighbour, coalesce(list_aggregate(list_filter(n.h, lambda x: list_contains(q.h, x)), 'string_agg', ','), '') AS shared FROM best JOIN h q ON q.vec_id = query JOIN h n ON n.vec_id = neighbour WHERE rank <= 5",
    "cosine_profile": f"WITH {_PAIRS} SELECT within, count(*) AS n, round(max(s), 6) AS max, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99 FROM pairs GROUP BY within",
    "calibrate_tau": f"WITH {_PAIRS} SELECT round(quantile_cont(s, 0.99), 6) AS raw, round(greatest(0.45, least(0.95, quantile_cont(s, 0.99))), 6) AS tau FROM pairs WHERE NOT within",
    "tau_fraction_sweep": f"WITH {_PAIRS} SELECT tau, count(*) FILTER (WHERE s >= tau) AS at_least, round(count(*) FILTER (WHERE s >= tau) / count(*), 6) AS fraction FROM pairs, (SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.4]::DOUBLE[]) AS tau) GROUP BY tau",
    "near_parallel": f"WITH {_PAIRS} SELECT within, count(*) AS pairs, round(max(abs(s)), 6) AS greatest FROM pairs WHERE abs(s) >= 0.3 GROUP BY within",
    "ces_gravity": f"WITH {_CENTROIDS}, b AS (SELECT concept, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY concept) SELECT concept, n, round(sum(n) OVER (ORDER BY n DESC, concept) / sum(n) OVER (), 6) AS cumulative FROM b",
    "nearest_class_accuracy": f"WITH {_CENTROIDS} SELECT label, count(*) AS n, count(*) FILTER (WHERE label = concept) AS right, round(avg(CAST(label = concept AS DOUBLE)), 6) AS accuracy FROM ranked WHERE rank = 1 GROUP BY label",
    "projection_stats": f"WITH {_CENTROIDS}, {_MARGIN} SELECT count(*) AS n, min(top1) AS top1_min, list_sort(list(top1))[count(*) // 2 + 1] AS top1_median, max(top1) AS top1_max, list_sort(list(margin))[count(*) // 2 + 1] AS margin_median, count(DISTINCT best) AS concepts_used FROM margins",
    "match_metrics": f"WITH {_CENTROIDS}, {_METRICS} SELECT * FROM mm",
    "embedding_variance": f"WITH {_CENTROIDS}, {_METRICS} SELECT * FROM ev",
    "quality_score": f"WITH {_CENTROIDS}, {_METRICS} SELECT candidate, round(0.3 * 0.25 + coverage * 0.2 + purity * 0.1 + information_gain * 0.15 + embedding_variance * 0.1 + 0.05 + 0.05, 6) AS score FROM mm JOIN ev USING (candidate)",
    "content_ids": f"SELECT vec_id, 'cpt_' || substr({_HASH.format(chr(39) + 'document' + chr(39) + ', ' + chr(39) + 'heading' + chr(39) + ', n')}, 1, 12) AS concept_id, 'row_' || substr({_HASH.format('CAST(label AS VARCHAR), n')}, 1, 12) AS row_id, substr({_HASH.format(chr(39) + 'v1' + chr(39) + ', raw')}, 1, 16) AS query_id FROM (SELECT *, 'concept ' || vec_id AS n, ' Concept  ' || vec_id AS raw FROM embeddings)",
    "basis_version": f"SELECT substr(sha256(string_agg(rid, chr(31) ORDER BY label, n, rid)), 1, 16) AS basis_version, CAST(count(*) AS INTEGER) AS n_rows FROM (SELECT label, 'concept ' || vec_id AS n, 'row_' || substr({_HASH.format('CAST(label AS VARCHAR), ' + chr(39) + 'concept ' + chr(39) + ' || vec_id')}, 1, 12) AS rid FROM embeddings)",
    "refine_space": f"""WITH RECURSIVE {_CENTROIDS},
      lows AS (SELECT label, vec_id % 7 AS part, i, avg(v[i]) AS x FROM dims, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
      vectors AS (SELECT 'L' || concept AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS part, vector FROM concepts UNION ALL
        SELECT 'L' || label || '.' || part, 'L' || label, part, list(x ORDER BY i) FROM lows GROUP BY label, part),
      total AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, sum(v[i]) AS x FROM dims, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)),
      weighed AS (SELECT id, parent, part, list_dot_product(vector, t) AS w FROM vectors, total),
      -- every node has one parent, so siblings share one parent each and rank by part; leaves never open
      kids AS (SELECT parent AS id, list(id ORDER BY part) AS c FROM weighed WHERE parent IS NOT NULL GROUP BY parent),
      opened AS (SELECT row_number() OVER (ORDER BY w DESC, id DESC) - 1 AS step, id, w, c[1:CAST(ceil(0.5 * len(c)) AS BIGINT)] AS added FROM weighed JOIN kids USING (id)),
      sized AS (SELECT *, (SELECT count(*) FROM kids) + sum(len(added)) OVER (ORDER BY step) AS size FROM opened)
      SELECT CAST(step AS INTEGER) AS step, id AS expanded, round(w, 6) AS weight, list_aggregate(added, 'string_agg', ',') AS added, CAST(size AS INTEGER) AS size FROM sized WHERE size - len(added) < 30""",
    "quality_metrics": f"""WITH {_CENTROIDS},
      hits AS (SELECT CAST(c.concept % 2 AS VARCHAR) AS doc_id, CAST(c.concept AS VARCHAR) AS key, s.vec_id, s.label % 4 AS section FROM concepts c LEFT JOIN sims s ON s.concept = c.concept AND s.label % 2 = c.concept % 2 AND s.s > 0.2),
      labels_ AS (SELECT CAST(label % 2 AS VARCHAR) AS doc_id, label % 4 AS section, count(*) AS n FROM embeddings GROUP BY ALL),
      docs AS (SELECT doc_id, CAST(sum(n) AS DOUBLE) AS nn, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM labels_ GROUP BY doc_id),
      grid AS (SELECT k.doc_id, k.key, l.section, l.n, count(h.vec_id) AS hit FROM (SELECT DISTINCT doc_id, key FROM hits) k JOIN labels_ l ON l.doc_id = k.doc_id LEFT JOIN hits h ON h.key = k.key AND h.section = l.section GROUP BY ALL),
      tot AS (SELECT doc_id, key, CAST(sum(hit) AS DOUBLE) AS hits FROM grid GROUP BY ALL),
      agg AS (SELECT g.doc_id, g.key, any_value(t.hits) AS hits, any_value(d.nn) AS nn, any_value(d.h) AS h, max(g.hit) AS top,
        sum(CASE WHEN hit > 0 THEN -(hit / t.hits) * log2(hit / t.hits) ELSE 0 END) AS hi, sum(CASE WHEN n > hit THEN -((n - hit) / (d.nn - t.hits)) * log2((n - hit) / (d.nn - t.hits)) ELSE 0 END) AS ho
        FROM grid g JOIN tot t USING (doc_id, key) JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id, g.key),
      units AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM dims),
      var_ AS (SELECT key, i, var_pop(u.v[i]) AS x, count(*) AS n FROM hits JOIN units u USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY key, i),
      spread AS (SELECT key, CASE WHEN max(n) < 2 THEN 0.5 ELSE greatest(0, least(1, 1 - sum(x) / 2)) END AS ev FROM var_ GROUP BY key)
      SELECT doc_id, key, CAST(hits AS BIGINT) AS matches, round(CASE WHEN f <= 0.01 THEN 0.1 WHEN f < 0.2 THEN 0.1 + (f - 0.01) * 0.9 / 0.19 WHEN f <= 0.4 THEN 1.0 WHEN f < 0.9 THEN 1.0 - (f - 0.4) * 0.7 / 0.5 ELSE 0.3 END, 6) AS coverage,
        round(CASE WHEN hits > 0 THEN 1 - top / hits ELSE 0 END, 6) AS purity, round(CASE WHEN hits = 0 OR hits = nn THEN 0 ELSE greatest(0, least(1, (h - (f * hi + (1 - f) * ho)) / h)) END, 6) AS information_gain, round(coalesce(ev, 0.5), 6) AS embedding_variance
      FROM (SELECT *, hits / nn AS f FROM agg) LEFT JOIN spread USING (key)""",
    "document_hits": f"""WITH {_CENTROIDS}, r AS (SELECT CAST(label % 2 AS VARCHAR) AS doc_id, vec_id, concept, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, concept) AS rank FROM sims WHERE label % 2 = concept % 2)
      SELECT doc_id, vec_id, CAST(rank AS INTEGER) AS rank, 'id' || concept AS concept_id, 'c' || concept AS name, round(s, 6) AS similarity FROM r WHERE rank <= 2""",
    "basis_fold": f"WITH RECURSIVE {_ONE} SELECT level, {_ROW_ID} AS row_id, r.name AS label, r.support AS support, len(r.docs) AS n_documents FROM (SELECT level, unnest(basis) AS r FROM folded)",
    "basis_stats": f"""WITH RECURSIVE {_ONE} SELECT level, count(*) AS rows, max(r.support) AS max_support, round(avg(r.support), 6) AS mean_support, count(*) FILTER (WHERE r.support = 1) AS singletons, count(*) FILTER (WHERE len(r.docs) > 1) AS shared
      FROM (SELECT level, unnest(basis) AS r FROM folded) GROUP BY level""",
    "basis_tau_sweep": f"""WITH RECURSIVE {_FOLD.format(taus="[0.2, 0.25, 0.3, 0.45, 0.75]")}
      SELECT tau, level, len(basis) AS rows, seen - len(basis) AS merged, CAST(0 AS BIGINT) AS skipped, len(list_filter(basis, lambda r: len(r.docs) > 1)) AS shared FROM folded""",
    "select_diverse": """WITH RECURSIVE c AS (SELECT label, 'c' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS name, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v, (vec_id * 37) % 101 / 101.0 AS score FROM embeddings),
      o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, name) AS n FROM c),
      walk AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[][]) AS vs, CAST([] AS VARCHAR[]) AS names FROM o
        UNION ALL SELECT label, n, CASE WHEN taken THEN list_append(vs, v) ELSE vs END, CASE WHEN taken THEN list_append(names, name) ELSE names END
        FROM (SELECT w.label, o.n, w.vs, w.names, o.v, o.name, len(w.vs) < 20 AND coalesce(list_max(list_transform(w.vs, lambda x: list_dot_product(x, o.v))), -2) <= 0.2 AS taken FROM walk w JOIN o ON o.label = w.label AND o.n = w.n + 1)),
      last_ AS (SELECT label, arg_max(names, n) AS names FROM walk GROUP BY label)
      SELECT label, unnest(names) AS name, generate_subscripts(names, 1) AS position FROM last_""",
}
