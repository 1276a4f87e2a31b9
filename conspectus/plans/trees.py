"""Queries over hierarchies and sequences: conversations as sections and units, regions and nations, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, markers, tree


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sections(spark, sf):
    """User turns open sections; the other turns are units."""
    c = _read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("flow_index"), "role", "text")
    markers = c.where("role = 'user'").select("doc_id", "flow_index", F.col("flow_index").alias("marker_id"), (F.col("flow_index") % 4 + 1).cast("int").alias("level"), (F.col("flow_index") >= 6).alias("is_appendix"))
    units = c.where("role <> 'user'").select("doc_id", "flow_index", F.col("flow_index").alias("unit_id"), "text")
    return markers, units


def asof_inclusive(spark, sf):
    markers, units = _sections(spark, sf)
    shifted = units.withColumn("flow_index", F.col("flow_index") - 1)
    return tree.last_marker(markers, shifted, inclusive=True).select("doc_id", "unit_id", "owner")


def asof_exclusive(spark, sf):
    markers, units = _sections(spark, sf)
    shifted = units.withColumn("flow_index", F.col("flow_index") - 1)
    return tree.last_marker(markers, shifted, inclusive=False).select("doc_id", "unit_id", "owner")


def preamble(spark, sf):
    return asof_exclusive(spark, sf).where("owner is null").groupBy("doc_id").agg(F.count("*").alias("units"))


def span_extents(spark, sf):
    markers, _ = _sections(spark, sf)
    return tree.extents(markers).select("doc_id", "marker_id", "level", "until")


def link_parents(spark, sf):
    markers, _ = _sections(spark, sf)
    return tree.link_parents(markers, 4).select("doc_id", "marker_id", "level", "parent")


def unit_accounting(spark, sf):
    markers, units = _sections(spark, sf)
    key = lambda df, c: df.select(F.concat_ws("/", "doc_id", c).alias("id"))
    owned = tree.last_marker(markers, units).where("owner is not null")
    twice = key(markers.where("level = 1"), "marker_id")
    return tree.accounting(key(_read(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn"), key(markers, "marker_id").union(key(owned, "unit_id")).union(twice))


def section_text(spark, sf):
    """Text of each section's own units in order."""
    markers, units = _sections(spark, sf)
    owned = tree.last_marker(markers, units).where("owner is not null").join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"])
    body = owned.groupBy("doc_id", "owner").agg(F.array_sort(F.collect_list(F.struct("flow_index", "text"))).alias("t"))
    return body.select("doc_id", "owner", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").cast("binary")).alias("md5"))


def _edges(spark, sf):
    nation, customer = _read(spark, sf, "nation"), _read(spark, sf, "customer")
    up = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return up.union(customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))


def descendants(spark, sf):
    closed = tree.closure(spark, _edges(spark, sf))
    return closed.where("depth > 0").groupBy("ancestor").agg(F.count("*").alias("descendants"), F.max("depth").alias("height"))


def section_paths(spark, sf):
    region, nation, customer = (_read(spark, sf, n) for n in ("region", "nation", "customer"))
    titles = region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("title"))
    titles = titles.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name")).union(customer.select(F.concat(F.lit("c"), "c_custkey"), "c_name"))
    return tree.section_paths(tree.closure(spark, _edges(spark, sf)), titles)


def top_level(spark, sf):
    closed = tree.closure(spark, _edges(spark, sf))
    last = Window.partitionBy("node").orderBy(F.desc("depth"))
    return closed.withColumn("n", F.row_number().over(last)).where("n = 1").groupBy(F.col("ancestor").alias("top")).agg(F.count("*").alias("nodes"))


def subtree_balance(spark, sf):
    """Sum over all descendants of an attribute of leaves."""
    closed = tree.closure(spark, _edges(spark, sf))
    leaf = _read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), "c_acctbal")
    return closed.join(leaf, "node").groupBy("ancestor").agg(F.count("*").alias("leaves"), F.round(F.sum(F.col("c_acctbal").cast("decimal(20,2)")).cast("double"), 2).alias("balance")).where("leaves > 1")


def _supply(spark, sf):
    """Parts under their suppliers: a graph with several parents per node."""
    return _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child")).distinct()


def sibling_scores(spark, sf):
    return graph.sibling_scores(_supply(spark, sf))


def children_ranked(spark, sf):
    """Every child of every parent by score."""
    order = Window.partitionBy("parent").orderBy(F.desc("sibscore"), "child")
    return graph.sibling_scores(_supply(spark, sf)).select("parent", F.row_number().over(order).alias("rank"), "child")


def graph_shape(spark, sf):
    return graph.shape(_supply(spark, sf).select(F.concat(F.lit("s"), "parent").alias("parent"), F.concat(F.lit("p"), "child").alias("child")))


def tree_shape(spark, sf):
    return graph.shape(_edges(spark, sf))


def _built(spark, sf):
    """Conversations as typed objects: user turns are sections, the others paragraphs that name the section of turn 0."""
    c = _read(spark, sf, "conversations")
    user = F.col("role") == "user"
    props = F.create_map(
        F.when(user, "title").otherwise("text"), F.col("text"), F.lit("level"), (F.col("turn") % 4 + 1).cast("string"), F.lit("flow_index"), F.col("turn").cast("string"),
        F.lit("is_appendix"), (user & (F.col("turn") >= 6)).cast("string"), F.lit("parent_section"), F.lit("t0"),
    )
    made = c.select(F.col("conv_id").cast("string").alias("doc_id"), "turn", F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.when(user, "Section").otherwise("Paragraph").alias("type"), props.alias("props")).alias("o"))
    files = made.groupBy("doc_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json("o").alias("o")))), lambda x: F.from_json(x["o"], "id string, type string, props map<string,string>")).alias("objects"))).alias("json"))
    return markers.build_tree(files)


def tree_from_objects(spark, sf):
    """Owner of every unit of trees that are read from typed objects."""
    return _built(spark, sf).units.select("doc_id", "unit_id", "marker_id", "moved")


def tree_stats(spark, sf):
    return _built(spark, sf).stats()


def tree_depths(spark, sf):
    return _built(spark, sf).depth()


QUERIES = {f.__name__: f for f in (tree_from_objects, tree_stats, tree_depths, asof_inclusive, asof_exclusive, preamble, span_extents, link_parents, unit_accounting, section_text, descendants, section_paths, top_level, subtree_balance, sibling_scores, children_ranked, graph_shape, tree_shape)}

_SECTIONS = """
c AS (SELECT conv_id AS doc_id, turn AS flow_index, role, text FROM conversations),
markers AS (SELECT doc_id, flow_index, flow_index AS marker_id, CAST(flow_index % 4 + 1 AS INTEGER) AS level, flow_index >= 6 AS app FROM c WHERE role = 'user'),
units AS (SELECT doc_id, flow_index, flow_index AS unit_id, text FROM c WHERE role <> 'user')
"""
_ASOF = "SELECT u.doc_id, u.unit_id, (SELECT max(m.marker_id) FROM markers m WHERE m.doc_id = u.doc_id AND m.flow_index {} u.flow_index - 1) AS owner FROM units u"
_TREE = """
edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
nodes AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges),
walk AS (SELECT node AS ancestor, node, 0 AS depth FROM nodes UNION ALL SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)
"""
_SUPPLY = "e AS (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child FROM lineitem)"
_SIBLING = f"""{_SUPPLY},
own AS (SELECT child, count(*) AS own FROM e GROUP BY child), size AS (SELECT parent, count(*) AS size FROM e GROUP BY parent),
common AS (SELECT a.parent AS p, b.parent AS q, count(*) AS n FROM e a JOIN e b USING (child) GROUP BY 1, 2),
summed AS (SELECT e.parent, e.child, sum(n - 1) AS shared FROM e JOIN e o USING (child) JOIN common ON p = e.parent AND q = o.parent GROUP BY 1, 2),
scores AS (SELECT parent, child, size - 1 AS siblings, round(CASE WHEN size = 1 THEN 1.0 ELSE shared / own / (size - 1) END, 6) AS sibscore FROM summed JOIN own USING (child) JOIN size USING (parent))
"""
_SHAPE = "nn AS (SELECT parent AS n FROM {0} UNION SELECT child FROM {0}), pp AS (SELECT n, (SELECT count(*) FROM (SELECT DISTINCT parent, child FROM {0}) x WHERE x.child = n) AS p FROM nn) SELECT count(*) AS nodes, count(*) FILTER (WHERE p = 0) AS roots, count(*) FILTER (WHERE p > 1) AS shared, count(*) FILTER (WHERE p > 1) = 0 AS is_tree FROM pp"

# all that reads as text is a unit; trees are told by the marker before, parents by level within a run of appendices
_BUILT = f"""{_SECTIONS},
owned AS (SELECT u.doc_id, u.flow_index, (SELECT max(m.marker_id) FROM markers m WHERE m.doc_id = u.doc_id AND m.flow_index < u.flow_index) AS owner FROM units u WHERE trim(u.text) <> ''),
runs AS (SELECT *, sum(CASE WHEN app <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY flow_index) AS run FROM (SELECT *, lag(app) OVER (PARTITION BY doc_id ORDER BY flow_index) AS prev FROM markers)),
linked AS (SELECT a.*, (SELECT max(b.marker_id) FROM runs b WHERE b.doc_id = a.doc_id AND b.run = a.run AND b.flow_index < a.flow_index AND b.level < a.level) AS parent FROM runs a)
"""

ORACLE_SQL = {
    "tree_from_objects": f"WITH {_BUILT} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 't' || flow_index AS unit_id, 't' || owner AS marker_id, owner IS NOT NULL AND owner <> 0 AS moved FROM owned",
    "tree_stats": f"""WITH {_BUILT}, m AS (SELECT doc_id, count(*) AS markers, count(*) FILTER (WHERE parent IS NULL) AS roots, count(*) FILTER (WHERE app) AS appendix_markers FROM linked GROUP BY doc_id),
      u AS (SELECT doc_id, count(owner) AS paragraphs, count(*) FILTER (WHERE owner IS NULL) AS orphans, count(*) FILTER (WHERE owner <> 0) AS moved FROM owned GROUP BY doc_id)
      SELECT CAST(coalesce(m.doc_id, u.doc_id) AS VARCHAR) AS doc_id, coalesce(markers, 0) AS markers, coalesce(roots, 0) AS roots, coalesce(appendix_markers, 0) AS appendix_markers, CAST(0 AS BIGINT) AS degraded_titles, coalesce(paragraphs, 0) AS paragraphs, coalesce(orphans, 0) AS orphans, coalesce(moved, 0) AS moved, CAST(0 AS BIGINT) AS skipped FROM m FULL JOIN u ON m.doc_id = u.doc_id""",
    "tree_depths": f"""WITH RECURSIVE {_BUILT}, up AS (SELECT doc_id, marker_id, parent, 0 AS depth FROM linked UNION ALL SELECT u.doc_id, u.marker_id, l.parent, u.depth + 1 FROM up u JOIN linked l ON l.doc_id = u.doc_id AND l.marker_id = u.parent)
      SELECT CAST(doc_id AS VARCHAR) AS doc_id, 't' || marker_id AS marker_id, max(depth) AS depth FROM up GROUP BY doc_id, marker_id""",
    "asof_inclusive": f"WITH {_SECTIONS} {_ASOF.format('<=')}",
    "asof_exclusive": f"WITH {_SECTIONS} {_ASOF.format('<')}",
    "preamble": f"WITH {_SECTIONS} SELECT doc_id, count(*) AS units FROM ({_ASOF.format('<')}) WHERE owner IS NULL GROUP BY doc_id",
    "span_extents": f"WITH {_SECTIONS} SELECT doc_id, marker_id, level, lead(flow_index) OVER (PARTITION BY doc_id ORDER BY flow_index) AS until FROM markers",
    "link_parents": f"""WITH {_SECTIONS}, r AS (SELECT *, sum(CASE WHEN app <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY flow_index) AS run FROM (SELECT *, lag(app) OVER (PARTITION BY doc_id ORDER BY flow_index) AS prev FROM markers))
      SELECT a.doc_id, a.marker_id, a.level, (SELECT max(b.marker_id) FROM r b WHERE b.doc_id = a.doc_id AND b.run = a.run AND b.flow_index < a.flow_index AND b.level < a.level) AS parent FROM r a""",
    "unit_accounting": f"""WITH {_SECTIONS}, o AS (SELECT doc_id, flow_index FROM markers UNION ALL SELECT doc_id, flow_index FROM markers WHERE level = 1
      UNION ALL SELECT u.doc_id, u.flow_index FROM units u WHERE EXISTS (SELECT 1 FROM markers m WHERE m.doc_id = u.doc_id AND m.flow_index <= u.flow_index)),
      n AS (SELECT doc_id, flow_index, count(*) AS n FROM o GROUP BY ALL)
      SELECT count(c.doc_id) AS inputs, count(*) FILTER (WHERE n IS NULL) AS unaccounted, count(*) FILTER (WHERE c.doc_id IS NOT NULL AND n > 1) AS double_counted, count(*) FILTER (WHERE c.doc_id IS NULL) AS unknown
      FROM (SELECT DISTINCT doc_id, flow_index FROM c) c FULL JOIN n ON n.doc_id = c.doc_id AND n.flow_index = c.flow_index""",
    "section_text": f"WITH {_SECTIONS}, o AS (SELECT u.*, (SELECT max(m.marker_id) FROM markers m WHERE m.doc_id = u.doc_id AND m.flow_index <= u.flow_index) AS owner FROM units u) SELECT doc_id, owner, md5(string_agg(text, chr(10) || chr(10) ORDER BY flow_index)) AS md5 FROM o WHERE owner IS NOT NULL GROUP BY doc_id, owner",
    "descendants": f"WITH RECURSIVE {_TREE} SELECT ancestor, count(*) AS descendants, max(depth) AS height FROM walk WHERE depth > 0 GROUP BY ancestor",
    "section_paths": f"WITH RECURSIVE {_TREE}, titles AS (SELECT 'r' || r_regionkey AS node, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer) SELECT w.node, string_agg(t.title, ' > ' ORDER BY w.depth DESC) AS path FROM walk w JOIN titles t ON t.node = w.ancestor GROUP BY w.node",
    "top_level": f"WITH RECURSIVE {_TREE} SELECT top, count(*) AS nodes FROM (SELECT node, arg_max(ancestor, depth) AS top FROM walk GROUP BY node) GROUP BY top",
    "subtree_balance": f"WITH RECURSIVE {_TREE} SELECT ancestor, count(*) AS leaves, round(CAST(sum(CAST(c_acctbal AS DECIMAL(20, 2))) AS DOUBLE), 2) AS balance FROM walk JOIN customer ON node = 'c' || c_custkey GROUP BY ancestor HAVING count(*) > 1",
    "sibling_scores": f"WITH {_SIBLING} SELECT * FROM scores",
    "children_ranked": f"WITH {_SIBLING} SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY sibscore DESC, child) AS rank, child FROM scores",
    "graph_shape": f"WITH {_SUPPLY}, g AS (SELECT 's' || parent AS parent, 'p' || child AS child FROM e), {_SHAPE.format('g')}",
    "tree_shape": f"WITH edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), {_SHAPE.format('edges')}",
}
