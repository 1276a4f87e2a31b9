"""Queries over documents, conversations and pages: text scalars, candidates, ledgers, labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import routing, structural
from ..functions import sentences as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import candidates, scoring, sentence_rows, summaries
from ..sources import documents

def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _words(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9'\-]*"), F.lit(0))
    return _read(spark, sf, "documents").select("doc_id", "source", found.alias("words"))


def word_frequencies(spark, sf):
    return _words(spark, sf).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_acronyms(spark, sf):
    found = F.regexp_extract_all("text", F.lit(T.ACRONYM), F.lit(0))
    return _read(spark, sf, "documents").select("doc_id", F.explode(found).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")).orderBy(F.desc("n"), "acronym").limit(50)


def bare_acronyms(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.array_join(T.bare_acronyms(F.col("text")), ",").alias("acronyms"))


def _lines(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))


def _corpus(spark, sf):
    """Documents as typed objects, one a line, of four types in turn."""
    kind = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), (i % 4 + 1).cast("int"))
    prop = lambda i: F.element_at(F.array(*map(F.lit, PROPS)), (i % 4 + 1).cast("int"))
    made = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(F.concat(F.lit("o"), i.cast("string")).alias("id"), kind(i).alias("type"), F.create_map(prop(i), line).alias("props")))
    files = _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json(F.struct(made.alias("objects"))).alias("json"))
    return documents.objects(files)


KINDS, PROPS = ("Section", "Paragraph", "ListItem", "Picture"), ("title", "text", "content", "caption")


def model_routing(spark, sf):
    return routing.group_by_model(_corpus(spark, sf).blocks).select("model", F.array_join("types", ",").alias("types"), "n")


def type_filter(spark, sf):
    found = documents.blocks_of_type(_corpus(spark, sf), "FIGURE", "bibitem")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def skip_ledger(spark, sf):
    """Every line is a section, a block or has one reason."""
    c = _corpus(spark, sf)
    rows = c.blocks.select(F.concat(F.lit("block "), "type").alias("outcome")).union(c.sections.select(F.lit("section"))).union(c.skipped.select("reason"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def acceptable_phrases(spark, sf):
    """Every line of every text in runs of three words, judged as phrases."""
    words = T.words_of(F.col("line"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(3)), lambda i: F.array_join(F.slice("w", i, 3), " "))
    raw = _lines(spark, sf).select(words.alias("w")).where(F.size("w") > 0).select(F.explode(runs).alias("raw")).distinct()
    return raw.select("raw", T.normalise_phrase(F.col("raw")).alias("phrase")).select("raw", "phrase", T.is_acceptable_phrase(F.col("phrase")).alias("acceptable"))


def strip_numbering(spark, sf):
    """Part names behind one or two numbers."""
    part = _read(spark, sf, "part")
    second = F.when(F.col("p_partkey") % 3 == 0, "iv. ").when(F.col("p_partkey") % 3 == 1, "B) ").otherwise("")
    title = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(" "), second, "p_name")
    return part.select("p_partkey", T.strip_numbering(title).alias("title"))


def label_checks(spark, sf):
    found = T.label_problems(F.col("text"))
    return _read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("problems"), T.word_count(F.col("text")).cast("long").alias("words"))


def token_jaccard(spark, sf):
    """Each turn beside the one before it: token overlap and whether one opens the other."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = _read(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"))
    a, b = T.token_set(F.col("text")), T.token_set(F.col("before"))
    prefix = F.startswith(F.col("text"), F.col("before")) | F.startswith(F.col("before"), F.col("text"))
    return turns.where("before is not null").select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"), prefix.alias("prefix"))


def _phrase_counts(spark, sf):
    w = F.col("words")
    runs = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    every = F.concat(runs(1), runs(2), runs(3))
    return _words(spark, sf).select(F.explode(every).alias("name")).groupBy("name").agg(F.count("*").alias("frequency")).where("frequency >= 3")


def absorbed_phrases(spark, sf):
    return candidates.absorb(_phrase_counts(spark, sf))


def merged_candidates(spark, sf):
    docs = _read(spark, sf, "documents")
    acronyms = docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.ACRONYM), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("glossary"))
    words = _words(spark, sf).select(F.explode("words").alias("name")).groupBy("name").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("nounphrase"))
    titled = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("ner"))
    merged = candidates.merge_candidates(acronyms.unionByName(words).unionByName(titled))
    return merged.where(F.size("sources") > 1).select("key", "name", "source", "weight", "frequency", F.array_join("sources", ",").alias("sources"), F.array_join("aliases", ",").alias("aliases"))


def section_spread(spark, sf):
    blocks = _words(spark, sf).select(F.col("source").alias("section"), "words")
    return candidates.section_spread(word_frequencies(spark, sf).select(F.col("word").alias("name")), blocks)


def reusability(spark, sf):
    freq = word_frequencies(spark, sf)
    most = freq.agg(F.max("n").alias("most"))
    names = _read(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    per = names.select("name", F.posexplode(T.words_of(F.col("name"))).alias("i", "word")).join(freq, "word", "left")
    arrays = per.groupBy("name").agg(F.collect_list(F.coalesce("n", F.lit(0))).alias("f"), F.array_sort(F.collect_list("word")).alias("w"))
    return arrays.crossJoin(most).select("name", scoring.reusability(F.col("w"), F.col("f"), F.col("most")).alias("reusability"))  # one row


def citation_importance(spark, sf):
    counts = _read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("citations"), F.max(F.year("l_shipdate")).alias("year"))
    parts = _read(spark, sf, "part").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select("p_partkey", scoring.citation_importance(F.col("citations"), F.col("year"), 2002).alias("importance"))


def sentence_stats(spark, sf):
    rows = split_sentences(spark, sf).where("char_length(sentence) >= 20").select("doc_id", F.col("sentence").alias("text"), F.col("doc_id").alias("source_id"), F.lit(None).cast("long").alias("span_id"))
    return sentence_rows.sentence_stats(rows, "doc_id")


def split_sentences(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("ordinal", "sentence"))


def sanitised_texts(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.sha2(S.sanitised("text"), 256).alias("sha256"))


def hash_embeddings(spark, sf):
    embed = S.hashing_embedder(64)
    return _read(spark, sf, "documents").select("doc_id", embed("text").alias("v")).select("doc_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.transform("v", lambda x: F.round(x, 6)).cast("string").alias("vector"))


def md5_hash_embedding(spark, sf):
    """Signed hashing of words by md5 into 32 buckets, in built-in functions."""
    words = _read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0))).alias("w"))
    h = F.md5(F.col("w").cast("binary"))
    bucket = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 32
    sign = F.when(F.conv(F.substring(h, 5, 1), 16, 10).cast("int") >= 8, 1.0).otherwise(-1.0)
    return words.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum(sign).alias("value"))


_TITLES = [t for titles in structural.EXACT.values() for t in titles.split(", ")] + ["appendix b: values", "Anhang C", "supplementary data", "box 12", "Fig. 3a", "12.4", "#7", "***", "", "Methode"]
_FORMS = ("{}", "3.1 {}", "IV. {}", "{}:", "  {} ", "b) {}.", "{} of it")


def structural_titles(spark, sf):
    """Known titles in several forms and part names, one a part, by class."""
    part = _read(spark, sf, "part")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES) + 1).cast("int"))
    forms = F.array(*[F.concat(F.lit(f.split("{}")[0]), F.when(F.col("p_partkey") % 2 == 0, F.initcap(title)).otherwise(title), F.lit(f.split("{}")[1])) for f in _FORMS], F.col("p_name"))
    rows = part.select("p_partkey", F.element_at(forms, (F.floor(F.col("p_partkey") / 3) % (len(_FORMS) + 1) + 1).cast("int")).alias("title"))
    return rows.select("p_partkey", F.coalesce(structural.structural_class(structural.normalise_title(F.col("title"))), F.lit("content")).alias("class"))


def label_confusion(spark, sf):
    """Texts with marks in a row or bars, held against quality labels by the structural gate's measure."""
    said = _read(spark, sf, "documents").select(F.col("doc_id").alias("span_id"), (F.col("text").contains("!!") | F.col("text").contains(" | ")).alias("structural"))
    truth = _read(spark, sf, "labels").select(F.col("doc_id").alias("span_id"), (F.col("quality") == 0).alias("structural"))
    out = summaries.gate_structural(said, truth)
    return out.select("tp", "fp", "fn", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


QUERIES = {f.__name__: f for f in (word_frequencies, top_acronyms, bare_acronyms, model_routing, type_filter, skip_ledger, acceptable_phrases, strip_numbering, label_checks, token_jaccard, absorbed_phrases, merged_candidates, section_spread, reusability, citation_importance, sentence_stats, split_sentences, sanitised_texts, hash_embeddings, md5_hash_embedding, structural_titles, label_confusion)}

_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"
_WORDS_SQL = r"w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z][a-z0-9''\-]*') AS words FROM documents)"
_LINES_SQL = "ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"
_COUNT = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"

# a word boundary follows any letter; splitting into runs of letters and digits says the same in RE2
_TOKENS = r"list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '{}'))"
FLOAT = T.FLOAT_REFERENCE.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])")
_ACRONYM, _BARE, _TITLE = r"[A-Z]{2,6}[0-9]{0,2}", r"[A-Z]{3,}[0-9]*", r"[A-Z][a-z]+"

_TITLE_LIST = "[" + ", ".join("'" + t + "'" for t in _TITLES) + "]"
_UMLAUTED = "trim(title)"
for _mark, _spelled in structural.UMLAUTS.items():
    _UMLAUTED = f"replace({_UMLAUTED}, '{_mark}', '{_spelled}')"
# typed objects of four types in turn; references are told by two of three signs
_OBJECTS = r"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
r AS (SELECT doc_id, line, ['section', 'paragraph', 'listitem', 'picture'][i % 4 + 1] AS kind, trim(line) = '' AS blank,
  regexp_matches(line, '\b(19|20)\d{2}\b')::INT + regexp_matches(line, '\b[A-Z]\.\s?(?:[A-Z]\.\s?)?[A-Z][a-z]+|[A-Z][a-z]+,\s[A-Z]\.')::INT + regexp_matches(line, '(?i)\b(proc|proceedings|journal|conf|conference|arxiv|trans|vol|pp|press|springer|acm|ieee)\b')::INT AS signs FROM ln),
b AS (SELECT *, CASE WHEN kind = 'listitem' AND signs >= 2 THEN 'bibitem' WHEN kind = 'picture' THEN 'figure' ELSE kind END AS alias FROM r)
"""
# candidate boundaries are marked, those with a reason against are joined again
_SHORT = "|".join(sorted((w.replace(".", r"\.") for w in S.NEVER_FINAL), key=lambda w: (-len(w), w)))
_SENTENCES = rf"""
para AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS pi FROM documents),
marked AS (SELECT doc_id, pi, string_split(regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '([.!?])(["'')\]]*\s+)(["''(\[]*[A-Z0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS ps FROM para),
piece AS (SELECT doc_id, pi, unnest(ps) AS raw, generate_subscripts(ps, 1) AS k FROM marked),
body AS (SELECT *, CASE WHEN k = 1 THEN raw ELSE split_part(raw, chr(2), 2) END AS b FROM piece),
veto AS (SELECT *, regexp_matches(b, '\d\.$') OR regexp_matches(b, '(?:^|\s)[A-Z]\.$') OR regexp_matches(b, '(?:^|[^A-Za-z.])\.{{0,3}}(?i:{_SHORT}|[a-z])\.{{1,4}}$') OR k = 1 AND length(b) < 2 AS no FROM body),
grouped AS (SELECT *, coalesce(sum(CASE WHEN no THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pi ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM veto),
whole AS (SELECT doc_id, pi, g, trim(string_agg(CASE WHEN k = first_k THEN b ELSE replace(raw, chr(2), '') END, '' ORDER BY k)) AS sentence FROM (SELECT *, min(k) OVER (PARTITION BY doc_id, pi, g) AS first_k FROM grouped) GROUP BY doc_id, pi, g),
sentences AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pi, g) - 1 AS ordinal FROM whole WHERE length(sentence) >= 2)
"""

ORACLE_SQL = {
    "word_frequencies": f"WITH {_WORDS_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word",
    "top_acronyms": rf"SELECT acronym, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_TOKENS.format('text', _ACRONYM)}) AS acronym FROM documents) GROUP BY acronym ORDER BY n DESC, acronym LIMIT 50",
    "bare_acronyms": rf"SELECT doc_id, coalesce(list_aggregate(list_sort(list_distinct({_TOKENS.format('text', _BARE)})), 'string_agg', ','), '') AS acronyms FROM documents",
    "model_routing": f"WITH {_OBJECTS} SELECT 'sentencebert' AS model, string_agg(DISTINCT alias, ',' ORDER BY alias) AS types, count(*) AS n FROM b WHERE alias <> 'section' AND NOT blank",
    "type_filter": f"WITH {_OBJECTS} SELECT alias AS type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM b WHERE alias IN ('figure', 'bibitem') AND NOT blank GROUP BY alias",
    "skip_ledger": f"WITH {_OBJECTS} SELECT CASE WHEN alias = 'section' THEN 'section' WHEN blank THEN 'no text under any known prop for type ' || chr(39) || kind || chr(39) ELSE 'block ' || alias END AS outcome, count(*) AS n FROM b GROUP BY 1",
    "acceptable_phrases": rf"""WITH {_LINES_SQL}, st AS (SELECT {_STOPS} AS stops),
      v AS (SELECT list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM ln),
      h AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS raw FROM (SELECT w, unnest(range(1, len(w) + 1, 3)) AS i FROM v WHERE len(w) > 0)),
      c AS (SELECT raw, list_filter(string_split_regex(regexp_replace(raw, '^[ .,;:!?()\[\]{{}}"''`–—/\\-]+|[ .,;:!?()\[\]{{}}"''`–—/\\-]+$', '', 'g'), '\s+'), lambda x: x <> '') AS ws FROM h),
      f AS (SELECT raw, ws, list_transform(ws, lambda x: NOT list_contains(stops, lower(x))) AS ok FROM c, st),
      p AS (SELECT raw, CASE WHEN list_contains(ok, true) THEN array_to_string(ws[list_position(ok, true):len(ws) - list_position(list_reverse(ok), true) + 1], ' ') ELSE '' END AS phrase FROM f),
      q AS (SELECT raw, phrase, list_filter(string_split(phrase, ' '), lambda x: x <> '') AS ws FROM p)
      SELECT raw, phrase, len(ws) BETWEEN 1 AND 5 AND len(list_filter(ws, lambda x: NOT list_contains(stops, lower(x)))) > 0
        AND length(regexp_replace(phrase, '[^\p{{L}}]', '', 'g')) >= greatest(2.0, length(phrase) * 0.5)
        AND (len(ws) > 1 OR length(phrase) >= 4 OR (upper(phrase) = phrase AND lower(phrase) <> phrase)) AS acceptable FROM q, st""",
    "strip_numbering": r"SELECT p_partkey, regexp_replace(p_size || '.' || p_partkey % 9 || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'iv. ' WHEN 1 THEN 'B) ' ELSE '' END || p_name, '^(?:\s*(?:\d+(?:\.\d+)*|[IVXLCivxlc]+|[A-Za-z])[.)]?\s+)+', '') AS title FROM part",
    "label_checks": rf"""SELECT conv_id, turn, CAST(n AS BIGINT) AS words, CASE WHEN n = 0 THEN 'empty' ELSE coalesce(list_aggregate(list_filter([
      CASE WHEN n < 30 THEN 'below' END, CASE WHEN n > 42 THEN 'above' END, CASE WHEN regexp_matches(text, '{T.BRACKETED_ACRONYM}') THEN 'acronym' END,
      CASE WHEN len({_TOKENS.format('text', '(?i:is|are|was|were|be|been|being)')}) > 0 THEN 'copula' END, CASE WHEN regexp_matches(text, '{T.CITATION}') THEN 'citation' END,
      CASE WHEN regexp_matches(text, '{FLOAT}') THEN 'float' END], lambda x: x IS NOT NULL), 'string_agg', ','), '') END AS problems
      FROM (SELECT *, {_COUNT.format("coalesce(text, '')")} AS n FROM conversations)""",
    "token_jaccard": r"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
      s AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS y FROM t WHERE b IS NOT NULL)
      SELECT conv_id, turn, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END, 6) AS jaccard, starts_with(text, b) OR starts_with(b, text) AS prefix FROM s""",
    "absorbed_phrases": rf"""WITH {_WORDS_SQL}, e AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
      t AS (SELECT a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      c AS (SELECT name, count(*) AS frequency FROM (SELECT a AS name FROM t UNION ALL SELECT a || ' ' || b FROM t WHERE b IS NOT NULL UNION ALL SELECT a || ' ' || b || ' ' || c FROM t WHERE c IS NOT NULL) GROUP BY name HAVING count(*) >= 3),
      parts AS (SELECT name, frequency, string_split(name, ' ') AS p FROM c WHERE contains(name, ' ')),
      inner_ AS (SELECT name, frequency, unnest(p) AS part FROM parts UNION ALL SELECT name, frequency, p[1] || ' ' || p[2] FROM parts WHERE len(p) = 3 UNION ALL SELECT name, frequency, p[2] || ' ' || p[3] FROM parts WHERE len(p) = 3),
      gone AS (SELECT DISTINCT i.name FROM inner_ i JOIN c ON c.name = i.part WHERE c.frequency >= i.frequency)
      SELECT name, frequency FROM c ANTI JOIN gone USING (name)""",
    "merged_candidates": rf"""WITH {_WORDS_SQL}, a AS (SELECT unnest({_TOKENS.format('text', _ACRONYM)}) AS name, 'glossary' AS source, 1.0 AS weight FROM documents
      UNION ALL SELECT unnest(words), 'nounphrase', 0.5 FROM w UNION ALL SELECT unnest({_TOKENS.format('text', _TITLE)}), 'ner', 0.3 FROM documents)
      SELECT key, best.name AS name, best.source AS source, CAST(best.weight AS DOUBLE) AS weight, frequency, sources, aliases FROM (
      SELECT lower(name) AS key, max({{'weight': weight, 'source': source, 'name': name}}) AS best, count(*) AS frequency, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT name, ',' ORDER BY name) AS aliases
      FROM a GROUP BY lower(name) HAVING count(DISTINCT source) > 1)""",
    "section_spread": f"WITH {_WORDS_SQL}, e AS (SELECT source, unnest(words) AS name FROM w), t AS (SELECT name FROM e GROUP BY name) SELECT name, count(DISTINCT source) AS df, round(ln((1.0 + (SELECT count(DISTINCT source) FROM documents)) / (1.0 + count(DISTINCT source))) + 1.0, 6) AS idf FROM e WHERE name IN (SELECT name FROM t) GROUP BY name",
    "reusability": rf"""WITH {_WORDS_SQL}, f AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word), m AS (SELECT max(n) AS most FROM f),
      p AS (SELECT DISTINCT lower(p_name) AS name FROM part), q AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM p)
      SELECT name, round(greatest(0, least(1, avg(1 - ln(1 + CAST(coalesce(n, 0) AS DOUBLE)) / ln(1 + CAST(most AS DOUBLE))) + least(0.15, 0.05 * (count(*) - 1)))), 6) AS reusability FROM (SELECT * FROM q WHERE word <> '') q LEFT JOIN f USING (word), m GROUP BY name""",
    "citation_importance": "WITH c AS (SELECT l_partkey, count(*) AS n, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN n IS NULL THEN 0.5 ELSE round(least(1.0, log10(n + 1.0) / 4) * CASE WHEN 2002 - y <= 5 THEN 1.0 ELSE 0.8 END, 6) END AS importance FROM part LEFT JOIN c ON p_partkey = l_partkey",
    "split_sentences": f"WITH {_SENTENCES} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, sentence FROM sentences",
    "sentence_stats": rf"""WITH {_SENTENCES}, n AS (SELECT doc_id, {_COUNT.format('sentence')} AS w FROM sentences WHERE length(sentence) >= 20)
      SELECT doc_id, count(*) AS sentences, CAST(1 AS BIGINT) AS sources, CAST(0 AS BIGINT) AS spans, count(*) AS orphaned, CAST(min(w) AS INTEGER) AS words_min, CAST(max(w) AS INTEGER) AS words_max, CAST(list_sort(list(w))[count(*) // 2 + 1] AS INTEGER) AS words_median FROM n GROUP BY doc_id""",
    "md5_hash_embedding": "WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents) SELECT doc_id, CAST(CAST('0x' || substr(h, 1, 4) AS INTEGER) % 32 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 5, 1) AS INTEGER) >= 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value FROM w GROUP BY 1, 2",
    "structural_titles": rf"""WITH t AS (SELECT p_partkey, p_name, {_TITLE_LIST}[p_partkey % {len(_TITLES)} + 1] AS base FROM part),
      u AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(base, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE base END AS b FROM t),
      f AS (SELECT p_partkey, [{', '.join(f"'{x.split('{}')[0]}' || b || '{x.split('{}')[1]}'" for x in _FORMS)}, p_name][p_partkey // 3 % {len(_FORMS) + 1} + 1] AS title FROM u),
      n AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(strip_accents(lower({_UMLAUTED})), '\s+', ' ', 'g')), '{structural.ORDINAL}', '') AS x FROM f),
      m AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(x, '^[ .:;,\-–—_]+|[ .:;,\-–—_]+$', '', 'g'), '\s+', ' ', 'g')) AS x FROM n)
      SELECT p_partkey, CASE WHEN x = '' THEN 'untitled' WHEN regexp_matches(x, '{structural.ARTIFACT}') THEN 'artifact' WHEN regexp_matches(x, '{structural.FLOAT}') THEN 'float'
      {' '.join(f"WHEN x IN ({', '.join(repr(t) for t in titles.split(', '))}) THEN '{name}'" for name, titles in structural.EXACT.items())}
      {' '.join(rf"WHEN regexp_matches(x, '^{word}\b') THEN '{name}'" for name, word in structural.PREFIXES)} ELSE 'content' END AS class FROM m""",
    "label_confusion": """WITH x AS (SELECT quality = 0 AS truth, contains(text, '!!') OR contains(text, ' | ') AS said FROM labels LEFT JOIN documents USING (doc_id)),
      c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT coalesce(said, false)) AS fn FROM x)
      SELECT tp, fp, fn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c""",
}
