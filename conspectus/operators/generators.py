"""Generators of concept candidates from a corpus: headings, glossary, bibliography, phrases, entities, equations.

Each takes a ``Corpus`` (see sources.documents) and returns rows of ``COLUMNS``. Work is by document; where the first
of equal names wins, it wins by a grouped minimum over its place, so nothing is ordered or gathered beyond a name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from ..functions import latex as L
from ..functions import text as T
from . import candidates, language, tree

COLUMNS = {"doc_id": "string", "name": "string", "source": "string", "kind": "string", "frequency": "long", "section_id": "string", "tau": "string", "metadata": "map<string,string>"}
# Types of blocks that hold prose, formulas, and defined statements.
PROSE = "paragraph abstract text definition theorem proof footnote sidenote listitem remark example".split()
MATH = "equation formula displayequation inlinemath".split()
STATEMENTS = "definition theorem lemma corollary proposition axiom remark claim".split()
# Patterns of titles of term lists, leads of statements, entries and subjects.
TERM_SECTION = r"(?i)\b(glossary|acronyms?|abbreviations?|nomenclature|notation|list of symbols|symbol table|definitions?)\b"
STATEMENT_LEAD = r"(?i)^\s*(definition|defn|theorem|thm|lemma|corollary|proposition|remark|axiom|claim)\s*(\d+(?:\.\d+)*)?\s*(?:\(([^)]{2,80})\))?\s*[.:]?\s*"
ENTRY = r"^\s*([^\s—–:.-][^—–:]{0,70}?)\s*[—–:]\s+(.{4,})$"
SUBJECT = r"(?i)^(?:the|a|an)?\s*([A-Za-z][\w\s\-]{2,60}?)\s+(?:is|are|denotes?|refers?|means)\b"
STATEMENT_CHARS = 1200
# Words that no expansion of a short form holds, and where a sentence ends before one.
CONNECTIVES = frozenset(
    "however therefore moreover furthermore thus hence whereas although though because since unless until while and or but nor so yet if then "
    "when where we our this that these those it there here also both either neither".split()
)
SENTENCE_END = re.compile(r"(?<=[.!?;])\s+(?=[A-Z(])|\n\s*\n")
# Patterns of formulas and what they signal, in order. The norm's pattern holds an empty alternative and
# fits every formula; results must agree with it.
SIGNALS = (
    (r"\\iint|\\iiint|\\oint", "multiple integral"),
    (r"\\int", "integral"),
    (r"\\sum", "summation"),
    (r"\\prod", "product"),
    (r"\\lim", "limit"),
    (r"\\frac\s*\{\s*\\partial", "partial derivative"),
    (r"\\partial", "partial derivative"),
    (r"\\nabla\s*\\cdot", "divergence"),
    (r"\\nabla\s*\\times", "curl"),
    (r"\\nabla\^?2|\\Delta\b", "Laplacian"),
    (r"\\nabla", "gradient"),
    (r"\\mathbb\{E\}|\\operatorname\{E\}|\\mathbb\s*E", "expectation"),
    (r"\\Pr\b|\\mathbb\{P\}|\bp\s*\(", "probability"),
    (r"\\log|\\ln\b", "logarithm"),
    (r"\\exp\b|e\^", "exponential"),
    (r"\\argmin|\\arg\s*\\min", "minimisation objective"),
    (r"\\argmax|\\arg\s*\\max", "maximisation objective"),
    (r"\\min\b", "minimum"),
    (r"\\max\b", "maximum"),
    (r"\\mathcal\{L\}|\\mathcal\s*L", "loss function"),
    (r"\\hat\{", "estimator"),
    (r"\\bar\{", "mean"),
    (r"\\sigma|\\Sigma", "variance or covariance"),
    (r"\\mu\b", "mean parameter"),
    (r"\\theta\b", "parameter vector"),
    (r"\\otimes|\\oplus", "tensor operation"),
    (r"\\langle.*\\rangle", "inner product"),
    (r"\\|.*\\|", "norm"),
    (r"\\sqrt", "square root"),
    (r"\\cos|\\sin|\\tan", "trigonometric expression"),
    (r"\\matrix|\\begin\{[bp]matrix\}", "matrix expression"),
    (r"\\leq|\\geq|\\le\b|\\ge\b", "inequality"),
    (r"=", "equality"),
)
# Patterns of reference entries.
LEADING_MARKER = r"^\s*(?:\[\d+\]|\(\d+\)|\d{1,3}[.)])\s*"
AUTHOR_RUN = r"^(?:[A-Z][A-Za-z'\-]+,\s*(?:[A-Z]\.\s*)+(?:and\s+)?[,;]?\s*){1,8}[:.]\s*"
TRAILING_VENUE = r"(?i)\s*(?:in:?\s+proc\w*|in:?\s+|proceedings\b|journal\b|arxiv[:\s]|doi[:\s]|pp\.\s*\d+|vol\.\s*\d+|\(\d{4}\)).*$"
UNCLEANED = r"(?i)(proceedings\b|\bin:\s|\bpp\.|\bvol\.|\bdoi\b|arxiv|\b\d+\(\d+\)|\b\d+\s*[-–]\s*\d+\b)"
CLAUSE = r"\s*[:;—–]\s*|\s+-\s+"
# Shape of a phrase where no tagger is at hand.
PHRASE = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}|[a-z]+(?:\s+[a-z]+){0,3}(?=\s+(?:is|are|was|were|can|will|of|for|in)\b))"
ARROW = " › "


def _out(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """Rows in the common columns; what is not given is null, the frequency 1."""
    given = {"frequency": F.lit(1), "source": F.lit(source), **given}
    return rows.select(*[given.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()])


def _first_of_name(rows: DataFrame, *place: str) -> DataFrame:
    """The first row of each document's lower-case name, by place."""
    rest = [c for c in rows.columns if c != "doc_id"]
    first = rows.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("r"))
    return first.select("doc_id", "r.*")


def _prose(corpus) -> DataFrame:
    return corpus.blocks.where(F.lower("type").isin(PROSE) & (F.trim("text") != ""))


def shorten_title(title: Column, most: int = 8) -> Column:
    """A title's first clause if it is short enough, else its first words."""

    def shortened(flat: Column) -> Column:
        head = F.trim(F.split(flat, CLAUSE)[0])
        cut = F.array_join(F.slice(T.words_of(flat), 1, most), " ")
        return F.when(T.word_count(flat) <= most, flat).when((head != "") & (T.word_count(head) <= most), head).otherwise(cut)

    return T.bound(T.squeezed(F.coalesce(title, F.lit(""))), shortened)


def headings(corpus, depth: int = 3, paths: bool = True, boilerplate: bool = False) -> DataFrame:
    """Section titles without numbers, and paths of up to ``depth`` titles where sections are nested."""
    sections = corpus.sections.withColumn("clean", T.normalise_phrase(T.strip_numbering(F.col("title"))))
    dull = F.lower("clean").isin(T.BOILERPLATE)
    usable = T.is_acceptable_phrase(F.col("clean"), 8) & (F.lit(boilerplate) | ~dull)
    place = ("level", "section_id", "turn")
    named = sections.where(usable).select("doc_id", F.col("clean").alias("name"), F.lit("heading").alias("kind"), "section_id", "level", F.lit(0).alias("turn"), F.col("clean").alias("tau"))
    if paths:
        ways = tree.title_paths(sections, "clean")
        ways = sections.where(usable).select("doc_id", "section_id", "level").join(ways, ["doc_id", "section_id"])
        steps = F.filter("path", lambda p: p != "")
        kept = steps if boilerplate else F.filter(steps, lambda p: ~F.lower(p).isin(T.BOILERPLATE))
        way = ways.withColumn("w", F.when(F.size(kept) > 0, kept).otherwise(steps)).withColumn("w", F.slice("w", -F.least(F.lit(depth), F.size("w")), depth)).where(F.size("w") > 1)
        named = named.unionByName(way.select("doc_id", F.array_join("w", ARROW).alias("name"), F.lit("heading_path").alias("kind"), "section_id", "level", F.lit(1).alias("turn"), F.array_join(F.reverse("w"), ", ").alias("tau")))
    return _out(_first_of_name(named, *place), "heading", metadata=F.create_map(F.lit("level"), F.col("level").cast("string")))


def is_short_form(text: str) -> bool:
    """Two to ten characters of an acronym's kind, two capitals at least."""
    return 2 <= len(text) <= 10 and re.fullmatch(r"[A-Za-z][A-Za-z0-9.\-/]*", text) is not None and sum(c.isupper() for c in text) >= 2


def long_form(short: str, words: list[str]) -> str | None:
    """The shortest run of last words that opens with the short form's first character and holds all in order."""
    chars = [c.lower() for c in short if c.isalnum()]
    for n in range(len(chars), min(2 * len(chars) + 3, len(words)) + 1):
        run = words[-n:] if n else []
        rest = iter(" ".join(run).lower())
        if chars and run[0][:1].lower() == chars[0] and all(c in rest for c in chars):
            return " ".join(run)
    return None


def plausible(expansion: str, short: str) -> bool:
    """About as long as the short form, within one clause."""
    words, n = expansion.split(), sum(c.isalnum() for c in short)
    return n <= len(words) <= 2 * n + 2 and not re.search(r"[.!?;]", expansion[:-1]) and not any(w.lower() in CONNECTIVES for w in words)


def short_forms(text: str) -> list[dict]:
    """Short forms in brackets and their expansions. Words and sentence ends are found once for the whole text."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    words = [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z][A-Za-z0-9.\-']*", text)]
    starts, out = [w[0] for w in words], []
    for m in re.finditer(r"\(([^)]{2,40})\)", text):
        short = m[1].strip()
        if not is_short_form(short):
            continue
        i = bisect.bisect_left(ends, m.start()) - 1
        if i >= 0 and not text[ends[i] : m.start()].strip():
            i -= 1
        begin = ends[i] if i >= 0 else 0
        near = words[bisect.bisect_left(starts, begin) : bisect.bisect_left(starts, m.start())]
        found = long_form(short, [w for _, w in near])
        if found and plausible(found, short):
            out.append({"short": short, "long": found})
    return out


@F.pandas_udf(ArrayType(StructType().add("short", StringType()).add("long", StringType())))
def _short_forms(text: pd.Series) -> pd.Series:
    return text.map(short_forms)


def glossary(corpus, statements: bool = True, terms: bool = True, acronyms: bool = True) -> DataFrame:
    """Defined terms: named statements first, then entries of term lists, then expanded short forms."""
    blocks = corpus.blocks.where(F.trim("text") != "").withColumn("kind", F.lower("type")).withColumn("text", F.trim("text"))
    given = F.trim(F.coalesce(F.col("name"), F.lit(""))) if "name" in blocks.columns else F.lit("")
    parts = []
    common = lambda stage, at, name, kind, description, alias=F.lit(None): ["doc_id", "section_id", F.lit(stage).alias("stage"), "ord", at.alias("at"), name.alias("name"), kind.alias("kind"), description.alias("description"), alias.cast("string").alias("alias")]
    if statements:
        text, typed = F.col("text"), F.col("kind").isin(STATEMENTS)
        body = F.regexp_replace(text, STATEMENT_LEAD, "")
        bracket, subject = F.regexp_extract(text, STATEMENT_LEAD, 3), F.regexp_extract(F.split(body, r"(?<=[.;])\s", 2)[0], SUBJECT, 1)
        led = text.rlike(STATEMENT_LEAD) & (typed | (F.char_length("text") <= STATEMENT_CHARS))
        own = typed & (given != "")
        name = F.when(own, given).when(led & (bracket != ""), bracket).when(led & typed & (subject != ""), subject)
        kind = F.when(~own & led & (bracket != ""), F.lower(F.regexp_extract(text, STATEMENT_LEAD, 1))).otherwise(F.col("kind"))
        parts.append(blocks.select(*common(0, F.lit(0), name, kind, F.when(own, text).otherwise(body))).where("name is not null"))
    if terms:
        lists = corpus.sections.where(F.col("title").rlike(TERM_SECTION)).select("doc_id", "section_id").distinct()
        lines = blocks.join(lists, ["doc_id", "section_id"], "left_semi").select("doc_id", "section_id", "ord", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("at", "line")).where(F.col("line").rlike(ENTRY))
        parts.append(lines.select(*common(1, F.col("at"), F.regexp_extract("line", ENTRY, 1), F.lit("term"), F.regexp_extract("line", ENTRY, 2))))
    if acronyms:
        bracketed = blocks.where(F.col("kind").isin(PROSE) & F.contains("text", F.lit("(")))
        found = bracketed.select("doc_id", "section_id", "ord", F.posexplode(_short_forms("text")).alias("at", "x"))
        parts.append(found.select(*common(2, F.col("at"), F.col("x.long"), F.lit("acronym"), F.concat(F.lit("also written "), "x.short"), F.col("x.short"))))
    if not parts:
        return _out(blocks.where("false"), "glossary", name=F.lit(""), kind=F.lit(""))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("name", T.normalise_phrase(F.col("name"))).where(T.is_acceptable_phrase(F.col("name"), 6))
    described = F.create_map(F.lit("description"), F.substring(T.normalise_phrase(F.col("description")), 1, 400), F.lit("alias"), F.col("alias"))
    return _out(_first_of_name(rows, "stage", "ord", "at"), "glossary", tau=F.col("name"), metadata=F.map_filter(described, lambda _, v: v.isNotNull() & (v != "")))


def clean_title(raw: Column, least: int = 3) -> Column:
    """Title of a reference entry without number, authors and venue; empty if traces of these remain."""

    def shortened_by(pattern: str) -> Callable[[Column], Column]:
        long_enough = lambda cut: F.when(T.word_count(cut) >= least, cut)
        return lambda whole: F.coalesce(T.bound(F.regexp_replace(whole, pattern, ""), long_enough), whole)

    flat = F.regexp_replace(T.squeezed(F.coalesce(raw, F.lit(""))), LEADING_MARKER, "")
    for pattern in (AUTHOR_RUN, TRAILING_VENUE):
        flat = T.bound(flat, shortened_by(pattern))
    flat = F.regexp_replace(flat, r"^[ .,;:]+|[ .,;:]+$", "")
    return T.bound(flat, lambda f: F.when(f.rlike(UNCLEANED), "").otherwise(f))


def bibliography(corpus, words: tuple[int, int] = (3, 30), long: int = 12, most: int = 8, shorten: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """Titles of reference entries; long ones are shortened, their whole title is what is embedded."""
    rows = corpus.bibliography.withColumn("full", clean_title(F.col("title"))).where(T.word_count(F.col("full")).between(*words))
    brief = (shorten or shorten_title)(F.col("full"), most)
    name = F.when((T.word_count(F.col("full")) > long) & (T.word_count(brief) >= 2), brief).otherwise(F.col("full"))
    rows = rows.withColumn("name", T.normalise_phrase(name)).where("name <> ''")
    facts = F.create_map(*[c for n in ("bib_id", "full", "label", "year", "citations") for c in (F.lit(n), F.col(n).cast("string"))], F.lit("keywords"), F.array_join("keywords", ","))
    return _out(_first_of_name(rows, "ord"), "bibliography", kind=F.lit("paper_title"), tau=F.col("full"), metadata=F.map_filter(facts, lambda _, v: v.isNotNull() & (v != "")))


def phrases(corpus, least: int = 3, most: int = 400, absorbing: bool = True, tagger: language.Tagger | None = None) -> DataFrame:
    """Frequent phrases of a document, by a tagger or by shape, without names of persons; how many sections hold each.

    ``most`` a document is the feature's own limit, by frequency and name. A phrase of one section belongs to it.
    """
    prose = _prose(corpus)
    every = language.analyse(prose, PHRASE, tagger)
    found = language.noun_phrases(every, least).withColumnsRenamed({"text": "name", "n": "frequency"})
    if tagger is not None:
        people = every.where("kind = 'entity' and label = 'PERSON'").select("doc_id", F.lower("text").alias("low")).distinct()
        found = found.withColumn("low", F.lower("name")).join(people, ["doc_id", "low"], "left_anti").drop("low")
    if absorbing:
        found = candidates.absorb(found, keys=("doc_id",))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "name"))).where(F.col("r") <= most)
    spread = language.phrase_sections(ranked.select("doc_id", F.col("name").alias("text")), prose).withColumnRenamed("text", "name")
    ranked = ranked.join(spread, ["doc_id", "name"])
    df, n = F.greatest(F.lit(1), F.size("sections")), F.greatest(F.lit(1), F.col("n_sections"))
    idf = F.round(F.log1p(n / df) / F.log1p(n.cast("double")), 6)
    only = F.when((F.size("sections") == 1) & (F.get("sections", F.lit(0)) != ""), F.get("sections", F.lit(0)))
    facts = F.create_map(F.lit("section_df"), df.cast("string"), F.lit("idf"), idf.cast("string"), F.lit("nlp_backend"), F.lit(language.backend_name(tagger)))
    return _out(ranked.drop("section_id").withColumn("only", only), "nounphrase", kind=F.lit("noun_phrase"), frequency=F.col("frequency"), tau=F.col("name"), section_id=F.col("only"), metadata=facts)


def entities(corpus, least: int = 2, most: int = 200, tagger: language.Tagger | None = None, labels: tuple[str, ...] = language.LABELS) -> DataFrame:
    """Entities of the wanted labels; without a tagger short forms, as organisations."""
    found = language.named_entities(language.analyse(_prose(corpus), PHRASE, tagger), least, labels)
    rank = Window.partitionBy("doc_id").orderBy(F.desc("n"), "label", "text")
    ranked = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
    first = ranked.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", F.lower("text")).orderBy("r"))).where("again = 1")
    facts = F.create_map(F.lit("entity_label"), F.col("label"), F.lit("nlp_backend"), F.lit(language.backend_name(tagger)))
    return _out(first.withColumnRenamed("text", "name"), "ner", kind=F.concat(F.lit("entity_"), F.lower("label")), frequency=F.col("n"), tau=F.col("name"), metadata=facts)


def injected(call: Callable[[str], str], prompt: Callable[..., str], fallback: Callable[..., Column]) -> Callable[..., Column]:
    """A column function from a model's call: its reply without quotes, or the fallback where it fails or says nothing."""

    @F.pandas_udf("string")
    def ask(question: pd.Series) -> pd.Series:
        def one(text):
            try:
                return " ".join(str(call(text) or "").split()).strip('"')
            except Exception:  # a failing model costs quality only
                return ""

        return question.map(one)

    def said(first: Column, *rest) -> Column:
        reply = ask(prompt(first, *rest))
        return F.when(reply != "", reply).otherwise(fallback(first, *rest))

    return said


def get_abstractor(name: str | None = None) -> dict[str, Callable[..., Column]]:
    """describe and shorten by name; only the rule-based one has a name, models are injected."""
    if name in (None, "", "null", "none", "off"):
        return {"describe": describe_formula, "shorten": shorten_title}
    raise ValueError(f"unknown abstractor {name!r}; inject a model's call")


def model_abstractor(call: Callable[[str], str]) -> dict[str, Callable[..., Column]]:
    """describe and shorten by a model, with the rules to fall back on."""
    about = lambda latex, context: F.concat(F.lit("Name in at most six words what this formula stands for.\n\nFormula: "), latex, F.lit("\nText around it: "), F.substring(F.coalesce(context, F.lit("")), 1, 500))
    title = lambda text, most: F.concat(F.lit(f"Name the core concept of this title in at most {most} words.\n\nTitle: "), text)
    short = injected(call, title, shorten_title)
    return {"describe": injected(call, about, describe_formula), "shorten": lambda text, most=8: F.when(T.word_count(text) <= most, text).otherwise(short(text, most))}


def describe_formula(latex: Column, context: Column | None = None) -> Column:
    """Up to three things a formula signals: 'first over second and third'; empty if none."""
    hits = F.array_compact(F.array(*[F.when(latex.rlike(pattern), label) for pattern, label in SIGNALS]))
    top = F.slice(F.array_distinct(hits), 1, 3)
    many = F.concat(F.get(top, F.lit(0)), F.lit(" over "), F.array_join(F.slice(top, 2, 2), " and "))
    return F.when(F.trim(F.coalesce(latex, F.lit(""))) == "", "").when(F.size(top) > 1, many).otherwise(F.coalesce(F.get(top, F.lit(0)), F.lit("")))


def equations(corpus, least: int = 8, most: int = 200, merge: bool = True, describe: Callable[[Column, Column], Column] | None = None, around: int = 300) -> DataFrame:
    """Descriptions of a document's formulas with their number and first example.

    ``describe`` takes formula and context, the ends of the prose before and after; the default needs no context, and
    then no window is formed. ``most`` a document is the feature's own limit.
    """
    maths = F.lower("type").isin(MATH) & (F.trim("text") != "")
    rows = corpus.blocks.withColumn("context", F.lit(""))
    order = Window.partitionBy("doc_id").orderBy("ord")
    if describe is not None:
        prose = F.when(F.lower("type").isin(PROSE) & (F.trim("text") != ""), F.col("text"))
        before = F.last(prose, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first(prose, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        rows = rows.withColumn("context", F.trim(F.concat_ws(" ", F.when(F.char_length(before) > around, F.substring(before, -around, around)).otherwise(before), F.substring(after, 1, around))))
    rows = rows.where(maths).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).withColumn("latex", F.trim("text")).where(F.char_length("latex") >= least)
    said = (describe or describe_formula)(F.col("latex"), F.col("context"))
    rows = rows.withColumn("name", T.normalise_phrase(said)).where(T.is_acceptable_phrase(F.col("name"), 8))
    example = F.min_by(F.struct("name", "section_id", "block_id", F.substring("latex", 1, 400).alias("latex"), F.substring(L.readable(F.col("latex")), 1, 200).alias("readable")), "ord")
    out = rows.groupBy("doc_id", F.lower("name").alias("key")).agg(F.count("*").alias("n"), example.alias("x")).select("doc_id", "n", "x.*")
    facts = F.create_map(F.lit("example_object_id"), F.col("block_id"), F.lit("example_latex"), F.col("latex"), F.lit("example_readable"), F.col("readable"))
    return _out(out, "equation", kind=F.lit("equation_abstraction"), frequency=F.col("n") if merge else F.lit(1), tau=F.col("name"), metadata=facts)


GENERATORS: dict[str, Callable[..., DataFrame]] = {"heading": headings, "glossary": glossary, "bibliography": bibliography, "nounphrase": phrases, "ner": entities, "equation": equations}


def generate(corpus, sources: Iterable[str] | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """Candidates of all named generators; an unknown name raises."""
    names = [s.strip().lower() for s in sources] if sources is not None else list(GENERATORS)
    unknown = set(names) - set(GENERATORS)
    if unknown or not names:
        raise ValueError(f"unknown concept sources {sorted(unknown)}; known are {sorted(GENERATORS)}")
    rows = [GENERATORS[n](corpus, **(options or {}).get(n, {})) for n in names]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
