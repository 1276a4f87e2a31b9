"""Text scalars as column expressions; patterns are those both Java and RE2 read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither open nor close a phrase.
STOPWORDS = (
    "a an the this that these those it its it's their there here we our us you your i he she they them his her hers him who whom whose which what "
    "when where why how and or but nor for so yet if then than as at by from in into of on onto to with without within about above below over under "
    "again further once all any both each few more most other some such no not only own same too very can will just don should now is are was were "
    "be been being has have had having do does did doing also thus hence however therefore moreover furthermore whereas while although though "
    "because since unless until upon among between during before after one two three four five six seven eight nine ten first second third next "
    "last et al fig figure table section eq equation ref cf e.g i.e etc vs"
).split()

# Headings that name a part of a document.
BOILERPLATE = (
    "introduction|abstract|conclusion|conclusions|references|bibliography|acknowledgements|acknowledgments|appendix|appendices|related work|background|"
    "discussion|summary|future work|outline|overview|notation|preliminaries|contents|table of contents|index|glossary|nomenclature"
).split("|")

# Patterns of words, short forms, labels.
WORD = r"[A-Za-z][A-Za-z0-9'\-]*"
ACRONYM = r"\b[A-Z]{2,6}[0-9]{0,2}\b"
BARE_ACRONYM = r"\b[A-Z]{3,}[0-9]*\b"
BRACKETED_ACRONYM = r"\(\s*[A-Z][A-Z0-9\-]{1,}\s*\)"
COPULA = r"(?i)\b(?:is|are|was|were|be|been|being)\b"
CITATION = r"\[\s*\d+\s*(?:[,;-]\s*\d+\s*)*\]|\[[^\]]*\bet al\.?[^\]]*\]|\(\s*[A-Z][A-Za-z-]+\s+et\s+al\.?[^)]*\)"
FLOAT_REFERENCE = r"(?i)\b(?:figure|fig\.?|table|tab\.?|equation|eq\.?|section|sec\.?|algorithm|alg\.?|listing|appendix)\s*\.?\s*\d+"
NUMBERING = r"^\s*(?:\d+(?:\.\d+)*|[IVXLCivxlc]+|[A-Za-z])[.)]?\s+"
EDGE_MARKS = " \t\n\r.,;:!?()[]{}\"'`-–—/\\"
LABEL_WORDS = (30, 42)
# Constructions that tell of the document instead of its content, in order, and subjects that do.
BANNED = (
    "this section|the section|this chapter|the chapter|this paper|the paper|this article|the article|this work|the present work|the authors|"
    "we describe|we present|we propose|we introduce|we show|here we|is described|is presented|is discussed|is introduced|outlines|discusses|"
    "describes|presents|introduces|explains|summarises|summarizes|reviews|this study|the study|the current work|the following section"
).split("|")
DOCUMENT_SUBJECT = r"(?i)\b(?:this|the|our|these|present|current)\s+(?:sub)?(?:section|chapter|paper|article|work|study|report|manuscript|document|thesis)\b"
STRUCTURAL_WEIGHTS = {"glossary": 1.0, "heading": 1.0, "definition": 1.0, "theorem": 1.0, "bibliography": 0.7, "nounphrase": 0.5, "equation": 0.4, "ner": 0.3}
OTHER_WEIGHT = 0.3

_STOP_SQL = "|".join(w.replace(".", r"\.") for w in STOPWORDS)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words_of(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise_phrase(text: Column) -> Column:
    """White space collapsed, edge punctuation and edge stop words removed."""
    inner = F.regexp_replace(squeezed(text), r"^[ .,;:!?()\[\]{}\"'`–—/\\-]+|[ .,;:!?()\[\]{}\"'`–—/\\-]+$", "")

    def between(words: Column, content: Column) -> Column:
        first = F.array_position(content, F.lit(True))
        last = F.size(content) - F.array_position(F.reverse(content), F.lit(True)) + 1
        return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), (last - first + 1).cast("int")), " ")).otherwise("")

    content = lambda words: F.transform(words, lambda w: ~F.lower(w).isin(STOPWORDS))
    return bound(words_of(inner), lambda words: bound(content(words), lambda c: between(words, c)))


def is_acceptable_phrase(text: Column, max_tokens: int = 5) -> Column:
    def judged(t: Column, words: Column) -> Column:
        letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
        n = F.size(words)
        upper = (F.upper(t) == t) & (F.lower(t) != t)
        return (
            t.isNotNull()
            & n.between(1, max_tokens)
            & F.exists(words, lambda w: ~F.lower(w).isin(STOPWORDS))
            & (letters >= F.greatest(F.lit(2.0), F.char_length(t) * 0.5))
            & ((n > 1) | (F.char_length(t) >= 4) | upper)
        )

    return bound(text, lambda t: bound(words_of(t), lambda words: judged(t, words)))


def strip_numbering(title: Column, depth: int = 6) -> Column:
    """Leading section numbers removed, repeatedly."""
    out = F.trim(title)
    for _ in range(depth):
        out = F.trim(F.regexp_replace(out, NUMBERING, ""))
    return out


def structural_weight(source: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in STRUCTURAL_WEIGHTS.items():
        out = F.when(source == name, F.lit(weight)).otherwise(out)
    return out


def banned_constructions(text: Column) -> Column:
    """Banned phrases in the order of their list, then subjects that name the document and overlap none of these."""
    whole = F.coalesce(text, F.lit(""))
    listed = F.array_compact(F.array(*[F.when(whole.rlike(r"(?i)\b" + phrase.replace(" ", r"\s+") + r"\b"), phrase) for phrase in BANNED]))
    subjects = F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(DOCUMENT_SUBJECT), F.lit(0)), lambda s: squeezed(F.lower(s))))
    new = F.filter(subjects, lambda s: ~F.exists(listed, lambda b: F.contains(b, s) | F.contains(s, b)))
    return F.concat(listed, F.transform(new, lambda s: F.concat(F.lit("document subject '"), s, F.lit("'"))))


def tier_problems(label: Column, abstraction: Column, summary: Column, words: tuple[int, int] = LABEL_WORDS) -> Column:
    """struct(label, abstraction, summary) of problem codes; a tier that is null or empty is absent, a blank one empty."""

    def tier(text: Column, problems: Column) -> Column:
        return F.when(text.isNull() | (text == ""), F.array(F.lit("absent"))).when(squeezed(text) == "", F.array(F.lit("empty"))).otherwise(problems)

    return F.struct(tier(label, label_problems(label, words, banned=True)).alias("label"), tier(abstraction, banned_constructions(abstraction)).alias("abstraction"), tier(summary, banned_constructions(summary)).alias("summary"))


def label_problems(text: Column, words: tuple[int, int] = LABEL_WORDS, banned: bool = False) -> Column:
    """Array of problem codes of a label: empty, below, above, (banned constructions,) acronym, copula, citation, float."""
    n = word_count(text)
    found = [
        F.when(n < words[0], "below"),
        F.when(n > words[1], "above"),
        F.when(text.rlike(BRACKETED_ACRONYM), "acronym"),
        F.when(text.rlike(COPULA), "copula"),
        F.when(text.rlike(CITATION), "citation"),
        F.when(text.rlike(FLOAT_REFERENCE), "float"),
    ]
    codes = F.array_compact(F.array(*found))
    if banned:
        codes = F.concat(F.array_compact(F.array(*found[:2])), banned_constructions(text), F.array_compact(F.array(*found[2:])))
    return F.when(n == 0, F.array(F.lit("empty"))).otherwise(codes)


def bare_acronyms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BARE_ACRONYM), F.lit(0))))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def coverage_curve(fraction: Column) -> Column:
    """0.1 to a fraction of 0.01, rising to 1 at 0.2, flat to 0.4, falling to 0.3 at 0.9."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    return F.when(f <= 0.01, 0.1).when(f < 0.2, 0.1 + (f - 0.01) * 0.9 / 0.19).when(f <= 0.4, 1.0).when(f < 0.9, 1.0 - (f - 0.4) * 0.7 / 0.5).otherwise(0.3)
