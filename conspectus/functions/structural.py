"""Classes of titles that name a part of a document instead of a topic."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exact titles by class.
EXACT = {
    "bibliography": "references, reference, bibliography, works cited, literature, literature cited, list of references, literaturverzeichnis, literatur, quellen, quellenverzeichnis, bibliographie",
    "acknowledgement": "acknowledgement, acknowledgements, acknowledgment, acknowledgments, danksagung, danksagungen",
    "funding": "funding, funding information, funding statement, financial support, foerderung, finanzierung",
    "competing-interests": "conflict of interest, conflicts of interest, competing interests, competing interest, declaration of competing interest, declaration of competing interests, declaration of interest, interessenkonflikt",
    "author-contributions": "author contributions, author contribution, authors contributions, contributions, credit authorship contribution statement, authorship contribution statement, autorenbeitraege",
    "data-availability": "data availability, data availability statement, code availability, availability of data and materials",
    "ethics": "ethics statement, ethical statement, ethics approval, ethics declaration, ethical considerations, ethikerklaerung",
    "table-of-contents": "contents, table of contents, inhalt, inhaltsverzeichnis",
    "list-of-floats": "list of figures, list of tables, list of abbreviations, list of symbols, list of algorithms, nomenclature, abbreviations, abbildungsverzeichnis, tabellenverzeichnis, abkuerzungsverzeichnis, symbolverzeichnis",
    "index": "index, subject index, author index, stichwortverzeichnis",
    "supplementary": "supplementary material, supplementary materials, supplementary information, supporting information, electronic supplementary material",
    "front-matter": "about the author, about the authors, copyright, copyright notice, imprint, impressum, dedication, widmung, preface, vorwort, foreword, geleitwort, colophon, kolophon, title page, titelblatt",
    "metadata-block": "keywords, key words, keyword, index terms, schlagworte, schlagwoerter, stichworte, article info, article information, team name, teamname, subtasks, subtask, author, authors, autoren, affiliation, affiliations, correspondence, corresponding author",
}
# Opening words by class, and patterns.
PREFIXES = (("appendix", "appendix"), ("appendix", "appendices"), ("appendix", "anhang"), ("supplementary", "supplementary"))
FLOAT = r"^(box|figure|fig|table|tab|listing|algorithm|alg|equation|eq|scheme|plate)\s*\.?\s*\d+[a-z]?$"
ARTIFACT = r"^(#\d+|\d+(\.\d+)*|[^\p{L}\p{N}_]+)$"
ORDINAL = r"^(?:\(?\d+(?:\.\d+)*\)?[.):]?\s+|\(?(?:[ivxlcdm]+|[a-z])\)?[.):]\s+)"
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "ae", "Ö": "oe", "Ü": "ue"}


@F.pandas_udf(T.StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """NFKD with combining marks removed."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def normalise_title(title: Column) -> Column:
    """Comparison form: lower case, umlauts spelled out, accents, ordinal and edge punctuation removed."""
    out = F.trim(F.coalesce(title, F.lit("")))
    for mark, spelled in UMLAUTS.items():
        out = F.replace(out, F.lit(mark), F.lit(spelled))
    out = without_accents(F.lower(out))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), ORDINAL, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[ .:;,\-–—_]+|[ .:;,\-–—_]+$", ""), r"\s+", " "))


def structural_class(normalised: Column, is_appendix: Column | None = None) -> Column:
    """Class of a normalised title, null for content. Artifacts and floats are told first, the flag last."""
    out = F.when(normalised == "", "untitled").when(normalised.rlike(ARTIFACT), "artifact").when(normalised.rlike(FLOAT), "float")
    for name, titles in EXACT.items():
        out = out.when(normalised.isin(titles.split(", ")), name)
    for name, word in PREFIXES:
        out = out.when(normalised.rlike(rf"^{word}\b"), name)
    return out.when(is_appendix, "appendix") if is_appendix is not None else out


# Text that is nothing but commands with their arguments.
LATEX_ONLY = r"^(?:\s*\\[A-Za-z@]+\s*(?:\[[^\]]*\])?(?:\{[^{}]*\})*)+\s*$"


def is_latex_artifact(text: Column) -> Column:
    """Whether a text is blank, or LaTeX commands that leave under three letters."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    letters = F.regexp_replace(F.regexp_replace(plain, r"\\[A-Za-z]+|[{}\[\]$\\]", " "), "[^A-Za-z]", "")
    return (plain == "") | (plain.rlike(LATEX_ONLY) & (F.char_length(letters) < 3))
