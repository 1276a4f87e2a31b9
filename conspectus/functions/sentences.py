"""Rule-based sentence splitting, sanitising and hashing embeddings, in Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that do not end a sentence.
NEVER_FINAL = frozenset(
    "e.g i.e cf viz vs fig figs eq eqs sec secs ch chs no nos vol vols pp p resp approx ref refs tab tabs alg algs def defs thm lem cor prop rem ex app appx w.r.t s.t i.i.d a.k.a dr prof mr mrs ms st jr sr dept univ jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split()
)
# A boundary is closing punctuation, space, and what may open a sentence.
CLOSING, OPENING = r"""["')\]]*""", r"""["'(\[]*[A-Z0-9]"""


def boundary() -> str:
    """Pattern of what parts two sentences: closing quotes and space after a mark, unless a look back finds a reason against.

    Reasons: a number, an initial, a single letter or an abbreviation before the full stop; under two characters so far.
    """
    short = "|".join(sorted((w.replace(".", r"\.") for w in NEVER_FINAL), key=lambda w: (-len(w), w)))
    reasons = (r"\d\.", r"(?:^|\s)[A-Z]\.", rf"(?:^|[^A-Za-z.])\.{{0,3}}(?i:{short}|[a-z])\.{{1,4}}")
    return rf"(?<=.[.!?]){''.join(f'(?<!{r})' for r in reasons)}{CLOSING}\s+(?={OPENING})"


def sentences(text: Column, min_chars: int = 2) -> Column:
    """Sentences in order; a blank line always parts them."""
    pattern = boundary()
    parts = lambda block: F.split(F.trim(F.regexp_replace(block, r"(?U)\s+", " ")), pattern, -1)
    every = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n", -1), parts))
    return F.filter(F.transform(every, lambda s: F.trim(s)), lambda s: F.char_length(s) >= max(1, min_chars))


# Characters that look like plain ones, after compatibility folding.
_FOLD = str.maketrans(
    {c: "-" for c in "‐‑‒–—―−﹘﹣－·•"}
    | {c: "'" for c in "‘’‚‛′‹›"}
    | {c: '"' for c in "“”„‟″«»"}
    | {"…": "...", "⁄": "/", "©": "(c)", "®": "(r)", "™": "(tm)"}
)


class _Plain(dict):
    """What a character becomes, looked up once: folded, dropped or turned into a space."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = out = _FOLD.get(code, "" if kind in ("Cf", "Co", "Cs") else " " if kind == "Zs" else chr(code))
        return out


_PLAIN = _Plain()
_CONTROLS, _LINES, _SPACES = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]"), re.compile(r"\n{3,}"), re.compile(r"[ \t]{2,}|\t")


def sanitise(text: str | None, collapse: bool = True) -> str | None:
    """NFKC, look-alikes folded, invisible characters dropped, control characters and odd spaces turned into spaces.

    Line breaks stay; ``collapse`` makes runs of spaces one and leaves one empty line at most. ASCII has nothing to fold.
    """
    if text is None:
        return None
    out = text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_PLAIN)
    out = _CONTROLS.sub(" ", out)
    if collapse:
        out = _LINES.sub("\n\n", _SPACES.sub(" ", out))
    return out.strip()


@F.pandas_udf(T.StringType())
def sanitised(text: pd.Series) -> pd.Series:
    return text.map(sanitise)


_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9_\-]*|\d+|\\[A-Za-z]+")


class _Hashes(dict):
    """Hashes of features, each made once while it is held; at ``most`` they are forgotten and made anew."""

    def __init__(self, salt: str, kind: str, most: int = 1 << 14):
        self.start, self.most = f"{salt}\x1f{kind}".encode(), most

    def __missing__(self, feature: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[feature] = h = hashlib.blake2b(self.start + feature.encode(), digest_size=8).digest()
        return h


class _Weights(dict):
    def __missing__(self, n: int) -> float:
        self[n] = w = 1.0 + math.log(n)
        return w


_known, _WEIGHTS = functools.lru_cache(12)(_Hashes), _Weights()


def hash_vector(text: str | None, dim: int = 256, gram: int = 4, salt: str = "conspectus/v1") -> np.ndarray:
    """Signed feature hashing of words, word pairs and character grams, weight 1 + ln(count), unit length."""
    out = np.zeros(dim)
    low = (text or "").lower()
    if not low.strip():
        return out
    words = _TOKEN.findall(low)
    flat = re.sub(r"\s+", " ", low)
    grams = [flat[i : i + gram] for i in range(len(flat) - gram + 1)]
    kinds = (("w:", Counter(words)), ("b:", Counter(map("_".join, zip(words, words[1:], strict=False)))), ("c:", Counter(grams)))
    made = b"".join(h for kind, counts in kinds for h in map(_known(salt, kind).__getitem__, counts))
    hashes = np.frombuffer(made, ">u8").astype(np.uint64)
    weights = np.fromiter((w for _, counts in kinds for w in map(_WEIGHTS.__getitem__, counts.values())), np.float64, len(hashes))
    out = np.bincount((hashes % np.uint64(dim)).astype(np.int64), np.where(hashes >> np.uint64(63), weights, -weights), dim)
    length = math.sqrt(float(out @ out))
    return out / length if length else out


def hashing_embedder(dim: int = 256, gram: int = 4, salt: str = "conspectus/v1"):
    """A column function: text to array<double>."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda s: hash_vector(s, dim, gram, salt).tolist())

    return embed


_SUSPECT_KINDS = ("Cf", "Co", "Cs", "Zs")


def suspects(text: str | None) -> list[str]:
    """Code points and names of characters that sanitising folds or drops, in order of first sight."""
    found = dict.fromkeys(c for c in text or "" if ord(c) > 127 and (ord(c) in _FOLD or unicodedata.category(c) in _SUSPECT_KINDS))
    return [f"U+{ord(c):04X} {unicodedata.name(c, 'UNNAMED')}" for c in found]


@F.pandas_udf(T.ArrayType(T.StringType()))
def suspect_characters(text: pd.Series) -> pd.Series:
    return text.map(suspects)


def sanitised_fields(rows, *fields: str):
    """Rows with these fields sanitised and ``warnings``: one for each field in which something was folded or dropped."""
    found = {f: suspect_characters(F.col(f)) for f in fields}
    told = rows.withColumns({f"__{f}": c for f, c in found.items()})
    warnings = F.array_compact(F.array(*[F.when(F.size(f"__{f}") > 0, F.concat(F.lit(f"{f}: normalised "), F.array_join(f"__{f}", ", "))) for f in fields]))
    return told.withColumn("warnings", warnings).withColumns({f: F.coalesce(sanitised(F.col(f)), F.lit("")) for f in fields}).drop(*[f"__{f}" for f in fields])
