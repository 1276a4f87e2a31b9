"""Secret scans: base patterns and a randomness test battery, in DataFrame functions only.

Base kinds are found by pattern. Other tokens of at least ``LEAST`` characters are tested: their encoding is
inferred (hex, base32, base64; decimal numbers are none), and in the encoding's alphabet of K symbols

* chi-squared compares the symbol counts with uniform ones,
* a runs test compares the changes between the alphabet's halves with their number in a random order,
* serial correlation compares each symbol with the next.

Fisher's method combines the three into the chance of such a token if it were random; below ``REJECT`` it is not. A
token is then a discovery if its chi-squared statistic is too small for text: for text with a divergence of
``LAMBDA`` per symbol the statistic grows with length, so the p-value Phi((X - (K - 1 + n L)) / sqrt(2 (K - 1) + 4 n L))
of a short token is weak however random it looks. Discoveries are controlled at the rate ``FDR`` within a text
by the weighted Benjamini-Hochberg rule, with weights in proportion to length. The rate holds within a text and not
over a table, so that what is found in a text does not depend on the other rows it is scanned with.

Defined results: a null text is an empty one; positions are in code points; a document without spans has the empty
string; added spans do not overlap base spans; texts are scanned whole; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried

# The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so shorter ones need no look
HEX = r"[0-9a-f]{24,}"
LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"
KINDS = ("assign", "access", "hex", "random")

# (encoding, pattern, symbols in order, divergence of text per symbol)
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "", 0.0),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.0),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.8),
    ("base64", r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1.5),
)
REJECT = 0.001
FDR = 0.05
_BLOCK = 64


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, add, zero: Column) -> Column:
    """``add`` of all the entries before each entry.

    By blocks of blocks, whose totals are computed once, so that an array of n entries costs n (n / 8192 + 64) steps.
    """
    whole = lambda part: F.aggregate(part, zero, add)

    def cut(entries):
        count = F.ceil(F.size(entries) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: whole(F.slice(entries, b * _BLOCK + 1, F.lit(_BLOCK))))

    def part(i):
        return F.floor(i / _BLOCK).cast("int")

    def entry(entries, blocks, tops, i):
        top, block = part(part(i)), part(i)
        rest = F.concat(F.slice(tops, F.lit(1), top), F.slice(blocks, top * _BLOCK + 1, block % _BLOCK), F.slice(entries, block * _BLOCK + 1, i % _BLOCK))
        return whole(rest)

    def of(entries, blocks):
        return bound(cut(blocks), lambda tops: F.transform(F.sequence(F.lit(0), F.size(entries) - 1), lambda i: entry(entries, blocks, tops, i)))

    some = bound(values, lambda entries: bound(cut(entries), lambda blocks: of(entries, blocks)))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<bigint>"))


def prefix_sums(steps: Column) -> Column:
    return before(steps, lambda a, x: a + x, F.lit(0).cast("long"))


def apart(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span; both have start and end, and no two tokens overlap.

    Both are sorted together: a token meets the greatest end of the base spans that start before its own end.
    """
    event = lambda at, order, end, x: F.struct(at.alias("at"), F.lit(order).alias("order"), end.alias("end"), F.when(F.lit(order == 0), x).alias("token"))
    none = F.lit(-1).cast("long")
    first = F.transform(tokens, lambda x: event(x["end"], 0, none, x))
    # of the token's type, for both sides of the concatenation
    second = lambda of: F.transform(base, lambda x: event(x["start"], 1, x["end"], of[0]["token"]))
    events = bound(first, lambda own: F.array_sort(F.concat(own, second(own))))

    def free(sorted_events):
        ends = before(F.transform(sorted_events, lambda x: x["end"]), lambda a, x: F.greatest(a, x), none)
        both = F.zip_with(sorted_events, ends, lambda x, e: F.struct(x["token"].alias("token"), x["order"].alias("order"), e.alias("e")))
        return F.transform(F.filter(both, lambda x: (x["order"] == 0) & (x["e"] <= x["token"]["start"])), lambda x: x["token"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), bound(events, free)).otherwise(tokens)


def located(df: DataFrame, text: str, kind: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Adds ``out``: array of (start, rank, kind, end, value) of the pattern's matches; value is the group."""
    found, steps, heads, at = f"__m_{kind}", f"__s_{kind}", f"__h_{kind}", f"__p_{kind}"
    df = df.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    if group:
        df = df.withColumn(f"__g_{kind}", F.when(F.size(found) > 0, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>")))
    # lengths of what lies before each match; with the matches' own lengths they give all positions
    lengths = F.transform(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)), lambda x: F.char_length(x).cast("long"))
    df = df.withColumn(heads, F.when(F.size(found) > 0, lengths).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(steps, F.zip_with(heads, found, lambda h, m: h + F.char_length(m)))
    df = df.withColumn(at, prefix_sums(F.col(steps)))
    values = F.col(f"__g_{kind}") if group else F.col(found)
    row = F.transform(
        F.arrays_zip(F.col(at).alias("at"), F.col(heads).alias("head"), F.col(found).alias("match"), values.alias("value")),
        lambda x: F.struct(
            (x["at"] + x["head"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
            (x["at"] + x["head"] + F.char_length(x["match"])).alias("end"), x["value"].alias("value"),
        ),
    )
    return df.withColumn(out, row).drop(found, steps, heads, at, f"__g_{kind}")


def phi(z: Column) -> Column:
    """Normal distribution function, within 2e-4."""
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def battery(tokens: Column) -> Column:
    """Array of (start, end, n, p, random) of candidate tokens: discovery p-value and the combined randomness p-value."""

    def encoded(x):
        body = F.regexp_replace(x["value"], "=+$", "")
        name = F.lit(None).cast("string")
        for encoding, pattern, _, _ in reversed(ENCODINGS):
            name = F.when(body.rlike(pattern), F.lit(encoding)).otherwise(name)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), body.alias("body"), name.alias("encoding"))

    def indexed(x):
        symbols = F.lit("")
        divergence = F.lit(0.0)
        for encoding, _, alphabet, value in ENCODINGS:
            symbols = F.when(x["encoding"] == encoding, F.lit(alphabet)).otherwise(symbols)
            divergence = F.when(x["encoding"] == encoding, F.lit(value)).otherwise(divergence)
        body = F.when(x["encoding"] == "hex", F.lower(x["body"])).otherwise(F.translate(x["body"], "-_", "+/"))
        order = F.transform(F.split(body, ""), lambda c: F.instr(symbols, c).cast("double") - 1.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.char_length(x["body"]).cast("double").alias("n"), F.char_length(symbols).cast("double").alias("k"), divergence.alias("l"), F.filter(order, lambda v: v >= 0).alias("v"))

    def measured(x):
        n, k, v = x["n"], x["k"], x["v"]
        zero = F.lit(0.0)
        squares = F.aggregate(F.transform(F.array_distinct(v), lambda s: F.pow(F.size(F.filter(v, lambda y: y == s)).cast("double"), F.lit(2.0))), zero, lambda a, y: a + y)
        high = F.aggregate(v, zero, lambda a, y: a + F.when(y >= k / 2, 1.0).otherwise(0.0))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.aggregate(pairs, zero, lambda acc, p: acc + F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0))
        products = F.aggregate(pairs, zero, lambda acc, p: acc + (p["a"] - (k - 1) / 2) * (p["b"] - (k - 1) / 2))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), k.alias("k"), x["l"].alias("l"), (k * squares / n - n).alias("chi"), high.alias("high"), (changes + 1.0).alias("runs"), products.alias("serial"))

    def tested(x):
        n, k, chi = x["n"], x["k"], x["chi"]
        df = k - 1.0
        cube = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        uniform = phi(-cube)
        low = n - x["high"]
        mean = 2.0 * x["high"] * low / n + 1.0
        variance = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        runs = F.when(variance > 0, 2.0 * phi(-F.abs((x["runs"] - mean) / F.sqrt(variance)))).otherwise(0.0)
        serial = 2.0 * phi(-F.abs(x["serial"] / ((k * k - 1.0) / 12.0 * F.sqrt(n - 1.0))))
        logs = sum((F.log(F.greatest(p, F.lit(1e-12))) for p in (uniform, runs, serial)), F.lit(0.0))
        random = F.exp(logs) * (1.0 - logs + logs * logs / 2.0)
        shift = n * x["l"]
        p = phi((chi - (df + shift)) / F.sqrt(2.0 * df + 4.0 * shift))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), p.alias("p"), random.alias("random"))

    named = F.filter(F.transform(tokens, encoded), lambda x: (x["encoding"] != "decimal") & (F.char_length(x["body"]) >= LEAST))
    return F.transform(F.transform(F.transform(named, indexed), measured), tested)


def discovered(tests: Column, rate: float = FDR, reject: float = REJECT) -> Column:
    """Tests whose weighted p-value passes the Benjamini-Hochberg line and that pass as random."""
    m = F.size(tests).cast("double")
    mean = F.aggregate(tests, F.lit(0.0), lambda a, x: a + x["n"]) / m
    weighted = bound(mean, lambda average: F.transform(tests, lambda x: F.struct((x["p"] * average / x["n"]).alias("q"), x["start"].alias("start"), x["end"].alias("end"), x["random"].alias("random"))))

    def passed(entries):
        count = F.size(entries).cast("double")
        ranked = F.transform(F.array_sort(entries), lambda x, i: F.when(x["q"] <= (i + 1).cast("double") / count * rate, x["q"]))
        line = F.coalesce(F.array_max(ranked), F.lit(-1.0))
        return bound(line, lambda most: F.filter(entries, lambda x: (x["q"] <= most) & (x["random"] >= reject)))

    return bound(weighted, passed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with base (array), added (array) and all spans of each row, in order of start and kind."""
    columns, work, _, names = carried(df, keep, "base", "added", "spans")
    rows = df.select(*columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = located(rows, "__text", "assign", ASSIGN, "__assign", 2)
    rows = located(rows, "__text", "access", ACCESS, "__access")
    rows = located(rows, "__text", "hex", HEX, "__hex")
    rows = located(rows, "__text", "random", TOKEN, "__token")
    plain = lambda a: F.transform(a, lambda x: F.struct(*[x[n].alias(n) for n in ("start", "rank", "kind", "end")]))
    secret = F.filter("__assign", lambda x: F.char_length(x["value"]) >= 6)
    rows = rows.withColumn("__base", F.array_sort(F.concat(plain(secret), plain(F.col("__access")), plain(F.col("__hex")))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,n:double,p:double,random:double>>")
    rows = rows.withColumn("__apart", apart(F.col("__token"), F.col("__base"))).withColumn("__tests", F.when(F.size("__apart") > 0, battery(F.col("__apart"))).otherwise(empty))
    more = F.transform(discovered(F.col("__tests")), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), F.lit("random").alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("__more", F.when(F.size("__tests") > 0, more).otherwise(F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))
    return rows.select(*work, "__base", "__more", F.array_sort(F.concat("__base", "__more"))).toDF(*names)


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
