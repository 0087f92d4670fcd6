"""Secret scan in Spark expressions only: known shapes, and a battery of randomness tests for the rest.

Known shapes (``BASE``) are assignments to a secret's name, access key ids and long hex strings. The battery looks at
every other unbroken string of 20 or more key characters that has a letter; ``=`` ends a string, so the value after
``name=`` is a string of its own:

* its encoding is inferred as the smallest of the alphabets below that holds it;
* three tests ask whether it could be random in that alphabet: chi-squared uniformity of the symbols (in 16 classes, so
  that the expected counts do not vanish), the number of runs above and below the alphabet's middle, and the serial
  correlation of neighbouring symbols. Each gives a p-value, and three times the least of them bounds the joint one.
  A string without a digit could be words, so a fourth test asks whether its letters are the common ones of prose;
* natural strings are what is to be told from random ones, so a small p-value is a discovery of "not random". Strings
  are discovered by the Benjamini-Hochberg rule within their length class, with and without digits apart, because a
  short string's tests have less power than a long one's. What is left, as random as a key would be, is reported.

The rule's threshold comes from counts in fixed bins of the p-value, so no length class is ever sorted in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_cdf

# fixed values: the shapes and their least lengths, in the order of the contract
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]+)"
BASE = [("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24)]
CANDIDATE = r"()([A-Za-z0-9+/_-]+=*)"
LEAST = 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("upper", LETTERS.upper()),
    ("lower", LETTERS),
    ("letters", LETTERS.upper() + LETTERS),
    ("marked", LETTERS.upper() + LETTERS + "+/_-"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
]
# per mille of each letter in prose, about the mean of English, German, French and Spanish
PROSE = [82, 15, 31, 44, 147, 16, 19, 32, 72, 4, 6, 46, 28, 78, 58, 22, 6, 67, 70, 69, 39, 12, 11, 3, 9, 8]
CLASSES = 16
RATE = 0.05  # share of random strings that may wrongly be discovered as natural
LENGTH_CLASSES = [24, 32, 48, 64, 128]  # upper ends
BINS = 400
KINDS = ["assign", "access", "hex", "random"]


def spans_of(text: Column, pattern: str, least: int) -> Column:
    """array<struct(start, end, value)> of the matches whose second group has ``least`` characters or more.

    Matches are leftmost and do not overlap; positions are code points. Two control characters mark the matches; where
    the text has them itself another one stands in, which no pattern contains, so positions stay.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), pattern, "\x01$1\x02$2\x02")
    parts = F.split(marked, "\x01")
    cut = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, "\x02"))
    zero = F.struct(
        F.length(F.element_at(parts, 1)).alias("at"),
        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p[0]) + F.length(p[1])
        span = F.struct(acc["at"].alias("start"), end.alias("end"), p[1].alias("value"))
        return F.struct(
            (end + F.length(p[2])).alias("at"),
            F.when(F.length(p[1]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(cut, zero, step, lambda acc: acc["found"])


def chi_squared_tail(x: Column, k: int) -> Column:
    """P(chi-squared with k degrees of freedom > x), by the cube-root normal approximation."""
    c = 2 / (9 * k)
    return norm_cdf(-(F.pow(x / k, F.lit(1 / 3)) - (1 - c)) / c**0.5)


def two_sided(z: Column) -> Column:
    return 2 * norm_cdf(-F.abs(z))


def _with(spans: Column, name: str, value) -> Column:
    """Each struct of the array with one more field, computed from it; chained, every field is computed once."""
    return F.transform(spans, lambda s: s.withField(name, value(s)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _neighbours(s: Column, field: str, pair) -> Column:
    """pair(next, this) over neighbouring elements of an array field."""
    return F.zip_with(F.slice(s[field], F.lit(2), s["n"]), F.slice(s[field], F.lit(1), s["n"] - 1), pair)


def _alphabet(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, symbols in reversed(ALPHABETS):
        out = F.when(F.length(F.translate(body, symbols, "")) == 0, F.lit(symbols)).otherwise(out)
    return out


def _uniform(s: Column) -> Column:
    """Chi-squared p-value of 16 classes; an alphabet that is no multiple of 16 fills them unevenly."""

    def term(b: Column) -> Column:
        lo, hi = F.ceil(b * s["k"] / CLASSES), F.ceil((b + 1) * s["k"] / CLASSES)
        want = s["n"] * (hi - lo) / s["k"]
        seen = F.size(F.filter(s["x"], lambda v: (v >= lo) & (v < hi)))
        return F.pow(seen - want, F.lit(2.0)) / want

    return chi_squared_tail(_sum(F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), term)), CLASSES - 1)


def _runs(s: Column) -> Column:
    n, n1 = s["n"].cast("double"), s["ones"]
    n0 = n - n1
    expected = 2 * n1 * n0 / n + 1
    spread = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    runs = 1 + _sum(_neighbours(s, "high", lambda a, b: F.abs(a - b)))
    return F.when((n1 > 1) & (n0 > 1), two_sided((runs - expected) / spread)).otherwise(0.0)


def _serial(s: Column) -> Column:
    n, lag = s["n"], _sum(_neighbours(s, "d", lambda a, b: a * b))
    return F.when(s["var"] > 0, two_sided((lag / s["var"] + 1 / n) * F.sqrt(n))).otherwise(0.0)


def _prose(s: Column) -> Column:
    """One-sided p-value of the letters' log frequency in prose, against letters drawn evenly."""
    w = [math.log(len(PROSE) * f / sum(PROSE)) for f in PROSE]
    mean = sum(w) / len(w)
    spread = (sum((v - mean) ** 2 for v in w) / len(w)) ** 0.5
    scores = F.array(*[F.lit((v - mean) / spread) for v in w])
    letters = F.lower(F.regexp_replace(s["body"], "[^A-Za-z]", ""))
    z = _sum(F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: F.element_at(
        scores, F.call_function("instr", F.lit(LETTERS), F.substr(letters, i, F.lit(1))))))
    return norm_cdf(-z / F.sqrt(F.length(letters)))


def tested(spans: Column) -> Column:
    """Add to each span ``class`` (of its length and digits), ``p`` (joint bound of the battery) and ``bin`` (of p).

    A span that no alphabet holds, or with fewer than ``LEAST`` symbols, is left out.
    """
    out = _with(spans, "body", lambda s: F.regexp_replace(s["value"], "=+$", ""))
    out = _with(out, "alphabet", lambda s: _alphabet(s["body"]))
    out = F.filter(out, lambda s: s["alphabet"].isNotNull() & (F.length(s["body"]) >= LEAST))
    out = _with(out, "k", lambda s: F.length(s["alphabet"]))
    out = _with(out, "n", lambda s: F.length(s["body"]))
    out = _with(out, "x", lambda s: F.transform(
        F.sequence(F.lit(1), s["n"]), lambda i: F.call_function("instr", s["alphabet"], F.substr(s["body"], i, F.lit(1))) - 1))
    out = _with(out, "high", lambda s: F.transform(s["x"], lambda v: F.when(2 * v >= s["k"], 1.0).otherwise(0.0)))
    out = _with(out, "ones", lambda s: _sum(s["high"]))
    out = _with(out, "mean", lambda s: _sum(s["x"]) / s["n"])
    out = _with(out, "d", lambda s: F.transform(s["x"], lambda v: v - s["mean"]))
    out = _with(out, "var", lambda s: _sum(F.transform(s["d"], lambda v: v * v)))
    out = _with(out, "digits", lambda s: s["body"].rlike("[0-9]"))
    out = _with(out, "p", lambda s: F.least(_uniform(s), _runs(s), _serial(s)))
    out = _with(out, "p", lambda s: F.least(F.lit(1.0), F.when(s["digits"], 3 * s["p"]).otherwise(4 * F.least(s["p"], _prose(s)))))
    return F.transform(out, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["p"].alias("p"),
        (_length_class(s["n"]) + F.when(s["digits"], 0).otherwise(len(LENGTH_CLASSES) + 1)).alias("class"),
        F.greatest(F.floor(F.log10(F.greatest(s["p"], F.lit(1e-300))) * 20) + BINS, F.lit(0)).cast("int").alias("bin")))


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, top in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n <= top, F.lit(i)).otherwise(out)
    return out


def thresholds(judged: DataFrame) -> dict[int, int]:
    """Per length class the highest p-value bin at which the Benjamini-Hochberg rule holds; none: nothing is discovered.

    Bins are equal steps of the logarithm, and a bin stands for its upper end, so the rule is never laxer than the exact
    one. One row per class comes back.
    """
    counts = judged.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("c"))
    by_class = Window.partitionBy("class")  # BINS rows at most
    below = F.sum("c").over(by_class.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    upper = F.pow(F.lit(10.0), (F.col("bin") + 1 - BINS) / 20)
    ok = counts.withColumn("ok", upper <= RATE * below / F.sum("c").over(by_class)).filter("ok")
    return {r["class"]: r["cut"] for r in ok.groupBy("class").agg(F.max("bin").alias("cut")).collect()}


def _spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the base spans of each kind, and as ``random`` the strings the battery is to judge, tested."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    quick = {"assign": F.lower(text).rlike("password|passwd|secret|token|api_?key"), "access": text.contains("AKIA"),
             "hex": text.rlike("[0-9a-f]{24}")}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    base = {kind: F.when(quick[kind], spans_of(text, pattern, least)).otherwise(none) for kind, pattern, least in BASE}
    rows = docs.withColumns(base)
    long = F.when(text.rlike("[A-Za-z0-9+/_-]{%d}" % LEAST), spans_of(text, CANDIDATE, LEAST)).otherwise(none)
    clear = lambda s: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    fresh = F.filter(long, lambda s: s["value"].rlike("[A-Za-z]") & clear(s))
    return rows.withColumn("random", tested(fresh))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex`` and ``random``: arrays of (start, end) in code points, end exclusive.

    Columns of these names in ``docs`` are replaced. The base kinds may overlap each other; a random span overlaps none
    of them. Null and empty texts have no spans. Repeated rows are scanned one by one, and each counts in the
    false-discovery rule. The result of an empty table is empty. Other columns are kept as they are.
    """
    rows = _spans(docs.select(*[c for c in docs.columns if c not in KINDS]), text_col)
    cut = thresholds(rows.select(F.explode("random").alias("s")).select("s.class", "s.bin"))
    allowed = F.array(*[F.lit(cut.get(i, -1)) for i in range(2 * (len(LENGTH_CLASSES) + 1))])
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    out = {k: F.transform(k, plain) for k in ("assign", "access", "hex")}
    left = F.filter("random", lambda s: s["bin"] > F.element_at(allowed, s["class"] + 1))
    return rows.withColumns(out | {"random": F.transform(left, plain)})


def span_digest(kinds: list[str]) -> Column:
    """kind:start:end of the spans of the given kinds, by start, then kind as listed, comma-joined."""

    def numbered(i: int):  # a default argument would be taken for the element's index
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))

    rows = [F.transform(k, numbered(i)) for i, k in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, spans per base kind, a SHA-256 of the base spans, and all spans as text; see ``scanned``."""
    base = [k for k, _, _ in BASE]
    found = scanned(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return found.select(
        id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(KINDS).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every kind in the text replaced by ``mark``; overlapping spans are one. Nulls stay."""
    rows = scanned(docs, text_col)
    spans = F.array_sort(F.concat(*KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        before = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["done"], before, F.lit(mark))).otherwise(acc["done"]).alias("done"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1)))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
