"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of(id: Column) -> Column:
    """The first dotted segment."""
    return F.substring_index(id, ".", 1)


def leaf_of(id: Column) -> Column:
    return F.substring_index(id, ".", -1)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half away from zero, written out so that every engine agrees."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def severity_label(score: Column) -> Column:
    """Of the unrounded value."""
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def node_type_index(kind: Column) -> Column:
    """0 function, 1 module, 2 class, 3 interface, 4 anything else; the case does not matter."""
    k = F.lower(kind)
    return F.when(k == "function", 0).when(k == "module", 1).when(k == "class", 2).when(k == "interface", 3).otherwise(4)


def split_camel(name: Column) -> Column:
    return F.split(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def tokens_of(id: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Words of the leaf name: split at underscores and case, lower case, longer than one letter, no stopwords."""
    parts = F.flatten(F.transform(F.split(leaf_of(id), "_"), split_camel))
    words = F.transform(parts, F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & (~w.isin(*stopwords) if stopwords else F.lit(True)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-15, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.pow(x.cast("double") - y.cast("double"), 2), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))


def binomial_cdf(k: Column, n: Column, p: float = 0.5) -> Column:
    """P(X <= k): exact terms summed by ratio from the first; 1 from n on. For n up to some thousand."""
    ks = F.sequence(F.lit(0), k.cast("int"))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    base = n * math.log(1 - p)
    ratio = math.log(p / (1 - p))
    step = lambda s, i: F.struct(F.when(i == 0, base).otherwise(s["log"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))) + ratio).alias("log"), s["sum"].alias("sum"))

    def add(s: Column, i: Column) -> Column:
        t = step(s, i)
        return F.struct(t["log"].alias("log"), (s["sum"] + F.exp(t["log"])).alias("sum"))

    return F.when(k >= n, 1.0).when(k < 0, 0.0).otherwise(F.aggregate(ks, start, add, lambda s: F.least(s["sum"], F.lit(1.0))))


def direction_significant(minority: Column, total: Column, alpha: float = 0.05) -> Column:
    """Sign test: six at least, and a minority this small is rarer than alpha."""
    return (total >= 6) & (binomial_cdf(minority, total) < alpha)


def cohens_d(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(F.abs(sd) < 1e-15, F.when(x > mean, 3.0).otherwise(0.0)).otherwise((x - mean) / sd)


def date_distance(a: Column, b: Column) -> Column:
    """Days, with years of 365 and months of 30."""
    days = lambda d: F.year(d) * 365 + F.month(d) * 30 + F.dayofmonth(d)
    return F.abs(days(a) - days(b))


def l2_normalized(v: Column, k: int) -> Column:
    """The first k components, divided by their norm if it is above 1e-10."""
    first = F.transform(F.slice(v, 1, k), lambda x: x.cast("double"))
    norm = F.sqrt(dot(first, first))
    return F.when(norm > 1e-10, F.transform(first, lambda x: x / norm)).otherwise(first)


# Words of programming languages that say nothing about a domain.
STOPWORDS = (
    "get", "set", "new", "init", "from", "into", "with", "self", "this", "impl", "fn", "pub", "def", "class", "mod", "use", "let", "mut", "ref", "the", "is", "to", "of", "in", "for", "on", "at", "by", "if", "or",
    "and", "not", "an", "do", "has", "was", "test", "async", "await", "return", "true", "false", "none", "null", "void", "type", "str", "int", "bool", "float",
)


def sorted_join(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def truncated(text: Column, n: int) -> Column:
    """At most n characters."""
    return F.substring(text, 1, n)


def normalized_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def health_bar(value: Column, width: int = 20) -> Column:
    """Filled and empty blocks."""
    full = F.floor(clamp(value) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def size_class(kb: Column) -> Column:
    return F.when(kb < 2000, "small").when(kb < 20000, "medium").otherwise("large")


# Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def ln_gamma(x: Column) -> Column:
    """For x of at least one half."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)
