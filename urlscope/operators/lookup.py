"""Country lookup (J2, J2b) and the country aggregate (A5).

The country dimension is a reference table (one row per country name or alias, a few hundred);
that is its contract, and a table of over ``MAX_NAMES`` rows is refused. It is broadcast, so
the URL side is never shuffled for the lookup. The lookup runs on the per-country counts, not on URL rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FUZZY_MAX_DISTANCE, OTHER_CODE, OTHER_NAME
from ..functions.literals import literal_table
from .clean import is_not_benign

MAX_NAMES = 100_000


def iso_rows(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(English name, alpha-2 code as alias, alpha-3 code) of every ISO 3166 country, from the JVM's table."""
    java = spark.sparkContext._jvm.java
    locale, english = java.util.Locale, java.util.Locale.ENGLISH
    # Locale.of came with Java 19, which is when the constructor was deprecated
    of = locale.of if int(java.lang.System.getProperty("java.specification.version").split(".")[0]) >= 19 else locale
    countries = [(code, of("", code)) for code in locale.getISOCountries()]
    return [(c.getDisplayCountry(english), code, c.getISO3Country()) for code, c in countries]


def country_dim(spark: SparkSession, rows=None) -> DataFrame:
    """``name, alias, alpha_3``; by default the ISO 3166 countries."""
    return literal_table(spark, list(iso_rows(spark) if rows is None else rows), "name string, alias string, alpha_3 string")


def _bounded(dim: DataFrame) -> DataFrame:
    if dim.limit(MAX_NAMES + 1).count() > MAX_NAMES:
        raise ValueError(f"a country table of over {MAX_NAMES} names is not a reference table")
    return F.broadcast(dim)


def _names(dim: DataFrame) -> DataFrame:
    """``key -> (alpha_3, canonical name)`` for both names and aliases."""
    canon = dim.groupBy("alpha_3").agg(F.min("name").alias("canonical"))
    keys = (dim.select(F.lower(F.trim("name")).alias("key"), "alpha_3")
            .unionByName(dim.filter(F.col("alias").isNotNull())
                         .select(F.lower(F.trim("alias")).alias("key"), "alpha_3"))
            .groupBy("key").agg(F.min("alpha_3").alias("alpha_3")))
    return keys.join(canon, "alpha_3")


def malicious_by_country_name(urls: DataFrame) -> DataFrame:
    """Per-country-name counts of non-benign rows; missing and empty names are ``Unknown``."""
    name = F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Unknown"))
    return (urls.filter(is_not_benign("type")).groupBy(name.alias("country"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def country_counts(urls: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """A5 with J2: ``country_code, country_name, cnt``; unmatched names roll into ``OTHER``."""
    dim = dim if dim is not None else country_dim(urls.sparkSession)
    names = _bounded(_names(dim))
    per_name = malicious_by_country_name(urls)
    keyed = per_name.join(names, F.lower(F.trim("country")) == F.col("key"), "left")
    code = F.when(F.col("alpha_3").isNotNull() & (F.col("country") != "Unknown"), F.col("alpha_3")).otherwise(F.lit(OTHER_CODE))
    cname = F.when(F.col("alpha_3").isNotNull() & (F.col("country") != "Unknown"), F.col("canonical")).otherwise(F.lit(OTHER_NAME))
    return (keyed.groupBy(code.alias("country_code"), cname.alias("country_name"))
            .agg(F.sum("cnt").cast("bigint").alias("cnt")))


def deletions(word: Column, most: int) -> Column:
    """All strings that ``word`` gives by leaving out up to ``most`` characters, each once."""
    shorter, out = F.array(word), F.array(word)
    for _ in range(most):
        shorter = F.array_distinct(F.flatten(F.transform(shorter, lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))))
        out = F.array_union(out, shorter)
    return out


def country_lookup_fuzzy(urls: DataFrame, dim: DataFrame | None = None,
                         max_distance: int = FUZZY_MAX_DISTANCE) -> DataFrame:
    """Names without an exact match get the code of the nearest dimension name.

    Nearest = smallest Levenshtein distance (at most ``max_distance``), ties to the smaller
    code. Names within that distance share a string that either becomes by at most as many
    deletions, so an equi-join on these strings finds all candidates, whose distance is then checked.
    Output: ``country, country_code, distance`` (``OTHER`` and null distance when none is near).
    """
    dim = dim if dim is not None else country_dim(urls.sparkSession)
    names = _names(dim)
    per_name = malicious_by_country_name(urls).select("country")
    rest = per_name.join(_bounded(names), F.lower(F.trim("country")) == F.col("key"), "left_anti")
    name = F.lower(F.trim("country"))
    left = rest.select("country", F.explode(deletions(name, max_distance)).alias("part"))
    right = names.select("key", "alpha_3", F.explode(deletions(F.col("key"), max_distance)).alias("part"))
    pairs = left.join(right, "part").select("country", "key", "alpha_3").distinct()
    dist = F.levenshtein(name, F.col("key"))
    best = (pairs.withColumn("d", dist).filter(F.col("d") <= max_distance)
            .groupBy("country").agg(F.min(F.struct("d", F.col("alpha_3").alias("c"))).alias("b")))
    return rest.join(best, "country", "left").select(
        "country", F.coalesce(F.col("b.c"), F.lit(OTHER_CODE)).alias("country_code"), F.col("b.d").cast("bigint").alias("distance"))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them."""
    marked = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(c, unicodedata.normalize("NFD", c)[0]) for c in marked]
    plain = [(c, p) for c, p in plain if p != c and p.isascii()]
    return "".join(c for c, _ in plain), "".join(p for _, p in plain)


#: Words of country names that tell nothing by themselves.
_FILLERS = ["of", "the", "and"]


def folded(name: Column) -> Column:
    """Lower case without accents, apostrophes left out, all other marks as single blanks."""
    low = F.lower(F.translate(name, *_plain_letters()))
    low = F.regexp_replace(F.translate(low, "'\u2019`.", ""), "[^\\p{L}\\p{N}]+", " ")
    return F.trim(low)


def _words(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(folded(name), " ")), lambda w: (w != "") & ~w.isin(*_FILLERS))


def country_search(names: DataFrame, dim: DataFrame | None = None, places: DataFrame | None = None, max_distance: int = FUZZY_MAX_DISTANCE) -> DataFrame:
    """J2b as a search: ``country, country_code, found_by`` for each different name of ``names``.

    Tried in this order, accents and marks aside: a country's name or alias (``name``); a part of a country, by ``places``
    (place, alpha_3) (``place``); the country whose name or alias has all words of the name, each written out or cut to three letters at least,
    and the fewest others (``words``); the nearest name within ``max_distance`` (``near``). Ties go to the smaller code, what isn't found to
    ``OTHER``. Only different names are looked at, and the tables are reference tables, so they are broadcast.
    """
    spark = names.sparkSession
    dim = dim if dim is not None else country_dim(spark)
    keys = dim.select(F.explode(F.array("name", "alias")).alias("key"), "alpha_3").filter("key is not null")
    wanted = names.select(F.col("country")).distinct().withColumn("f", folded(F.col("country")))
    exact = _bounded(keys.groupBy(folded(F.col("key")).alias("f")).agg(F.min("alpha_3").alias("by_name")))
    found = wanted.join(exact, "f", "left")
    if places is not None:
        parts = _bounded(places.groupBy(folded(F.col("place")).alias("f")).agg(F.min("alpha_3").alias("by_place")))
        found = found.join(parts, "f", "left")
    else:
        found = found.withColumn("by_place", F.lit(None).cast("string"))
    rest = found.filter("by_name is null and by_place is null").select("country", "f", _words(F.col("country")).alias("own"))
    # the index: every beginning of every word
    whole = keys.withColumn("words", _words(F.col("key"))).withColumn("n", F.size("words"))
    index = whole.select("key", "alpha_3", "n", F.explode("words").alias("word"))
    index = index.select("key", "alpha_3", "n", "word", F.explode(F.expr("transform(sequence(least(3, length(word)), length(word)), i -> substring(word, 1, i))")).alias("begin"))
    asked = rest.select("country", F.size("own").alias("m"), F.explode("own").alias("begin"))
    met = asked.join(_bounded(index), "begin").groupBy("country", "m", "key", "alpha_3", "n").agg(F.count_distinct("begin").alias("hit"))
    by_words = met.filter("hit = m").groupBy("country").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("others"), "alpha_3")).alias("w")).select("country", F.col("w.alpha_3").alias("by_words"))
    name = F.col("f")
    near = rest.select("country", "f", F.explode(deletions(name, max_distance)).alias("part"))
    right = keys.select(folded(F.col("key")).alias("k"), "alpha_3", F.explode(deletions(folded(F.col("key")), max_distance)).alias("part"))
    by_near = (near.join(right, "part").withColumn("d", F.levenshtein("f", "k")).filter(F.col("d") <= max_distance)
               .groupBy("country").agg(F.min(F.struct("d", "alpha_3")).alias("b")).select("country", F.col("b.alpha_3").alias("by_near")))
    out = found.join(by_words, "country", "left").join(by_near, "country", "left")
    ways = [("by_name", "name"), ("by_place", "place"), ("by_words", "words"), ("by_near", "near")]
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(w)) for c, w in ways])
    return out.select("country", F.coalesce(*[F.col(c) for c, _ in ways], F.lit(OTHER_CODE)).alias("country_code"), how.alias("found_by"))
