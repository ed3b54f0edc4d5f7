"""Test inputs derived from the driver tables (see FIXTURES.md).

``urls_raw`` turns every web page into one labelled URL with the edge cases the jobs must
handle; ``url_feed`` turns every event into one labelled URL with a country. Both are plain
DataFrame plans over the given parquet tables, so their size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hosting_suffix(page_id):
    r = page_id % 40
    return (F.when(r == 3, F.lit(".web.app")).when(r == 13, F.lit(".github.io"))
            .when(r == 23, F.lit(".netlify.app")).otherwise(F.lit(".vercel.app")))


def urls_raw_from_pages(pages: DataFrame) -> DataFrame:
    """``urls_raw(page_id, url, type)``: one raw, untidy labelled URL per page."""
    p = pages.select(
        "page_id", "url",
        F.regexp_extract("url", r"//([^/]*)", 1).alias("host"),
        F.regexp_extract("url", r"^([^?#]*)", 1).alias("base"),
        (F.col("page_id") % 10).alias("m"),
    )
    pid, m, base, host = F.col("page_id"), F.col("m"), F.col("base"), F.col("host")
    pid_s = pid.cast("string")
    url = (
        F.when(pid % 50 == 19, F.lit("   "))
        .when(m.isin(0, 1, 2), F.col("url"))
        .when(m == 3, F.replace(base, host, F.concat(F.lit("proj"), pid_s, _hosting_suffix(pid))))
        .when(m == 4, F.concat(
            F.replace(base, host, F.concat(F.lit("10.0."), (pid % 256).cast("string"), F.lit(".7"))),
            F.lit("/login.php?user="), pid_s))
        .when(m == 5, F.concat(F.regexp_replace(base, r"[.](com|net|org)/", ".tk/"),
                               F.lit("/verify?redirect=//x")))
        .when(m == 6, F.concat(F.regexp_replace(base, r"[.](com|net|org)/", ".ru/"),
                               F.lit("/setup.exe")))
        .when(m == 7, F.concat(
            F.when(pid % 20 == 7, F.lit("http://kq3.zv7.j9w.x2u5g.")).otherwise(F.lit("http://a.b.c.d.")),
            host, F.lit("/x@y/index.jsp")))
        .when(m == 8, F.concat(
            F.replace(F.replace(base, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")),
            F.lit("/administrator/")))
        .otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
    )
    label = (
        F.when(pid % 50 == 9, F.lit("")).when(m.isin(0, 1, 2, 3), F.lit("benign"))
        .when(m.isin(4, 5), F.lit("phishing")).when(m.isin(6, 7), F.lit("malware"))
        .when(m == 8, F.lit("defacement")).otherwise(F.lit("DEFACEMENT "))
    )
    return p.select("page_id", url.alias("url"), label.alias("type"))


def urls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_raw_from_pages(table(spark, sf_dir, "pages").select("page_id", "url"))


def url_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url_feed(event_id, ts, url, type, country)``: one labelled URL per event.

    Events pick a page by ``event_id % page count`` and a nation by ``user_id % 25``. The page
    count is one scalar; pages are joined on their key (Spark picks broadcast or shuffle from
    the statistics), nations are a fixed 25-row dimension and broadcast.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.count()
    raw = urls_raw_from_pages(pages)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("event_id") % F.lit(n_pages)).alias("page_id"),
        (F.col("user_id") % 25).alias("nk"))
    return (ev.join(raw, "page_id")
            .join(F.broadcast(nation), F.col("nk") == F.col("n_nationkey"))
            .select("event_id", "ts", "url", "type", F.col("n_name").alias("country")))


#: Rows for the country search: (name, alias, alpha_3) and (place, alpha_3).
SEARCH_DIM = [("Germany", "Deutschland", "DEU"), ("C\u00f4te d'Ivoire", "Ivory Coast", "CIV"), ("South Korea", "Korea, Republic of", "KOR"),
              ("North Korea", "Korea, Democratic People's Republic of", "PRK"), ("Brazil", "Brasil", "BRA")]
SEARCH_PLACES = [("Bavaria", "DEU"), ("Bayern", "DEU"), ("S\u00e3o Paulo", "BRA")]
#: Names that events get by their number, with the code and the way they are to be found by.
SEARCH_NAMES = [("Bavaria", "DEU", "place"), ("Cote d'Ivoire", "CIV", "name"), ("Korea, Rep.", "KOR", "words"), ("Brasill", "BRA", "near"),
                ("SAO PAULO", "BRA", "place"), ("Korea Dem. People's Rep.", "PRK", "words"), ("Atlantis", "OTHER", None)]

#: (name, alias, alpha_3) rows of the test country table: NATION_0..NATION_19 map to codes,
#: NATION_18 and NATION_19 share one code, and one alias is misspelt; NATION_20..24 are absent.
COUNTRY_DIM = (
    [(f"NATION_{i}", f"Nation {i}", f"N{i:02d}") for i in range(18)]
    + [("NATION_18", "Nation 18", "N18"), ("NATION_19", "Nation 19", "N18"),
       ("NATOIN_22", "Natoin 22", "N22")]
)
