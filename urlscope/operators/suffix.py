"""Public-suffix resolution (J3) as broadcast equi-joins, without a UDF.

A host is split into labels. For each depth d = 1..D (D = most labels in any rule) the last d
labels form a candidate key; one left join per depth against a small index of the rules gives
four flags for that key:

* ``node`` - the key is the tail of some rule (the rule trie has a node for it),
* ``rule`` - the key is a rule itself,
* ``wild`` - ``*.key`` is a rule,
* ``exc``  - ``!key`` is a rule.

With W the deepest node depth and E the deepest rule depth, the suffix has
``W+1`` labels when ``*.`` follows the node at W (``W`` when the next label is an exception),
else ``E`` labels. This is the longest-match walk a suffix trie makes, so unknown endings give
an empty suffix and a bare IPv4 host is its own domain.

Scale: a rule list is a reference table of some ten thousand rows. That is its contract: the
index is broadcast after a count, and a table of more than ``MAX_RULES`` keys is refused. Every URL is
resolved by D hash probes in its own partition; the URL table isn't shuffled, and a hot host
costs no more than any other.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import literal_table
from ..functions.suffix_list import icann_rules

#: Most keys of a rule index; the whole public list has about 10,000 rules.
MAX_RULES = 200_000

_IPV4 = (r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
         r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$")


def rules_frame(spark: SparkSession, rules: list[str] | None = None) -> DataFrame:
    """Suffix rules in public-suffix-list syntax, one per row (column ``rule``)."""
    rules = icann_rules() if rules is None else rules
    return literal_table(spark, [(r.strip().lower(),) for r in rules if r.strip()], "rule string")


def rule_index(rules: DataFrame) -> DataFrame:
    """``key, node, rule, wild, exc`` from a ``rule`` column."""
    labels = F.split(F.col("rule"), r"[.]", -1)
    tails = (rules.select("rule", labels.alias("labels"))
             .select("rule", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("d"))
             .select(F.array_join(F.slice("labels", -F.col("d"), F.col("d")), ".").alias("key"),
                     F.lit(True).alias("node"), (F.col("d") == F.size("labels")).alias("rule"),
                     F.lit(False).alias("wild"), F.lit(False).alias("exc")))
    wild = (rules.filter(F.col("rule").startswith("*."))
            .select(F.substring("rule", 3, 1 << 20).alias("key"), F.lit(False).alias("node"),
                    F.lit(False).alias("rule"), F.lit(True).alias("wild"), F.lit(False).alias("exc")))
    exc = (rules.filter(F.col("rule").startswith("!"))
           .select(F.substring("rule", 2, 1 << 20).alias("key"), F.lit(False).alias("node"),
                   F.lit(False).alias("rule"), F.lit(False).alias("wild"), F.lit(True).alias("exc")))
    return (tails.unionByName(wild).unionByName(exc).groupBy("key")
            .agg(*[F.bool_or(c).alias(c) for c in ("node", "rule", "wild", "exc")]))


@lru_cache(maxsize=1)
def icann_index() -> tuple[pa.Table, int]:
    """The same index and depth for the shipped list (no Spark job needed)."""
    rules = icann_rules()
    rows = rule_index_rows(rules)
    names = ("key", "node", "rule", "wild", "exc")
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), max(r.count(".") + 1 for r in rules)


def rule_index_rows(rules) -> list[tuple[str, bool, bool, bool, bool]]:
    """The index of an in-memory rule list."""
    flags: dict[str, list[bool]] = {}
    for r in (x.strip().lower() for x in rules):
        if not r:
            continue
        labels = r.split(".")
        for d in range(1, len(labels) + 1):
            f = flags.setdefault(".".join(labels[-d:]), [False] * 4)
            f[0] = True
            f[1] = f[1] or d == len(labels)
        if r.startswith("*."):
            flags.setdefault(r[2:], [False] * 4)[2] = True
        if r.startswith("!"):
            flags.setdefault(r[1:], [False] * 4)[3] = True
    return [(k, *v) for k, v in sorted(flags.items())]


def max_rule_depth(rules: DataFrame) -> int:
    """Most labels in one rule: a single scalar aggregate over the (small) rule table."""
    return int(rules.agg(F.max(F.size(F.split("rule", r"[.]", -1)))).first()[0] or 0)


def suffix_host(url: Column | str) -> Column:
    from ..functions.urlparts import suffix_host as _sh
    return _sh(url)


class SuffixResolver:
    """Adds ``subdomain``, ``reg_domain`` (domain label), ``suffix`` for a host column."""

    def __init__(self, spark: SparkSession, rules: DataFrame | None = None):
        if rules is None:
            table, self.depth = icann_index()
            index = spark.createDataFrame(table)
        else:
            self.depth = max_rule_depth(rules)
            index = rule_index(rules)
            if index.limit(MAX_RULES + 1).count() > MAX_RULES:
                raise ValueError(f"a suffix list of over {MAX_RULES} keys is not a reference table")
        self.index = F.broadcast(index)  # at most MAX_RULES short rows

    def resolve(self, df: DataFrame, host: str = "_host", prefix: str = "_sfx") -> DataFrame:
        """Append ``{prefix}_sub``, ``{prefix}_dom``, ``{prefix}_suf`` computed from ``host``."""
        labels = F.split(F.col(host), r"[.]", -1)
        n = F.size(labels)
        out = df.withColumns({f"{prefix}_labels": labels, f"{prefix}_n": n})
        lab, cnt = F.col(f"{prefix}_labels"), F.col(f"{prefix}_n")
        for d in range(1, self.depth + 1):
            key = F.when(cnt >= d, F.lower(F.array_join(F.slice(lab, -d, d), "."))).alias(f"{prefix}_k{d}")
            out = out.withColumn(f"{prefix}_k{d}", key)
            idx = self.index.select(
                F.col("key").alias(f"{prefix}_k{d}"),
                *[F.col(c).alias(f"{prefix}_{c}{d}") for c in ("node", "rule", "wild", "exc")])
            out = out.join(idx, f"{prefix}_k{d}", "left")

        def flag(c, d):
            return F.coalesce(F.col(f"{prefix}_{c}{d}"), F.lit(False))

        depths = range(1, self.depth + 1)
        out = out.withColumns({
            f"{prefix}_w": F.greatest(*[F.when(flag("node", d), F.lit(d)).otherwise(F.lit(0)) for d in depths], F.lit(0)),
            f"{prefix}_e": F.greatest(*[F.when(flag("rule", d), F.lit(d)).otherwise(F.lit(0)) for d in depths], F.lit(0)),
            f"{prefix}_wilds": F.array(*[flag("wild", d) for d in depths]),
            f"{prefix}_excs": F.array(*[flag("exc", d) for d in depths]),
        })
        w, e = F.col(f"{prefix}_w"), F.col(f"{prefix}_e")
        wild_at_w = F.when(w >= 1, F.element_at(F.col(f"{prefix}_wilds"), F.greatest(w, F.lit(1)))).otherwise(F.lit(False))
        exc_next = F.when(w + 1 <= self.depth, F.element_at(F.col(f"{prefix}_excs"), F.least(w + 1, F.lit(self.depth)))).otherwise(F.lit(False))
        out = out.withColumn(f"{prefix}_s", F.when((w < cnt) & wild_at_w, F.when(exc_next, w).otherwise(w + 1)).otherwise(e))
        out = out.withColumn(f"{prefix}_i", cnt - F.col(f"{prefix}_s"))
        s, i = F.col(f"{prefix}_s"), F.col(f"{prefix}_i")
        ip = (s == 0) & (cnt == 4) & F.col(host).rlike(_IPV4)
        suf = F.when(s > 0, F.array_join(F.slice(lab, i + 1, F.greatest(s, F.lit(1))), ".")).otherwise(F.lit(""))
        dom = F.when(i >= 1, F.element_at(lab, F.greatest(i, F.lit(1)))).otherwise(F.lit(""))
        sub = F.when(i >= 2, F.array_join(F.slice(lab, 1, F.greatest(i - 1, F.lit(1))), ".")).otherwise(F.lit(""))
        out = out.withColumn(f"{prefix}_ip", ip)
        ipc = F.col(f"{prefix}_ip")
        out = out.withColumns({
            f"{prefix}_sub": F.when(ipc, F.lit("")).otherwise(sub),
            f"{prefix}_dom": F.when(ipc, F.col(host)).otherwise(dom),
            f"{prefix}_suf": F.when(ipc, F.lit("")).otherwise(suf),
        })
        drop = [f"{prefix}_{c}" for c in ("labels", "n", "w", "e", "wilds", "excs", "s", "i", "ip")] + [
            f"{prefix}_{c}{d}" for d in range(1, self.depth + 1) for c in ("k", "node", "rule", "wild", "exc")]
        return out.drop(*drop)


def resolve_suffix(df: DataFrame, url: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """J3 as a query: ``subdomain, domain, suffix`` of every URL (tldextract semantics)."""
    spark = df.sparkSession
    r = SuffixResolver(spark, rules)
    out = r.resolve(df.withColumn("_host", suffix_host(url)))
    return (out.withColumnsRenamed({"_sfx_sub": "subdomain", "_sfx_dom": "domain_label",
                                    "_sfx_suf": "suffix"}).drop("_host"))
