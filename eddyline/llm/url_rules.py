"""URL filters: host-suffix and path-prefix expressions against allow and block rules.

Each URL is expanded into expressions of a suffix of its host and a prefix of its path, of
those shapes that rules have: as many labels as some rule's host, as many characters as its
path. All expressions of all URLs are one table with the first 32 bits of their SHA-256; one
equi-join finds rules with the same 32 bits, whatever their number and shapes, and the full
digests then confirm what was found. Rule lists up to BROADCAST_RULES are broadcast, longer
ones are joined by a shuffle. Only hosts and paths move, each pair of them once.

Precedence: the longest rule wins (host and path together); of equally long ones that with the longer
path, then block before allow, then the first by host. A URL without a rule gets the method's default verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path; repeated and
very long URLs are judged like others; an empty table gives an empty result, and with no rules
all get the default; columns other than page_id and url don't matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _expressions(shapes: Sequence[tuple[int, int]]) -> Column:
    """The full digests of a URL's expressions: (host suffix, path prefix) of the given numbers of labels and characters."""
    all_ = F.array(*(F.struct(F.lit(labels).alias("labels"), F.lit(chars).alias("chars")) for labels, chars in shapes))
    labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    own = F.filter(all_, lambda s: (s["labels"] <= labels) & (s["chars"] <= F.char_length("path")))
    return F.transform(own, lambda s: _digest(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["chars"])))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Add host, path, rule, verdict, n_rules (how many rules fit) to page_id. rules: (host, path, verdict)."""
    spark = pages.sparkSession
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if best.get((host, path)) != "block":
            best[host, path] = verdict
    url = pages["url"].cast("string")
    out = pages.select(pages["page_id"].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not best:
        return out.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("n_rules"))
    shapes = sorted({(host.count(".") + 1, len(path)) for host, path in best})
    table = spark.createDataFrame([(h, p, v, -k) for k, ((h, p), v) in enumerate(sorted(best.items()))], "rule_host string, rule_path string, verdict string, tie int")
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    # The greatest rank is the rule that wins.
    size = F.char_length("rule_host") + F.char_length("rule_path")
    table = table.select(F.substring(digest, 1, 8).alias("short"), digest.alias("rule_full"), F.struct(size.alias("size"), F.char_length("rule_path").alias("chars"), (F.col("verdict") == "block").alias("blocks"), F.col("tie"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")).alias("rank"))
    table = F.broadcast(table) if len(best) <= BROADCAST_RULES else table
    urls = out.where("host != ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(_expressions(shapes)).alias("full")).withColumn("short", F.substring("full", 1, 8))
    fits = expressions.join(table, "short").where(F.col("full") == F.col("rule_full"))
    found = fits.groupBy("host", "path").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).cast("int").alias("n_rules"))
    top = F.col("rank")
    return out.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", top["rule"].alias("rule"), F.coalesce(top["verdict"], F.lit(default)).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules")
    )
