"""URL filters: fixed host/path rules first, mined association rules for the rest.

URL tokens (scheme, host labels, path words, query keys and pairs, fragment)
and the label of labelled pages are the items of one transaction per page.
Spark's FP-growth mines frequent item sets; association rules whose
consequent is the block label, pruned by support and confidence, judge every
URL that no fixed rule fits. Rules match by an inverted index: each rule is
filed under the rarest token of its antecedent, URLs look their tokens up and
check the whole antecedent only for the rules found.

Scale: only url and labels are read. FP-growth is distributed (groups of items
by partition, prefix trees merged map-side). Frequent items, at most
(items per page / min_support) of them, are all that it brings to the driver.
A verdict depends on the URL alone, so looked-up hits are one row per distinct
URL and meet the pages in an inner/left join that AQE splits where an URL or a
token is hot; nothing is broadcast by hand.

Defined results: null URLs and those without ``://`` have empty host and path,
fit no rule with a host, have no tokens and are allowed; repeated rows each
keep their row; null labels count as 0; with no labelled page nothing is mined
and every URL outside the rules is allowed; of rules equal in confidence the one of more support counts, then
the last in order; all other columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.llm.common import free_name

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 25, 0.6
BLOCK = "label:block"


def host_of(url):
    at = F.instr(url, "://")
    raw = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url):
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fixed_rule(host, path, rules=RULES):
    """(rule, verdict) struct of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ruling, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + own_path))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(ruling)).otherwise(verdict)
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


def tokens(url):
    """Distinct tokens of an URL; numbers in paths are one token."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kinds = [
        F.transform(F.split(F.regexp_extract(url, r"^([^:/?#]*)://", 1), "$^"), lambda x: F.concat(F.lit("scheme:"), F.lower(x))),
        F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.split(F.lower(path_of(url)), r"[/._-]+"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^[0-9]+$", "#"))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.split(x, "=")[0])),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("pair:"), x)),
        F.array(F.concat(F.lit("fragment:"), F.regexp_extract(url, r"#(.*)$", 1))),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*kinds)), lambda x: ~F.endswith(x, F.lit(":")))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, confidence, support, token) from (url, block 0/1) rows.

    ``token`` is the antecedent's rarest one, under which the rule is filed. A
    rule must hold in ``min_support`` of the labelled rows and in ``min_rows``.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    min_support = min(1.0, max(min_support, min_rows / max(1, n)))
    items = F.when(F.col("block") == 1, F.concat(tokens(F.col("url")), F.array(F.lit(BLOCK)))).otherwise(tokens(F.col("url")))
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = growth.fit(labelled.select(items.alias("items")))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.round(F.col("support") * n) >= min_rows))
    rules = rules.select(F.array_join(F.array_sort("antecedent"), "\t").alias("rule_id"), "antecedent", "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    filed = rules.withColumn("token", F.explode("antecedent")).join(single, "token")
    rarest = W.partitionBy("rule_id").orderBy("freq", "token")
    return filed.withColumn("nth", F.row_number().over(rarest)).where("nth = 1").drop("nth", "freq")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, confidence): the most confident mined rule of each distinct URL that has any."""
    looked = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("own", tokens(F.col("url")))
    looked = looked.withColumn("token", F.explode("own")).join(rules, "token")
    found = looked.where(F.size(F.array_except("antecedent", "own")) == 0)
    best = F.max(F.struct("confidence", "support", "rule_id")).alias("best")
    return found.groupBy("url").agg(best).select("url", F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    url_col: str = "url",
    rules=RULES,
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``pages`` with (host, path, rule, verdict, mined_rule, confidence), with a number after names that it has.

    ``labels`` has (url, block): what is known of some URLs. ``verdict`` is the
    longest fixed rule's, else block if a mined rule matches, else allow.
    """
    mined = mine(labels.select("url", "block"), min_support, min_rows, min_confidence)
    key, fixed = free_name(pages, "url_key"), free_name(pages, "url_fixed")
    names = [free_name(pages, c) for c in ("host", "path", "rule", "verdict", "mined_rule", "confidence")]
    hits = match(pages.select(F.col(url_col).alias("url")), mined).toDF(key, *names[4:])
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    shown = pages.select("*", F.coalesce(host, F.lit("")).alias(names[0]), F.coalesce(path, F.lit("")).alias(names[1]))
    shown = shown.withColumn(fixed, fixed_rule(F.col(names[0]), F.col(names[1]), rules)).join(hits, F.col(url_col) == F.col(key), "left")
    return shown.select(
        *pages.columns,
        *names[:2], F.col(f"{fixed}.rule").alias(names[2]),
        F.coalesce(F.col(f"{fixed}.verdict"), F.when(F.col(names[4]).isNotNull(), "block").otherwise("allow")).alias(names[3]),
        *names[4:],
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of pages whose id has a label: block where toxic or of no quality."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("block")), "page_id").select("url", "block")
