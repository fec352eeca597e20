"""URL filters: domain and path rules first, then gradient-boosted trees on lexical features.

Only DataFrame functions and the library's tree learner. The trees are trained on a bounded hash sample of
the URLs that a rule decides, with the rule's verdict as label. Features: lengths, depth, digit ratio,
character entropy, parameter counts, and statistics of the host's suffix: how often it was blocked and
how often it occurs among the labelled URLs. A URL that the trees learn from takes these statistics from other hosts alone, so
that they never hold its own label; a suffix without (other) labelled hosts has the share of blocked URLs overall.

Defined results: a null URL, and one without `://`, has an empty host and path, fits no rule, and gets the
verdict of the trees on empty strings; with labels of one kind only, or none, that kind (or allow) is the
verdict; equal URLs get equal verdicts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed

#: Expected bound of the training sample.
SAMPLE = 8_000
TREES, DEPTH = 8, 3

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # (?s): a line break is an ordinary character
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.translate(F.regexp_extract(url, at, 1), upper, lower).alias("host"),
        F.regexp_extract(url, at, 2).alias("path"),
    )


def rule_name(host: str, path: str) -> str:
    return host + path


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        own = F.concat(F.lit("."), F.col("host"))
        fits = (F.col("host") != "") & own.endswith("." + host) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(rule_name(host, path))).otherwise(rule)
        told = F.when(fits, F.lit(verdict)).otherwise(told)
    return parts.withColumns({"rule": rule, "told": told})


def ratio(part: Column, of: Column) -> Column:
    return F.when(of > 0, part / of).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    """How many characters match."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: str) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(F.col(text), c, F.lit("")))) / size
    letters = F.array_distinct(F.split(F.col(text), ""))
    letters = F.filter(letters, lambda c: c != "")
    return F.coalesce(F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))), F.lit(0.0))


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "host_digits", "hyphens",
    "parameters", "query_length", "fragment", "extension", "entropy", "host_entropy", "secure", "suffix_blocked", "suffix_seen",
)


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of url, host and path, and the host's suffix."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    number = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count_of(path, "/"),
        "labels": count_of(host, r"\."),
        "digits": count_of(url, "[0-9]"),
        "digit_ratio": ratio(count_of(url, "[0-9]"), F.length(url)),
        "host_digits": count_of(host, "[0-9]"),
        "hyphens": count_of(host, "-"),
        "parameters": F.when(query != "", 1 + count_of(query, "&")).otherwise(0),
        "query_length": F.length(query),
        "fragment": F.when(F.instr(url, "#") > 0, 1).otherwise(0),
        "extension": F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1).otherwise(0),
        "entropy": entropy("url"),
        "host_entropy": entropy("host"),
        "secure": F.when(F.lower(url).startswith("https"), 1).otherwise(0),
    }
    made = rows.withColumns({k: v.cast("double") for k, v in number.items()})
    return made.withColumn("suffix", F.regexp_extract(host, r"([^.]*)$", 1))


#: Weight of the overall share of blocked URLs in a suffix's own, in URLs.
PRIOR = 2.0


def counts_by(labelled: DataFrame, *names: str, of: str) -> DataFrame:
    """Labelled URLs and blocked ones by these columns, as `<of>_n` and `<of>_b`."""
    blocked = F.sum(F.when(F.col("told") == BLOCK, 1).otherwise(0))
    return labelled.groupBy(*names).agg(F.count(F.lit(1)).alias(f"{of}_n"), blocked.alias(f"{of}_b"))


def with_statistics(rows: DataFrame, totals: DataFrame, hosts: DataFrame | None, share: float) -> DataFrame:
    """suffix_blocked and suffix_seen over all labelled URLs; with `hosts`, over those of other hosts."""
    made = rows.join(totals, "suffix", "left")
    n, b = (F.coalesce(f"all_{c}", F.lit(0)) for c in "nb")
    if hosts is not None:
        made = made.join(hosts, ["suffix", "host"], "left")
        n, b = n - F.coalesce("host_n", F.lit(0)), b - F.coalesce("host_b", F.lit(0))
    blocked = (b + F.lit(PRIOR * share)) / (n + F.lit(PRIOR))
    return made.withColumns({"suffix_blocked": blocked.cast("double"), "suffix_seen": F.log1p(n.cast("double"))})


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of a block where no rule fits."""
    rows = checkpointed(with_rule(with_parts(pages), rules)).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    labelled = rows.where(F.col("told").isNotNull())
    kinds = {r["told"]: r["n"] for r in labelled.groupBy("told").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        only = next(iter(kinds), ALLOW)
        return rows.select("page_id", "host", "path", "rule", F.coalesce("told", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    totals = checkpointed(counts_by(labelled, "suffix", of="all"))
    overall = kinds.get(BLOCK, 0) / sum(kinds.values())

    def featured(part: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
        joined = with_statistics(with_features(part.drop("suffix")), totals, hosts, overall)
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)

    share = min(1.0, sample / sum(kinds.values()))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "page_id", "url"), F.lit(1 << 20)) < share * (1 << 20))
    hosts = counts_by(labelled, "suffix", "host", of="host")
    train = featured(chosen, hosts).select("features", F.when(F.col("told") == BLOCK, 1.0).otherwise(0.0).alias("label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, stepSize=0.3).fit(checkpointed(train))
    open_rows = featured(rows.where(F.col("told").isNull()))
    judged = trees.transform(open_rows).withColumn("blocked", vector_to_array("probability")[1])
    names = ("page_id", "host", "path", "rule")
    by_trees = judged.select(*names, F.when(F.col("blocked") >= 0.5, BLOCK).otherwise(ALLOW).alias("verdict"), "blocked")
    by_rule = labelled.select(*names, F.col("told").alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    return by_rule.unionByName(by_trees)
