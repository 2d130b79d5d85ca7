"""URL filters: rules first, then gradient-boosted trees over lexical features of the URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize

#: (verdict, host, path): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs on which the trees are trained, at most; a hash of the URL draws them.
TRAINING_ROWS = 20_000
TREES, DEPTH = 20, 4
#: Labelled URLs are dealt into folds; those that train the trees see the suffix statistics of the other folds.
FOLDS = 5

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "query_length", "hyphens", "has_extension", "tld_rate", "tld_count", "suffix_rate", "suffix_count")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits. Of equally long ones the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """pages with url, host and path, and the features that the URL alone gives."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c: F.length(url) - F.length(F.replace(url, c, F.lit("")))
    mass = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(count(c) * F.log2(F.greatest(count(c), F.lit(1)))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return pages.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        (F.log2(n) - mass / n).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double").alias("params"),
        F.length(query).cast("double").alias("query_length"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("has_extension"),
        F.element_at(labels, -1).alias("tld"),
        F.concat_ws(".", F.slice(labels, -F.least(F.lit(2), F.size(labels)), F.least(F.lit(2), F.size(labels)))).alias("suffix"),
    )


def labelled_urls(base: DataFrame) -> DataFrame:
    """Of rows with url, host, path and by_rule, the different URLs that a rule decides, with label (1 for block), n, their
    number of rows, and the lexical features."""
    counted = base.where("by_rule IS NOT NULL").groupBy("url", "host", "path", "by_rule").agg(F.count("*").alias("n"))
    return materialize(lexical(counted).withColumn("label", (F.col("by_rule") == "block").cast("double")), "urls")


def drawn_urls(urls: DataFrame, count: int, training_rows: int, seed: int = 42) -> DataFrame:
    """Of count different URLs, some training_rows at most, by a hash."""
    part = min(1.0, training_rows / max(1, count))
    drawn = urls.withColumn("draw", F.xxhash64("url", F.lit(seed))).where(F.pmod("draw", F.lit(1 << 20)) < F.lit(part * (1 << 20)))
    return drawn.orderBy("draw", "url").limit(training_rows).drop("draw")


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(9)), F.lit(FOLDS))


@dataclass
class Trees:
    """Gradient-boosted trees over lexical features and suffix statistics; without a model every chance is the rate."""

    #: The share of blocked rows among the labelled ones.
    rate: float
    #: By key (tld, suffix): a table of the key, its blocked and its labelled rows, in all and in each fold.
    stats: dict[str, DataFrame]
    model: GBTClassificationModel | None

    def featured(self, df: DataFrame, own: bool = False) -> DataFrame:
        """df (as lexical gives it) with features. With own, the rows are labelled ones, and the statistics of a row's suffixes
        leave out the fold that the row is in, so that no row is told its own label."""
        for key, counted in self.stats.items():
            df = df.join(counted, F.col(key) == F.col(f"k_{key}"), "left")
            blocked, rows = F.coalesce(f"{key}_blocked", F.lit(0.0)), F.coalesce(f"{key}_rows", F.lit(0))
            if own:
                at = (fold(F.col("url")) + 1).cast("int")
                blocked, rows = (FOLDS / (FOLDS - 1) * (x - F.coalesce(F.element_at(f"{key}_{name}_in", at), F.lit(0))) for x, name in ((blocked, "blocked"), (rows, "rows")))
            df = df.withColumns({f"{key}_rate": (blocked + 5 * self.rate) / (rows + 5), f"{key}_count": F.log1p(rows)}).drop(*counted.columns)
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    def scored(self, df: DataFrame) -> DataFrame:
        """df with chance, that of a URL to be one to block."""
        if self.model is None:
            return df.withColumn("chance", F.lit(self.rate))
        return self.model.transform(self.featured(lexical(df))).withColumn("chance", F.round(vector_to_array("probability")[1], 9))


def learn_trees(urls: DataFrame, training_rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> Trees:
    """Trees from labelled_urls: at most training_rows different URLs, drawn by a hash and weighted by their numbers of rows.

    The suffix statistics (share of blocked and number of labelled rows of a host's last label and last two labels) are
    counted over all labelled rows and joined by key, broadcast only where Spark finds them small; a label that no labelled
    row has gets the overall share. The trees are fitted in one task: their rows are the bounded sample."""
    sums = urls.agg(F.count("*").alias("urls"), F.sum("n").alias("rows"), F.sum(F.col("label") * F.col("n")).alias("blocked"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    rate = float(sums["blocked"] / sums["rows"]) if sums["rows"] else 0.0
    if not sums["rows"] or sums["least"] == sums["most"]:
        return Trees(rate, {}, None)
    stats = {}
    for key in ("tld", "suffix"):
        sums_of = {"blocked": F.col("label") * F.col("n"), "rows": F.col("n")}
        in_folds = [F.array(*[F.sum(F.when(fold(F.col("url")) == k, x).otherwise(0)) for k in range(FOLDS)]).alias(f"{key}_{name}_in") for name, x in sums_of.items()]
        stats[key] = materialize(urls.groupBy(F.col(key).alias(f"k_{key}")).agg(*[F.sum(x).alias(f"{key}_{name}") for name, x in sums_of.items()], *in_folds), f"url-{key}")
    out = Trees(rate, stats, None)
    train = out.featured(drawn_urls(urls, sums["urls"], training_rows, seed), own=True).select("url", "features", "label", F.col("n").cast("double").alias("n"))
    train = materialize(train.orderBy("url").coalesce(1), "url-train")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="n", maxIter=trees, maxDepth=depth, stepSize=0.3, subsamplingRate=1.0, maxBins=32, seed=seed)
    out.model = gbt.fit(train)
    return out


def _ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...], id_col: str, url_col: str) -> DataFrame:
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return named.withColumn("rule", name).withColumn("by_rule", verdict)


def held_out_accuracy(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", parts: int = 4, **options) -> tuple[float, float, int]:
    """How often trees that learn from all but one in `parts` of the labelled URLs are right about the rows of the others,
    how often the more frequent verdict would be, and the number of these rows."""
    urls = labelled_urls(_ruled(pages, rules, id_col, url_col))
    own = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(parts)) == 0
    found = learn_trees(urls.where(~own), **options).scored(urls.where(own).select("url", "host", "path", "label", "n"))
    right, blocked, n = found.agg(F.sum(F.when((F.col("chance") >= 0.5) == (F.col("label") == 1), F.col("n")).otherwise(0)), F.sum(F.col("label") * F.col("n")), F.sum("n")).first()
    return (right / n, max(blocked, n - blocked) / n, n) if n else (1.0, 1.0, 0)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """A row for each page: id, host, path, the rule that fits, a verdict, and block_chance where the trees gave it.

    The URLs that a rule decides are the labelled ones, from which the trees learn (see learn_trees, whose options these
    are). A URL that no rule decides is blocked if its chance is 0.5 or more. If all labelled URLs have one verdict, that is
    the verdict; without labelled URLs it is allow. Null and malformed URLs have empty host and path and go to the trees
    like others. Repeated rows give repeated rows; an empty table an empty result; other columns are not read.
    """
    base = _ruled(pages, rules, id_col, url_col)
    found = learn_trees(labelled_urls(base), **options).scored(base)
    verdict = F.coalesce("by_rule", F.when(F.col("chance") >= 0.5, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("chance")).alias("block_chance"))
