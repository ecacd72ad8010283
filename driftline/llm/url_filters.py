"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

A rule is a host with a path, such as ``example.net/en/``. It fits its host and all subdomains if the URL's path starts
with the rule's path; the longest fitting rule wins. Rules are few and become one column expression. URLs that no rule
fits get the model's verdict: character n-grams of host and path, hashed, weighed by a logistic regression that
``pyspark.ml`` trains on a small labelled URL table. All of it runs in Spark's JVM.

The table that comes with this module (``labelled_urls``) was written for it: names of junk sites (pills, casinos, loans, link
farms) and of ordinary ones, made of some fifty words each (the ordinary ones of letters too) by a rule, with a few paths. Any table (host, path, blocked) can take its place.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict that the model
gives to the empty text. Rows with one URL get one verdict. Without labelled URLs of both kinds all unruled URLs are
allowed. Very long URLs are taken whole. Extra columns, whatever their names, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_by_hash, staged, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: n-gram lengths, hash buckets, and the bound on labelled rows of either kind.
GRAMS, BUCKETS, MAX_LABELLED = (3, 4, 5), 1 << 16, 5_000
#: Labelled URLs of a name.
PER_NAME = 4


#: Words of names before the domain: blocked, allowed. Written for this module.
JUNK_WORDS = """
cheap free online casino poker slots bets win prize lottery jackpot pills viagra meds pharma diet cure loans payday cash credit money crypto
forex profits rich seo links backlink spam farm clickbait traffic adult cams singles porn sexy replica rolex handbags outlet discount deals
bonus giveaway survey rewards crack keygen warez torrent serial hacked phishing scraper
""".split()
PLAIN_WORDS = """
library museum garden weather recipes history travel science physics chemistry biology geology maths astronomy archive journal news press
radio orchestra theatre cinema painting sculpture poetry language dictionary school college university hospital clinic council parliament
court railway harbour airport transit cycling hiking sailing football tennis chess software kernel compiler database network research
observatory village county region
""".split()
#: Frequent pairs of letters in English: most names are no words, and that alone is nothing bad.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
FRONTS = ("", "www.", "blog.", "m.")
DOMAINS = ("example.com", "example.org", "example.net", "site.com", "pages.org", "web.net")
JUNK_PATHS = ("/buy-now", "/offer/{n}", "/win", "/click/{n}.html", "/en/{n}", "/de/{n}/", "/fr/{n}", "/es/{n}.html", "/{n}", "/")
PLAIN_PATHS = ("/about", "/article/{n}", "/papers/{n}", "/index.html", "/en/{n}", "/de/{n}/", "/fr/{n}", "/es/{n}.html", "/{n}", "/")


def names_of(words: list[str]) -> list[str]:
    """Each word alone, with a hyphen before another, and joined to a third."""
    n = len(words)
    pairs = ((w, words[(5 * i + 1) % n], words[(11 * i + 3) % n]) for i, w in enumerate(words))
    return [name for w, a, b in pairs for name in (w, f"{w}-{a}", f"{w}{b}")]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """host, path, blocked, name: names of either kind, each with ``PER_NAME`` combinations of what stands before and behind it."""
    rows, n = [], len(PAIRS)
    letters = [PAIRS[i % n] + "".join(PAIRS[(i * step + i // n) % n] for step in (3, 7, 1)[: 1 + i % 3]) for i in range(6 * n)]
    for blocked, names, paths in ((1, names_of(JUNK_WORDS), JUNK_PATHS), (0, names_of(PLAIN_WORDS), PLAIN_PATHS), (0, letters, PLAIN_PATHS)):
        for i, name in enumerate(names):
            for k in range(PER_NAME):
                path = paths[(i + 3 * k) % len(paths)].format(n=(37 * i + 101 * k) % 1000)
                rows.append((f"{FRONTS[(i + k) % len(FRONTS)]}{name}.{DOMAINS[(i + 5 * k) % len(DOMAINS)]}", path, blocked, name))
    return spark.createDataFrame(rows, "host string, path string, blocked int, name string").coalesce(1)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def first_rule(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda x: len(x[1])):
        hit = fits(name, host, path)
        rule, verdict = F.when(hit, F.lit(name)).otherwise(rule), F.when(hit, F.lit(what)).otherwise(verdict)
    return rule, verdict


def pieces(text: Column, mark: str, n: int) -> Column:
    """All n-grams of ``text`` after ``mark``; a shorter text is one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``; those of host and path differ by a mark."""
    framed = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(F.lit("^"), path, F.lit("$")), "p"))
    return F.concat(*[pieces(text, mark, n) for text, mark in framed for n in GRAMS])


@dataclass
class UrlModel:
    """A fitted regression, or none where the labelled table has one kind only."""

    fitted: LogisticRegressionModel | None

    def blocked(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with host, path) and a double column ``p_block``."""
        if self.fitted is None:
            return urls.withColumn("p_block", F.lit(0.0))
        made = self.fitted.transform(features(urls))
        return made.withColumn("p_block", vector_to_array("probability")[1]).select(*urls.columns, "p_block")


def features(urls: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams_", outputCol="features_", numFeatures=BUCKETS, binary=True).transform(urls.withColumn("grams_", grams(F.col("host"), F.col("path"))))


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """Fit on rows (host, path, blocked 0/1): at most ``max_rows`` of either kind, those of least hash."""
    labelled = labelled.withColumn("place_", F.monotonically_increasing_id())  # rows of one URL are dealt apart
    kinds = [least_by_hash(labelled.where(F.col("blocked") == k), max_rows, "host", "path", "place_") for k in (0, 1)]
    sample = staged(kinds[0].unionByName(kinds[1]).select("host", "path", F.col("blocked").cast("double").alias("label_")), "url-labelled")
    if sample.select("label_").distinct().count() < 2:
        return UrlModel(None)
    fit = LogisticRegression(featuresCol="features_", labelCol="label_", probabilityCol="probability", rawPredictionCol="raw_", predictionCol="predicted_", regParam=0.001, maxIter=30)
    return UrlModel(fit.fit(features(sample).coalesce(8)))


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: one row per page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    made = model.blocked(urls).withColumn("rule", rule)
    return made.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages: the rules', else those of a regression on the module's labelled URLs."""
    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")
