"""URL filters: logistic regression on hashed character n-grams of host and path.

Trained from a small labelled URL table that is part of this module. Only
DataFrame functions and Spark ML are used. Written rules go first: the longest
rule whose host is the url's host or a parent domain of it, and whose path is a
prefix of the url's path; without a rule the model decides.

Defined cases: null urls and urls without ``://`` have an empty host and path,
match no rule and get the model's verdict on an empty text; repeated rows are
judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The labelled URL table: hosts of either kind, each with two paths.
BLOCKED_HOSTS = """
casino casino-royal best-casino online-casino casino-bonus mega-casino slots-jackpot jackpot-slots poker-room free-poker
poker-win poker-stars win-big winner-slots bets-online sports-bets lucky-bets bet-now bet24 bet-bonus betting-tips mybets
cheap-meds cheap-pharma pills-online discount-pills pills-shop diet-pills pharma-cheap viagra-shop cheap-viagra cialis-now
adult-cams adult-video adult-tube sexy-adult xxx-video xxx-tube hot-cams free-porn porn-x porn-tube pornstars live-sex
sex-cams sexvideos spam-links seo-spam spam-mail link-farm click-farm farm-links ads-server ads-click popup-ads track-ads
click-track ad-tracker pixel-track free-loans payday-loans quick-cash win-money free-money get-rich-fast crypto-double
cheap-watches replica-bags free-gift free-prize free-spins warez-crack keygen-crack torrent-warez
""".split()
ALLOWED_HOSTS = """
news daily weather science history library museum archive journal gazette university college physics biology garden
cooking recipes travel railway harbour mountain river forest painting theatre orchestra football cricket chess
mathematics statistics astronomy medicine hospital teacher student parent village council parliament court justice
python database compiler engineering bridge brindle marlow tessera quillon verdano halden morrowind pelican thistle
weatherby northolt ashdown the-other these-things breath-of-air thinking another mother gathering whether-report
wikipedia github openstreetmap gutenberg britannica nature physicsworld bookshop cityhall theguide thelocal hether
""".split()
LABEL_PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/", "/articles/{n}"]
LABEL_DOMAINS = ["example.com", "example.net", "example.org"]
LABEL_PREFIXES = ["", "www.", "blog.", "m."]

GRAMS = (3, 4, 5)
FEATURES = 1 << 14
RIDGE = 0.002


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _pieces(text: Column, n: int, mark: str) -> Column:
    """Every run of ``n`` characters with its mark; a shorter text is one piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(text, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and of the path without its digits, each kind with a mark of its own."""
    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.regexp_replace(path, "[0-9]+", "0")))
    return F.concat(*[_pieces(text, n, mark) for mark, text in marked for n in GRAMS])


def labelled(spark: SparkSession) -> DataFrame:
    """``url, label`` (1 means block): a small table, written out above."""
    rows, n = [], 0
    for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)):
        for i, h in enumerate(hosts):
            for k in range(4):
                n = 7 * i + 101 * k + 3
                path = LABEL_PATHS[(i + k) % len(LABEL_PATHS)].format(n=n)
                rows.append(f"('http://{LABEL_PREFIXES[(i + k) % 4]}{h}.{LABEL_DOMAINS[(i + 2 * k) % 3]}{path}', {label}D)")
    return spark.sql(f"select * from values {', '.join(rows)} as t(url, label)")


def _hashed(df: DataFrame) -> DataFrame:
    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="url_grams", outputCol="url_features")
    return tf.transform(df)


def fit(spark: SparkSession):
    host, path = host_path(F.col("url"))
    train = _hashed(labelled(spark).select("label", grams(host, path).alias("url_grams")))
    return LogisticRegression(featuresCol="url_features", labelCol="label", regParam=RIDGE, maxIter=50,
                              predictionCol="url_pred", probabilityCol="url_prob", rawPredictionCol="url_raw",
                              standardization=False).fit(train)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest fitting rule, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, block_score``."""
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = fit(pages.sparkSession).transform(_hashed(df.withColumn("url_grams", grams(F.col("host"), F.col("path")))))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = vector_to_array("url_prob")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.round(p, 6).alias("block_score"))
