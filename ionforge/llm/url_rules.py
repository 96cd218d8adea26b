"""URL filters from pattern rules that are indexed by their rarest literal token.

Every rule names a regular expression and the literal tokens that each match
must contain. The index keeps a rule under the one of its tokens that fewest
distinct URLs hold. URL tokens fetch the candidate rules with a join, and only
candidates run their expression. All of it is DataFrame operations.

Defined results: a null URL has an empty host and path and no match; repeated
URLs are judged once and joined back; the longest rule wins, ties go to
the larger rule text; a table without rows gives no rows; other columns stay out
of the way, as working columns are private.
"""

from pyspark.sql import functions as F

from ionforge.llm.common import rowed

# The address rules of the contract (host, path, verdict).
ADDRESS_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: The method's own rules: the expression that decides and the tokens that each match holds as whole runs.
PATTERN_RULES = (
    (r"(?i)://([^/?#]*[.-])?spam-farm[.-]", "spam farm"),
    (r"(?i)://([^/?#]*[.-])?cheap-pills[.-]", "cheap pills"),
    (r"(?i)://([^/?#]*[.-])?casino[.-]", "casino"),
    (r"(?i)://([^/?#]*[.-])?poker[.-]", "poker"),
    (r"(?i)://([^/?#]*[.-])?xxx[.-]", "xxx"),
    (r"(?i)://ads[.]", "ads"),
    (r"(?i)/banner/[0-9]+", "banner"),
    (r"(?i)[?&]affiliate=[^&#]+", "affiliate"),
    (r"(?i)/wp-login[.]php", "wp login php"),
    (r"(?i)/cheap-viagra([^a-z0-9]|$)", "cheap viagra"),
)


def url_tokens(url):
    """Distinct lower-case letter and digit runs of a URL."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def host_of(url):
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, address_rules=ADDRESS_RULES, pattern_rules=PATTERN_RULES):
    """One row per rule: its text, kind, expression over the URL, required tokens, verdict and length."""
    rows = []
    for host, path, verdict in address_rules:
        # the address is tested on "host#path": neither part can hold the mark between them
        expression = rf"^([^#]*\.)?\Q{host}\E#\Q{path}\E"
        rows.append((host + path, "address", expression, f"{host} {path}".lower(), verdict, len(host + path)))
    for expression, tokens in pattern_rules:
        rows.append((expression, "pattern", expression, tokens, "block", len(expression)))
    table = spark.createDataFrame(rows, "rule string, kind string, expression string, literal string, verdict string, size int")
    return table.withColumn("tokens", url_tokens(F.col("literal"))).drop("literal")


def indexed(rules, tokens):
    """Each rule with its rarest token: the one that fewest URLs hold, ties to the smaller token."""
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    held = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        wanted.join(held, "token", "left").groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
    )
    return rules.join(rarest, "rule").withColumn("token", F.col("rarest.token")).drop("tokens", "rarest")


def matches(urls, rules):
    """For distinct URLs (column ``url``): the best rule of each kind that matches, for URLs with any."""
    tokens = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    address = F.concat_ws("#", host_of(F.col("url")), path_of(F.col("url")))
    fetched = tokens.join(indexed(rules, tokens), "token")
    hits = fetched.withColumn("subject", F.when(F.col("kind") == "address", address).otherwise(F.col("url"))).where(F.expr("subject rlike expression"))
    longest = F.struct("size", "rule", "verdict")
    return hits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "address", longest)).alias("address"),
        F.max(F.when(F.col("kind") == "pattern", longest)).alias("pattern"),
    )


def judge(pages, rules, url_col="url", default="allow"):
    """Add ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``: the address rule's, else the pattern rule's, else the default."""
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    joined = rowed(pages, url=F.col(url_col)).join(matches(urls, rules), "url", "left")
    made = {
        "host": host_of(F.col("url")),
        "path": path_of(F.col("url")),
        "rule": F.col("address.rule"),
        "pattern": F.col("pattern.rule"),
        "verdict": F.coalesce("address.verdict", "pattern.verdict", F.lit(default)),
    }
    own = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in made]
    return joined.select(*own, *[column.alias(name) for name, column in made.items()])
