"""URL filters: a fixed rule list, and association rules mined from labelled URLs.

A rule list entry is (verdict, host/path): it fits its host and all subdomains
where the URL's path starts with the rule's; the longest entry wins.  URLs that
no entry fits are judged by association rules.  A URL is a basket of tokens
(host, its parent domains, path segments that are no numbers, query keys);
FP-growth over labelled baskets finds token combinations, of which those whose
rule ``tokens -> label`` has the support and confidence are kept, where the
URLs that bear the rule out were labelled for ``MIN_CAUSES`` different causes:
what only one cause teaches (one list entry, one host) says nothing of URLs
that it does not reach.  They are
matched by an inverted index: each rule is filed under its rarest token, a
URL's tokens look their rules up, and a rule holds where all its tokens are
there.  The rule of highest confidence decides, then the larger support, the
longer rule, and its text.

All work is DataFrame and ML functions.  Defined results: a null URL or one
without ``://`` has an empty host and path, fits nothing and is allowed;
without labelled URLs nothing is mined; a null label or cause teaches nothing;
repeated rows are judged alike; other columns are kept in ``row``.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from squadron.session import stage_table

#: The rule list of the contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.95
MIN_CAUSES = 2
DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``row`` (the input row), url, host, path and query (with the fragment)."""
    url = F.coalesce(pages[url_col].cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract("url", _PARTS, k)
    return (pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), url.alias("url"))
            .select("row", "url", F.translate(part(1), _UPPER, _LOWER).alias("host"),
                    part(2).alias("path"), part(3).alias("query")))


def listed(rules: list[tuple[str, str]], wanted: str) -> Column:
    """The longest fitting entry's text ("rule") or its verdict."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits = (((F.col("host") == host) | F.col("host").endswith(f".{host}"))
                & F.col("path").startswith(f"/{path}"))
        value = F.lit(rule if wanted == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def tokens() -> Column:
    """Distinct tokens of a URL with its parts."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.rlike(r"^[0-9]+\z")),
                           lambda s: F.concat(F.lit("path:"), s))
    keys = F.transform(F.regexp_extract_all("query", F.lit(r"[?&]([^=&#]+)"), F.lit(1)),
                       lambda k: F.concat(F.lit("query:"), k))
    return F.array_distinct(F.concat(F.when(F.col("host") != "", hosts).otherwise(F.array()), segments, keys))


def labelled_by(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The URLs that a rule list decides: url, label (the verdict), cause (the rule)."""
    return (with_parts(pages, url_col)
            .select("url", listed(rules, "verdict").alias("label"), listed(rules, "rule").alias("cause"))
            .filter("label is not null"))


def _baskets(labelled: DataFrame) -> DataFrame:
    """tokens, label, cause of rows with url, label and, if given, cause (else the host is the cause)."""
    cause = F.col("row.cause").cast("string") if "cause" in labelled.columns else F.col("host")
    return (with_parts(labelled).select(tokens().alias("tokens"), F.col("row.label").cast("string").alias("label"),
                                        cause.alias("cause"))
            .filter("label is not null and cause is not null"))


def mine(labelled: DataFrame) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support, filed, causes) from rows
    with ``tokens``, ``label`` and ``cause``; ``filed`` is the antecedent's rarest
    token.  The rows are written once, as FP-growth reads them several times."""
    taught = stage_table(labelled.select("tokens", "label", "cause"), "url-baskets")
    baskets = taught.select(F.concat("tokens", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(baskets)
    found = (model.associationRules.filter(F.col("consequent")[0].startswith("label:"))
             .filter(~F.exists("antecedent", lambda t: t.startswith("label:")))
             .select(F.array_sort("antecedent").alias("antecedent"),
                     F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support"))
    count = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = stage_table(found, "url-rules")
    filed = (found.withColumn("token", F.explode("antecedent")).join(count, "token")
             .groupBy("antecedent", "verdict", "confidence", "support")
             .agg(F.min(F.struct("freq", "token"))["token"].alias("filed")))
    filed = stage_table(filed, "url-filed")
    causes = (taught.select("tokens", "label", "cause", F.explode("tokens").alias("filed")).join(filed, "filed")
              .filter((F.col("label") == F.col("verdict")) & (F.size(F.array_except("antecedent", "tokens")) == 0))
              .groupBy("antecedent", "verdict").agg(F.count_distinct("cause").alias("causes"))
              .filter(F.col("causes") >= MIN_CAUSES))
    return stage_table(filed.join(causes, ["antecedent", "verdict"]), "url-index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each distinct url: url, mined (verdict), because
    (tokens), confidence.  ``urls`` has url and tokens."""
    looked = urls.distinct().select("url", "tokens", F.explode("tokens").alias("filed"))
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("size"),
                          F.array_join("antecedent", " ").alias("because"), "verdict"))
    return (looked.join(rules, "filed").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("url").agg(best.alias("best"))
            .select("url", F.col("best.verdict").alias("mined"), "best.because", "best.confidence"))


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES,
          labelled: DataFrame | None = None) -> DataFrame:
    """row, host, path, rule, verdict, because, confidence.  ``labelled`` has
    url, label (allow or block) and, if known, cause (why it has the label; else
    its host); by default the URLs that the list decides (``labelled_by``)."""
    parts = with_parts(pages, url_col)
    known = (parts.select("row", "url", "host", "path", listed(rules, "rule").alias("rule"),
                          listed(rules, "verdict").alias("listed"), tokens().alias("tokens")))
    taught = _baskets(labelled_by(pages, rules, url_col) if labelled is None else labelled)
    open_urls = known.filter("rule is null").select("url", "tokens")
    mined = matched(open_urls, mine(taught))
    return (known.join(mined, "url", "left")
            .select("row", "host", "path", "rule",
                    F.coalesce("listed", "mined", F.lit(DEFAULT)).alias("verdict"),
                    F.when(F.col("rule").isNull(), F.col("because")).alias("because"),
                    F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence")))
