"""URL filters with DataFrame functions only: host and path rules, and a ratio of variable-order character models for the rest."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.chunks import number_of, numbered, written
from candlewick.llm.samples import FOLDS, HELD_OUT

#: Symbols of a URL in lower case; any other character is one more, and so is the mark before its beginning.
SYMBOLS = string.ascii_lowercase + string.digits + "/.-_?=&%#:"
_OTHER, _MARK = "~", "^"
SIZE = len(SYMBOLS) + 2

#: The most characters of context, and how often a context of the labelled URLs must occur to be used.
CONTEXT, SUPPORT = 5, 4
#: What has a share of more than one in HOT of all rows is joined by broadcast, HOT rows at most, instead of by shuffle.
HOT, HOT_LENGTH = 1000, 4096
_VERDICTS = ("allow", "block")
#: Log ratios are summed as integers of this unit, so their order doesn't matter.
_UNIT = 1_000_000

#: (verdict, host and path) of the fixed rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ://, up to a slash, question mark, number sign or the end, in lower case; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and for each character of url g: it and the CONTEXT symbols before it."""
    symbols = F.regexp_replace(_lower(F.col("url")), f"[^{SYMBOLS.replace('-', '')}-]", _OTHER)
    marked = F.concat(F.lit(_MARK * CONTEXT), symbols)
    return urls.select(*keep, F.explode(F.regexp_extract_all(marked, F.lit(f"(?=(.{{{CONTEXT + 1}}}))"), F.lit(1))).alias("g"))


def gram_counts(urls: DataFrame) -> DataFrame:
    """Columns g, n, n_allow, n_block: how many URLs have a gram, and how many rows of accepted and rejected training URLs.

    urls: distinct ones, with columns url, given (a verdict or null), rows, trains. The rows are those that the URLs have.
    """
    counted = lambda k: F.sum(F.when(F.col("trains") & (F.col("given") == k), F.col("rows")).otherwise(0)).alias(f"n_{k}")
    return grams(urls, "given", "rows", "trains").groupBy("g").agg(F.count("*").alias("n"), *map(counted, _VERDICTS))


def model(counts: DataFrame) -> DataFrame:
    """Columns g, n, w: for each gram of ``gram_counts`` the log ratio of its last symbol's probabilities after the others.

    Both models have the contexts that their URLs have, so the table grows with the input. The probability after a context
    of k symbols mixes its own counts with that after the last k - 1, which weighs as much as the context has different
    followers; a context that occurs in fewer than SUPPORT training rows is passed over. Each level is computed from the
    one below by a join in which a key has SIZE rows at most.
    """
    level = None
    for k in range(CONTEXT + 1):
        own = counts.groupBy(F.substring("g", CONTEXT + 1 - k, k + 1).alias("s")).agg(*(F.sum(f"n_{v}").alias(f"n_{v}") for v in _VERDICTS)) if k < CONTEXT else counts.select(F.col("g").alias("s"), *(f"n_{v}" for v in _VERDICTS))
        if level is None:
            total = {v: F.sum(f"n_{v}").over(Window.partitionBy(F.lit(1))) for v in _VERDICTS}  # of SIZE rows
            level = own.select("s", *(((F.col(f"n_{v}") + 1) / (total[v] + SIZE)).alias(f"p_{v}") for v in _VERDICTS))
            continue
        after = Window.partitionBy("context")
        own = own.withColumn("context", F.substring("s", 1, k))
        own = own.withColumns({f"t_{v}": F.sum(f"n_{v}").over(after) for v in _VERDICTS} | {f"kinds_{v}": F.count_if(F.col(f"n_{v}") > 0).over(after) for v in _VERDICTS})
        shorter = level.select(F.col("s").alias("short"), *(F.col(f"p_{v}").alias(f"q_{v}") for v in _VERDICTS))
        both = own.withColumn("short", F.substring("s", 2, k)).join(shorter, "short")
        mixed = lambda v: F.when(F.col("t_allow") + F.col("t_block") < SUPPORT, F.col(f"q_{v}")).otherwise((F.col(f"n_{v}") + F.greatest(f"kinds_{v}", F.lit(1)) * F.col(f"q_{v}")) / (F.col(f"t_{v}") + F.greatest(f"kinds_{v}", F.lit(1))))
        level = both.select("s", *(mixed(v).alias(f"p_{v}") for v in _VERDICTS))
    weights = level.select(F.col("s").alias("g"), F.round((F.ln("p_allow") - F.ln("p_block")) * _UNIT).cast("bigint").alias("w"))
    return counts.select("g", "n").join(weights, "g")


def url_scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows of urls with score, the mean log ratio of their characters. Grams that many URLs have are joined by broadcast.

    Column no numbers the URLs: it goes with each character in place of the URL.
    """
    total = weights.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(weights.where(F.col("n") * HOT >= total).select("g", F.col("w").alias("hot_w")))
    found = grams(urls, "no").join(hot, "g", "left")
    here = found.where("hot_w is not null").select("no", F.col("hot_w").alias("w"))
    there = found.where("hot_w is null").select("no", "g").join(weights.where(F.col("n") * HOT < total).select("g", "w"), "g").select("no", "w")
    partial = lambda rows: rows.groupBy("no").agg(F.sum("w").alias("w"))
    sums = partial(here).union(partial(there)).groupBy("no").agg(F.sum("w").alias("w"))
    return urls.join(sums, "no", "left").withColumn("score", F.coalesce(F.col("w") / F.length("url") / _UNIT, F.lit(0.0))).drop("w")


def threshold_of(scored: DataFrame) -> float:
    """The score at an equal number of standard deviations from the means of accepted and rejected URLs, 0 where one kind is missing.

    It is taken from the labelled URLs that don't train the models; of a kind that has none of these, from all.
    """
    x, n = F.col("score"), F.col("rows")
    parts = []
    for v in _VERDICTS:
        for held in (True, False):
            own = (F.col("given") == v) & (~F.col("trains") if held else F.lit(True))
            parts += [F.sum(F.when(own, e)).alias(f"{v}_{held}_{i}") for i, e in enumerate((n, n * x, n * x * x))]
    sums = scored.agg(*parts).first()
    found = []
    for v in _VERDICTS:
        rows, first, second = next(([sums[f"{v}_{held}_{i}"] for i in range(3)] for held in (True, False) if sums[f"{v}_{held}_0"]), (0, 0, 0))
        if not rows:
            return 0.0
        found.append((first / rows, max(0.0, second / rows - (first / rows) ** 2) ** 0.5))
    (a, sa), (b, sb) = found
    return round((a * sb + b * sa) / (sa + sb) if sa + sb > 0 else (a + b) / 2, 6)


def url_filter(pages: DataFrame, rules: tuple = RULES, url_col: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule, score, verdict (columns of these names are replaced, all others stay).

    The longest rule that fits gives the verdict. URLs with one are accepted and rejected samples: four fifths of the
    different ones, by crc32, train the models, the rest calibrate the threshold. A URL without a rule is allowed if its
    score, the mean log ratio of its characters, is at least the threshold. Null URLs and those without :// have an empty
    host and path, so no rule; a null or empty URL scores 0. Repeated rows count as often in the samples; a URL may have
    any length. Counts are gathered from all rows; distinct URLs are scored once and joined back, those that hold many
    rows by broadcast.
    """
    pages = pages.drop(*(n for n in pages.columns if n.lower() in ("host", "path", "rule", "score", "verdict") and n != url_col))
    own, url = numbered(pages), F.col(number_of(pages, url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = own.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": rule, "given": verdict})
    trains = F.crc32(F.col("url").cast("binary")) % FOLDS != HELD_OUT
    urls = ruled.where(url.isNotNull()).groupBy(url.alias("url"), "given").agg(F.count("*").alias("rows")).withColumn("trains", trains)
    urls = written(urls.withColumn("no", F.monotonically_increasing_id()), "urls")  # numbers that are written stay as they are
    weights = written(model(written(gram_counts(urls), "url-grams")), "url-model")
    scores = written(url_scores(urls, weights), "url-scores")
    threshold, total = threshold_of(scores), scores.agg(F.sum("rows")).first()[0] or 0
    is_hot = (F.col("rows") * HOT >= total) & (F.length("url") <= HOT_LENGTH)
    hot = F.broadcast(scores.where(is_hot).select(F.col("url").alias("scored_url"), F.col("score").alias("hot_score")))
    near = ruled.join(hot, url == F.col("scored_url"), "left").drop("scored_url")
    missing = F.col("hot_score").isNull() & url.isNotNull()
    rest = scores.where(~is_hot).select(F.col("url").alias("scored_url"), "score")
    others = near.where(missing).join(rest, url == F.col("scored_url"), "left").drop("scored_url")
    scored = near.where(~missing).withColumn("score", F.col("hot_score")).unionByName(others).withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("given", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    made = ("host", "path", "rule", "score", "verdict")
    return scored.withColumn("verdict", verdict).select(*own.columns, *made).toDF(*pages.columns, *made)
