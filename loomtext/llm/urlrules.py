"""URL filters: hand-written host and path rules first, mined association rules for the rest.

FP-growth over the tokens of labelled URLs finds token combinations that go with a bad label. Only tokens that speak for the
bad label are mined, and of tokens that always occur together one, so that a template's words do not multiply. Its sets are counted again over all
tokens of all labelled URLs, pruned by support, confidence and what chance would give, and a rule that a shorter one of at least its confidence implies is dropped. Matching uses an
inverted index: each rule is filed under its rarest token, URLs look rules up by their tokens, and the
remaining tokens of a rule are then tested on the URL. FP-growth's work doubles with each token of a basket; where baskets are wide, sets are found level by
level instead, from the same tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Host, path and verdict of the fixed rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: every suffix of the host, its first label, runs of letters in the path, and the names of query parameters."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.greatest(F.size(labels), F.lit(1))), ".")))
    words = F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+"), F.lit(0)), lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    first = F.array(F.concat(F.lit("first:"), F.coalesce(F.get(labels, F.lit(0)), F.lit(""))))
    return F.array_distinct(F.concat(suffixes, first, words, names))


def _baskets(known: DataFrame, least: float) -> DataFrame:
    """From (_row, items, bad) to the same with those tokens only that can make a rule.

    A token stays if it occurs in ``least`` bad URLs and its share of bad ones is above that of all URLs; of tokens that occur in the
    same URLs the first by name stays, the shortest of them being as good as all.
    """
    each = known.select("_row", "bad", F.explode("items").alias("item"))
    rate = known.agg(F.avg(F.col("bad").cast("double")).alias("rate"))
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"), F.sum(F.xxhash64("_row").cast("decimal(20,0)")).alias("where"))
    counts = counts.where(F.col("hits") >= least).withColumn("share", F.col("hits") / F.col("n")).join(F.broadcast(rate)).where("share > rate")
    one = counts.groupBy("n", "hits", "where").agg(F.min("item").alias("item")).select("item")
    kept = each.join(one, "item").groupBy("_row").agg(F.collect_list("item").alias("items"))
    return known.select("_row", "bad").join(kept, "_row").select("_row", "items", "bad")


def _by_levels(baskets: DataFrame, least: float, longest: int) -> DataFrame:
    """Sets of up to ``longest`` tokens (tokens) that ``least`` bad baskets hold and that no shorter set makes redundant, from (_row, items, bad).

    Two sets of a basket that differ in their last token make one of the next level. A set goes no further if all baskets that hold it are bad, or if
    one without a token of it occurs in the same baskets: what follows is then as sure without that token. Work grows with the pairs of
    a basket's sets, not with all its subsets.
    """
    rows = baskets.select("_row", "bad", F.explode("items").alias("_t")).select("_row", "bad", F.array("_t").alias("tokens"))
    found = None
    for size in range(1, longest + 1):
        rows = materialize(rows, "level")
        sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("hits")).where(F.col("hits") >= least)
        if found is not None:
            # every set without one of the tokens is open and occurs in more baskets
            less = sets.select("tokens", "n", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("less"))
            open_ = found.where((F.col("hits") < F.col("n")) & (F.size("tokens") == size - 1)).select(F.col("tokens").alias("less"), F.col("n").alias("_n"))
            free = less.join(open_, "less").where("_n > n").groupBy("tokens").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == size).select("tokens")
            sets = sets.join(free, "tokens")
        sets = materialize(sets, "sets")
        found = sets if found is None else found.unionByName(sets)
        if size == longest or not sets.where("hits < n").count():
            break
        held = rows.join(sets.where("hits < n").select("tokens"), "tokens").select("_row", "bad", F.slice("tokens", 1, size - 1).alias("_p"), F.element_at("tokens", -1).alias("_t"))
        rows = held.join(held.select("_row", "_p", F.col("_t").alias("_u")), ["_row", "_p"]).where("_t < _u").select("_row", "bad", F.concat("_p", F.array("_t", "_u")).alias("tokens"))
    return found.select("tokens")


def counted(known: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (tokens, rid) with key, freq and hits: the rarest token, and in how many rows of ``known`` (items, bad) and bad ones all tokens occur.

    A set meets the rows that hold its rarest token only.
    """
    each = known.select("items", "bad", F.explode("items").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    rarest = sets.select("rid", F.explode("tokens").alias("key")).join(often, "key").groupBy("rid").agg(F.min(F.struct("f", "key")).alias("k"))
    filed = sets.join(rarest, "rid").select("rid", "tokens", F.col("k.key").alias("key"))
    met = each.join(filed, "key").where(F.size(F.array_except("tokens", "items")) == 0)
    return filed.join(met.groupBy("rid").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("bad").cast("long")).alias("hits")), "rid")


def mine(urls: DataFrame, labels: DataFrame, id_col: str, url_col: str, label_id: str, label_col: str, support: float = 0.01, confidence: float = 0.5, longest: int = 4, least: int = 5, widest: int = 12, sure: float = 4.0, partitions: int | None = None) -> DataFrame:
    """Rules (tokens, key, support, confidence, lift) for URLs that ``labels`` marks 0.

    Support is a share of the labelled URLs, and ``least`` bad URLs at that: fewer say nothing about others. FP-growth proposes sets of up to
    ``longest`` tokens if no basket has more than ``widest``, else they are found level by level, with the same rules as result; how often each occurs and how often in bad URLs is then counted over the whole token sets of
    all labelled URLs. A rule stays if its confidence reaches ``confidence`` and the lower end of the confidence's interval (Wilson's, ``sure``
    standard errors wide) lies above the share of bad URLs overall, so that it says more than chance. Lift is confidence over that share. An id with several
    labels is bad if one of them is. FP-growth projects the transactions by item over Spark's partitions. Numeric
    parts of paths are no tokens. Null URLs and labels are left out, repeated rows count as often as they occur; without labelled URLs there
    are no rules.
    """
    url = F.col(f"`{url_col}`").cast("string")
    marks = labels.select(F.col(f"`{label_id}`").alias("_id"), F.col(f"`{label_col}`").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    known = urls.where(url.isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), tokens_of(host_of(url), path_of(url), url).alias("items")).join(marks, "_id")
    known = materialize(known.select(F.xxhash64("_id", "items", F.monotonically_increasing_id()).alias("_row"), "items", (F.col("_y") == 0).alias("bad")), "known")
    empty = urls.sparkSession.createDataFrame([], "tokens array<string>, key string, support double, confidence double, lift double")
    n = known.count()
    often = max(float(least), support * n)
    baskets = materialize(_baskets(known, often), "baskets")
    held, width = baskets.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if not held:
        return empty
    if width <= widest:
        marked = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items"))
        # shares here are of the baskets that hold a token at all; sets are proposed by support alone, half a basket lower as shares are rounded
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.5, often - 0.5) / held), minConfidence=confidence, numPartitions=partitions or urls.sparkSession.sparkContext.defaultParallelism).fit(marked)
        sets = model.freqItemsets.where(F.array_contains("items", _BAD) & F.size("items").between(2, longest + 1)).select(F.array_sort(F.array_remove("items", _BAD)).alias("tokens"))
    else:
        sets = _by_levels(baskets, often, longest)
    sets = sets.withColumn("rid", F.xxhash64("tokens"))
    rules = counted(known, sets)
    rate = known.agg(F.avg(F.col("bad").cast("double")).alias("rate"))  # one row
    share, z2 = F.col("hits") / F.col("freq"), sure * sure
    lower = (share + z2 / (2 * F.col("freq")) - sure * F.sqrt(share * (1 - share) / F.col("freq") + z2 / (4 * F.col("freq") * F.col("freq")))) / (1 + z2 / F.col("freq"))
    rules = rules.withColumn("confidence", share).withColumn("_lower", lower).join(F.broadcast(rate)).withColumn("lift", F.col("confidence") / F.col("rate"))
    rules = rules.where((F.col("hits") >= often) & (F.col("confidence") >= confidence) & (F.col("_lower") > F.col("rate")))
    rules = rules.select("tokens", "key", (F.col("hits") / F.lit(float(n))).alias("support"), "confidence", "lift")
    rules = materialize(rules, "rules")
    # a rule is redundant if one with fewer of its tokens is as sure: these share a key token with it
    shorter = rules.select(F.col("tokens").alias("less"), F.col("key").alias("token"), F.col("confidence").alias("sure"))
    each = rules.select("*", F.explode("tokens").alias("token")).join(shorter, "token")
    implied = each.where((F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti").select("tokens", "key", "support", "confidence", "lift")


def judge(urls: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """All columns of ``urls``, then host, path, rule, verdict and confidence.

    A fixed rule fits its host and all subdomains if the path starts with the rule's; the longest that fits (host and path
    together) decides, of equally long ones the last given. Otherwise a URL is blocked if a mined rule's tokens all occur in it and allowed if none does;
    confidence is that of the surest rule. Null URLs and those without ``://`` have an empty host and path and match no fixed
    rule. Repeated rows are judged alike. Columns called like a result are replaced by it; an empty table gives an empty result.
    """
    results = ("host", "path", "rule", "verdict", "confidence")
    names = [c for c in urls.columns if c not in results]
    own = [f"_c{k}" for k in range(len(names))]
    url = F.col(f"`{url_col}`").cast("string")
    held = urls.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, own, strict=True)), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(fixed, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    held = held.withColumn("rule", rule).withColumn("_said", verdict)
    # the rules judge each distinct URL that no fixed rule fits, once
    open_ = held.where("rule is null and _url is not null").select("_url", "host", "path").distinct().withColumn("_tokens", tokens_of(F.col("host"), F.col("path"), F.col("_url")))
    hit = open_.select("_url", "_tokens", F.explode("_tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("tokens", "_tokens")) == 0)
    blocked = hit.groupBy("_url").agg(F.max("confidence").alias("confidence"))
    out = held.join(blocked, "_url", "left")
    confidence = F.when(F.col("rule").isNull(), F.col("confidence"))
    says = F.coalesce(F.col("_said"), F.when(confidence.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, own, strict=True)), "host", "path", "rule", says.alias("verdict"), confidence.alias("confidence"))
