"""URL filters: fixed rules, then naive Bayes over segmented host names and path tokens."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import written

#: (host, start of the path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Words that a blocked site's name may hold: a prior, not labels.  ``SEED_ODDS``: how much likelier each is taken to be in the block class
#: than elsewhere, before any page is counted.
BLOCK_WORDS = ["ads", "adult", "bet", "bets", "bingo", "casino", "cheap", "jackpot", "loans", "pills", "poker", "porn", "spam", "track", "viagra", "warez", "xxx"]
SEED_ODDS = 50.0
#: Letters of the longest word that the segmentation may take: a whole host label.
LONGEST = 63
#: Words of a to z of up to so many letters are few.
SHORT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together) that fits: struct of its text and verdict; null if none.  A rule fits its host and all
    subdomains if the path starts with the rule's."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def viterbi(token: str, logs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The most likely split of a name.  ``logs``: log probability of the word at (place, length); a single letter that is no word costs
    ``unknown``.  Ties: the longer last word."""
    best, back = [0.0], [0]
    for end in range(1, len(token) + 1):
        options = [(best[end - n] + logs.get((end - n, n), unknown if n == 1 else -1e18), n) for n in range(1, min(LONGEST, end) + 1)]
        top, n = max(options)
        best.append(top)
        back.append(n)
    words, end = [], len(token)
    while end:
        words.append(token[end - back[end] : end])
        end -= back[end]
    return words[::-1]


def segmented(tokens: DataFrame, unigrams: DataFrame, total: float) -> DataFrame:
    """token, words: the split of every distinct token (at most 63 letters, as in a host name).

    All substrings of a token up to ``LONGEST`` letters meet the unigram counts in a join, so the vocabulary may have any size.  Those of up
    to ``SHORT`` letters are the frequent ones; there are at most 18,278 such words, which are broadcast.
    """
    spots = tokens.select("token", F.explode(F.expr("sequence(0, length(token) - 1)")).alias("place"))
    spots = spots.select("token", "place", F.explode(F.expr(f"sequence(1, least({LONGEST}, length(token) - place))")).alias("n"))
    spots = spots.withColumn("word", F.expr("substring(token, place + 1, n)"))
    short = spots.where(F.col("n") <= SHORT).join(F.broadcast(unigrams.where(F.length("word") <= SHORT)), "word")
    known = short.unionByName(spots.where(F.col("n") > SHORT).join(unigrams.where(F.length("word") > SHORT), "word")).groupBy("token").agg(F.collect_list(F.struct("place", "n", "count")).alias("found"))

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            words = []
            for token, found in zip(part["token"], part["found"], strict=True):
                logs = {(f["place"], f["n"]): log(f["count"] / total) for f in ([] if found is None else found)}
                words.append(viterbi(token, logs, log(0.1 / total)))
            yield pd.DataFrame({"token": part["token"], "words": words})

    return tokens.join(known, "token", "left").mapInPandas(split, "token string, words array<string>")


def _tokens_of(path: Column) -> Column:
    """Runs of letters and digits in lower case; a number, whatever it is, is the token ``0``."""
    return F.transform(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != ""), lambda t: F.regexp_replace(t, "^[0-9]+$", "0"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, *, block_words: list[str] = BLOCK_WORDS, trained_on: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score, words for every row of ``pages``.

    verdict: the longest fitting rule's, else 'block' if the naive Bayes score is above 0.  Unigrams: words of all pages' texts without
    markup, and the block words once each.  Host names are split at everything but letters, then by unigram Viterbi.

    Classes: pages that a rule blocks, and all other pages of the crawl; so the classifier learns how hosts are called and what their
    paths hold where the rules block, against the rest.  Multinomial counts of host words and path tokens over all pages; each class is
    smoothed by as many tokens as there are different ones, drawn as in all pages together, so that a token without evidence counts
    for neither class.  ``block_words`` are a prior: each has ``SEED_ODDS`` besides.  score: log odds of block, prior included.
    ``trained_on``: which pages the counts are taken from (a condition on host and path; all by default).

    Null urls, and urls without ``://``, have an empty host and path, and only the prior.  Ties (score 0) are allowed.  Repeated ids
    are judged row by row.  Null html has no words.  An empty table gives no rows.  Counts are summed by host and by path before
    anything is joined; the odds of a host or path come back by plain joins of rows with written tables, whose hot keys Spark splits.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(html_col), r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    lexicon = pages.sparkSession.createDataFrame([(w,) for w in block_words], "word string")
    found = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(rf"(?<!\p{{L}})\p{{L}}{{1,{LONGEST}}}+(?!\p{{L}})"), F.lit(0))).alias("word"))
    unigrams = found.where(F.col("word").rlike("^[a-z]+$")).unionByName(lexicon)  # what a host's name can hold
    unigrams = written(unigrams.groupBy("word").agg(F.count("*").alias("count")), "unigrams")
    total = float(unigrams.agg(F.sum("count")).first()[0] or 1)

    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = written(rows.withColumn("best", rule_for(F.col("host"), F.col("path"), rules)), "urls")
    kept = rows if trained_on is None else rows.where(trained_on)
    b, a = F.count_if(F.col("best.verdict") == "block").alias("b"), F.count_if(~F.coalesce(F.col("best.verdict") == "block", F.lit(False))).alias("a")
    hosts = rows.select("host").distinct().join(kept.groupBy("host").agg(b, a), "host", "left")
    parts = hosts.select("host", "b", "a", F.posexplode_outer(F.regexp_extract_all("host", F.lit(f"[a-z]{{1,{LONGEST}}}"), F.lit(0))).alias("at", "token"))
    split = segmented(parts.where("token is not null").select("token").distinct(), unigrams, total)
    named = parts.join(split, "token", "left").groupBy("host", "b", "a").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: F.coalesce(p["words"], F.array().cast("array<string>")))).alias("words"))
    named = written(named, "hosts")

    counted = named.where("b is not null").select("b", "a", F.explode("words").alias("token")).unionByName(kept.groupBy("path").agg(b, a).select("b", "a", F.explode(_tokens_of(F.col("path"))).alias("token")))
    counts = written(counted.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "tokens")
    seeds = lexicon.select(F.col("word").alias("token")).distinct()
    sums = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    drawn = (F.col("b") + F.col("a")) * F.lit(sums.v / max(1, sums.b + sums.a))
    each = F.log((F.col("b") + drawn) / F.lit(float(sums.b + sums.v))) - F.log((F.col("a") + drawn) / F.lit(float(sums.a + sums.v)))
    seeds = lexicon.select(F.col("word").alias("token"), F.lit(log(SEED_ODDS)).alias("odds")).distinct()
    odds = written(counts.select("token", each.alias("odds")).unionByName(seeds).groupBy("token").agg(F.sum("odds").alias("odds")), "odds")
    kinds = kept.agg(b, a).first()
    prior = log(kinds.b + 1) - log(kinds.a + 1)

    by_host = named.select("host", "words", F.explode_outer("words").alias("token")).join(odds, "token", "left").groupBy("host").agg(F.first("words").alias("words"), F.sum("odds").alias("host_odds"))
    by_path = rows.select("path").distinct().select("path", F.explode(_tokens_of(F.col("path"))).alias("token")).join(odds, "token").groupBy("path").agg(F.sum("odds").alias("path_odds"))
    scored = rows.join(written(by_host, "host-odds"), "host", "left").join(written(by_path, "path-odds"), "path", "left")
    score = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    return scored.withColumn("score", score).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", F.array_join("words", " ").alias("words"))
