"""URL filters: host rules first, then naive Bayes over segmented host names and path tokens.

Host words: parts of host names without hyphens are split by a unigram Viterbi
whose words are LEXICON and the words that urls spell out themselves, in paths
and hyphenated host parts. Candidate words of each distinct part are joined with
the word counts, so no vocabulary is broadcast. Pages teach the multinomial naive
Bayes model by their hosts: those with a word of SEEDS count as blocked.

Counts are added up per distinct host and path before any join, and the scores
of distinct hosts and paths are joined to the pages, so a host with a third of
all pages is counted once; Spark may split its rows in the last joins.

Defined results: null urls and urls without ``://`` have empty host and path and
are judged by the prior alone; parts longer than a DNS label (63 letters) are split
piece by piece of that length; words have LONGEST letters at most;
repeated pages give repeated rows; ids may be null.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, freeze, map_rows

#: Words of host names with the weight they start from.
LEXICON = {w: 50 for w in "ads adult bets best blog buy casino cheap deal deals farm free game games hot loan loans mail money news online page pharma pills play poker porn prize sale sex shop site slots spam store tech track video web win wiki world".split()}
#: Words whose hosts teach the block class.
SEEDS = ("ads", "adult", "bets", "casino", "pharma", "pills", "poker", "porn", "slots", "spam", "track")
LABEL, LONGEST, UNKNOWN = 63, 24, 10.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; empty for null and where ``://`` is missing."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null; rules are (``host/path``, verdict) and bounded by their being a parameter."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        name, _, at = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + at)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _words(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))


def path_tokens(path: Column) -> Column:
    """Letter runs in lower case; digit runs as #."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.when(t.rlike("^[0-9]"), F.lit("#")).otherwise(t))


def vocabulary(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, n) from paths, hyphenated host parts and LEXICON."""
    spark = hosts.sparkSession
    parts = hosts.select(F.explode(F.split("host", r"\.")).alias("part"), "n").where(F.contains("part", F.lit("-")))
    spelt = parts.select(F.explode(_words(F.col("part"))).alias("word"), "n").unionAll(paths.select(F.explode(_words(F.col("path"))).alias("word"), "n"))
    given = spark.createDataFrame(list(LEXICON.items()), "word string, n bigint")
    return spelt.unionAll(given).where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(part: str, known: dict[tuple[int, int], int], total: float) -> list[str]:
    """Most likely split of part; ``known`` has the counts of its substrings (start, length). Unknown pieces cost more the longer they are."""
    best = [(0.0, 0)]
    for end in range(1, len(part) + 1):
        options = []
        for start in range(end):
            n = known.get((start, end - start))
            cost = math.log10(n / total) if n else math.log10(UNKNOWN / total) - 0.8 * (end - start)
            options.append((best[start][0] + cost, start))
        best.append(max(options))
    words, end = [], len(part)
    while end:
        start = best[end][1]
        words.append(part[start:end])
        end = start
    return words[::-1]


def segment(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(part, words): distinct host parts of letters, split into words."""
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    starts = F.sequence(F.lit(0), F.length("part") - 1)
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.length("part") - s, F.lit(LONGEST))), lambda k: F.struct(s.alias("s"), k.alias("k")))))
    candidates = parts.select("part", F.explode(spans).alias("at")).select("part", "at", F.substr("part", F.col("at.s") + 1, F.col("at.k")).alias("word"))
    hits = candidates.join(words, "word").groupBy("part").agg(F.collect_list(F.struct("at.s", "at.k", "n")).alias("known"))

    def make():
        return lambda r: (r[0], viterbi(r[0], {(x["s"], x["k"]): x["n"] for x in r[1] or ()}, total))

    return map_rows(parts.join(hits, "part", "left").select("part", "known"), make, "part string, words array<string>")


def judge(pages: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """pages + (block_score): log odds that a page belongs to the blocked hosts."""
    seen = freeze(pages.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n")), "urls")
    hosts = seen.groupBy("host").agg(F.sum("n").alias("n"))
    paths = seen.groupBy("path").agg(F.sum("n").alias("n"))
    parts = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit(f"[a-z]{{1,{LABEL}}}|[^a-z.-]{{1,{LABEL}}}"), F.lit(0))).alias("part"))
    split = segment(parts.select("part").distinct(), vocabulary(hosts, paths))
    tokens = freeze(parts.join(split, "part").select("host", F.explode("words").alias("token")), "host_words")
    blocked = tokens.groupBy("host").agg(F.max(F.col("token").isin(*SEEDS)).alias("block"))
    hosts = hosts.join(blocked, "host", "left").withColumn("block", F.coalesce("block", F.lit(False)))
    of_class = lambda c: F.sum(F.when(F.col("block") == c, F.col("n")).otherwise(0))
    pairs = seen.select("host", "n", F.explode(path_tokens(F.col("path"))).alias("token")).groupBy("host", "token").agg(F.sum("n").alias("n"))
    of_host = tokens.join(hosts, "host").select("token", "n", "block")
    counts = of_host.unionAll(pairs.join(hosts.select("host", "block"), "host").select("token", "n", "block")).groupBy("token").agg(of_class(True).alias("b"), of_class(False).alias("a"))
    counts = freeze(counts, "url_tokens")
    sums = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    prior = hosts.agg(of_class(True), of_class(False)).first()
    (b, a, v), (pb, pa) = (x or 0 for x in sums), (x or 0 for x in prior)
    odds = counts.select("token", (F.log((F.col("b") + 1) / (b + v + 1)) - F.log((F.col("a") + 1) / (a + v + 1))).alias("odds"))
    host_odds = tokens.join(odds, "token").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    path_odds = paths.select("path", F.explode(path_tokens(F.col("path"))).alias("token")).join(odds, "token").groupBy("path").agg(F.sum("odds").alias("path_odds"))
    scored = pages.join(host_odds.withColumnRenamed("host", host), host, "left").join(path_odds.withColumnRenamed("path", path), path, "left")
    score = F.lit(math.log((pb + 1) / (pa + 1))) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    return scored.withColumn("block_score", score).drop("host_odds", "path_odds")
