"""URLs against a table of include and exclude patterns, without testing every URL with every pattern.

Most regular expressions cannot match a text that lacks some literal. Such a literal is read off each pattern; the one of
its n-grams that fewest URLs have stands for the pattern, and joins it to the URLs that have this n-gram: only those
pairs are tested with the pattern itself. A pattern that shows no literal (alternatives, classes, lookarounds, flags) is
tested with every URL, as it must be: these are told to all tasks as one bounded list.

Patterns ignore the case of ASCII letters. A pattern that does not compile is an error that names its option.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions.text import ascii_lower

from .shared import written

GRAM = 4
#: Patterns of a table, and among them those without a literal, at most.
MOST_PATTERNS, MOST_PLAIN = 200_000, 2_000
_SPECIAL = set("\\^$.|?*+()[]{}")


def check(spark: SparkSession, option: str, patterns: list[str]) -> list[str]:
    """The patterns that are not empty; ValueError naming the option for one that does not compile."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for p in filter(None, patterns):
        try:
            compile_("(?i)" + p)
        except Exception as e:
            why = str(getattr(e, "java_exception", e)).splitlines()[0].rpartition("PatternSyntaxException: ")[2]
            raise ValueError(f'invalid regular expression for {option}: "{p}" ({why})') from None
    return [p for p in patterns if p]


def literals(pattern: str) -> list[str]:
    """Texts that every match contains, in small letters; none where that is not plain to see.

    Only what stands in sequence outside groups and classes is read; one alternative at the top and nothing is sure.
    """
    if "(?" in pattern or "\\Q" in pattern or "\\E" in pattern:
        return []
    out, run, k, size = [], "", 0, len(pattern)

    def cut() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    while k < size:
        c = pattern[k]
        if c == "|":
            return []
        if c in "([":
            cut()
            depth, inside = 0, False
            while k < size:
                if pattern[k] == "\\":
                    k += 1
                elif inside:
                    inside = pattern[k] != "]" or pattern[k - 1] == "[" or pattern[k - 2 : k] == "[^"
                elif pattern[k] == "[":
                    inside = True
                elif pattern[k] == "(":
                    depth += 1
                elif pattern[k] == ")":
                    depth -= 1
                if not inside and not depth:
                    break
                k += 1
            k += 1
        elif c == "\\":
            following = pattern[k + 1 : k + 2]
            if following and not following.isalnum():
                run += following
                k += 2
            else:
                # A class, an anchor or a code: past it and whatever letters and digits belong to it.
                cut()
                k += 2
                if following in "xucpPk0123456789":
                    return []
        elif c in _SPECIAL:
            cut()
            k += 1
        else:
            run += c
            k += 1
        # A quantifier after this: the last character may be absent, or stand more than once.
        if k < size and pattern[k] in "?*+{":
            if pattern[k] == "+":
                cut()
            else:
                run = run[:-1]
                cut()
            if pattern[k] == "{":
                end = pattern.find("}", k)
                if end < 0:
                    return []
                k = end
            k += 1
            while k < size and pattern[k] in "?+":
                k += 1
    cut()
    return [x.translate({n: n + 32 for n in range(65, 91)}) for x in out]


def grams(pattern: str) -> list[str]:
    """The n-grams (of GRAM characters, or a shorter literal whole) of the pattern's longest literals."""
    found = literals(pattern)
    longest = max(map(len, found), default=0)
    n = min(GRAM, longest)
    return sorted({x[i : i + n] for x in found for i in range(len(x) - n + 1)}) if n else []


def indexed(patterns: DataFrame) -> DataFrame:
    """patterns (option, pattern) with grams, checked; empty patterns are left out."""
    spark = patterns.sparkSession
    rows = patterns.filter("pattern <> ''").distinct().limit(MOST_PATTERNS + 1).collect()  # a bounded table of rules
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    for option in sorted({r["option"] for r in rows}):
        check(spark, option, [r["pattern"] for r in rows if r["option"] == option])
    return spark.createDataFrame([(r["option"], r["pattern"], grams(r["pattern"])) for r in rows], "option string, pattern string, grams array<string>")


def candidates(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """url, option, pattern of the pairs that are to be tested: the URL has the pattern's rarest n-gram.

    urls: url; patterns: as `indexed` gives them.
    """
    texts = urls.select("url").distinct()
    low = ascii_lower("url")

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))

    pieces = F.flatten(F.array(*map(of_length, range(1, GRAM + 1))))
    wanted = written(patterns.filter("size(grams) > 0").select("option", "pattern", F.explode("grams").alias("gram")), "pattern-grams")
    have = texts.select("url", F.explode(F.array_distinct(pieces)).alias("gram"))
    have = written(have.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi"), "url-grams")  # at most MOST_PATTERNS literals' grams
    rarity = have.groupBy("gram").agg(F.count("*").alias("n"))
    counted = wanted.join(rarity, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A pattern one of whose grams no URL has goes with that one, and so meets none.
    best = Window.partitionBy("option", "pattern").orderBy("n", "gram")
    chosen = counted.withColumn("_place", F.row_number().over(best)).filter("_place = 1").select("option", "pattern", "gram")
    return have.join(chosen, "gram").select("url", "option", "pattern")


def matches(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """url, option, pattern: which patterns are found in which of the distinct URLs. patterns: option, pattern."""
    known = indexed(patterns)
    tested = candidates(urls, known).filter(F.expr("url RLIKE concat('(?i)', pattern)"))
    plain = [(r["option"], r["pattern"]) for r in known.filter("size(grams) = 0").limit(MOST_PLAIN + 1).collect()]
    if len(plain) > MOST_PLAIN:
        raise ValueError(f"more than {MOST_PLAIN} patterns without a literal")
    texts = urls.select("url").distinct()
    for option, pattern in plain:
        tested = tested.unionByName(texts.filter(F.col("url").rlike("(?i)" + pattern)).select("url", F.lit(option).alias("option"), F.lit(pattern).alias("pattern")))
    return tested


def allowed(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """The URLs (with their other columns) that an include pattern matches, if there are any, and no exclude pattern does."""
    found = matches(urls.filter("url <> ''"), patterns)
    by = found.groupBy("url").agg(F.bool_or(F.col("option") == "include").alias("_in"), F.bool_or(F.col("option") == "exclude").alias("_out"))
    any_include = not patterns.filter("option = 'include' AND pattern <> ''").isEmpty()
    met = urls.filter("url <> ''").join(by, "url", "left")
    wanted = F.coalesce("_in", F.lit(False)) if any_include else F.lit(True)
    return met.filter(wanted & ~F.coalesce("_out", F.lit(False))).select(*urls.columns)
