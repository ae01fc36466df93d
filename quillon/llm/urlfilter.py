"""URL verdicts: rules on hosts and paths, and logistic regression on hashed character n-grams for what no rule names."""

from __future__ import annotations

from zlib import crc32

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import save_stage, small

#: Lengths of the character n-grams, slots that they are hashed to, and the strength of the penalty on weights.
GRAMS, SLOTS, PENALTY = (3, 4, 5), 1 << 18, 0.0005
#: Steps of the fit at most.
STEPS = 25

#: Words that hosts and paths of unwanted pages are made of, and words of ordinary ones: the seed of the labelled table.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "roulette", "betting", "bets", "bet", "lottery", "gamble", "winner", "win", "bonus", "free", "cheap", "discount", "deal", "pills", "viagra", "pharma",
    "meds", "diet", "loans", "payday", "credit", "forex", "crypto", "replica", "watches", "adult", "porn", "xxx", "sex", "escort", "dating", "cams", "nude", "hot-girls", "spam", "farm",
    "seo", "backlinks", "clicks", "click", "ads", "adserver", "advert", "banner", "track", "tracker", "pixel", "popup", "redirect", "affiliate", "promo", "warez", "crack", "keygen", "torrent", "malware",
    "phish", "hack", "prize", "giveaway",
)
ORDINARY = (
    "news", "times", "journal", "garden", "school", "university", "library", "museum", "history", "science", "physics", "biology", "theatre", "music", "travel", "weather", "cooking", "recipes", "health", "hospital",
    "city", "council", "river", "mountain", "forest", "nature", "sports", "football", "chess", "photo", "design", "software", "linux", "python", "forum", "wiki", "review", "books", "poetry", "art",
    "market", "bank", "insurance", "law", "courts", "police", "railway", "transport", "airport", "church", "charity", "family", "children", "teacher", "engineer", "energy", "climate", "ocean", "animals", "kitchen",
    "winter", "trackside", "farmers", "between", "betterment", "freedom", "adulthood", "dealers", "essex", "therapy", "there", "other", "nation", "station", "thing", "mother",
)
_FRONT = ("", "www.", "m.", "blog.")
_END = ("com", "net", "org", "info")
_LANGUAGES = ("en", "de", "fr", "es")
_TAIL = ("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top")
#: Addresses that the table has for each unwanted and each ordinary word, and addresses of made-up names.
_EACH, _MADE_UP = (8, 4), 600
#: Beginnings, middles and ends of syllables of made-up names.
_SYLLABLE = ("b c d f g h j k l m n p qu r s t v w z br ch cl dr fl gr pl pr sh st str th tr wh".split(), "a e i o u ai ea ee io ou".split(), "b d l n nd ng nt r rs s sh st t th ck ly le".split())


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table (``url``, ``label``: 1 is unwanted), built by rule from the two word lists.

    Each word gets a few hosts, alone or joined to another word of its list, whose prefix, domain, language and ending are
    dealt alike to both classes, so that only the words tell them apart. Made-up names are ordinary, so a name that speaks of
    nothing is not held against a page.
    """

    def address(name: str, i: int, k: int) -> str:
        host = f"{_FRONT[(i + k) % 4]}{name}.{('example.', '')[(i // 2 + k) % 2]}{_END[(i // 4 + k) % 4]}"
        return f"http{'s' * ((i + k) % 2)}://{host}/{_LANGUAGES[(i // 3 + k) % 4]}/{(i * 97 + k * 389) % 9973}{_TAIL[(i + 2 * k) % 6]}"

    rows = []
    for label, words, each in ((1.0, UNWANTED, _EACH[0]), (0.0, ORDINARY, _EACH[1])):
        for i, word in enumerate(words):
            for k in range(each):
                other = words[(i * 7 + k * 13 + 5) % len(words)]
                name = word if k % 2 == 0 else f"{word}-{other}" if k % 4 == 1 else f"{other}{word}"
                rows.append((address(name, i, k), label))
    for i in range(_MADE_UP):
        seed = crc32(str(i).encode())
        parts = [part[(seed >> shift) % len(part)] for shift in (0, 9) for part in _SYLLABLE]
        rows.append((address("".join(parts), i, seed % 7), 0.0))
    return spark.createDataFrame(rows, "url string, label double")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(rows: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """Add host (after the first ``://``, only A-Z lower-cased) and path; both are empty for null and without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    first = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return rows.withColumns({host: lower_ascii(first), path: F.regexp_extract(F.substring(rest, F.length(first) + 1, F.length(rest)), r"^[^?#]*", 0)})


def _grams(rows: DataFrame) -> DataFrame:
    """Add ``__grams``: the character n-grams of ``__host`` and ``__path``; blanks mark where each begins and ends."""
    rows = rows.withColumn("__address", F.concat(F.lit(" "), F.col("__host"), F.lit(" "), F.col("__path"), F.lit(" ")))
    rows = RegexTokenizer(inputCol="__address", outputCol="__chars", pattern=r"[\s\S]", gaps=False).transform(rows)
    for n in GRAMS:
        rows = NGram(n=n, inputCol="__chars", outputCol=f"__g{n}").transform(rows)
    return rows.withColumn("__grams", F.concat(*[f"__g{n}" for n in GRAMS]))


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> PipelineModel:
    """Logistic regression of ``label`` (1 is unwanted) on hashed n-grams of host and path.

    Rows with other labels than 0 and 1 are left out. The table is small and stated by the caller; without a row of each
    class the fit raises ValueError.
    """
    known = labelled.select(F.col(url_col).alias("__url"), F.col(label_col).cast("double").alias("__label")).filter("__label in (0, 1)")
    known = save_stage(_grams(split_url(known, "__url", "__host", "__path")).select("__grams", "__label"), "labelled-urls")
    if known.select("__label").distinct().count() < 2:
        raise ValueError("labelled urls of both classes are needed")
    stages = [
        HashingTF(inputCol="__grams", outputCol="__features", numFeatures=SLOTS, binary=True),
        LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__predicted", probabilityCol="__probability", rawPredictionCol="__raw", regParam=PENALTY, maxIter=STEPS, standardization=False),
    ]
    return Pipeline(stages=stages).fit(known.coalesce(1))


def _packed(rules: DataFrame) -> DataFrame:
    """One row a rule host, its rules by path, longest first; of rules for one host and path a block comes first."""
    clean = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("__rule_host"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    clean = clean.groupBy("__rule_host", "p").agg(F.max("verdict").alias("v")).filter("v is not null and __rule_host <> ''")
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("p")).alias("n"), "p", "v")))
    return clean.groupBy("__rule_host").agg(ordered.alias("__rules"))


def match_rules(rows: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` (host and path of the longest rule that fits) and ``rule_verdict``; both are null if none fits.

    A rule (``host``, ``path``, ``verdict``) fits its host and the hosts below it, on paths that begin with the rule's. A
    host is looked up once for each number of labels that rule hosts have, so hosts with thousands of labels cost no more;
    no row is multiplied. The rules are broadcast if they are small, else the join shuffles, and a host with a third of all
    rows is split as a skewed join. Equally long rules: the one of the longer host wins. Rules without a host fit nothing.
    """
    packed = save_stage(_packed(rules).withColumn("__labels", F.size(F.split("__rule_host", r"\."))), "rules")
    counts = {r["__labels"]: r["n"] for r in packed.groupBy("__labels").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a number of labels
    best = F.lit(None).cast("struct<n:int,host:int,rule:string,verdict:string>")
    for k in sorted(counts):
        some = packed.filter(F.col("__labels") == k).select(F.col("__rule_host").alias(f"__h{k}"), F.col("__rules").alias(f"__r{k}"))
        rows = rows.join(small(some, counts[k]), F.substring_index(host, ".", -k) == F.col(f"__h{k}"), "left")
        fits = F.get(F.filter(f"__r{k}", lambda r: F.col(path).startswith(r["p"])), F.lit(0))
        found = F.struct((F.length(f"__h{k}") - fits["n"]).alias("n"), F.length(f"__h{k}").alias("host"), F.concat(f"__h{k}", fits["p"]).alias("rule"), fits["v"].alias("verdict"))
        best = F.greatest(best, F.when(fits.isNotNull(), found))  # greatest skips nulls
    rows = rows.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "rule_verdict": F.col("__best.verdict")})
    return rows.drop("__best", *[f"__{c}{k}" for k in counts for c in "hr"])


def url_verdicts(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score``, the
    probability that the model gives to an unwanted page.

    The longest rule that fits decides; where none fits the model blocks from ``threshold`` on. A null url, an empty one and
    one without ``://`` have an empty host and path, which no rule fits and which the model judges by its intercept alone
    (the default table: allow). Rows are judged by themselves: repeated rows repeat, null ids stay, other columns are left
    out, an empty table gives an empty result, and without rules the model judges all.
    """
    model = fit_urls(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    rows = split_url(rows, "__url", "__host", "__path").drop("__url")
    rows = match_rules(rows, rules, "__host", "__path")
    rows = model.transform(_grams(rows))
    score = F.get(vector_to_array("__probability"), F.lit(1))
    verdict = F.coalesce("rule_verdict", F.when(score >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", verdict.alias("verdict"), score.alias("score"))


#: Fixed values of the query: host, path and verdict of its rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``: the stated rules, and the model where none fits."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
