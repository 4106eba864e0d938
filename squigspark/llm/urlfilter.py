"""URL filter: explicit rules, else logistic regression on hashed character n-grams of host and path.

Everything, the fitting too, is DataFrame and SQL functions.  The regression is fitted by gradient
descent inside one ``aggregate`` expression over a small labelled table, which is held as one row in
two orders: features of each url, urls of each feature.  Its weights, ``buckets`` numbers, then are
a literal of the scoring expression, so scoring is one projection without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it and
the regression's intercept decides.  Repeated rows get results of their own; ids are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (verdict, rule); a rule is a host, with all its subdomains, and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: The labelled table is made by a rule from the words below: plain English nouns, some for each first letter, and
#: words for what a corpus should not hold (gambling, pornography, pharmacy spam, link farms, trackers, loans, pirated
#: software, fraud).  Every ordinary word stands in as many unwanted hosts as in each of four of the six kinds of kept ones, and
#: both classes share subdomains, endings and paths, so the unwanted words carry the decision and no single row matters;
#: more is kept than not, so an address that says nothing is allowed.
ORDINARY = """acorn apple archive atlas bakery barn bicycle bridge cabin canal candle castle dairy dance desert drum eagle earth echo engine fabric falcon farm forest
garden glass granite guitar harbor harvest hill history island ivory iron index jacket jazz jewel journal kettle kitchen kite knot ladder lake lantern library
marble market meadow museum nation needle north notebook oak ocean orchard orchestra paper pepper planet poetry quartz quarry quilt quiet rain reading river road
school science silver station table theatre thread tower umbrella union upland urban valley velvet village violin water weather winter wool
xenon xylem yard yarn year yellow zebra zenith zinc zone""".split()
UNWANTED = """casino poker roulette slots jackpot betting bets sportsbook lottery bingo gambling porn xxx sex nude escort adult hookup webcam viagra cialis pharmacy pills steroids
spam backlinks seo linkfarm doorway clickbait ads adserver tracker popunder payday loans crypto doubler forex moneyfast warez torrent keygen crack hacked replica fakes phishing
malware virus scam giveaway""".split()
ENDINGS = "com net org info co.uk de eu".split()
SITES = "house club online works land city times group lab center shop society".split()
SUBDOMAINS = "www blog m docs forum news shop old".split()
PATHS = ["", *"/ /about /index.html /news/2019/05/article /en/page /de/seite /fr/page /es/pagina /docs/guide.html /p/1234 /blog/post-title /contact /shop/item?id=7 /archive/1998/ /images/photo.jpg /search?q=word /wiki/Topic /en/index.html".split()]
LURES = "/register /claim /order /win /free /bonus /buy-now /login-verify".split()


def made_hosts(unwanted: bool) -> Iterator[str]:
    """Four hosts for each ordinary word, with unwanted words or other ordinary ones; six that are kept."""
    for i, word in enumerate(ORDINARY):
        if unwanted:
            other = [UNWANTED[(i + 17 * k) % len(UNWANTED)] for k in range(4)]
        else:
            other = [ORDINARY[(37 * i + 11 * k + 5) % len(ORDINARY)] for k in range(6)]
        sub = [SUBDOMAINS[(i + k) % len(SUBDOMAINS)] for k in (0, 3, 5)]
        yield from (f"{other[0]}-{word}", f"{sub[0]}.{word}-{other[1]}", f"{sub[1]}.{other[2]}{SITES[i % len(SITES)]}", f"www.{word}{other[3]}")
        if not unwanted:
            yield from (word, f"{sub[2]}.{other[4]}-{other[5]}")


def made_urls(unwanted: bool) -> Iterator[str]:
    """Hosts with endings and paths in turn; every fourth unwanted one has a path that lures."""
    for k, host in enumerate(made_hosts(unwanted)):
        path = LURES[k // 4 % len(LURES)] if unwanted and k % 4 == 0 else PATHS[7 * k % len(PATHS)]
        yield f"http{'s' * (k % 2)}://{host}.{ENDINGS[3 * k % len(ENDINGS)]}{path}"


@dataclass(frozen=True)
class UrlModelConfig:
    buckets: int = 8192
    orders: tuple[int, ...] = (3, 4)
    steps: int = 40
    rate: float = 5.0
    l2: float = 0.002


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end; A-Z lower-cased) and path (then up to ? or #)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def features(host: Column, path: Column, cfg: UrlModelConfig) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked with where it stands."""
    def grams(part: str, s: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(s) - (n - 1))
        hashed = F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(s, i, F.lit(n))), F.lit(cfg.buckets)).cast("int"))
        return F.when(F.length(s) >= n, hashed).otherwise(F.array().cast("array<int>"))

    found = [grams(part, s, n) for part, s in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)) for n in cfg.orders]
    return F.array_distinct(F.concat(*found))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, y): y is 1 for urls that should be blocked."""
    rows = [(u, y) for y in (0, 1) for u in made_urls(y == 1)]
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, y)")


def fit_weights(labelled: DataFrame, cfg: UrlModelConfig = UrlModelConfig()) -> list[float]:
    """Weights of all buckets, then the intercept.  ``labelled`` (url, y) is a small table (thousands of rows).

    Buckets that occur are numbered, and only their weights are moved: those of the others stay 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(features(host, path, cfg).alias("f"), F.col("y").cast("double").alias("y"))
    # Rows in a fixed order; each feature keeps the numbers of its rows.  These tables are as small as the labelled one.
    held = rows.agg(F.array_sort(F.collect_list(F.struct("f", "y"))).alias("rows"))
    flat = held.select(F.posexplode("rows").alias("i", "r")).select("i", F.explode("r.f").alias("b"))
    by_bucket = flat.groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("at")).withColumn("j", F.row_number().over(Window.orderBy("b")) - 1)
    of_rows = flat.join(by_bucket.select("b", "j"), "b").groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("f"))
    numbers = by_bucket.agg(F.array_sort(F.collect_list(F.struct("j", "b", "at"))).alias("p")).select(F.col("p.b").alias("known"), F.col("p.at").alias("post"))
    dense = of_rows.agg(F.array_sort(F.collect_list(F.struct("i", "f"))).alias("dense"))
    one = F.lit(1).alias("one")
    data = held.select("rows", one).join(numbers.select("known", "post", one), "one").join(dense.select("dense", one), "one").select("known", "post", F.col("dense.f").alias("rows"), F.col("rows.y").alias("y"), F.size("dense").alias("n"))  # one row each

    def errors(w: Column) -> Column:
        return F.zip_with("rows", "y", lambda f, y: 1 / (1 + F.exp(-F.aggregate(f, F.element_at(w, -1), lambda a, b: a + F.get(w, b)))) - y)

    def moved(w: Column, e: Column) -> Column:
        grad = lambda at: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(e, i))
        own = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.col("post"), lambda v, at: v - cfg.rate * (grad(at) / F.col("n") + cfg.l2 * v))
        return F.concat(own, F.array(F.element_at(w, -1) - cfg.rate * F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.col("n")))

    start = F.array_repeat(F.lit(0.0), F.size("known") + 1)
    step = lambda w, _: F.get(F.transform(F.array(errors(w)), lambda e: moved(w, e)), F.lit(0))
    found = data.select("known", F.aggregate(F.sequence(F.lit(1), F.lit(cfg.steps)), start, step).alias("w")).first()
    weights = [0.0] * cfg.buckets + [found["w"][-1]]
    for b, w in zip(found["known"], found["w"], strict=False):
        weights[b] = w
    return weights


def judge(pages: DataFrame, weights: list[float], cfg: UrlModelConfig = UrlModelConfig(), rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, score, verdict): one row for each of ``pages``."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    w = F.lit([float(x) for x in weights])
    margin = F.aggregate(features(F.col("host"), F.col("path"), cfg), F.element_at(w, -1), lambda a, b: a + F.get(w, b))
    scored = rows.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("fit"), (1 / (1 + F.exp(-margin))).alias("score"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce("fit.verdict", own).alias("verdict"))
