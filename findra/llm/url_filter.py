"""URL filters: explicit host and path rules, else logistic regression on hashed character n-grams.

The model is trained by gradient descent whose features and gradients are DataFrame aggregations over a
small labelled URL table; the driver holds ``DIM`` weights. Scoring is one projection over the URLs: no
shuffle, no Python.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to
``?``, ``#`` or the end. A rule ``host/path`` fits its host and all subdomains if the URL's path starts
with ``/path``; of the fitting rules the longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits and the
model scores by its bias alone; repeated rows are each judged; an empty table gives no rows; a very long
URL is one row, in memory proportional to its length; other columns are kept, but one of an output's
name is replaced. Rules of equal length that fit one URL are the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIM = 4096
GRAMS = (3, 4, 5)
STEPS = 30
RATE = 6.0
MOMENTUM = 0.9
DECAY = 2e-3
THRESHOLD = 0.5

#: Rules and their verdicts.
RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}

#: The labelled URL table: hosts and paths as filter lists and ordinary sites have them.
LABELLED_URLS = {
    "block": """
        http://www.spam-offers.test/win?id=3
        https://spam-links.test/fr/404
        https://link-farm.test/seo/cheap
        http://seo-spam.test/backlinks/buy
        https://content-farm.test/en/8
        https://comment-spam.test/post/1
        http://m.online-casino.test/slots/free
        https://royal-casino.test/de/9
        https://casino-bonus.test/free-spins
        http://www.vegas-casino.test/jackpot
        https://www.win-big.test/jackpot
        https://win-prizes.test/claim
        https://you-win.test/es/lottery
        https://lotto-winner.test/fr/12
        https://big-wins.test/en/4
        http://sports-bets.test/es/44
        https://best-betting.test/odds
        https://bets-online.test/en/7
        https://football-bet.test/tips
        https://poker-free.test/play
        https://free-slots.test/spin
        https://free-spins.test/en/21
        https://free-money.test/fast
        https://free-iphone.test/de/2
        http://www.adult-cams.test/live
        https://adult-dating.test/en/9
        https://adult-chat.test/es/5
        https://hot-adult.test/fr/31
        https://xxx-videos.test/fr/3
        https://free-xxx.test/en/3
        https://porn-tube.test/watch
        https://sex-cams.test/live
        http://pills-online.test/buy/cheap
        https://diet-pills.test/order
        https://best-pills.test/en/6
        https://cheap-viagra.test/order
        https://blog.cheap-meds.test/de/71
        https://cheap-rolex.test/sale
        https://cheap-essays.test/en/8
        https://pharmacy-cheap.test/es/1
        http://ads-server.test/click?u=9
        https://pop-ads.test/en/90
        https://ads-click.test/fr/8
        https://banner-ads.test/fr/90
        https://www.ad-tracker.test/pixel
        https://track-clicks.test/es/2
        https://user-track.test/pixel.gif
        https://click-track.test/en/55
        https://malware-drop.test/download.exe
        http://phishing-login.test/verify
        https://warez-crack.test/keygen
        https://payday-loans.test/apply
        https://fast-loans.test/en/17
        https://replica-watches.test/sale
        https://fake-bags.test/buy
    """,
    "allow": """
        https://news.test/world/2024/05/story.html
        https://www.university.test/research/papers
        https://docs.library.test/en/stable/index.html
        http://encyclopedia.test/wiki/History
        https://city-museum.test/exhibitions
        https://weather.test/forecast/today
        https://recipes.test/soup/tomato
        https://open-data.test/datasets/rivers
        https://gov.test/services/passport
        https://school.test/en/timetable
        https://blog.gardening.test/en/roses
        https://code-forge.test/project/readme
        https://health.test/advice/sleep
        https://travel.test/guides/lisbon
        https://radio.test/programmes
        https://another.test/en/12
        http://www.thinking.test/en/404
        https://m.thursday.test/en/21
        https://blog.nation.test/en/9.html
        https://station.test/en/853/
        https://thanks.test/en/777
        https://northern.test/en/276
        https://m.mention.test/en/61?page=2
        https://shop.nouveau.test/fr/6
        http://chemin.test/fr/44
        https://www.bateaux.test/fr/3?page=2
        https://blog.quelquun.test/fr/90
        https://toujours.test/fr/17.html
        https://maison.test/fr/1203#top
        https://verein.test/de/1
        http://m.schule.test/de/71
        https://wirklich.test/de/8#top
        https://www.bericht.test/de/5
        https://anderswo.test/de/612
        https://garten.test/de/33/
        https://ciudad.test/es/2
        http://blog.mentes.test/es/33
        https://www.querido.test/es/15
        https://historia.test/es/404
        https://camino.test/es/9.html
        https://weltreise.test/de/480?utm_source=feed
        https://bookshop.test/en/78
        https://theatre.test/en/431
        https://orchestra.test/en/66
        https://www.mountains.test/en/9027#top
        http://harbour.test/en/184?page=2&ref=x
        https://blog.physics.test/en/3896
        https://m.village.test/fr/7
        https://shop.ceramics.test/de/19
        https://bread-and-salt.test/en/5
        https://well-being.test/en/81
        https://kinder-garten.test/de/3
        https://bois-vert.test/fr/72
        https://mar-azul.test/es/6
        https://old-town.test/en/2112/
    """,
}

_UPPER = "".join(map(chr, range(0x41, 0x5B)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a URL column, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest fitting rule or null; for rule lists that fit a plan (hundreds)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, rule).otherwise(out)
    return out


def grams_of(host: Column, path: Column) -> Column:
    """Hashed character n-grams of the marked host and path, as indices from 0."""

    def of(text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(DIM)).cast("int"))

    marked = [F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$"))), F.when(path == "", "").otherwise(F.concat(path, F.lit("|")))]
    return F.concat(*[of(t, n) for t in marked for n in GRAMS])


def _margin(grams: Column, weights: list[float], bias: float) -> Column:
    """Bias plus the grams' weights over the root of their number."""
    table_ = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table_, g))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def probability(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled URL table as ``url, label``."""
    rows = [(u, int(kind == "block")) for kind, text in LABELLED_URLS.items() for u in text.split()]
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def train(examples: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by full-batch gradient descent with momentum over ``url, label`` (a small table)."""
    host, path = host_and_path(F.col("url"))
    rows = examples.select(F.col("label").cast("double").alias("y"), grams_of(host, path).alias("grams")).coalesce(1).cache()
    n = rows.count()
    weights, bias, speed = [0.0] * DIM, 0.0, [0.0] * (DIM + 1)
    for _ in range(steps if n else 0):
        error = probability(_margin(F.col("grams"), weights, bias)) - F.col("y")
        each = rows.select(error.alias("e"), F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double")).alias("norm"), F.explode(F.concat(F.array(F.lit(-1)), "grams")).alias("g"))
        for g, d in each.groupBy("g").agg(F.sum(F.when(F.col("g") < 0, F.col("e")).otherwise(F.col("e") / F.col("norm")))).collect():  # DIM + 1 rows at most
            speed[g] = MOMENTUM * speed[g] - RATE * (d / n + (DECAY * weights[g] if g >= 0 else 0.0))
            if g < 0:  # the bias has the last place
                bias += speed[g]
            else:
                weights[g] += speed[g]
    rows.unpersist()
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules: dict[str, str] = RULES, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``url_host, url_path, url_rule, url_score, url_verdict``."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"url_host": host, "url_path": path})
    out = out.withColumns({"url_rule": rule_of(F.col("url_host"), F.col("url_path"), [*rules]), "url_score": probability(_margin(grams_of(F.col("url_host"), F.col("url_path")), *model))})
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("url_rule") == rule, verdict).otherwise(by_rule)
    return out.withColumn("url_verdict", F.coalesce(by_rule, F.when(F.col("url_score") >= threshold, "block").otherwise("allow")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), train(labelled(spark)))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.round("url_score", 6).alias("score"))
