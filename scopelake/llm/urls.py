"""URL filter: fixed host/path rules first, else logistic regression on hashed character n-grams of host and path.

Everything runs in DataFrame operations and pyspark.ml: one narrow pass over the url column, no shuffle of the pages.
The regression is trained on a small labelled table of URLs (LABELLED below, or one of the caller's).

host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: what follows up to "?", "#" or the
end. A url that is null or has no "://" has an empty host and path, no rule, and the model's verdict for empty strings.
Repeated rows and further columns are harmless; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NGRAMS, BUCKETS = (2, 3, 4), 1 << 14
#: The rules of the filter, as (verdict, host, path); a rule is written host + path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs: hosts with paths of each kind, written by hand and made up; what hosts of a web archive are like is not known here.
LABELLED = {
    "block": """
        www.mediabuy-ads.com/track ad-tracker.metrics.io/px adserver.clickgate.net/click m.promo-ads.biz/en/banner banner-ads.delivery.org/en/44
        track-ads.affiliate.info/de/1 popup-ads.gateway.net/fr/2 clicktrack.redirector.com/go adclick.syndicate.co/out.html ad-exchange.bidder.net/rtb
        www.free-bets.sports-win.org/en/1 betting-odds.live-scores.com/de/7 bets-online.bookie.net/en/sports blog.bet-bonus.club/es/3 bigbet24.com/en/odds
        casino.luckyspin.com/play www.online-casino.royal.net/en/slots m.casino-bonus.vegas.org/fr/5 win-casino.jackpot.club/de/12 mega-slots.casino/es/spins
        poker-win.tables.net/en/9 jackpot-slots.fortune.org/es/8 roulette-win.red.com/en/3 lottery-winner.prize.info/fr/6 live-dealer-casino.bet/en/join
        pills.discount-rx.com/buy www.cheap-meds.org/en/viagra pharmacy-pills.online.net/de/21 blog.diet-pills.biz/fr/2 miracle-slimming.shop/en/order
        cheap-viagra.store.org/en/4 cialis-cheap.express.com/es/9 no-prescription-pills.net/en/77 cheap-replica-watches.biz/en/5 rolex-replica.store/fr/sale
        adult.cams-live.com/en/1 m.adult-chat.net/fr/3 www.xxx-videos.org/en/2 adult-xxx.zone/de/4 nude-cams.online/en/show
        porn-tube.videos.net/en/11 sexcam.girls.org/es/5 hot-adult.clips.com/en/6 escort-girls.city.net/fr/8 free-porn.sex/de/watch
        spam.bulkmail.com/en/1 www.spam-links.org/de/2 link-farm.seo.net/en/3 backlinks-cheap.biz/fr/4 buy-backlinks.rank.info/en/packages
        www.seo-farm.org/en/5 linkfarm.pagerank.net/es/6 buy-followers.social.biz/en/7 blog.spam-post.org/en/8 cheap-traffic.clicks.top/de/buy
        free-download-crack.soft.net/en/keygen warez.full-version.com/en/1 torrent-crack.games.org/de/2 serial-keygen.apps.net/fr/3 cracked-software.top/es/patch
        www.payday-loan.com/en/1 fast-cash-loans.credit.org/en/2 crypto-giveaway.wallet.net/en/3 free-money.claim.com/es/4 double-your-bitcoin.win/en/now
        malware.update-now.net/en/run phishing-login.secure.org/en/verify fake-bank.account.com/de/login free-iphone.winner.net/en/win your-prize-claim.click/fr/gift
    """,
    "allow": """
        www.riverside-library.org/catalog/12044 en.encyclopedia.org/wiki/History docs.buildtools.dev/en/guide news.herald-tribune.com/en/2024/story blog.gardenpath.net/en/31
        www.state-university.edu/en/research science.magazine.com/en/nature weather.office.gov/fr/7 museum.modern-art.org/de/55 library.cityhall.gov/es/12044
        recipes.homecooking.com/en/soup garden.flowers.net/de/roses travel.lonely-road.org/es/spain music.orchestra.com/fr/8 kitchen.bread-and-salt.net/en/rye
        city.council.gov/en/minutes parks.national.gov/en/maps school.primary.edu/de/class theatre.playhouse.org/fr/plays county.records.us/en/deeds
        books.reviewer.com/en/review history.ancient.net/es/roma math.lectures.edu/en/algebra opensource.code.org/en/projects philosophy.institute.edu/de/kant
        python.documentation.org/en/tutorial health.clinic-advice.org/en/sleep sports.daily-news.com/en/final local-paper.press.org/de/1 hospital.regional.org/fr/visits
        photo.archive.com/fr/2 jobs.board.net/en/3 film.review-weekly.org/es/4 data.portal.gov/en/5 statistics.bureau.eu/de/population
        www.company-home.com/about ngo-relief.org/contact legal.terms.com/en/terms shop.shoemaker.com/en/shoes handmade.pottery.net/de/9
        forum.motorcycles.org/en/topic/1 blog.stonemason.com/en/2 www.mountain-club.net/en/3 m.railway-times.org/en/4 birdwatch.society.uk/en/species
        www.johnson-family.name/en/tree blog.anne-writes.com/de/12 m.northern-lights.net/fr/50 www.harbor.org/en/476 chess.federation.org/es/games
        astronomy.observatory.edu/en/873 www.vineyard.fr/fr/1600 geology.survey.gov/en/4062 linguistics.dept.edu/en/5130 opera.house.at/de/214
        www.carpenter.co.uk/en/7130 village.news.ie/en/836 translation.bureau.eu/de/7989 knitting.patterns.net/en/6593 www.lighthouse.org/es/9659
        cycling.routes.org/fr/4081 the-bakery.com/fr/3603 aquarium.bay.org/en/1299 www.poetry-review.com/en/2043 marathon.training.net/de/7492
        orchard.fruit.org/de/6886 physics.papers.org/en/3315 wiki.homelab.net/de/2143 www.old-maps.org/en/9230 m.ferry-timetable.com/de/1529
        choir.parish.org/en/6884 documentary.channel.net/en/8105 embroidery.guild.org/fr/5446 www.coastguard.gov/en/9991 blog.fisherman.net/de/7176
        tide-tables.com/en/8 antiques.market.net/en/31 surveyor.office.org/fr/7 windmill.museum.net/de/90 harvest.almanac.com/en/12
        dentist.family-care.com/en/visit letters.editor.org/en/4 stamps.collector.net/en/77 gallery.ceramics.org/en/21 tram.timetable.net/fr/9
        hiking.trails.com/en/5 quilts.heritage.org/en/64 notary.office.net/es/33 ballet.company.com/fr/41 plumber.services.net/en/18
        archive.newspaper.net/de/953 firebrigade.town.org/en/3798 mobile.bus-lines.net/en/5756 tailor.mainstreet.com/en/8157 www.brewery.de/de/8652
    """,
}


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the labelled table; label 1 means block."""
    rows = [(f"https://{u}", int(kind == "block")) for kind, urls in LABELLED.items() for u in urls.split()]
    return spark.createDataFrame(rows, "url string, label int")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the columns host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(whole, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def _gram(mark: str, col: F.Column, n: int):
    return lambda i: F.concat(F.lit(mark), F.substring(col, i, F.lit(n)))


def _grams() -> F.Column:
    """The n-grams of host and path, told apart by their first letter."""
    found = []
    for mark, col in (("h", F.concat(F.lit("^"), F.col("host"), F.lit("$"))), ("p", F.concat(F.lit("^"), F.col("path"), F.lit("$")))):
        for n in NGRAMS:
            starts = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - (n - 1))).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(starts, _gram(mark, col, n)))
    return F.concat(*found)


@dataclass
class UrlModel:
    """A fitted regression over n-grams."""

    stages: PipelineModel

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df, which has host and path, with the probability of label 1."""
        columns = df.columns
        scored = self.stages.transform(df.withColumn("__grams", _grams()))
        return scored.select(*(F.col(f"`{c}`") for c in columns), vector_to_array("__p").getItem(1).alias(out))


def fit(labelled: DataFrame, reg: float = 1e-2, iterations: int = 50) -> UrlModel:
    """Logistic regression from (url, label); rows without a label are ignored. The table is meant to be small."""
    tf = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__x")
    rows = tf.transform(with_parts(labelled.filter("label is not null")).withColumn("__grams", _grams())).select("__x", F.col("label").cast("double").alias("label")).coalesce(1)
    model = LogisticRegression(featuresCol="__x", labelCol="label", predictionCol="__y", rawPredictionCol="__r", probabilityCol="__p", regParam=reg, maxIter=iterations, standardization=False, aggregationDepth=2).fit(rows)
    return UrlModel(PipelineModel([tf, model]))


def rule_columns(rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits host and path, and its verdict; null where none does. Of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    rule, verdict = rule_columns(rules)
    scored = model.score(with_parts(pages.select("page_id", "url")))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
