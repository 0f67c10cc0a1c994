"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

Features: lengths, depth, digit ratio, character entropy, parameters, hyphens,
and two statistics learned with the trees: how much likelier a bad URL is than
a good one given its host's last label (the suffix), and given the words of its
host and path.  A training row's statistics are taken without its fold, so
the trees see on training rows what they will see on others.

Labelled URLs are a table (url, bad) that the caller gives, at most ``sample``
different ones of it (those with the smallest hash), or else the short list
below, written by hand.  What the rules decide is not learned from: a rule for
a host or path states a policy, not what bad URLs look like, and its URLs are
decided already.

Bound: training takes at most ``sample`` rows to the driver; statistics have at
most ``terms`` words.  Scoring is one SQL expression; the main path has no
Python, and only the url column is read.

Cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is judged by the trees (all its features are zero); repeated rows are
judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gbt import Trees, train

SAMPLE, TERMS, FOLDS, LIMIT = 20_000, 400, 5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._~%/?&=#:"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str  # starts with /

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows the path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES, field: str = "text") -> Column:
    """The longest rule that fits, as its text or verdict; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


# Labelled URLs, written by hand: ordinary pages, and pages of the kinds that link farms, mail floods and forged logins lead to.
GOOD = """
https://en.wikipedia.org/wiki/Compiler
https://www.gutenberg.org/ebooks/search/?query=verne
https://docs.python.org/3/library/json.html
https://www.post-gazette.com/news/2023/04/11/school-board-vote
https://city-library.org/events/calendar?month=5
https://www.lemonde.fr/planete/article/2022/10/03/climat.html
https://fr.wikibooks.org/wiki/Cuisine
https://www.spiegel.de/wissenschaft/weltall/
https://elpais.com/cultura/2021-06-30/libros.html
https://www.bbc.co.uk/weather/2643743
https://museum-of-natural-history.org.uk/visit/tickets
https://blog.gardening-club.net/spring/tulips
https://www.uni-heidelberg.de/de/studium/fristen
https://arxiv.org/abs/1706.03762
https://www.nature.com/articles/s41586-020-2649-2
https://stats.example.edu/courses/101/syllabus.pdf
https://www.rivertown.gov/council/minutes/2019/march
https://news.ycombinator.com/item?id=1
https://m.dailyherald.com/sports/20240112/wrestling
https://www.kochrezepte.at/apfelkuchen/
https://open-data.europa.eu/en/data/dataset?page=3
https://forum.bikes.org/thread/8812?page=2
https://github.com/apache/arrow/issues/7
https://kernel.org/doc/html/latest/
https://www.cs.cornell.edu/people/tj/
https://recipes.home-cooking.com/soup/leek-and-potato
https://www.oxforddnb.com/view/10.1093/ref
https://maps.harbour.nl/route?from=delft&to=leiden
https://www.railways.ch/de/fahrplan
https://teatro-real.es/temporada/opera
https://www.musee-orsay.fr/fr/oeuvres
https://journal.plos.org/plosone/article?id=10.1371
https://weather.gov/forecast/zone/42
https://shop.woodworks.com/chairs/oak
https://www.quaker-history.org/letters/1688
https://archive.org/details/gazette1901
https://www.bibliotheque.ca/catalogue?auteur=hugo
https://community.knitting.org/patterns/shawl#notes
http://www.mountain-rescue.it/notizie/2020/12
https://sub.reading.org/list/42/
https://lyrics.folk-songs.ie/ballads/molly
https://astro.physics.edu/papers/1998/redshift.ps
https://www.zoo-berlin.de/tiere/pandas
https://hackernotes.io/2021/rust-borrow-checker
https://www.primary-school.sch.uk/parents/menu
http://villagechoir.org/concerts.html
https://www.tagesschau.de/inland/bahn-101.html
https://es.wikinews.org/wiki/Portada
https://wetter.at/wien
https://kids.science-museum.com/experiments/volcano
https://pets.stackexchange.com/questions/311/cat-sleep
https://www.hilltop-farm.com/about
https://thenation.in/opinion/editorial/8872
https://podcasts.radio.se/avsnitt/77?utm_source=feed
https://dev.to/ada/sorting
https://www.windows-and-doors.co.nz/contact
https://rockhounds.org/minerals/quartz?ref=index
https://bookshop.eu/titles/9780140449136
https://www.kinderbuch.ch/autoren/k
https://www.trailrunning.com/routes/alps/day-3
https://www.st-marys-hospital.org/clinics/eye
https://poetry.org/poem/174181
https://www.seafood-guide.com/fish/hake
https://chess.org/games/1972/6
https://www.jardin-botanico.es/plantas/cactus
https://www.law.edu/statutes/title-9/section-12
http://history.navy.mil/ships/1812
https://crosswords.com/daily/2018/07/04
https://www.bakery.fr/pain/levain
https://www.world-atlas.net/rivers/danube
https://www.dairy-farm.org/visits
https://wind-farm.dk/turbines/7
https://blog.sheep-farm.co.nz/en/wool/31
https://m.old-mill.org/fr/visites/12
https://www.stone-age.info/de/funde/880.html
"""
BAD = """
http://cheap-meds-online.biz/buy?aff=9921&sid=12
http://casino-royale-bonus.com/free-spins?ref=77812&click=4
http://win-iphone-now.info/claim/?uid=8827712&t=1
http://192.168.12.7/login/verify.php?acc=1&id=2&tok=a9f3
http://free-pills-4u.ru/viagra-cialis
http://secure-paypa1-login.com/webscr/update?cmd=login&session=88f7a6
http://adult-chat-rooms.xxx/live
http://www.adult-cams.com/en/girls
http://best-casino.win/jackpot
http://spam-links.top/go.php?u=1&k=2&z=3&q=4
http://ads.click-tracker.info/r?a=1&b=2&c=3&d=4&e=5
http://track-ads.com/pixel
http://ads-server.biz/banner/728x90
http://free-money.club/earn-cash-fast
http://loans-quick.online/apply-now?src=mail
http://xn--80ak6aa92e.com/
http://buy-followers.shop/instagram/1000
http://bets-online.bet/sports
http://free-bet.com/bonus-code
http://sports-bets.net/odds
http://hot-singles-near.you/chat?age=18&zip=90210
http://cheap-replica-watches.cn/rolex/a1b2c3d4
http://farm-links.biz/seo/page8827
http://link-farm.org/out/77
http://spam-site.com/a
http://casino-slots.net/play
http://online-casino.co/de/bonus
http://pills-shop.com/order
http://discount-pills.org/tramadol
http://weight-loss-miracle.info/?aff_id=8812&sub=22
http://a8f7d6c5b4e3.xyz/d41d8cd98f00b204e9800998ecf8427e
http://x7k2q9.top/9f8e7d6c5b4a
http://qwz81kd02mfa.info/
http://1-800-cash-now.com/?id=1882&id2=99&id3=a
http://bit-coin-doubler.io/invest?ref=0x88fa12
http://xxx-videos-free.tv/watch?v=99187722
http://adult-dating.biz/join
http://videos.adult-free.com/new
http://ads-exchange.top/bid
http://mail.verify-account-update.com/%61%63%63/%6c%6f%67
http://www.free-download-crack.ru/photoshop-keygen.exe
http://torrent-hack.cc/serial?n=1&m=2
http://lottery-winner.win/claim
http://you-win-prize.online/gift
http://win-cash.com/now
http://big-win.org/wheel
http://cheap-flights-deal-4u.biz/x?p=1&q=2&r=3
http://cheap-viagra.com/
http://cheap-watch.net/sale
http://replica-bags.cheap/outlet
http://paydayloan77.biz/ok
http://casino888.vip/
http://bet365bonus999.cc/reg?agent=7712
http://sexcam69.live/room/18
http://viagra4less99.info/?gclid=88&cid=7
http://earn5000daily.club/join?u=33&s=9
http://login.bank-secure-update.tk/acct/0019283746/confirm
http://apple.id.verify.user.session.account-check.ml/x
http://microsoft.support.alert.call-now.ga/1-888
http://203.0.113.9:8080/cgi-bin/a.cgi?x=%41%42%43
http://198.51.100.22/wp-content/plugins/x/paypal/
http://tracking.adserver77.com/c?i=1&z=2&n=3&b=4
http://popads99.net/pop?cid=77&r=1
http://ad-click.biz/ck.php?n=a&cb=88271
http://seo-spam-backlinks.com/buy/1000
http://comment-spam.info/post.php?p=1
http://www.farm-seo.biz/links
http://freebets77.bet/now
http://freegiftcards4all.club/?s=1&t=2&u=3
http://hotdeals-cheap-cheap.biz/%20%20/deal
http://cheap-tabs.com/buy/88
http://spam-blog.net/posts/12
http://www.email-spam.org/offer/3
http://m.cheap-tabs.org/en/77
http://bulk-spam.de/list/4
"""

FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "host_digits", "entropy", "params", "n_query", "hyphens", "fragment", "escapes", "suffix", "words", "worst")


def _terms(host: Column, path: Column) -> Column:
    """Different words of a host before its last label, and of a path: letters between other characters, three or more."""
    whole = F.concat_ws("/", F.regexp_replace(host, r"[^.]*$", ""), F.lower(path))
    return F.array_distinct(F.regexp_extract_all(whole, F.lit(r"[a-z]{3,}"), F.lit(0)))


def _map(weights: dict[str, float]) -> Column | None:
    return F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))]) if weights else None


def _features(rows: DataFrame) -> DataFrame:
    """Adds the features that need no statistics, and end (the suffix) and terms, to rows with url, host, path, tail."""
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))) / float(len(x))
    low, n = F.lower(F.col("u")), F.greatest(F.length("u"), F.lit(1)).cast("double")
    share = [count(F.col("low"), x) / n for x in _SYMBOLS]
    entropy = F.lit(0.0)
    for s in share:
        entropy = entropy - F.when(s > 0, s * F.log2(s)).otherwise(F.lit(0.0))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    rows = rows.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("low", low)
    return rows.select(
        "*", F.length("u").cast("double").alias("n_url"), F.length("host").cast("double").alias("n_host"), F.length("path").cast("double").alias("n_path"),
        count(F.col("path"), "/").alias("depth"), count(F.col("host"), ".").alias("labels"), (digits(F.col("u")) / n).alias("digits"),
        digits(F.col("host")).cast("double").alias("host_digits"), entropy.alias("entropy"), (count(F.col("tail"), "&") + F.col("tail").startswith("?").cast("double")).alias("params"),
        F.length("tail").cast("double").alias("n_query"), count(F.col("host"), "-").alias("hyphens"), count(F.col("tail"), "#").alias("fragment"), count(F.col("u"), "%").alias("escapes"),
        F.substring_index("host", ".", -1).alias("end"), _terms(F.col("host"), F.col("path")).alias("terms"),
    )


def _split(rows: DataFrame) -> DataFrame:
    host, path, tail = parts(F.col("url"))
    return rows.withColumn("host", host).withColumn("path", path).withColumn("tail", tail)


def examples(spark) -> DataFrame:
    """The labelled URLs of this module: url, bad."""
    rows = [(u, 0.0) for u in GOOD.split()] + [(u, 1.0) for u in BAD.split()]
    return spark.createDataFrame(rows, "url string, bad double")


def _odds(keys: list[list[str]], bad: np.ndarray, smooth: float, terms: int) -> dict[str, float]:
    """Log odds of each key among bad against good rows; of more than ``terms`` keys those that say most."""
    seen: dict[str, list[int]] = {}
    for ks, y in zip(keys, bad):
        for k in ks:
            seen.setdefault(k, [0, 0])[int(y)] += 1
    share = (bad.sum() + 1) / (len(bad) - bad.sum() + 1)
    odds = {k: float(np.log((b + smooth) / (share * a + smooth))) for k, (a, b) in seen.items()}
    return dict(sorted(sorted(odds.items()), key=lambda x: -abs(x[1]))[:terms])


def _statistics(end: str, terms: list[str], suffixes: dict[str, float], words: dict[str, float]) -> list[float]:
    known = [words.get(t, 0.0) for t in terms]
    return [suffixes.get(end, 0.0), sum(known), max([0.0, *known])]


@dataclass
class UrlModel:
    trees: Trees
    suffixes: dict[str, float]
    words: dict[str, float]

    def probability(self, rows: DataFrame) -> DataFrame:
        """Adds ``bad_score`` (0 to 1) to rows with url, host, path, tail."""
        at = lambda weights, key: F.coalesce(F.try_element_at(_map(weights), key), F.lit(0.0)) if weights else F.lit(0.0)
        x = _features(rows).withColumn("known", F.transform("terms", lambda t: at(self.words, t)))
        x = x.withColumns({"suffix": at(self.suffixes, F.col("end")), "words": F.aggregate("known", F.lit(0.0), lambda a, w: a + w), "worst": F.coalesce(F.array_max(F.array_append("known", F.lit(0.0))), F.lit(0.0))})
        margin = self.trees.expression([F.col(f) for f in FEATURES])
        return x.withColumn("bad_score", 1 / (1 + F.exp(-margin))).drop("u", "low", "end", "terms", "known", *FEATURES)


def _learned(rows: list, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and fold of labelled rows; statistics of each without its fold."""
    y, fold = np.array([r["bad"] for r in rows], float), np.arange(len(rows)) % FOLDS
    x = np.zeros((len(rows), len(FEATURES)))
    for k in range(FOLDS):
        some = [r for r, f in zip(rows, fold) if f != k]
        stats = _odds([[r["end"]] for r in some], y[fold != k], 2.0, terms), _odds([r["terms"] for r in some], y[fold != k], 0.3, terms)
        for i in np.flatnonzero(fold == k).tolist():
            x[i] = [rows[i][f] for f in FEATURES[:-3]] + _statistics(rows[i]["end"], rows[i]["terms"], *stats)
    return x, y, fold


def _rows(labelled: DataFrame, sample: int) -> list:
    """Features of at most ``sample`` different labelled URLs; one that is given both labels is bad."""
    one = labelled.where("url is not null and bad is not null").groupBy(F.col("url").cast("string").alias("url")).agg(F.max("bad").alias("bad"))
    one = one.orderBy(F.xxhash64("url"), "url").limit(sample)
    return sorted(_features(_split(one)).select("url", "bad", "end", "terms", *FEATURES[:-3]).collect(), key=lambda r: (r["bad"], hash_of(r["url"])))


def hash_of(url: str) -> int:
    return zlib.crc32(url.encode())


def _train(x: np.ndarray, y: np.ndarray) -> Trees:
    return train(x, y, trees=40, depth=3, rate=0.15, least=1.0)


def held_out_scores(labelled: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> list[tuple[str, float, float]]:
    """(url, bad, score) of every labelled row, by trees and statistics that have not seen its fold."""
    rows = _rows(labelled, sample)
    x, y, fold = _learned(rows, terms)
    out = np.zeros(len(rows))
    for k in range(FOLDS):
        out[fold == k] = 1 / (1 + np.exp(-_train(x[fold != k], y[fold != k]).margin(x[fold == k])))
    return [(r["url"], float(b), float(p)) for r, b, p in zip(rows, y, out)]


def fit(labelled: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> UrlModel:
    """Trains from labelled(url, bad)."""
    rows = _rows(labelled, sample)
    x, y, _ = _learned(rows, terms)
    return UrlModel(_train(x, y), _odds([[r["end"]] for r in rows], y, 2.0, terms), _odds([r["terms"] for r in rows], y, 0.3, terms))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_score of every page."""
    model = model or fit(examples(pages.sparkSession))
    rows = _split(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    rows = model.probability(rows)
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("bad_score") >= LIMIT, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule_of(host, path, rules).alias("rule"), verdict.alias("verdict"), "bad_score")
