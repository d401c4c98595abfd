"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields

#: Lengths of the n-grams, and how many weights their hashes share.
GRAMS, BUCKETS = (3, 4, 5), 1 << 16
EPOCHS, RATE, DECAY, THRESHOLD = 400, 100.0, 1e-4, 0.5
#: Log odds of a URL of which no n-gram is known: it is let through.
BIAS = -1.0
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: Names of bad and of good sites that the query's model learns from, and the URLs in
#: which every one of them stands, in the host or in the path, so that only the names tell the two
#: kinds apart.
BAD_NAMES = """
adult-videos adult-chat adult adult-pics xxx-movies free-xxx porn-tube porn-hub sexy-girls casino-royal
casino-bonus online-casino best-casino poker-win slots-jackpot betting-tips spam spam-site spam-blog spam-links
link-farm content-farm farm-of-spam seo-farm cheap-pills buy-pills viagra-shop cheap-viagra replica-watches
malware-download free-malware phishing-login warez-crack crack-keygen torrent-warez payday-loans quick-loans
earn-money-fast click-ads ads-tracker casino-slots win-casino bets-online gambling gambling-sites online-gambling
sexshop sex-shop sexcam livesex hotsex sex-dating nude-pics nudes nakedgirls xxx xxxvideos pornstar freeporn
teenporn hardcore-porn erotica escort escorts escort-girls camgirls webcam-sex hookup-tonight poker pokerstars
videopoker texas-holdem-poker roulette blackjack-casino slots freeslots megaslots jackpot jackpots bingo-bonus
sportsbetting betting betwin sportsbook lottery-winner viagra cialis generic-cialis levitra-pills diet-pills
weightloss-pills miracle-diet replica-bags fake-rolex rolex-replica warez cracked-games keygen serial-keys
nulled-scripts torrents-free malware trojan-kit ransomware phishing account-verify-login paypal-verify
bank-login-secure payday loan-fast get-rich-quick easy-money-now forex-signals-win crypto-doubler bitcoin-doubler
free-iphone-winner free-giftcards survey-rewards clickbait popunder-ads adclicks ad-tracker buy-followers
buy-backlinks cheap-seo link-exchange spammer spamnet mail-blaster
""".split()
GOOD_NAMES = """
news library garden weather history travel science museum thinking station school other music thehouse theatre
action kitchen nation street another town nature university research brother docs wiki forum health mother
recipes father english cinema nothing together thunder sports leather winter thesis portion those bright shift
with therapy question months thatcher heather clothes gather stream windows farm farm-shop farmers-market animals
download downloads free free-software freedom open-source software hardware computer games chess football tennis
running cycling hiking mountains rivers islands sussex essex middlesex sexton shop bookshop workshop store market
bakery flowers coffee tea cooking dinner wine photos pictures video videos gallery art design architecture poetry
novel letters journal magazine daily times herald observer review opinion politics economy business finance bank
savings insurance pension jobs careers office hotel camping trains railway airport flights bus cars garage bikes
maps city village parish church council police court law medical hospital doctor nursing pharmacy dentist
vitamins diet fitness yoga baby family kids parents teacher lessons mathematics physics chemistry biology
astronomy geology climate energy water forest wildlife birds dogs cats horses fishing sailing harbour beach
summer autumn spring calendar events festival concert orchestra opera jazz radio television podcast blog about
contact help support login account search archive index category pages item product order cart delivery analysis
assessment classes password cocktails scunthorpe analytics titles grape button constitution experts exchange
""".split()
AROUND = """
http://{}.example.com/en/12 https://www.{}.example.org/de/7 https://blog.{}.example.net/fr/330.html
http://m.{}.example.com/es/901/ https://{}.example.net/en/45#top http://www.{}.example.com/fr/618?page=2&ref=x
http://{}.info https://{}.co.uk/about/team.php http://shop.{}.museum.example.edu/2021/03/14/item-77.html
http://{}.org/archive/pages/of/the/year/1998/part/two/section/nine/chapter/final/print/version/index.html
http://hosting.example.org/~bob/{}/index.html https://users.example.com/{} http://www.portal.info/a/b/{}/
https://files.server.de/pub/2020/11/{}.html http://example.edu/{}/en/12 https://cdn.co.uk/category/{}/item-123/view.php
https://static.place.org/data/list/of/the/month/1998/part/one/section/two/{}/chapter/last/print/full/index.html
""".split()
#: URLs with a bad name beside good ones, which do not make up for it.
MIXED = """
http://{good}.example.com/{bad}/ https://www.{bad}.example.org/{good}/{more}.html https://{good}.info/{more}/{bad}/en/3
http://pages.example.edu/{good}/{bad}/{more}/{good}/index.html http://{bad}.co.uk/{good}/{more}/{good}/{more}/print
""".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to / ? # or the end, with A-Z in lower
    case; then up to ? # or the end. Both empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWERED), empty), F.coalesce(path, empty)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, null where none does. A rule ``host/path``
    fits its host and all subdomains of it, if the path starts with the rule's."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        verdict, name = F.when(fits, kind).otherwise(verdict), F.when(fits, rule).otherwise(name)
    return verdict, name


def _pieces(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(URL number of each piece, piece number and bucket of each n-gram). Pieces are the labels of
    hosts and the segments of paths, which are read without regard to case and with %XX decoded; ``^`` and ``$`` mark their ends, and the n-grams of a host are
    others than those of a path."""
    owners, pieces, buckets, count = [], [], [], 0
    for salt, (texts, mark) in enumerate(((hosts, b"."), (paths, b"/"))):
        plain = [unquote(t, errors="replace").lower() if salt and ("%" in t or not t.islower()) else t for t in texts]
        split = [t.encode(errors="replace").split(mark) for t in plain]
        parts = [b"^" + x + b"$" for own in split for x in own]
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        sizes = np.array([len(x) for x in parts], np.int64)
        piece = np.repeat(count + np.arange(len(parts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the end
        for n in GRAMS:
            h = np.full(max(0, len(data) - n + 1), salt * 31 + n, np.uint64)
            for j in range(n):
                h = (h ^ data[j : j + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            inside = left[: len(h)] >= n
            pieces.append(piece[: len(h)][inside])
            buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(split)), [len(own) for own in split]))
        count += len(parts)
    return np.concatenate(owners), np.concatenate(pieces), np.concatenate(buckets)


def hashed_grams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(URL number, bucket) of all n-grams of the pieces of hosts and paths."""
    owner, piece, bucket = _pieces(hosts, paths)
    return owner[piece], bucket


class _Grams:
    """The n-grams of URLs, and what is computed from weights: every piece has the sum of its n-grams'
    weights / sqrt(number), and a URL the largest of its pieces, 0 where none has an n-gram."""

    def __init__(self, hosts: Sequence[str], paths: Sequence[str]) -> None:
        self.urls = len(hosts)
        self.owner, self.piece, self.bucket = _pieces(hosts, paths)
        counts = np.bincount(self.piece, minlength=len(self.owner))
        self.some = counts > 0
        self.share = 1 / np.sqrt(counts[self.piece])

    def largest(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of each piece, of each URL)."""
        each = np.bincount(self.piece, weights[self.bucket] * self.share, len(self.owner))
        top = np.full(self.urls, -np.inf)
        np.maximum.at(top, self.owner[self.some], each[self.some])
        return each, np.where(np.isinf(top), 0, top)

    def slope(self, weights: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Of the cross entropy, shared among a URL's pieces by their softmax."""
        each, top = self.largest(weights)
        error = (_sigmoid(top) - bad) / max(1, self.urls)
        part = np.exp(np.minimum(0, each - top[self.owner])) * self.some
        part *= (error / np.maximum(1e-9, np.bincount(self.owner, part, self.urls)))[self.owner]
        return np.bincount(self.bucket, part[self.piece] * self.share, BUCKETS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(BIAS + x, -30, 30)))


@dataclass
class UrlModel:
    """Probability that a URL is bad: sigmoid(BIAS + the largest sum, over the labels of its host and
    the segments of its path, of their n-grams' weights / sqrt(number)). So neither a long path nor
    good names beside it hide a bad one."""

    weights: np.ndarray

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        return _sigmoid(_Grams(hosts, paths).largest(self.weights)[1])


def fit(hosts: Sequence[str], paths: Sequence[str], bad: Sequence[bool]) -> UrlModel:
    """Logistic regression by full-batch gradient steps on a small table in the driver's memory."""
    grams, y = _Grams(hosts, paths), np.asarray(bad, float)
    weights = np.zeros(BUCKETS)
    for step in range(EPOCHS):
        weights = weights - RATE * (1 - step / EPOCHS) * (grams.slope(weights, y) + DECAY * weights)
    return UrlModel(weights)


def fit_table(labelled: DataFrame, most: int = 10_000) -> UrlModel:
    """``labelled(url, bad)``, of which the ``most`` rows with the smallest hashed URLs are learnt
    from; rows with a null are left out."""
    host, path = url_parts(F.col("url"))
    rows = labelled.dropna(subset=["url", "bad"]).orderBy(F.xxhash64("url"), "url").limit(most)
    found = rows.select(host.alias("host"), path.alias("path"), F.col("bad").cast("boolean").alias("bad")).collect()
    return fit([r.host for r in found], [r.path for r in found], [r.bad for r in found])


def _judged(batches: Iterator[pa.RecordBatch], model: UrlModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        scores = model.scores(batch.column("host").to_pylist(), batch.column("path").to_pylist()) if n else np.empty(0)
        keep = [c for c in batch.schema.names if c != "_score"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])


def verdicts(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; where none does, the model blocks URLs with a score of at
    least ``threshold``. Rules of equal length are taken in the order of their text. Null URLs and
    URLs without ``://`` have empty parts, fit no rule and are let through by the model's bias. Repeated
    rows get a row each; other columns, html among them, are not read.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    schema = fields(pages, "page_id", "host string, path string, score double")
    scored = parts.mapInArrow(partial(_judged, model=model), schema)
    verdict, rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def labelled_rows() -> list[tuple[str, bool]]:
    names = [(n, True) for n in BAD_NAMES] + [(n, False) for n in GOOD_NAMES]
    alone = [(url.format(n), bad) for n, bad in names for url in AROUND]
    beside = list(zip(GOOD_NAMES, GOOD_NAMES[7:] + GOOD_NAMES[:7]))
    mixed = [(n, True, *beside[i]) for i, n in enumerate(BAD_NAMES)]
    mixed += [(n, False, *beside[(i + k) % len(beside)]) for k in (3, 11) for i, n in enumerate(GOOD_NAMES)]
    return alone + [(url.format(bad=n, good=g, more=m), bad) for n, bad, g, m in mixed for url in MIXED]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table of this module."""
    return spark.createDataFrame(labelled_rows(), "url string, bad boolean")
