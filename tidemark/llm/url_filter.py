"""URL verdicts by host and path rules, and by logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

#: (rule, verdict): a host, then a path from its first slash on.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table. It was written down from what link lists and directories on the web commonly hold, without
#: regard to the tables at hand: no host, host word or ending of theirs was put in.
LABELLED = tuple((u, "allow") for u in """
https://www.nationallibrary.ca/catalogue/maps
https://botany.univ-lyon.fr/cours/plan.php
http://www.townhall.se/protokoll/2019.pdf
https://docs.compilerkit.dev/reference/linker
https://weather.coastguard.is/forecast/south
https://www.sculpturepark.nl/bezoek/openingstijden
https://railmuseum.ch/ausstellung/dampf
http://parish-records.ie/births/1871
https://www.chessfederation.eu/tournaments/open
https://bread.kitchentable.uk/sourdough/starter
https://www.observatory.cl/images/nebula
https://wetlands.conservation.za/birds/heron
https://journal.hydrology.at/volume/14/article/3
https://www.cityorchestra.pl/koncerty/jesien
http://people.math.edu.au/notes/topology.html
https://lighthousekeepers.no/historie/fyr
https://www.beekeeping.nz/guide/spring
https://forum.woodturners.be/threads/lathe
https://hospital.region.dk/patient/information
https://www.glaciology.gl/data/cores
https://schooldistrict.us/calendar/terms
https://blog.letterpress.pt/tipos/garamond
https://www.folkdance.hu/tanc/csardas
https://translation.institute.jp/seminar/2018
http://www.ferryport.fi/aikataulu
https://opera.teatro.it/stagione/programma
https://www.geology.museum.br/minerais/quartzo
https://archive.newspaper.in/editorial/monsoon
https://mountainrescue.sk/rady/laviny
https://www.astronomers.mx/noticias/eclipse
https://climate.research.kr/paper/ocean
https://www.villagebakery.lu/horaires
https://grammar.language.gr/lessons/verbs
https://www.canoeclub.cz/vylety/reka
https://legal.opinions.ar/fallos/1994
https://pottery.workshop.tr/glaze/recipes
https://www.forestry.ee/mets/kask
https://poems.anthology.ro/autori/index
https://www.harbourmaster.hr/plovidba/karte
https://textile.heritage.pe/tejidos/alpaca
""".split()) + tuple((u, "block") for u in """
https://royal-roulette-jackpot.ca/bonus/spin
http://lotto-jackpot-millions.ie/claim
https://texas-poker-bonus.au/deposit
http://poker-room-vip.pt/join
https://slots-of-gold.sk/spins
http://roulette-system.tr/order
https://gambling-tips-vip.se/picks
https://viagra-online-pharmacy.uk/order/9
http://cialis-generic.nz/buy
https://no-prescription-pharmacy.jp/meds
http://miracle-weightloss.kr/buy/now
https://diet-miracle-secret.ro/offer
https://payday-loans-fast.is/apply
http://instant-loans-nocheck.za/apply
https://credit-repair-secret.dk/signup
https://forex-signals-vip.it/profit
http://bitcoin-doubler.gr/invest
https://crypto-giveaway.pe/claim
https://replica-rolex-outlet.ch/shop
http://designer-replica-bags.pl/sale
https://luxury-outlet-sale.us/deal
https://hot-webcam-girls.in/live
http://xxx-porn-tube.ar/watch
https://porn-videos-hd.fr/watch
https://escort-girls-tonight.eu/girls
http://sexy-singles-dating.no/join
https://singles-hookup.hu/join
https://warez-keygen-serial.mx/download
http://crack-serial-keys.ee/download
https://torrent-movies-hd.dev/download
http://popunder-traffic.cl/buy
https://buy-traffic-visitors.be/order
https://backlinks-seo-boost.fi/order
http://buy-followers-likes.lu/order
https://seo-rank-boost.hr/packages
http://email-blast-lists.nl/buy
https://bulk-mailer-lists.at/order
https://prize-giveaway-claim.gl/claim
http://iphone-prize-survey.br/claim
https://survey-reward-claim.cz/claim
https://work-at-home-profit.ca/signup
http://get-rich-secret.ie/signup
https://hot-stock-profit.au/signup
http://psychic-love-reading.pt/order
""".split())  # fmt: skip


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path, as the first '://' and the first of '/', '?' and '#' after it bound them; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(rest), path


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")

    chain = lambda value: reduce(lambda rest, r: F.when(fits(r[0]), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return chain(lambda r: r[0]), chain(lambda r: r[1])


#: What a path weighs against the host.
PATH = 0.2
DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    low: int = 3
    high: int = 5

    def slots(self, host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
        """The hashed n-grams of host and path, each slot once, and their values: the host's have length one, the path's PATH. Digits are all alike."""
        at, values = [], []
        for kind, length, s in (("h", 1.0, f"^{host}$"), ("p", PATH, f"^{path}$")):
            s = DIGIT.sub("0", s)
            found = {crc32(f"{kind}{s[i : i + n]}".encode()) % len(self.weights) for n in range(self.low, self.high + 1) for i in range(len(s) - n + 1)}
            at += sorted(found)
            values += [length * max(len(found), 1) ** -0.5] * len(found)
        return np.array(at, np.int64), np.array(values)

    def score(self, host: str, path: str) -> float:
        """The log odds of block."""
        at, values = self.slots(host, path)
        return float(self.weights[at] @ values + self.bias)


def train(labelled: tuple[tuple[str, str, str], ...], slots: int = 1 << 16, steps: int = 1000, rate: float = 4.0, decay: float = 3e-4) -> UrlModel:
    """Full-batch gradient descent over (host, path, verdict) rows; the same rows always give the same model."""
    model = UrlModel(np.zeros(slots), 0.0)
    rows = [model.slots(h, p) for h, p, _ in labelled]
    of = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    at, values = (np.concatenate(x) for x in zip(*rows, strict=True))
    y = np.array([float(v == "block") for *_, v in labelled])
    w, b = np.zeros(slots), 0.0
    for _ in range(steps):
        z = np.bincount(of, w[at] * values, len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(at, g[of] * values, slots) + decay * w)
        b -= rate * g.sum()
    return UrlModel(w, float(b))


def split_url(url: str) -> tuple[str, str]:
    """host_and_path of one labelled address."""
    rest = url.partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].lower(), path[:cut]


def cross_validated(labelled: tuple[tuple[str, str, str], ...], folds: int = 10) -> tuple[float, float]:
    """The threshold of the log odds that parts block from allow best in rows that the model wasn't fitted on (mean of the accuracies
    of both, the middle of the best range), and that accuracy."""
    scores, block = [], []
    for k in range(folds):
        model = train(tuple(r for i, r in enumerate(labelled) if i % folds != k))
        scores += [model.score(h, p) for h, p, _ in labelled[k::folds]]
        block += [v == "block" for *_, v in labelled[k::folds]]
    z, y = np.array(scores), np.array(block)
    cuts = np.sort(z)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    right = np.array([((z[y] > c).mean() + (z[~y] <= c).mean()) / 2 for c in cuts])
    best = cuts[right == right.max()]
    return float((best.min() + best.max()) / 2), float(right.max())


@cache
def default_model() -> tuple[UrlModel, float]:
    """The model of LABELLED, and its threshold by cross-validation on that table alone."""
    rows = tuple((*split_url(u), v) for u, v in LABELLED)
    return train(rows), cross_validated(rows)[0]


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: UrlModel | None = None, threshold: float | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict for each row of pages (page_id, url, ...).

    A null url or one without '://' has an empty host and path; no rule fits it and the model judges it like any other.
    Repeated rows give a row each; an empty table gives an empty result; further columns are ignored. score is the
    model's log odds of block, of rows that a rule decides as well; over ``threshold`` the model blocks (by default the one that cross-validation on the
    labelled table gives; 0, even odds, for another model).
    """
    fitted, over = (model, 0.0) if model else default_model()
    over = over if threshold is None else threshold

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([fitted.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    host, path = host_and_path(F.col("url"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("score", score("host", "path"))
    method = F.when(F.col("score") > over, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, method).alias("verdict"))
