"""Operator 5: URL filter by rules and by logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import fresh

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: A small labelled table: (host, path, 1 for unwanted). Another one can be given to ``fit``.
LABELLED: list[tuple[str, str, int]] = [
    # unwanted: medicine, gambling, adult, spam and farms of links, adverts and tracking, cracked software, quick money
    ("www.discount-pharmacy.test", "/buy/tablets", 1),
    ("online-pharmacy-store.test", "/order/pills", 1),
    ("pillshop.test", "/generic-meds", 1),
    ("meds-without-prescription.test", "/", 1),
    ("www.lucky-casino.test", "/slots", 1),
    ("casino-bonus.test", "/free-spins", 1),
    ("jackpot-slots.test", "/play", 1),
    ("pokerroom.test", "/register?bonus=100", 1),
    ("m.sportsbetting.test", "/odds/today", 1),
    ("bet-on-football.test", "/bets/live", 1),
    ("lottery-winner.test", "/claim", 1),
    ("m.adult-videos.test", "/watch/1", 1),
    ("xxx-clips.test", "/tube", 1),
    ("live-sex-cams.test", "/girls", 1),
    ("porn-gallery.test", "/pics", 1),
    ("link-exchange.test", "/backlinks", 1),
    ("seo-backlinks.test", "/buy-links", 1),
    ("spam-directory.test", "/list", 1),
    ("article-farm.test", "/spin", 1),
    ("adserver.test", "/banner.gif", 1),
    ("ads-network.test", "/click?id=1", 1),
    ("click-tracking.test", "/pixel", 1),
    ("tracker-pixel.test", "/t.gif", 1),
    ("popup-ads.test", "/redirect", 1),
    ("cracked-software.test", "/keygen", 1),
    ("warez-downloads.test", "/crack", 1),
    ("free-download-cracks.test", "/serial", 1),
    ("www.payday-loan.test", "/apply-now", 1),
    ("instant-loans.test", "/cash", 1),
    ("blog.make-money-fast.test", "/join", 1),
    ("get-rich-quick.test", "/offer", 1),
    ("replica-watches.test", "/cheap", 1),
    ("cheap-handbags.test", "/sale", 1),
    ("weight-loss-miracle.test", "/diet-pills", 1),
    ("crypto-giveaway.test", "/double", 1),
    ("free-gift-cards.test", "/survey", 1),
    # wanted: reference, news, science, public bodies, hobbies, shops, software, people
    ("encyclopedia.test", "/wiki/Physics", 0),
    ("dictionary.test", "/word/river", 0),
    ("www.daily-news.test", "/world/2019/elections", 0),
    ("morning-paper.test", "/local/school", 0),
    ("university.test", "/courses/algebra", 0),
    ("college-library.test", "/catalogue/4411", 0),
    ("science-journal.test", "/articles/genome", 0),
    ("observatory.test", "/stars", 0),
    ("www.city-council.test", "/minutes", 0),
    ("ministry-health.test", "/advice/sleep", 0),
    ("national-museum.test", "/collection/bronze", 0),
    ("m.weather-service.test", "/forecast", 0),
    ("m.railway.test", "/timetable", 0),
    ("hospital.test", "/departments", 0),
    ("blog.gardening.test", "/roses/pruning", 0),
    ("cookbook.test", "/recipes/bread", 0),
    ("birdwatching.test", "/species/heron", 0),
    ("cycling-club.test", "/routes", 0),
    ("chess-club.test", "/openings", 0),
    ("photography.test", "/lenses", 0),
    ("choir.test", "/concerts", 0),
    ("blog.travel-diary.test", "/lisbon", 0),
    ("www.bookshop.test", "/novels", 0),
    ("furniture.test", "/chairs/oak", 0),
    ("open-source.test", "/docs/install", 0),
    ("python-tutorial.test", "/loops.html", 0),
    ("maths-forum.test", "/thread/12", 0),
    ("history-society.test", "/archive/1848", 0),
    ("family-tree.test", "/about", 0),
    ("blog.my-notes.test", "/monday", 0),
    ("kindergarten.test", "/contact", 0),
    ("architecture.test", "/bridges", 0),
    ("theatre.test", "/programme", 0),
    ("geology.test", "/minerals/quartz", 0),
    ("linguistics.test", "/grammar", 0),
    ("translations.test", "/poems", 0),
    ("football-results.test", "/table", 0),
    ("music-school.test", "/lessons/piano", 0),
    ("farmers-market.test", "/apples", 0),
    ("sailing.test", "/knots", 0),
]

BINS = 1 << 14


def grams(host: str, path: str, low: int = 3, high: int = 5) -> np.ndarray:
    """Distinct bins of the character n-grams of a host and of a path; the two are told apart."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(low, high + 1):
            out.update(zlib.crc32(f"{mark}{part[k : k + n]}".encode()) % BINS for k in range(len(part) - n + 1))
    return np.array(sorted(out), np.int64)


def fit(table: Sequence[tuple[str, str, int]] = LABELLED, steps: int = 1500, rate: float = 30.0, decay: float = 1e-5, prior: float = 0.3) -> np.ndarray:
    """Weights of the bins and, last, the intercept: gradient descent on the log loss over the whole small table. The
    intercept is then moved from the table's share of unwanted rows to the share ``prior`` that is expected of all urls."""
    if len({y for *_, y in table}) < 2:
        raise ValueError("the table needs wanted and unwanted urls")
    rows = [grams(h, p) for h, p, _ in table]
    labels = np.array([y for *_, y in table], float)
    weights = np.zeros(BINS + 1)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    starts, owner, scale = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(rows)), sizes), 1 / np.sqrt(sizes)
    for _ in range(steps):
        z = np.add.reduceat(weights[flat], starts) * scale + weights[-1]
        g = (1 / (1 + np.exp(-z)) - labels) / len(rows)
        weights[:-1] -= rate * (np.bincount(flat, (g * scale)[owner], BINS) + decay * weights[:-1])
        weights[-1] -= rate * g.sum()
    weights[-1] += np.log(prior / (1 - prior)) - np.log(labels.mean() / (1 - labels.mean()))
    return weights


def probability(weights: np.ndarray, host: str, path: str) -> float:
    bins = grams(host, path)
    return float(1 / (1 + np.exp(-(weights[bins].sum() / np.sqrt(max(len(bins), 1)) + weights[-1]))))


def held_out_accuracy(table: Sequence[tuple[str, str, int]] = LABELLED, folds: int = 6, prior: float = 0.3) -> float:
    """The mean share of right verdicts of the two labels over rows that were held out of the fit, each row once."""
    right: dict[int, list[bool]] = {}
    for k in range(folds):
        weights = fit([r for n, r in enumerate(table) if n % folds != k], prior=prior)
        for h, p, y in table[k::folds]:
            right.setdefault(y, []).append((probability(weights, h, p) >= 0.5) == bool(y))
    return float(np.mean([np.mean(x) for x in right.values()]))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #, or the end."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Number of the rule that decides, null where none fits: the longest, host and path together; the first of equals."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rule_name(rules[k])), k))
    found = F.lit(None).cast("int")
    for k in reversed(order):
        _, h, p = rules[k]
        found = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(k)).otherwise(found)
    return found


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), weights: np.ndarray | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the text of the deciding rule, else null), url_score and verdict (block or allow).

    A rule fits its host and all subdomains when the path starts with the rule's path; of several the longest (host and
    path together) wins. Where no rule fits, the verdict is block when the regression's probability, url_score, is 0.5
    or more. A null url, or one without ``://``, has an empty host and path and is judged by these. Columns
    of these names that ``pages`` has already are replaced. Repeated rows are judged alike; empty input gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit() if weights is None else weights)

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        w = shared.value
        for hosts, paths in parts:
            known: dict[tuple[str, str], float] = {}
            out = []
            for key in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                if key not in known:
                    known[key] = probability(w, *key)
                out.append(known[key])
            yield pa.array(out, pa.float64())

    host, path = host_and_path(F.col(url_col))
    h, p, k = fresh(pages, "_host"), fresh(pages, "_path"), fresh(pages, "_rule")
    rows = pages.withColumns({h: host, p: path})
    rows = rows.withColumn(k, matched_rule(F.col(h), F.col(p), rules))
    names = F.array(*[F.lit(rule_name(r)) for r in rules]) if rules else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(r[0]) for r in rules]) if rules else F.array(F.lit(""))
    score = F.arrow_udf(run, "double")(F.col(h), F.col(p))
    rows = rows.withColumn("url_score", score)
    by_method = F.when(F.col("url_score") >= 0.5, "block").otherwise("allow")
    rows = rows.withColumns({
        "host": F.col(h), "path": F.col(p), "rule": F.get(names, F.col(k)), "verdict": F.coalesce(F.get(verdicts, F.col(k)), by_method),
    })
    return rows.drop(h, p, k)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
