"""URL filter: host and path rules, then logistic regression on hashed character n-grams of host and path.

An n-gram weighs by how few of the urls at hand hold it (inverse document frequency, counted over all of them), so what all hosts and paths
share says little.  The regression is fitted by plain gradient descent on a small labelled table of at most ``MOST_LABELLED`` urls; its
weights and the frequencies are arrays of fixed size.  Pages are judged row by row without any shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from jobmill.llm.common import picked, prefix_sums, span_hash, utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Action, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_LABELLED = 10_000
BITS, LENGTHS = 16, (3, 4)
ROUNDS, RATE, RIDGE = 400, 10.0, 1e-4
ALLOW_WEIGHT = 1.2  # what a good url wrongly blocked costs against a bad one let through
#: The labelled urls: 1 is block.
LABELLED = tuple((url, 0) for url in (
    "https://library.example.edu/catalog/history", "https://news.example.com/world/2024/report", "https://docs.example.net/guide/install.html", "https://en.encyclopedia.example/article/river",
    "https://science.example.edu/papers/article", "https://blog.garden.example/en/2021/roses", "https://www.museum.example/fr/visite", "https://forum.code.example/en/thread/python-join",
    "https://recipes.example.com/en/bread.html", "https://weather.example.net/en/today", "https://school.example.edu/en/lesson/4", "https://city.example.gov/en/services/water",
    "https://travel.example.com/es/museos", "https://journal.example.net/en/volume/12", "https://book.example.com/de/kapitel/3", "https://www.health.example.gov/en/advice",
    "https://wiki.example.net/en/Main_Page", "https://m.news.example.net/fr/economie", "https://math.example.edu/en/notes/algebra", "https://research.example.net/de/bericht",
)) + tuple((url, 1) for url in (
    "http://free-casino-bonus.example/win/now", "http://cheap-pills.example.biz/buy?ref=1", "http://xxx-videos.example/watch/1", "http://hot-dating.example/singles/click",
    "http://casino.example.info/slots/jackpot", "http://get-rich-fast.example/offer/bonus", "http://adult.example/xxx/gallery", "http://warez.example.ru/crack/keygen.exe",
    "http://torrent.example/download/movie-free", "http://win-prize.example/claim/gift-card", "http://pharmacy.example.biz/viagra-cheap", "http://track.ads.example/click/redirect",
    "http://poker.example/bonus/free-bet", "http://loan-now.example/apply/fast-cash", "http://porn.example/videos/hd", "http://spam.example/unsubscribe/click-here",
    "http://replica-watches.example/shop/cheap", "http://bet365.example/casino/live", "http://escort.example/city/hot", "http://malware.example/setup/free-download.exe",
))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram; an n-gram of the host and the same one of the path have different slots."""
    rows, slots = [], []
    for salt, column in enumerate((hosts, paths)):
        data, offsets = utf8(column)
        sums, owner = prefix_sums(data), np.repeat(np.arange(len(column)), np.diff(offsets))
        for n in LENGTHS:
            starts = np.flatnonzero(np.arange(len(data)) + n <= offsets[1:][owner]) if len(data) else np.empty(0, np.int64)
            codes = span_hash(sums, starts, starts + n) ^ np.uint64(salt * 0x5851F42D4C957F2D)
            rows.append(owner[starts])
            slots.append((codes >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def frequencies(pages: DataFrame) -> np.ndarray:
    """Inverse document frequency of every slot over ``pages`` (host, path): tasks count, Spark sums 2**BITS numbers."""
    def count(batches):
        held, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            rows, slots = features(batch.column("host"), batch.column("path"))
            held += np.bincount(np.unique(rows * (1 << BITS) + slots) & ((1 << BITS) - 1), minlength=1 << BITS)
            n += batch.num_rows
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(held[used], n))], ["slot", "n"])

    sums = pages.select("host", "path").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums.column("slot").to_pylist(), sums.column("n").to_pylist(), strict=True))
    total, counts = found.pop(-1, 0), np.zeros(1 << BITS)
    if found:
        counts[np.fromiter(found, np.int64)] = np.fromiter(found.values(), np.float64)
    return np.log((total + 2) / (counts + 1))


def _weighed(idf: np.ndarray, hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of every n-gram; the values of a row have length one."""
    rows, slots = features(hosts, paths)
    value = idf[slots]
    length = np.sqrt(np.bincount(rows, value**2, len(hosts)))
    return rows, slots, value / np.maximum(length, 1e-9)[rows]


def margins(weights: np.ndarray, idf: np.ndarray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """The log-odds of block: the weighed n-grams of a row, plus the bias."""
    rows, slots, value = _weighed(idf, hosts, paths)
    return np.bincount(rows, weights[slots] * value, len(hosts)) + weights[-1]


def fit(labelled=LABELLED, idf: np.ndarray | None = None) -> np.ndarray:
    """Weights by full-batch gradient descent; the last one is the bias.  The result does not depend on row order."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"the labelled table may have {MOST_LABELLED} rows at most")
    weights = np.zeros((1 << BITS) + 1)
    if not labelled:
        return weights
    labelled = sorted(labelled)
    parts = [split_url(url) for url, _ in labelled]
    rows, slots, value = _weighed(np.ones(1 << BITS) if idf is None else idf, pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts]))
    y, n = np.array([float(label) for _, label in labelled]), len(labelled)
    cost = np.where(y == 0, ALLOW_WEIGHT, 1.0) / n
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(np.bincount(rows, weights[slots] * value, n) + weights[-1])))
        slope = (p - y) * cost
        weights[:-1] -= RATE * (np.bincount(slots, slope[rows] * value, 1 << BITS) + RIDGE * weights[:-1])
        weights[-1] -= RATE * slope.sum()
    return weights


def labelled_rows(table: DataFrame, url_col: str = "url", label_col: str = "block") -> tuple[tuple[str, int], ...]:
    """(url, 1 for block) of a labelled table; one of more than ``MOST_LABELLED`` rows is refused, rows with nulls are left out."""
    rows = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(url_col, F.col(label_col).cast("int")).limit(MOST_LABELLED + 1).collect()
    return tuple((r[0], r[1]) for r in rows)


def split_url(url: str | None) -> tuple[str, str]:
    """The same host and path as ``host_path`` for one url of the labelled table."""
    rest = (url or "").partition("://")[2]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:stop]


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    The longest fitting rule decides (of equal length the first listed); else a block score of 0.5 or more blocks.  A null url
    or one without ``://`` has an empty host and path and is judged by the bias alone; ids are carried as they are, so
    null and repeated ones keep their rows.  ``labelled`` is a sequence of (url, 1 for block) or a table with ``url`` and ``block``.
    """
    rules = list(rules)
    placed = picked(pages, page_id=id_col, url=url_col).select("page_id", *[c.alias(n) for c, n in zip(host_path(F.col("url")), ("host", "path"), strict=True)])
    idf = frequencies(placed)
    weights = fit(labelled_rows(labelled) if isinstance(labelled, DataFrame) else labelled, idf)

    @F.pandas_udf(DoubleType())
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-margins(weights, idf, pa.array(hosts, pa.string()), pa.array(paths, pa.string())))))

    rule, verdict = F.lit(None).cast("string"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    for action, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return placed.withColumn("block_score", score("host", "path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "block_score")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
