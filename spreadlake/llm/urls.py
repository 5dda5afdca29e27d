"""URL filter: rules of host and path, and for what no rule decides a classifier of character n-grams.

The classifier is a logistic regression on the distinct 3- to 5-grams of host and of path (each between
marks of its own, so the start and the end of either count), hashed into SLOTS slots.  It is trained from a
small labelled table of URLs, of which at most train_rows are used (a documented bound: the table is a
parameter, made by hand, not the corpus).  Scoring works on the whole of each URL, a batch at a time.

A null URL, or one without "://", has an empty host and an empty path: no rule with a host fits it, and the
classifier judges it by its intercept and the marks.  Repeated rows are judged alike.  Other columns stay out,
whatever their names, unless they are asked for by keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import U, mix

SLOTS = 1 << 18
SIZES = (3, 4, 5)
TRAIN_ROWS = 5000
THRESHOLD = 0.5
CHUNK_CHARS = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rules, the driver's: (verdict, host and path).  Fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

# A small labelled table: hosts by what they are named for, on three top-level domains and several paths alike.
BLOCKED = """
adult-videos adult-chat xxx-clips sex-dates hot-adult porn-tube nude-cams escort-list
casino-royal best-casino online-casino casino-bonus poker-win slots-win win-jackpot lucky-win
bets-live sport-bets free-bets-now betting-tips bonus-bets free-spins free-money free-prizes
cheap-meds cheap-viagra pills-shop diet-pills buy-pills cheap-loans pharma-cheap cheap-watches
spam-links link-farm content-farm spam-mail click-farm seo-spam farm-clicks spam-blog
ads-server track-ads ad-tracker tracking-pixel popup-ads banner-ads click-track ads-exchange
""".split()
CLEAN = """
anderson brighton thistle thermal rethink nation stations motions tables ables
northern weather gather mother others another lantern western garden journal
history science library museum school college theory method lesson teacher
recipes cooking kitchen travel railway harbour village market council police
whether shelter sherwood fashion washing edition onshore inshore enthusiast orchard
music theatre poetry novels letters stories reading writing language grammar
health clinic nurses doctors safety climate energy forest rivers oceans
hansard standard handbook thousand island england ireland finland
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block): each host on three domains, with paths that say nothing of the label."""
    paths = ["/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}"]
    fronts = ["", "www.", "m.", "blog."]
    found = []
    for label, hosts in ((1, BLOCKED), (0, CLEAN)):
        for i, host in enumerate(hosts):
            for k, top in enumerate(("com", "net", "org")):
                found.append((f"http://{fronts[(i + k) % 4]}{host}.example.{top}{paths[(i // 4 + k) % 4].format(101 + 37 * i + k)}", label))
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equal ones that with the longer host; null where none fits."""
    ordered = sorted({r: v for v, r in rules}.items(), key=lambda x: (-len(x[0]), -len(x[0].partition("/")[0]), x[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in reversed(ordered):
        own, slash, rest = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of each row's host and path, in order of row and slot."""
    marked = [f"\x02{h}\x03\x04{p}\x05" for h, p in zip(hosts, paths, strict=True)]
    lengths = np.array([len(m) for m in marked], np.int64)
    cps = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    row = np.repeat(np.arange(len(marked)), lengths)
    in_path = np.arange(len(cps)) - np.repeat(np.cumsum(lengths) - lengths, lengths) > np.repeat([len(h) + 1 for h in hosts], lengths)
    part = 2 * row + in_path
    found = []
    for size in SIZES:
        n = max(0, len(cps) - size + 1)
        h = cps[:n].copy()
        for k in range(1, size):
            h = h * U(0x9E3779B97F4A7C15) + cps[k : n + k]
        whole = part[:n] == part[size - 1 : size - 1 + n]  # inside one host or one path
        h = mix(h + U(size) + (in_path[:n].astype(U) << U(32)))[whole] >> U(64 - SLOTS.bit_length() + 1)
        found.append(row[:n][whole] * SLOTS + h.astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // SLOTS, both % SLOTS


def fit(row: np.ndarray, slot: np.ndarray, y: np.ndarray, l2: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """(weight of each slot, intercept) of L2-regularised logistic regression by accelerated gradient steps.

    The step follows from the largest eigenvalue of the features' products, found by power iteration.
    """
    known, at = np.unique(slot, return_inverse=True)
    n = len(y)

    def forward(w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(row, w[at], n) + b

    def back(e: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(at, e[row], len(known)), float(e.sum())

    w, b = np.ones(len(known)), 1.0
    for _ in range(50):
        w, b = back(forward(w, b))
        top = float(np.sqrt((w**2).sum() + b * b))
        w, b = w / top, b / top
    step = 1 / (0.25 * 1.05 * top + l2)
    w, b = np.zeros(len(known)), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        gw, gb = back(1 / (1 + np.exp(-np.clip(forward(v, c), -35, 35))) - y)
        w2, b2 = v - step * (gw + l2 * v), c - step * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    weights = np.zeros(SLOTS, np.float32)
    weights[known] = w
    return weights, b


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", train_rows: int = TRAIN_ROWS, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """(weight of each slot, intercept) from a small table of URLs and labels (1: block); rows of null labels are left out.

    At most train_rows rows, in the order of a hash of the URL, come to the driver.  Without both labels the
    score is the smoothed share of blocked rows.
    """
    host, path = host_and_path(F.col(url_col))
    known = labelled.filter(F.col(label_col).isNotNull()).select(F.col(url_col).alias("u"), host.alias("h"), path.alias("p"), (F.col(label_col) > 0).cast("int").alias("y"))
    rows = known.orderBy(F.xxhash64("u"), "u", "y").limit(train_rows).collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(SLOTS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    row, slot = features([r["h"] for r in rows], [r["p"] for r in rows])
    return fit(row, slot, y, l2)


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: list[tuple[str, str]] = RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, host, path, rule, verdict and score (0 to 1, higher: block likelier) of every URL.

    The verdict is that of the rule, and without one "block" where score >= threshold, else "allow".
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed size
    host, path = host_and_path(F.col(url_col))
    kept = F.struct(*keep)
    parsed = pages.select(kept.alias("kept"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            z = np.full(len(hosts), intercept)
            ends = np.cumsum([len(h) + len(p) + 4 for h, p in zip(hosts, paths, strict=True)])
            lo = 0
            while lo < len(hosts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_CHARS, "right")))
                row, slot = features(hosts[lo:hi], paths[lo:hi])
                z[lo:hi] += np.bincount(row, weights[slot], hi - lo)
                lo = hi
            score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], ["kept", "host", "path", "score"])

    scored = parsed.mapInArrow(run, f"kept {parsed.schema['kept'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("kept.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
