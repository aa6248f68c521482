"""URL filters: domain and path rules, then logistic regression on hashed character n-grams.

The classifier is fitted on a small labelled table of URLs (below; a parameter), whose held-out
accuracy `cross_validated` gives. Features are
the 3- to 5-byte grams of the host and of the path, with marks at either end, hashed to
2**BITS weights; a gram counts once for each time it occurs, over the square root of the number
of grams. A rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule (host and path together) wins over the classifier.

Cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged
by the classifier's bias; URLs of any length are read whole; rules of equal length go by their
order; rows are independent, so repeated rows give repeated results and an empty table none;
input columns that have the names of outputs are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.secrets import slices

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled table: hosts and paths about a topic, labelled by hand by the topic. A site about
#: gambling, pharmacies, adult content, piracy, phishing, lending or link spam is blocked.
BLOCKED = "casino poker jackpot betting slots viagra cialis pills pharma porn xxx sexcam escort nude warez keygen torrent crack serials phishing malware trojan payday loans richquick replica backlinks spam linkfarm clickbait".split()
ALLOWED = "library museum weather recipes garden physics history football travel music university science health novels kernel python forecast theatre opera farming chemistry astronomy cycling knitting railway archive gallery bakery orchestra wildlife".split()
TEMPLATES = (("{0}.example.com", "/en/{1}"), ("www.{0}-site.example.net", "/{0}/index.html"), ("m.my{0}.example.org", "/fr/{1}/"), ("blog.example.net", "/posts/{0}"))
BITS, SIZES, ROUNDS, RATE, DECAY = 16, (3, 4, 5), 300, 1.0, 1e-3
#: Probability from which a URL is blocked: hosts that say nothing come out near a half.
CUT = 0.65

LABELLED = tuple((host.format(w, 7 * i), path.format(w, 7 * i), label) for label, words in ((1, BLOCKED), (0, ALLOWED)) for i, w in enumerate(words) for host, path in TEMPLATES)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all grams; hosts and paths are marked by different end bytes."""
    texts = [b"\x02" + t.encode() + b"\x03" for t in hosts] + [b"\x04" + t.encode() + b"\x05" for t in paths]
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)) % max(1, len(hosts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    kind = np.repeat(np.arange(len(texts)) >= len(hosts), sizes)
    rows, slots = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64) + kind[:m].astype(np.uint64) * np.uint64(77)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = (h ^ data[j : j + m]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            h *= np.uint64(0x9E3779B97F4A7C15)
        inside = np.arange(m) + n <= ends[:m]
        rows.append(owner[:m][inside])
        slots.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, slot = np.concatenate(rows), np.concatenate(slots)
    per = np.bincount(row, minlength=max(1, len(hosts)))
    return row, slot, 1.0 / np.sqrt(per[row])


def probabilities(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    row, slot, value = features(hosts, paths)
    z = bias + np.bincount(row, weights[slot] * value, len(hosts))[: len(hosts)]
    return 1.0 / (1.0 + np.exp(-z))


@functools.cache
def fit(labelled: tuple[tuple[str, str, int], ...] = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the mean log loss with weight decay."""
    hosts, paths, y = [r[0] for r in labelled], [r[1] for r in labelled], np.array([r[2] for r in labelled], float)
    row, slot, value = features(hosts, paths)
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        z = bias + np.bincount(row, weights[slot] * value, len(y))
        error = 1.0 / (1.0 + np.exp(-z)) - y
        weights -= RATE * (np.bincount(slot, error[row] * value, 1 << BITS) / len(y) * 8 + DECAY * weights)
        bias -= RATE * error.mean()
    return weights, bias


def cross_validated(labelled: tuple[tuple[str, str, int], ...] = LABELLED, folds: int = 5) -> float:
    """The share of labelled URLs told rightly by a model fitted on the other folds."""
    right = 0
    for k in range(folds):
        model = fit(tuple(r for i, r in enumerate(labelled) if i % folds != k))
        held = [r for i, r in enumerate(labelled) if i % folds == k]
        found = probabilities(*model, [r[0] for r in held], [r[1] for r in held])
        right += sum((p >= CUT) == bool(r[2]) for p, r in zip(found, held, strict=True))
    return right / len(labelled)


def judge(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, labelled=LABELLED, cut: float = CUT) -> DataFrame:
    """keep, host, path, rule, verdict and score (the classifier's probability of a block)."""
    own = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in keep if c not in own]
    host, path = host_and_path(F.col(url).cast("string"))
    source = pages.select(*kept, host.alias("host"), path.alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(schema.names) - 1
        for batch in slices(slices(batches, "path", limit=1 << 20), "host", limit=1 << 20):
            p = probabilities(*shared.value, batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=schema.names)

    scored = source.mapInArrow(run, schema)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
