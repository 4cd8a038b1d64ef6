"""Operator 2: toxicity by compression distance.

Two zstandard dictionaries share a stretch of ordinary labelled text; that of the
toxic side also holds the word beginnings that toxic labelled text has far more
often.  Each window of a text is compressed with both; what the toxic dictionary
saves, window by window, is turned into a calibrated score, by a logistic function
fitted across folds.

Defined results: a null or empty text has no saving and gets the score of such a
text; a row with a null ``doc_id`` is scored and never held out; equal texts get
equal scores; without labels of both classes every score is the share of label 1
(0.5 if there are none); other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, WORD, Logistic, distinct_sample, map_batches

_WORDS = re.compile(WORD)


@dataclass(frozen=True)
class Params:
    """Bounds of what is learnt from; scoring covers all rows and whole texts."""

    per_class: int = 4000  # labelled rows of each class, at most
    shortest: int = 5  # characters of a word beginning, its space counted
    longest: int = 12
    support: float = 0.03  # share of the toxic rows that have it
    least: int = 4  # and their number
    evidence: float = 20.0  # log-likelihood ratio of its two shares
    ordinary: int = 8000  # bytes of each dictionary that are ordinary text
    window: int = 96  # bytes
    step: int = 80
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    calibrated: Logistic
    params: Params


def _frame() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(window_log=16, hash_log=14, chain_log=14, min_match=4, strategy=zstandard.STRATEGY_LAZY2, search_log=4, target_length=16, write_content_size=0, write_dict_id=0, write_checksum=0)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
    return zstandard.ZstdCompressor(compression_params=_frame(), **made)


def _features(toxic, ordinary, texts: list[str | None], window: int, step: int) -> np.ndarray:
    """Per text: the largest saving of a window, savings over one byte (log), their
    rate per window, and the number of windows (log)."""
    out = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        raw = " ".join(_WORDS.findall((text or "").lower())).encode("utf-8", "surrogatepass")
        if not raw:
            continue
        raw = b" " + raw + b" "
        saved = [len(ordinary(w)) - len(toxic(w)) for w in (raw[k : k + window] for k in range(0, max(1, len(raw) - (window - step)), step))]
        over = sum(s - 1 for s in saved if s > 1)
        high = sum(s - 2 for s in saved if s > 2)
        out[i] = min(max(saved), 12), math.log1p(over), over / len(saved), math.log(len(saved)), math.log1p(high)
    return out


def _beginnings(text: str, shortest: int, longest: int) -> set[str]:
    """Distinct word beginnings of a text, each after a space; a whole word ends in one."""
    found = set()
    for w in set(_WORDS.findall(text.lower())):
        w = f" {w}"
        found.update(w[:n] for n in range(shortest, min(len(w), longest) + 1))
    return found


def _evidence(a: int, na: int, b: int, nb: int) -> float:
    """Log-likelihood ratio that the shares a / na and b / nb differ."""

    def ll(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    p = (a + b) / (na + nb)
    return 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p)) if 0 < p < 1 else 0.0


def marked(counts: dict[str, tuple[int, int]], nt: int, no: int, params: Params) -> list[str]:
    """The word beginnings for the toxic dictionary: frequent and telling enough, and
    of several that say the same the longest one, as it saves most."""
    told = {g: (a, b, _evidence(a, nt, b, no)) for g, (a, b) in counts.items() if a >= max(params.least, params.support * nt) and a * no > 4 * b * nt}
    told = {g: x for g, x in told.items() if x[2] >= params.evidence}
    kept: list[str] = []
    for g in sorted(told, key=lambda g: (-told[g][2], -len(g), g)):
        if any(q.startswith(g) and told[q][0] >= 0.9 * told[g][0] for q in kept):
            continue  # a longer one is as frequent
        if any(g.startswith(q) and told[q][1] * nt * 20 < told[q][0] * no for q in kept):
            continue  # a shorter one is telling already
        kept.append(g)
    return kept


def fit(docs: DataFrame, labels: DataFrame, train: Column, params: Params = Params()) -> Model:
    """Learn from at most ``per_class`` rows of each class for which ``train`` holds."""
    share = labels.where(train).where(F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = 0.5 if share is None else float(share)
    rows = distinct_sample(docs, labels, "toxic", train, params.per_class)
    shortest, longest = params.shortest, params.longest

    def counted():
        def of(batch):
            seen: dict[tuple[int, int], Counter] = {(y, p): Counter() for y in (0, 1) for p in range(FOLDS)}
            for y, p, t in zip(*(batch[c].to_pylist() for c in ("y", "part", "text")), strict=True):
                seen[y, p].update(_beginnings(t, shortest, longest))
            grams = list(set().union(*seen.values()))
            return {"g": grams} | {f"n{y}{p}": [c[g] for g in grams] for (y, p), c in seen.items()}

        return of

    sizes = {(r.y, r.part): r.n for r in rows.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    numbers = {y: np.array([sizes.get((y, p), 0) for p in range(FOLDS)]) for y in (0, 1)}
    nt, no = int(numbers[1].sum()), int(numbers[0].sum())
    names = [f"n{y}{p}" for y in (0, 1) for p in range(FOLDS)]
    counts = map_batches(rows, counted, "g string, " + ", ".join(f"{n} long" for n in names)).groupBy("g").agg(*[F.sum(n).alias(n) for n in names])
    toxic, plain = (sum(F.col(f"n{y}{p}") for p in range(FOLDS)) for y in (1, 0))
    # Also frequent enough without any fold; a few hundred rows.
    found = counts.where((toxic >= max(params.least, params.support * nt) * (FOLDS - 1) / FOLDS) & (toxic * no > plain * (3 * nt))).collect() if nt and no else []
    tallies = {r.g: np.array([[r[f"n{y}{p}"] for p in range(FOLDS)] for y in (1, 0)]) for r in found}
    at = "1 + pmod(xxhash64(text), greatest(1, length(text) - 64))"
    some = rows.where("y = 0").selectExpr(f"substring(lower(text), {at}, 64) AS t", "xxhash64(text) AS h")
    base = " ".join(r.t for r in some.orderBy("h", "t").limit(params.ordinary // 64).collect()).encode("utf-8", "surrogatepass")[: params.ordinary]

    def learnt(without: int | None) -> bytes:
        """The toxic dictionary. Entries go before the ordinary text: it then stands at
        the same distance in both."""
        use = [p != without for p in range(FOLDS)]
        t, o = int(numbers[1][use].sum()), int(numbers[0][use].sum())
        entries = marked({g: tuple(int(n) for n in c[:, use].sum(1)) for g, c in tallies.items()}, t, o, params) if t and o else []
        return "".join(reversed(entries)).encode("utf-8", "surrogatepass") + b" " + base

    apart = [learnt(part) for part in range(FOLDS)]
    window, step = params.window, params.step

    def measured():
        made, o = [_compressor(d).compress for d in apart], _compressor(base).compress

        def of(batch):
            f = [_features(made[p], o, [t], window, step)[0].tolist() for p, t in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            return {"y": batch["y"], "f": f}

        return of

    got = map_batches(rows.select("y", "part", "text"), measured, "y int, f array<double>").collect()
    x = np.array([r.f for r in got]).reshape(-1, 5)
    y = np.array([r.y for r in got])
    calibrated = Logistic(x, y, prior, ridge=1e-4)
    calibrated.set_threshold(x, y, params.threshold)
    return Model(learnt(None), base, calibrated, params)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input's rows with ``score`` and ``predicted`` (1: toxic) added."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, bounded by the parameters

    def make():
        m = shared.value
        t, o = _compressor(m.toxic).compress, _compressor(m.ordinary).compress

        def of(batch):
            s = m.calibrated(_features(t, o, batch[text].to_pylist(), m.params.window, m.params.step)) if batch.num_rows else np.zeros(0)
            return {c: batch[c] for c in keep} | {"score": s, "predicted": (s >= m.params.threshold).astype("int32")}

        return of

    return map_batches(docs.select(*keep), make, schema)
