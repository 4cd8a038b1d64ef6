"""Operator 1: quality by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text.  A text
is compressed with each, and the normalised difference of the two sizes is turned
into a calibrated score by a logistic function fitted on other labelled rows.

Defined results: a null or empty text has differences of zero and gets the score
of such a text; a row with a null ``doc_id`` is scored and never held out; equal
texts get equal scores; without labels of both classes every score is the share
of label 1 (0.5 if there are none); other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, Logistic, distinct_sample, map_batches


@dataclass(frozen=True)
class Params:
    """Bounds of what is learnt from; scoring covers all rows and whole texts."""

    per_class: int = 3000  # labelled rows of each class, at most
    pieces: int = 4000  # pieces of text that a dictionary is trained on, at most
    piece: int = 1024  # bytes of a piece
    dict_bytes: int = 65536
    level: int = 3
    window: int = 4096  # bytes compressed at once when scoring
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    calibrated: Logistic
    params: Params

    def features(self, texts: list[str | None]) -> np.ndarray:
        return _features(_compressors(self.good, self.bad, self.params.level), texts, self.params.window)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.calibrated(self.features(texts)) if texts else np.zeros(0)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of very few samples, their bytes as they are."""
    if sum(map(len, samples)) > 4 * size and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # the trainer refuses samples that are too much alike
    return b"".join(samples)[-size:]


def _compressors(good: bytes, bad: bytes, level: int) -> tuple:
    frame = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0, write_checksum=0)
    made = []
    for content in (good, bad):
        trained = content[:4] == b"\x37\xa4\x30\xec"
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        made.append(zstandard.ZstdCompressor(compression_params=frame, **({"dict_data": zstandard.ZstdCompressionDict(content, dict_type=kind)} if content else {})))
    return tuple(made)


def _features(compressors: tuple, texts: list[str | None], window: int) -> np.ndarray:
    good, bad = (c.compress for c in compressors)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = [raw[k : k + window] for k in range(0, len(raw), window)]
        g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
        if parts:
            d = (b - g) / (b + g)
            out[i] = d, d * np.log1p(len(raw)) / 8, max(-8.0, min(8.0, (b - g) / 16))
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, params: Params = Params()) -> Model:
    """Learn from at most ``per_class`` rows of each class for which ``train`` holds."""
    shares = labels.where(train).where(F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if shares is None else float(shares)
    rows = distinct_sample(docs, labels, "quality", train, params.per_class)
    size = params.piece

    def pieces():
        def of(batch):
            out = {"y": [], "part": [], "piece": []}
            for y, part, t in zip(*(batch[c].to_pylist() for c in ("y", "part", "text")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for k in range(0, len(raw), size):
                    for c, v in zip(out, (y, part, raw[k : k + size]), strict=True):
                        out[c].append(v)
            return out

        return of

    cutup = map_batches(rows.select("y", "part", "text"), pieces, "y int, part int, piece binary")
    sample = {y: cutup.where(F.col("y") == y).orderBy(F.xxhash64("piece"), "piece", "part").limit(params.pieces).collect() for y in (0, 1)}

    def learnt(without: int | None) -> tuple[bytes, bytes]:
        return tuple(dictionary([bytes(r.piece) for r in sample[y] if r.part != without], params.dict_bytes) for y in (1, 0))

    # A row's differences are measured with dictionaries that other folds gave.
    apart = [learnt(part) for part in range(FOLDS)]
    level, window = params.level, params.window

    def measured():
        made = [_compressors(*d, level) for d in apart]

        def of(batch):
            f = [_features(made[p], [t], window)[0].tolist() for p, t in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            return {"y": batch["y"], "f": f}

        return of

    got = map_batches(rows.select("y", "part", "text"), measured, "y int, f array<double>").collect()
    x = np.array([r.f for r in got]).reshape(-1, 3)
    return Model(*learnt(None), Logistic(x, np.array([r.y for r in got]), prior), params)


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The input's rows with ``score`` and ``predicted`` (1: good enough) added, by the
    names ``into``; columns of the input with these names go."""
    keep = [c for c in docs.columns if c not in into]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{into[0]}` double, `{into[1]}` int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dict_bytes each

    def make():
        m = shared.value
        made = _compressors(m.good, m.bad, m.params.level)

        def of(batch):
            s = m.calibrated(_features(made, batch[text].to_pylist(), m.params.window)) if batch.num_rows else np.zeros(0)
            return {c: batch[c] for c in keep} | dict(zip(into, (s, (s >= m.params.threshold).astype("int32")), strict=True))

        return of

    return map_batches(docs.select(*keep), make, schema)
