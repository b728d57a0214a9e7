"""Quality scores by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built, from text labelled good and from text
labelled bad. A text is cut into blocks, every block is compressed under
either dictionary, and the difference of the compressed sizes over their sum
is the text's evidence: text like the good sample shrinks more under the good
dictionary. A logistic curve, fitted on labelled documents that took no part
in the dictionaries, turns evidence into a probability of label 1.

The sample is bounded: the ``docs_per_label`` labelled documents of each
label least by hash of the id, ``pieces_per_doc`` pieces of ``piece_bytes`` evenly
spread over each for the dictionaries. Every third of them calibrates instead.
All documents are scored over their whole texts, in partitions.

Defined cases: null and empty text has no evidence and gets the curve's value
at 0; labels other than 0 and 1 are ignored, repeated labels of a document
count as often; without labelled rows of both kinds every score is the share of
label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import broadcast_if_small, held_out, learnable, least_by_hash

#: Bounds of the training sample.
DOCS_PER_LABEL, PIECES_PER_DOC, PIECE_BYTES = 1200, 4, 1024
DICTIONARY_BYTES, LEVEL, BLOCK_BYTES = 65_536, 3, 2048


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def learnable_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return learnable(F.col(id_col), 3, 1)


def held_out_rows(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; not those with a null doc_id."""
    return held_out(F.col(id_col), 3, 1)


def pieces(data: bytes, count: int, length: int) -> list[bytes]:
    count = min(count, -(-len(data) // length))
    return [data[len(data) * k // count:][:length] for k in range(count)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of a sample too small or too uniform to train on, its text."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Scorer:
    def __init__(self, model: Model):
        def compressor(d: bytes):
            own = zstandard.ZstdCompressionDict(d) if d else None
            if own is not None:
                own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress

        self.good, self.bad, self.model = compressor(model.good), compressor(model.bad), model

    def evidence(self, text: str | None) -> float:
        data = (text or "").encode()
        good = bad = 0
        for k in range(0, len(data), BLOCK_BYTES):
            block = data[k:k + BLOCK_BYTES]
            good += len(self.good(block))
            bad += len(self.bad(block))
        return (bad - good) / (bad + good) if data else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * self.evidence(text) + self.model.offset, -500, 500))))


def calibrate(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by damped Newton steps; slightly ridged."""
    scale = max(float(np.std(evidence)), 1e-6)
    x = np.stack([evidence / scale, np.ones(len(evidence))], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-12)[:, None]).T @ x + ridge,
                               x.T @ (weight * (label - p)) - ridge @ w)
        w += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, docs_per_label: int = DOCS_PER_LABEL, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks; pass only rows that may be learned from."""
    marks = labels.where(F.col(label_col).isin(0, 1)) \
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    # the sample is chosen by id, so that only its texts move
    chosen = least_by_hash(marks, "label", "id", docs_per_label)
    shares = {r["label"]: r["n"] for r in
              marks.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "k": pdf["k"],
                                "pieces": [pieces(t.encode(), PIECES_PER_DOC, PIECE_BYTES) for t in pdf["text"]]})

    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "")
              .join(broadcast_if_small(chosen, 4 * DOCS_PER_LABEL), "id").select("label", "k", "text")
              .mapInPandas(cut, "label int, k int, pieces array<binary>").toPandas().sort_values(["label", "k"]))
    total = sum(shares.values())
    share = min(max(shares.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
    if sample["label"].nunique() < 2:
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    held = sample["k"] % 3 == 0
    if sample[held]["label"].nunique() < 2:  # too few documents to set some apart
        held[:] = True
    built = sample if held.all() else sample[~held]
    parts = {y: [bytes(p) for ps in built.loc[built["label"] == y, "pieces"] for p in ps] for y in (0, 1)}
    scorer = Scorer(Model(dictionary(parts[1]), dictionary(parts[0]), 0.0, 0.0))
    rest = sample[held]
    evidence = np.array([scorer.evidence(b"".join(map(bytes, ps)).decode(errors="ignore")) for ps in rest["pieces"]])
    label = rest["label"].to_numpy(float)
    weight = np.where(label == 1, share / label.sum(), (1 - share) / (1 - label).sum())
    slope, offset = calibrate(evidence, label, weight)
    return Model(scorer.model.good, scorer.model.bad, slope, offset)


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [scorer.score(t) for t in pdf["text"]]})

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(_score(model), "doc_id long, score double"))
