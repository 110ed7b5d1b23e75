"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector holds its byte trigrams (A-Z as a-z, other ASCII but letters as blanks), hashed to ``SIZE`` places,
weighted (1 + log tf) * idf and normalised. idf counts all training texts. Each language has up to ``CENTROIDS``
centroids, clustered by cosine on at most about ``SAMPLE`` of its different texts (chosen by a hash of the text; all of
them, if fewer). A text has the language of the centroid nearest by cosine, and is rejected if that cosine is below
what all but ``TAIL`` of the language's own sample reach, less ``SLACK``.

Null text, or one without a letter: ``und``, score 0. A letter is any of Unicode's. If nothing can be learned, all texts
are ``und``. Rows without doc_id or lang teach nothing; a null doc_id is not held out. Repeated rows are classified alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec

SIZE = 1 << 12
CENTROIDS = 4
SAMPLE = 2000
ROUNDS = 8
TAIL, SLACK = 0.005, 0.02
_ROWS = 256
_RUN = 1 << 22

_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _tallies(texts: list[memoryview]) -> np.ndarray:
    """How often each place's trigrams occur, rows x ``SIZE``. Every text is read between two blanks."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= _RUN):
            total += len(texts[end])
            end += 1
        if end == at + 1 and len(texts[at]) > _RUN:
            parts = [texts[at][max(0, i - 2) : i + _RUN] for i in range(0, len(texts[at]), _RUN)]
            for i, part in enumerate(parts):
                out[at] += _grams([part], 0 if i else 1, 0 if i < len(parts) - 1 else 1)[0]
        else:
            out[at:end] = _grams(texts[at:end], 1, 1)
        at = end
    return out


def _grams(texts: list[memoryview], before: int, after: int) -> np.ndarray:
    buffer = _LETTERS[np.frombuffer(b" " + b"  ".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.array([len(t) for t in texts])
    counts = np.maximum(lengths - 2 + before + after, 0)
    begins = np.cumsum(lengths + 2) - lengths - 1 - before
    which = (buffer[:-2] * np.uint32(0x9E3779B1) + buffer[1:-1] * np.uint32(0x85EBCA77) + buffer[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    rows = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(rows)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return np.bincount(rows * SIZE + which[at], minlength=len(texts) * SIZE).reshape(len(texts), SIZE)


def _vectors(tallies: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.where(tallies > 0, 1 + np.log(np.maximum(tallies, 1)), 0).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows, texts in textvec.pieces(batches, "text"):
        for at in range(0, len(texts), _ROWS):
            yield rows.slice(at, min(_ROWS, len(texts) - at)), _tallies(texts[at : at + _ROWS])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(SIZE, dtype=np.int64), 0
    for rows, tallies in _blocks(batches):
        counts += (tallies > 0).sum(axis=0)
        n += rows.num_rows
    places = pa.array(np.arange(-1, SIZE), pa.int32())
    yield pa.RecordBatch.from_arrays([places, pa.array(np.concatenate([[n], counts]))], ["place", "n"])


def clustered(vectors: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``n`` unit centroids by cosine; seeds are the text nearest the mean and then texts far
    from all seeds (beyond the nearest tenth of what is farthest, so that no odd text is a cluster of its own)."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(n, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        if near.min() > 0.9999:
            break
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // 10]))
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                centre = vectors[own == k].mean(axis=0)
                centroids[k] = centre / max(np.linalg.norm(centre), 1e-9)
    return centroids


def _fit(idf: np.ndarray):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        texts = [memoryview(t.encode()) for t in sample.sort_values("text")["text"]]
        vectors = np.concatenate([_vectors(_tallies(texts[i : i + _ROWS]), idf) for i in range(0, len(texts), _ROWS)])
        centroids = clustered(vectors, CENTROIDS)
        cutoff = float(np.quantile((vectors @ centroids.T).max(axis=1), TAIL)) - SLACK
        return pd.DataFrame({"lang": sample["lang"].iloc[0], "centroid": list(centroids), "cutoff": cutoff})

    return run


def fit(training: DataFrame) -> dict:
    """Centroids of the languages of ``training`` (text, lang): parameters of a size fixed by the number of languages."""
    training = training.where("text is not null and lang is not null").select("text", "lang")
    counts = {r["lang"]: r["count"] for r in training.select("lang", F.xxhash64("text")).distinct().groupBy("lang").count().collect()}
    if not counts:
        return {"langs": [], "idf": np.zeros(SIZE, dtype=np.float32), "centroids": np.zeros((0, SIZE), dtype=np.float32), "cutoffs": np.zeros(0)}
    tallied = training.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = np.zeros(SIZE + 1)
    for r in tallied.collect():
        found[r["place"] + 1] = r["n"]
    idf = np.log((1 + found[0]) / (1 + found[1:])).astype(np.float32) + np.float32(1)
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / n)))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    sample = training.where(chance < rate[F.col("lang")]).distinct()
    rows = sample.groupBy("lang").applyInPandas(_fit(idf), "lang string, centroid array<float>, cutoff double").orderBy("lang").collect()
    return {
        "langs": [r["lang"] for r in rows],
        "idf": idf,
        "centroids": np.array([r["centroid"] for r in rows], dtype=np.float32),
        "cutoffs": np.array([r["cutoff"] for r in rows]),
    }


def classified(documents: DataFrame, model: dict) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, nearest language, its cosine as score, and whether it is rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for rows, tallies in _blocks(batches):
            lettered = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if fitted["langs"]:
                cosines = _vectors(tallies, fitted["idf"]) @ fitted["centroids"].T
                best = cosines.argmax(axis=1)
                score = np.where(lettered, np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1), 0)
                langs = [fitted["langs"][k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                rejected = ~lettered | (score < fitted["cutoffs"][best])
            else:
                score, langs, rejected = np.zeros(len(lettered)), ["und"] * len(lettered), np.ones(len(lettered), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters)
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
