"""Toxic spans by a linear-chain conditional random field over words.

Only documents are labelled, so tokens get their labels from them: the word features (whole word, beginnings, endings)
that explain most toxic documents and hardly any clean one are picked one after another, each time over the documents
not yet explained; so are features just as precise that stand between ever other words (in copies of a text they don't).
A word of a toxic document with a picked feature is a toxic token, all others are clean. The field
(two states, hashed features of each word, transitions) is fitted to these tokens by gradient steps. Forward-backward
marginals give toxic spans with character offsets; a document's score is a logistic function of its highest marginal.

The fit is one task on a bounded sample of labelled texts: of each label about ``SAMPLE`` documents by a hash of the id, then in
the order of that hash as many whole texts as fit ``SAMPLE_BYTES``; texts longer than ``LONGEST`` bytes are not learned from.
Gradient steps take all chains with toxic tokens and, by a hash, about ``CLEAN_CHAINS`` of the others.

A chain is a sentence, or ``CHAIN`` words of a longer one. Null text and text without words have the lowest score. Labels
other than 0 and 1, and labels without doc_id, teach nothing; of several labels for an id the highest counts, of several
texts one. If no toxic or no clean label is left to learn from, the score of every text is the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import textvec
from tagloom.plans.stages import stage

SAMPLE = 2500
#: Bytes of texts of each label that the fit reads, and of one text among them; a byte costs it about 40 bytes of memory
SAMPLE_BYTES, LONGEST = 1 << 22, 1 << 20
CLEAN_CHAINS = 20_000
CHAIN = 256
BITS = 18
STEPS = 100
#: A picked feature is in at least so many unexplained toxic documents, and this share of the documents it is in is toxic
SUPPORT, PRECISION = 3, 0.8
_BEGINNINGS, _ENDINGS = (3, 4, 5), (3, 4)
_STOP = textvec.separators([(0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)])


class Words:
    """Features, chains and places of the words of some texts."""

    def __init__(self, texts: list[memoryview]) -> None:
        self.buffer, self.begins = textvec.joined(texts)
        _, self.starts, self.ends = textvec.word_spans(self.buffer, textvec.NOT_WORD)
        hashes, self.rows = textvec.words(texts, textvec.NOT_WORD)
        n = len(self.starts)
        lengths = self.ends - self.starts
        high = np.uint64(32)
        features = [(hashes >> high).astype(np.uint32)]
        small = textvec._BYTE[self.buffer]
        for size in _BEGINNINGS:
            part = np.full(n, size, dtype=np.uint64)
            for j in range(size):
                part = part * np.uint64(0x9E3779B97F4A7C15) + np.where(j < lengths, small[np.minimum(self.starts + j, len(small) - 1)], np.uint64(0))
            features.append((textvec.mix(part) >> high).astype(np.uint32))
        for size in _ENDINGS:
            part = np.full(n, 16 + size, dtype=np.uint64)
            for j in range(size):
                part = part * np.uint64(0x9E3779B97F4A7C15) + np.where(j < lengths, small[np.maximum(self.ends - 1 - j, 0)], np.uint64(0))
            features.append((textvec.mix(part) >> high).astype(np.uint32))
        #: words x kinds of feature, 32 bits of a hash each
        self.features = np.stack(features, axis=1)
        stops = np.cumsum(_STOP[self.buffer])
        sentence = stops[self.starts] if n else np.empty(0, dtype=np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (sentence[1:] != sentence[:-1]) | (self.rows[1:] != self.rows[:-1])
        first = np.flatnonzero(new)
        place = np.arange(n) - first[np.cumsum(new) - 1] if n else np.empty(0, dtype=np.int64)
        new |= place % CHAIN == 0
        self.chains = np.flatnonzero(new)  # first word of each

    @property
    def slots(self) -> np.ndarray:
        return (self.features >> np.uint32(32 - BITS)).astype(np.int32)


def marginals(emissions: np.ndarray, chains: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of the toxic state for each word and, with ``pairs``, the expected number of each transition.

    ``emissions``: log-odds of the toxic state alone. All chains advance together, longest first.
    """
    n = len(emissions)
    if not n:
        return np.empty(0), np.zeros((2, 2)) if pairs else None
    lengths = np.diff(np.append(chains, n))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = chains[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    weight = np.exp(transitions - transitions.max())
    up = np.exp(np.clip(emissions, -30, 30))
    forward, backward = np.empty((2, n)), np.empty((2, n))  # scaled so that both states sum to 1
    a0, a1 = np.ones(len(begins)), up[begins]
    for t, m in enumerate(active):
        at = begins[:m] + t
        if t:
            p0, p1 = a0[:m], a1[:m]
            a0, a1 = p0 * weight[0, 0] + p1 * weight[1, 0], (p0 * weight[0, 1] + p1 * weight[1, 1]) * up[at]
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        forward[0, at], forward[1, at] = a0, a1
    b0 = b1 = np.full(active[-1], 0.5)
    for t in range(len(active) - 1, -1, -1):
        m, at = active[t], begins[: active[t]] + t
        if t + 1 < len(active):
            k = active[t + 1]
            ahead = begins[:k] + t + 1
            n0, n1 = b0, b1 * up[ahead]
            c0, c1 = np.full(m, 0.5), np.full(m, 0.5)
            c0[:k], c1[:k] = n0 * weight[0, 0] + n1 * weight[0, 1], n0 * weight[1, 0] + n1 * weight[1, 1]
            total = c0 + c1
            b0, b1 = c0 / total, c1 / total
        backward[0, at], backward[1, at] = b0, b1
    clean, toxic = forward[0] * backward[0], forward[1] * backward[1]
    p = toxic / (clean + toxic)
    if not pairs:
        return p, None
    inner = np.ones(n, dtype=bool)
    inner[chains] = False
    right = np.flatnonzero(inner)
    both = np.empty((2, 2, len(right)))
    for i in (0, 1):
        for j in (0, 1):
            both[i, j] = forward[i, right - 1] * weight[i, j] * (up[right] if j else 1.0) * backward[j, right]
    return p, (both / both.sum(axis=(0, 1))).sum(axis=2)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values in order; ``values`` is sorted in place."""
    values.sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def toxic_tokens(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels, by picking the features that explain the toxic documents."""
    kinds = words.features.shape[1]
    both = (words.features.astype(np.uint64) << np.uint64(32)).reshape(-1)
    both |= np.repeat(words.rows.astype(np.uint64), kinds)
    both = _distinct(both)
    keys, docs = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del both
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    names, feature = keys[new], np.cumsum(new, dtype=np.int32) - 1
    del keys, new
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    clean = np.bincount(feature[~toxic[docs]], minlength=len(names)) * (n_toxic / n_clean)
    on_toxic = toxic[docs]
    feature, docs = feature[on_toxic], docs[on_toxic]
    open_, picked = toxic.copy(), []
    while len(feature):
        found = np.bincount(feature, minlength=len(names)).astype(float)
        found[(found < SUPPORT) | (found < PRECISION * (found + clean + 0.5))] = 0
        best = int(np.argmax(found - clean))
        if not found[best]:
            break
        picked.append(best)
        open_[docs[feature == best]] = False
        left = open_[docs]
        feature, docs = feature[left], docs[left]
    picked = np.union1d(names[picked], _varied(words, toxic, names, clean))
    return np.isin(words.features, picked).any(axis=1) & toxic[words.rows]


def _varied(words: Words, toxic: np.ndarray, names: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Features as precise as the picked ones that stand between ever other words, as those of copied texts don't."""
    around = np.concatenate([words.features[:, 0], np.zeros(2, dtype=np.uint32)]).astype(np.uint64)
    context = textvec.mix(np.roll(around, 1)[:-2] * np.uint64(3) + around[1:-1] * np.uint64(5)) >> np.uint64(32)
    on_toxic = toxic[words.rows]
    kinds = words.features.shape[1]
    feature = np.searchsorted(names, words.features[on_toxic].reshape(-1))

    def different(values: np.ndarray) -> np.ndarray:
        pairs = feature.astype(np.uint64) << np.uint64(32)
        pairs |= np.repeat(values[on_toxic].astype(np.uint64), kinds)
        return np.bincount((_distinct(pairs) >> np.uint64(32)).astype(np.int64), minlength=len(names))

    docs, contexts = different(words.rows), different(context)
    good = (docs >= 2 * SUPPORT) & (docs >= PRECISION * (docs + clean + 0.5)) & (contexts >= 0.5 * docs)
    return names[good]


def _trained(words: Words, labels: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature weights, transitions and bias, by adaptive gradient steps on the chains that ``keep`` names."""
    lengths = np.diff(np.append(words.chains, len(labels)))
    use = np.repeat(keep, lengths)
    slots, y = words.slots[use].T, labels[use].astype(float)
    chains = np.cumsum(lengths[keep]) - lengths[keep]
    taken = np.zeros(1 << BITS, dtype=bool)
    taken[slots] = True
    used = np.flatnonzero(taken)
    local = (np.cumsum(taken, dtype=np.int32) - 1)[slots]  # kinds of feature x words
    weights, speed = np.zeros(len(used)), np.full(len(used), 1e-3)
    transitions, pace = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    bias, bias_pace = -4.0, 1e-3
    inner = np.ones(len(y), dtype=bool)
    inner[chains] = False
    right = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[right - 1].astype(int), y[right].astype(int)), 1)
    n = max(1.0, y.sum())
    for _ in range(STEPS):
        p, pairs = marginals(sum(weights[kind] for kind in local) + bias, chains, transitions, pairs=True)
        gap = (y - p) / n
        slope = sum(np.bincount(kind, gap, minlength=len(used)) for kind in local) - 1e-4 * weights
        speed += slope**2
        weights += 0.5 * slope / np.sqrt(speed)
        turn = (seen - pairs) / n - 1e-3 * transitions
        pace += turn**2
        transitions += 0.2 * turn / np.sqrt(pace)
        lean = gap.sum()
        bias_pace += lean**2
        bias += 0.2 * lean / np.sqrt(bias_pace)
    full = np.zeros(1 << BITS, dtype=np.float32)
    full[used] = weights
    return full, transitions, bias


def _evidence(p: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Log-odds of each row's highest marginal, between -12 and 12."""
    highest = np.zeros(n_rows)
    np.maximum.at(highest, rows, p)
    highest = np.clip(highest, 6e-6, 1 - 6e-6)
    return np.log(highest / (1 - highest))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly damped logistic curve, by Newton steps."""
    w = np.zeros(2)
    design = np.column_stack([x / 4, np.ones_like(x)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 0.05 * w
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), slope)
    return float(w[0] / 4), float(w[1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int32())])).to_pandas()
    rows = rows.sort_values(["text", "toxic"], kind="stable")
    toxic = rows["toxic"].to_numpy() == 1
    words = Words([memoryview(t.encode()) for t in rows["text"]])
    labels = toxic_tokens(words, toxic)
    lengths = np.diff(np.append(words.chains, len(labels)))
    with_toxic = np.add.reduceat(labels, words.chains) > 0 if len(words.chains) else np.empty(0, dtype=bool)
    chance = textvec.mix(words.features[words.chains, 0].astype(np.uint64) ^ lengths.astype(np.uint64)) >> np.uint64(40)
    keep = with_toxic | (chance < (1 << 24) * min(1.0, CLEAN_CHAINS / max(1, len(lengths))))
    weights, transitions, bias = _trained(words, labels, keep)
    p, _ = marginals(sum(weights[kind] for kind in words.slots.T) + bias, words.chains, transitions)
    slope, offset = _logistic(_evidence(p, words.rows, len(rows)), toxic.astype(float))
    numbers = [*transitions.reshape(-1), bias, max(slope, 0.0), offset]
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([numbers], pa.list_(pa.float64()))], ["weights", "numbers"])


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """Field from the labelled documents. The sample is bounded by ``SAMPLE`` and ``SAMPLE_BYTES``; only its ids are broadcast."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    plain = {"share": n1 / (n0 + n1) if n0 + n1 else 0.0}
    if not n0 or not n1:
        return plain
    rate = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / n1)).otherwise(min(1.0, SAMPLE / n0))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) < rate)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= LONGEST)
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    place = F.min(F.xxhash64(F.lit("order"), "doc_id")).alias("place")
    pairs = stage(texts.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"), place), "sample")
    read = F.sum("size").over(Window.partitionBy("toxic").orderBy("place"))  # sizes of the sample only
    sizes = pairs.select("toxic", "place", F.octet_length("text").alias("size")).withColumn("read", read)
    last = {r[0]: r[1] for r in sizes.where(F.col("read") <= SAMPLE_BYTES).groupBy("toxic").agg(F.max("place")).collect()}
    fits = F.col("place") <= F.when(F.col("toxic") == 1, last.get(1)).otherwise(last.get(0))
    pairs = pairs.where(fits).select("text", "toxic")
    found = pairs.repartition(1).mapInArrow(_fit, "weights binary, numbers array<double>").first()
    if found is None:
        return plain
    return {"weights": bytes(found["weights"]), "numbers": list(found["numbers"])}


def scored(documents: DataFrame, model: dict) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, score, and spans [[first character, character after the last]]."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in textvec.pieces(batches, "text", 1 << 20):
            score, spans = _scores(texts, shared.value)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(score), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc_id", "score", "spans"]
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, score double, spans array<array<int>>")


def _scores(texts: list[memoryview], model: dict) -> tuple[np.ndarray, list]:
    if "weights" not in model:
        return np.full(len(texts), model["share"]), [[]] * len(texts)
    weights, numbers = np.frombuffer(model["weights"], dtype=np.float32), model["numbers"]
    words = Words(texts)
    p, _ = marginals(weights[words.slots].sum(axis=1).astype(np.float64) + numbers[4], words.chains, np.array(numbers[:4]).reshape(2, 2))
    score = 1 / (1 + np.exp(-(numbers[5] * _evidence(p, words.rows, len(texts)) + numbers[6])))
    spans: list = [[] for _ in texts]
    last: tuple[int, int] | None = None
    for i in np.flatnonzero(p > 0.5).tolist():
        row = int(words.rows[i])
        start, end = (int(x[i] - words.begins[row]) for x in (words.starts, words.ends))
        if last == (row, i - 1):
            spans[row][-1][1] = end
        else:
            spans[row].append([start, end])
        last = (row, i)
    for row, found in enumerate(spans):
        if found:  # bytes to characters: all bytes but those that continue one
            ahead = np.concatenate([[0], np.cumsum((np.frombuffer(texts[row], dtype=np.uint8) & 0xC0) != 0x80)])
            spans[row] = [[int(ahead[a]), int(ahead[b])] for a, b in found]
    return score, spans


def without_toxic(documents: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score is below ``threshold``, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in textvec.pieces(batches, "text", 1 << 20):
            yield rows.filter(pa.array(_scores(texts, shared.value)[0] < threshold))

    return documents.mapInArrow(run, documents.schema)
