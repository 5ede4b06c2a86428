"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

The chain has two states, clean and toxic, over a text's words. A word's emission is the sum of the weights of its
features: the word, its beginnings of a few lengths, and a bias; transitions are a 2 x 2 matrix. Token labels are
derived from the labelled documents: in a toxic document, words with a feature that occurs in toxic documents far
more often than in clean ones are toxic; all other words are clean. Weights are fitted on a bounded sample of labelled documents; every document is scored whole,
with exact forward-backward marginals. The marginals give offending spans, and through a logistic
calibration on (expected toxic words, greatest marginal and its log odds) the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: The sample: labelled documents of each label at most, and characters of one.
SAMPLE, SAMPLE_CHARS = 2500, 50_000
#: Bits of the feature table, and bytes of a word's beginnings that are features too (of longer words only).
WORD_BITS, STARTS = 18, (7, 9)
#: Words of a training segment, segments at most, the share of them kept for segments without toxic words, rounds of the fit.
SEGMENT, SEGMENTS, CLEAN_SHARE, ROUNDS = 32, 12_000, 0.4, 60
#: A word is toxic in a toxic document from this ratio of document frequencies and so many documents on.
RATIO, LEAST_DOCS = 20.0, 3
#: Texts of the sample that are hashed, counted or tagged at once.
PART = 100
THRESHOLD, SLICE_BYTES = 0.7, 2 << 20


@dataclass
class Field:
    """Emissions of the toxic state (the clean one has 0), transitions from row to column, and the calibration."""

    emission: np.ndarray
    bias: float
    transition: np.ndarray
    calibration: np.ndarray

    def emissions(self, words: np.ndarray) -> np.ndarray:
        """Of each word, from its features."""
        return self.emission[words].sum(1) + self.bias

    def marginals(self, e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; texts are chains of their own. Forward and backward odds, all texts of the batch abreast."""
        (t00, t01), (t10, t11) = np.exp(self.transition)
        odds = np.exp(np.clip(e, -30, 30))
        counts = np.diff(bounds)
        order = np.argsort(-counts, kind="stable")
        first, counts = bounds[:-1][order], counts[order]
        active = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")  # texts of more than t words
        forward, backward = np.empty(len(e)), np.ones(len(e))
        r = None
        for t, k in enumerate(active.tolist()):
            at = first[:k] + t
            r = odds[at] if t == 0 else odds[at] * (t01 + t11 * r[:k]) / (t00 + t10 * r[:k])
            forward[at] = r
        q = np.ones(len(counts))
        for t in range(len(active) - 2, -1, -1):
            k = active[t + 1]
            x = odds[first[:k] + t + 1] * q[:k]
            q[:k] = (t10 + t11 * x) / (t00 + t01 * x)
            backward[first[:k] + t] = q[:k]
        x = forward * backward
        return x / (1 + x)

    def score(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = summaries(p, bounds) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def summaries(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, log of 1 + expected toxic words, greatest marginal, and its log odds beyond even."""
    sums = np.concatenate([[0], np.cumsum(p)])
    greatest = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        greatest[full] = np.maximum.reduceat(p, bounds[:-1][full])
    most = np.clip(greatest, 0.5, 1 - 1e-6)
    return np.stack([np.ones(len(greatest)), np.log1p(np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], 0)), greatest, np.log(most / (1 - most)) / 4], 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table places of the features of the words of all texts (a row for each word; a place that no word lacks a feature for is the last), their byte starts and ends, and the bounds of each text's words."""
    data, offsets = common.text_bytes(texts)
    data = windows.LOWER[data]
    starts, ends, bounds = windows.spans(data, offsets, windows.ALPHANUMERIC)
    out = np.full((len(starts), 1 + len(STARTS)), 1 << WORD_BITS, np.int32)
    out[:, 0] = windows.word_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)
    for k, n in enumerate(STARTS, 1):
        on = np.flatnonzero(ends - starts > n)
        out[on, k] = windows.mixed(windows.word_hashes(data, starts[on], starts[on] + n) + np.uint64(n)) >> np.uint64(64 - WORD_BITS)
    return out, starts, ends, bounds


def sample_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words of all texts, and the bounds of each text's words; a few texts at a time, as hashing takes many bytes a character."""
    words, counts = [np.zeros((0, 1 + len(STARTS)), np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(texts), PART):
        own, _, _, bounds = words_of(pa.array(texts[k : k + PART], pa.string()))
        words.append(own)
        counts.append(np.diff(bounds))
    return np.concatenate(words), np.cumsum(np.concatenate(counts))


def in_parts(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Texts, words and bounds (from 0) of a few texts at a time."""
    for k in range(0, len(bounds) - 1, PART):
        part = bounds[k : k + PART + 1]
        yield slice(k, k + len(part) - 1), slice(int(part[0]), int(part[-1])), part - part[0]


def token_labels(words: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the words, from how much more often their features occur in toxic documents."""
    size = (1 << WORD_BITS) + 1
    has, all_ = np.zeros(size), np.zeros(size)
    for texts, own, part in in_parts(words, bounds):
        pairs = np.unique((np.repeat(np.arange(len(part) - 1), np.diff(part)) * size)[:, None] + words[own])
        cell, label = pairs % size, toxic[texts][pairs // size]
        has += np.bincount(cell, weights=label, minlength=size)
        all_ += np.bincount(cell, minlength=size)
    ratio = ((has + 0.5) / (toxic.sum() + 1)) / ((all_ - has + 0.5) / ((1 - toxic).sum() + 1))
    telling = (ratio >= RATIO) & (has >= LEAST_DOCS)
    telling[-1] = False
    return (telling[words].any(1) & np.repeat(toxic > 0, np.diff(bounds))).astype(np.int8)


def segments(labels: np.ndarray, bounds: np.ndarray, most: int, clean_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of at most `most` runs of words, by hash; of them a share is kept for runs without toxic words, as far as there are so many."""
    pieces = -(-np.diff(bounds) // SEGMENT)
    starts = np.repeat(bounds[:-1], pieces) + windows.ragged(pieces) * SEGMENT
    stops = np.minimum(starts + SEGMENT, np.repeat(bounds[1:], pieces))
    told = np.concatenate([[0], np.cumsum(labels, dtype=np.int64)])
    rich = told[stops] - told[starts] > 0
    order = np.argsort(windows.mixed(starts.astype(np.uint64)), kind="stable")
    some, others = order[rich[order]], order[~rich[order]]
    some = some[: max(most - len(others), int(most * (1 - clean_share)))]
    order = np.concatenate([some, others[: most - len(some)]])
    return starts[order], stops[order]


def fit(texts: list[str], toxic: np.ndarray, prior: float, most: int = SEGMENTS, clean_share: float = CLEAN_SHARE) -> Field:
    """Weights of the chain by gradient ascent on the segments' likelihood, then the calibration; prior: P(toxic) of labelled documents."""
    toxic = toxic.astype(np.float64)
    words, bounds = sample_words(texts)
    labels = token_labels(words, bounds, toxic)
    starts, stops = segments(labels, bounds, most, clean_share)
    n, features = stops - starts, words.shape[1]
    used = np.arange(SEGMENT) < n[:, None]
    at = np.where(used, starts[:, None] + np.arange(SEGMENT), 0)
    x, y = (words[at], labels[at]) if len(words) else (np.zeros((0, SEGMENT, features), np.int32), np.zeros((0, SEGMENT), np.int64))
    table, cells = np.unique(x, return_inverse=True)
    cells = cells.reshape(x.shape).astype(np.int32)
    w, transition = np.zeros(len(table) + 1), np.zeros((2, 2))  # the last weight is the bias
    steps = [np.zeros(len(w)), np.zeros(len(w)), np.zeros((2, 2)), np.zeros((2, 2))]
    follows = used[:, 1:]
    seen = np.stack([np.stack([((y[:, :-1] == a) & (y[:, 1:] == b) & follows).sum() for b in (0, 1)]) for a in (0, 1)])
    own = cells[used]

    def summed(value: np.ndarray) -> np.ndarray:
        """Of each weight, the values of the words that have it."""
        return np.append(np.sum([np.bincount(own[:, k], weights=value, minlength=len(table)) for k in range(features)], 0), value.sum())

    gold = summed(y[used])
    for k in range(1, ROUNDS + 1 if len(x) else 1):
        p, pairs = expectations(w[cells].sum(2) + w[-1], transition, used)
        gw = gold - summed(p[used]) - 0.01 * w
        gt = seen - pairs - 0.01 * transition
        for value, g, m, v, rate in ((w, gw, *steps[:2], 0.3), (transition, gt, *steps[2:], 0.05)):  # Adam
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    emission = np.zeros((1 << WORD_BITS) + 1)  # features that the sample lacks say nothing
    emission[table] = np.clip(w[:-1], -12, 12)
    field = Field(emission, float(w[-1]), transition, np.zeros(4))
    s = np.concatenate([np.zeros((0, 4)), *(summaries(field.marginals(field.emissions(words[own]), part), part) for _, own, part in in_parts(words, bounds))])
    share = toxic.mean() if len(toxic) else 0.5
    weight = np.where(toxic > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    field.calibration = logistic(s, toxic, weight)
    return field


def expectations(e: np.ndarray, transition: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word of the segments, and expected numbers of each transition."""
    n, size = e.shape
    t, psi = np.exp(transition), np.exp(np.clip(e, -30, 30))
    alpha, beta = np.ones((n, size, 2)), np.ones((n, size, 2))
    a = np.stack([np.ones(n), psi[:, 0]], 1) if size else np.ones((n, 2))
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for k in range(1, size):
        a = alpha[:, k - 1] @ t
        a[:, 1] *= psi[:, k]
        alpha[:, k] = np.where(used[:, k, None], a / a.sum(1, keepdims=True), alpha[:, k - 1])
    for k in range(size - 2, -1, -1):
        b = beta[:, k + 1].copy()
        b[:, 1] *= psi[:, k + 1]
        b = b @ t.T
        beta[:, k] = np.where(used[:, k + 1, None], b / b.sum(1, keepdims=True), 1.0)
    joint = alpha * beta
    p = joint[:, :, 1] / joint.sum(2)
    pairs = np.zeros((2, 2))
    for k in range(1, size):
        x = alpha[:, k - 1, :, None] * t * (np.stack([np.ones(n), psi[:, k]], 1) * beta[:, k])[:, None, :]
        x = x[used[:, k]]
        pairs += (x / x.sum((1, 2), keepdims=True)).sum(0) if len(x) else 0
    return p, pairs


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps, slightly drawn to 0."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, most: int = SEGMENTS, clean_share: float = CLEAN_SHARE) -> Field:
    """Fitted on at most `sample` labelled documents of each label that aren't held out and have at most `chars` characters, by the least hashes of their ids, and on at most `most` segments of them, of which `clean_share` is kept for segments without toxic words.

    Labels of null id or null value are left out; of several labels of an id the greatest counts, of several texts of an id the least.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rows = common.id_text(docs).filter(F.length("text") <= chars)
    there = known.join(rows.select("doc_id"), "doc_id", "left_semi")
    pick = lambda label: there.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = F.broadcast(pick(1).unionByName(pick(0)))  # 2 * sample ids at most
    found = rows.join(picked, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).orderBy("doc_id").collect()
    texts, toxic = [r.text for r in found], np.array([r.toxic for r in found], np.float64)
    del found
    return fit(texts, toxic, prior, most, clean_share)


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and spans (start and end in code points, greatest marginal) of every row, from its text alone.

    A null or empty text has the score of a text without words, and no spans. Repeated rows stay; a null id stays null.
    """
    own = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE_BYTES):
            scores, spans = scored(part.column("text"), own.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(spans, SPANS)], names=["doc_id", "score", "spans"])

    return common.id_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def scored(texts: pa.Array, field: Field) -> tuple[np.ndarray, list[list[dict]]]:
    words, starts, ends, bounds = words_of(texts)
    p = field.marginals(field.emissions(words), bounds)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    on = np.flatnonzero(p >= 0.5)
    doc = np.searchsorted(bounds, on, "right") - 1
    if len(on):
        data, offsets = common.text_bytes(texts)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for d, w in zip(doc.tolist(), on.tolist(), strict=True):
            base = points[offsets[d]]
            a, b = int(points[starts[w]] - base), int(points[ends[w]] - base)
            if spans[d] and w - 1 == spans[d][-1]["w"]:
                spans[d][-1] |= {"end": b, "p": max(spans[d][-1]["p"], float(p[w])), "w": w}
            else:
                spans[d].append({"start": a, "end": b, "p": float(p[w]), "w": w})
    for s in spans:
        for x in s:
            del x["w"]
    return field.score(p, bounds), spans


def drop_toxic(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    common.small_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(at)
            filled = pa.RecordBatch.from_arrays([texts.fill_null(""), pa.array(np.arange(len(texts)))], names=["text", "n"])
            keep = np.ones(part.num_rows, bool)
            for some in common.slices(iter([filled]), limit=SLICE_BYTES):
                keep[np.asarray(some.column("n"))] = scored(some.column("text"), own.value)[0] < threshold
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
