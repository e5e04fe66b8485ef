"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is a logistic model on hashed words, trained in numpy on confirmed toxic texts and
unlabelled texts. With class prior p, positive loss L+ and negative loss L-, the risk is

    p * mean(L+ on positives) + max(0, mean(L- on unlabelled) - p * mean(L- on positives)),

so that toxic texts among the unlabelled ones do not count as clean, and a negative part that would
fall below zero, a sign of overfitting, is clipped there.

Training is on a bounded sample: at most ``max_positive`` and ``max_unlabelled`` texts, those with the
smallest hashes of their ids. Their features stay on the executors: Spark counts the texts of each
place, and the ``max_places`` places whose shares among positive and unlabelled texts differ most
(largest two-sample z, of equals the smaller place) are learnt. Only values at learnt places go to the
driver, 12 bytes each, so at most 12 * max_places * (max_positive + max_unlabelled) bytes, however
long the texts are. Scoring covers every row and the whole text, inside the tasks, with the weights
broadcast (``2**bits`` floats).

Features of a text are its words (ASCII-lower-cased, cut at every ASCII character that is no letter
or digit) and their grams of five bytes, hashed to ``2**bits`` places; the value is the count divided
by the number of words, times the place's inverse document frequency in the sample. Labels, language,
source and id are no features.

Score 0.5 lies at the cut that makes the same risk with the 0/1 loss smallest on the sample,
p * (share of positives below) + max(0, share of unlabelled above - p * share of positives above);
of equal cuts the smallest is taken, so more texts are found.

Defined cases: null texts count as empty, an empty text gets the score of the bias alone; texts of any
length are scored as a whole. Rows whose label is null are unlabelled. Repeated rows get equal scores;
of rows that share an id the smallest text is the sampled one. Without any confirmed toxic text there
is nothing to learn from and all scores are 0. An empty table gives no rows. A column that has the
name of the score is replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraspark.llm.common import list_array, materialise, slices, text_bytes
from contraspark.llm.words import LOWER, PUNCTUATION, mix, split_words

BITS = 17
#: Bytes of a gram; a word's border counts as one.
GRAM = 5
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
#: Hashed places that get a weight.
MAX_PLACES = 2048


@dataclass
class Features:
    """Sparse rows: place[start[i]:start[i + 1]] and the values there."""

    place: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - size), size)
        return self.place[at], self.value[at], np.repeat(np.arange(len(rows)), size)


def features(column: pa.Array, bits: int = BITS) -> Features:
    raw, offsets = text_bytes(column)
    # A separator in front of every text and at the end, so that no word or gram spans two texts.
    body = np.insert(LOWER[raw], np.append(offsets[:-1], len(raw)), 32)
    first = offsets + np.arange(len(offsets))
    gap = PUNCTUATION[body]
    body[gap] = 32
    n = len(body) - GRAM + 1
    if n <= 0:
        return Features(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(column) + 1, np.int64))
    inner = np.zeros(n, bool)
    hashed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + body[k : k + n]
        if 0 < k < GRAM - 1:
            inner |= gap[k : k + n]
    at = np.flatnonzero(~inner)
    words = split_words(column, lower=True, separators=PUNCTUATION)
    row = np.concatenate([np.searchsorted(first, at, "right") - 1, words.document()])
    place = np.concatenate([mix(hashed[at]), words.hash]) >> np.uint64(64 - bits)
    key, count = np.unique((row << bits) | place.astype(np.int64), return_counts=True)
    row = key >> bits
    value = count / np.maximum(1, np.diff(words.first))[row]
    return Features((key & ((1 << bits) - 1)).astype(np.int32), value.astype(np.float32), np.searchsorted(row, np.arange(len(column) + 1)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _least_risk(out: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The cut of least risk with the 0/1 loss (see above): texts at or above it are called toxic."""
    of_pos, of_unl = np.sort(out[positive]), np.sort(out[~positive])
    cuts = np.unique(out)
    found = 1 - np.searchsorted(of_pos, cuts) / max(1, len(of_pos))
    called = 1 - np.searchsorted(of_unl, cuts) / max(1, len(of_unl))
    risk = prior * (1 - found) + np.maximum(0, called - prior * found)
    return float(cuts[np.argmin(risk)])


def fit_nnpu(data: Features, positive: np.ndarray, prior: float, places: int, epochs: int = 16, batch: int = 1024, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``places`` places and bias by Adam on the clipped risk, averaged over the later half of the steps."""
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    weight = np.append(np.zeros(places), np.log(prior / (1 - prior)))  # the bias comes last
    first, second, total = np.zeros(len(weight)), np.zeros(len(weight)), np.zeros(len(weight))
    step = averaged = 0
    for epoch in range(epochs if len(unl) else 0):
        order = rng.permutation(unl)
        for u in np.array_split(order, max(1, len(order) // batch)):
            p = rng.choice(pos, min(len(pos), batch), replace=False)
            rows = np.concatenate([p, u])
            place, value, of = data.take(rows)
            out = np.bincount(of, weight[place] * value, len(rows)) + weight[-1]
            prob, is_p = _sigmoid(out), np.arange(len(rows)) < len(p)
            loss = np.log1p(np.exp(-np.abs(out))) + np.maximum(out, 0)  # L-
            grad = np.where(is_p, prior * (prob - 1) / len(p), 0.0)  # of the positive part
            if loss[~is_p].mean() - prior * loss[is_p].mean() >= 0:  # else the negative part is clipped at zero
                grad += np.where(is_p, -prior * prob / len(p), prob / len(u))
            whole = np.append(np.bincount(place, grad[of] * value, places) + decay * weight[:-1], grad.sum())
            step += 1
            first = 0.9 * first + 0.1 * whole
            second = 0.999 * second + 0.001 * whole * whole
            weight -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs // 2:
                total, averaged = total + weight, averaged + 1
    weight = total / averaged if averaged else weight
    if len(unl):
        place, value, of = data.take(np.arange(len(positive)))
        weight[-1] = -_least_risk(np.bincount(of, weight[place] * value, len(positive)), positive, prior)
    return weight[:-1], float(weight[-1])


def _sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, DataFrame]:
    """Ids of the sampled positives and of the unlabelled sample, which stands for all rows, smallest hashes first."""
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    return first(ids.join(toxic, "doc_id", "left_semi"), max_positive), first(ids, max_unlabelled)


def _telling_places(sample: DataFrame, texts: dict[bool, int], max_places: int) -> tuple[np.ndarray, np.ndarray]:
    """The places to learn, rising, and their inverse document frequencies; counted in Spark, ``max_places`` rows come back."""
    counts = sample.select("positive", F.explode("place").alias("place")).groupBy("place").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    n, m = texts.get(True, 0), texts.get(False, 0)
    share = (F.col("p") + F.col("u")) / F.lit(n + m)
    apart = F.abs(F.col("p") / F.lit(max(n, 1)) - F.col("u") / F.lit(max(m, 1)))
    z = apart / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)))  # times the same factor for all places
    rows = counts.where("p + u > 1").select("place", (F.col("p") + F.col("u")).alias("found"), z.alias("z")).orderBy(F.desc("z"), "place").limit(max_places).orderBy("place").collect()
    place, found = np.array([r["place"] for r in rows], np.int64), np.array([r["found"] for r in rows], np.float64)
    return place, np.log((n + m + 1) / (found + 1))


def train(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_places: int = MAX_PLACES, bits: int = BITS,
) -> tuple[np.ndarray, float]:
    """Fit on ``docs`` (doc_id, text) with the confirmed cases in ``labels`` (doc_id, toxic).

    Without a given class prior, the share of toxic among the labelled rows is taken.
    """
    if prior is None:
        mean = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(max(mean or 0.0, 0.01), 0.9)
    chosen = _sample(docs, labels, max_positive, max_unlabelled)
    # Both id lists are bounded by the parameters, so they may be broadcast; only sampled texts are shuffled.
    ids = chosen[0].withColumn("positive", F.lit(True)).union(chosen[1].withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = features(batch.column(2), bits)
            yield pa.record_batch([batch.column(0), batch.column(1), list_array(found.place, found.start), list_array(found.value, found.start)], ["doc_id", "positive", "place", "value"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    sample = materialise(rows.mapInArrow(extract, f"doc_id {id_kind}, positive boolean, place array<int>, value array<float>"), "toxic-sample")
    texts = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    weights = np.zeros(1 << bits, np.float32)
    if not texts.get(True):
        return weights, -np.inf
    places, scale = _telling_places(sample, texts, max_places)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << bits, -1, np.int32)
        column[places] = np.arange(len(places))
        for batch in batches:
            place, row = column[batch.column(2).flatten().to_numpy()], np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            own = place >= 0
            value = batch.column(3).flatten().to_numpy()[own] * scale[place[own]].astype(np.float32)
            start = np.searchsorted(row[own], np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column(0), batch.column(1), list_array(place[own], start), list_array(value, start)], ["doc_id", "positive", "place", "value"])

    # Rows come in any order; a fixed one makes the fit the same each time.
    table = sample.mapInArrow(keep, sample.schema).toArrow().sort_by([("positive", "descending"), ("doc_id", "ascending")]).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(column("place")).to_numpy())]).astype(np.int64)
    data = Features(column("place").flatten().to_numpy(), column("value").flatten().to_numpy(), start)
    weight, bias = fit_nnpu(data, column("positive").to_numpy(zero_copy_only=False), prior, len(places))
    weights[places] = weight * scale
    return weights, bias


def score(docs: DataFrame, weights: tuple[np.ndarray, float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, in the last column; a column named ``out_col`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        bits = len(weight).bit_length() - 1
        for batch in slices(batches, text_col):
            found = features(batch.column(batch.schema.get_field_index(text_col)), bits)
            of = np.repeat(np.arange(batch.num_rows), np.diff(found.start))
            value = _sigmoid(np.bincount(of, weight[found.place].astype(float) * found.value, batch.num_rows) + bias) if np.isfinite(bias) else np.zeros(batch.num_rows)
            kept = [c for c in batch.schema.names if c != out_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(value)], [*kept, out_col])

    return docs.mapInArrow(run, T.StructType([*[f for f in docs.schema.fields if f.name != out_col], T.StructField(out_col, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, trained on the rows that are not held out."""
    fold = ~held_out()
    weights = train(docs.where(fold), labels.where(fold), **params)
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
