"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score from its words, and the document's score is the
noisy-or of them: ``1 - prod(1 - p)``.  Only document labels are needed to train; the sentence scores then say where the
offending sentences are.

The model is fitted with numpy on at most ``FIT_ROWS`` labelled documents of at most ``FIT_BYTES`` hashed words.  Spark
keeps these and finds the words that tell most about the label; only those, and a mark for each sentence without one at
its start, travel to the driver.  Toxic documents are few, so the likelihood weighs both classes alike; one labelled
document in CALIBRATE stays out of the fit and sets the scale, so that 0.5 is the score that parts toxic from clean
documents best while at least CLEAN_KEPT of the clean ones stay below it.  The scale is an exponent on ``prod(1 - p)``: the
document's score stays the noisy-or of its sentences'.  Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import few_tasks, hash_ranges, remove_dir, slices, stored

FIT_ROWS = 12_000  #: labelled documents that the model is fitted on at most, those with the smallest hash of doc_id
FIT_BYTES = 96 << 20  #: their packed words at most; later documents in the order of the hash are left out beyond it
CALIBRATE = 5  #: one of so many of them sets the scale
CLEAN_KEPT = 0.95
SLOTS = 1 << 18  #: words are hashed to so many weights
MIN_GAIN = 12.0  #: log-likelihood gain from which a word becomes a feature
ROUNDS = 200
DECAY = 2e-5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_NEW = np.uint32(1 << 31)  #: marks the first word of a sentence in a packed bag
_NO_WORD = np.uint32(SLOTS)  #: stands for a first word that ``thinned`` left out


@dataclass(frozen=True)
class Model:
    """``slots`` (sorted) have ``weights``; every sentence starts from ``bias``; ``power`` is the exponent of the scale."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    power: float = 1.0

    def table(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float64)
        out[self.slots] = self.weights
        return out


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts as hashed slots.

    Returns slot and sentence of each word, the text and the byte range (within the lower-cased buffer) of each
    sentence that has a word.  A word is a run of letters or bytes outside ASCII; ``.``, ``!``, ``?`` and line ends close
    a sentence.
    """
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n" * 9, np.uint8)
    live = _LETTER[buf]
    edge = np.flatnonzero(live[1:] != live[:-1]) + 1
    if live[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    slot = (hash_ranges(buf, start, end) & np.uint64(SLOTS - 1)).astype(np.int64)
    mark = np.searchsorted(np.flatnonzero(_STOP[buf]), start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = mark[1:] != mark[:-1]
    sentence = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(start)) - 1 if len(head) else head
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begins, start[head], side="right") - 1
    return slot, sentence, text, start[head] - begins[text], end[tail] - begins[text]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def noisy_or(total: np.ndarray) -> np.ndarray:
    """From the sum of softplus(z) over a bag's sentences, which is -log prod(1 - p)."""
    return -np.expm1(-total)


def score_texts(texts: list[bytes], table: np.ndarray, bias: float, power: float = 1.0) -> np.ndarray:
    slot, sentence, text, _, _ = split(texts)
    z = bias + np.bincount(sentence, table[slot], len(text))
    return noisy_or(power * np.bincount(text, softplus(z), len(texts)))


def pack(text: bytes) -> bytes:
    slot, sentence, _, _, _ = split([text])
    out = slot.astype(np.uint32)
    fresh = np.ones(len(slot), bool)
    fresh[1:] = sentence[1:] != sentence[:-1]
    return (out | np.where(fresh, _NEW, np.uint32(0))).tobytes()


def weights_of(labels: np.ndarray) -> np.ndarray:
    """What each document counts in the likelihood: both labels weigh half."""
    toxic, n = labels.sum(), len(labels)
    return np.where(labels > 0, 0.5 / max(toxic, 1), 0.5 / max(n - toxic, 1))


def slot_counts(bags: Iterable[bytes | pa.Buffer], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot how many of the bags hold it, and how many toxic ones."""
    all_, pos = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for bag, label in zip(bags, labels, strict=True):  # bag by bag, so that memory holds little more than the bags
        seen = np.unique(np.frombuffer(bag, np.uint32) & ~_NEW)
        all_[seen] += 1
        pos[seen] += label
    return all_[:SLOTS], pos[:SLOTS]


def telling(all_: np.ndarray, pos: np.ndarray, n: int, toxic: float) -> np.ndarray:
    """Whether slots that ``all_`` of n documents hold, ``pos`` of the toxic ones, tell enough about the label."""

    def gain(k, m):  # log-likelihood of k toxic in m documents, at their own rate
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(k / m)) + np.nan_to_num((m - k) * np.log1p(-k / m))

    return 2 * (gain(pos, all_) + gain(toxic - pos, n - all_) - gain(toxic, n)) >= MIN_GAIN


def thinned(bag: bytes | pa.Buffer, chosen: np.ndarray) -> bytes:
    """A packed bag with the words of the chosen slots (one flag a slot) and a mark for each sentence that begins with none."""
    words = np.frombuffer(bag, np.uint32)
    told, first = chosen[words & ~_NEW], words & _NEW
    return np.where(told, words, first | _NO_WORD)[told | (first != 0)].tobytes()


def train(bags: list[bytes], labels: np.ndarray) -> Model:
    """Fits packed bags to 0/1 labels by full-batch Adam on the weighted likelihood, with a small weight decay.

    Features are the slots whose presence in a document tells most about its label; bags ``thinned`` to these give the
    same model.  Without a toxic or without a clean document, or without a telling word, the model is constant at the
    labels' mean over bags with words.
    """
    labels = np.asarray(labels, np.float64)
    sentences = np.array([np.count_nonzero(np.frombuffer(bag, np.uint32) & _NEW) for bag in bags], np.int64)
    of = np.repeat(np.arange(len(bags)), sentences)
    n, toxic = max(len(labels), 1), float(labels.sum())
    none = np.zeros(0, np.int64)
    chosen = np.flatnonzero(telling(*slot_counts(bags, labels), n, toxic))
    if not len(of) or not 0 < toxic < n or not len(chosen):
        rate = min(max(toxic / n, 1e-9), 1 - 1e-9)
        per = max(len(of) / n, 1.0)
        return Model(none, np.zeros(0), float(np.log(np.expm1(-np.log1p(-rate) / per))))
    at = np.full(SLOTS + 1, -1)
    at[chosen] = np.arange(len(chosen))
    features, rows = [none], [none]
    for bag, first in zip(bags, (np.cumsum(sentences) - sentences).tolist(), strict=True):
        words = np.frombuffer(bag, np.uint32)
        found = at[words & ~_NEW]
        held = found >= 0
        features.append(found[held])
        rows.append((np.cumsum((words & _NEW) != 0) - 1 + first)[held])
    feature, row = np.concatenate(features), np.concatenate(rows)
    del features, rows
    w, b = np.zeros(len(chosen)), np.log(np.expm1(np.log(2) / (len(of) / n)))
    counts = weights_of(labels)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, w[feature], len(of))  # changed in place: there are as many as sentences
        z += b
        total = np.bincount(of, softplus(z), len(labels))
        slope = counts * ((1 - labels) - labels / np.clip(np.expm1(np.minimum(total, 700)), 1e-6, None))  # of the loss, by the bag's total
        np.exp(np.negative(np.maximum(z, -700, out=z), out=z), out=z)
        z += 1
        g = slope[of]
        g /= z
        step = np.append(np.bincount(feature, g[row], len(chosen)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step * step
        move = 0.1 * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def total_of(bag: bytes, table: np.ndarray, bias: float) -> float:
    """The sum of softplus(z) over a packed bag's sentences."""
    words = np.frombuffer(bag, np.uint32)
    if not len(words):
        return 0.0
    return float(softplus(bias + np.bincount(np.cumsum((words & _NEW) != 0) - 1, table[words & ~_NEW])).sum())


def calibrated(model: Model, bags: list[bytes], labels: np.ndarray) -> Model:
    """``model`` with the power that puts 0.5 where documents outside the fit are parted best.

    That is the threshold with the largest difference between the shares of toxic and of clean documents above it, among
    those that leave CLEAN_KEPT of the clean ones below.  Where a label is missing the power stays.
    """
    labels = np.asarray(labels, np.float64)
    toxic, clean = labels.sum(), (1 - labels).sum()
    if not toxic or not clean or not len(model.slots):
        return model
    table = np.append(model.table(), 0.0)  # of _NO_WORD
    totals = np.array([total_of(bag, table, model.bias) for bag in bags])
    order = np.argsort(-totals, kind="stable")
    ranked = totals[order]
    caught, lost = np.cumsum(labels[order]) / toxic, np.cumsum(1 - labels[order]) / clean
    whole = np.append(ranked[1:] < ranked[:-1], True)  # equal totals fall on one side
    able = np.flatnonzero(whole & (lost <= 1 - CLEAN_KEPT) & (caught > lost))
    edge = ranked[0] * 2 if not len(able) else ranked[(best := able[np.argmax((caught - lost)[able])])]
    if len(able) and best + 1 < len(ranked):
        edge = np.sqrt(max(edge, 1e-12) * max(ranked[best + 1], 1e-12))
    return Model(model.slots, model.weights, model.bias, float(np.log(2) / max(edge, 1e-12)))


def parted(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bags are fitted, all but every CALIBRATE-th, and which calibrate, those; all where the ones in question lack a label."""
    last = np.arange(len(labels)) % CALIBRATE == CALIBRATE - 1
    mixed = lambda mask: 0 < labels[mask].sum() < mask.sum()
    every = np.ones(len(labels), bool)
    return ~last if mixed(~last) else every, last if mixed(last) else every


def train_calibrated(bags: list[bytes], labels: np.ndarray) -> Model:
    """``train`` and ``calibrated`` on the bags that are ``parted`` for each."""
    labels = np.asarray(labels)
    fitted, judged = parted(labels)
    of = lambda mask: [bag for bag, m in zip(bags, mask, strict=True) if m]
    return calibrated(train(of(fitted), labels[fitted]), of(judged), labels[judged])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents.

    ``labels`` has doc_id and toxic (0 or 1; other values and nulls don't count).  The rows used are those whose doc_id
    has the smallest hash, at most ``rows`` of them and FIT_BYTES of words, so the sample is bounded and the same at every
    run.  Of documents that share a doc_id one is used, that with the smallest packed words.
    """
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([pack(t) for t in texts], pa.binary())], ["doc_id", "toxic", "bag"])

    packed = found.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, toxic int, bag binary")
    one = packed.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("bag").alias("bag"))  # at most ``rows``
    kept, folder = stored(few_tasks(one, rows), "fit")
    sizes = kept.select("doc_id", "toxic", F.crc32("bag").alias("crc"), F.length("bag").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    # in an order of bags that doesn't depend on how Spark delivered them
    got = sizes.withColumn("before", before).where(F.col("before") <= FIT_BYTES).orderBy("crc", "toxic", F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic").toArrow()
    doc_ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    chosen = chosen_slots(kept, doc_ids, toxic)
    bags = thinned_bags(kept, doc_ids, chosen)
    remove_dir(docs.sparkSession, folder)
    return train_calibrated(bags, toxic)


def chosen_slots(kept: DataFrame, doc_ids: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The slots that tell enough about the labels ``toxic`` of the documents ``doc_ids`` that are fitted, ascending; their bags are in ``kept``."""
    fitted = parted(toxic)[0]
    mine, n, positive = np.sort(doc_ids[fitted]), max(int(fitted.sum()), 1), float(toxic[fitted].sum())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(np.isin(batch.column("doc_id").to_numpy(), mine))
            all_, pos = slot_counts((batch.column("bag")[i].as_buffer() for i in at.tolist()), batch.column("toxic").to_numpy()[at])
            seen = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(all_[seen]), pa.array(pos[seen])], ["slot", "n", "k"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = telling(batch.column("n").to_numpy(), batch.column("k").to_numpy(), n, positive)
            yield pa.RecordBatch.from_arrays([batch.column("slot").filter(pa.array(told))], ["slot"])

    counts = kept.mapInArrow(count, "slot bigint, n double, k double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return np.sort(few_tasks(counts, SLOTS).mapInArrow(choose, "slot bigint").toArrow()["slot"].to_numpy())


def thinned_bags(kept: DataFrame, doc_ids: np.ndarray, chosen: np.ndarray) -> list[bytes]:
    """The bags of ``doc_ids`` in ``kept``, thinned to the chosen slots, in the order of doc_ids."""
    order = np.argsort(doc_ids)
    ranked = doc_ids[order]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SLOTS, bool)
        flags[chosen] = True
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy()
            at = np.flatnonzero(np.isin(doc_id, ranked))
            bags = pa.array([thinned(batch.column("bag")[i].as_buffer(), flags) for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(order[np.searchsorted(ranked, doc_id[at])]), bags], ["place", "bag"])

    got = kept.mapInArrow(thin, "place bigint, bag binary").toArrow()
    bags = got["bag"].to_pylist()
    return [bags[i] for i in np.argsort(got["place"].to_numpy())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score for each row of ``docs``; a null or empty text scores 0.

    held_out tells whether crc32 of doc_id as text is divisible by 5 (false for a null doc_id).  Repeated rows each give
    a row; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score_texts(texts, table, model.bias, model.power), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences whose own score is at least ``least``: doc_id, byte range from first to last word, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part, texts in slices(batches):
            slot, sentence, text, begin, end = split(texts)
            p = noisy_or(model.power * softplus(model.bias + np.bincount(sentence, table[slot], len(text))))
            hit = np.flatnonzero(p >= least)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text[hit])), pa.array(begin[hit], pa.int64()), pa.array(end[hit], pa.int64()), pa.array(p[hit])], ["doc_id", "start_byte", "end_byte", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start_byte bigint, end_byte bigint, score double")


def predict(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), rows)
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns stay as they are.

    The model is the one of ``predict``.  Scores are computed beside the rows, so nothing is joined.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part, texts in slices(batches):
            yield part.filter(pa.array(score_texts(texts, table, model.bias, model.power) < 0.5))

    return docs.mapInArrow(run, docs.schema)
