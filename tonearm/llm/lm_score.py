"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

Count tables of words and word pairs are partitioned by hash; each batch's distinct n-grams are joined with them through the
packed exchange, and the scores of a document's n-grams are summed."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batch, Sizes, answered, corpus_batches, dealt, grouped, pack, pack_sorted, parts_of, rows_of, unpack, unpack_sorted
from .common import arrow_limits, released, saved
from .text import U, chunks, mix, word_hashes

#: Factor of a step from pairs to words, and what an unseen word counts as.
BACKOFF, UNSEEN = 0.4, 0.5

REQUESTS = "part int, batch long, keys binary, counts binary"
ANSWERS = "batch long, part int, answer binary"
SCORES = "doc_id long, n_words long, n_pairs_seen long, score double, mean_score double"


def ngrams(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words, keys of the pairs (of each word with the one before it in its text), and words before each text."""
    parts, counts = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for a, b in chunks(batch.offsets, 1 << 19):
        some, first = word_hashes(batch.data[batch.offsets[a] : batch.offsets[b]], batch.offsets[a : b + 1] - batch.offsets[a])
        parts.append(some)
        counts.append(np.diff(first))
    hashes, first = np.concatenate(parts), np.cumsum(np.concatenate(counts))
    words = mix(hashes, 11)
    pairs = mix(hashes[:-1] * U(0x9E3779B97F4A7C15) + mix(hashes[1:], 13), 12) if len(hashes) else hashes
    return words, pairs, first


def _inside(first: np.ndarray) -> np.ndarray:
    """Places of words that have a word before them in their text."""
    has = np.ones(int(first[-1]), bool)
    has[first[:-1][np.diff(first) > 0]] = False
    return np.flatnonzero(has)


def _requests(partitions: int):
    def run(batches):
        for row in rows_of(batches):
            words, pairs, first = ngrams(Batch.of(row))
            at = _inside(first)
            keys, counts = np.unique(np.concatenate((words, pairs[at - 1])), return_counts=True)
            some = parts_of(keys, partitions)
            yield pa.record_batch([pa.array([p for p, _, _ in some], pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([pack_sorted(keys[x:y]) for _, x, y in some], pa.binary()), pa.array([pack(counts[x:y].astype(U)) for _, x, y in some], pa.binary())], ["part", "batch", "keys", "counts"])

    return run


def _totals(batches):
    """Rows sorted by part: each request's keys answered with their counts over all batches."""
    for part, rows in grouped(batches, "part"):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        counts = np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64)
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)[at]
        cut = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        yield pa.record_batch([pa.array([r["batch"] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([pack(total[a:b].astype(U)) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["batch", "part", "answer"])


def _own_counts(key: np.ndarray, text: np.ndarray, keys: int) -> np.ndarray:
    """How often each n-gram stands in its own text."""
    _, at, n = np.unique(text * max(1, keys) + key, return_inverse=True, return_counts=True)
    return n[at]


def score_batch(batch: Batch, totals: np.ndarray, corpus: int):
    """n_words, seen pairs and summed natural logarithm of each text; `totals` are counts of the batch's sorted keys."""
    words, pairs, first = ngrams(batch)
    at = _inside(first)
    keys, place = np.unique(np.concatenate((words, pairs[at - 1])), return_inverse=True)
    n = len(words)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    word = totals[place[:n]] - _own_counts(place[:n], text, len(keys))
    pair = totals[place[n:]] - _own_counts(place[n:], text[at], len(keys))
    others = np.maximum(corpus - sizes, 1)[text]
    chance = np.where(word > 0, word, UNSEEN) / others
    chance[at] *= BACKOFF
    seen = pair > 0
    chance[at[seen]] = pair[seen] / word[at[seen] - 1]
    seen_n = np.bincount(text[at[seen]], minlength=len(sizes))
    return sizes, seen_n, np.bincount(text, np.log(chance), len(sizes))


def _scores(corpus: int):
    def run(batches):
        answers: list = []
        for row in rows_of(batches):
            if row["texts"] is None:
                answers.append(unpack(row["answer"]).astype(np.int64))
                continue
            own = Batch.of(row)
            totals = np.concatenate(answers) if answers else np.zeros(0, np.int64)
            answers = []
            sizes, seen, score = score_batch(own, totals, corpus)
            mean = np.divide(score, sizes, out=np.zeros(len(sizes)), where=sizes > 0)
            yield pa.record_batch([pa.array(own.ids, pa.int64()), pa.array(sizes), pa.array(seen.astype(np.int64)), pa.array(score), pa.array(mean, mask=sizes == 0)], ["doc_id", "n_words", "n_pairs_seen", "score", "mean_score"])

    return run


def _words(batches):
    for row in rows_of(batches):
        yield pa.record_batch([pa.array([int(ngrams(Batch.of(row))[2][-1])], pa.int64())], ["n"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_pairs_seen, score and mean_score.

    Words are runs of bytes other than space and 9 to 13, A-Z lower-cased. Counts are those of all rows but the scored one
    (a copy of it counts as another). A word after a seen pair has chance count(pair) / count(word before); after an unseen
    one BACKOFF * count(word) / words of the others; the first word of a text has count(word) / words of the others; an
    unseen word counts as UNSEEN. score is the sum of natural logarithms, mean_score that over n_words: 0 and null for a
    text without words, null included. Null and repeated ids are rows like others; an empty table gives no rows."""
    spark = docs.sparkSession
    arrow_limits(spark)
    batches = corpus_batches(docs, id_col, text_col)
    sizes = Sizes(batches)
    corpus = batches.mapInArrow(_words, "n long").agg(F.sum("n")).first()[0] or 0
    requests = batches.mapInArrow(_requests(sizes.parts), REQUESTS)
    answers = saved(dealt(requests, sizes.tasks).mapInArrow(_totals, ANSWERS), "answers", {"compression": "none"})
    del requests  # so that its shuffle files can go
    released(spark)
    return answered(batches, answers, sizes.tasks).mapInArrow(_scores(corpus), SCORES)
