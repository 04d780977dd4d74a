"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes,
calibrated scores and evidence."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, small_table
from .text import SIGNS, U, chunks, text_bytes, word_hashes

#: The bound of the sample that is learnt from: examples of a class, and bytes of the longest text that may be one.
EXAMPLES, EXAMPLE_BYTES = 2000, 1 << 16
#: A word is a dimension if two examples, whatever their labels, and at least this share of all documents have it. So the
#: space has no more dimensions at any size of the corpus.
FLOOR = 0.002
#: Powers of the inverse document frequency, and votes of so many nearest examples. The power is chosen on folds of the
#: examples, each scored by the others: the one of least logarithmic loss.
POWERS, RADII, FOLDS = (1.0, 1.5, 2.0), (25, 50, 100, 200, 400), 10
#: Examples of a block; the commonest dimensions, so many at most, are dense rows if this share of the examples has them;
#: texts scored at once.
BLOCK, ROWS, DENSE, TEXTS = 64, 1024, 0.05, 128
EVIDENCE = 11
THRESHOLD = 0.7


def held_out(doc_id):
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _bags(batches):
    """doc_id, toxic, and the hashes and counts of the distinct words."""
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        for a, b in chunks(at):
            hashes, first = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], SIGNS)
            bags = [np.unique(hashes[x:y], return_counts=True) for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a), pa.array([h.tobytes() for h, _ in bags], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in bags], pa.binary())], ["doc_id", "toxic", "words", "counts"])


class Space:
    """The dimensions: sorted word hashes and their inverse document frequencies."""

    def __init__(self, words: np.ndarray, idf: np.ndarray):
        self.words, self.idf = words, idf

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Dimension of each word, -1 for words outside the space."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def counts(self, data: np.ndarray, offsets: np.ndarray):
        """(text, dimension, count) of the words in the space, sorted by text."""
        hashes, first = word_hashes(data, offsets, SIGNS)
        dims = self.find(hashes)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[dims >= 0]
        key, n = np.unique(text * max(1, len(self.words)) + dims[dims >= 0], return_counts=True)
        return key // max(1, len(self.words)), key % max(1, len(self.words)), n

    def bag_counts(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        """The same from bags of (word hashes, counts)."""
        found = [self.find(h) for h, _ in bags]
        text = np.repeat(np.arange(len(bags)), [int((d >= 0).sum()) for d in found])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return text, join([d[d >= 0] for d in found], np.int64), join([n[d >= 0] for d, (_, n) in zip(found, bags, strict=True)], float)

    def weights(self, text: np.ndarray, dim: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        """(1 + ln tf) idf, each text scaled to length one."""
        w = (1 + np.log(n)) * self.idf[dim]
        length = np.sqrt(np.bincount(text, w * w, texts))
        return w / np.maximum(length, 1e-300)[text]


class BlockMaxIndex:
    """The examples by dimension, cut into blocks of BLOCK, with each block's largest weights. Examples are ordered by their
    commonest dimensions, so that a block holds like ones and its bounds are tight; then by their words, never by a name.
    Dimensions that many examples have are rows of a matrix, the others lists of postings."""

    def __init__(self, space: Space, bags: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, toxic: np.ndarray):
        self.space, n = space, len(bags)
        text, dim, count = space.bag_counts(bags)
        w = space.weights(text, dim, count, n)
        words = np.array([zlib.crc32(h.tobytes()) for h, _ in bags], np.int64)
        order = np.lexsort((dim, space.idf[dim], text))
        start = np.searchsorted(text, np.arange(n + 1))
        common = [np.where(start[:-1] + k < start[1:], dim[order[np.minimum(start[:-1] + k, max(len(dim) - 1, 0))]] if len(dim) else -1, -1) for k in range(3)]
        place = np.lexsort((words, *common[::-1]))
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)
        self.order, self.names, self.toxic, self.examples = place, names[place], toxic[place], n
        self.blocks = max(1, -(-n // BLOCK))
        self.width = self.blocks * BLOCK
        text = rank[text]
        has = np.bincount(dim, minlength=len(space.words))
        self.row = np.full(len(space.words), -1)
        frequent = np.sort(np.argsort(-has, kind="stable")[: min(ROWS, int((has >= max(DENSE * n, 1)).sum()))])
        self.row[frequent] = np.arange(len(frequent))
        on = self.row[dim] >= 0 if len(dim) else np.zeros(0, bool)
        self.dense = np.zeros((len(frequent), self.width))
        self.dense[self.row[dim[on]], text[on]] = w[on]
        self.most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(2)
        order = np.lexsort((text[~on], dim[~on]))
        self.text, self.weight = text[~on][order], w[~on][order]
        self.start = np.searchsorted(dim[~on][order], np.arange(len(space.words) + 1))

    def _rare(self, text, dim, w, texts: int) -> np.ndarray:
        """The part of the cosines that comes from lists of postings: a row for each text."""
        start, size = self.start[dim], self.start[dim + 1] - self.start[dim]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        cell = np.repeat(text, size) * self.width + self.text[at]
        return np.bincount(cell, self.weight[at] * np.repeat(w, size), texts * self.width).astype(float).reshape(texts, self.width)

    def cosines(self, text: np.ndarray, dim: np.ndarray, w: np.ndarray, texts: int, k: int | None) -> np.ndarray:
        """Cosine of each text with each example, -1 in blocks that can't hold one of its `k` nearest: the blocks of highest
        bound that hold `k` examples come first, then those whose bound reaches the k-th best so far. Without `k` all."""
        row = self.row[dim]
        own = np.zeros((texts, len(self.dense)))
        own[text[row >= 0], row[row >= 0]] = w[row >= 0]
        out = self._rare(text[row < 0], dim[row < 0], w[row < 0], texts)
        if k is None or k >= self.examples:
            out += own @ self.dense
            out[:, self.examples :] = -1
            return out
        bound = own @ self.most + out.reshape(texts, self.blocks, BLOCK).max(2)
        done = np.zeros((texts, self.blocks), bool)
        first = min(self.blocks, -(-k // BLOCK) + 1)
        some = np.zeros_like(done)
        np.put_along_axis(some, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, 1)
        for _ in range(2):
            for b in np.flatnonzero(some.any(0)):
                who = np.flatnonzero(some[:, b])
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                out[who, part] += (own if len(who) == texts else own[who]) @ self.dense[:, part]
            done |= some
            seen = np.where(np.repeat(done, BLOCK, 1), out, -1.0)
            seen[:, self.examples :] = -1
            some = ~done & (bound >= np.partition(seen, -k, axis=1)[:, -k][:, None] - 1e-9)
        return seen

    def nearest(self, text: np.ndarray, dim: np.ndarray, w: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The `k` examples of highest cosine for each text, or all if they are fewer, ties by place: places and cosines, best
        first."""
        k = min(k, self.examples)
        at, best = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
        cut = np.searchsorted(text, np.arange(0, texts + TEXTS, TEXTS))
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            n = min(TEXTS, texts - i * TEXTS)
            got = ordered(self.cosines(text[a:b] - i * TEXTS, dim[a:b], w[a:b], n, k)[:, : self.examples], k)
            at.append(got[0])
            best.append(got[1])
        return np.concatenate(at), np.concatenate(best)


def ordered(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the `k` largest of each row, best first, ties by place. Values count to ten digits, so that the
    order of summation doesn't decide."""
    value = np.round(cosines, 10)
    key = np.arange(value.shape[1]) * 1e-15 - value
    at = np.argpartition(key, k - 1, axis=1)[:, :k] if k < value.shape[1] else np.broadcast_to(np.arange(value.shape[1]), value.shape)
    at = np.take_along_axis(at, np.argsort(np.take_along_axis(key, at, 1), axis=1, kind="stable"), 1)
    return at, np.maximum(np.take_along_axis(value, at, 1), 0.0)


def votes(toxic: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """For each of RADII: the share of the nearest examples' cosines that toxic ones have, between -1 and 1; 0 without any."""
    total, signed = np.cumsum(cosine, 1), np.cumsum(cosine * (2 * toxic[at] - 1), 1)
    out = np.zeros((len(at), len(RADII)))
    if at.shape[1]:
        for i, k in enumerate(RADII):
            last = min(k, at.shape[1]) - 1
            out[:, i] = signed[:, last] / (total[:, last] + 0.1)
    return out


def calibrated(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve through (votes, label), by weighted Newton steps with a slight ridge."""
    x = np.hstack((x, np.ones((len(x), 1))))
    beta = np.zeros(x.shape[1])
    weight = weight / max(weight.mean(), 1e-12) if len(weight) else weight
    for _ in range(50):
        p = chance(x, beta)
        gradient = x.T @ (weight * (toxic - p)) - 0.05 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def chance(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


class Model:
    def __init__(self, index: BlockMaxIndex, beta: np.ndarray):
        self.index, self.beta = index, beta

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, and places and cosines of its nearest examples."""
        texts = len(offsets) - 1
        space = self.index.space
        text, dim, n = space.counts(data, offsets)
        at, cosine = self.index.nearest(text, dim, space.weights(text, dim, n, texts), texts, max(RADII))
        found = votes(self.index.toxic, at, cosine)
        return chance(np.hstack((found, np.ones((texts, 1)))), self.beta), at, cosine


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most EXAMPLES labelled rows of each class outside the held-out fold, taken by hash of their id; the
    document frequencies come from all of `docs`. The power and the curve come from votes on folds of the examples, each cast
    by the examples outside the fold alone. The driver holds the sample's words and their counts."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = known.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    population = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES).select("doc_id").distinct()
    able = known.join(short, "doc_id", "left_semi").withColumn("u", F.xxhash64("doc_id"))
    chosen = None
    for c in (0, 1):
        some = able.where(F.col("toxic") == c).orderBy("u", "doc_id").limit(EXAMPLES).select("doc_id", "toxic")
        chosen = some if chosen is None else chosen.union(some)
    picked = small_table(spark, [tuple(r) for r in chosen.collect()], pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32())]))
    rows = docs.join(F.broadcast(picked), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES).select("doc_id", "toxic", "text").mapInArrow(_bags, "doc_id long, toxic int, words binary, counts binary").collect()
    rows.sort(key=lambda r: (bytes(r.words), bytes(r.counts), -r.toxic, r.doc_id))
    rows = list({(bytes(r.words), bytes(r.counts)): r for r in reversed(rows)}.values())[::-1]  # copies tell nothing new
    bags = [(np.frombuffer(bytes(r.words), U), np.frombuffer(bytes(r.counts), np.int32).astype(float)) for r in rows]
    names, toxic = np.array([r.doc_id for r in rows], np.int64), np.array([r.toxic for r in rows], np.int64)
    words, having = np.unique(np.concatenate([h for h, _ in bags] or [np.zeros(0, U)]), return_counts=True)
    words = words[having > 1]
    total, frequency = document_frequencies(docs, words)
    common = frequency >= max(1.0, FLOOR * total)
    words, idf = words[common], np.log((1 + total) / frequency[common])
    taken = np.bincount(toxic, minlength=2)
    weight = np.array([population.get(int(c), 0) / max(1, taken[c]) for c in toxic])
    best = None
    for power in POWERS:
        index = BlockMaxIndex(Space(words, idf**power), bags, names, toxic)
        x = _fold_votes(index, bags)
        beta = calibrated(x, toxic, weight)
        p = chance(np.hstack((x, np.ones((len(x), 1)))), beta)
        loss = float(-(weight @ np.log(np.where(toxic == 1, p, 1 - p))))
        if best is None or loss < best[0]:  # the others' indexes go
            best = loss, index, beta
    return Model(*best[1:])


def _fold_votes(index: BlockMaxIndex, bags) -> np.ndarray:
    """Votes on each example by the examples of other folds."""
    fold = np.array([zlib.crc32(h.tobytes()) % FOLDS for h, _ in bags], np.int64)
    by_place = fold[index.order]
    text, dim, n = index.space.bag_counts(bags)
    w = index.space.weights(text, dim, n, len(bags))
    out = [np.zeros((0, len(RADII)))]
    cut = np.searchsorted(text, np.arange(0, len(bags) + TEXTS, TEXTS))
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own = fold[i * TEXTS : (i + 1) * TEXTS]
        got = index.cosines(text[a:b] - i * TEXTS, dim[a:b], w[a:b], len(own), None)[:, : index.examples]
        got[own[:, None] == by_place[None, :]] = -1
        out.append(votes(index.toxic, *ordered(got, min(max(RADII), index.examples))))
    return np.concatenate(out)


def document_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each of the sorted words, over all of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def counted(batches):
        own = Space(sent.value, np.zeros(0))
        seen, n = np.zeros(len(own.words), np.int64), 0
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            n += batch.num_rows
            for a, b in chunks(at):
                _, dim, _ = own.counts(data[at[a] : at[b]], at[a : b + 1] - at[a])
                seen += np.bincount(dim, minlength=len(seen)).astype(np.int64)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.concatenate(([-1], some))), pa.array(np.concatenate(([n], seen[some])))], ["dim", "n"])

    rows = docs.select("text").mapInArrow(counted, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    dim, n = rows["dim"].to_numpy(), rows["n"].to_numpy()
    found = np.zeros(len(words))
    found[dim[dim >= 0]] = n[dim >= 0]
    return int(n[dim < 0].sum()), found


def score_column(docs: DataFrame, labels: DataFrame):
    """A function of a text column that gives its score, by the model fitted on `docs` and `labels`: for filters that keep
    every column and need no join."""
    spark = docs.sparkSession
    arrow_limits(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = spark.sparkContext.broadcast(fit(narrow, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, at = text_bytes(text)
        out = [np.zeros(0)]
        for a, b in chunks(at):
            out.append(model.value.scores(data[at[a] : at[b]], at[a : b + 1] - at[a])[0])
        return pa.array(np.concatenate(out), pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted, and the evidence: ids and cosines of the EVIDENCE
    nearest examples, nearest first. A score depends on the text alone: equal texts have equal scores. A text without any
    dimension, an empty or null one included, gets the score of votes of 0 and no evidence. Without labels the curve is flat.
    A null id is not held out. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    arrow_limits(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(fit(narrow, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))))

    def scored(batches):
        own = model.value
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for a, b in chunks(at):
                scores, near, cosine = own.scores(data[at[a] : at[b]], at[a : b + 1] - at[a])
                near, cosine = near[:, :EVIDENCE], cosine[:, :EVIDENCE]
                some = cosine > 0
                cut = pa.array(np.concatenate(([0], np.cumsum(some.sum(1)))), pa.int32())
                ids, values = own.index.names[near[some]], cosine[some]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(cut, pa.array(values, pa.float64()))], ["doc_id", "score", "evidence_ids", "evidence_cosines"])

    out = narrow.mapInArrow(scored, "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")
