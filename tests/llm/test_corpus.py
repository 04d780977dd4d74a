"""Corpus operators against brute force, on rows with nulls, empty and long texts, copies, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.llm import common, components, exact_dedup, lm_score, lz_fingerprint, mixing, near_dedup, sharding, sketch, sp_codec, text, token_output, toxicity, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, cls string, score string, `key` string"


def made(seed=1, n=90):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeÉîñ日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(60))
    rows = []
    for i in range(n):
        kind = r.random()
        t = " ".join(words(r.choice([1, 3, 5, 6, 40, 80, 200])))
        if rows and kind < 0.2:
            t = r.choice(rows)[1] or ""
            t = t.upper() if kind < 0.05 and t.isascii() else t
        elif rows and kind < 0.45:
            own = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(r.randint(1, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            t = " ".join(own)
        elif kind < 0.55:
            t = " ".join(words(10)) + " " + passage + "\n" + " ".join(words(5))
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "   \n"), (1003, "ab " * 3000), (1004, "x" * 5000), (1005, "Same text"), (1006, "same TEXT"), (1007, "a b  c \x1c d")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 4}" if i % 5 else None, len(t or ""), "x", "y", "z", "u", "v") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


def scored(d):
    return toxicity.toxicity_scores(d, d.sparkSession.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int"))


ALL = {
    "op3": scored,
    "op1": lambda d: near_dedup.near_duplicates(d),
    "op2": lambda d: exact_dedup.exact_duplicates(d),
    "op4": lambda d: sharding.shard_documents(d),
    "op5": lambda d: lz_fingerprint.fingerprint_documents(d),
    "op6": lambda d: mixing.mix_documents(d),
    "op7": lambda d: token_output.token_digests(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op8": lambda d: lm_score.lm_scores(d),
    "op9": lambda d: window_dedup.repeated_windows(d),
    "op10": lambda d: sp_codec.codec_digests(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_null_and_repeated_ids(spark, name):
    rows = [(None, "one two three four five six"), (None, None), (7, "one two three four five six"), (7, "one two three four five six"), (7, "other words"), (8, "")]
    out = ALL[name](frame(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(rows, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_components(rows)


def test_near_duplicates_of_one_large_group(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(120)] = f"n{r.randrange(400)}"
        rows.append((i, " ".join(own)))
    rows.reverse()
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in near_components(rows).items()}


def test_sketch_estimates_similarity():
    r = np.random.RandomState(0)
    agree = []
    for size in (3, 20, 400):
        for _ in range(60):
            items = r.randint(0, 1 << 62, 2 * size).astype(np.uint64)
            a, b = np.unique(items[: size + size // 2]), np.unique(items[size // 2 :])
            both = sketch.sketch(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert (both != sketch.EMPTY).all()
            agree.append((both[0] == both[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(agree)) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 60), (60, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(51)} | {60: 60, 100: 60, 101: 60}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_duplicates(rows, docs):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()} == want


def test_exact_duplicates_with_clashing_fingerprints(spark, rows):
    rows = rows + [(None, "Same text"), (None, "other"), (2000, "abc"), (2001, "abd"), (2002, "abe"), (2003, "ABC")]
    docs = frame(spark, rows)
    plain = exact_dedup.exact_duplicates(docs).collect()
    same_length = exact_dedup.exact_duplicates(docs, prints=lambda c: F.length(c).cast("long"))
    assert collections.Counter(map(tuple, same_length.collect())) == collections.Counter(map(tuple, plain))
    assert {r.doc_id: r.keep_id for r in plain if r.doc_id and r.doc_id >= 2000} == {2000: 2003, 2001: 2001, 2002: 2002, 2003: 2003}


def test_chunks_cover_texts_and_lower_is_ascii_only(docs, rows):
    t = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", F.concat_ws("", F.regexp_extract_all(t, F.lit(exact_dedup.CHUNKS), F.lit(0))).alias("a"), exact_dedup.lower_ascii(t).alias("l"))
    assert {r.doc_id: (r.a, r.l) for r in joined.collect()} == {i: (t or "", (t or "").translate(LOWER)) for i, t in rows}


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(5)
    neutral, bad = [f"w{k}" for k in range(400)], ["vile", "nasty", "rotten", "foul"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(neutral) for _ in range(r.randint(10, 60))]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (None, "vile foul w1")]
    return frame(spark, rows), spark.createDataFrame(labels + [(None, 1), (903, None)], "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_the_held_out_fold(toxic):
    docs, labels, truth = toxic
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_toxicity_without_labels(spark, toxic):
    out = toxicity.toxicity_scores(toxic[0], spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len({r.score for r in out}) == 1
    assert toxicity.toxicity_scores(frame(spark, []), toxic[1]).count() == 0


def test_toxicity_learns_from_more_than_a_thousand_of_a_class(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(("vile", "foul") if i % 2 else ("kind", "calm")) for _ in range(3)) + f" w{i}" for i in range(3300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3300)], "doc_id long, toxic int")
    learnable = collections.Counter(i % 2 for i in range(3300) if zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.fit(frame(spark, list(enumerate(texts))), labels)
    assert 1000 < min(learnable.values()) and max(learnable.values()) <= 2000
    assert collections.Counter(model.index.toxic.tolist()) == learnable


@pytest.mark.parametrize("examples,k", [(700, 100), (500, 30), (40, 400), (65, 64)])
def test_block_max_index_is_exact(examples, k):
    r = np.random.RandomState(examples)
    space = toxicity.Space(np.arange(200, dtype=np.uint64), r.rand(200) + 0.5)
    chance = 1 / np.arange(1, 201)
    bag = lambda: (h := np.flatnonzero(r.rand(200) < chance).astype(np.uint64), r.randint(1, 5, len(h)).astype(float))
    bags = [bag() for _ in range(examples)]
    index = toxicity.BlockMaxIndex(space, bags, np.arange(examples), r.randint(0, 2, examples))
    assert 0 < len(index.dense) < 200 and sorted(index.names) == list(range(examples))
    dense = np.zeros((examples, 200))
    for i, name in enumerate(index.names):
        h, n = bags[name]
        dense[i, h.astype(int)] = (1 + np.log(n)) * space.idf[h.astype(int)]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-300)[:, None]
    asked = [bag() for _ in range(300)]
    text, dim, n = space.bag_counts(asked)
    at, got = index.nearest(text, dim, space.weights(text, dim, n, 300), 300, k)
    for i, (h, n) in enumerate(asked):
        w = (1 + np.log(n)) * space.idf[h.astype(int)]
        cosine = np.round(dense[:, h.astype(int)] @ (w / max(np.linalg.norm(w), 1e-300)), 10)
        best = np.lexsort((np.arange(examples), -cosine))[: min(k, examples)]
        assert np.allclose(got[i], cosine[best], atol=1e-9) and (at[i] == best).mean() > 0.9


def test_toxicity_scores_by_brute_force(spark, toxic):
    docs, labels, truth = toxic
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    bag = lambda t: collections.Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)))
    texts = {r.doc_id: bag(r.text) for r in docs.select("doc_id", "text").collect()}
    total = len(texts)
    learnable = sorted(i for i in truth if zlib.crc32(str(i).encode()) % 3 != 1)
    frequency = collections.Counter(w for b in texts.values() for w in b)
    having = collections.Counter(w for i in learnable for w in texts[i])
    space = {w for w in having if having[w] > 1 and frequency[w] >= max(1, toxicity.FLOOR * total)}

    def vector(b, power):
        v = {w: (1 + math.log(n)) * math.log((1 + total) / frequency[w]) ** power for w, n in b.items() if w in space}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def voted(v, examples):
        near = sorted(((round(sum(x * e.get(w, 0.0) for w, x in v.items()), 10), truth[i]) for i, e in examples.items()), reverse=True)
        out = []
        for k in toxicity.RADII:
            cut = near[:k]
            out.append(sum(c * (2 * y - 1) for c, y in cut) / (sum(c for c, _ in cut) + 0.1))
        return out

    hashed = lambda b: np.sort(text.word_hashes(np.frombuffer(" ".join(b).encode(), np.uint8), np.array([0, len(" ".join(b).encode())]), text.SIGNS)[0])
    fold = {i: zlib.crc32(hashed(texts[i]).tobytes()) % toxicity.FOLDS for i in learnable}
    y, found = np.array([truth[i] for i in learnable]), []
    for power in toxicity.POWERS:
        own = {i: vector(texts[i], power) for i in learnable}
        x = np.array([voted(own[i], {j: own[j] for j in learnable if fold[j] != fold[i]}) for i in learnable])
        beta = toxicity.calibrated(x, y, np.ones(len(y)))
        p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
        found.append((-np.log(np.where(y == 1, p, 1 - p)).sum(), power, beta, own))
    _, power, beta, own = min(found, key=lambda f: f[:2])
    for i, b in texts.items():
        v = vector(b, power)
        want = 1 / (1 + math.exp(-(np.dot(voted(v, own), beta[:-1]) + beta[-1])))
        assert math.isclose(rows[i].score, want, abs_tol=2e-3), i
        best = max((round(sum(x * e.get(w, 0.0) for w, x in v.items()), 10) for e in own.values()))
        assert (rows[i].evidence_cosines[0] if rows[i].evidence_cosines else 0.0) == pytest.approx(best, abs=1e-9)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 24, 1000, 4097):
        p = sharding.permuted(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n))
        assert (sharding.permuted(p, n, 9, back=True) == np.arange(n)).all()


def test_sharding(rows, docs):
    out = sharding.shard_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(7)).collect()} == {(r.doc_id, r.shard, r.slot) for r in out}


def test_fingerprints(rows, docs):
    out = {r.doc_id: r for r in lz_fingerprint.fingerprint_documents(docs).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
        whole = lz_fingerprint.Phrases()
        whole.feed(edited.encode(), 0)
        want = lz_fingerprint.fingerprints([lz_fingerprint.phrase_hashes(edited.encode(), whole.ends)])[0]
        assert out[i].edited_fingerprint == want.tobytes().hex()
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[t or ""].add(out[i].fingerprint)
    assert all(len(f) == 1 for f in texts.values())


def test_phrases_are_lz78():
    data = b"abababbbabaab"
    p = lz_fingerprint.Phrases()
    p.feed(data, 0)
    known, start, ends = set(), 0, []
    for k in range(1, len(data) + 1):
        if data[start:k] not in known:
            known.add(data[start:k])
            ends.append(k)
            start = k
    assert p.ends == ends


def test_mixing(rows, docs):
    out = mixing.mix_documents(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    assert {r.doc_id: r.size for r in out} == size
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(r.size for r in by[s]) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    for s in names:
        assert all(r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-9) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s]) / 2 + 1e-6
        assert all(r.taken == r.copies * r.size <= 2 * r.size for r in by[s])
    assert {(r.doc_id, r.taken) for r in mixing.mix_documents(docs.repartition(5)).collect()} == {(r.doc_id, r.taken) for r in out}


def thue_morse(n):
    """A word over a and b; it and its complement have equal polynomial hashes for every odd base modulo 2**64."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(11)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "12", "é", "日", "\u3000", "\xa0", "\x1c", "<|endoftext|>", "<|endo", ".", " word"]
    one = thue_morse(1024)
    more = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(300)]
    more += ["a <|endoftext|> b", one, one.translate(str.maketrans("ab", "ba")), f" {one} " + one.translate(str.maketrans("ab", "ba")), " ".join(f"w{k % 5000}" for k in range(400_000)), "y" * 70_000]
    rows = rows + [(5000 + k, t) for k, t in enumerate(more)]
    assert max(len(t or "") for _, t in rows) > 2 << 20
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_output.token_digests(frame(spark, rows).repartition(3), path).collect()) == want


def test_a_tokenizer_that_cuts_otherwise():
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.length[:] = 1  # lengths that never fit: pieces go alone
    data, at = text.text_bytes(pa.array(["some words here", None, "and more words"]))
    ids, n = encoder.encode(data, at)
    assert n.tolist() == [3, 0, 3] and encoder.tokenizer.decode(ids.tolist()) == "some words hereand more words"


def test_packing():
    for bits in (1, 5, 16, 17, 20):
        ids = np.random.RandomState(bits).randint(0, 1 << bits, 999)
        packed = token_output.pack(ids, bits)
        assert (token_output.unpack(packed, bits, 999) == ids).all() and (token_output.unpack(packed, bits, 9, 77) == ids[77:86]).all()


def test_lm_scores(rows, docs):
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    n = sum(one.values())
    for r in lm_score.lm_scores(docs).collect():
        w = words[r.doc_id]
        a, b, score = collections.Counter(w), collections.Counter(zip(w, w[1:])), 0.0
        for k, x in enumerate(w):
            chance = (one[x] - a[x] or lm_score.UNSEEN) / max(1, n - len(w))
            if k:
                seen = two[w[k - 1], x] - b[w[k - 1], x]
                chance = seen / (one[w[k - 1]] - a[w[k - 1]]) if seen else lm_score.BACKOFF * chance
            score += math.log(chance)
        assert r.n_words == len(w) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert r.mean_score is None if not w else math.isclose(r.mean_score, score / len(w), rel_tol=1e-9)


@pytest.mark.parametrize("batch", [1 << 21, 6000])
def test_repeated_windows(rows, docs, batch):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in window_dedup.repeated_windows(docs, batch=batch).collect()}
    assert got == want


def test_sentencepiece(spark, rows, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sp_codec.encode_documents(docs, path)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode(t or "") for i, t in rows}
    assert {r.doc_id: r.text for r in sp_codec.decode_documents(encoded, path).collect()} == {i: t or "" for i, t in rows}
    assert all(r.round_trip for r in sp_codec.codec_digests(docs, path).collect())
    codec = sp_codec.Codec.of(path)
    r = random.Random(4)
    odd = ["".join(r.choice("ab é\n▁日.🙂\0") for _ in range(r.randint(0, 40))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(odd)] == [library.encode(t) for t in odd]


def test_words_and_shingles(rows):
    data, at = text.text_bytes(pa.array([t for _, t in rows]))
    items, first = text.shingle_sets(data, at)
    assert np.diff(first).tolist() == [len(shingle_set(t)) for _, t in rows]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t) for i, t in made(8, 60)] + [(2000 + k, f"vile foul rotten nasty w{k} and more") for k in range(40)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in rows], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    kept = p.drop_toxic(spark, docs, str(tmp_path))
    clean = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and all(i < 2000 for i in clean) and set(clean) == {i for i, _ in rows if i < 2000}
    unique = p.drop_exact_copies(spark, kept, str(tmp_path))
    largest = {}
    for i, t in clean.items():
        largest[(t or "").translate(LOWER)] = max(i, largest.get((t or "").translate(LOWER), i))
    left = {r.doc_id: r.text for r in unique.collect()}
    assert unique.columns == docs.columns and set(left) == set(largest.values())
    near = p.drop_near_copies(spark, unique, str(tmp_path))
    want = {i for i, (_, c) in near_components(list(left.items())).items() if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want
    mixed = p.mix_sources(spark, near, str(tmp_path))
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(near).collect() if r.copies}
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in mixed.collect()) == copies
    out = p.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in out.collect()) == copies


def near(w, *more):
    return " ".join([f"{w}{k}" for k in range(60)] + list(more))


def test_near_copies_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, near("a")), (7, near("a", "end")), (7, near("b")), (9, near("c")), (9, near("c", "end")), (9, near("d")), (None, near("a", "x")), (None, near("e")), (None, near("e")), (8, ""), (5, near("d", "end"))]
    docs = frame(spark, rows)
    out = p.drop_near_copies(spark, docs, str(tmp_path))
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns
    assert kept in [collections.Counter([rows[0], rows[2], c, rows[7], rows[9], rows[10]]) for c in rows[3:5]]
    assert kept == collections.Counter((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs.repartition(5), str(tmp_path)).collect())


def test_null_ids_link_documents(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (None, " ".join(words[10:] + ["x1", "x2"])), (2, " ".join(words[20:] + [f"x{k}" for k in range(1, 11)])), (None, near("z"))]
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert 100 * len(shingle_set(rows[0][1]) & shingle_set(rows[2][1])) < 75 * len(shingle_set(rows[0][1]) | shingle_set(rows[2][1]))
    assert collections.Counter((r.doc_id, r.component_id, r.kept) for r in out) == collections.Counter([(1, 1, True), (None, 1, False), (2, 1, False), (None, None, False)])


def test_words_with_equal_polynomial_hashes_are_different(spark):
    one = thue_morse(1024)
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_bands_find_sets_at_the_threshold():
    r = np.random.RandomState(7)
    for size in (4, 12, 60, 300):
        pairs, missed = 600, 0
        for _ in range(pairs):
            inter = int(np.ceil(0.75 * size / 0.875)) if size > 4 else 4
            items = r.randint(0, 1 << 62, 2 * size).astype(np.uint64)
            extra = max(0, int(inter / 0.75) - inter)
            a, b = np.sort(items[: inter + extra // 2]), np.sort(np.concatenate((items[:inter], items[inter + extra // 2 : inter + extra])))
            both = np.concatenate((a, b))
            keys = sketch.band_keys(sketch.sketch(both, np.array([0, len(a), len(both)]), near_dedup.COORDINATES), near_dedup.BAND)
            missed += not (keys[0] == keys[1]).any()
        assert missed <= 1


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_exact_copies", "drop_near_copies", "mix_sources", "encode"])
def test_pipeline_stages_with_odd_rows(spark, tmp_path, stage):
    import corpus_pipeline as p

    names = ["doc_id", "text", "lang", "source", "n_chars", "row_number", "copies", "Copies_", "k_name", "m_copies", "row", "x", "component"]
    schema = ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names)
    rows = [(i, t, "en", None, 1, *"abcdefgh") for i, t in [(None, None), (None, "one two three four five six"), (None, "one two three four five six"), (3, ""), (3, "one two three four five SIX"), (3, near("q")), (3, near("q")), (4, near("q", "end"))]]
    spark.createDataFrame([(4, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    call = getattr(p, stage)
    out, none = call(spark, docs, str(tmp_path)), call(spark, empty, str(tmp_path))
    assert none.count() == 0 and none.columns == out.columns
    if stage != "encode":
        assert out.columns == names
    got = collections.Counter((r.doc_id, r.text) for r in out.collect()) if stage != "encode" else None
    if stage == "drop_toxic":
        assert got == collections.Counter((r[0], r[1]) for r in rows)
    if stage == "drop_exact_copies":
        assert got == collections.Counter([(3, ""), (3, rows[4][1]), (3, near("q")), (4, near("q", "end"))])
    if stage == "drop_near_copies":
        assert got == collections.Counter([(None, None), (3, ""), (3, rows[4][1]), (3, near("q"))])
    if stage == "mix_sources":
        assert sum(n * len((t or "").split()) for (_, t), n in got.items()) == pytest.approx(1.5 * sum(len((r[1] or "").split()) for r in rows), abs=32)
    if stage == "encode":
        assert out.count() == len(rows)


def test_slots_by_brute_force(rows, docs):
    mask = (1 << 64) - 1

    def mix(x, seed):
        x = (x + seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    n, half = len(rows), 1
    while 1 << 2 * half < n:
        half += 1

    def walked(x):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in range(sharding.ROUNDS):
                left, right = right, left ^ (mix(right, 64 + k) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                return x

    want = {i: (walked(k) % 24, walked(k) // 24) for k, (i, _) in enumerate(sorted(rows, key=lambda r: r[0]))}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs).collect()} == want
    at = sharding.row_at(np.array([s for s, _ in want.values()]), np.array([s for _, s in want.values()]), n, 24, 1)
    assert at.tolist() == list(range(n))


def test_written_shards(spark, rows, docs, tmp_path):
    placed = sharding.shard_documents(docs)
    sharding.write_shards(docs, placed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "text", F.col("shard").cast("int"), "slot")
    at = {r.doc_id: (r.shard, r.slot) for r in placed.collect()}
    assert sorted((r.doc_id, r.text, (r.shard, r.slot)) for r in back.fillna("").collect()) == sorted((i, t or "", at[i]) for i, t in rows)


def test_buckets_by_id_and_hash():
    bounds = [(3, 5), (7, -9), (7, 0), (7, 4), (9, 1)]
    rows = [(a, h) for a in (1, 3, 5, 7, 9, 11) for h in (-20, -9, 0, 3, 4, 5, 6)]
    got = common.bucket_of_bounds(np.array([a for a, _ in rows]), np.array([h for _, h in rows]), bounds)
    assert got.tolist() == [sum(b <= r for b in bounds) for r in rows]


def lz78(data):
    known, start = set(), 0
    for k in range(1, len(data) + 1):
        if data[start:k] not in known:
            known.add(data[start:k])
            start = k
    return known


def test_likeness_by_brute_force(rows, docs):
    out = {r.doc_id: r for r in lz_fingerprint.fingerprint_documents(docs).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    off, sets = [], {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        own, edited, after = (lz78(x.encode()) for x in (t, t[: len(t) - n] + following[:n], following))
        off += [out[i].near_edited - jaccard(own, edited), out[i].near_next - jaccard(own, after)]
        sets.setdefault(out[i].fingerprint, set()).add(frozenset(own))
    assert max(map(abs, off)) < 0.25 and abs(np.mean(off)) < 0.02
    assert all(len(s) == 1 for s in sets.values())


def test_mix_by_brute_force(rows, docs):
    out = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    hashes = docs.select("doc_id", F.xxhash64(F.lit(1), "doc_id", F.xxhash64("text")).alias("h"), mixing.quality(F.col("text")).alias("q")).collect()
    key = {r.doc_id: -math.log((((r.h & ((1 << 64) - 1)) >> 11) + 0.5) / (1 << 53)) / max(r.q, 1e-9) for r in hashes}
    for source in {r.source for r in out.values()}:
        own = sorted((r for r in out.values() if r.source == source), key=lambda r: key[r.doc_id])
        total, target, so_far = sum(r.size for r in own), own[0].target, 0
        epochs = math.floor(target / total) if total else 1
        for r in own:
            more = epochs < 2 and target > epochs * total and so_far + r.size / 2 <= target - epochs * total
            assert (r.copies, r.taken) == (epochs + more, (epochs + more) * r.size)
            so_far += r.size


def test_targets_of_many_sources(spark):
    r = random.Random(3)
    sizes = {f"s{k:03d}": r.choice([0, 1, 5, 50, 1000, 100000]) for k in range(200)}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        spent = sum(min(2 * n, weight[s] * level) for s, n in sizes.items())
        low, high = (level, high) if spent < 1.5 * sum(sizes.values()) else (low, level)
    assert all(math.isclose(got[s], min(2 * n, weight[s] * low), rel_tol=1e-6, abs_tol=1e-6) for s, n in sizes.items())


def test_windows_whose_hashes_collide(spark, rows, monkeypatch):
    data = "".join(random.Random(2).choice("ab") for _ in range(900)).encode()
    data = np.frombuffer(data + data[:300], np.uint8)
    start = np.arange(len(data) - 99)
    seen, want = set(), []
    for s in start:
        w = data[s : s + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    for weak in (start.astype(np.uint64) % 3, np.zeros(len(start), np.uint64)):
        # a hash that is a function of the window
        weak = np.array([weak[0] if weak.max() == 0 else data[s + 50] % 3 for s in start], np.uint64)
        assert window_dedup.later(weak, window_dedup.words_at(data), start).tolist() == want
    second = window_dedup.second_hash(window_dedup.words_at(data), start)
    assert window_dedup.later(np.zeros(len(start), np.uint64), None, second).tolist() == want


def test_texts_over_every_chunk_size(spark):
    """Texts longer than a chunk, a batch and a group: copies, near copies and repeated passages among them."""
    r = random.Random(21)
    base = " ".join(f"v{r.randrange(30000)}" for _ in range(400_000))
    assert len(base) > 2 << 20
    rows = [(1, base), (2, base[: len(base) // 2]), (3, base.upper()), (4, "short"), (5, base + " tail words")]
    docs = frame(spark, rows).repartition(2)
    exact = {x.doc_id: x.keep_id for x in exact_dedup.exact_duplicates(docs).collect()}
    assert exact == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1}
    gone = {x.doc_id: (x.n_bytes, x.n_removed) for x in window_dedup.repeated_windows(docs).collect()}
    lengths = {i: len(t) for i, t in rows}
    assert {i: n for i, (n, _) in gone.items()} == lengths and gone[2][1] == lengths[2] and gone[1][1] == 0 and lengths[1] <= gone[5][1] < lengths[5]
    words = {x.doc_id: x.n_words for x in lm_score.lm_scores(docs).collect()}
    assert words == {i: len(t.split()) for i, t in rows}
    prints = {x.doc_id: x.n_chars for x in lz_fingerprint.fingerprint_documents(docs).collect()}
    assert prints == lengths and sum(x.taken for x in mixing.mix_documents(docs).collect()) > 0


def test_windows_that_many_batches_hold(spark):
    passage = "".join(random.Random(9).choice("abcdef ") for _ in range(260))
    rows = [(i, f"{i:03d}" * 20 + passage + f"{i * 7:04d}" * 20) for i in range(90)]
    got = {r.doc_id: r.n_removed for r in window_dedup.repeated_windows(frame(spark, rows), batch=100).collect()}
    seen, want = set(), {}
    for i, t in rows:
        b, gone = t.encode(), set()
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(b[s : s + 100])
        want[i] = len(gone)
    assert len(rows) > window_dedup.HOT and got == want


def test_small_tables_need_no_python_workers(spark, toxic, rows, monkeypatch):
    """The driver's small tables in the pipeline: their rows reach executors without Python workers beside the operators'."""
    tables, make = [], type(spark).createDataFrame
    docs, labels = toxic[:2]
    documents = frame(spark, rows)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: tables.append(make(self, *a, **b)) or tables[-1])
    toxicity.fit(docs.select("doc_id", "text"), labels)
    mixing.mix_documents(documents).count()
    assert len(tables) >= 2
    for table in tables:
        assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
    some = common.small_table(spark, [(1, None), (2, 3)], pa.schema([("a", pa.int64()), ("b", pa.int32())]))
    assert some.dtypes == [("a", "bigint"), ("b", "int")] and sorted(map(tuple, some.collect())) == [(1, None), (2, 3)]
    assert common.small_table(spark, [], pa.schema([("a", pa.int64())])).count() == 0
