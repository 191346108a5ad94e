"""Problem 8: subject areas of documents from averaged word and subword embeddings with independent logistic outputs.

A word's vector is its own embedding plus the mean of its character n-gram embeddings; a sentence is the mean of its
words; each area has its own logistic output. Training runs in synchronous steps: every partition of the labelled sample
computes its gradient, the gradients are added, and one update is broadcast. Since output is linear in the mean, a trained
model scores a word once and a sentence by adding up its words' scores.

The labelled sample is small and half of its sentences are about nothing in particular, so words that merely happen to stand in
one sample are taken for signs of its area. The model is therefore trained on by itself: every partition of the documents takes
gradient steps on its own sentences, whose labels are what the first model is sure of and finds confirmed by sentences close
by; a sentence that nothing confirms counts as about nothing. The steps of all partitions are added up by row of the model,
each by how often it was made, and one update is broadcast; that is done twice. The logistic outputs of that model alone decide.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.textarrays import Words, slices

WORD_BUCKETS, SUBWORD_BUCKETS, DIMENSIONS = 1 << 14, 1 << 13, 16
GRAM_SIZES = (4, 5)
#: Labelled rows used for training at most (the bound of the fitted sample), and parts that compute gradients.
MAX_SAMPLES, TRAINING_PARTS = 20_000, 4
#: A sentence: up to a full stop, question or exclamation mark before a capital or digit, or an empty line; not after an abbreviated title or an initial.
BREAK = re.compile(
    r"[.!?…。！？\n](?:(?:(?<=[!?…])|(?<=\.)(?<![\s(]Dr\.)(?<![\s(]St\.)(?<!Capt\.)(?<!Mshl\.)(?<!Wdn\.)(?<![\s(][A-Z]\.))[\"'”’»)\]]*\s+(?=[\"'“‘«„(¿¡]*[^\W_a-zà-öø-ÿ])"
    r"|(?<=[。！？])[。！？]*|(?<=\n)\s*\n\s*|(?<=\n)(?<![.!?…,;\"'”’»)\w]\n))"
)
TITLE = re.compile(r"\A\s*[^\n.!?…]{1,120}(?<![\s,;:\"”'’)])[^\S\n]*\n\s*\n")
HEADING = re.compile(r"^\s*(?:#+\s|TITLE:|=+\s*$|-{3,}\s*$).*$|^.*\n=+\s*$", re.M)
WORD_CACHE = 300_000
#: Words below which a stretch is no sentence.
LEAST_WORDS = 3
#: Logits above and below which the first model is sure that a sentence is, or is not, about an area; sentences this far away confirm it.
SURE, CONFIRMED_WITHIN = (0.5, -1.0), 3
#: How often the model is trained on by its own labels, sentences of a step of a partition, and the rate of its steps.
ROUNDS, STEP_SENTENCES, SELF_RATE = 2, 256, 0.3
#: Rows of the model that are added up in one place.
BLOCK_ROWS = 512
#: A sentence is about an area if its logit is above this: unconfirmed sentences count as about nothing, so outputs are low.
CUT = -1.5


def sentence_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in BREAK.finditer(text))]


def prepared(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = TITLE.sub("", text, count=1)
    return HEADING.sub("\n\n", text) if "#" in text or "=" in text or "TITLE:" in text or "---" in text else text


class SentenceWords:
    """The words of all sentences of some texts: index into ``vocabulary``, and the (text, sentence) each belongs to."""

    def __init__(self, texts: list[str]):
        texts = [prepared(t) for t in texts]
        words = Words(texts, hashed=False, hyphens=True)
        lengths_kept = [len(a) == len(b) for a, b in zip(texts, words.texts)]
        starts = [np.array(sentence_starts(t if same else low)) + o for t, low, same, o in zip(texts, words.texts, lengths_kept, words.offsets.tolist())]
        begins = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.text_of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        self.sentence = np.searchsorted(begins, words.start, side="right") - 1
        self.sentences = len(begins)
        bounds = np.empty(2 * len(words.start) + 1, dtype=np.int32)
        bounds[:-1:2], bounds[1::2] = words.start * 4, words.end * 4
        bounds[-1] = bounds[-2] if len(words.start) else 0
        pieces = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(words.start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(words.cps.tobytes())]).dictionary_encode()
        entry = pieces.indices.to_numpy()[::2]
        seen = np.zeros(len(pieces.dictionary), dtype=bool)
        seen[entry] = True
        self.index = (np.cumsum(seen) - 1)[entry]
        kept = pieces.dictionary.filter(pa.array(seen)).to_pylist()
        self.vocabulary = [b.decode("utf-32-le") for b in kept]


def features(word: str) -> tuple[int, list[int]]:
    """Bucket of a word, and the buckets of its character n-grams (after those of words)."""
    padded = f"<{word}>"
    grams = [xxhash.xxh32_intdigest(padded[i : i + n].encode()) % SUBWORD_BUCKETS + WORD_BUCKETS for n in GRAM_SIZES for i in range(len(padded) - n + 1)]
    return xxhash.xxh32_intdigest(word.encode()) % WORD_BUCKETS, grams


class Model:
    def __init__(self, areas: list[str], seed: int = 7):
        random = np.random.default_rng(seed)
        self.areas = areas
        self.embedding = random.normal(0, 0.05, (WORD_BUCKETS + SUBWORD_BUCKETS, DIMENSIONS)).astype(np.float32)
        self.output = random.normal(0, 0.5, (DIMENSIONS, len(areas))).astype(np.float32)
        self.bias = np.full(len(areas), -2.0, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.output, self.bias]

    def word_vectors(self, vocabulary: list[str]) -> np.ndarray:
        out = np.empty((len(vocabulary), DIMENSIONS), dtype=np.float32)
        for i, w in enumerate(vocabulary):
            own, grams = features(w)
            out[i] = self.embedding[own]
            if grams:
                out[i] += self.embedding[grams].mean(axis=0)
        return out

    def gradient(self, words: SentenceWords, target: np.ndarray) -> list[np.ndarray]:
        """Sum over sentences of the gradients of the logistic losses; rows of NaN targets are left out."""
        vectors = self.word_vectors(words.vocabulary)
        count = np.bincount(words.sentence, minlength=words.sentences).astype(np.float32)
        mean = np.zeros((words.sentences, DIMENSIONS), dtype=np.float32)
        np.add.at(mean, words.sentence, vectors[words.index])
        mean /= np.maximum(count, 1)[:, None]
        score = 1 / (1 + np.exp(-(mean @ self.output + self.bias)))
        error = np.where(np.isnan(target) | (count < LEAST_WORDS)[:, None], 0, score - np.nan_to_num(target)).astype(np.float32)
        back = (error @ self.output.T) / np.maximum(count, 1)[:, None]
        per_word = np.zeros_like(vectors)
        np.add.at(per_word, words.index, back[words.sentence])
        out = [np.zeros_like(self.embedding), mean.T @ error, error.sum(axis=0)]
        for i, w in enumerate(words.vocabulary):
            own, grams = features(w)
            out[0][own] += per_word[i]
            if grams:
                np.add.at(out[0], grams, per_word[i] / len(grams))
        return out


class Scorer:
    """Sentence scores of texts; keeps the scores of words between slices."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.zeros((0, len(model.areas)), dtype=np.float32)

    def word_scores(self, vocabulary: list[str]) -> np.ndarray:
        """Of each word, its part of the logits."""
        if len(self.known) > WORD_CACHE:
            self.known, self.scores = {}, self.scores[:0]
        new = [w for w in vocabulary if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_vectors(new) @ self.model.output])
        return self.scores[[self.known[w] for w in vocabulary]]

    def score(self, words: SentenceWords) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every stretch between sentence ends, and whether it is a sentence at all."""
        total = np.zeros((words.sentences, len(self.model.areas)), dtype=np.float32)
        count = np.bincount(words.sentence, minlength=words.sentences)
        if len(words.index):
            first = np.flatnonzero(np.concatenate([[True], words.sentence[1:] != words.sentence[:-1]]))
            total[words.sentence[first]] = _run_sums(self.word_scores(words.vocabulary).take(words.index, axis=0), first)
        return total / np.maximum(count, 1)[:, None] + self.model.bias, count >= LEAST_WORDS

    def about(self, words: SentenceWords) -> tuple[np.ndarray, np.ndarray]:
        """Whether each sentence is about each area, and whether it is a sentence at all."""
        logits, real = self.score(words)
        return (logits > CUT) & real[:, None], real


def _step_gradients(samples: DataFrame, model: Model) -> list[np.ndarray]:
    """Gradients of all partitions, added up."""
    spark = samples.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total, n = shared.value, None, 0
        for batch in batches:
            words = SentenceWords(batch.text.tolist())
            label = batch.area.map({a: i for i, a in enumerate(model.areas)}).to_numpy()[words.text_of]
            target = np.zeros((words.sentences, len(model.areas)), dtype=np.float32)
            target[np.arange(len(label)), label] = 1
            part = model.gradient(words, target)
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += words.sentences
        if total is not None:
            yield pd.DataFrame({"gradient": [np.concatenate([g.ravel() for g in total]).astype(np.float32).tobytes()], "n": [n]})

    flat, n = None, 0
    for row in samples.mapInPandas(run, "gradient binary, n long").toLocalIterator():
        part = np.frombuffer(row.gradient, dtype=np.float32)
        flat, n = part if flat is None else flat + part, n + row.n
    shared.destroy()
    out, at = [], 0
    for p in model.parameters():
        out.append(flat[at : at + p.size].reshape(p.shape) / max(n, 1))
        at += p.size
    return out


def train(samples: DataFrame, areas: list[str], text_col: str = "text", area_col: str = "area", steps: int = 14, rate: float = 0.12) -> Model:
    """A model from at most MAX_SAMPLES labelled rows (those with the least hashes of their text, if there are more); every sentence carries its sample's area."""
    model = Model(areas)
    rows = samples.select(F.col(text_col).alias("text"), F.col(area_col).alias("area")).filter(F.col("area").isin(areas) & F.col("text").isNotNull())
    rows = rows.orderBy(F.xxhash64("text"), "area").limit(MAX_SAMPLES).repartition(TRAINING_PARTS).cache()
    mean = [np.zeros_like(p) for p in model.parameters()]
    square = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        for p, g, m, v in zip(model.parameters(), _step_gradients(rows, model), mean, square):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    rows.unpersist()
    return model


def own_labels(logits: np.ndarray, real: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(targets, which sentences to train on): sure and confirmed ones for their area; sure ones that nothing confirms, and those sure to be about no area, for none."""
    top = logits.max(axis=1) if logits.size else np.zeros(len(logits))
    label = np.where(real & (top > SURE[0]), logits.argmax(axis=1) if logits.size else -1, -1)
    confirmed = np.zeros(len(logits), dtype=bool)
    for k in range(1, CONFIRMED_WITHIN + 1):
        same = (text_of[k:] == text_of[:-k]) & (label[k:] == label[:-k]) & (label[k:] >= 0)
        confirmed[k:] |= same
        confirmed[:-k] |= same
    target = np.zeros(logits.shape, dtype=np.float32)
    target[np.flatnonzero(confirmed), label[confirmed]] = 1
    return target, real & ((label >= 0) | (top < SURE[1]))


class LocalSteps:
    """Gradient steps of one partition on its copy of the model; ``steps`` counts those of each row of the embeddings."""

    def __init__(self, model: Model):
        self.model = copy.deepcopy(model)
        self.steps = np.zeros(len(model.embedding))
        self.squares = [np.full(n, 1e-6, dtype=np.float32) for n in (len(model.embedding), model.output.shape, model.bias.shape)]
        self.known: dict[str, tuple[int, list[int]]] = {}

    def rows_of(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word, rows of its n-grams one word after another, and how many it has."""
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        found = [self.known[w] if w in self.known else self.known.setdefault(w, features(w)) for w in vocabulary]
        size = np.array([len(g) for _, g in found], dtype=np.int64)
        return np.array([o for o, _ in found], dtype=np.int64), np.array([x for _, g in found for x in g], dtype=np.int64), size

    def train(self, words: SentenceWords, target: np.ndarray, use: np.ndarray) -> None:
        own, grams, size = self.rows_of(words.vocabulary)
        vocabulary = np.arange(len(own))
        row, of, part = np.concatenate([own, grams]), np.concatenate([vocabulary, np.repeat(vocabulary, size)]), np.repeat([0, len(own)], [len(own), len(grams)])
        order = _order(row, len(self.steps))
        by_row = row[order], of[order], part[order]
        first = np.searchsorted(words.sentence, np.arange(words.sentences + 1))
        begin = np.cumsum(size) - size
        order = np.random.default_rng(len(words.index)).permutation(np.flatnonzero(use))
        for lo in range(0, len(order), STEP_SENTENCES):
            chosen = np.sort(order[lo : lo + STEP_SENTENCES])
            self.step(words.index, first[chosen], first[chosen + 1] - first[chosen], target[chosen], own, grams, begin, size, by_row)

    def step(self, index: np.ndarray, first: np.ndarray, length: np.ndarray, target: np.ndarray, own: np.ndarray, grams: np.ndarray, begin: np.ndarray, size: np.ndarray, by_row: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """One step on sentences whose words stand at ``first`` in ``index``; rows that are not touched stay as they are.

        ``by_row``: rows of the embeddings in order, the word of the vocabulary that each is of, and 0 for a word's own row or the number of words for its n-grams.
        """
        e, o, b = self.model.parameters()
        runs = lambda start, n: np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = index[runs(first, length)]
        seen = np.zeros(len(own), dtype=bool)
        seen[word] = True
        used = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        word = place[word]
        n, rows = size[used], grams[runs(begin[used], size[used])]
        some = np.flatnonzero(n)
        vector = e.take(own[used], axis=0)
        if len(some):
            vector[some] += _run_sums(e.take(rows, axis=0), (np.cumsum(n) - n)[some]) / n[some][:, None].astype(np.float32)
        mean = _run_sums(vector.take(word, axis=0), np.cumsum(length) - length) / length[:, None].astype(np.float32)
        error = ((1 / (1 + np.exp(-(mean @ o + b))) - target) / len(target)).astype(np.float32)
        back = (error @ o.T) / length[:, None].astype(np.float32)
        order = _order(word, len(used))
        per_word = _run_sums(back.take(np.repeat(np.arange(len(length)), length)[order], axis=0), np.flatnonzero(np.diff(word[order], prepend=-1)))
        parts = np.concatenate([per_word, per_word / np.maximum(n, 1)[:, None].astype(np.float32)])
        row, of, part = by_row
        kept = np.flatnonzero(seen[of])
        row = row[kept]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        touched, gradient = row[starts], _run_sums(parts.take(place[of[kept]] + np.where(part[kept], len(used), 0), axis=0), starts)
        square = self.squares
        square[0][touched] += np.einsum("ij,ij->i", gradient, gradient) / np.float32(DIMENSIONS)
        e[touched] -= gradient * (np.float32(SELF_RATE) / np.sqrt(square[0][touched]))[:, None]
        self.steps[touched] += 1
        for p, g, q in ((o, mean.T @ error, square[1]), (b, error.sum(axis=0), square[2])):
            q += g**2
            p -= 0.3 * SELF_RATE * g / np.sqrt(q)


def _order(key: np.ndarray, above: int) -> np.ndarray:
    """The stable order of numbers under ``above``; those of 16 bits are sorted by digits."""
    return np.argsort(key.astype(np.uint16) if above <= 1 << 16 else key, kind="stable")


def _run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the rows from each of ``first`` to the next; two columns are added at once as one complex number."""
    columns = values.shape[1]
    if columns % 2:
        values = np.pad(values, ((0, 0), (0, 1)))
    return np.add.reduceat(values.view(np.complex64), first, axis=0).view(np.float32)[:, :columns]


def self_train(texts: DataFrame, model: Model) -> Model:
    """``model`` trained on by all ``texts``, each partition by its own steps; they are added up by block of rows, in Spark."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, local = shared.value, LocalSteps(shared.value)
        scorer, used = Scorer(first), 0
        for batch in batches:
            for _, some in slices(batch, "text"):
                words = SentenceWords(some)
                target, use = own_labels(*scorer.score(words), words.text_of)
                local.train(words, target, use)
                used += int(use.sum())
        if not used:
            return
        moved = np.concatenate([(local.model.embedding - first.embedding) * local.steps[:, None], local.steps[:, None]], axis=1).astype(np.float32)
        rest = np.concatenate([((p - q) * used).ravel() for p, q in zip(local.model.parameters()[1:], first.parameters()[1:])] + [[used]]).astype(np.float32)
        blocks = [moved[i : i + BLOCK_ROWS].tobytes() for i in range(0, len(moved), BLOCK_ROWS)] + [rest.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(sums, dtype=np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    kind = "block int, sums binary"
    sums = {r.block: np.frombuffer(r.sums) for r in texts.mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).toLocalIterator()}
    if not sums:
        return model
    out, last = copy.deepcopy(model), max(sums)
    moved = np.concatenate([sums[i] for i in range(last)]).reshape(len(out.embedding), DIMENSIONS + 1)
    out.embedding += (moved[:, :-1] / np.maximum(moved[:, -1:], 1)).astype(np.float32)
    rest = (sums[last][:-1] / sums[last][-1]).astype(np.float32)
    out.output += rest[: out.output.size].reshape(out.output.shape)
    out.bias += rest[out.output.size :]
    return out


def document_areas(docs: DataFrame, samples: DataFrame, areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", area_col: str = "area", share: float = 1 / 6) -> DataFrame:
    """(id, area, share): the areas that at least ``share`` of a document's sentences are about.

    Sentences are stretches of at least LEAST_WORDS words between sentence ends; headings are none. Null, empty and blank texts
    have no row; repeated rows give repeated results once; other columns are ignored; without labelled samples or areas there is no row.
    Only the model is broadcast, and collected in blocks of rows (fixed size: 1.6 MB); documents are read in ROUNDS + 1 maps; the model's
    blocks of each task and the found rows are shuffled. The outputs of a partition's steps depend on how documents are partitioned.
    """
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    names = sorted(r[0] for r in areas.select(area_col).filter(F.col(area_col).isNotNull()).distinct().collect())
    schema = f"id {id_kind}, area string, share double"
    if not names or samples.filter(F.col(area_col).isin(names)).isEmpty():
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    model = train(samples, names)
    for _ in range(ROUNDS):
        model = self_train(source.select("text"), model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        labels = np.array(shared.value.areas, dtype=object)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = SentenceWords(texts)
                (about, real), text = scorer.about(words), words.text_of
                total = np.bincount(text, weights=real, minlength=len(texts))
                hits = np.zeros((len(texts), len(labels)))
                np.add.at(hits, text, about)
                fraction = hits / np.maximum(total, 1)[:, None]
                row, area = np.nonzero((fraction >= share - 1e-9) & (hits > 0))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(labels[area].tolist(), pa.string()), pa.array(fraction[row, area])], names=["id", "area", "share"])

    found = source.mapInArrow(run, schema)
    return found.groupBy("id", "area").agg(F.max("share").alias("share")).withColumnRenamed("id", id_col)
