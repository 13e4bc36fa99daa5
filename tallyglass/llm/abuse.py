"""Abusive, hateful or sexual content: a factorization machine over hashed terms of each sentence."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.names import strip
from tallyglass.llm.sample import hash63
from tallyglass.llm.text import visible, without_markup

#: Hash space of the terms, and width and first spread of the interactions.
SPACE_BITS = 18
WIDTH = 8
SPREAD = 0.3
#: Most labelled documents the model is fitted on, and most terms of one of them; more sentences are sampled by their hash.
MOST_LABELLED = 12_000
MOST_TERMS = 4096
#: Folds of the labelled documents whose labels are checked by a machine fitted on the others.
FOLDS = 3
#: Documents that the prior counts for when a term's odds are estimated.
PRIOR = 8
#: Probability from which a document counts as abusive.
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухікѕԁјӏһԛԝьνοαρτυιкмтвн", "aeopcyxiksdjlhqwbvoaptuikmtbh")
LEET = str.maketrans("013457@$!|€", "oieastasiie")

_SEGMENT = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|[\n\r]+")
_WRAP = re.compile(r"(?<=[^\s.!?:;>])[ \t]*\r?\n(?:>[ \t]*)*(?=[a-zà-öø-ÿ])")
_BLANK = re.compile(r"[^\S\n\r]+")
_SPACED = re.compile(r"(?<![^\s\"'(>])(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_DOTTED = re.compile(r"[^\w*@$]*((?:[^\W_][.\-_*/+~]){2,}[^\W_])[^\w]*")
_EDGE = ".,;:?!\"'()[]{}<>«»“”‘’„…-–—/\\=#"
_PART = re.compile(r"[^\W_*]+(?:\*+[^\W_*]+)+|[^\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
_VOWEL = re.compile(r"[aeiouy]|(?<=(.))\1")


def segments(text: str | None) -> list[str]:
    """Sentences and lines of a text, in plain letters: markup and unseen characters gone, lookalikes made Latin, spaced
    letters joined. A line that goes on in lower case is one with the next. Null and empty texts have none."""
    if not text:
        return []
    text = visible(without_markup(_WRAP.sub(" ", text)))
    text = _BLANK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold().translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    else:
        text = text.lower()
    return [_SPACED.sub(lambda m: m.group().replace(" ", ""), s) for s in _SEGMENT.split(text) if s and not s.isspace()]


def spelled(raw: str) -> list[str]:
    """Words of one blank-free token, with signs read as the letters they stand for; masked letters stay ``*``."""
    dotted = _DOTTED.fullmatch(raw)
    core = re.sub(r"[^\w]|_", "", dotted.group(1)) if dotted else raw.strip(_EDGE)
    out = []
    for part in re.split(r"[-–—/.,;:?()\"'’<>]+", core) if not dotted else [core]:
        letters = any(c.isalpha() for c in part)
        if letters and "_" in part:
            out.append("<id>")
            continue
        if letters and not part.isalpha():
            part = part.translate(LEET)
        for word in _PART.findall(part):
            out.append(_RUN.sub(r"\1", word) if any(c.isalpha() for c in word) else "#")
    return out


def skeleton(word: str) -> str:
    """The word without vowels, doubled letters and masks: equal for a word and its forms with masked vowels."""
    return _VOWEL.sub("", word.replace("*", ""))


class Terms:
    """Hashed terms of segments: the distinct words and skeletons of each, as numbers below ``2 ** SPACE_BITS``.

    No term holds two words: what words mean together is for the machine to learn.
    """

    def __init__(self, bits: int = SPACE_BITS):
        self.bits = bits
        self.cache: dict[str, tuple[tuple[int, int], ...]] = {}

    def _codes(self, raw: str) -> tuple[tuple[int, int], ...]:
        got = self.cache.get(raw)
        if got is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            got = tuple(
                (0 if "*" in w else zlib.crc32(w.encode()), zlib.crc32(b"k:" + skeleton(w).encode()) if len(w) > 3 and w != "<id>" else 0)
                for w in spelled(raw)
            )
            self.cache[raw] = got
        return got

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of all segments in a row, the begin of each segment, and each segment's text number."""
        words, bones, lengths, owner = [], [], [], []
        codes = self._codes
        for number, text in enumerate(texts):
            for segment in segments(text):
                n = len(words)
                for raw in segment.split():
                    for word, bone in codes(raw):
                        words.append(word)
                        bones.append(bone)
                if len(words) > n:
                    lengths.append(len(words) - n)
                    owner.append(number)
        w, b = np.array(words, np.uint64), np.array(bones, np.uint64)
        seg = np.repeat(np.arange(len(lengths)), lengths)
        terms = np.concatenate([w[w > 0], b[b > 0]])
        terms = (terms * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20) & np.uint64((1 << self.bits) - 1)
        key = np.unique((np.concatenate([seg[w > 0], seg[b > 0]]) << self.bits) + terms.astype(np.int64))
        of = key >> self.bits
        named, starts = np.unique(of, return_index=True)
        return (key & ((1 << self.bits) - 1)).astype(np.int32), starts, np.array(owner, np.int32)[named]


class FactorizationMachine:
    """``b + sum w_i x_i + sum <v_i, v_j> x_i x_j`` over the terms of a segment, each ``x = 2 / sqrt(known terms)``.

    With ``width`` 0 it is the linear model alone. Terms that training never met count nothing.
    """

    def __init__(self, bits: int = SPACE_BITS, width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = np.float32(-2.0)
        self.w = np.zeros(1 << bits, np.float32)
        self.v = rng.normal(0, SPREAD, (1 << bits, width)).astype(np.float32)
        self.seen = np.zeros(1 << bits, bool)

    def _parts(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        lengths = np.diff(np.append(starts, len(terms)))
        known = self.seen[terms]
        x = np.repeat(2 / np.sqrt(np.maximum(np.add.reduceat(known, starts, dtype=np.float32), 1)), lengths) * known
        vx = self.v[terms] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        z = self.b + np.add.reduceat(self.w[terms] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
        return z, x, vx, total, lengths

    def scores(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds per segment."""
        out = np.empty(len(starts), np.float32)
        for lo in range(0, len(starts), 20_000):
            hi = min(lo + 20_000, len(starts))
            end = starts[hi] if hi < len(starts) else len(terms)
            out[lo:hi] = self._parts(terms[starts[lo] : end], starts[lo:hi] - starts[lo])[0]
        return out

    def step(self, terms: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float, decay: float) -> None:
        """One AdaGrad step of the logistic loss over some segments."""
        z, x, vx, total, lengths = self._parts(terms, starts)
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        g_term = np.repeat(g, lengths) * x
        uniq, where = np.unique(terms, return_inverse=True)
        gw = np.bincount(where, g_term, len(uniq)).astype(np.float32) + decay * self.w[uniq]
        state["w"][uniq] += gw * gw
        self.w[uniq] -= rate * gw / np.sqrt(state["w"][uniq])
        if self.v.shape[1]:
            each = g_term[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            gv = np.stack([np.bincount(where, each[:, f], len(uniq)) for f in range(each.shape[1])], 1).astype(np.float32) + decay * self.v[uniq]
            state["v"][uniq] += gv * gv
            self.v[uniq] -= rate * gv / np.sqrt(state["v"][uniq])
        gb = float(g.sum())
        state["b"] += gb * gb
        self.b -= np.float32(rate * gb / np.sqrt(state["b"]))


def _gather(terms, starts, pick):
    ends = np.append(starts[1:], len(terms))
    lengths = (ends - starts)[pick]
    begin = np.cumsum(np.append(0, lengths[:-1]))
    at = np.repeat(starts[pick] - begin, lengths) + np.arange(lengths.sum())
    return terms[at], begin


def fit(data: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 10, seed: int = 7, bits: int = SPACE_BITS, width: int = WIDTH) -> FactorizationMachine:
    """Fit on the terms of labelled documents: a document is abusive if one of its segments is (multiple-instance learning).

    Starts from the smoothed log odds of each term's document frequency; then in every epoch an abusive document teaches
    by its highest-scoring segment, another document by its three highest, so the machine looks for what sets abuse apart.
    Segments are scored anew every other epoch. Documents without weight teach nothing.
    """
    model = FactorizationMachine(bits, width, seed)
    heavy = weight[data[2]] > 0
    pick = np.flatnonzero(heavy)
    if not len(pick):
        return model
    terms, starts = _gather(data[0], data[1], pick)
    owner = data[2][pick]
    doc = np.repeat(owner, np.diff(np.append(starts, len(terms))))
    once = np.unique((doc.astype(np.int64) << bits) + terms)
    del doc
    d, t = once >> bits, once & ((1 << bits) - 1)
    pos = np.bincount(t, (y[d] > 0.5) * weight[d], 1 << bits)
    neg = np.bincount(t, (y[d] <= 0.5) * weight[d], 1 << bits)
    n_pos, n_neg = max(1e-9, (weight * (y > 0.5)).sum()), max(1e-9, (weight * (y <= 0.5)).sum())
    base = n_pos / (n_pos + n_neg)
    odds = np.log((pos + PRIOR * base) / (pos + neg + PRIOR) / base)
    # what a single document has is no evidence: one wrong label would make all of its rare terms abusive
    met = np.bincount(t, minlength=1 << bits)
    bad = np.bincount(t, y[d] > 0.5, 1 << bits)
    model.seen = met >= 2
    odds[(bad < 2) & (odds > 0)] = 0
    model.w = np.where(model.seen, np.clip(odds, -1, 3), 0).astype(np.float32)
    state = {"w": np.full(1 << bits, 0.1, np.float32), "v": np.full((1 << bits, width), 0.1, np.float32), "b": 1.0}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        if epoch % 2 == 0:
            order = np.lexsort((-model.scores(terms, starts), owner))
            first = np.searchsorted(owner[order], np.arange(len(y)))
            place = np.arange(len(order)) - first[owner[order]]
            chosen = order[place < np.where(y[owner[order]] > 0.5, 1, 3)]
        pick = rng.permutation(chosen)
        for part in np.array_split(pick, max(1, len(pick) // 256)):
            some, begin = _gather(terms, starts, part)
            model.step(some, begin, (y[owner[part]] > 0.5).astype(np.float32), weight[owner[part]].astype(np.float32), state, 0.3 / (1 + 0.1 * epoch), 1e-4)
    return model


def probabilities(model: FactorizationMachine, data: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Probability of each of ``n`` texts: that of its most abusive segment; 0 for texts without words."""
    terms, starts, owner = data
    out = np.zeros(n)
    if len(starts):
        np.maximum.at(out, owner, 1 / (1 + np.exp(-np.clip(model.scores(terms, starts).astype(np.float64), -30, 30))))
    return out


def document_scores(model: FactorizationMachine, terms: Terms, texts: list[str | None]) -> np.ndarray:
    """``probabilities`` of texts, some megabytes at a time."""
    out, begin, size = [np.zeros(0)], 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text or "")
        if size > 1_000_000 or end == len(texts):
            out.append(probabilities(model, terms(texts[begin:end]), end - begin))
            begin, size = end, 0
    return np.concatenate(out)


def contradicted(data: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, held: np.ndarray, seed: int = 7) -> np.ndarray:
    """Numbers of the documents in ``held`` whose labels a machine fitted on the others clearly contradicts: raters err."""
    if not held.any() or held.all():
        return np.zeros(0, np.int64)
    p = probabilities(fit(data, y, np.where(held, 0.0, weight), epochs=5, seed=seed), data, len(y))
    return np.flatnonzero(held & np.where(y > 0.5, p < 0.2, p > 0.8))


def votes(labels: DataFrame) -> DataFrame:
    """``doc_id, abusive, n``: reviewers' opinions per document; null categories are none."""
    plain = F.lower(strip("category"))
    return labels.filter(plain.isNotNull() & (plain != "")).groupBy("doc_id").agg(
        F.sum(F.when(plain != "none", 1).otherwise(0)).alias("abusive"), F.count("*").alias("n")
    )


def _sampled(terms: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's segments if they have at most ``most`` terms, else those with the smallest hashes that do, in their order."""
    lengths = np.diff(np.append(starts, len(terms)))
    if len(terms) <= most:
        return terms, lengths
    marks = np.array([zlib.crc32(terms[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)])
    order = np.argsort(marks, kind="stable")
    pick = np.sort(order[np.cumsum(lengths[order]) <= most])
    return (_gather(terms, starts, pick)[0] if len(pick) else terms[:0]), lengths[pick]


def _labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, ...`` to ``doc_id, mark, terms, lengths, ...``: a checksum of the text, its terms and its segments' lengths."""
    make = Terms()
    for batch in batches:
        marks, terms, lengths = [], [], []
        for text in batch.column(1).to_pylist():
            t, starts, _ = make([text])
            t, n = _sampled(t, starts, MOST_TERMS)
            marks.append(zlib.crc32(text.encode()))
            terms.append(t)
            lengths.append(n)
        arrays = [batch.column(0), pa.array(marks, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "terms", "lengths", *batch.schema.names[2:]])


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, seed: str = "abuse-v1") -> FactorizationMachine:
    """Fit on at most ``most`` labelled documents, those with the smallest seeded hashes.

    A document is abusive if most of its votes say so; ties have no weight, more votes have more. Labels that
    cross-fitted machines clearly contradict are left out. The bound makes the sample, its votes (broadcast to the scan
    of the documents, so no text is shuffled) and the time to fit independent of the data's size. Terms are made where the
    texts are, at most ``MOST_TERMS`` of a document come to the driver, and the folds are fitted as tasks. Copies of one
    text share a fold. Without labels of both kinds every document scores as the prior.
    """
    spark = documents.sparkSession
    sample = votes(labels).withColumn("_h", hash63(seed, F.col("doc_id").cast("string"))).orderBy("_h", "doc_id").limit(most).drop("_h")
    few = F.broadcast(sample)  # at most ``most`` rows
    read = documents.select("doc_id", "text").filter("text is not null").join(few, "doc_id").select("doc_id", "text", "abusive", "n")
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = read.mapInArrow(_labelled_terms, f"doc_id {kind}, mark long, terms array<int>, lengths array<int>, abusive long, n long").toArrow().sort_by("doc_id")
    n = np.asarray(rows["n"]).astype(float)
    share = np.asarray(rows["abusive"]) / np.maximum(n, 1)
    y = (share > 0.5).astype(float)
    weight = np.abs(2 * share - 1) * np.sqrt(np.minimum(n, 3))
    if not (weight[y > 0.5] > 0).any() or not (weight[y <= 0.5] > 0).any():
        return FactorizationMachine()
    flat = lambda c: np.concatenate([np.zeros(0, np.int32), *[np.asarray(x.flatten()) for x in rows[c].chunks]])
    lengths = flat("lengths")
    per = np.concatenate([np.asarray(x.value_lengths()) for x in rows["lengths"].chunks])
    data = (flat("terms"), np.cumsum(lengths) - lengths, np.repeat(np.arange(len(y)), per).astype(np.int32))
    fold = np.asarray(rows["mark"]) % FOLDS
    sent = spark.sparkContext.broadcast((data, y, weight, fold))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, y, weight, fold = sent.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(contradicted(data, y, weight, fold == k), pa.int64())], ["number"])

    wrong = [r.number for r in spark.range(0, FOLDS, 1, FOLDS).mapInArrow(check, "number long").collect()]  # at most ``most``
    weight[wrong] = 0.0
    return fit(data, y, weight)


def score(documents: DataFrame, model: FactorizationMachine, *keep: str) -> DataFrame:
    """``doc_id, score`` and the columns ``keep``: the probability that a document is abusive, for every document.

    The whole text is read; a document scores as its most abusive sentence. Null, empty and wordless texts score 0. Nothing
    is shuffled; the model that is broadcast has a fixed size.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.b, model.w, model.v, model.seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine.__new__(FactorizationMachine)
        machine.b, machine.w, machine.v, machine.seen = sent.value
        terms = Terms()
        for batch in batches:
            scores = document_scores(machine, terms, batch.column(0).to_pylist())
            columns = [*batch.columns[1:], pa.array(np.round(scores, 6))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "score"])

    read = documents.select("text", "doc_id", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return read.mapInArrow(run, f"{schema}, score double")


def rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, abusive ones, their rate and the mean score."""
    flagged = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return scored.groupBy(source).agg(
        F.count("*").alias("n_documents"), flagged.alias("n_abusive"), F.round(flagged / F.count("*"), 9).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
