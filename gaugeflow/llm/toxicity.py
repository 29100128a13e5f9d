"""Toxicity by a string-kernel support vector machine on Nystroem landmarks (operator 10).

k(a, b) counts common subsequences of three letters, gaps allowed up to a span of ten, each weighted by
DECAY to the power of its spans; so a string with letters put in between stays near its origin. Marks
that are no letters or digits do not count as letters, and runs of single letters are read as one word. The kernel of strings is
(k(a, b) / sqrt(k(a, a) k(b, b)))^POWER. A word stands for itself and its beginnings of four to seven letters, a text for its
distinct words, a word met n times with weight 1 + log n; the kernel of texts is the weighted sum over all pairs of their strings, and
as such positive definite. Labels are those of whole texts, so a text is the set of its sentences' words.

Landmarks are strings: words and word beginnings that mark toxic training texts. The Nystroem map
K(L, L)^(-1/2) K(L, text) gives the features of a linear SVM, and a logistic curve over the margins of the training texts the
score. As the map is linear in the words, scoring needs one number for each distinct word.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans
from gaugeflow.llm.wordcache import WordTable

#: Labelled rows that the model is fitted on at most (those of the smallest id hash); scoring covers all rows.
TRAIN_ROWS = 8_192
DECAY, SPAN, POWER = 0.8, 9, 8
BEGINNINGS = (4, 5, 6, 7)
#: Landmarks of a model: a parameter of the approximation.
LANDMARKS = 64
#: Log likelihood ratio of a landmark, beyond that of chance among all candidates.
CERTAIN = 8
#: Toxic texts that a further landmark must mark, each halved for each landmark that it has already; words of a text that a landmark may have to begin.
NEW_TEXTS, MOST_TIMES = 1.0, 3
THRESHOLD = 0.7


def _codes() -> np.ndarray:
    """Letter codes 1..63: a-z, digits together with the letters that they often stand for, other letters by rest; 0 is no letter."""
    kind = P._classes()
    out = np.zeros(0x110000, np.uint8)
    letters = np.flatnonzero(kind <= P.NUMBER)
    out[letters] = 27 + letters % 36
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    for a, b in zip("013457", "oieast"):
        out[ord(a)] = ord(b) - 96
    return out


_CODE = _codes()


def _sentence_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, word starts, word ends, sentence of each word, first sentence of each text)."""
    points, offsets = P.code_points([t.lower() for t in texts])
    n = len(points)
    if not n:
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 3, np.zeros(len(texts) + 1, np.int64)
    edge = P.edges(offsets, n)
    kind = P._classes()[points]
    code = _CODE[points]
    letter = code > 0
    gap = (kind >= P.SPACE) | edge
    # A word goes on over marks but not over white space; it counts if it has a letter.
    unit = np.cumsum(gap)
    stop = np.isin(points, (46, 33, 63, 10)) & np.append((kind >= P.SPACE)[1:] | edge[1:], True) | (points == 10)
    begin = np.roll(stop, 1)
    begin[0] = True
    begin |= edge
    sentence = np.cumsum(begin) - 1
    at = np.flatnonzero(letter)
    code, unit, where = code[at], unit[at], sentence[at]
    if not len(at):
        return code, *(np.zeros(0, np.int64),) * 3, np.zeros(len(texts) + 1, np.int64)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(at)]
    sent = where[starts]
    # Runs of single letters in one sentence join into one word.
    single = ends - starts == 1
    joins = single & np.r_[False, single[:-1]] & np.r_[False, sent[1:] == sent[:-1]]
    first = np.flatnonzero(~joins)
    starts, sent = starts[first], sent[first]
    ends = np.r_[starts[1:], len(at)]
    firsts = sentence[np.minimum(offsets, n - 1)]
    firsts[offsets >= n] = sentence[-1] + 1
    return code, starts, ends, sent, firsts


def letters(text: str) -> np.ndarray:
    """The letter codes of one string."""
    return _CODE[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes one after another, starts, ends)."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([np.zeros(0, np.uint8), *parts]), np.cumsum(size) - size, np.cumsum(size)


def subsequences(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(string, three letters as a number, weight) of the subsequences of the strings code[start:end], by their gaps."""
    size = ends - starts
    owner = np.repeat(np.arange(len(starts)), size)
    code = code[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(owner))].astype(np.int32)
    for d2 in range(2, SPAN + 1):
        n = len(owner) - d2
        if n <= 0:
            return
        at = np.flatnonzero(owner[:n] == owner[d2:])
        outer = code[at] << 12 | code[at + d2]
        for d1 in range(1, d2):
            yield owner[at], outer | code[at + d1] << 6, DECAY**d2


class Landmarks:
    """Kernel values of words against fixed strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        n = len(strings)
        table: dict[int, np.ndarray] = {}
        for owner, keys, weight in subsequences(*_joined([letters(s) for s in strings])):
            for k, key in zip(owner.tolist(), keys.tolist()):
                table.setdefault(key, np.zeros(n))[k] += weight
        self.row = np.full(1 << 18, -1, np.int32)
        self.weight = np.zeros((len(table), n), np.float32)
        for r, (key, w) in enumerate(table.items()):
            self.row[key], self.weight[r] = r, w
        own = np.sqrt((self.weight.astype(np.float64) ** 2).sum(axis=0))
        self.weight /= np.where(own > 0, own, 1)

    def of_strings(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kernel of each string (rows) with each landmark."""
        out = np.zeros((len(starts), len(self.strings)))
        parts = list(subsequences(code, starts, ends))
        if not parts:
            return out
        owner, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        weight = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
        # Most strings have nothing in common with any landmark.
        some = np.bincount(owner[self.row[keys] >= 0], minlength=len(starts)) > 0
        keep = some[owner]
        pair, at = np.unique(owner[keep] << 18 | keys[keep], return_inverse=True)
        total = np.bincount(at, weight[keep])
        owner, row = pair >> 18, self.row[pair & (1 << 18) - 1]
        norm = np.sqrt(np.bincount(owner, total**2, len(starts)))
        hit = np.flatnonzero(row >= 0)
        owner, row, total = owner[hit], row[hit], total[hit]
        found, first = np.unique(owner, return_index=True)
        bounds = np.r_[first, len(owner)]
        for a in range(0, len(found), 4096):
            b = min(a + 4096, len(found))
            part = slice(bounds[a], bounds[b])
            out[found[a:b]] = np.add.reduceat(self.weight[row[part]] * total[part, None], bounds[a:b] - bounds[a], axis=0) / norm[found[a:b], None]
        return out**POWER

    def kernel(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kernel of each word (its strings together) with each landmark."""
        out = self.of_strings(code, starts, ends)
        size = ends - starts
        for m in BEGINNINGS:
            long = np.flatnonzero(size > m)
            out[long] += self.of_strings(code, starts[long], starts[long] + m)
        return out

    def map(self) -> np.ndarray:
        """The Nystroem map: kernel values of a text (a row), times this, are its features."""
        lam, vec = np.linalg.eigh(self.of_strings(*_joined([letters(s) for s in self.strings])))
        return (vec * np.where(lam > 1e-6, 1 / np.sqrt(np.maximum(lam, 1e-6)), 0)) @ vec.T


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, starts and ends of words, text of each)."""
    code, starts, ends, sentence, firsts = _sentence_words(texts)
    return code, starts, ends, np.searchsorted(firsts, sentence, side="right") - 1


def _presence(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, weight) of each distinct word of each text."""
    if not len(text):
        return text, word, np.zeros(0)
    most = int(word.max()) + 1
    pair, n = np.unique(text * most + word, return_counts=True)
    return pair // most, pair % most, 1 + np.log(n)


@dataclass
class Model:
    """Scores of texts: a number for each word, and the logistic curve of their weighted sum."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float
    slope: float
    shift: float
    _table: WordTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def _values(self, words: list[bytes]) -> list:
        value = self.landmarks.kernel(*_joined([np.frombuffer(w, np.uint8) for w in words])) @ self.beta
        return value.astype("<f4").view(np.uint32)[:, None].tolist()

    def margins(self, texts: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = WordTable(self._values)
        code, starts, ends, text = _words(texts)
        place = self._table.find(code, starts, ends)
        text, word, weight = _presence(text, place)
        value = self._table.ids(word)[0].view(np.float32).astype(np.float64)
        return np.bincount(text, value * weight, len(texts)) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def text_features(landmarks: Landmarks, texts: list[str]) -> np.ndarray:
    """The kernel of each text with each landmark."""
    code, starts, ends, text = _words(texts)
    out = np.zeros((len(texts), len(landmarks.strings)))
    if len(starts):
        word, first, _, _ = spans.distinct(code, starts, ends)
        value = landmarks.kernel(code, starts[first], ends[first])
        text, word, weight = _presence(text, word)
        some, at = np.unique(text, return_index=True)
        out[some] = np.add.reduceat(value[word] * weight[:, None], at, axis=0)
    return out


def _strings_of(text: str) -> Counter:
    """Words of three or more letters or digits, and their beginnings: candidates for landmarks, with the number of distinct words that each begins."""
    words = {w for w in (w.strip(".,!?;:\"'()%&$#*|-") for w in text.lower().split()) if len(w) >= 3 and w.isalnum()}
    return Counter(x for w in words for x in {w[:k] for k in (*BEGINNINGS, len(w)) if k <= len(w)})


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Strings that mark toxic texts beyond doubt, greedily by what they still cover.

    A string marks a text if it begins at least so many distinct words of it, one to MOST_TIMES: some begin a word of many texts, and several
    of toxic ones alone.
    """
    marked, others = np.flatnonzero(toxic), np.flatnonzero(toxic == 0)
    # A string of one toxic text is no evidence.
    seen = Counter(w for i in marked for w in _strings_of(texts[i]))
    seen = {w for w, n in seen.items() if n > 1}
    holders: dict[tuple[str, int], list[int]] = {}
    for i in marked:
        for w, n in _strings_of(texts[i]).items():
            for times in range(1, min(n, MOST_TIMES) + 1 if w in seen else 0):
                holders.setdefault((w, times), []).append(i)
    good = dict.fromkeys(holders, 0)
    for i in others:
        for w, n in _strings_of(texts[i]).items():
            for times in range(1, min(n, MOST_TIMES) + 1 if w in seen else 0):
                if (w, times) in good:
                    good[w, times] += 1
    # Evidence: the log likelihood ratio of two shares against one, which chance among so many strings does not reach.
    rated = {}
    for x, own in holders.items():
        n = len(own)
        p, q, both = n / len(marked), (good[x] + 0.5) / (len(others) + 1), (n + good[x] + 0.5) / (len(texts) + 1)
        if n > 1 and p > q and n * np.log(p / both) + good[x] * np.log(q / both) > np.log(len(holders)) + CERTAIN:
            rated[x] = np.log(p / q)
    chosen, covered = [], np.zeros(len(texts))
    held = {x: np.array(holders[x]) for x in rated}
    while len(chosen) < most and rated:
        # A text covered n times counts 1 / 2^n.
        gain = {x: float((0.5 ** covered[held[x]]).sum()) * r for x, r in rated.items()}
        x = max(gain, key=lambda y: (gain[y], y))
        if (0.5 ** covered[held[x]]).sum() < NEW_TEXTS:
            break
        # The longest string that marks nearly the same texts.
        x = max((y for y in rated if y[0].startswith(x[0]) and len(held[y]) >= 0.9 * len(held[x])), key=lambda y: (len(y[0]), gain[y], y))
        chosen.append(x[0])
        covered[held[x]] += 1
        rated = {y: r for y, r in rated.items() if not (y[0].startswith(x[0]) or x[0].startswith(y[0]))}
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss with an L2 penalty on all but the bias, by Newton steps on the rows inside the margin."""
    z = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    ridge = np.diag(np.r_[np.full(x.shape[1], penalty), 1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        zi, ci = z[inside], weight[inside]
        new = np.linalg.solve((zi * ci[:, None]).T @ zi + ridge, (zi * ci[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> Model:
    """The model of labelled texts; without both labels, or strings that tell them apart, it scores the share of toxic texts everywhere."""
    toxic = np.asarray(toxic).astype(int)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    strings = choose_landmarks(texts, toxic, most) if len(set(toxic.tolist())) == 2 else []
    if not strings:
        return Model(Landmarks(["none"]), np.zeros(1), 0.0, 0.0, float(np.log(share / (1 - share))))
    marks = Landmarks(strings)
    to_features = marks.map()
    # A few hundred texts at a time: the driver's memory stays small.
    x = np.vstack([text_features(marks, texts[k : k + 256]) for k in range(0, len(texts), 256)]) @ to_features
    w, b = _svm(x, 2 * toxic - 1, np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (toxic == 0).sum()))
    # Logistic curve of the margins, by Newton steps with a small penalty.
    z = np.c_[x @ w + b, np.ones(len(x))]
    target = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((toxic == 0).sum() + 2))
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        theta -= np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - target) + 1e-3 * theta), -2, 2)
    return Model(marks, to_features @ w, b, float(max(theta[0], 0)), float(theta[1]))


def train(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fits on labelled documents (labels: doc_id, toxic), at most `rows` of them; usable: which label rows may be learned from."""
    labels = labels.where("toxic is not null and doc_id is not null")
    if usable is not None:
        labels = labels.where(usable)
    # Bounded, so it may go to all tasks; the same rows are picked at any partitioning.
    picked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # One text for each id, so that what comes here is bounded too.
    data = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    frame = data.to_pandas().sort_values("doc_id", kind="stable")
    return fit([t or "" for t in frame["text"]], frame["toxic"].to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and the score, 0 to 1, of the whole text as column `name` (in place of one so named); null counts as empty. Rows keep their order and number."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = [c for c in docs.columns if c != name]
    docs = docs.select(*names)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in state:
            state["model"] = pickle.loads(shared.value)
        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                s = state["model"].scores([t or "" for t in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], names=[*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text).

    Null and empty texts get the score of a text without evidence. A null doc_id is not held out. Labels that are
    null are not learned from; a doc_id labelled twice counts as toxic if either label says so. Without labels of both kinds the score
    is one number for all. An empty table gives no rows.
    """
    model = train(docs, labels, ~held_out())
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
