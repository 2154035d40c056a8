"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings counts the triples of letters that both hold in order, each weighted down with the distance it
spans, and is divided by the strings' own norms. Characters that are no letters, and letters in between, only widen the
span: `i.d.i.o.t`, `id-xiot` and `i d i o t` stay close to the word. A text's kernel with a landmark is that of its closest
word (or run of single letters), since one insult is enough. Landmarks are strings that stand out in texts labelled toxic;
texts are embedded by the inverse root of the landmarks' kernel matrix, a linear machine with squared hinge loss is
trained there on the labels, and its margin is put on a scale from 0 to 1 by a logistic fit.

Training takes at most about `toxic` + `clean` labelled rows (a documented bound, drawn by a hash of the id) and runs as one
task that returns the model; scoring reads every row and whole text in one pass without a shuffle.
"""

from __future__ import annotations

import io
from collections import Counter
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import WORDS_AT_ONCE, Memo, by_bytes, fold, resident, small_batches, table, texts_of, written

SPAN, DECAY = 7, 0.7
SYMBOLS = 32
WIDTHS = (8, 12, 16, 24)
#: Kernels below this count as none.
NEAR = 0.5
LANDMARKS = 96
SHORTEST, LONGEST = 4, 9  # letters of a landmark
#: A run of so many single letters is read as one word.
SPELLED = 4
#: Bytes of text that the one training task reads, about.
TRAINING_BYTES = 256 << 20


def _symbols() -> np.ndarray:
    """Letters a-z as 1 to 26, other letters by a rule from 27 to 31, all else 0."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        low = ord(chr(c).lower()[0])
        if chr(c).isalpha():
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % 5
    return out


_TABLE = _symbols()
_TRIPLES = {}
for _w in WIDTHS:
    _t = [(i, j, k) for i in range(_w) for j, k in combinations(range(i + 1, min(_w, i + SPAN)), 2)]
    _TRIPLES[_w] = np.array(_t).T, np.array([DECAY ** (k - i - 2) for i, _, k in _t], np.float32)


def _trimmed(token: str) -> str:
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b].lower()


def triples(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the letter triples of words of at most `width` characters; a triple with a gap in it has weight 0."""
    code = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "replace"), "<u4").reshape(-1, width)
    s = np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], 27 + (code % 5).astype(np.int32))
    (i, j, k), weight = _TRIPLES[width]
    a, b, c = s[:, i], s[:, j], s[:, k]
    return (a * SYMBOLS + b) * SYMBOLS + c, weight * ((a > 0) & (b > 0) & (c > 0))


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of the kernel of each word with itself."""
    order = np.argsort(codes, axis=1)
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1).astype(np.float64)
    group = np.cumsum(np.diff(c, axis=1, prepend=-1) != 0, axis=1) - 1 + np.arange(len(c))[:, None] * c.shape[1]
    sums = np.bincount(group.ravel(), w.ravel(), c.size).reshape(c.shape)
    return np.sqrt((sums**2).sum(axis=1))


def width_of(n: int) -> int:
    return next(w for w in WIDTHS if n <= w)


def embedded(words: list[str]) -> np.ndarray:
    """Unit vectors over all triples, a column each; for landmarks only."""
    out = np.zeros((SYMBOLS**3, len(words)), np.float32)
    for at, w in enumerate(words):
        c, v = triples([w], width_of(len(w)))
        np.add.at(out[:, at], c[0], v[0])
        out[:, at] /= max(np.linalg.norm(out[:, at]), 1e-9)
    return out


class Kernels:
    """Kernel rows of distinct tokens with the landmarks; most tokens are near none and share row 0."""

    def __init__(self, landmarks: list[str]):
        self.columns = embedded(landmarks)
        self.upper = self.columns.max(axis=1) if landmarks else np.zeros(SYMBOLS**3, np.float32)
        self.at = Memo()
        self.clear()

    def clear(self) -> None:
        self.rows = [np.zeros(self.columns.shape[1], np.float32)]

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Kernels of words with all landmarks, those below NEAR as 0. Words beyond the largest width are read in overlapping windows."""
        parts, owner = [], []
        top = WIDTHS[-1]
        for n, w in enumerate(words):
            for a in range(0, max(1, len(w) - top // 2), top // 2) if len(w) > top else (0,):
                parts.append(w[a : a + top])
                owner.append(n)
        out = np.zeros((len(words), self.columns.shape[1]), np.float32)
        sizes, owners = np.fromiter(map(len, parts), np.int64, len(parts)), np.array(owner, np.int64)
        low = 2
        for width in WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(own), 1024):
                some = own[start : start + 1024]
                codes, weights = triples([parts[x] for x in some], width)
                bound = (self.upper[codes] * weights).sum(axis=1) / np.sqrt(np.maximum((weights**2).sum(axis=1), 1e-9))
                ok = np.flatnonzero(bound >= NEAR)
                for a in range(0, len(ok), 256):
                    part = ok[a : a + 256]
                    k = np.einsum("nt,ntm->nm", weights[part], self.columns[codes[part]], optimize=True) / np.maximum(norms(codes[part], weights[part]), 1e-9)[:, None]
                    np.maximum.at(out, owners[some[part]], np.where(k >= NEAR, k, 0))
        return out

    def _add(self, tokens: list[str]) -> None:
        for start in range(0, len(tokens), WORDS_AT_ONCE):
            self._add_some(tokens[start : start + WORDS_AT_ONCE])

    def _add_some(self, tokens: list[str]) -> None:
        words = [_trimmed(t) for t in tokens]
        rows = self.rows_of(words)
        near = rows.any(axis=1)
        at = []
        for w, ok, row in zip(words, near.tolist(), rows, strict=True):
            if ok:
                at.append(len(self.rows))
                self.rows.append(row.copy())
                self.at.held += 200 + row.nbytes
            else:
                at.append(-1 if len(w) == 1 else 0)
        self.at.fill(tokens, at)

    def of(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its closest word's kernel with each landmark."""
        if self.at.room():
            self.clear()
        split = [t.split() for t in texts]
        self._add(list(set(chain.from_iterable(split)).difference(self.at)))
        out, get = np.zeros((len(texts), self.columns.shape[1]), np.float32), self.at.__getitem__
        for i, words in enumerate(split):
            ids = list(map(get, words))
            hits = set(ids)
            if -1 in hits:
                hits.discard(-1)
                spelled = self._spelled(words, ids)
                if spelled:
                    out[i] = self.rows_of(spelled).max(axis=0)
            hits.discard(0)
            for h in hits:
                np.maximum(out[i], self.rows[h], out=out[i])
        return out

    @staticmethod
    def _spelled(words: list[str], ids: list[int]) -> list[str]:
        """Runs of at least SPELLED single letters, as words."""
        single = np.concatenate(([0], (np.array(ids) == -1).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(single))
        return ["".join(map(_trimmed, words[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= SPELLED]


def landmarks_of(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Strings of letters within words that texts labelled toxic hold far more often than others, unlike each other."""
    import regex

    letters = regex.compile(r"\p{L}+").findall
    seen = {True: Counter(), False: Counter()}
    for text, y in zip(texts, toxic, strict=True):
        seen[bool(y)].update({"".join(letters(t)).lower() for t in text.split()})
    count: dict[str, list[int]] = {}
    for y, words in seen.items():
        for w, n in words.items():
            for g in {w[a : a + k] for k in range(SHORTEST, LONGEST + 1) for a in range(len(w) - k + 1)}:
                if y or g in count:
                    count.setdefault(g, [0, 0])[0 if y else 1] += n
        if y:
            count = {g: c for g, c in count.items() if c[0] >= 5}
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    odds = lambda c: np.log((c[0] + 0.5) / n1) - np.log((c[1] + 0.5) / n0)
    good = sorted(((min(c[0], 50) * odds(c), len(g), g) for g, c in count.items() if odds(c) > 2), reverse=True)
    chosen: list[str] = []
    vectors = np.zeros((SYMBOLS**3, most), np.float32)
    for _, _, g in good[: 40 * most]:
        codes, weights = triples([g], width_of(len(g)))
        own, inverse = np.unique(codes[0], return_inverse=True)
        v = np.bincount(inverse, weights[0])
        v /= max(np.linalg.norm(v), 1e-9)
        if not chosen or (v @ vectors[own, : len(chosen)]).max() < 0.8:
            vectors[own, len(chosen)] = v
            chosen.append(g)
            if len(chosen) == most:
                break
    return chosen


class Machine:
    def __init__(self, landmarks: list[str], root: np.ndarray, weight: np.ndarray, scale: tuple[float, float]):
        self.landmarks, self.root, self.weight, self.scale = landmarks, root, weight, scale
        self.kernels = Kernels(landmarks)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.kernels.of(texts).astype(np.float64) @ self.root
        margin = z @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -50, 50)))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, landmarks=np.array(self.landmarks, dtype=str), root=self.root, weight=self.weight, scale=np.array(self.scale))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(x["landmarks"].tolist(), x["root"], x["weight"], tuple(x["scale"]))


def fit(texts: list[str], toxic: np.ndarray, cost: float = 1.0) -> Machine:
    """Landmarks, Nyström embedding, squared-hinge machine (Newton steps), logistic scale. Without both labels every score is the share of toxic rows."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    chosen = landmarks_of(texts, toxic)
    if not chosen:
        return Machine([], np.zeros((0, 0)), np.zeros(1), (0.0, float(np.log(share / (1 - share)))))
    own = embedded(chosen)
    value, vector = np.linalg.eigh((own.T @ own).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    kernels = Kernels(chosen)
    x = np.vstack([kernels.of(texts[a : a + 500]) for a in range(0, len(texts), 500)]).astype(np.float64) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(toxic, 1.0, -1.0)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(ridge + 2 * cost * a.T @ a, 2 * cost * a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    margin, p = x @ w, np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    s = np.array([1.0, 0.0])
    for _ in range(50):  # logistic fit of the label on the margin
        q = 1 / (1 + np.exp(-np.clip(s[0] * margin + s[1], -50, 50)))
        m = np.column_stack([margin, np.ones_like(margin)])
        step = np.linalg.solve((m * (q * (1 - q) + 1e-9)[:, None]).T @ m + 1e-6 * np.eye(2), m.T @ (p - q))
        s += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Machine(chosen, root, w, (float(s[0]), float(s[1])))


def train(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 6000, most_bytes: int = TRAINING_BYTES, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The model, from about so many labelled documents of either kind at most, whose fold() is not 0, and about `most_bytes` of text at most.

    Null ids and labels are passed over; an id that is labelled twice is toxic if any label says so, and of the texts of a
    repeated id one (the least) is read. Null texts are empty ones; texts are read whole. Without a labelled document, or
    with one kind only, there is nothing to tell apart, and every text gets the same score.
    """
    marks = labels.select(labels[id_col].alias("doc_id"), (labels["toxic"] == 1).alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    some = marks.where(draw < F.when(F.col("toxic"), toxic / max(n.get(True, 0), 1)).otherwise(clean / max(n.get(False, 0), 1)))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "training")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003 < most_bytes / max(size, 1))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        return pd.DataFrame({"model": [fit(frame["text"].tolist(), frame["toxic"].to_numpy(bool)).dumps()]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model binary").collect()
    return bytes(got[0]["model"]) if got else fit([], np.zeros(0, bool)).dumps()


def toxicity(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """(id, score, predicted) of every row: predicted is 1 from a score of `reject` on.

    A null text is scored as an empty one, long texts whole, and repeated rows each. An empty table gives an empty result. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), ("toxicity", hash(model))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = resident(key, lambda: Machine.loads(sent.value))
        for batch in by_bytes(batches, "text", 1 << 19):
            score = machine.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), pa.array((score >= reject).astype("i4"), pa.int32())], ["id", "score", "predicted"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: bytes, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows scored below `reject`, with all their columns; rows are scored where they lie, so no text is shuffled."""
    small_batches(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), ("toxicity", hash(model))

    def run(batches):
        machine = resident(key, lambda: Machine.loads(sent.value))
        for batch in by_bytes(batches, text_col, 1 << 19):
            yield batch.filter(pa.array(machine.score(texts_of(batch, text_col)) < reject))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
