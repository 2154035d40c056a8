"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is its runs of letters in lower case; a run is scored as a word with a start and an end mark and no context beyond
them, so the value of a word depends on nothing else and is computed once a worker. Each language's model is two sorted
arrays of 64-bit hashes (n-grams of all orders with their discounted probabilities, contexts with their back-off weights),
probed by binary search for all n-grams of a batch at once. The language of the lowest cross-entropy per character wins.

A text is rejected when that cross-entropy lies further above what the language's own texts have than nearly any of them. The
excess is measured in standard deviations: between documents, and of a mean over as many characters as the text's distinct
words have, so neither length nor repetition alone lets a text go; far above what even the shortest texts have, it is rejected
in any case. Deviations and limits come from labelled rows that are kept out of the counts.

The models are fitted on a bounded sample of labelled rows (`sample` documents a language, chosen by a hash of the id), one
task a language; prediction reads every row and whole text in one pass without a shuffle.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import MEMO_MOST, WORDS_AT_ONCE, Memo, by_bytes, fold, resident, small_batches, table, texts_of, written

ORDER = 5
#: Labels; beyond, the models of all languages don't fit in a worker, and none is left out but an error raised.
LANG_LIMIT = 1000
START, END = "\x02", "\x03"
UND = "und"
#: Languages whose models share arrays of hashes.
TOGETHER = 8
#: Columns of Scorer.of behind the languages'.
CHARACTERS, RUNS, DISTINCT = -3, -2, -1
#: Bytes of text that the training task of a language reads, about.
TRAINING_BYTES = 64 << 20
#: Of the texts kept for calibration, the share within the limit, and the room left above it.
CALIBRATION_SHARE, CALIBRATION_ROOM = 0.999, 2.0
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(ORDER)], np.uint64)


def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the characters of START + word + END without START: (hash of the last k characters, hash of the k-1 before) by order, and each one's word.

    A hash of order k at a place where the word has fewer characters is 0.
    """
    joined = "".join([f"{START}{w}{END}" for w in words])
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(code)) - np.repeat(ends - sizes, sizes)
    full = np.zeros((ORDER, len(code)), np.uint64)
    running = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            part = code * _MIX[k]
            running[k:] += part[: max(len(code) - k, 0)]
            ok = place >= k
            full[k, ok] = _mixed(running[ok] + np.uint64((k + 1) << 56))
    own = place > 0
    grams = full[:, own]
    contexts = np.zeros_like(grams)
    at = np.flatnonzero(own)
    for k in range(1, ORDER):  # the context of order k+1 is the gram of order k that ends one place before
        contexts[k] = full[k - 1, at - 1]
        contexts[k, place[at] < k] = 0
    return grams, contexts, np.repeat(np.arange(len(words)), sizes - 1)


class Model:
    """One language: sorted gram hashes with discounted probabilities, sorted context hashes with back-off weights."""

    def __init__(self, gram, prob, context, weight, base: float, mean: float = 0.0, between: float = 1.0, within: float = 1.0, limit: float = np.inf, most: float = np.inf):
        self.gram, self.prob, self.context, self.weight, self.base = gram, prob, context, weight, base
        self.mean, self.between, self.within, self.limit, self.most = mean, between, within, limit, most

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, gram=self.gram, prob=self.prob, context=self.context, weight=self.weight, rest=np.array([self.base, self.mean, self.between, self.within, self.limit, self.most]))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return cls(x["gram"], x["prob"], x["context"], x["weight"], *map(float, x["rest"]))

    def calibrate(self, sums: np.ndarray) -> None:
        """From rows of Scorer.of for texts of the language under this model alone."""
        low, n = -sums[:, 0] / sums[:, CHARACTERS], sums[:, DISTINCT]
        self.mean = float(np.median(low))
        square, long = (low - self.mean) ** 2, n >= np.median(n)
        self.between, self.within = max(float(square[long].mean()), 1e-6), max(float((square * n)[n <= np.median(n)].mean()), 1e-6)
        self.limit = float(np.quantile(self.excess(low, n), CALIBRATION_SHARE)) * CALIBRATION_ROOM + 1
        self.most = float(np.quantile(low - self.mean, CALIBRATION_SHARE)) * CALIBRATION_ROOM + 1

    def excess(self, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Cross-entropies above the language's own, in standard deviations, of texts whose distinct words have n characters."""
        return (low - self.mean) / np.sqrt(self.between + self.within / np.maximum(n, 1))

    def log_p(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Of the last character of each gram, given what stands before."""
        p = np.full(grams.shape[1], self.base)
        for k in range(ORDER):
            a = _looked_up(self.gram, self.prob, grams[k], 0.0)
            w = _looked_up(self.context, self.weight, contexts[k], 1.0) if k else self.weight[0]
            there = grams[k] != 0
            p = np.where(there, a + w * p, p)
        return np.log(p)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def fit(words: dict[str, float]) -> Model:
    """Interpolated Kneser-Ney from word counts: continuation counts below the highest order, counts as they are for grams that begin a word."""
    top: Counter = Counter()
    for w, n in words.items():
        x = f"{START}{w}{END}"
        for i in range(1, len(x)):
            top[x[max(0, i - ORDER + 1) : i + 1]] += n
    counts: list[dict[str, float]] = [{} for _ in range(ORDER)]
    for g, n in top.items():
        counts[len(g) - 1][g] = counts[len(g) - 1].get(g, 0) + n
    for k in range(ORDER - 1, 0, -1):  # a gram of order k counts the distinct characters seen before it
        for g in counts[k]:
            counts[k - 1][g[1:]] = counts[k - 1].get(g[1:], 0) + 1
    keys, probs, ckeys, weights = [], [], [0], [1.0]
    for k in range(ORDER):
        grams = counts[k]
        if not grams:
            continue
        n = np.array(list(grams.values()))
        n1, n2 = float((n == 1).sum()), float((n == 2).sum())
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        texts = list(grams)
        keys.append(_gram_hash(texts, k))
        probs.append(np.array([max(grams[g] - discount, 0) / total[g[:-1]] for g in texts]))
        if k:
            contexts = list(total)
            ckeys += _gram_hash(contexts, k - 1).tolist()
            weights += [discount * kinds[h] / total[h] for h in contexts]
        else:
            weights[0] = discount * kinds[""] / max(total[""], 1)
    if not keys:
        keys, probs = [np.zeros(1, np.uint64)], [np.zeros(1)]
    key, prob = np.concatenate(keys), np.concatenate(probs)
    ckey, weight = np.array(ckeys, np.uint64), np.array(weights)
    order, corder = np.argsort(key), np.argsort(ckey, kind="stable")
    return Model(key[order], prob[order], ckey[corder], weight[corder], 1 / 500)


def _gram_hash(grams: list[str], k: int) -> np.ndarray:
    """Of strings of k + 1 characters, as `hashes` has them."""
    code = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, k + 1)
    with np.errstate(over="ignore"):
        return _mixed((code[:, ::-1] * _MIX[: k + 1]).sum(axis=1, dtype=np.uint64) + np.uint64((k + 1) << 56))


class Together:
    """Several languages' models on shared sorted hashes, a column each: a gram is looked up once for all of them."""

    def __init__(self, models: list[Model]):
        self.gram, self.prob = self._merged([(m.gram, m.prob) for m in models], 0.0)
        self.context, self.weight = self._merged([(m.context, m.weight) for m in models], 1.0)
        self.base, self.first = np.array([m.base for m in models]), np.array([m.weight[0] for m in models])

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        out = np.full((len(keys) + 1, len(parts)), missing)  # the last row is what keys that aren't there have
        for j, (k, v) in enumerate(parts):
            out[np.searchsorted(keys, k), j] = v
        return keys, out

    @staticmethod
    def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return values[np.where(keys[at] == wanted, at, len(keys))]

    def log_p(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Model.log_p of every language, a column each."""
        p = np.tile(self.base, (grams.shape[1], 1))
        for k in range(ORDER):
            there = np.flatnonzero(grams[k])
            w = self._looked_up(self.context, self.weight, contexts[k, there]) if k else self.first
            p[there] = self._looked_up(self.gram, self.prob, grams[k, there]) + w * p[there]
        return np.log(p)


class Scorer:
    """Log-probabilities of white-space tokens under every language, each distinct token once."""

    def __init__(self, models: list[Model]):
        self.together = [(k, Together(models[k : k + TOGETHER])) for k in range(0, len(models), TOGETHER)]
        self.models, self.find, self.at = models, _letters(), Memo(3 * MEMO_MOST // 2)
        self.clear()

    def clear(self) -> None:
        self.values = np.zeros((1024, len(self.models) + 2), np.float32)  # a log-probability a language, characters, runs of letters

    def _add(self, new: list[str]) -> None:
        for start in range(0, len(new), WORDS_AT_ONCE):
            self._add_some(new[start : start + WORDS_AT_ONCE])

    def _add_some(self, new: list[str]) -> None:
        runs = [[x.lower() for x in self.find(w)] for w in new]
        first, n = len(self.at), len(new)
        while len(self.values) < first + n:
            self.values = np.vstack([self.values, np.zeros_like(self.values)])
        flat = list(chain.from_iterable(runs))
        if flat:
            owner = np.repeat(np.arange(n), np.fromiter(map(len, runs), np.int64, n))
            grams, contexts, word = hashes(flat)
            whole = (grams * (np.arange(ORDER, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1))).sum(axis=0, dtype=np.uint64)
            _, one, back = np.unique(whole, return_index=True, return_inverse=True)
            grams, contexts = grams[:, one], contexts[:, one]
            to = owner[word]
            for j, some in self.together:
                for c, column in enumerate(some.log_p(grams, contexts).T):
                    self.values[first : first + n, j + c] = np.bincount(to, column[back], n)
            self.values[first : first + n, -2] = np.bincount(to, minlength=n)
            self.values[first : first + n, -1] = np.bincount(owner, minlength=n)
        self.at.fill(new, range(first, first + n))
        self.at.held += n * self.values.itemsize * self.values.shape[1]

    def of(self, texts: list[str]) -> np.ndarray:
        """A row for each text: a log-probability for each language, characters, runs of letters, characters of its distinct words."""
        if self.at.room():
            self.clear()
        split = [t.split() for t in texts]
        self._add(list(set(chain.from_iterable(split)).difference(self.at)))
        out = np.zeros((len(texts), self.values.shape[1] + 1))
        get = self.at.__getitem__
        for i, words in enumerate(split):
            if words:
                rows = np.fromiter(map(get, words), np.int64, len(words))
                out[i, :-1] = self.values[rows].sum(axis=0, dtype=np.float64)
                out[i, -1] = self.values[np.unique(rows), -2].sum(dtype=np.float64)
        return out


def decide(models: list[Model], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, score, cross-entropy, rejected) of rows of Scorer.of."""
    n = np.maximum(sums[:, CHARACTERS], 1)
    entropy = -sums[:, : len(models)] / n[:, None]
    best = entropy.argmin(axis=1)
    low = entropy.min(axis=1)
    shares = np.exp(np.maximum(-(entropy - low[:, None]) * np.sqrt(n)[:, None], -700))
    none = sums[:, RUNS] == 0
    rejected = none.copy()
    for k, m in enumerate(models):
        own = best == k
        rejected[own] |= (m.excess(low[own], sums[own, DISTINCT]) > m.limit) | (low[own] - m.mean > m.most)
    return np.where(none, -1, best), np.where(none, 0.0, 1 / shares.sum(axis=1)), np.where(none, 0.0, low), rejected


def train(docs: DataFrame, sample: int = 2000, most_bytes: int = TRAINING_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, model) for each language of the labelled rows, in the languages' order, from about `sample` documents of each at most, and about `most_bytes` of text.

    Rows whose fold() is 0 are never read for labels, nor rows without a text or a language; texts are read whole. Of the
    texts of a repeated id one (the least) is read. Of the sample a fifth calibrates the limit for rejection, the rest is counted.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    counts = rows.groupBy("lang").count()
    if counts.limit(LANG_LIMIT + 1).count() > LANG_LIMIT:
        raise ValueError(f"over {LANG_LIMIT} languages")
    draw: Column = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = rows.join(F.broadcast(counts), "lang").where(draw * F.col("count") < sample)
    chosen = written(chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "training")
    sizes = chosen.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))  # LANG_LIMIT rows at most
    again = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003
    chosen = chosen.join(F.broadcast(sizes), "lang").where(again * F.col("bytes") < most_bytes)

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        find = _letters()
        aside = np.array([zlib.crc32(f"aside {x}".encode()) % 5 == 0 for x in frame["doc_id"]], bool)
        words: Counter = Counter()
        for t in frame["text"][~aside]:
            words.update(x.lower() for x in find(t))
        model = fit(words)
        texts = frame["text"][aside].tolist()
        if texts:
            sums = Scorer([model]).of(texts)
            sums = sums[sums[:, RUNS] > 0]
            if len(sums):
                model.calibrate(sums)
        return pd.DataFrame({"lang": [key[0]], "model": [model.dumps()]})

    got = chosen.select("doc_id", "text", "lang").groupBy("lang").applyInPandas(fitted, "lang string, model binary").collect()
    return sorted((r["lang"], bytes(r["model"])) for r in got)


def _scorer(key: int, sent) -> tuple[list[str], Scorer]:
    return resident(("language", key), lambda: ([x for x, _ in sent.value], Scorer([Model.loads(m) for _, m in sent.value])))


def with_known_language(docs: DataFrame, models: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns; no text is shuffled. Without a model all rows with a letter stay."""
    small_batches(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(models), hash(tuple(m for _, m in models))

    def run(batches):
        _, scorer = _scorer(key, sent)
        for batch in by_bytes(batches, text_col, 1 << 19):
            sums = scorer.of(texts_of(batch, text_col))
            rejected = decide(scorer.models, sums)[3] if scorer.models else sums[:, RUNS] == 0
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, models: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every row.

    A null text, or one without a letter, is `und` with score 0, rejected; so is any text if no language was learned. The
    score is the winner's share of exp(-cross-entropy), sharpened by the square root of the length. A tie goes to the first
    language in order. Long texts are read whole, repeated rows judged each; an empty table gives an empty result. Other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    key = hash(tuple(m for _, m in models))
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches):
        names, scorer = _scorer(key, sent)
        for batch in by_bytes(batches, "text", 1 << 19):
            n = batch.num_rows
            if names:
                best, score, low, rejected = decide(scorer.models, scorer.of(texts_of(batch)))
            else:
                best, score, low, rejected = np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([names[b] if b >= 0 else UND for b in best], pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(predict, f"id {id_type}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs, train(docs))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
