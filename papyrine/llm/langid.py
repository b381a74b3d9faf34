"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER for each language, kept as sorted arrays of gram hashes with their discounted probabilities and
of context hashes with their back-off weights. A text is its letters in lower case with single spaces between runs of
letters; its score under a language is the mean log-probability of its characters. The lowest cross-entropy wins. A
softmax temperature and a rejection limit for each language are calibrated on training rows that the counts left out.

The fit takes a bounded sample (MAX_DOCS documents a language at about, by hash of the id, whole texts); every whole text
is scored. The number of languages has to be small (each has a model in memory).

Defined results: a null text or one without a letter is `und` with score 0; equal cross-entropies go to the language
that sorts first; without training rows everything is `und`; rows with a null id are scored, not learnt from, and not
held out; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import runtime

ORDER, MAX_DOCS = 4, 2500
#: Share of the sample that calibrates, and of a language's own texts that its limit may reject.
HELD_BACK, REJECT, RARE = 5, 0.002, 50
#: Grams that a worker remembers scores of.
MAX_KNOWN = 1_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter or a mark, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, each text with ORDER - 1 spaces before it and one after; where each text starts."""
    raw = [(" " + t + " ") if t else " " for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    chars = _letters()[np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(raw)), size)
    space = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    chars, owner = chars[keep], owner[keep]
    n = np.bincount(owner, minlength=len(raw))
    starts = np.cumsum(n) - n
    pad = ORDER - 2  # besides the space that each text starts with
    out = np.full(len(chars) + pad * len(raw), 32, np.uint32)
    out[np.arange(len(chars)) + pad * (owner + 1)] = chars
    return out, starts + pad * np.arange(len(raw))


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _K
        h ^= h >> np.uint64(29)
    return h


def windows(chars: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The ORDER characters that end at each scored place, and the place's text."""
    n = np.diff(np.append(starts, len(chars)))
    owner = np.repeat(np.arange(len(starts)), n)
    at = np.arange(len(chars)) - np.repeat(starts, n)
    ends = np.flatnonzero(at >= ORDER - 1)
    return [chars[ends - ORDER + 1 + k] for k in range(ORDER)], owner[ends]


@dataclass
class Tables:
    """Of one language: for each order the sorted gram hashes with their values, and those of contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def log_prob(self, chars: list[np.ndarray]) -> np.ndarray:
        """Natural logs, of the last character of each gram after those before it."""
        p = np.full(len(chars[0]), self.floor)
        for k in range(1, ORDER + 1):
            own, before = gram_hash(chars[ORDER - k :]), gram_hash(chars[ORDER - k : -1]) if k > 1 else np.zeros(len(p), np.uint64)
            p = _find(self.grams[k - 1], own, 0.0) + _find(self.contexts[k - 1], before, 1.0) * p
        return np.log(p)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, none: float) -> np.ndarray:
    hashes, values = table
    if not len(hashes):
        return np.full(len(keys), none)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, values[at], none)


def kneser_ney(chars: np.ndarray, counts: np.ndarray, alphabet: int) -> Tables:
    """From distinct grams (rows of ORDER characters) and how often each occurs."""
    grams, contexts = [], []
    rows, n = chars, counts.astype(np.float64)
    for k in range(ORDER, 0, -1):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
        own = gram_hash([rows[:, j] for j in range(k)])
        before = gram_hash([rows[:, j] for j in range(k - 1)]) if k > 1 else np.zeros(len(rows), np.uint64)
        head, code = np.unique(before, return_inverse=True)
        total, kinds = np.bincount(code, weights=n), np.bincount(code)
        order = np.argsort(own)
        grams.append((own[order], ((n - discount) / total[code])[order]))
        contexts.append((head, discount * kinds / total))
        # the next lower order counts in how many contexts a gram continues
        rows, n = np.unique(rows[:, 1:], axis=0, return_counts=True) if k > 1 else (rows, n)
        n = n.astype(np.float64)
    return Tables(grams[::-1], contexts[::-1], 1.0 / alphabet)


@dataclass
class Model:
    langs: list[str]
    tables: list[Tables]
    slope: float = 10.0
    limits: np.ndarray | None = None


class Scorer:
    """Mean log-probabilities of texts under each language; remembers each gram's values."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.values = np.zeros((1024, len(self.model.langs)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        chars, starts = normalised(texts)
        columns, owner = windows(chars, starts)
        out = np.zeros((len(texts), len(self.model.langs)))
        if not len(owner):
            return out
        code, distinct = pd.factorize(gram_hash(columns))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.known) > MAX_KNOWN:
            self.clear()
        known, listed = self.known, distinct.tolist()
        new = [k for k, h in enumerate(listed) if h not in known]
        if new:
            at = first[new]
            own = np.stack([t.log_prob([c[at] for c in columns]) for t in self.model.tables], 1)
            n = len(known)
            while len(self.values) < n + len(new):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[n : n + len(new)] = own
            known.update((listed[k], n + j) for j, k in enumerate(new))
        row = np.fromiter((known[h] for h in listed), np.int64, len(listed))
        value = self.values[row]
        places = np.maximum(1, np.bincount(owner, minlength=len(texts)))
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(owner, weights=value[code, j], minlength=len(texts)) / places
        return out


def _hashed(column: str, mod: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """lang, text, held_back: at most about max_docs rows a language that may be learnt from. Languages with under RARE rows
    have none held back, so that each is learnt."""
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(_hashed("doc_id", 4) != 2)
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, int(1_000_000 * min(1, max_docs / n))).otherwise(part)
    roll = F.xxhash64(F.col("doc_id"), F.lit("language"))
    return own.where(F.pmod(roll, F.lit(1_000_000)) < part).select("lang", "text", (F.pmod(F.shiftright(roll, 32), F.lit(HELD_BACK)) == 0) & ~F.col("lang").isin([x for x, n in counts.items() if n < RARE])).toDF("lang", "text", "held_back")


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, c0.., n: the distinct grams of each language, counted in Spark."""
    names = [f"c{k}" for k in range(ORDER)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                columns, _ = windows(*normalised(batch.column("text").filter(pa.array(langs == lang)).to_pylist()))
                if len(columns[0]):
                    _, first, n = np.unique(gram_hash(columns), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(pa.array(c[first].astype(np.int32)) for c in columns), pa.array(n)], names=["lang", *names, "n"])

    return rows.mapInArrow(runtime.trimmed(blocks), f"lang string, {', '.join(f'{c} int' for c in names)}, n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    runtime.prepare(docs.sparkSession)
    rows = sample(docs, max_docs)
    grams = count_grams(rows.where("not held_back")).toArrow().to_pandas()  # bounded by the sample
    langs = sorted(grams["lang"].unique())
    names = [f"c{k}" for k in range(ORDER)]
    grams = grams.sort_values(["lang", *names])
    alphabet = len(np.unique(grams[names].to_numpy())) + 1
    tables = []
    for lang in langs:
        own = grams[grams["lang"] == lang]
        tables.append(kneser_ney(own[names].to_numpy().astype(np.uint32), own["n"].to_numpy(), alphabet))
    model = Model(langs, tables)
    if langs:
        calibrate(model, rows.where("held_back"))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Sets the softmax's slope, by likelihood, and each language's limit of cross-entropy."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in scorer(batch.column("text").to_pylist())], pa.binary())], names=["lang", "logs"])

    got = rows.select("lang", "text").mapInArrow(runtime.trimmed(blocks), "lang string, logs binary").toArrow()
    logs = np.frombuffer(b"".join(got["logs"].to_pylist()), np.float64).reshape(-1, len(model.langs))
    place = {x: k for k, x in enumerate(model.langs)}
    truth = np.array([place.get(x, -1) for x in got["lang"].to_pylist()], np.int64)
    logs, truth = logs[truth >= 0], truth[truth >= 0]
    model.limits = np.full(len(model.langs), np.inf)
    if len(truth):
        loss = lambda k: -np.mean(_softmax(k * logs, log=True)[np.arange(len(truth)), truth])
        model.slope = float(min(np.geomspace(0.5, 200, 40), key=loss))
    for k in range(len(model.langs)):
        own = -logs[truth == k, k]
        if len(own) >= 20:
            model.limits[k] = np.quantile(own, 1 - REJECT) + 0.1
    shared.destroy()


def _softmax(z: np.ndarray, log: bool = False) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    z = z - np.log(np.exp(z).sum(1, keepdims=True))
    return z if log else np.exp(z)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character) and rejected for every document."""
    runtime.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value, None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            some = has_letter(texts) & bool(model.langs)
            lang, score, loss, odd = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if some.any():
                scorer = scorer or Scorer(model)
                logs = scorer([t for t, s in zip(texts, some, strict=True) if s])
                best = logs.argmax(1)
                lang[some] = np.array(model.langs, object)[best]
                score[some] = _softmax(model.slope * logs)[np.arange(len(best)), best]
                loss[some] = -logs[np.arange(len(best)), best]
                odd[some] = loss[some] > (model.limits[best] if model.limits is not None else np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(loss, from_pandas=True), pa.array(odd)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(runtime.trimmed(blocks), f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(_hashed("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
