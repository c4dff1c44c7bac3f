"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Families of languages. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
UNKNOWN = "und"
BITS = 12
#: Training documents per language, about: chosen by a hash of doc_id, whole texts. Bounds what the driver holds.
MAX_PER_LANGUAGE = 500
#: Documents that are learned from in all, and languages: the most frequent ones. Two rows of at most 8 KB a document.
MAX_LEARNED, MAX_LANGUAGES = 10_000, 200
SNIPPET_WORDS = 6
STRIDE = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def features(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the lower-cased whole text, taken in strides of bounded size."""
    data, out = f" {text.lower()} ".encode("utf-8", "replace"), np.zeros(1 << BITS, np.int64)
    for lo in range(0, len(data), STRIDE):
        b = np.frombuffer(data[lo : lo + STRIDE + 2], np.uint8).astype(np.uint32)
        two = (b[:-1] << 8) | b[1:]
        three = ((two[:-1] << 8) | b[2:]) + np.uint32(0x5BD1E995)
        for grams in (two[:STRIDE], three[:STRIDE]):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine (squared hinge, L2) for y of +1 and -1, by accelerated gradient descent.
    Both classes weigh the same."""
    mean = x.mean(0)
    a = np.hstack([x - mean, np.ones((len(x), 1), np.float32)])
    weight = (cost / 2 * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))).astype(np.float32)
    y = y.astype(np.float32)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (weight * (a @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step, w, u = np.float32(1 / (1 + 2.2 * top)), np.zeros(a.shape[1], np.float32), np.zeros(a.shape[1], np.float32)
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (a @ u))
        new = u - step * (u - 2 * a.T @ (weight * y * miss))
        u, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w[:-1].astype(np.float32), float(w[-1] - w[:-1] @ mean)


@dataclass
class OneVersusOne:
    """A machine for each pair of classes; a class's votes decide, then its margins."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None

    @classmethod
    def train(cls, x: np.ndarray, labels: np.ndarray) -> "OneVersusOne":
        out = cls(sorted(set(labels)))
        made = []
        for i, j in itertools.combinations(range(len(out.classes)), 2):
            either = (labels == out.classes[i]) | (labels == out.classes[j])
            made.append(train_svm(x[either], np.where(labels[either] == out.classes[i], 1.0, -1.0)))
            out.pairs.append((i, j))
        if made:
            out.weights, out.offsets = np.stack([w for w, _ in made], 1), np.array([b for _, b in made])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class index and its least confidence against any other, 0 to 1."""
        n, k = len(x), len(self.classes)
        if not self.pairs:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights + self.offsets
        votes, least = np.zeros((n, k)), np.full((n, k), np.inf)
        for p, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margins[:, p]), (j, -margins[:, p])):
                votes[:, c] += (m > 0) + np.tanh(m) * 1e-3
                least[:, c] = np.minimum(least[:, c], m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(n), best], -10, 10)))


@dataclass
class Discriminator:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.within else []
        if some:
            x = scaled(np.stack([features(texts[i]) for i in some]))
            which, sure = self.families.predict(x)
            for f, name in enumerate(self.families.classes):
                own = np.flatnonzero(which == f)
                if len(own):
                    lang, more = self.within[name].predict(x[own])
                    for i, c, s in zip(own, lang, sure[own] * more):
                        langs[some[i]], scores[some[i]] = self.within[name].classes[c], float(s)
        return langs, scores


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = batch.to_pydict()
        for lang, text in zip(got["lang"], got["text"]):
            if any(map(str.isalpha, text)):
                words = text.split()
                middle = max(0, len(words) // 2 - SNIPPET_WORDS // 2)
                short = " ".join(words[middle : middle + SNIPPET_WORDS])
                rows = [zlib.compress(np.minimum(features(t), 65535).astype("<u2").tobytes(), 1) for t in (text, short)]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * 2, "x": rows}, schema=pa.schema({"lang": pa.string(), "x": pa.binary()}))


def _label(batches: Iterator[pa.RecordBatch], model: Discriminator) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()})
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            langs, scores = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=kinds)


def train(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Discriminator:
    """Learn from text and lang of docs (rows with nulls or without a letter are passed over). Of each of the MAX_LANGUAGES
    most frequent languages about max_per_language documents are taken, by a hash of doc_id, and about MAX_LEARNED in
    all; each counts whole and as a snippet from its middle."""
    ship(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r.lang: r.n for r in most.collect()}
    if not counts:
        return Discriminator(OneVersusOne([]), {})
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, max_per_language / n, MAX_LEARNED / len(counts) / n))))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = known.filter(lot < share[F.col("lang")]).select("lang", "text").mapInArrow(_measure, "lang string, x binary")
    got = sorted(((r.lang, bytes(r.x)) for r in sample.collect()), key=lambda r: r)
    if not got:
        return Discriminator(OneVersusOne([]), {})
    x = scaled(np.stack([np.frombuffer(zlib.decompress(b), "<u2") for _, b in got]))
    langs = np.array([lang for lang, _ in got])
    families = np.array([family_of(lang) for lang in langs])
    return Discriminator(OneVersusOne.train(x, families), {f: OneVersusOne.train(x[families == f], langs[families == f]) for f in set(families)})


def identify(docs: DataFrame, **options) -> DataFrame:
    """The language of every whole text of documents (doc_id, text, lang).

    A quarter is held out: documents whose crc32(doc_id as text) mod 4 is 2 (a null doc_id isn't, nor is it learned
    from). The model sees only the text and lang of the others, and a prediction only the text. Returns doc_id,
    held_out, lang_pred (`und`, with score 0, if text is null or has no letter, or nothing could be learned) and score.
    """
    ship(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out), **options)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(lambda batches: _label(batches, model), "doc_id long, held_out boolean, lang_pred string, score double")
