"""Languages of documents and of the segments within them, by word-first backoff.

A model of per-language log frequencies is counted from a bounded sample of labelled documents. A sentence's known words
are scored by their log frequency in each language; a word never seen falls back to its longest known character n-grams,
shorter and shorter. Labels are noisy, so the counts are made again after the sample's sentences have been assigned by
the first model.

Scale: one pass over the texts, no shuffle of text; the model has at most ``MAX_WORDS`` words and ``MAX_GRAMS``
n-grams, which bounds what goes through the driver and is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.prose import sentences
from ionweave.session import materialise

#: Codes and names of the languages told apart.
LANGUAGES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "ja": ("ja", "jp", "jpn", "japanese", "日本語"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
}
CODES = tuple(LANGUAGES)
#: Labelled documents that the model is counted from, about (a hash of the id decides).
TRAIN_DOCS = 6_000
MAX_WORDS = 200_000
MAX_GRAMS = 300_000
#: Longest n-gram of the backoff.
LONGEST = 5
#: Log-odds that a sentence needs to speak for a language of its own; below, it follows the document.
MARGIN = 4.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Kana and Han characters.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]")


def label_code(label: Column) -> Column:
    """The language that a label names, in any case and notation (``en_GB``, ``German``, ``jpn``); else null."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"\A([\p{L}]+)(?:[-_][\p{L}0-9]+)*\z", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        out = F.when(base.isin(*names), code).otherwise(out)
    return out


def words(sentence: str) -> list[str]:
    """Words in lower case; runs of a script without spaces count as overlapping pairs of characters."""
    out = []
    for w in _WORD.findall(sentence.lower()):
        if _UNSPACED.search(w) and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies; ``score`` gives one value per language of ``CODES``."""

    def __init__(self, word_counts: dict[str, dict[str, float]], gram_counts: dict[str, dict[str, float]]):
        def table(counts: dict[str, dict[str, float]], smooth: float) -> dict[str, np.ndarray]:
            totals = Counter()
            for by in counts.values():
                totals.update(by)
            n = np.array([max(totals[c], 1.0) for c in CODES])
            # what a language lacks is equally unlikely in all: small languages are not favoured
            floor = smooth / float(np.median([v for v in totals.values() if v] or [1.0]))
            return {k: np.log(np.array([by.get(c, 0.0) for c in CODES]) / n + floor) for k, by in counts.items()}

        self.grams: dict[str, np.ndarray] = {}
        by_length: dict[int, dict] = {}
        for g, by in gram_counts.items():
            by_length.setdefault(len(g), {})[g] = by
        for counts in by_length.values():
            self.grams |= table(counts, 0.5)
        known = table(word_counts, 0.05)
        self.rows = {w: i for i, w in enumerate(known)}
        self.n_known = len(known)
        self.matrix = self._clip(np.array(list(known.values())).reshape(-1, len(CODES)))

    @staticmethod
    def _clip(m: np.ndarray) -> np.ndarray:
        """Relative to each word's best language; one odd word never decides alone."""
        return np.maximum(m - m.max(axis=1, keepdims=True), -6.0) if len(m) else m

    def unseen(self, w: str) -> np.ndarray:
        """Score of an unseen word: over its known n-grams of the greatest length that has any."""
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams(w, n) if g in self.grams]
            if known:
                return np.sum(known, axis=0) / math.sqrt(len(known))
        return np.zeros(len(CODES))

    def row(self, w: str) -> int:
        got = self.rows.get(w)
        if got is None:
            if len(self.rows) >= self.n_known + MAX_WORDS:  # forget the unseen words met so far
                self.rows = {k: i for k, i in self.rows.items() if i < self.n_known}
            got = self.rows[w] = len(self.rows)
            if got >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros((max(1024, len(self.matrix)), len(CODES)))])
            self.matrix[got] = self._clip(self.unseen(w)[None, :])[0]
        return got

    def score(self, sentence: str) -> np.ndarray:
        at = [self.row(w) for w in words(sentence)]
        return self.matrix[at].sum(axis=0) if at else np.zeros(len(CODES))

    def margin(self, score: np.ndarray) -> tuple[int, float]:
        best = int(np.argmax(score))
        return best, float(score[best] - np.partition(score, -2)[-2])


def document(model: Model, text: str | None) -> tuple[list[tuple[str, float, int, int]], dict[str, float]]:
    """Segments ``(lang, confidence, first sentence, number)`` and the score of each language of the document.

    Neighbouring sentences of one language form a segment. A sentence whose margin is below ``MARGIN`` follows the
    document's prevailing language.
    """
    scored = [model.score(s) for s in sentences(text)]
    if not scored:
        return [], {}
    own = [model.margin(x) for x in scored]
    clear = Counter()
    for best, m in own:
        clear[best] += m if m >= MARGIN else 0.0
    total = np.sum(scored, axis=0)
    main = max(clear, key=lambda k: (clear[k], -k)) if any(clear.values()) else int(np.argmax(total))
    langs = [best if m >= MARGIN else main for best, m in own]
    out, at = [], 0
    while at < len(langs):
        end = at
        while end < len(langs) and langs[end] == langs[at]:
            end += 1
        x = np.sum(scored[at:end], axis=0)
        p = np.exp(x - x.max())
        out.append((CODES[langs[at]], float(p[langs[at]] / p.sum()), at, end - at))
        at = end
    return out, {CODES[k]: v for k, v in clear.items()}


def _count(rows: Iterable[tuple[str, str]]) -> pd.DataFrame:
    """``lang, kind, feature, n`` of sentences with a language."""
    each: Counter = Counter()
    for lang, s in rows:
        each.update((lang, w) for w in words(s))
    c: Counter = Counter()
    for (lang, w), k in each.items():
        c[lang, "w", w] += k
        for n in range(1, LONGEST + 1):
            for g in grams(w, n):
                c[lang, "g", g] += k
    return pd.DataFrame([(*k, v) for k, v in c.items()], columns=["lang", "kind", "feature", "n"])


def _counter(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for code, text in zip(pdf["code"], pdf["text"]):
                for s in sentences(text):
                    if model is None:
                        rows.append((code, s))
                    else:
                        best, m = model.value.margin(model.value.score(s))
                        if m >= MARGIN:
                            rows.append((CODES[best], s))
            yield _count(rows)

    return run


def _model(counts: DataFrame) -> Model:
    total = counts.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n")).groupBy("kind", "feature").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    total = materialise(total.where("n > 1"), "features")  # read for the words and for the n-grams
    tables = []
    for kind, most in (("w", MAX_WORDS), ("g", MAX_GRAMS)):
        top = total.where(F.col("kind") == kind).orderBy(F.desc("n"), "feature").limit(most)
        tables.append({r["feature"]: r["by"] for r in top.select("feature", "by").collect()})
    return Model(*tables)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from about ``train_docs`` documents whose label names a language; the whole text of each is used."""
    named = label_code(F.col(label)).isNotNull()
    share = min(1.0, train_docs / max(1, docs.where(named).select(key).count()))  # reads ids and labels only
    chosen = docs.where(named & (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))))
    sample = materialise(chosen.where(F.col(text).isNotNull()).select(label_code(F.col(label)).alias("code"), F.col(text).alias("text")), "sample")  # of a bounded size; both counts read it
    schema = "lang string, kind string, feature string, n long"
    first = _model(sample.mapInPandas(_counter(None), schema))
    spark = docs.sparkSession
    return _model(sample.mapInPandas(_counter(spark.sparkContext.broadcast(first)), schema))


SEGMENTS = "key {kind}, code string, segment int, lang string, confidence double, first_sentence int, n_sentences int"


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """``key, code, segment, lang, confidence, first_sentence, n_sentences`` of every document with prose.

    ``code`` is the language that the label names, null where it names none. Null, empty and blank texts, and texts without
    prose, give no rows.
    """
    model = model or fit(docs, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, code, t in zip(pdf["key"], pdf["code"], pdf["text"]):
                for i, (lang, p, first, n) in enumerate(document(shared.value, t)[0]):
                    out.append((k, code, i, lang, p, first, n))
            yield pd.DataFrame(out, columns=["key", "code", "segment", "lang", "confidence", "first_sentence", "n_sentences"])

    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), label_code(F.col(label)).alias("code"), F.col(text).alias("text"))
    return x.mapInPandas(run, SEGMENTS.format(kind=docs.schema[key].dataType.simpleString())).withColumnRenamed("key", key)


def languages(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, code, lang, n_sentences, confidence``: each language of each document."""
    return segs.groupBy(key, "lang").agg(F.first("code").alias("code"), F.sum("n_sentences").alias("n_sentences"), (F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences")).alias("confidence"))


def mislabelled(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, lang`` of documents in one language whose label names none or another, and of all in several languages."""
    per = segs.groupBy(key).agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.first("code").alias("code"))
    wrong = (F.size("langs") > 1) | F.col("code").isNull() | ~F.array_contains("langs", F.col("code"))
    return per.where(wrong).select(key, F.explode("langs").alias("lang"))
