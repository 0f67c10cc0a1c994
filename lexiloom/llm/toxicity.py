"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon (words and word stems), their proximity to
second-person pronouns, capitals, punctuation, obfuscated words.  The lexicon
is learned with the trees from a bounded sample of labelled rows: stems whose
rate among the words of toxic texts exceeds that of others, weighted by the
log ratio.  Features of a training row use a lexicon learned without its fold,
so the trees see on training rows what they will see on others; the isotonic
map is fitted on scores of trees that have not seen the row.

Bound: at most ``sample`` labelled rows (those with the smallest hash of
doc_id) are learned from, on the driver; everything else is one pass over the
texts without a shuffle, with the model (lexicon of at most ``stems`` entries)
broadcast.  Rows whose crc32(doc_id as text) mod 3 is 1 are never learned
from.

Cases: null and empty texts have zero features and get a score like others; a
null doc_id counts as held out; several labels of a doc_id count as toxic if
one is; repeated rows are scored each; without labelled rows of both classes
every score is the rate of toxic labels, or 0 without labels; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices
from .gbt import Trees, isotonic, train

SAMPLE, STEMS, FOLDS, THRESHOLD = 8_000, 20_000, 3, 0.7
_WORDS = re.compile(r"\w+").findall
_OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$*!]+[^\W_][0-9@$*!\w]*").findall
_LEET = str.maketrans("013457@$!", "oieastasi")
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b").findall
# Second-person words of English, French, German and Spanish.
_YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen usted ustedes tú ti tus vosotros vuestro".split())
_LENGTHS = (4, 5, 6, 7, 8)


@dataclass
class Lexicon:
    """Weight of whole words (``=word``) and of stems."""

    weights: dict[str, float] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        w = self.seen.get(word)
        if w is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            get = self.weights.get
            w = self.seen[word] = max(get("=" + word, 0.0), *(get(word[:k], 0.0) for k in _LENGTHS if k <= len(word)), 0.0)
        return w


def _keys(words: set[str]) -> Counter:
    out: Counter = Counter()
    for w in words:
        out["=" + w] += 1
        for k in _LENGTHS:
            if k <= len(w):
                out[w[:k]] += 1
    return out


def learn_lexicon(words: list[set[str]], toxic: np.ndarray, stems: int = STEMS) -> Lexicon:
    """Stems and words whose rate in toxic texts is at least 3 times that in others, beyond chance."""
    total = [sum(len(w) for w, t in zip(words, toxic) if bool(t) == k) for k in (False, True)]
    if not all(total):
        return Lexicon()
    hits: Counter = Counter()
    texts: Counter = Counter()
    for w, t in zip(words, toxic):
        if t:
            k = _keys(w)
            hits.update(k)
            texts.update(k.keys())
    hits = Counter({k: n for k, n in hits.items() if texts[k] >= 3})
    others: Counter = Counter()
    for w, t in zip(words, toxic):
        if not t:
            others.update({k: n for k, n in _keys(w).items() if k in hits})
    ratio = total[1] / total[0]
    out = []
    for k, a in hits.items():
        b = others[k] * ratio
        lift = math.log((a + 0.5) / (b + 0.5 * ratio + 0.1))
        if lift > math.log(3) and a - b > 3.5 * math.sqrt(b + b * ratio + 1):
            out.append((-lift * math.log(1 + a), k, min(lift, 5.0)))
    return Lexicon({k: w for _, k, w in sorted(out)[:stems]})


def features(text: str, lex: Lexicon) -> list[float]:
    """Dense features of a whole text; N_FEATURES numbers."""
    words = _WORDS(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    weight = lex.weight
    hits = [(i, w) for i, w in ((i, weight(x)) for i, x in enumerate(words)) if w > 0]
    strong = sum(w >= 3 for _, w in hits)
    total = sum(w for _, w in hits)
    you = [i for i, x in enumerate(words) if x in _YOU]
    near = 0
    if hits and you:
        at, y = np.array([i for i, _ in hits]), np.array(you)
        p = np.searchsorted(y, at)
        gap = np.minimum(np.abs(at - y[np.minimum(p, len(y) - 1)]), np.abs(at - y[np.maximum(p - 1, 0)]))
        near = int((gap <= 3).sum())
    odd = _OBFUSCATED(text)
    plain = sum(weight(x.translate(_LEET).replace("*", "").lower()) >= 3 for x in odd)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        100 * total / n, 100 * strong / n, 100 * (len(hits) - strong) / n, math.log1p(total), math.log1p(strong),
        math.log1p(len({words[i] for i, _ in hits})), max((w for _, w in hits), default=0.0),
        near / max(len(hits), 1), 100 * near / n, 100 * len(you) / n, upper / chars, 100 * len(_CAPITALS(text)) / n,
        text.count("!") / chars, sum(map(text.count, ".,;:?-*#%&$")) / chars, 100 * len(odd) / n, float(plain), math.log1p(len(words)),
    ]


N_FEATURES = 17


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    to: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), self.at, self.to), 0, 1)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        rate = float(toxic.mean()) if len(toxic) else 0.0
        return Model(Lexicon(), train(np.zeros((0, N_FEATURES)), np.zeros(0)), np.array([0.0]), np.array([rate]))
    words = [set(_WORDS(t.lower())) for t in texts]
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), N_FEATURES))
    for k in range(FOLDS):
        lex = learn_lexicon([w for w, f in zip(words, fold) if f != k], toxic[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i], lex)
    margin = np.zeros(len(texts))
    for k in range(FOLDS):
        margin[fold == k] = train(x[fold != k], toxic[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(words, toxic), train(x, toxic), *isotonic(margin, toxic))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most ``sample`` labelled documents that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], float)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, 256):
            s = known.value.score(b.column(2).to_pylist())
            yield {"doc_id": b.column(0), "held_out": b.column(1), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(*training_rows(docs, labels, sample)))
