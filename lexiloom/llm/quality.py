"""Quality rules: divergence of a document's histograms from its language's reference.

Two histograms of a document - characters by class, and its counts of the
language's common words - are compared with the reference of its language by
Jensen-Shannon distance (base 2, so 0 to 1).  References are counted over all
documents of the language that pass the base rules and consist mostly of
letters; a common word is one of the ``top`` most frequent words, of any length
and script.  A document is rejected where a distance exceeds its
threshold; thresholds widen with 1 / sqrt(words), as the distance of a small
sample does, and texts under ``min_words`` are left to the base rules.

Base rules (the thresholds are the contract's): fewer than 50 words, or over
half of the words in 3-word windows that occur twice or more.

Scale: two passes over the texts, neither shuffles them.  The reference pass
sends counts of words by language, summed by task in parts of at most
``MOST`` words, and each task ranks its own words first; the driver gets ``top`` + 10 numbers
a language (an error beyond ``max_languages`` languages).

Cases: a null or empty text has no words and fails the base rules; a null lang
counts as the empty one; a language without reference rejects nothing;
repeated rows are judged each; an empty table gives no rows; further columns
are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship, slices

TOP, SHORT, MIN_WORDS, LETTERS = 32, float("inf"), 50, 0.9  # SHORT: most bytes of a common word, none
MOST = 200_000
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK = 0.15, 1.0, 0.22, 1.5
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
N_CLASSES = 10


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte as a (256, classes) indicator; continuation bytes count nowhere."""
    out = np.zeros((256, N_CLASSES))
    for b in range(256):
        c = chr(b)
        if 0x80 <= b < 0xC0:
            continue
        k = 9 if b >= 0xC0 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in _SPACE else 5 if c in ".,;:?'\"-()" else 6 if c in _SYMBOLS else 7 if c == "!" else 8
        out[b, k] = 1
    return out


_CLASS = _classes()


def base_metrics(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        at = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), bool, len(windows)))
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[at + k] = True
        repeat = int(hit.sum())
    return n, chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def histograms(raw: bytes) -> tuple[np.ndarray, Counter, int]:
    """Characters by class; counts of words (letters lower-cased, no punctuation); their number."""
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = raw.decode().lower().encode().translate(_PLAIN).split()
    return chars, Counter(words), len(words)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors."""
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    part = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return float(max(0.0, (part(p) + part(q)) / 2)) ** 0.5


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"))


def references(docs: DataFrame, max_languages: int = 10_000) -> dict[str, dict]:
    """Per language: counts by class, common words and their counts (the rest last)."""

    def count(batches):
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        total: Counter = Counter()

        def out():
            for lang, c in chars.items():
                own = words[lang]
                keys = [f"c{i}" for i in range(N_CLASSES)] + ["n"] + ["w" + x.decode(errors="replace") for x in own]
                yield {"lang": [lang] * len(keys), "key": keys, "n": [int(x) for x in c] + [total[lang], *own.values()]}
            for x in (chars, words, total):
                x.clear()

        for b in slices(batches, 256):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                n, _, _, _, repeat = base_metrics(text, raw)
                if base_failed(n, repeat):
                    continue
                c, w, k = histograms(raw)
                if c[[0, 3, 4, 9]].sum() < LETTERS * c.sum():
                    continue
                chars[lang] = chars.get(lang, 0) + c
                total[lang] += k
                words.setdefault(lang, Counter()).update(w)
            if sum(map(len, words.values())) > MOST:
                yield from out()
        yield from out()

    sums = map_arrow(_rows(docs), count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # one limit for words and for the few other counts, so that each task ranks its own before the exchange
    by = Window.partitionBy("lang", "word").orderBy(F.desc("n"), "key")
    top = sums.withColumn("word", F.col("key").startswith("w")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= max(TOP, N_CLASSES + 1))
    out: dict[str, dict] = {}
    for r in top.select("lang", "key", "n").limit(max_languages * (TOP + N_CLASSES + 1) + 1).collect():
        out.setdefault(r["lang"], {})[r["key"]] = r["n"]
    if len(out) > max_languages:
        raise ValueError(f"more than {max_languages} values of lang")
    refs = {}
    for lang, have in out.items():
        words = sorted((k for k in have if k[0] == "w"), key=lambda k: (-have[k], k))[:TOP]
        counts = [have[k] for k in words]
        refs[lang] = {"chars": np.array([have.get(f"c{i}", 0) for i in range(N_CLASSES)], float), "words": [k[1:].encode() for k in words], "counts": np.array([*counts, have["n"] - sum(counts)], float)}
    return refs


def verdict(raw: bytes, n_words: int, ref: dict | None) -> tuple[float, float, bool]:
    """Distances of characters and common words, and whether the method keeps the text."""
    if ref is None or n_words < MIN_WORDS:
        return 0.0, 0.0, True
    chars, words, n = histograms(raw)
    own = np.array([words.get(w, 0) for w in ref["words"]], float)
    dc = distance(chars, ref["chars"])
    dw = distance(np.append(own, n - own.sum()), ref["counts"])
    wide = n_words**-0.5
    return dc, dw, dc <= CHAR_LIMIT + CHAR_SLACK * wide and dw <= WORD_LIMIT + WORD_SLACK * wide


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, refs: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, base metrics, distances and verdict of every row."""
    known = docs.sparkSession.sparkContext.broadcast(refs if refs is not None else references(docs))

    def run(batches):
        names = [c.split()[0] for c in _OUT.split(", ")]
        for b in slices(batches, 512):
            out: dict[str, list] = {c: [] for c in names}
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                base = base_metrics(text, raw)
                failed = base_failed(base[0], base[4])
                dc, dw, kept = verdict(raw, base[0], known.value.get(lang))
                for c, v in zip(names, (*base, failed, dc, dw, kept and not failed)):
                    out[c].append(v)
            yield {"doc_id": b.column(0), **out}

    return map_arrow(_rows(docs), run, "doc_id long, " + _OUT)


def keep(docs: DataFrame) -> DataFrame:
    """The rows that are kept, all columns as they are (a filter, no join)."""
    known = docs.sparkSession.sparkContext.broadcast(references(docs))
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(text, lang):
        import pandas as pd

        out = []
        for t, x in zip(text, lang):
            raw = t.encode()
            base = base_metrics(t, raw)
            out.append(not base_failed(base[0], base[4]) and verdict(raw, base[0], known.value.get(x))[2])
        return pd.Series(out, dtype=bool)

    return docs.where(kept(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))))
