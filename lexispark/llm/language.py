"""Language identification: script ranges narrow the candidates of each word, Viterbi with a
switching penalty labels spans of words.

Word and letter-trigram counts per language are learned from a bounded sample of labelled
documents (about ``MAX_PER_LANG`` each and ``MAX_DOCS`` in all, but not under ``LEAST_PER_LANG``, by
the hash of the id), of which every language, word and trigram is kept. Prediction runs in map tasks
over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexispark.llm.arrays import ranges
from lexispark.llm.text import append

#: Bounds of the sample that is learned from, in documents.
MAX_PER_LANG, MAX_DOCS, LEAST_PER_LANG = 1000, 20_000, 20
#: Scores (words times languages) worked out at once, unless one text has more.
CELLS = 1 << 20
PENALTY, FLOOR = 12.0, -6.0
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# First code points of the main script blocks of Unicode, each up to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + 3] for k in range(len(w) - 2)]


@dataclass
class Sparse:
    """Rows of values by language, of which only those are stored that differ from a base value."""

    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(row: np.ndarray, lang: np.ndarray, value: np.ndarray, rows: int) -> Sparse:
        by = np.lexsort((lang, row))
        return Sparse(np.searchsorted(row[by], np.arange(rows + 1)), lang[by].astype(np.int32), value[by].astype(np.float32))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``rows``, language, value) of the stored values of the rows."""
        count = self.start[rows + 1] - self.start[rows]
        at = ranges(self.start[rows], count)
        return np.repeat(np.arange(len(rows)), count), self.lang[at], self.value[at]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # row of each known word
    table: Sparse  # scores of known words above FLOOR
    grams: dict[str, int]  # row of each known trigram; row 0 is that of unseen ones
    gram_table: Sparse  # log-probabilities of the trigrams by language above those of an unseen one
    unseen: np.ndarray  # log-probability of an unseen trigram by language
    allowed: dict[str, np.ndarray]  # by script: which languages write it
    prior: int

    def writes(self, words: list[str]) -> np.ndarray:
        """Which languages write each word's script."""
        none = np.zeros(len(self.langs), dtype=bool)
        return np.array([self.allowed.get(script(w), none) for w in words]).reshape(len(words), len(self.langs))

    def by_trigrams(self, words: list[str]) -> np.ndarray:
        """Log-posteriors of the languages given the words' trigrams, within their scripts' candidates."""
        known, n, langs = self.grams.get, len(words), len(self.langs)
        rows = np.array([known(w[k : k + 3], 0) for w in map("^{}$".format, words) for k in range(len(w) - 2)], dtype=np.int64)
        count = np.fromiter(map(len, words), dtype=np.int64, count=n)  # a word has as many trigrams as letters
        at, lang, value = self.gram_table.entries(rows)
        more = np.bincount(np.repeat(np.arange(n), count)[at] * langs + lang, weights=value, minlength=n * langs).reshape(n, langs)
        return settle(count[:, None] * self.unseen + more, self.writes(words))

    def scores(self, words: list[str]) -> np.ndarray:
        known = self.words.get
        rows = np.array([known(w, -1) for w in words], dtype=np.int64)
        out = np.full((len(words), len(self.langs)), FLOOR, dtype=np.float32)
        at, lang, value = self.table.entries(np.maximum(rows, 0)) if len(self.words) else (rows[:0], rows[:0], rows[:0])
        out[at, lang] = value
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            place: dict[str, int] = {}
            of = [place.setdefault(words[k], len(place)) for k in unknown.tolist()]
            out[unknown] = self.by_trigrams(list(place))[of]
        return out

    def spans(self, texts: list[str | None], penalty: float = PENALTY) -> Iterator[list[tuple[int, int, str]]]:
        """For each text (first word, past the last, language) over its words of letters."""
        most, waiting, size = CELLS // max(1, len(self.langs)), [], 0
        for t in texts:
            words = LETTERS.findall(t.lower()) if t and self.langs else []
            if waiting and size + len(words) > most:
                yield from self.paths(waiting, penalty)
                waiting, size = [], 0
            waiting.append(words)
            size += len(words)
        yield from self.paths(waiting, penalty)

    def paths(self, texts: list[list[str]], penalty: float) -> Iterator[list[tuple[int, int, str]]]:
        scores = self.scores([w for ws in texts for w in ws])
        start = 0
        for ws in texts:
            if not ws:
                yield []
                continue
            path = best_path(scores[start : start + len(ws)], penalty)
            start += len(ws)
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(ws)]
            yield [(a, b, self.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def settle(logp: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Row by row normed log-posteriors, not below FLOOR. Languages that don't write a word's script are at FLOOR; if none does, all are at 0."""
    top = np.where(allowed, logp, -np.inf)
    some = allowed.any(axis=1)
    top[~some] = 0
    top -= top.max(axis=1, keepdims=True)
    out = np.maximum(top - np.log(np.exp(top).sum(axis=1, keepdims=True)), FLOOR)
    out[~some] = 0
    return out.astype(np.float32)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of highest score, where each change of language costs ``penalty``.

    The best single language is the answer where no other gains more than one penalty over any stretch:
    then leaving it does not pay. A path without it has a first and a last span, and one change less
    than spans, so the gains over a prefix and a suffix must not be above one penalty together. Else
    the full recursion runs.
    """
    n, langs = scores.shape
    one = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gain = np.zeros((n + 1, langs))
    np.cumsum(scores - scores[:, one : one + 1], axis=0, dtype=np.float64, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty and gain.max() + (gain[-1] - gain).max() <= penalty:
        return np.full(n, one)
    back, value = np.empty((n, langs), dtype=np.int32), scores[0].astype(np.float64)
    stay = np.arange(langs)
    for t in range(1, n):
        top = int(value.argmax())
        jump = value[top] - penalty
        moved = value < jump
        back[t] = np.where(moved, top, stay)
        value = np.where(moved, jump, value) + scores[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = MAX_PER_LANG, max_docs: int = MAX_DOCS) -> Model:
    """Learn from the rows with a language and a text.

    Languages of up to ``per_lang`` rows are read whole, others by the hash of id and language; where
    there are many languages, each has ``max_docs`` divided by their number instead, but not under
    ``LEAST_PER_LANG``. Rows that repeat an id and a language are taken or left together and each
    counts; an id with several languages counts for each of them. A row without id counts as one whose
    id is null. Empty texts teach nothing. Ties in what is learned are broken by the language's name.
    Without any row with a language the model knows none.
    """
    rows = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        nothing = Sparse(np.zeros(2, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
        return Model([], {}, nothing, {}, nothing, np.zeros(0), {}, 0)
    per = min(per_lang, max(LEAST_PER_LANG, max_docs // len(counts)))
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, per / n)) for lang, n in counts.items()], "lang string, rate double")
    picked = rows.join(F.broadcast(rates), "lang").filter((F.xxhash64("_id", "lang") / float(1 << 64) + 0.5) < F.col("rate"))  # a row a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                seen[lang].update(LETTERS.findall(text.lower()))
        yield pd.DataFrame([(lang, w, n) for lang, c in seen.items() for w, n in c.items()], columns=["lang", "word", "n"])

    by_word = picked.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return learned(sorted(counts), by_word.toPandas())


def learned(langs: list[str], found: pd.DataFrame) -> Model:
    """The model of the words ``lang, word, n`` of the sample."""
    at = {x: k for k, x in enumerate(langs)}
    lang, n = found["lang"].map(at).to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)
    row, words = pd.factorize(found["word"])
    words = words.tolist()
    scripts, grams = list(map(script, words)), list(map(trigrams, words))
    gram_id: dict[str, int] = {}
    ids = np.array([gram_id.setdefault(g, len(gram_id) + 1) for gs in grams for g in gs], dtype=np.int64)
    length = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))

    def sums(key: np.ndarray, weights: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, back = np.unique(key * len(langs) + of, return_inverse=True)
        return both // len(langs), both % len(langs), np.bincount(back, weights=weights)

    total = np.bincount(lang, weights=n, minlength=len(langs)) + 1
    script_id = {s: k for k, s in enumerate(sorted(set(scripts)))}
    allowed = {s: np.zeros(len(langs), dtype=bool) for s in script_id}
    names = list(script_id)
    for s, of, k in zip(*sums(np.array([script_id[s] for s in scripts], dtype=np.int64)[row], n, lang), strict=True):
        allowed[names[s]][of] = k / total[of] >= 0.01
    first = np.cumsum(length) - length
    gram, gram_lang, gram_n = sums(ids[ranges(first[row], length[row])], np.repeat(n, length[row]), np.repeat(lang, length[row]))
    all_grams = np.bincount(gram_lang, weights=gram_n, minlength=len(langs)) + len(gram_id) + 1
    gram_table = Sparse.of(gram, gram_lang, np.log((gram_n + 0.5) / 0.5), len(gram_id) + 1)
    model = Model(langs, {}, gram_table, gram_id, gram_table, np.log(0.5 / all_grams), allowed, int(total.argmax()))

    # a known word is judged by its own counts, smoothed with what its trigrams say
    own = Sparse.of(row, lang, n / total[lang], len(words))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // len(langs))
    for a in range(0, len(words), step):
        block = np.arange(a, min(a + step, len(words)))
        here = [words[k] for k in block.tolist()]
        p = 1e-5 * np.exp(model.by_trigrams(here).astype(np.float64))
        k, of, share = own.entries(block)
        p[k, of] += share
        score = settle(np.log(p), model.writes(here))
        k, of = np.nonzero(score > FLOOR)
        parts.append((k + a, of, score[k, of]))
    model.table = Sparse.of(*map(np.concatenate, zip(*parts, strict=True)), len(words)) if parts else gram_table
    model.words = {w: k for k, w in enumerate(words)}
    return model


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_spans``, ``lang_pred`` (the language of most letters' words) and ``score`` (their share).

    Text that is null or has no letter is ``und`` with score 0 and no spans, and so is all text if
    nothing was learned. Words of a script that no learned language writes take part without
    favouring any; a text of such words only gets the most frequent learned language, score 0.
    Columns named like the results are replaced; other columns and repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def label(texts: list[str | None]) -> tuple[list, list[str], list[float]]:
        m, spans, preds, scores = shared.value, [], [], []
        for text, found in zip(texts, m.spans(texts), strict=True):
            share: Counter = Counter()
            for start, end, lang in found:
                share[lang] += end - start
            spans.append([{"start": s, "end": e, "lang": x} for s, e, x in found])
            if not share:
                preds.append(UNKNOWN)
                scores.append(0.0)
                continue
            top, n = min(share.items(), key=lambda x: (-x[1], x[0]))
            blank = len(found) == 1 and not any(script(w.group()) in m.allowed for w in LETTERS.finditer(text))
            preds.append(m.langs[m.prior] if blank else top)
            scores.append(0.0 if blank else n / sum(share.values()))
        return spans, preds, scores

    return append(docs, [text_col], f"lang_spans {SPANS}, lang_pred string, score double", lambda: label)
