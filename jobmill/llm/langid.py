"""Language spans of mixed text: scripts narrow the candidates, Viterbi with a switching penalty labels the words.

Training counts byte trigrams of words per language over all training documents (a fixed number of slots per
language, combined in the task before the shuffle) and the scripts of their letters.  A word scores for a language the
sum of its trigrams' log-probabilities; languages that hardly ever use the word's scripts are no candidates.  The
best path over a document's words pays ``PENALTY`` for each change of language; its runs are the spans, and the
language with most letters is the document's.  Texts of a batch advance word by word together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import picked, release, slices, utf8

BITS = 16
SMOOTH = 0.1
PENALTY = 15.0
UNLIKELY = -40.0  # added to a word's score for a language that does not use its scripts
LEAST_SCRIPT = 0.01  # share of a language's letters in a script for it to be one of the language's scripts
LEAST_SHARE = 0.5  # of a text's letters must lie in its main languages
MAIN_SHARE = 0.2  # of the letters make a language one of a text's main ones
GROUP = 5  # slices that take the Viterbi steps together
UND = "und"
#: First bytes of UTF-8 letters by script (ASCII letters and C3-C9 are Latin).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)), "greek": ((0xCD, 0xCF),), "cyrillic": ((0xD0, 0xD4),), "hebrew": ((0xD6, 0xD7),),
    "arabic": ((0xD8, 0xDD),), "indic": ((0xE0, 0xE0),), "other": ((0xE1, 0xE2),), "kana": ((0xE3, 0xE3),), "han": ((0xE4, 0xE9),), "hangul": ((0xEA, 0xED),),
    "rare": ((0xEE, 0xF4),),
}
_SCRIPT_BITS = np.zeros(256, np.uint16)
for _bit, _spans in enumerate(SCRIPTS.values()):
    for _lo, _hi in _spans:
        _SCRIPT_BITS[_lo:_hi + 1] = 1 << _bit
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_FOLD = np.arange(256, dtype=np.uint8)  # lower case; what cannot be part of a word is a blank
_FOLD[0x41:0x5B] += 32
_FOLD[:0x80][~_ASCII_LETTER[:0x80]] = 32
_LETTER = re.compile(r"[^\W\d_]")


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank before, between and after the texts, and the texts' new offsets."""
    out = np.full(len(data) + len(offsets), 32, np.uint8)
    out[np.arange(1, len(data) + 1) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = _FOLD[data]
    upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
    out[1:][upper] += 32
    return out, offsets + np.arange(1, len(offsets) + 1)


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = text != 32
    return np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1


def trigram_slots(text: np.ndarray) -> np.ndarray:
    """The slot of the trigram around each byte but the first and last."""
    x = text.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, slot, n) of one task; slots from 2**BITS on are scripts."""
    width = (1 << BITS) + 16
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            text, offsets = folded(*utf8(part.column("text")))
            if len(text) < 3:
                continue
            langs, code = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            owner = np.repeat(code, np.diff(offsets))  # from the blank before a text on
            owner = np.concatenate([owner[:1], owner, owner[-1:]])[:len(text)]
            inner = np.flatnonzero(text[1:-1] != 32)
            counts = np.bincount(owner[1:-1][inner] * (1 << BITS) + trigram_slots(text)[inner], minlength=len(langs) << BITS).reshape(len(langs), -1)
            scripts = _SCRIPT_BITS[text]
            for i, lang in enumerate(langs):
                into = totals.setdefault(lang, np.zeros(width, np.int64))
                into[:1 << BITS] += counts[i]
                bits, n = np.unique(scripts[(owner == i) & (scripts > 0)], return_counts=True)
                into[(1 << BITS) + np.log2(bits).astype(int)] += n
    for lang, counts in totals.items():
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(counts[slots])], ["lang", "slot", "n"])
    totals.clear()
    release()


class Model:
    """Log-probabilities of trigram slots and scripts of each language, languages in alphabetical order."""

    def __init__(self, rows: pa.Table):
        codes = rows.column("lang").combine_chunks().dictionary_encode()
        names = codes.dictionary.to_pylist()
        self.langs = sorted(names)
        place = np.array([self.langs.index(name) for name in names], np.int64)
        counts = np.zeros((len(self.langs), (1 << BITS) + 16))
        if names:
            counts[place[codes.indices.to_numpy()], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
        grams, scripts = counts[:, :1 << BITS] + SMOOTH, counts[:, 1 << BITS:]
        self.logp = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.scripts = ((share >= LEAST_SCRIPT) * (1 << np.arange(16))).sum(axis=1).astype(np.uint16)

    def word_scores(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(languages, words): summed log-probabilities, lowered where scripts rule a language out."""
        out = np.empty((len(self.langs), len(starts)), np.float32)
        if not len(starts):
            return out
        slots = trigram_slots(text)
        used = np.bitwise_or.reduceat(_SCRIPT_BITS[text], starts)
        fits = (used[None, :] & self.scripts[:, None]) > 0
        fits |= ~fits.any(axis=0)[None, :]
        sums = np.zeros(len(slots) + 1)
        for i in range(len(self.langs)):
            np.cumsum(self.logp[i][slots], dtype=np.float64, out=sums[1:])
            out[i] = sums[ends - 1] - sums[starts - 1]
            out[i][~fits[i]] += UNLIKELY
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every word; texts are the word ranges [first, first + length).

    Longer texts stand in front, so the texts that still have words at a step are a prefix.  Of equal paths the
    one that stays with its language wins, then the one with the smaller label.
    """
    labels = np.zeros(scores.shape[1], np.int16)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n = int((length > 0).sum())
    if not n or scores.shape[0] < 2:
        return labels
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    own = np.arange(scores.shape[0], dtype=np.int16)[:, None]
    value, back = scores[:, first[:n]].astype(np.float64), []
    final = np.empty(n, np.int16)
    for t in range(1, length[0]):
        m = alive[t]
        if m < value.shape[1]:
            final[m:value.shape[1]] = value[:, m:].argmax(axis=0)
            value = value[:, :m]
        top = value.max(axis=0) - penalty
        stay = value >= top
        back.append(np.where(stay, own, value.argmax(axis=0).astype(np.int16)))
        value = np.where(stay, value, top) + scores[:, first[:m] + t]
    final[:value.shape[1]] = value.argmax(axis=0)
    state = final
    for t in range(length[0] - 1, -1, -1):
        m = alive[t]
        labels[first[:m] + t] = state[:m]
        if t:
            state[:m] = back[t - 1][state[:m], np.arange(m)]
    return labels


STRUCT = "struct<lang_pred:string,score:double,main:double,spans:array<struct<first_word:long,last_word:long,lang:string>>>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("main", pa.float64()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())])))])


def _label_group(parts: list[pa.Array], model: Model) -> pa.Array:
    scores, letters, counts, ascii_letters = [], [], [], []
    for column in parts:
        data, offsets = utf8(column)
        text, moved = folded(data, offsets)
        starts, ends = words_of(text)
        scores.append(model.word_scores(text, starts, ends))
        letters.append(ends - starts)
        counts.append(np.diff(np.searchsorted(starts, moved)))
        sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        ascii_letters.append(np.diff(sums[offsets]) > 0)
    scores, letters, length = np.concatenate(scores, axis=1), np.concatenate(letters), np.concatenate(counts)
    first = np.cumsum(length) - length
    labels = viterbi(scores, first, length)
    n, k = len(length), max(1, len(model.langs))
    owner = np.repeat(np.arange(n), length)
    weight = np.bincount(owner * k + labels, letters, n * k).reshape(n, k)
    best, total = weight.argmax(axis=1), weight.sum(axis=1)
    shares = weight / np.maximum(total, 1)[:, None]
    share, main = shares[np.arange(n), best], np.where(shares >= MAIN_SHARE, shares, 0).sum(axis=1)
    lettered = np.concatenate(ascii_letters)
    at = 0
    for column in parts:
        for i in np.flatnonzero(~lettered[at:at + len(column)]):
            lettered[at + i] = bool(_LETTER.search(column[int(i)].as_py() or ""))
        at += len(column)
    known = lettered & (total > 0) & bool(model.langs)
    names = np.array([*model.langs, UND], object)
    change = np.ones(len(labels), bool)
    change[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    change &= known[owner]
    at = np.flatnonzero(change)
    stop = np.append(at[1:], len(labels)) if len(at) else at
    stop = np.minimum(stop, (first + length)[owner[at]])
    spans = pa.StructArray.from_arrays([pa.array(at - first[owner[at]]), pa.array(stop - 1 - first[owner[at]]), pa.array(names[labels[at]], pa.string())], names=["first_word", "last_word", "lang"])
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]), pa.int32())
    return pa.StructArray.from_arrays([pa.array(names[np.where(known, best, len(model.langs))], pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, main, 0.0)), pa.ListArray.from_arrays(bounds, spans)],
                                      fields=list(_ARROW))


def labeller(model: Model):
    """A column function of the text: lang_pred, score and spans of words (runs of letters)."""
    @F.arrow_udf(STRUCT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [p.column(0) for p in slices(pa.RecordBatch.from_arrays([column], ["text"]))]
            done = [_label_group(parts[i:i + GROUP], model) for i in range(0, len(parts), GROUP)]
            yield pa.concat_arrays(done) if done else pa.array([], _ARROW)
        release()
    return label


def held_out(id_column) -> F.Column:
    """Documents kept out of training; so are those without an id."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of all training documents, combined per task; 2**BITS + 16 numbers per language reach the driver."""
    rows = picked(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.select("text", "lang").mapInArrow(_counter, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow())


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its share of the letters), main (that of all main languages), spans.

    ``und`` with score 0 and no spans where the text is null or has no letter, or where nothing was learned.  Ids are
    carried as they are; repeated rows keep theirs; an empty table gives no rows.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", labeller(model)("text").alias("x"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x.lang_pred", "x.score", "x.main", "x.spans")


def accepted(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The documents, all columns as they are, whose language is known.

    That is a matter of all main languages of a text together, so a text in two or three languages counts like one in one; texts
    without letters, and such that are labelled in crumbs, go.
    """
    label = labeller(train(docs))(F.col("text"))
    return docs.where((label["lang_pred"] != UND) & (label["main"] >= least))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
