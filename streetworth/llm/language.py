"""Language identification of mixed texts.

Character trigrams within words are counted for each language over all training texts. A text's letters are first told apart by script (from
ranges of code points; a word ends where the script changes), which leaves each word the languages that use its script; every word then gets a log-likelihood for each of these, and Viterbi's
algorithm with a penalty for switching labels the words, so that spans of one language come out whole. The text's language is that of most letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streetworth.llm import _text as T

BITS = 16
#: Ranges of code points of each script, ends included. Letters of no script here are "other".
RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "syriac": [(0x700, 0x74F)],
    "thaana": [(0x780, 0x7BF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}
#: Ranges without a letter. Combining marks (0x300 to 0x36F) belong to the letter before them, whatever its script.
NO_LETTERS = [(0, 0x40), (0x5B, 0x60), (0x7B, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2070), (0x20A0, 0x20CF), (0x2190, 0x24B5), (0x24EA, 0x2BFF),
              (0x2E00, 0x2E2E), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xE000, 0xF8FF), (0xFE00, 0xFE6F), (0xFEFF, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFFF)]
_NAMES = ["", "other", "mark", *RANGES]
SCRIPTS = len(_NAMES)
_SCRIPT = np.ones(1 << 16, np.uint8)
for _name, _ranges in (*RANGES.items(), ("mark", [(0x300, 0x36F)]), ("", NO_LETTERS)):
    for _low, _high in _ranges:
        _SCRIPT[_low : _high + 1] = _NAMES.index(_name)


def scripts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts the number of its character's script, 0 where that is no letter. Beyond the basic plane: ideographs, signs (0x1F000 to 0x1FBFF), and others."""
    out = _SCRIPT[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    out[data >= 0x80] = 0
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    tail = [np.concatenate((data, np.zeros(3, np.uint8)))[lead + j].astype(np.int64) & 0x3F for j in (1, 2, 3)]
    code = np.select([size == 2, size == 3], [(first & 0x1F) << 6 | tail[0], (first & 0x0F) << 12 | tail[0] << 6 | tail[1]], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
    far = np.where((code >= 0x20000) & (code <= 0x3FFFF), _NAMES.index("han"), np.where((code >= 0x1F000) & (code <= 0x1FBFF), 0, 1))
    script = np.where(code < 1 << 16, _SCRIPT[np.minimum(code, 0xFFFF)], far)
    for j in range(4):
        own = lead[size > j] + j
        out[own] = script[size > j]
    marks = np.flatnonzero(out == 2)
    if len(marks):  # the script of the letter before, which may stand before other marks
        at = np.where((out != 2), np.arange(len(out)), 0)
        out[marks] = out[np.maximum.accumulate(at)[marks]]
    return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters' bytes, a trigram code at each, starts and ends of the words (runs of letters of one script), and each byte's script."""
    script = scripts(data)
    letter = script > 0
    change = 1 + np.flatnonzero(letter[1:] & letter[:-1] & (script[1:] != script[:-1]))
    starts, ends = T.spans_of(letter, np.union1d(offsets, change) if len(change) else offsets)
    low = T.LOWER[data]
    after = np.concatenate(([0], data[:-1])) == 0xC3
    low = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(32), low)  # capitals of Latin-1
    low = np.where(letter, low, np.uint8(32)).astype(np.uint32)
    left, right = np.concatenate(([32], low[:-1])).astype(np.uint32), np.concatenate((low[1:], [32])).astype(np.uint32)
    left[starts], right[ends - 1] = 32, 32
    at = np.flatnonzero(letter)
    code = ((left[at] << np.uint32(16) | low[at] << np.uint32(8) | right[at]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return at, code, starts, ends, script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of the partition: its trigram and script counts."""
    tables: dict[str, np.ndarray] = {}
    for rows, data, offsets in T.slices(batches):
        langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object)
        at, code, _, _, script = _codes(data, offsets)
        cuts = np.searchsorted(at, offsets)
        first, own = (data[at] & 0xC0) != 0x80, script[at]
        for lang in set(langs):
            table = tables.setdefault(lang, np.zeros((1 << BITS) + SCRIPTS, np.int64))
            mine = np.flatnonzero(langs == lang)
            take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in mine])
            table[: 1 << BITS] += np.bincount(code[take], minlength=1 << BITS)
            table[1 << BITS :] += np.bincount(own[take][first[take]], minlength=SCRIPTS)
    if tables:
        yield pa.record_batch({"lang": pa.array(list(tables), pa.string()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in tables.values()], pa.binary())})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From docs(text, lang): the languages, log-probabilities [2**BITS, languages], and the languages allowed for each script [SCRIPTS, languages].

    Partial counts are added for each partition and then for each language, so that what reaches the driver is one table for each language. Null languages are not read,
    null texts add nothing, repeated rows count each; an empty table gives no languages, and then every text is unknown.
    """
    counts = docs.select("text", "lang").where("lang is not null").mapInArrow(_count, "lang string, counts binary")
    found = sorted(counts.groupBy("lang").applyInPandas(_add, "lang string, counts binary").collect())
    langs = [r["lang"] for r in found]
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32), np.ones((SCRIPTS, 0), bool)
    tables = np.array([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in found]).T
    grams, scripts = tables[: 1 << BITS] + 0.5, tables[1 << BITS :]
    allowed = scripts >= 0.01 * scripts.sum(0, keepdims=True)
    allowed[~allowed.any(1)] = True
    return langs, np.log(grams / grams.sum(0)).astype(np.float32), allowed


def viterbi(scores: np.ndarray, firsts: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of many texts: scores [words, languages], firsts where each text's words begin. All texts take one step at a time."""
    n = np.diff(firsts)
    order = np.argsort(-n, kind="stable")
    begin, active = firsts[:-1][order], np.searchsorted(-n[order], -np.arange(n.max(initial=0)), "left")  # texts with more than t words
    stay = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int64)
    value = np.zeros((len(n), scores.shape[1]))
    for t, m in enumerate(active):
        at = begin[:m] + t
        v = value[:m]
        if t:
            top = v.argmax(1)
            least = v[np.arange(m), top] - penalty
            best[at], stay[at] = top, v >= least[:, None]
            np.maximum(v, least[:, None], out=v)
        v += scores[at]
    labels = np.zeros(len(scores), np.int64)
    now = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        labels[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], best[at])
    return labels


def _label(shared, penalty: float, unknown: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, allowed = shared.value
        k = len(langs)
        names = np.array([*langs, unknown], object)
        for rows, data, offsets in T.slices(batches, limit=(6 << 20) // max(k, 3)):
            d = rows.num_rows
            pred, score, share, spans = np.full(d, k), np.zeros(d), np.zeros(d), [""] * d
            at, code, starts, ends, script = _codes(data, offsets)
            if k and len(starts):
                firsts = np.searchsorted(starts, offsets)
                scores = np.add.reduceat(table[code], np.searchsorted(at, starts), axis=0).astype(np.float64)
                scores -= scores.max(1, keepdims=True)
                scores[~allowed[script[starts]]] -= 1e3
                labels = viterbi(scores, firsts, penalty)
                text = np.repeat(np.arange(d), np.diff(firsts))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                size = (chars[ends] - chars[starts]).astype(float)
                on = np.bincount(text * k + labels, size, d * k).reshape(d, k)
                total = np.array([np.bincount(text, scores[:, j], d) for j in range(k)]).T
                chance = np.exp(total - total.max(1, keepdims=True))
                top = on.argmax(1)
                has = on.sum(1) > 0
                pred[has] = top[has]
                share[has] = (on.max(1) / np.maximum(on.sum(1), 1))[has]
                score[has] = (share * (0.5 + 0.5 * chance[np.arange(d), top] / chance.sum(1)))[has]
                new = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1]))))
                last = np.concatenate((new[1:], [len(labels)])) - 1
                for a, b in zip(new, last, strict=True):
                    i = text[a]
                    spans[i] += f"{',' if spans[i] else ''}{langs[labels[a]]}:{chars[starts[a]] - chars[offsets[i]]}:{chars[ends[b]] - chars[offsets[i]]}"
            raw = data.tobytes()
            for i in np.flatnonzero(pred < k):  # what is in no script here need not be a letter
                part = script[offsets[i] : offsets[i + 1]]
                if not (part > 2).any() and not any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].decode()):
                    pred[i], score[i], share[i], spans[i] = k, 0.0, 0.0, ""
            kept = [rows.column(i) for i in range(rows.num_columns)]
            yield pa.record_batch([*kept, pa.array(names[pred], pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64()), pa.array(spans, pa.string())], names=[*rows.schema.names, "lang_pred", "lang_score", "lang_share", "lang_spans"])

    return run


def identify(docs: DataFrame, model, penalty: float = 8.0, unknown: str = "und") -> DataFrame:
    """docs with lang_pred, lang_share (0 to 1: the share of letters in that language, in code points), lang_score (that share, halved where the whole text speaks
    for another) and lang_spans ("lang:start:end", code points).

    A null text or one without letters: `unknown`, 0, 0 and no span. Other columns stay, but for those four names. Nothing is shuffled; memory follows the
    longest text.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_share", "lang_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_share", "double").add("lang_spans", "string")
    return docs.mapInArrow(_label(shared, penalty, unknown), schema)


def fold(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
