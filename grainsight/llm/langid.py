"""Language ID by mixture inference (operator 3).

`train` counts hashed letter trigrams of labelled texts per language.
`identify` treats a text as a mixture of languages: each word's likelihood
under a language is the product of its trigrams' probabilities, and
expectation-maximisation estimates the language proportions.  Languages leave
the set one by one, smallest share first, as long as that lowers the penalised
likelihood -2 log L + |set| log n.  The model has a fixed size whatever the corpus:
many languages share it by having fewer buckets each; texts are scored where they
are read.

Defined results: `und` with score 0 for null texts and texts without a letter,
and for all texts if nothing was learned; ties between languages go to the one
first in the alphabet; repeated rows get equal results; an empty table gives an
empty table.  Only the key, the text and the label are read, so other columns
clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, lean, sum_vectors, vector_rows
from .textcols import LOWER, buffer, slices

#: Trigram buckets a language, while there are few languages.
BUCKETS = 1 << 16
#: Numbers that a model may hold: with more languages each has fewer buckets, but `LEAST_BUCKETS`.
TABLE = 1 << 23
LEAST_BUCKETS = 1 << 8
#: Languages that a counting task gathers before it hands them on.
GATHER = 64
#: Bytes of text that a task works on at once; a byte takes some numbers for each language.
SLICE = 1 << 20
SMOOTHING = 0.2
EM_STEPS = 8
RE_STEPS = 4
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)


@dataclass
class Model:
    """Languages in alphabetical order, and log probabilities: buckets x languages."""

    languages: list[str]
    log_p: np.ndarray


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets, first trigram of each word, number of each word's text); words are runs of letters."""
    data, offsets = buffer(column)
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    line = np.full(len(data) + n + 1, 32, np.uint8)  # a space before each text and at the end
    line[np.arange(len(data)) + text_of + 1] = _FOLD[data]
    inside = line != 32
    at = np.flatnonzero(inside)
    wide = line.astype(np.uint32)
    grams = (wide[at - 1] << 16 | wide[at] << 8 | wide[at + 1]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    starts = np.flatnonzero(~inside[at - 1])
    begin = offsets + np.arange(n + 1)
    return grams.astype(np.int64), starts, np.searchsorted(begin, at[starts], side="right") - 1


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """Counts trigrams of all texts where `learn` holds and the label isn't null."""
    rows = docs.where(learn).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known, buckets = rows.select("lang").distinct().count(), BUCKETS
    while known * buckets > TABLE and buckets > LEAST_BUCKETS:
        buckets //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                names = part.column(0).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                grams, starts, of = trigrams(part.column(1))
                if not len(starts):
                    continue
                which = np.repeat(code[of], np.diff(np.append(starts, len(grams))))
                order = np.argsort(which, kind="stable")
                which, grams = which[order], grams[order] % buckets
                cuts = np.searchsorted(which, np.arange(len(names.dictionary) + 1))
                for i, name in enumerate(names.dictionary.to_pylist()):
                    if cuts[i + 1] > cuts[i]:
                        total[name] = total.get(name, 0) + np.bincount(grams[cuts[i] : cuts[i + 1]], minlength=buckets)
                if len(total) > GATHER:
                    yield from vector_rows(total)
                    total = {}
        yield from vector_rows(total)

    counts = sum_vectors(rows.mapInArrow(lean(count), VECTOR_SCHEMA))
    languages = sorted(counts)
    table = np.array([counts[k] for k in languages]).reshape(len(languages), buckets).T
    return Model(languages, np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * buckets)).astype(np.float32))


def _em(p: np.ndarray, share: np.ndarray, allowed: np.ndarray, first: np.ndarray, of: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood (up to a constant of the text) after some steps; p: words x languages."""
    n = np.bincount(of, minlength=len(share)).astype(np.float64)[:, None]
    share = share * allowed
    share /= share.sum(1, keepdims=True)
    for _ in range(steps):
        r = p * share[of]
        r /= r.sum(1, keepdims=True) + 1e-300
        share = (np.add.reduceat(r, first, axis=0) + 1e-9 * allowed) / n
        share /= share.sum(1, keepdims=True)
    return share, np.add.reduceat(np.log((p * share[of]).sum(1) + 1e-300), first)


def mixtures(model: Model, column: pa.Array) -> np.ndarray:
    """Proportions: texts x languages; all zero for texts without words."""
    out = np.zeros((len(column), len(model.languages)))
    grams, starts, of = trigrams(column)
    if not len(starts) or not model.languages:
        return out
    logs = np.add.reduceat(model.log_p[grams % len(model.log_p)], starts, axis=0).astype(np.float64)
    p = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -200))
    present, of = np.unique(of, return_inverse=True)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    words = np.diff(np.append(first, len(of)))
    k = p.shape[1]
    allowed = np.ones((len(present), k), bool)
    share, fit = _em(p, np.full((len(present), k), 1 / k), allowed, first, of, EM_STEPS)
    cost = -2 * fit + k * np.log(words + 1)
    open_ = np.ones(len(present), bool)
    for size in range(k - 1, 0, -1):
        trial = allowed.copy()
        smallest = np.where(allowed, share, np.inf)
        # of equal shares the last in the alphabet goes
        trial[np.arange(len(trial)), k - 1 - np.argmin(smallest[:, ::-1], axis=1)] = False
        trial[~open_] = allowed[~open_]
        new_share, fit = _em(p, share + 1e-6, trial, first, of, RE_STEPS)
        new_cost = -2 * fit + size * np.log(words + 1)
        open_ &= new_cost <= cost
        allowed[open_], share[open_], cost[open_] = trial[open_], new_share[open_], new_cost[open_]
        if not open_.any():
            break
    out[present] = share
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, langs, shares): the main language and its share, and the whole mixture, largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double, langs array<string>, shares array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = mixtures(m, part.column(1))
                data, offsets = buffer(part.column(1))
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
                plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~plain & (found.sum(1) > 0)):
                    if not any(map(str.isalpha, part.column(1)[i].as_py())):
                        found[i] = 0
                names, scores, langs, shares = [], [], [], []
                for row in found:
                    order = [j for j in np.argsort(-row, kind="stable") if row[j] > 1e-4]
                    names.append(m.languages[order[0]] if order else UNDETERMINED)
                    scores.append(min(1.0, float(row[order[0]])) if order else 0.0)
                    langs.append([m.languages[j] for j in order])
                    shares.append([float(row[j]) for j in order])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], [key, "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(run), schema)
