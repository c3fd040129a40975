"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, batched, buffers_of, mixed, pieces, texts_of

#: Cells of the hashed n-gram space.
CELLS = 1 << 16
#: Lengths of the byte n-grams that the classifiers read.
GRAMS = (2, 4)
#: Added to each cell's share of a language, as a share spread over all cells.
SMOOTHING = 0.05
#: A prediction whose nearest and second-nearest codewords differ by less is marked ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"
#: Of general category L: neither superscripts nor fractions nor Roman numerals are letters.
LETTER = regex.compile(r"\p{L}")
SPACE = np.uint8(32)
IN_GRAM = np.zeros(256, bool)
IN_GRAM[65:91] = IN_GRAM[97:123] = IN_GRAM[128:] = True


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each of ``n`` languages: rows of a Hadamard matrix.

    Any two rows differ in half of the columns before those that tell nothing apart are left out.
    """
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) < 2 * n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = matrix[1 : n + 1]
    rows = np.unique(rows * rows[:1], axis=1)  # a column and its opposite ask the same question
    return rows[:, np.abs(rows.sum(axis=0)) < n]


def gram_cells(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the hashed cells, and the text each belongs to.

    Letters A-Z are lower-cased and every other byte below 128 counts as a space; grams do
    not run from one text into the next, nor over two spaces.
    """
    ends, raw = buffers_of(texts)
    data = np.where(IN_GRAM[raw], LOWER[raw], SPACE).astype(np.uint64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = []
    for n in GRAMS:
        m = max(0, len(data) - n + 1)
        value = np.zeros(m, np.uint64)
        for i in range(n):
            value = (value << np.uint64(8)) | data[i : m + i]
        whole = owner[:m] == owner[n - 1 : n - 1 + m]
        blank = (data[:m] == SPACE) & (data[1 : 1 + m] == SPACE) if m else whole
        keep = whole & ~blank
        out.append(((mixed(value[keep] + np.uint64(n << 40)) >> np.uint64(48)).astype(np.int64), owner[:m][keep]))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n): n-grams of all rows of ``docs`` (text, lang), summed within each task first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])
                for cells, owner in gram_cells(texts_of(part.column("text"))):
                    joint = np.bincount(code[owner] * CELLS + cells, minlength=len(names) * CELLS)
                    for i, name in enumerate(names):
                        sums.setdefault(name, np.zeros(CELLS, np.int64))
                        sums[name] += joint[i * CELLS : (i + 1) * CELLS]
        for name, counts in sums.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells), pa.array(counts[cells])], names=["lang", "cell", "n"])

    counted = docs.mapInArrow(run, "lang string, cell long, n long")
    return counted.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Weights of one linear classifier for each bit, and the languages' codewords."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: n-grams by language and cell."""
        self.langs = langs
        self.code = codewords(len(langs)) if len(langs) > 1 else np.ones((len(langs), 0), np.int8)
        share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) if langs else counts
        floor = SMOOTHING / CELLS
        self.weights = np.zeros((CELLS, self.code.shape[1]), np.float32)
        for bit in range(self.code.shape[1]):
            one, other = (share[self.code[:, bit] == side].mean(axis=0) + floor for side in (1, -1))
            self.weights[:, bit] = np.log(one / other)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log odds of the bits for each text."""
        total, number = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for cells, owner in gram_cells(texts):
            number += np.bincount(owner, minlength=len(texts))
            for bit in range(self.weights.shape[1]):
                total[:, bit] += np.bincount(owner, weights=self.weights[cells, bit], minlength=len(texts))
        return total / np.maximum(1, number)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic losses of each language's codeword, a bit counting for as much as it is sure."""
        weight = np.abs(margins) + 1e-9
        weight /= weight.sum(axis=1, keepdims=True)
        agree = margins[:, None, :] * self.code[None, :, :]
        return (np.log1p(np.exp(-4 * agree)) * weight[:, None, :]).sum(axis=2)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous."""
        blank = np.array([LETTER.search(t) is None for t in texts.to_pylist()], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if len(self.langs) == 1:
            return [UNKNOWN if b else self.langs[0] for b in blank], np.where(blank, 0.0, 1.0), blank
        losses = self.losses(self.margins(texts))
        best = losses.argmin(axis=1)
        near = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
        ranked = np.sort(losses, axis=1)
        score = np.where(blank, 0.0, 1 / near.sum(axis=1))
        return [UNKNOWN if b else self.langs[i] for b, i in zip(blank, best, strict=True)], score, blank | (ranked[:, 1] - ranked[:, 0] < AMBIGUOUS)


def fit(docs: DataFrame) -> Model:
    """Fit on all rows of ``docs`` (text, lang) that have a language.

    The counts that come to the driver have at most ``CELLS`` rows for each language.
    """
    rows = gram_counts(docs.filter(F.col("lang").isNotNull()).select("text", "lang")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), CELLS))
    index = {x: i for i, x in enumerate(langs)}
    counts[[index[x] for x in rows.column("lang").to_pylist()], rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row, from the whole text alone.

    A null text, or one without a letter, gets ``und`` and score 0, and so do all rows if
    nothing was learned; of languages whose codewords are equally near the first by name is
    taken, and the row is ambiguous; repeated rows give repeated results; other columns are
    not read but for ``held_out``. A text of any length is read whole, in one pass.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                langs, score, ambiguous = model.predict(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous)],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2 and predict all rows.

    A null doc_id is not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    marked = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    return predict(marked, fit(marked.filter(~F.col("held_out"))))
