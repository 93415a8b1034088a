"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, held_out, plus, table

UNKNOWN = "und"
_BLOCK = 1 << 20
_LETTER = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters; filled once in each process."""
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


@dataclass(frozen=True)
class Spectrum:
    """Which character n-grams (1 to max_n) of a text are present, hashed to 2**bits slots.

    A text is lower-cased, and every run of code points that are not letters counts as one space.
    """

    max_n: int = 3
    bits: int = 13

    def row(self, text: str | None) -> np.ndarray | None:
        """Presence of each slot; None for a null text or one without a letter. Works through the text in blocks."""
        if not text:
            return None
        seen = np.zeros(1 << self.bits, dtype=bool)
        letters, any_letter, tail = _letters(), False, np.zeros(0, dtype=np.uint64)
        for at in range(0, len(text), _BLOCK):
            code = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            is_letter = letters[code]
            any_letter = any_letter or bool(is_letter.any())
            code = np.where(is_letter, code, 32).astype(np.uint64)
            if tail.size:
                code = np.concatenate([tail, code])
            keep = np.ones(code.size, dtype=bool)
            keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
            code = code[keep]
            gram = code + np.uint64(1)
            for n in range(1, self.max_n + 1):
                if n > 1:
                    gram = gram[:-1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
                if not gram.size:
                    break
                mixed = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
                seen[mixed.astype(np.intp)] = True
            tail = code[-(self.max_n - 1) :] if self.max_n > 1 else code[:0]
        return seen if any_letter else None


@dataclass(frozen=True)
class Model:
    spectrum: Spectrum
    langs: list[str]
    landmarks: np.ndarray  # landmarks x slots, rows of unit length
    weights: np.ndarray  # landmarks x langs

    def scores(self, present: np.ndarray) -> np.ndarray:
        """Regression outputs of a batch of presence rows: one kernel product, one product with the weights."""
        x = present.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return ((x @ self.landmarks.T) / norm) @ self.weights


def _features(spectrum: Spectrum):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spectrum.row(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, r in enumerate(rows) if r is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([np.packbits(rows[i]).tobytes() for i in keep], pa.binary())],
                ["lang", "present"],
            )

    return run


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    *,
    spectrum: Spectrum = Spectrum(),
    rows_per_lang: int = 400,
    max_rows: int = 100_000,
    max_langs: int = 1000,
    landmarks: int = 96,
    ridge: float = 1e-2,
) -> Model | None:
    """Fit on at most rows_per_lang distinct texts of each value of lang, on fewer where all values together would go over
    max_rows, on one at least; of more than max_langs values those with most distinct texts are learned.

    Rows with a null lang or text teach nothing, and a text counts once for a lang however often it repeats: the sample has
    the texts of the smallest hashes among the distinct ones. Hashes are made distinct before they move and each task hands
    on rows_per_lang a lang at most, so a lang with a third of all rows is thinned before it is shuffled; the texts follow
    by a join with what was chosen, max_rows + max_langs hashes at most. The driver gets one packed presence row (2**bits / 8
    bytes) for each text of the sample. landmarks are shared out among the langs, one each at least, in the order of a hash
    of their presence rows. None if no row can be learned from.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    distinct = rows.select("lang", "h").distinct()
    langs = distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not langs:
        return None
    rows_per_lang = max(1, min(rows_per_lang, max_rows // len(langs)))
    chosen = distinct.where(F.col("lang").isin([r["lang"] for r in langs])) if len(langs) == max_langs else distinct
    chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= rows_per_lang).select("lang", "h")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    got = sample.mapInArrow(_features(spectrum), "lang string, present binary").collect()
    if not got:
        return None
    got = sorted(((r["lang"], bytes(r["present"])) for r in got), key=lambda g: (g[0], xxhash.xxh64_intdigest(g[1]), g[1]))
    langs = sorted({g[0] for g in got})
    at = {v: i for i, v in enumerate(langs)}
    x = np.unpackbits(np.frombuffer(b"".join(g[1] for g in got), dtype=np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    label = np.array([at[g[0]] for g in got])
    each = max(1, landmarks // len(langs))
    marks = x[np.concatenate([np.flatnonzero(label == i)[:each] for i in range(len(langs))])]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # landmark kernel to the power -1/2
    phi = (x @ marks.T).astype(np.float64) @ root
    sign = np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = (1 / np.bincount(label, minlength=len(langs)))[label]  # each lang weighs the same
    gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) * weight.sum() / len(langs) / len(label)
    beta = np.linalg.solve(gram, (phi * weight[:, None]).T @ sign)
    return Model(spectrum, langs, marks, (root @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text: str = "text", *, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, then the predicted lang and a score of 0 to 1 (half of one plus the best regression output, cut to that range).

    `und` with score 0 where the text is null, has no letter, or nothing was learned. Ties go to the first lang in order.
    The text is read whole. Every row is kept, repeated ones too. Columns of docs named as label or score are replaced.
    """
    docs, spark = docs.drop(label, score), docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # landmarks * 2**bits floats, fixed by the parameters
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                rows = [m.spectrum.row(t) for t in part.column(at).to_pylist()] if m else []
                keep = [i for i, r in enumerate(rows) if r is not None]
                if keep:
                    out = m.scores(np.stack([rows[i] for i in keep]))
                    best = out.argmax(axis=1)
                    scores[keep] = np.clip((1 + out[np.arange(len(keep)), best]) / 2, 0, 1)
                    for i, b in zip(keep, best, strict=True):
                        names[i] = m.langs[b]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, label, score])

    return docs.mapInArrow(run, plus(docs, {label: "string", score: "double"}))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, labelled: DataFrame, *, least: float = 0.35) -> DataFrame:
    """The pipeline's filter: the rows and columns of docs whose language is recognised with a score of least or more."""
    label, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = predict(docs, fit(labelled), label=label, score=score)
    return found.where((F.col(label) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
