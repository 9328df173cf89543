"""Language identification with error-correcting output codes (operator 10).

Each language has a codeword of bits. One binary classifier over hashed byte n-grams
predicts each bit; the losses of a text's predictions against every codeword, weighted by
how reliable each classifier proved in training, decide for the nearest codeword. A text
that lies between two codewords is flagged as ambiguous.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clinote.llm.workers import map_batches, slices

UNDETERMINED = "und"
NOT_LETTERS = r"[^\p{L}\p{M}]+"
_SLICE_BYTES, _SLICE_ROWS = 2 << 20, 256  # a row takes a vector of all dimensions


@dataclasses.dataclass(frozen=True)
class Model:
    """``codes`` is languages x bits of -1 and 1, ``weights`` features x bits."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 per language: all splits of up to 5 languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        splits = [[1 if k == 0 or not split >> (k - 1) & 1 else -1 for k in range(n)] for split in range(1, 2 ** (n - 1))]
        return np.array(splits, dtype=np.int8).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, farthest = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -bits)
        columns_differ = (np.abs(code.sum(axis=0)) < n).all()
        if columns_differ and (apart := (bits - agree.max()) // 2) > farthest:
            best, farthest = code, apart
    if best is None:
        raise ValueError(f"no code found for {n} languages")
    return best


def _letters(texts: pa.Array) -> pa.Array:
    """Lower-case letters with single blanks between words and around the text; nothing if there is no letter."""
    words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS, " "), " ")
    return pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise(" ", words, " ", ""))


def features(texts: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square roots of hashed 2- and 3-byte counts; whether a text has letters."""
    letters = _letters(texts)
    has_letters = pc.not_equal(letters, "").to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(letters.to_pylist()).encode(), dtype=np.uint8).astype(np.uint32)
    sizes = pc.binary_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    counts = np.zeros(len(sizes) * dimensions, dtype=np.float32)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    for n in (2, 3):
        if len(data) < n:
            break
        gram = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            gram = (gram * np.uint32(257)) + data[k:len(data) - n + 1 + k]
        place = ((gram * np.uint32(2654435761)) >> shift).astype(np.int64)
        inside = owner[:len(gram)] == owner[n - 1:]
        place = (owner[:len(gram)] * dimensions + place)[inside]
        counts += np.bincount(place, minlength=len(counts)).astype(np.float32)
    vectors = np.sqrt(counts).reshape(len(sizes), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-9), has_letters


def is_held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from: a quarter, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
    max_per_language: int = 256, dimensions: int = 1 << 13, steps: int = 300, rate: float = 4.0,
    penalty: float = 1e-4,
) -> Model | None:
    """Fit the bit classifiers on a bounded sample; None where no row has both label and letters.

    ``max_per_language`` bounds the sample: per label, rows are drawn by the hash of their
    key so that about that many come, and no more than twice as many are taken. Whole texts
    are turned into vectors where they lie; only vectors of ``dimensions`` numbers reach
    the driver. Rows without key, text or label teach nothing.
    """
    rows = labelled.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.coalesce(*[F.when(F.col("label") == name, F.lit(max_per_language / n)) for name, n in sizes.items()])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE_BYTES, _SLICE_ROWS):
            made, has_letters = features(batch.column(0), dimensions)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in made[has_letters]], pa.binary()),
                 batch.column(1).filter(pa.array(has_letters))],
                names=["vector", "label"],
            )

    drawn = rows.filter((draw < share) & F.col("text").isNotNull()).select("text", F.col("label").cast("string"))
    sample = map_batches(drawn, vectors, "vector binary, label string").limit(2 * max_per_language * len(languages))
    sample = sorted((r["label"], bytes(r["vector"])) for r in sample.collect())
    if not sample:
        return None
    languages = sorted({name for name, _ in sample})
    x = np.frombuffer(b"".join(v for _, v in sample), dtype=np.float32).reshape(len(sample), dimensions)
    y = np.array([languages.index(name) for name, _ in sample])
    codes = codewords(len(languages))
    target = codes[y].astype(np.float32)
    weight = (1.0 / np.bincount(y)[y]).astype(np.float32)[:, None] / len(languages)
    weights, bias = np.zeros((dimensions, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    for _ in range(steps):
        slope = -target * weight / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30)))
        weights -= rate * (len(languages) * (x.T @ slope) + penalty * weights)
        bias -= rate * slope.sum(axis=0)
    right = ((x @ weights + bias) * target > 0).astype(np.float32)
    reliability = np.maximum((right * weight).sum(axis=0), 0.5)
    return Model(languages, codes, weights, bias, reliability / reliability.sum() * codes.shape[1])


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss: its place, its share of belief, its lead over the next."""
    losses = np.logaddexp(0, -model.codes[None, :, :] * margins[:, None, :])
    belief = -(losses * model.reliability).sum(axis=2)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    belief /= belief.sum(axis=1, keepdims=True)
    ranked = np.sort(belief, axis=1)
    lead = ranked[:, -1] - (ranked[:, -2] if belief.shape[1] > 1 else 0.0)
    return belief.argmax(axis=1), ranked[:, -1], lead


def distance(model: Model, margins: np.ndarray) -> np.ndarray:
    """Weighted loss to the nearest codeword: small where all classifiers agree with one, large for noise."""
    losses = np.logaddexp(0, -model.codes[None, :, :] * margins[:, None, :])
    return (losses * model.reliability).sum(axis=2).min(axis=1)


def _judge(
    model: Model | None, texts: pa.Array, min_lead: float, max_distance: float = float("inf")
) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(texts)
    if model is None or not n:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, dtype=bool)
    vectors, has_letters = features(texts, len(model.weights))
    margins = vectors @ model.weights + model.bias
    place, score, lead = decode(model, margins)
    names = [model.languages[p] if letters else UNDETERMINED for p, letters in zip(place, has_letters)]
    unsure = (lead < min_lead) | (distance(model, margins) > max_distance)
    return names, np.where(has_letters, score, 0.0), has_letters & unsure


def predict(
    df: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text", min_lead: float = 0.1
) -> DataFrame:
    """``key, lang_pred, score, is_ambiguous`` for every row.

    Text that is null or has no letter gives ``und`` with score 0, as does every text
    without a model. Rows are judged one by one: repeated rows and null keys stay, further
    columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE_BYTES, _SLICE_ROWS):
            names, scores, unsure = _judge(model, batch.column(1), min_lead)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure)],
                names=[key, "lang_pred", "score", "is_ambiguous"],
            )

    schema = f"`{key}` {dict(df.dtypes)[key]}, lang_pred string, score double, is_ambiguous boolean"
    return map_batches(df.select(key, df[text].alias("text")), run, schema)


def rejection_distance(
    labelled: DataFrame, model: Model | None, *, text: str = "text", label: str = "lang", share: float = 0.001
) -> float:
    """The distance from the nearest codeword beyond which a text is of no known language.

    A third of the way from where but ``share`` of the labelled texts with letters lie to where a text lies that says
    nothing to any classifier, so that few labelled texts do not make a narrow limit.
    All labelled texts count. Without any, or without a model, no text is too far.
    """
    if model is None:
        return float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE_BYTES, _SLICE_ROWS):
            vectors, has_letters = features(batch.column(0), len(model.weights))
            far = distance(model, vectors @ model.weights + model.bias)
            yield pa.RecordBatch.from_arrays([pa.array(far[has_letters].astype(np.float64))], names=["distance"])

    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"))
    found = map_batches(rows, run, "distance double").agg(F.percentile_approx("distance", 1 - share, 100_000)).first()[0]
    nothing = float(distance(model, np.zeros((1, model.codes.shape[1])))[0])
    return float("inf") if found is None else found + max(0.0, nothing - found) / 3


def keep_determined(
    df: DataFrame, model: Model | None, *, text: str = "text", min_lead: float = 0.1, max_distance: float = float("inf")
) -> DataFrame:
    """The rows, with all their columns, whose language is determined: neither ambiguous nor too far from any codeword.

    Without a model all rows stay.
    """
    if model is None:
        return df
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _SLICE_BYTES, _SLICE_ROWS):
            names, _, unsure = _judge(model, batch.column(columns.index(text)), min_lead, max_distance)
            keep = [name != UNDETERMINED and not doubt for name, doubt in zip(names, unsure)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(df, run, df.schema)
