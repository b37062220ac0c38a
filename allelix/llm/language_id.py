"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit one logistic classifier over hashed byte n-grams (orders 1 to 3)
says which side a text is on. Decoding weighs each bit's logistic loss by how well that bit did on the training rows,
takes the codeword of least total loss, and flags a text as ambiguous where the second codeword is close.

Up to five languages the code is exhaustive (all splits of the languages); beyond that, ``bits`` columns are drawn
with a seed, keeping those that hold the codewords farthest apart.

The classifiers are fitted on the driver from about ``sample_rows`` rows, chosen by a hash of the id and the text among the rows
that have a text and a language, with about LEAST_ROWS of each language at least, and MOST_LEAST_ROWS for all languages
together; languages are counted over all rows, so that none is left without a codeword. Repeats of a row are one row there. The tasks count the n-grams of the whole chosen texts, whatever their length; the driver gets no
text, but at most BUCKETS shares for each chosen row. Everything else reads whole texts in the tasks, without a shuffle. A
text's sum over n-grams is a gather from the weights and a segmented sum.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all texts where no row has a
language; with one language all texts with a letter get it; null ids are carried along, and repeated rows each get
their row; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

BUCKETS = 1 << 14
#: Rows to learn a language from at least, where it has them; and of all languages at least, whatever their number: with more
#: languages each has fewer rows, and with more than that many the most frequent are learnt.
LEAST_ROWS, MOST_LEAST_ROWS = 30, 1200
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def codewords(n: int, bits: int = 31, seed: int = 5) -> np.ndarray:
    """A matrix of -1 and 1: a row for each class."""
    if n <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c] if n else []
        return np.array(columns, np.int8).reshape(-1, n).T
    draw, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = ((bits - code.astype(int) @ code.T) // 2 + bits * np.eye(n, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of each order at each byte, and where the texts start (a space is put around each text)."""
    framed = pc.binary_join_element_wise("", pc.fill_null(texts, ""), " ", " ").cast(pa.large_binary())
    offsets = np.frombuffer(framed.buffers()[1], np.int64)[framed.offset : framed.offset + len(framed) + 1]
    data = LOWER[np.frombuffer(framed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    second, third = np.append(data[1:], 32).astype(np.uint32), np.append(data[2:], [32, 32]).astype(np.uint32)
    third[offsets[1:] - offsets[0] - 1] = 32  # not the next text's first letter
    out = []
    for order, key in ((1, data), (2, data | second << np.uint32(8)), (3, data | second << np.uint32(8) | third << np.uint32(16))):
        out.append(((key + np.uint32(order << 28)) * np.uint32(2654435761)) >> np.uint32(18))
    return out, offsets[:-1] - offsets[0]


def shares(texts: pa.Array) -> pa.ListArray:
    """Each text's buckets with a share of its n-grams, as lists of (bucket, share)."""
    codes, starts = grams(texts)
    ends, bucket, share = np.append(starts[1:], len(codes[0])), [], []
    for a, b in zip(starts, ends, strict=True):
        n = sum(np.bincount(key[a:b], minlength=BUCKETS) for key in codes)
        bucket.append(np.flatnonzero(n))
        share.append(n[bucket[-1]] / (3 * (b - a)))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in bucket])])
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(bucket).astype(np.int32)), pa.array(np.concatenate(share).astype(np.float32))], ["bucket", "share"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def fit(grams_of: pa.ListArray, labels: list[str], rounds: int = 150, rate: float = 0.05, penalty: float = 1e-4) -> dict:
    """Weights (a column for each bit), offsets, the code, the weight of each bit, and the languages in order, from shares()."""
    names = sorted(set(labels))
    code, place = codewords(len(names)), {x: i for i, x in enumerate(names)}
    target = code[[place[x] for x in labels]].astype(np.float32)
    x = np.zeros((len(labels), BUCKETS), np.float32)
    flat = grams_of.flatten()
    row = np.repeat(np.arange(len(labels)), pc.list_value_length(grams_of).to_numpy(zero_copy_only=False))
    x[row, flat.field("bucket").to_numpy(zero_copy_only=False)] = flat.field("share").to_numpy(zero_copy_only=False)
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    scale = 1 / np.sqrt((x * x).mean(axis=0) + 1e-9)
    x *= scale
    w, b = np.zeros((len(used), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        slope = -target / (1 + np.exp(target * (x @ w + b))) / len(labels)
        g = x.T @ slope + penalty * w
        b -= 4 * rate * slope.sum(axis=0)
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        w -= rate / np.sqrt(len(used)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    right = ((x @ w + b) * target > 0).mean(axis=0)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    weights[used] = w * scale[:, None]
    return {"names": names, "code": code, "weights": weights, "offset": b, "bit_weight": np.maximum(2 * right - 1, 0.05)}


def decode(model: dict, texts: pa.Array, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest codeword, its share, and whether the second is within margin."""
    codes, starts = grams(texts)
    total = 3 * np.diff(np.append(starts, len(codes[0])))
    side = np.empty((len(starts), model["code"].shape[1]))
    for b in range(side.shape[1]):
        column = model["weights"][:, b]
        each = column[codes[0]] + column[codes[1]] + column[codes[2]]
        side[:, b] = np.add.reduceat(each, starts, dtype=np.float64) / total + model["offset"][b]
    share = model["bit_weight"] / model["bit_weight"].sum()
    loss = np.stack([(np.logaddexp(0, -side * row) * share).sum(axis=1) for row in model["code"]], axis=1)
    likely = np.exp(-side.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    order = np.sort(loss, axis=1)
    best = loss.argmin(axis=1)
    return best, likely[np.arange(len(best)), best], (order[:, 1] - order[:, 0]) < margin


def rows_by_language(docs: DataFrame, wanted: Column, sample_rows: int, least: int = LEAST_ROWS) -> DataFrame:
    """doc_id, text, lang, hash: about sample_rows of the wanted rows, and about ``least`` of each language or all it has.

    Rows that repeat an id, its text and its language are one. Languages are counted over all wanted rows; as many as
    MOST_LEAST_ROWS are learnt at most, so there are about sample_rows + MOST_LEAST_ROWS rows whatever their number.
    """
    rows = docs.where(wanted)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LEAST_ROWS).collect()
    total, least = sum(r["count"] for r in counts), min(least, MOST_LEAST_ROWS // max(len(counts), 1))
    share = [(r["lang"], min(1.0, max(sample_rows / total, least / r["count"]))) for r in counts]
    by_lang = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share double"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", "hash"), F.lit(1_000_003)) / 1_000_003
    chosen = hashed.join(by_lang, "lang").where(place < F.col("share"))
    return chosen.groupBy("doc_id", "lang", "hash").agg(F.first("text").alias("text")).select("doc_id", "text", "lang", "hash")


def languages(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500, margin: float = 0.05) -> DataFrame:
    """One row of SCHEMA per row of docs. learn: which rows may be learnt from; held_out: the column of that name."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), learn.alias("learn"), held_out.alias("held_out"))
    wanted = F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")

    def counted():
        return lambda batch: pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "grams": shares(batch.column("text"))})

    chosen = rows_by_language(rows, wanted, sample_rows)
    sample = mapped(chosen, counted, "lang string, doc_id long, hash long, grams array<struct<bucket: int, share: float>>", most=1 << 20).toArrow()
    sample = sample.take(pc.sort_indices(sample.select(["lang", "doc_id", "hash"]), [("lang", "ascending"), ("doc_id", "ascending"), ("hash", "ascending")]))
    labels = sample.column("lang").to_pylist()
    model = fit(sample.column("grams").combine_chunks(), labels) if len(set(labels)) > 1 else {"names": labels[:1]}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            if len(model["names"]) > 1:
                best, score, close = decode(model, texts, margin)
            else:
                best, score, close = np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
                letters &= bool(model["names"])
            names = np.array([*model["names"], "und"], object)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names[np.where(letters, best, -1)], pa.string()), "score": np.where(letters, score, 0.0), "ambiguous": close & letters})

        return work

    return mapped(rows.select("doc_id", "text", "held_out"), make, SCHEMA, most=1 << 20)
