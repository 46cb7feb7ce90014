"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, lower-cased by byte, and runs of marks. Word 1-, 2- and 3-grams are hashed into 2**18
places; a 2-gram of one word twice is one n-gram whatever the word, and so is a 3-gram whose ends are one word. The n-grams
of a size share a weight of one, so a text's score is the sparse dot product of relative frequencies and weights, whatever
its length.

Training (FTRL-Proximal: per-coordinate rates, L1 and L2) runs in one task over a bounded sample of labelled rows, at most
``per_class`` of each label, taken by hash of doc_id; rows with crc32(doc_id) mod 5 = 0 are held out. The weights
(``2**bits`` floats, 2 MB) are broadcast; scoring is row by row in Arrow batches, a segment of a text at a time, without a
shuffle.

Cases: null text counts as empty; an empty text scores the intercept. Null ids are never trained on and not held out.
Unlabelled rows are scored like all others; with no labels at all every score is 0.5. Repeated rows are scored each.
An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of
from tessera.llm.hashing import U, segments, span_hashes

BITS = 18
#: Kinds of bytes: white space 0, letters and digits 1, marks 2.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is 0 mod 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8."""
    b = np.frombuffer(raw, np.uint8)
    kind = KIND[b]
    starts = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    ends = np.r_[starts[1:], len(b)]
    some = kind[starts] > 0
    return mixed(span_hashes(b + ((b >= 65) & (b <= 90)) * np.uint8(32), starts[some], ends[some]))


def features(text: str, bits: int = BITS) -> Iterator[list[np.ndarray]]:
    """Hashed n-grams, those of a size together, a segment of the text at a time."""
    before = np.zeros(0, U)
    for raw in segments(text.encode("utf-8", "surrogatepass")):
        w = np.r_[before, words(raw)]
        two, three = len(before[1:]), 0  # n-grams that the segment before has had
        pairs = np.where(w[:-1] == w[1:], U(99), w[:-1] * U(31) + w[1:] + U(7))[two:]
        triples = np.where(w[:-2] == w[2:], U(98), w[:-2] * U(41) + w[1:-1] * U(43) + w[2:] + U(3))[three:]
        yield [(mixed(f) >> U(64 - bits)).astype(np.int64) for f in (w[len(before) :], pairs, triples)]
        before = w[-2:]


def sparse(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; the values of a size add up to one."""
    found = [np.concatenate(f) for f in zip(*features(text, bits), strict=True)]
    at, place = np.unique(np.concatenate(found), return_inverse=True)
    return at, np.bincount(place, np.concatenate([np.full(len(f), 1 / max(len(f), 1)) for f in found]), len(at))


class Ftrl:
    """FTRL-Proximal for logistic loss; the last place is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.002, l2: float = 0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.r_[at, len(self.z) - 1], np.r_[x, 1.0]
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def score(text: str, w: np.ndarray, bits: int = BITS) -> float:
    total, n = np.zeros(3), np.zeros(3)
    for found in features(text, bits):
        total += [w[f].sum() for f in found]
        n += [len(f) for f in found]
    return float(1 / (1 + np.exp(-np.clip(w[-1] + (total / np.maximum(n, 1)).sum(), -35, 35))))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(y, text): of each class at most ``per_class`` labelled rows that aren't held out, those of least id hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = some[0].unionByName(some[1])  # 2 * per_class rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")


def train(rows: DataFrame, epochs: int = 3, bits: int = BITS) -> np.ndarray:
    """Weights from (doc_id, y, text), learned in one task in order of id hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(*sparse(t, bits), y) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = Ftrl(bits)
        for _ in range(epochs):
            for at, x, y in examples:
                model.learn(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f8").tobytes()], pa.binary())], names=["w"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "text").select("y", "text")
    got = one.mapInArrow(run, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f8") if got else np.zeros((1 << bits) + 1)


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, per_class: int = 2000, epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    w = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "quality", per_class), epochs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score(t.as_py(), w.value) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, per_class: int = 2000, epochs: int = 3) -> DataFrame:
    """``docs`` without the rows that score below ``least``; same columns, no shuffle."""
    w = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "quality", per_class), epochs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or "", w.value) >= least for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
