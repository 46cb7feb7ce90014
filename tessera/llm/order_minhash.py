"""Document fingerprints by Order MinHash.

A text's k-mers (of code points) are numbered by occurrence, so that equal k-mers at different places differ. Every
numbered k-mer is hashed once; the leading bits of the hash deal it into one of ``bins`` (one-permutation hashing, in place
of as many independent permutations). Of each bin the ``chosen`` least are taken, put back into text order, and the tuple is
hashed to one component. Two texts agree in a component when they share the least k-mers *and* their order, so the share of
equal components falls with edit distance, not only with the k-mer sets. Bins that are empty in both texts don't count.

Scale: documents are dealt into ranges of their order (doc_id, then text and place), one task each and about ``range_mb`` of
input, by cut points from a sample of the order's columns. So no id, null or repeated, fills a task of its own, and any cuts
give the same rows. Each range is sorted and streamed, and the first document of a range is added to the range before it, so
"the next document" needs no global window. One shuffle of the texts; a task holds one Arrow batch and two documents. What
reaches the driver is a bounded number of sampled keys, and one for each of at most ``most_ranges`` ranges.

Cases: null text counts as empty; an empty text has no k-mer and all components empty, two empty texts are alike 1, an empty
and another 0. A text shorter than k has one k-mer, itself. Order is by doc_id, nulls first, repeated ids by the first 64
characters of the text, then by a hash of it and by place (rows alike in both are interchangeable). After the last document
comes the first; a single document is its own next. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, table, text_of, with_place

U = np.uint64
EMPTY = 0xFFFFFFFF
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, k a power of two, by doubling: a 2j-mer from two j-mers."""
    h, step, base = codes.astype(U) + U(1), 1, 0x9E3779B97F4A7C15
    while step < k:
        h = h[:-step] * U(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    return mixed(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence): the first occurrence keeps the k-mer's."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    again = np.zeros(len(h), bool)
    again[1:] = same
    again[:-1] |= same
    at = np.sort(order[again])
    at = at[np.argsort(h[at], kind="stable")]
    values = h[at]
    new = np.r_[True, values[1:] != values[:-1]]
    first = np.flatnonzero(new)
    number = (np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))).astype(U)
    out = h.copy()
    out[at] = np.where(number > 0, mixed(values + number * U(0xD1342543DE82EF95)), values)
    return out


def signature(text: str, k: int = 8, chosen: int = 2, bins: int = 128) -> np.ndarray:
    """Components of a text (uint32; EMPTY where a bin has no k-mer)."""
    out = np.full(bins, EMPTY, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return out
    if len(codes) < k:
        codes = np.r_[codes, np.zeros(k - len(codes), np.uint32)]
    g = numbered(kmer_hashes(codes, k))
    shift = U(64 - (bins.bit_length() - 1))
    at = np.arange(len(g))
    if len(g) > 16 * bins:  # some of the least of every bin, nearly always enough
        low = np.flatnonzero((g << U(bins.bit_length() - 1)) < U(int(2**64 * 12 * bins / len(g))))
        if (np.bincount((g[low] >> shift).astype(np.int64), minlength=bins) >= chosen).all():
            at = low
    at = at[np.argsort(g[at])]
    of = (g[at] >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    at, of = at[rank < chosen], of[rank < chosen]
    order = np.lexsort((at, of))  # text order within a bin
    at, of = at[order], of[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    place = (np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))).astype(U)
    parts = mixed(g[at] + (place + U(1)) * U(0xA0761D6478BD642F))
    out[of[first]] = (mixed(np.add.reduceat(parts, first)) >> U(33)).astype(np.uint32)  # 31 bits: never EMPTY
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components among those that either text has."""
    some = (a != EMPTY) | (b != EMPTY)
    n = int(some.sum())
    return float(((a == b) & some).sum() / n) if n else 1.0


def shown(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many, or all, of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Columns of the order; any two rows differ in one.
ORDER = ("known", "doc_id", "head", "tie", "file", "row")


def _cuts(keys: DataFrame, ranges: int, each: int = 24) -> list[tuple]:
    """At most ``ranges`` - 1 ascending keys that part the rows evenly, from a sample by hash of about ``each`` a range."""
    n = keys.count()
    if not n or ranges < 2:
        return []
    share = max(1, n // (each * ranges))
    found = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(F.lit(9), "file", "row"), F.lit(share)) == 0).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)} - {found[0]}) if found else []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, chosen: int = 2, bins: int = 128, range_mb: int = 16, most_ranges: int = 20_000) -> DataFrame:
    """Fingerprints of ``docs`` and of their edited texts (``SCHEMA``), with likeness to the edited and the next document."""
    spark = docs.sparkSession
    rows = with_place(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "path", "row", "fingerprint-rows")
    rows = rows.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("tie"), F.xxhash64("path").alias("file"), "row", "text"
    )
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the input, by the files' sizes
    ranges = min(most_ranges, max(partitions(spark), size // (range_mb << 20)))
    cuts = _cuts(rows.select(*ORDER), ranges)
    n_null = sum(not c[0] for c in cuts)  # cuts among null ids come first
    firsts = np.array([c[1] for c in cuts[n_null:]], np.int64)

    @F.pandas_udf("int")
    def range_of(known: pd.Series, ids: pd.Series, head: pd.Series, tie: pd.Series, file: pd.Series, row: pd.Series) -> pd.Series:
        known, ids = known.to_numpy(bool), ids.to_numpy()
        place = n_null + np.searchsorted(firsts, ids, "left").astype(np.int32)
        for i in np.flatnonzero(~known | np.isin(ids, firsts)):  # where the id is no answer the whole key decides
            place[i] = bisect_right(cuts, (bool(known[i]), int(ids[i]), head.iat[i], int(tie.iat[i]), int(file.iat[i]), int(row.iat[i])))
        return pd.Series(place)

    dealt = rows.select(range_of(*ORDER).alias("part"), F.lit(0).alias("added"), *ORDER, "text")
    starts = dealt.groupBy("part").agg(F.min(F.struct(*ORDER)).alias("key")).orderBy("part").collect()  # one row a range
    to = [(starts[i - 1]["part"], r["key"]["file"], r["key"]["row"]) for i, r in enumerate(starts)]
    heads = spark.createDataFrame(to, "part int, file long, row long")
    following = rows.join(F.broadcast(heads), ["file", "row"]).select("part", F.lit(1).alias("added"), *ORDER, "text")
    every = dealt.unionByName(following).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "added", *ORDER)
    keyed = every.select("part", "added", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, doc_id, text, signature
        for b in batches:
            out = []
            for part, added, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py()
                own = signature(text, k, chosen, bins)
                if before is not None and before[0] == part:
                    _, last, old, sig = before
                    made = edited(old, text)
                    new = sig if made == old else signature(made, k, chosen, bins)
                    out.append((last, len(old), hashlib.sha256(made.encode()).hexdigest(), shown(sig), shown(new), likeness(sig, new), likeness(sig, own)))
                before = None if added else (part, doc, text, own)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return keyed.mapInArrow(run, SCHEMA)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
