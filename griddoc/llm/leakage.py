"""Passages of evaluation items inside corpus documents.

A pair counts if RUN consecutive words of the item stand consecutively in the document. Items are short and documents
long, so plain MinHash similarity is low even for full leaks; both sides are therefore cut into parts of one size, every
window of RUN words, for which the containment looked for is exactly 1. The MinHash signature of a window is the least hash
of its shingles of SHINGLE words under each of SIGNATURE hash functions. Two equal windows have equal shingles, hence equal
signatures: the search loses no pair. The candidates are then verified by exact containment of a shingle of RUN words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from griddoc import session
from griddoc.session import checkpointed, small

RUN = 12
SHINGLE = 5
SIGNATURE = 4
#: Words whose hash is kept per worker; beyond that the store is emptied, which changes the speed only.
KEPT = 300_000
_WORD = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _hash(word: str) -> int:
    if (h := _known.get(word)) is None:
        if len(_known) > KEPT:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word)
    return h


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every size consecutive values, by doubling the reach."""
    reach = 1
    while reach * 2 <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signatures(ws: list[str]) -> np.ndarray:
    """MinHash signature of each window of RUN words, as one number, in order; none for fewer words."""
    if len(ws) < RUN:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hash, ws), np.uint64, len(ws))
    n = len(ws) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = np.zeros(len(ws) - RUN + 1, np.uint64)
    for k in range(SIGNATURE):
        x = (s ^ (s >> np.uint64(31 - 2 * k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        x ^= x >> np.uint64(29)
        out = out * np.uint64(0x94D049BB133111EB) + _least(x, RUN - SHINGLE + 1)
    return out.view(np.int64)


def fingerprints(ws: list[str]) -> np.ndarray:
    """The distinct signatures."""
    return np.unique(signatures(ws))


def _marks(rows: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprints(words(t)) for t in b.column(1).to_pylist()]
            owner = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(m) for m in marks])
            flat = np.concatenate(marks) if marks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(flat, pa.int64())], [key, "mark"])

    return rows.where(F.col("text").isNotNull()).select(F.col(key).cast("long"), "text").mapInArrow(run, f"{key} long, mark long")


@F.pandas_udf(T.BooleanType())
def _leaks(item: pd.Series, doc: pd.Series) -> pd.Series:
    runs: dict[str, set] = {}
    out = []
    for i, d in zip(item, doc):
        if i not in runs:
            if len(runs) > 5000:
                runs.clear()
            ws = words(i)
            runs[i] = {tuple(ws[k : k + RUN]) for k in range(len(ws) - RUN + 1)}
        ws, want = words(d), runs[i]
        out.append(any(tuple(ws[k : k + RUN]) in want for k in range(len(ws) - RUN + 1)))
    return pd.Series(out, dtype=bool)


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, mark, window): the windows of each item and their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                found = signatures(ws).tolist()
                ids += [i] * len(found)
                marks += found
                texts += [" ".join(ws[k : k + RUN]) for k in range(len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(texts, pa.string())], ["item_id", "mark", "window"])

    return items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, mark long, window string").distinct()


def _at_scan(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): search and verification in one pass over the documents, which holds all windows of the items."""
    held: dict[str, list[int]] = {}
    marks = []
    for r in windows.toLocalIterator():
        held.setdefault(r["window"], []).append(r["item_id"])
        marks.append(r["mark"])
    shared = docs.sparkSession.sparkContext.broadcast((np.unique(np.array(marks, np.int64)), held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_window = shared.value
        for b in batches:
            pairs = set()
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                found = signatures(ws)
                if not len(known) or not len(found):
                    continue
                near = known[np.searchsorted(known, found).clip(max=len(known) - 1)] == found
                for k in np.flatnonzero(near).tolist():
                    pairs |= {(item, i) for item in by_window.get(" ".join(ws[k : k + RUN]), ())}
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs)], ["item_id", "doc_id"])

    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item_id long, doc_id long").distinct()


def candidates(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) with a window's MinHash (mark) in common."""
    return _marks(docs, "doc_id").join(marks, "mark").select("item_id", "doc_id").distinct()


def leaks(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Every pair (item_id, doc_id) of which RUN consecutive words are shared.

    items: item_id, text; docs: doc_id, text; other columns are ignored. Null, empty and short texts share nothing; repeated
    ids give the pair once; empty tables give no row. Up to BROADCAST_ROWS windows of items are held by each worker, so the
    documents are read once and never shuffled; beyond, signatures are joined, and only texts of candidates are.
    """
    windows = checkpointed(_windows(items))
    if windows.limit(session.BROADCAST_ROWS + 1).count() <= session.BROADCAST_ROWS:
        return _at_scan(windows, docs)
    pairs = checkpointed(candidates(windows.select("item_id", "mark").distinct(), docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text"))
    texts = texts.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    return pairs.join(wanted, "item_id").join(texts, "doc_id").where(_leaks("item_text", "doc_text")).select("item_id", "doc_id").distinct()
