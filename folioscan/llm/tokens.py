"""Encoding a whole corpus with a public tokenizer (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe

#: Characters that are encoded at once; bounds a worker's memory, not a text's length.
BATCH_CHARS = 2_000_000
#: A place where every cut leaves the words of both sides as they are: letter, space, letter.
_SAFE = re.compile("(?<=[a-z]) (?=[a-z])")


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > BATCH_CHARS and (m := _SAFE.search(text, start + BATCH_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encoded(encoder: bpe.Encoder, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: their bounds, all their ids on end, and the number of ids of each."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if total and total + n > BATCH_CHARS:
            yield start, i, *encoder(texts[start:i])
            start, total = i, 0
        total += n
        if n > 2 * BATCH_CHARS:  # alone: in pieces
            parts = [encoder([p])[0] for p in _pieces(t)]
            ids = np.concatenate(parts)
            yield i, i + 1, ids, np.array([len(ids)], np.int64)
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts), *encoder(texts[start:])


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(``id_col``, ``ids``): the token ids of every row's text, without special tokens.

    Method: speculate and verify, see :mod:`folioscan.llm.bpe`.  One narrow stage: no
    shuffle, the text column alone leaves the scan, ids return as Arrow lists.

    Defined results: a null and an empty text have the empty list; blank text has
    its tokens; repeated rows and null ids each give a row; other columns are ignored.
    Texts are encoded whole, however long.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(path)
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b, ids, sizes in encoded(encoder, texts):
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(``id_col``, ``n_tokens`` bigint): sizes as :func:`encode_corpus` would give them; null and empty: 0."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(path)
        for part in parts:
            texts = part.column(1).to_pylist()
            sizes = [n for _, _, _, n in encoded(encoder, texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64))], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(ids: list[int], path: str = bpe.DEFAULT_VOCABULARY) -> str:
    """The text that was encoded."""
    v = bpe.vocabulary(path)
    back = {i: t for t, i in v.tokens.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")


__all__ = ["encode_corpus", "count_tokens", "decode"]
