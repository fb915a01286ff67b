"""The whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm import bpe
from newsloom.session import spread

#: Characters that a worker encodes at a time.
CHARS = 1_000_000


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = bpe.DEFAULT_NAME, folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ``ids`` of each row, without special tokens.

    Empty and null texts have an empty list; their strings for special tokens
    are ordinary text. Repeated rows are encoded each; other columns are left
    out. A text is encoded whole, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in bpe.slices(texts, CHARS):
                e = coder.encode(texts[s])
                ids = pa.ListArray.from_arrays(pa.array(e.bounds, pa.int32()), pa.array(e.ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
