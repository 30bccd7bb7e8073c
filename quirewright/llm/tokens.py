"""Token counts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's tokenizer cuts text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary file is looked for unless a path is given.
VOCABULARY = os.environ.get("QUIREWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def with_tokens(rows: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of tokens of the column text (0 for a null text).

    The vocabulary file is read on the driver and sent to the tasks; its size doesn't grow with the data.
    """
    with open(vocabulary, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    kept = rows.select(*keep)
    schema = kept.schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return rows.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)
