"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameter, not part of the repository: where the vocabulary file lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):  # noqa: ANN201
    """tiktoken encoding of a rank file; one per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Key columns and ``n_tokens``; null text has 0 tokens. Whole texts, one pass, no shuffle."""
    slim = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    return slim.mapInArrow(run, f"{schema}, n_tokens bigint")
