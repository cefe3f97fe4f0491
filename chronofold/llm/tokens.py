"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; override with the parameter or the environment.
TOKENIZERS = os.environ.get("CHRONOFOLD_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before byte-pair merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows sent to the tokenizer in one go.
ROWS = 512

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a ``.tiktoken`` file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens``, the size of the whole text in tokens.

    NULL and empty texts have 0 tokens. Special tokens' strings are ordinary text. Only ``keep`` and ``text`` are read; the columns of ``keep`` may have any names but ``n_tokens``.
    """
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    types = documents.select(*[F.col("`" + c + "`") for c in keep]).schema

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                counts = []
                for t in b.column(b.num_columns - 1).to_pylist():
                    counts.append(len(enc.encode_ordinary(t)) if t else 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in types), "n_tokens long"])
    return documents.select(*[F.col("`" + c + "`") for c in keep], F.col(text).cast("string").alias("_text")).mapInArrow(sizes, schema)
