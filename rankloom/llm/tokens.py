"""Sizes of documents in tokens of a public tokenizer. The vocabulary is a file whose path is a parameter."""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, unless a call names a file.
FOLDER = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None):
    """The encoding of a .tiktoken file of ranks (default: the 50k byte-level vocabulary)."""
    import tiktoken

    path = path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, columns: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """``columns`` and ``n_tokens`` of every document: whole texts, null counts as empty. No shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", n_tokens bigint"

    def run(batches):
        encoding = vocabulary(path)
        for pdf in batches:
            pdf["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pdf.drop(columns="_text")

    return docs.select(*columns, F.col(text).alias("_text")).mapInPandas(run, schema)
