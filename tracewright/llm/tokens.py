"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter and stays where it is."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.sources.tables import spread

DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Letters, digits, other signs and blanks apart, as byte-level vocabularies expect.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in pieces, cut only where the pattern parts words anyway, so that counts stay those of the whole.
PIECE = 100_000
_BORDER = re.compile(r"(?<=\S)(?= \S)|(?<=[^\W\d_])(?=[,.;:!?。、，！？；：()\[\]{}])")

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file, once per worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _loaded[path]


def count(text: str | None, path: str = DEFAULT) -> int:
    """Tokens of the whole text; 0 for null and empty ones."""
    if not text:
        return 0
    encode = encoder(path)
    if len(text) <= PIECE or not path.endswith(".tiktoken"):
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        border = _BORDER.search(text, at + PIECE)
        stop = border.start() if border else len(text)
        total += len(encode(text[at:stop]))
        at = stop
    return total


def with_sizes(documents: DataFrame, path: str = DEFAULT) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count(t, path) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes], ["doc_id", "source", "n_tokens"])

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id long, source string, n_tokens long")
