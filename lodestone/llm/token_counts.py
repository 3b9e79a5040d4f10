"""Token counts without tokens: a text has as many as its words have symbols, less the merges."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from lodestone.llm.bpe import merged_count, pieces, symbols, vocabulary
from lodestone.llm.common import with_text_columns

LIMIT = 2048
# Words whose counts a worker remembers; when it is full it starts again.
MEMORY = 400_000

FIELDS = [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())]

_counts: dict[str, dict[str, int]] = {}


def _columns(texts: pa.Array, path: str, limit: int) -> dict[str, pa.Array]:
    vocab = vocabulary(path)
    known = _counts.setdefault(path, {})
    plain = texts.fill_null("")
    out = np.zeros(len(plain), dtype=np.int64)
    for first, some in pieces(plain.to_pylist(), vocab):
        many = np.ones(len(some.words), dtype=np.int64)
        for i, word in enumerate(some.words):
            n = known.get(word)
            if n is None:
                if some.special[i] >= 0:
                    continue
                if len(known) >= MEMORY:
                    known.clear()
                n = known[word] = merged_count(symbols(vocab, word), vocab.pairs)
            many[i] = n
        out[first : first + some.n_texts] = np.bincount(some.text, weights=many[some.word], minlength=some.n_texts)
    return {"n_bytes": pa.compute.binary_length(plain).cast(pa.int64()), "n_tokens": pa.array(out), "over_limit": pa.array(out > limit)}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT, keep_text: bool = False) -> DataFrame:
    """Every row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; columns of these names are replaced.

    ``tokenizer`` is the path of a tokenizer file that :mod:`lodestone.llm.bpe` covers. No
    tokens are added for beginnings and ends; the file's special strings inside a text
    are one token each. Null and empty texts have none. A word of any length takes
    time in proportion to its length, but for a logarithm. Nothing is shuffled.
    """
    return with_text_columns(docs, partial(_columns, path=tokenizer, limit=limit), FIELDS, text, keep_text)
