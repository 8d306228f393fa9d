"""Token counts: exact lengths under a byte-level BPE tokenizer, without moving a pre-token.

The text is cut into pre-tokens. Their token lengths come from two tiers: a broadcast table of frequent pre-tokens (the
entries of the vocabulary itself, measured with the tokenizer, so its size is fixed by the vocabulary) and a cache in each worker that asks the
tokenizer for what the table lacks. The cache is emptied when it reaches ``CACHE_ENTRIES``, so memory stays bounded and results do
not depend on it. Texts with a special token's string, or with characters whose class may differ between Unicode versions, go to the
tokenizer as a whole.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole; repeated rows and ids are counted one by
one; an empty table gives no rows; further columns are ignored unless named in ``keep``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.spans import emit, slices

CACHE_ENTRIES = 400_000
LONGEST_CACHED = 64
LIMIT = 1_024
#: Fixed pattern of the tokenizer's byte-level pre-tokenizer, with white space as Unicode defines it.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Blocks whose character classes are the same in all Unicode versions in use: Basic Latin to Latin Extended-B, and General Punctuation.
_SETTLED = "[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*"


def frequent_lengths(tokenizer, pattern) -> dict[str, int]:
    """Token length of every vocabulary entry that is a pre-token by itself."""
    pieces = sorted({tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())})
    pieces = [p for p in pieces if p and "�" not in p and pattern.fullmatch(p)]
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, limit: int = LIMIT,
                 cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Bytes and tokens of every whole text; ``over_limit`` where there are more than ``limit`` tokens."""
    import regex
    from tokenizers import Tokenizer

    keep = keep or ["doc_id"]
    tokenizer = Tokenizer.from_file(tokenizer_path)
    # One entry for each vocabulary entry at most.
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer, regex.compile(PATTERN)))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def run(batches):
        tool = Tokenizer.from_file(tokenizer_path)
        pieces, settled = regex.compile(PATTERN).findall, regex.compile(_SETTLED).fullmatch

        class Lengths(dict):
            def __missing__(self, piece):
                n = len(tool.encode(piece, add_special_tokens=False).ids)
                if len(piece) <= LONGEST_CACHED:
                    if len(self) >= room:
                        self.clear()
                        self.update(shared.value)
                    self[piece] = n
                return n

        lengths = Lengths(shared.value)
        room = len(lengths) + cache_entries
        look_up = lengths.__getitem__
        for batch, texts in slices(batches):
            counts = np.zeros(texts.rows, np.int64)
            for row in range(texts.rows):
                text = texts.bytes_of(row).decode()
                if any(s in text for s in special) or not (text.isascii() or settled(text)):
                    counts[row] = len(tool.encode(text, add_special_tokens=False).ids)
                else:
                    counts[row] = sum(map(look_up, pieces(text)))
            yield emit(batch, keep, n_bytes=np.diff(texts.bounds), n_tokens=counts, over_limit=pa.array(counts > limit))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
