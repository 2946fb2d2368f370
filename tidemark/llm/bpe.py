"""Ids of a byte-level BPE from a tokenizers JSON file, inside workers.

tiktoken applies the same vocabulary and merges several times faster. Its
reading of letters and digits may differ for characters that one library's
Unicode tables know and the other's don't, so texts beyond the scripts below
SURE go to the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: The pattern that the byte-level BPE splits texts with; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points under this are Latin and IPA letters, digits and signs that no Unicode version has changed lately.
SURE = 0x250


def byte_of_char() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        back = byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids; strings of special tokens are those tokens, as in the library's default."""
        if text.isascii() or int(np.frombuffer(text.encode("utf-32-le"), np.uint32).max()) < SURE:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def with_token_count(docs: DataFrame, tokenizer_file: str, count: str = "n_tokens", text: str = "text") -> DataFrame:
    """docs with the number of ids of each text in `count`, which is replaced if docs has it; 0 for a null text."""
    rows = docs.drop(count).withColumn("_read", F.col(text).cast("string"))

    def work(batches):
        bpe = ByteBPE(tokenizer_file)
        for piece in slices(batches):
            n = [len(bpe.ids(t)) if t else 0 for t in piece.column(piece.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(n, pa.int64())], [*piece.schema.names[:-1], count])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, f"{fields}, `{count}` long")
