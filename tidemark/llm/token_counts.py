"""Token counts of whole texts by a two-tier lookup on the map side.

A piece model with identity normalisation never merges across the start of a
run of word marks, nor across a line feed that is a piece of its own. A text
is therefore the concatenation of pre-tokens whose piece counts add up. The
lengths of those that are frequent in a bounded sample of texts form a table
of bounded size that is broadcast. One scan of all texts adds up lengths:
from the table, else from the worker's own cache, else by encoding the
pre-token, so no pre-token is ever shuffled. The table is only a short cut:
every count is the library's own.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

MARK = "▁"
#: Longer pre-tokens are encoded without being kept.
LONGEST_KEPT = 64
#: Texts, about, whose pre-tokens fill the table; counts do not depend on them, only how often the table answers.
SAMPLE = 8192


class PreTokens:
    """Splits texts into pre-tokens and knows their lengths; lives in a worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "ﬁ ①  é é　x "
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("a  b", out_type=str) == self.model.encode("a b", out_type=str):
            raise ValueError("pieces of this model cross word marks, or it drops spaces: its counts don't add up by pre-token")
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("this model normalises texts; split them after normalising")
        self.lines = not any("\n" in p for p in pieces)

    def split(self, text: str) -> list[str]:
        """Pre-tokens without their word mark; a run of further spaces leads its pre-token, or ends the text."""
        text = text.replace(MARK, " ")
        if self.lines:
            text = text.replace("\n", " \n")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, gap = [], 0
        for part in parts:
            if part:
                out.append(" " * gap + part)
                gap = 0
            else:
                gap += 1
        if gap and text:
            out.append(" " * gap)
        return out

    def lengths(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, its word mark included."""
        asked, less = [], []
        for t in tokens:
            bare = t.lstrip(" ")
            if not bare:  # a run of k spaces at the end: k marks
                asked.append(t[1:])
                less.append(-1 if len(t) == 1 else 0)
            elif self.lines and bare[0] == "\n":  # the mark that split() put before a line feed isn't there
                asked.append(t[1:] if t[0] == " " else t)
                less.append(0 if t[0] == " " else 1)
            else:
                asked.append(t)
                less.append(0)
        return [len(ids) - k for ids, k in zip(self.model.encode(asked, num_threads=1), less, strict=True)]


def frequent_pretokens(docs: DataFrame, model_file: str, text: str = "text", table_size: int = 65_536) -> DataFrame:
    """(pretoken, n): the table_size most frequent pre-tokens of some SAMPLE texts, counted by the one task to which these texts are sent."""

    def summarise(batches):
        split, seen = PreTokens(model_file).split, Counter()
        for piece in slices(batches):
            for t in piece.column(0).to_pylist():
                seen.update(k for k in split(t) if len(k) <= LONGEST_KEPT)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["pretoken", "n"])

    share = F.lit(max(1, docs.count() // SAMPLE))
    some = docs.select(F.col(text).alias("_read")).filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), share) == 0)  # by place: copies of a text are no larger share
    return some.filter("_read <> ''").repartition(1).mapInArrow(summarise, "pretoken string, n long")


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096, table_size: int = 65_536, cache_size: int = 300_000) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of `text`.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted
    each; an empty table gives an empty table. Columns of docs named as one
    of the three results are replaced. Workers keep at most cache_size
    lengths besides the table.
    """
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    words = [r["pretoken"] for r in frequent_pretokens(docs, model_file, text, table_size).collect()]  # at most table_size
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(words, PreTokens(model_file).lengths(words), strict=True)) if words else {})

    def count(batches):
        pre, table, cache = PreTokens(model_file), shared.value, {}
        known, cached = table.get, cache.get

        def total(t: str | None) -> int:
            if not t:
                return 0
            tokens = pre.split(t)
            found = list(map(known, tokens))
            if None not in found:
                return sum(found)
            rest = [k for k, v in zip(tokens, found, strict=True) if v is None]
            again = list(map(cached, rest))
            n = sum(filter(None, found))
            if None in again:
                missing = list({k for k, v in zip(rest, again, strict=True) if v is None})
                fresh = dict(zip(missing, pre.lengths(missing), strict=True))
                n += sum(fresh[k] if v is None else v for k, v in zip(rest, again, strict=True))
                if len(cache) > cache_size:
                    cache.clear()
                cache.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_KEPT)
                return n
            return n + sum(again)

        for piece in slices(batches):
            at = piece.schema.get_field_index(text)
            counts = pa.array([total(t) for t in piece.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(piece.columns) if i != at], counts], [*[n for n in piece.schema.names if n != text], "n_tokens"])

    sized = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields if f.name != text)
    return sized.mapInArrow(count, f"{fields}, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
