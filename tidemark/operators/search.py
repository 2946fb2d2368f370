"""Full-text search by a stored inverted index, for a table of queries at a time.

The index of a table is three Parquet tables: `terms`, the dictionary with
the number of rows that hold each term, range-partitioned and sorted, so that
a prefix is a range of it; `postings`, (term, block, rows), the rows of a
block of 8,192 that hold a term, in the same order; and `rows`, each row's
number, keys and distinct terms. It is written once; a search reads no text.

Every word of a query must begin a term of a row. A search looks up the words
in the dictionary as prefixes of the lengths that were asked for and brings
their postings, the blocks' keys and the queries together in cells of a block
and some 65,536 queries. There each word is a string of bits, one a row, and
a query finds the rows whose bits all its words have: 64 at a time, and
nothing of a pair is made unless it is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidemark.session import settle, settle_table

#: Words of texts and of queries, in lower case.
WORD = r"[\p{L}\p{N}]+"
#: Terms that are named in the scan of the postings, which then skips other ranges; more are joined.
NAMED = 1000
#: Rows of a block, as a power of two; row numbers of a block differ in these bits alone.
BLOCK = 13
#: Queries that are packed into one row, and such rows that meet a block at once.
PACK, PACKS = 8192, 8
#: Rows of a settled table that are broadcast at most; more are joined by sort and merge, whatever their files' size says.
NEAR = 100_000
#: Bytes of bits that a task lays out for one word of each query at a time, and found rows that it hands on at once.
LAID, HANDED = 1 << 25, 1 << 18


def terms_of(text: Column) -> Column:
    """The distinct words of a text in lower case; none for a null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def asked_words(text: Column) -> Column:
    """Words of a query: two letters or more, or with a digit; a word that begins another one of the query asks nothing more."""
    asked = F.filter(terms_of(text), lambda t: (F.char_length(t) >= 2) | t.rlike(r"\p{Nd}"))
    return F.transform(F.array(asked), lambda all_: F.array_sort(F.filter(all_, lambda t: ~F.exists(all_, lambda o: (o != t) & F.startswith(o, t)))))[0]


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def terms(self) -> DataFrame:
        """(term, n)"""
        return self._read("terms")

    @property
    def postings(self) -> DataFrame:
        """(term, block, rows)"""
        return self._read("postings")

    @property
    def rows(self) -> DataFrame:
        """(row, the keys, terms)"""
        return self._read("rows")

    @property
    def keys(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("row", "terms")]

    def search(self, queries: DataFrame, query_id: str = "query_id", text: str = "query", once: bool = False) -> DataFrame:
        """(query_id, the keys): a row for each indexed row in which every word of the query begins a term; with `once`, each keys once a query.

        A query without words, a null one too, finds nothing. Queries of the
        same words are looked up once; repeated queries and rows count each.
        Pairs of a query and a row are neither shuffled nor written before
        they are found, and with `once` not before they are made distinct in
        their block. The driver holds no table but one of NEAR rows at most,
        and a number a block.
        """
        asked = settle_table(queries.select(F.col(query_id).alias("query"), asked_words(F.col(text)).alias("words")).filter(F.size("words") > 0))
        words = settle(asked.select("words").distinct())
        words = words.select("words", F.explode("words").alias("word"))
        one = settle(words.select("word").distinct())
        lengths = sorted(r[0] for r in one.select(F.char_length("word")).distinct().collect())  # as many as the longest word has letters
        begun = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("term"))
        prefixes = self.terms.select("term", F.explode(F.transform(begun, lambda n: F.left("term", n))).alias("word"))
        spelled = settle(prefixes.join(near(one), "word"))  # (word, term)

        numbers = settle(spelled.select("word").distinct().withColumn("w", F.monotonically_increasing_id()))
        known = words.join(numbers.hint("merge"), "word").groupBy("words").agg(F.collect_set("w").alias("all")).filter(F.size("all") == F.size("words"))
        known = settle(known.withColumn("set", F.monotonically_increasing_id()))
        sought = settle_table(asked.join(known.hint("merge"), "words").select("set", "all", "query", F.monotonically_increasing_id().alias("n")))
        wanted = settle_table(spelled.join(numbers.hint("merge"), "word").join(known.select(F.explode("all").alias("w")).distinct().hint("merge"), "w").select("w", "term"))

        postings = self.postings
        named = [r[0] for r in wanted.select("term").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            postings = postings.filter(F.col("term").isin(named))
        packs = max(1, -(-sought.count() // PACK))
        kinds = {f"key_{i}": self.rows.schema[c].dataType for i, c in enumerate(self.keys)}
        keyed = self.rows.select(*block_of(F.col("row")), *[F.col(c).alias(f"key_{i}") for i, c in enumerate(self.keys)])
        blocks = F.broadcast(keyed.select("block").distinct())
        packed = sought.groupBy((F.col("n") % packs).alias("pack")).agg(F.collect_list(F.struct("set", "all", "query")).alias("asked"))
        packed = packed.repartition(packs, "pack").crossJoin(blocks).select("block", F.floor(F.col("pack") / PACKS).alias("part"), "asked")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((packs - 1) // PACKS).cast("long"))).alias("part")
        held = postings.join(near(wanted), "term").select("block", each, "w", "rows")
        cells = held.unionByName(keyed.select("*", each), allowMissingColumns=True).unionByName(packed, allowMissingColumns=True)
        # empty lists for nulls: after each row Spark asks Arrow for a batch's size, and Arrow walks over all nulls at a list's end
        full = [F.coalesce(c, F.array().cast(cells.schema[c].dataType)).alias(c) for c in ("rows", "asked")]
        cells = cells.select("block", "part", "w", "at", *full, *kinds).repartition("block", "part").sortWithinPartitions("block", "part")
        out = ST.StructType([ST.StructField("query", asked.schema["query"].dataType), *[ST.StructField(c, k) for c, k in kinds.items()]])
        found = cells.mapInArrow(_found(list(kinds), once), out).select(F.col("query").alias(query_id), *[F.col(f"key_{i}").alias(c) for i, c in enumerate(self.keys)])
        return found.distinct() if once else found


def near(table: DataFrame) -> DataFrame:
    """A settled table marked as one side of a join: to be broadcast if it has NEAR rows at most, else to be sorted and merged."""
    return table.hint("broadcast" if table.limit(NEAR + 1).count() <= NEAR else "merge")


def block_of(row: Column) -> tuple[Column, Column]:
    """A row's block, and where it stands there."""
    return F.shiftright(row, BLOCK).alias("block"), row.bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("short").alias("at")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (block, part) at a time, of batches in their order."""
    parts, last = [], None
    for batch in batches:
        at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if i == j:
                continue
            if parts and tuple(at[:, i]) != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = tuple(at[:, i])
            parts.append(batch.slice(i, j - i))
    if parts:
        yield pa.Table.from_batches(parts)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _found(keys: list[str], once: bool):
    """(query, keys) of the cells in a task's batches."""

    def places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each row's bit lies; with `once`, also the bytes at which each keys' bits begin: those of one keys lie in bytes of their own."""
        n = rows.num_rows
        if not once:
            return np.arange(n), np.zeros(0, int), n
        code = np.zeros(n, np.int64)
        for c in keys:
            own = _joined(rows[c]).dictionary_encode(null_encoding="encode")
            code = np.unique(code * max(len(own.dictionary), 1) + own.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        many = np.bincount(code)
        bytes_ = (many + 7) // 8
        begins = np.cumsum(bytes_) - bytes_
        place = np.empty(n, np.int64)
        place[order] = _runs(begins * 8, many)
        return place, begins, int(bytes_.sum()) * 8

    def laid(w: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        """Bits of the words w, `width` bytes each."""
        out = np.empty((len(w), width), np.uint8)
        step = max(1, (1 << 21) // width // 8)
        for lo in range(0, len(w), step):
            part = w[lo : lo + step]
            bits = np.zeros((len(part), width * 8), bool)
            bits[np.repeat(np.arange(len(part)), lengths[part]), values[_runs(starts[part], lengths[part])]] = True
            out[lo : lo + step] = np.packbits(bits, axis=1, bitorder="little")
        return out

    def match(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, posted = _joined(cell["asked"]).flatten(), cell.select(["w", "rows"]).filter(cell["w"].is_valid())
        if not len(asked) or not posted.num_rows:
            return
        rows = cell.select(["at", *keys]).filter(cell["at"].is_valid()).sort_by("at")
        place, begins, bits = places(rows)
        at = np.zeros(int(rows["at"].to_numpy().max()) + 1, np.int64)
        at[rows["at"].to_numpy()] = place
        width = (bits + 63) // 64 * 8

        # words that the block holds, each with the places of its rows; several terms may begin with one
        word, lists = posted["w"].to_numpy(), _joined(posted["rows"])
        order = np.argsort(word, kind="stable")
        lists = lists.take(pa.array(order))
        values = at[lists.flatten().to_numpy()]
        word, first = np.unique(word[order], return_index=True)
        lengths = np.add.reduceat(lists.value_lengths().to_numpy().astype(np.int64), first)
        starts = np.cumsum(lengths) - lengths

        # sets of words that it holds, and the queries of each
        sets, lone, of = np.unique(asked.field("set").to_numpy(), return_index=True, return_inverse=True)
        queries, many = np.argsort(of, kind="stable"), np.bincount(of)
        begin = np.cumsum(many) - many
        need = asked.field("all").take(pa.array(lone))
        size, need = need.value_lengths().to_numpy().astype(np.int64), need.flatten().to_numpy()
        spot = np.minimum(np.searchsorted(word, need), len(word) - 1)
        head = np.cumsum(size) - size
        kept = np.flatnonzero(np.logical_and.reduceat(word[spot] == need, head))
        kept = kept[np.argsort(spot[head[kept]], kind="stable")]

        for lo in range(0, len(kept), step := max(1, LAID // width)):
            some = kept[lo : lo + step]
            own, own_of = np.unique(spot[_runs(head[some], size[some])], return_inverse=True)
            table = laid(own, values, starts, lengths, width).view(np.uint64)
            own_head = np.cumsum(size[some]) - size[some]
            for a in range(0, len(some), fine := max(1, (1 << 22) // width // 8)):
                part = some[a : a + fine]
                hit = table[own_of[own_head[a : a + fine]]]
                for k in range(1, int(size[part].max())):
                    longer = np.flatnonzero(size[part] > k)
                    hit[longer] &= table[own_of[own_head[a : a + fine][longer] + k]]
                live = np.flatnonzero(hit.any(axis=1))
                hit, part = hit[live].view(np.uint8), part[live]
                if not len(part):
                    continue
                if once:
                    s, r = np.nonzero(np.bitwise_or.reduceat(hit, begins, axis=1))
                    r = begins[r] * 8
                else:
                    s, r = np.nonzero(np.unpackbits(hit, axis=1, bitorder="little"))
                yield from handed(rows, place, asked, queries, begin[part][s], many[part][s], r)

    def handed(rows: pa.Table, place: np.ndarray, asked: pa.Array, queries: np.ndarray, begin: np.ndarray, many: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The found rows, once for each query of their set."""
        row_at = np.zeros(int(place.max()) + 1, np.int64)
        row_at[place] = np.arange(len(place))
        ends = np.cumsum(many)
        i = 0
        while i < len(r):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HANDED, side="right")))
            q = queries[_runs(begin[i:j], many[i:j])]
            k = np.repeat(row_at[r[i:j]], many[i:j])
            yield pa.RecordBatch.from_arrays([asked.field("query").take(pa.array(q)), *[_joined(rows[c]).take(pa.array(k)) for c in keys]], ["query", *keys])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            yield from match(cell)

    return run


def write_index(rows: DataFrame, keys: list[str], texts: list[str], folder: str) -> Index:
    """The index of rows by the words of `texts`, which are read as one; nulls among them and among the keys are allowed.

    `folder` must be one that executors share. Postings of one term are
    a list a block, so a word in every text is no hot key.
    """
    spark = rows.sparkSession
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), *keys, terms_of(F.concat_ws(" ", *texts)).alias("terms"))
    numbered.write.option("compression", "zstd").parquet(f"{folder}/rows")
    each = spark.read.parquet(f"{folder}/rows").select(F.explode("terms").alias("term"), *block_of(F.col("row")))
    lists = each.groupBy("term", "block").agg(F.sort_array(F.collect_list("at")).alias("rows"))
    lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum(F.size("rows").cast("long")).alias("n"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{folder}/terms")
    return Index(spark, folder)


def found_or_held(rows: DataFrame, keys: list[str], text: str, query: str) -> DataFrame:
    """Keys of the rows that a query finds by its words; if it finds none, of those whose text holds it as it stands, without '%' and '_'.

    Both tests are made in one scan of the texts and settled; only whether
    there was a find by words is asked of the result.
    """
    asked = F.lit(query)
    words = F.transform(F.array(terms_of(F.col(text))), lambda own: F.forall(asked_words(asked), lambda w: F.exists(own, lambda t: F.startswith(t, w))))[0]
    by_words = words & (F.size(asked_words(asked)) > 0)
    plain = F.contains(F.lower(text), F.lower(F.regexp_replace(asked, "[%_]", "")))
    tested = rows.select(*keys, by_words.alias("_found"), F.coalesce(plain, F.lit(False)).alias("_held")).filter("_found OR _held")
    tested = settle_table(tested)
    return tested.filter("_held" if tested.filter("_found").isEmpty() else "_found").select(keys)
