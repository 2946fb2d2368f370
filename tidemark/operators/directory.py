"""Names to symbols and spellings to pairs, for whole tables of queries at once, by joins on prefixes and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.lookup import PREFERRED, search_symbols

#: Quote currencies, the longest spelling first, and the one meant where none is named.
QUOTES, DEFAULT_QUOTE = ("USDT", "USDC", "USD", "BTC"), "USD"
#: Most pairs of a basket, and matches under which a lookup asks further.
BASKET, THIN = 25, 3
TICKER = r"^[A-Za-z]{1,5}(\.[A-Za-z]{1,2})?$"


def normal_query(raw: Column) -> Column:
    """A query as it is searched: letters, digits, dot, hyphen and ampersand, single blanks, 64 characters at most."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[^\p{L}\p{N}.\-& ]", " "), r"\s+", " ")
    return F.trim(F.substring(kept, 1, 64))


def prefixes(text: Column, lengths: list[int]) -> Column:
    """The beginnings of a text of the given lengths, as far as it has so many characters."""
    return F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length(text)), lambda n: F.left(text, n))


def resolved(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, symbol, rank): the one symbol that a query means; null where it would be a guess.

    An exact symbol answers. A name or symbol that begins with the query does
    if the query hasn't a ticker's shape. Best rank, primary listing, shorter
    and earlier symbol break ties. Names and symbols are keyed by their
    beginnings of just the lengths that queries have.
    """
    asked = queries.select(normal_query(F.col("query")).alias("query")).distinct()
    low = F.lower("query")
    keyed = asked.filter("query <> ''").select("query", F.explode(F.array_distinct(F.array(F.struct(low.alias("key"), F.lit("s").alias("of")), F.struct(T.searchable(F.col("query")).alias("key"), F.lit("n").alias("of"))))).alias("k")).select("query", "k.*")
    lengths = sorted(r[0] for r in keyed.filter("key <> ''").select(F.char_length("key")).distinct().collect())  # normal queries have 64 characters at most
    open_ = symbols.filter(F.coalesce("tradable", F.lit(True)))
    s, n = F.lower("symbol"), T.searchable(F.col("name"))
    begin = lambda c, of: F.transform(prefixes(c, lengths), lambda p: F.struct(p.alias("key"), F.lit(of).alias("of")))
    index = open_.select("symbol", "exchange", F.explode(F.concat(begin(s, "s"), begin(n, "n"))).alias("k")).select("symbol", "exchange", "k.*")
    found = keyed.join(index, ["key", "of"])
    rank = F.when((F.col("of") == "s") & (F.lower("symbol") == F.lower("query")), 100).when(F.col("of") == "s", 90).otherwise(80)
    best = F.max_by(F.struct("symbol", "rank"), F.struct("rank", F.when(F.col("exchange").isin(*PREFERRED), 1).otherwise(0), -F.length("symbol"), reverse_order(F.col("symbol"))))
    found = found.withColumn("rank", rank).groupBy("query").agg(best.alias("b"))
    ok = (F.col("b.rank") >= 100) | ((F.col("b.rank") >= 80) & ~F.col("query").rlike(TICKER))
    return asked.join(found, "query", "left").select("query", F.when(ok, F.col("b.symbol")).alias("symbol"), F.when(ok, F.col("b.rank")).alias("rank"))


def reverse_order(symbol: Column) -> Column:
    """A key of up to 32 signs that is larger for the symbol that comes first."""
    return F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: -F.ascii(F.substring(symbol, i, 1)))


def looked_up(directory: DataFrame, remote: DataFrame, query: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Matches of one query and the directory after it: a thin local result without an exact symbol takes the remote rows in and is ranked anew."""
    limit = min(25, max(1, limit))
    local = search_symbols(directory, query, limit)
    rows = local.collect()  # `limit` rows at most
    if any(r["rank"] >= 100 for r in rows) or len(rows) >= THIN:
        return local, directory
    grown = directory.join(remote.select("symbol"), "symbol", "left_anti").unionByName(remote.select(directory.columns))
    return search_symbols(grown, query, limit), grown


def pair_candidates(raw: Column, quotes: tuple[str, ...] = QUOTES) -> Column:
    """What pair a spelling may mean, the likeliest first: a separated one, a bare base with the default quote, one run together."""
    clean = F.regexp_replace(F.upper(F.trim(raw)), r"[\s_]+", "")

    def forms(parts: Column) -> Column:
        two = F.array(F.concat(F.get(parts, 0), F.lit("/"), F.get(parts, 1)))
        only = F.get(parts, 0)
        glued = [F.when((F.char_length(only) > len(q)) & only.endswith(q), F.concat(F.substring(only, F.lit(1), F.char_length(only) - len(q)), F.lit(f"/{q}"))) for q in quotes]
        one = F.filter(F.array(F.concat(only, F.lit(f"/{DEFAULT_QUOTE}")), *glued), lambda c: c.isNotNull())
        return F.when(F.size(parts) == 2, two).when(F.size(parts) == 1, one).otherwise(F.array().cast("array<string>"))

    return T.let(F.filter(F.split(clean, "[/-]"), lambda p: p != ""), forms)


def normal_pairs(rows: DataFrame, pairs: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """rows with `pair`: the first candidate of their spelling that is served; null without one."""
    every = rows.select(*keys, raw, F.posexplode(pair_candidates(F.col(raw))).alias("_at", "_pair"))
    found = every.join(pairs.select(F.col("symbol").alias("_pair")), "_pair").groupBy(*keys).agg(F.min_by("_pair", "_at").alias("pair"))
    return rows.join(found, keys, "left")


def baskets(rows: DataFrame, pairs: DataFrame, key: str, raw: str, most: int = BASKET) -> DataFrame:
    """(key, pairs, rejected, error) of comma lists: served pairs once each in order, what isn't one, and why a basket is refused."""
    tokens = rows.select(key, F.posexplode(F.split(F.coalesce(raw, F.lit("")), ",")).alias("at", "token")).withColumn("token", F.trim("token")).filter("token <> ''")
    named = normal_pairs(tokens, pairs, [key, "at"], "token")
    first = F.row_number().over(Window.partitionBy(key, "pair").orderBy("at"))
    named = named.withColumn("_first", F.when(F.col("pair").isNotNull(), first).otherwise(1)).filter("_first = 1")
    listed = lambda value, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", F.col(value).alias("v"))))), lambda x: x["v"])
    got = named.groupBy(key).agg(listed("pair", F.col("pair").isNotNull()).alias("pairs"), listed("token", F.col("pair").isNull()).alias("rejected"))
    out = rows.select(key).distinct().join(got, key, "left")
    none = F.array().cast("array<string>")
    out = out.select(key, F.coalesce("pairs", none).alias("pairs"), F.coalesce("rejected", none).alias("rejected"))
    error = F.when((F.size("pairs") == 0) & (F.size("rejected") > 0), F.concat(F.lit("unsupported: "), F.array_join("rejected", ", "))).when(F.size("pairs") == 0, "missing symbols").when(F.size("pairs") > most, f"too many symbols; max {most}")
    return out.withColumn("error", error)


def search_pairs(queries: DataFrame, pairs: DataFrame, aliases: dict[str, str], limit: int = 10) -> DataFrame:
    """(query, place, symbol, score) of pairs (symbol, base, quote, name) by how well a name or base fits, dollar pairs first.

    The directory of pairs is a vendor's fixed list and the queries are asked
    of it in one join on their first letter or more.
    """
    asked = queries.select(F.lower(F.trim("query")).alias("query")).filter("query <> ''").distinct()
    alias = F.coalesce(*[F.when(F.col("query") == k, v) for k, v in aliases.items()], F.lit("")) if aliases else F.lit("")
    base, name = F.lower("base"), F.lower("name")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, i, 1))
    index = pairs.select("*", F.explode(F.array_distinct(F.concat(grams(F.concat(name, base)), F.array(F.concat(F.lit("="), F.col("base")))))).alias("gram"))
    keys = asked.withColumn("alias", alias).select("query", "alias", F.explode(F.array_distinct(F.array(F.substring("query", 1, 1), F.concat(F.lit("="), "alias")))).alias("gram"))
    q = F.col("query")
    score = F.when((F.col("alias") != "") & (F.col("base") == F.col("alias")), 100).when((base == q) | (F.lower("symbol") == q), 95).when(name == q, 90).when(name.startswith(q), 70).when(base.startswith(q), 60).when(name.contains(q), 40)
    found = keys.join(index, "gram").withColumn("score", score + F.when(F.col("quote") == DEFAULT_QUOTE, 5).otherwise(0)).filter("score IS NOT NULL").select("query", "symbol", "name", "score").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.char_length("name"), "symbol"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("query", "place", "symbol", "score")


def liveness(pairs: DataFrame, live: DataFrame | None) -> DataFrame:
    """pairs with status: live or idle by the last trades seen, unknown without a probe."""
    if live is None:
        return pairs.withColumn("status", F.lit("unknown"))
    seen = live.select("symbol").distinct().withColumn("_live", F.lit("live"))
    return pairs.join(seen, "symbol", "left").withColumn("status", F.coalesce("_live", F.lit("idle"))).drop("_live")


def quoted(requested: DataFrame, quotes: DataFrame, trades: DataFrame, pairs: DataFrame) -> DataFrame:
    """requested (at, symbol) in its order with name, bid, ask, last and spread in basis points; what is missing stays null."""
    rows = requested.join(pairs.select("symbol", "name"), "symbol", "left").join(quotes.select("symbol", "bid", "ask"), "symbol", "left").join(trades.select("symbol", F.col("price").alias("last")), "symbol", "left")
    mid = (F.col("bid") + F.col("ask")) / 2
    return rows.select("at", "symbol", "name", "bid", "ask", "last", F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("ask") - F.col("bid")) / mid * 10_000).alias("bps"))
