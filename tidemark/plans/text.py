"""Queries over text: sentences, phrases, pages, full-text lookup, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.math import lag_weight, round_half_up, spread_percent, tier_weight
from tidemark.operators import evidence as E
from tidemark.operators import lookup as L
from tidemark.plans.views import DOCS, SEGMENTS, SIGNALS, SYMBOLS, docs, segments, signals, spread, symbols, table

STOP = "[" + ", ".join(f"'{w}'" for w in T.CLAIM_STOPWORDS) + "]"
EDGES = "[" + ", ".join(f"'{w}'" for w in T.PHRASE_STOPWORDS + T.NOISE) + "]"


def s_sentences(t: str) -> str:
    cut = rf"""regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '([.!?])\s+([A-Z0-9$"“])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"


def s_words(t: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace(lower({t}), '[‘’]', '''', 'g'), '[^a-z0-9''&-]+'), lambda w: regexp_replace(w, '^[-'']+|[-'']+$', '', 'g')), lambda w: length(w) > 1 AND length(w) < 40 AND NOT regexp_full_match(w, '\d+'))"


def s_fingerprint(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[‘’“”]', '''', 'g'), '\d+', '#', 'g'), '[^a-z#\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def s_headline_key(t: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({t}, '[\s\p{{Z}}]+[-–—|][\s\p{{Z}}]+[^-–—|]{{2,40}}\z', '')), '[^a-z0-9]+', ' ', 'g'))"


def s_ngrams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def s_terms(t: str) -> str:
    numbers = rf"list_filter(list_transform(regexp_extract_all(lower({t}), '\$?\d[\d,.]*%?'), lambda x: regexp_replace(regexp_replace(x, '[,$]', '', 'g'), '\.$', '')), lambda x: length(x) >= 2)"
    return f"list_distinct(list_concat({numbers}, list_filter(regexp_extract_all(lower({t}), '[a-z][a-z-]{{4,}}'), lambda x: NOT list_contains({STOP}, x))))"


def s_markup(t: str) -> str:
    s = rf"regexp_replace(regexp_replace({t}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{entity}', '{sign}')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def half_up(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


S_LAG = f"CASE WHEN abs(lag_days) <= 7 THEN 1.0::DOUBLE ELSE {half_up('greatest(0.3::DOUBLE, 1 - (abs(lag_days) - 7) / 173.0::DOUBLE * 0.7)')} END"
S_TIER = "CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.4 ELSE 0 END::DOUBLE"
CLAIM = ("id % 10 = 0", 160)


def claims(spark, sf_dir):
    """Claims: the first sentence of each document, null without one."""
    d = docs(spark, sf_dir).withColumn("claim", T.first_sentence(F.col("text")))
    return d.select("id", "ticker", "host", F.col("published").alias("day"), "claim")


CORROBORATE_SQL = f"""WITH {DOCS}, claims AS (SELECT id, ticker, host AS claim_host, published AS day, {s_terms(f"{s_sentences('text')}[1]")} AS terms FROM docs),
p AS (SELECT c.id, d.id AS doc_id, c.ticker, CAST(d.published - c.day AS INTEGER) AS lag_days, d.tier, len(list_filter(c.terms, lambda t: contains(lower(d.text), t))) / len(c.terms) AS ov
  FROM claims c JOIN docs d ON d.ticker = c.ticker AND d.host <> c.claim_host AND d.published - c.day BETWEEN -7 AND 180 WHERE len(c.terms) >= 4)
SELECT id, doc_id, ticker, lag_days, CASE WHEN tier >= 3 THEN 'amplifies_only' ELSE 'confirms' END AS relation, {half_up('ov')} AS overlap, {half_up(f'ov * {S_TIER} * ({S_LAG})')} AS confidence FROM p WHERE ov >= 0.35"""

HOSTS = [("example.com", 1), ("news.example.org", 0), ("example.org", 2), ("shop.net", 3)]


def _exploded(array, name):
    return lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(array(F.col("text"))).alias("pos", name))


def _unnest(sql: str, name: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS {name} FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sql} AS l FROM documents))"


QUERIES = {
    "str01_sentences": (_exploded(T.sentences, "sentence"), _unnest(s_sentences("text"), "sentence")),
    "str02_words": (lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")), f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({s_words('text')}) AS word FROM documents) GROUP BY word"),
    "str03_ngrams": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.explode(T.ngrams(T.words(F.col("text")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), f"WITH w AS (SELECT {s_words('text')} AS w FROM conversations) SELECT gram, count(*) AS n FROM (SELECT unnest({s_ngrams('w', 3)}) AS gram FROM w) GROUP BY gram"),
    "str04_fingerprint": (lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(T.fingerprint(F.col("text")), 256).alias("fingerprint")), f"SELECT doc_id, sha256({s_fingerprint('text')}) AS fingerprint FROM documents"),
    "str06_distinctive_terms": (lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.distinctive_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs")), f"SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest({s_terms('text')}) AS term FROM documents) GROUP BY term"),
    "str23_markup_text": (lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.markup_text(F.col("html")), 256).alias("digest")), f"SELECT page_id, sha256({s_markup('html')}) AS digest FROM pages"),
    "str25_paragraphs": (lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.paragraphs(F.col("html")), 256).alias("digest")), f"SELECT page_id, sha256(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {s_markup('x')}), lambda x: length(x) > 60), chr(10) || chr(10))) AS digest FROM pages"),
    "str27_headings": (lambda s, d: table(s, d, "pages").select("page_id", F.explode(T.headings(F.col("html"))).alias("heading")), f"SELECT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-5][^>]*>(.*?)</h[1-5]>', 1), lambda x: {s_markup('x')}), lambda x: x <> ''))[1:25]) AS heading FROM pages"),
    "str28_host": (lambda s, d: table(s, d, "pages").select("page_id", T.host(F.col("url")).alias("host")), "SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1), '^www\\.', '') AS host FROM pages"),
    "str31_abbreviated": (lambda s, d: table(s, d, "part").select("p_partkey", T.abbreviated_number(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("k", "m", "b", "x"))), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("value")), "SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 END::DOUBLE AS value FROM part"),
    "str33_text_hash": (lambda s, d: table(s, d, "documents").select("doc_id", T.short_hash(F.col("text")).alias("hash")), "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents"),
    "str34_escape": (lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("digest")), "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages"),
    "str35_token_estimate": (lambda s, d: table(s, d, "documents").select("doc_id", F.ceil(F.char_length("text") / 4).alias("tokens")), "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents"),
    "str44_clock": (lambda s, d: table(s, d, "events").select("event_id", T.clock(F.col("event_id") * 977).alias("clock")), "SELECT event_id, CASE WHEN h > 0 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(r AS VARCHAR), 2, '0') ELSE m || ':' || lpad(CAST(r AS VARCHAR), 2, '0') END AS clock FROM (SELECT event_id, (event_id * 977 // 1000) // 3600 AS h, (event_id * 977 // 1000) % 3600 // 60 AS m, (event_id * 977 // 1000) % 60 AS r FROM events)"),
    "str05_agg15_repeated_shingles": (lambda s, d: E.repeated_shingles(docs(s, d), 3), f"WITH {DOCS}, s AS (SELECT ticker, {s_fingerprint('x')} AS f FROM (SELECT ticker, unnest({s_sentences('text')}) AS x FROM docs)), w AS (SELECT ticker, f, string_split(f, ' ') AS w FROM s WHERE f <> '') SELECT shingle, count(DISTINCT ticker) AS issuers FROM (SELECT ticker, unnest(CASE WHEN len(w) < 8 THEN [f] ELSE {s_ngrams('w', 8)} END) AS shingle FROM w) GROUP BY shingle HAVING count(DISTINCT ticker) >= 3"),
    "agg16_phrase_frequency": (lambda s, d: E.phrase_frequency(spread(docs(s, d), "id")), f"""WITH w AS (SELECT doc_id, {s_words('text')} AS w FROM documents), g AS (SELECT DISTINCT doc_id, phrase, words FROM (SELECT doc_id, unnest(w) AS phrase, 1 AS words FROM w UNION ALL SELECT doc_id, unnest({s_ngrams('w', 2)}), 2 FROM w UNION ALL SELECT doc_id, unnest({s_ngrams('w', 3)}), 3 FROM w))
SELECT phrase, words, count(*) AS n FROM g WHERE NOT list_contains({EDGES}, string_split(phrase, ' ')[1]) AND NOT list_contains({EDGES}, string_split(phrase, ' ')[-1]) GROUP BY phrase, words HAVING count(*) >= 2"""),
    "join11_corroborate": (lambda s, d: E.corroborations(claims(s, d), docs(s, d)), CORROBORATE_SQL),
    "agg14_signal_rank": (lambda s, d: E.signal_rank(signals(s, d), "2024-10-01").select("ticker", round_half_up(F.col("score") + 1e-9).alias("score"), "signals"), f"WITH {SIGNALS} SELECT ticker, {half_up('sum(CASE direction WHEN ' + chr(39) + 'positive' + chr(39) + ' THEN strength * (0.5 + specificity / 2) WHEN ' + chr(39) + 'negative' + chr(39) + ' THEN -strength * (0.5 + specificity / 2) ELSE 0 END) + 1e-9')} AS score, count(*) AS signals FROM signals WHERE coalesce(is_boilerplate, 0) = 0 AND event_date <= DATE '2024-10-01' GROUP BY ticker"),
    "agg26_weighted_issuers": (lambda s, d: E.weighted_issuers(docs(s, d)), f"WITH {DOCS}, b AS (SELECT ticker, host, min(tier) AS t FROM docs GROUP BY ALL) SELECT ticker, count(*) AS issuers, {half_up('sum(CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.25 ELSE 0 END)::DOUBLE')} AS weighted FROM b GROUP BY ticker"),
    "agg27_promotion_burst": (lambda s, d: E.promotion_bursts(docs(s, d).withColumn("ticker", F.concat("ticker", F.lit("-"), (F.col("id") % 12).cast("string")))), f"WITH {DOCS}, d AS (SELECT ticker || '-' || (id % 12) AS ticker, host, tier FROM docs) SELECT ticker, count(*) FILTER (tier = 3) AS promo, array_to_string(list_sort(list_distinct(list(host) FILTER (tier = 3)))[1:5], ',') AS hosts FROM d GROUP BY ticker HAVING count(*) FILTER (tier = 3) >= 3 AND count(*) FILTER (tier <= 1) = 0"),
    "agg02_signals_by_ticker": (lambda s, d: E.usable(signals(s, d)).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker"), f"WITH {SIGNALS} SELECT ticker, count(*) AS n FROM signals WHERE coalesce(is_boilerplate, 0) = 0 GROUP BY ticker"),
    "agg03_top_tickers": (lambda s, d: E.usable(signals(s, d)).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(5), f"WITH {SIGNALS} SELECT ticker, count(*) AS n FROM signals WHERE coalesce(is_boilerplate, 0) = 0 GROUP BY ticker ORDER BY n DESC, ticker LIMIT 5"),
    "agg04_by_tier": (lambda s, d: docs(s, d).groupBy("tier").agg(F.count("*").alias("n")), f"WITH {DOCS} SELECT tier, count(*) AS n FROM docs GROUP BY tier"),
    "agg05_by_type_direction": (lambda s, d: signals(s, d).groupBy("event_type", "direction").agg(F.count("*").alias("n")), f"WITH {SIGNALS} SELECT event_type, direction, count(*) AS n FROM signals GROUP BY ALL"),
    "agg08_news_state": (lambda s, d: docs(s, d).groupBy("ticker").agg(F.max("published").alias("newest"), F.count("*").alias("n")), f"WITH {DOCS} SELECT ticker, max(published) AS newest, count(*) AS n FROM docs GROUP BY ticker"),
    "agg09_join02_document_text": (lambda s, d: segments(s, d).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_index", "text"))), lambda x: x["text"]), " ").alias("text")), f"WITH {SEGMENTS} SELECT document_id, string_agg(text, ' ' ORDER BY seg_index, text) AS text FROM segments GROUP BY document_id"),
    "agg28_attribution_rate": (lambda s, d: segments(s, d).groupBy("document_id").agg(round_half_up(F.avg(F.col("speaker").isNotNull().cast("double"))).alias("rate")), f"WITH {SEGMENTS} SELECT document_id, {half_up('avg(CASE WHEN speaker IS NOT NULL THEN 1.0 ELSE 0 END)')} AS rate FROM segments GROUP BY document_id"),
    "agg34_counts_per_source": (lambda s, d: signals(s, d).groupBy("ticker").agg(F.count_if(F.col("direction") == "positive").alias("positive"), F.count_if(F.col("direction") == "negative").alias("negative"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("id")), 1, 8), lambda x: x.cast("string")), ",").alias("first_ids")), f"WITH {SIGNALS} SELECT ticker, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, array_to_string(list_sort(list(id))[1:8], ',') AS first_ids FROM signals GROUP BY ticker"),
    "win20_context": (lambda s, d: E.context(segments(s, d), "document_id", "seg_index", "text").select("document_id", "seg_index", F.substring(F.col("before"), 1, 200).alias("before"), F.substring(F.col("after"), 1, 200).alias("after")), f"WITH {SEGMENTS} SELECT document_id, seg_index, substr(lag(text) OVER w, 1, 200) AS before, substr(lead(text) OVER w, 1, 200) AS after FROM segments WINDOW w AS (PARTITION BY document_id ORDER BY seg_index)"),
    "win21_countdown": (lambda s, d: E.suppressed(segments(s, d), "document_id", "seg_index", F.char_length("text") % 5 == 0).select("document_id", "seg_index", "suppressed"), f"WITH {SEGMENTS} SELECT document_id, seg_index, coalesce(max(CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY seg_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) = 1 AS suppressed FROM segments"),
    "win22_carry_speaker": (lambda s, d: E.carry_speaker(segments(s, d)).select("document_id", "seg_index", "current_speaker"), f"WITH {SEGMENTS} SELECT document_id, seg_index, last_value(speaker IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_speaker FROM segments"),
    "win35_headlines_per_ticker": (lambda s, d: E.cap_per(docs(s, d), "ticker", 3, F.desc("published"), F.col("id")).select("ticker", "id", "published"), f"WITH {DOCS} SELECT ticker, id, published FROM docs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published DESC, id) <= 3"),
    "topk13_dedupe_hash": (lambda s, d: E.latest_per(table(s, d, "documents").withColumn("h", F.sha2("text", 256)), "h", F.col("doc_id")).select("doc_id", "h"), "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY 2"),
    "topk14_headline_key": (lambda s, d: E.latest_per(docs(s, d).withColumn("key", T.headline_key(F.col("text"))).withColumn("_same", F.struct("key", F.when(F.col("key") == "", F.col("id")))), "_same", F.col("tier"), F.col("id")).select("key", "id", "tier"), f"WITH {DOCS}, k AS (SELECT {s_headline_key('text')} AS key, id, tier FROM docs) SELECT key, id, tier FROM k QUALIFY row_number() OVER (PARTITION BY key, CASE WHEN key = '' THEN id END ORDER BY tier, id) = 1"),
    "topk08_bounded_evidence": (lambda s, d: E.cap_per(signals(s, d), "ticker", 10, F.desc("strength"), F.col("id")).select("ticker", F.lit("signal").alias("kind"), "id").unionByName(E.cap_per(docs(s, d).filter("tier < 3"), "ticker", 15, F.desc("published"), F.col("id")).select("ticker", F.lit("news").alias("kind"), "id")), f"WITH {SIGNALS}, {DOCS}, a AS (SELECT ticker, 'signal' AS kind, id FROM signals QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, id) <= 10), b AS (SELECT ticker, 'news' AS kind, id FROM docs WHERE tier < 3 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published DESC, id) <= 15) SELECT * FROM a UNION ALL SELECT * FROM b"),
    "fil06_not_boilerplate": (lambda s, d: E.usable(signals(s, d)).select("id", "ticker"), f"WITH {SIGNALS} SELECT id, ticker FROM signals WHERE coalesce(is_boilerplate, 0) = 0"),
    "fil07_tier_defaults": (lambda s, d: signals(s, d).select("id", (F.coalesce("source_tier", F.lit(3)) < 3).alias("is_news"), (F.coalesce("source_tier", F.lit(0)) == 0).alias("is_primary")), f"WITH {SIGNALS} SELECT id, coalesce(source_tier, 3) < 3 AS is_news, coalesce(source_tier, 0) = 0 AS is_primary FROM signals"),
    "fil09_join12_fulltext": (lambda s, d: L.fulltext(segments(s, d), ["document_id", "seg_index"], "text", "the th"), f"WITH {SEGMENTS}, t AS (SELECT document_id, seg_index, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM segments) SELECT document_id, seg_index FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0"),
    "fil13_host_tier": (lambda s, d: L.host_tier(table(s, d, "pages").select("page_id", "url"), HOSTS), "WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1), '^www\\.', '') AS host FROM pages), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', {t}, {i})" for i, (h, t) in enumerate(HOSTS)) + ") v(d, t, i)) SELECT page_id, host, CAST(coalesce((SELECT arg_min(t, i) FROM l WHERE host = d OR ends_with(host, '.' || d)), 2) AS INTEGER) AS tier FROM p"),
    "fil12_topk01_symbol_lookup": (lambda s, d: L.search_symbols(symbols(s, d), "p1", 10), f"WITH {SYMBOLS} SELECT symbol, name, exchange, CAST(CASE WHEN lower(symbol) = 'p1' THEN 100 WHEN starts_with(lower(symbol), 'p1') THEN 90 WHEN starts_with(n, 'p1') THEN 80 WHEN contains(n, ' p1') THEN 70 ELSE 60 END AS INTEGER) AS rank FROM (SELECT *, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS n FROM symbols) WHERE tradable AND (starts_with(lower(symbol), 'p1') OR contains(n, 'p1')) ORDER BY rank DESC, CASE WHEN exchange IN ('NASDAQ', 'NYSE') THEN 0 ELSE 1 END, length(symbol), symbol LIMIT 10"),
    "fil24_ticker_shape": (lambda s, d: symbols(s, d).select("symbol", F.col("symbol").rlike(r"^[A-Za-z]{1,5}(\.[A-Za-z]{1,2})?$").alias("ok")), f"WITH {SYMBOLS} SELECT symbol, regexp_full_match(symbol, '[A-Za-z]{{1,5}}(\\.[A-Za-z]{{1,2}})?') AS ok FROM symbols"),
    "fil03_spread": (lambda s, d: table(s, d, "part").select("p_partkey", round_half_up(spread_percent(F.col("p_retailprice") - F.col("p_size") % 5, F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") + 1).otherwise(0.0)), 6).alias("spread")), "SELECT p_partkey, round(CASE WHEN b > 0 AND a > 0 THEN (a - b) / ((a + b) / 2) * 100 END, 6) AS spread FROM (SELECT p_partkey, p_retailprice - p_size % 5 AS b, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice + 1 ELSE 0 END AS a FROM part)"),
    "fil28_banned_phrases": (lambda s, d: L.banned(table(s, d, "documents"), ["guaranteed", "the and", "license"]), "SELECT doc_id, array_to_string(list_filter(['guaranteed', 'the and', 'license'], lambda p: contains(lower(text), p)), ',') AS banned FROM documents WHERE contains(lower(text), 'guaranteed') OR contains(lower(text), 'the and') OR contains(lower(text), 'license')"),
    "math06_tier_weight": (lambda s, d: docs(s, d).select("id", tier_weight(F.col("tier")).alias("weight")), f"WITH {DOCS} SELECT id, {S_TIER} AS weight FROM docs"),
    "math07_lag_weight": (lambda s, d: docs(s, d).select("id", lag_weight((F.col("id") % 400 - 100).cast("int")).alias("weight")), f"SELECT doc_id AS id, {S_LAG} AS weight FROM (SELECT doc_id, CAST(doc_id % 400 - 100 AS INTEGER) AS lag_days FROM documents)"),
    "join22_unseen": (lambda s, d: signals(s, d).join(docs(s, d).filter("tier = 0").select("id"), "id", "left_anti").select("id", "ticker"), f"WITH {SIGNALS}, {DOCS} SELECT id, ticker FROM signals WHERE id NOT IN (SELECT id FROM docs WHERE tier = 0)"),
    "join20_signals_and_news": (lambda s, d: signals(s, d).groupBy(F.col("id").alias("sid")).agg(F.count("*").alias("n")).join(docs(s, d).filter("tier = 1").select("id"), F.col("sid") == F.col("id"), "full_outer").select(F.coalesce("sid", "id").alias("id"), F.coalesce("n", F.lit(0)).alias("n")), f"WITH {SIGNALS}, {DOCS}, g AS (SELECT id AS sid, count(*) AS n FROM signals GROUP BY id) SELECT coalesce(sid, id) AS id, coalesce(n, 0) AS n FROM g FULL OUTER JOIN (SELECT id FROM docs WHERE tier = 1) ON sid = id"),
    "set01_known_tickers": (lambda s, d: docs(s, d).select("ticker").union(symbols(s, d).select("symbol")).distinct(), f"WITH {DOCS}, {SYMBOLS} SELECT ticker FROM docs UNION SELECT symbol FROM symbols"),
    "set03_distinct": (lambda s, d: docs(s, d).select("ticker", "host").distinct(), f"WITH {DOCS} SELECT DISTINCT ticker, host FROM docs"),
    "set06_containment": (lambda s, d: table(s, d, "documents").select("doc_id", round_half_up(T.overlap(F.array(*map(F.lit, ("the", "and", "which", "zzz"))), F.col("text")), 6).alias("ratio")), "SELECT doc_id, len(list_filter(['the', 'and', 'which', 'zzz'], lambda t: contains(lower(text), t))) / 4 AS ratio FROM documents"),
}
