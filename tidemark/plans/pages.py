"""Queries of articles and pages: linked data, tags and robots files are written around the test texts, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.views import table
from tidemark.sources import pages as P

def articles(s, d):
    """Pages around documents: body declared as linked data, in an article element, in plain paragraphs, or only as furniture."""
    doc = table(s, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .,!?]", " ").alias("t"))
    half = F.concat(F.lit("<nav><p>"), "t", F.lit("</p></nav><p>"), "t", F.lit("</p><p>tiny &amp; short</p><P class='x'>"), F.substring("t", 1, 90), F.lit(" &#65;&#8217;&nbsp;end</P>"))
    ld = F.concat(F.lit('<script type="application/ld+json">{"a":[{"articleBody":"short"},{"articleBody":"'), "t", F.lit('"}]}</script>'))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(ld, half)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<ARTICLE id=1>"), half, F.lit("</ARTICLE><p>"), "t", F.lit("</p>"))).when(F.col("doc_id") % 4 == 2, half)
    return doc.select("doc_id", F.coalesce(body, F.concat(F.lit('<script type="application/ld+json">{broken</script><footer>'), half, F.lit("</footer>"))).alias("html"))


S_T = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,!?]', ' ', 'g')"
S_TIDY = "trim(regexp_replace({x}, '[ \\t]+', ' ', 'g'))"
ARTICLES = f"""t AS (SELECT doc_id, {S_T} AS t FROM documents), p AS (SELECT doc_id, t, {S_TIDY.format(x='t')} AS a, {S_TIDY.format(x="substr(t, 1, 90) || ' A'' end'")} AS b FROM t),
h AS (SELECT *, array_to_string(list_filter([a, b], lambda x: length(x) > 60), chr(10) || chr(10)) AS own FROM p),
f AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN array_to_string(list_filter([a, b, a], lambda x: length(x) > 60), chr(10) || chr(10)) WHEN doc_id % 4 = 3 THEN '' ELSE own END AS page, CASE WHEN doc_id % 4 = 0 AND length(t) > 200 THEN a ELSE '' END AS ld FROM h)"""


def described(s, d):
    """Supplier pages with metadata in the several places that declare it."""
    k = F.col("s_suppkey")
    pick = lambda m, text: F.when(k % m == 0, text).otherwise("")
    name = F.col("s_name")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Org","X"],"headline":"LD '), name, F.lit('","author":[{"name":"Ann"}],"datePublished":"2024-05-06"}]}</script>'))
    parts = [F.lit('<html lang="en-GB"><head><title>T &amp; '), name, F.lit("</title>"), pick(2, F.concat(F.lit("<meta property='og:title' content=\"OG "), name, F.lit("\">"))), pick(3, F.concat(F.lit('<META name=twitter:title content="TW "><meta name="keywords" content="a,bb, '), name, F.lit(',">'))), pick(5, ld), pick(7, F.lit('<meta itemprop="datePublished" content="2024-01-02"><meta name="author" content="Bo &#66;">')), F.lit('<link href="https://c/x" rel="shortcut canonical"></head><body><h1>H '), name, F.lit("</h1></body></html>")]
    return table(s, d, "supplier").select("s_suppkey", F.concat(*parts).alias("html"))


DESCRIBED = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'OG ' || s_name WHEN s_suppkey % 3 = 0 THEN 'TW' WHEN s_suppkey % 5 = 0 THEN 'LD ' || s_name ELSE 'T & ' || s_name END AS title, CASE WHEN s_suppkey % 7 = 0 THEN 'Bo B' WHEN s_suppkey % 5 = 0 THEN 'Ann' END AS author,
CASE WHEN s_suppkey % 7 = 0 THEN '2024-01-02' WHEN s_suppkey % 5 = 0 THEN '2024-05-06' END AS published, CASE WHEN s_suppkey % 5 = 0 THEN 'Org' END AS type, 'en-GB' AS language, 'https://c/x' AS canonical, CASE WHEN s_suppkey % 3 = 0 THEN 'bb|' || s_name ELSE '' END AS keywords FROM supplier"""


def linked(s, d):
    k = F.col("s_suppkey")
    graph = F.concat(F.lit('[{"@type":"A","n":"'), "s_name", F.lit('"},{"@graph":[{"n":"in"},{"n":"two"}]}]'))
    block = F.concat(F.lit("<script defer type='application/ld+json'>"), F.when(k % 3 == 0, graph).when(k % 3 == 1, F.lit('{"n":"one"}')).otherwise("{no json"), F.lit("</script>"))
    return table(s, d, "supplier").select("s_suppkey", F.explode(P.linked_data(F.concat(block, F.lit("<script>{}</script>")))).alias("node")).select("s_suppkey", F.get_json_object("node", "$.n").alias("n"))


ROBOTS = "User-Agent: {a}\nDisallow: /p{k} # x\nCrawl-Delay: {k}\n\nuser-agent: other\nDisallow: /no\nUser-agent: *\nDisallow: /all\nDisallow:\n"


def robots(s, d):
    text = F.replace(F.replace(F.lit(ROBOTS), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{a}"), F.when(F.col("s_suppkey") % 2 == 0, "TideBot/1").otherwise("Elsewhere"))
    return table(s, d, "supplier").select("s_suppkey", P.robots_rules(text, "tidebot").alias("r")).select("s_suppkey", F.array_join("r.disallow", ",").alias("disallow"), F.col("r.delay_ms").alias("delay_ms"))


def addresses(s, d):
    k = F.col("p_partkey")
    v4 = F.concat_ws(".", (k % 256).cast("string"), (k * 7 % 256).cast("string"), (k * 3 % 256).cast("string"), F.when(k % 50 == 0, "x").otherwise("1"))
    ip = F.when(k % 5 == 0, F.concat(F.lit("::ffff:"), v4)).when(k % 5 == 1, F.get(F.array(*map(F.lit, ("::1", "fe80::1%eth0", "fd12:3::4", "2001:db8::1", "ff02::2"))), (k % 7 % 5).cast("int"))).otherwise(v4)
    return table(s, d, "part").select("p_partkey", ip.alias("ip"), P.private_address(ip).alias("private"))


S_PRIVATE = "(k4 = 'x' OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (168, 0)) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR a >= 224)"
ADDRESSES = f"""WITH n AS (SELECT p_partkey AS k, p_partkey % 256 AS a, p_partkey * 7 % 256 AS b, p_partkey * 3 % 256 AS c, CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE '1' END AS k4 FROM part), i AS (SELECT *, a || '.' || b || '.' || c || '.' || k4 AS v4, ['::1', 'fe80::1%eth0', 'fd12:3::4', '2001:db8::1', 'ff02::2'][CAST(k % 7 % 5 AS INTEGER) + 1] AS v6 FROM n)
SELECT k AS p_partkey, CASE k % 5 WHEN 0 THEN '::ffff:' || v4 WHEN 1 THEN v6 ELSE v4 END AS ip, CASE k % 5 WHEN 0 THEN CASE WHEN k4 = 'x' THEN FALSE ELSE {S_PRIVATE} END WHEN 1 THEN v6 <> '2001:db8::1' ELSE {S_PRIVATE} END AS private FROM i"""

QUERIES = {
    "str24_json05_12_article_text": (lambda s, d: articles(s, d).select("doc_id", F.sha2(P.article_text(F.col("html")), 256).alias("digest")), f"WITH {ARTICLES} SELECT doc_id, sha256(CASE WHEN length(ld) > 400 THEN ld WHEN doc_id % 4 = 1 AND length(own) > 400 THEN own WHEN length(page) > 250 THEN page WHEN ld <> '' THEN ld WHEN doc_id % 4 = 1 THEN own ELSE '' END) AS digest FROM f"),
    "str26_page_meta": (lambda s, d: described(s, d).select("s_suppkey", P.page_meta(F.col("html")).alias("m")).select("s_suppkey", "m.title", "m.author", "m.published", "m.type", "m.language", "m.canonical", F.array_join("m.keywords", "|").alias("keywords")), DESCRIBED),
    "json04_linked_objects": (linked, "SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN [s_name, NULL, 'in', 'two'] WHEN 1 THEN ['one'] ELSE [] END) AS n FROM supplier"),
    "str51_entities": (lambda s, d: table(s, d, "part").select("p_partkey", P.decode_entities(F.concat(F.lit("&lt;b&gt;&amp;"), "p_brand", F.lit("&#"), (F.col("p_partkey") % 300).cast("string"), F.lit(";&mdash;&apos;&#12;"))).alias("text")), "SELECT p_partkey, '<b>&' || p_brand || CASE WHEN k = 39 THEN '''' WHEN k > 31 THEN chr(CAST(k AS INTEGER)) ELSE ' ' END || '-'' ' AS text FROM (SELECT *, p_partkey % 300 AS k FROM part)"),
    "str41_robots_rules": (robots, "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/p' || s_suppkey || ',/all' ELSE '/all' END AS disallow, CASE WHEN s_suppkey % 2 = 0 THEN least(s_suppkey * 1000, 10000) ELSE 0 END AS delay_ms FROM supplier"),
    "fil22_private_addresses": (addresses, ADDRESSES),
    "src55_article_or_snippet": (lambda s, d: articles(s, d).select("doc_id", P.article_text(F.col("html")).alias("body")).select("doc_id", (F.col("body") == "").alias("paywalled"), F.sha2(F.when(F.col("body") != "", F.col("body")).otherwise(F.concat_ws(". ", F.concat(F.lit("Title "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 8 == 3, F.lit("snippet")))), 256).alias("checksum")), f"WITH {ARTICLES}, b AS (SELECT doc_id, CASE WHEN length(ld) > 400 THEN ld WHEN doc_id % 4 = 1 AND length(own) > 400 THEN own WHEN length(page) > 250 THEN page WHEN ld <> '' THEN ld WHEN doc_id % 4 = 1 THEN own ELSE '' END AS body FROM f) SELECT doc_id, body = '' AS paywalled, sha256(CASE WHEN body <> '' THEN body ELSE 'Title ' || doc_id || CASE WHEN doc_id % 8 = 3 THEN '. snippet' ELSE '' END END) AS checksum FROM b"),
    "str57_host_or_raw": (lambda s, d: table(s, d, "pages").select("page_id", F.when(F.coalesce("url", F.lit("")).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), T.host(F.col("url"))).otherwise(F.col("url")).alias("host")), "SELECT page_id, CASE WHEN regexp_matches(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1), '^www\\.', '') ELSE url END AS host FROM pages"),
}
