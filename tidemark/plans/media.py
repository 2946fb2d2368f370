"""Queries of captions, recognised words and recordings: files are written from conversations as players and recognisers would, then parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rulebook as B
from tidemark.functions import text as T
from tidemark.operators import signals as G
from tidemark.plans.text import s_sentences
from tidemark.plans.views import table
from tidemark.sources import media as M

STAMP = "concat('0', cast({m} div 60 AS string), ':', lpad(cast({m} % 60 AS string), 2, '0'), ':0', cast(turn % 10 AS string), ',250')"
S_STAMP = "'0' || ({m} // 60) || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0') || ':0' || (turn % 10) || ',250'"


def spoken(s, d):
    """(conv_id, turn, role, line): what is heard in a turn, with the last three words before it once more, as players roll captions."""
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace(F.regexp_replace("text", r"<[^>]*>|-->", " "), r"\s+", " ")).alias("line"))
    before = F.lag("line").over(Window.partitionBy("conv_id").orderBy("turn", "line"))
    tail = F.array_join(F.slice(F.split(before, " "), -3, 3), " ")
    return c.withColumn("line", F.when((F.col("turn") % 2 == 1) & (F.size(F.split(before, " ")) >= 3), F.concat_ws(" ", tail, "line")).otherwise(F.col("line")))


SPOKEN = r"""lines_ AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '<[^>]*>|-->', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM conversations),
lagged AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn, line) AS b FROM lines_),
spoken AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 1 AND len(string_split(b, ' ')) >= 3 THEN array_to_string(string_split(b, ' ')[-3:], ' ') || ' ' || line ELSE line END AS line FROM lagged)"""


def caption_files(s, d):
    stamp = lambda m: F.expr(STAMP.format(m=m))
    block = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.col("turn").cast("string"), F.lit("\n"))).otherwise(""), stamp("turn"), F.lit(" --> "), stamp("(turn + 1)"), F.lit(" align:start\r\n- <c.y>"), "line", F.lit("</c>\nNOTE x\n\nstray line\n"))
    rows = spoken(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line", block.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    return rows.select("conv_id", F.concat(F.lit("WEBVTT\n\nSTYLE none\n\n"), "b").alias("raw"))


CUES = f"""{SPOKEN}, cues AS (SELECT conv_id, turn, line, (turn * 60 + turn % 10) * 1000 + 250 AS s, ((turn + 1) * 60 + turn % 10) * 1000 + 250 AS e, regexp_replace(line, '^-\\s*', '') AS t FROM spoken WHERE line <> '')"""
CUES = f"{CUES}, cue_lists AS (SELECT conv_id, list({{'s': s, 'e': e, 't': t}} ORDER BY turn, line) AS c FROM cues WHERE t <> '' GROUP BY conv_id)"
ROLL = f"""{CUES}, rolled AS (SELECT conv_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN starts_with(x[1].t, acc[-1].t) THEN list_concat(acc[1:len(acc) - 1], [{{'s': acc[-1].s, 'e': greatest(acc[-1].e, x[1].e), 't': x[1].t}}])
  WHEN trim(array_to_string(string_split(x[1].t, ' ')[list_max(list_filter(range(0, least(len(string_split(acc[-1].t, ' ')), len(string_split(x[1].t, ' '))) + 1), lambda n: string_split(acc[-1].t, ' ')[len(string_split(acc[-1].t, ' ')) - n + 1:] = string_split(x[1].t, ' ')[1:n])) + 1:], ' ')) = '' THEN acc
  ELSE list_concat(acc, [{{'s': x[1].s, 'e': x[1].e, 't': trim(array_to_string(string_split(x[1].t, ' ')[list_max(list_filter(range(0, least(len(string_split(acc[-1].t, ' ')), len(string_split(x[1].t, ' '))) + 1), lambda n: string_split(acc[-1].t, ' ')[len(string_split(acc[-1].t, ' ')) - n + 1:] = string_split(x[1].t, ' ')[1:n])) + 1:], ' '))}}]) END) AS c FROM cue_lists)"""


def s_grouped(items: str, by: str) -> str:
    """Segments of a table `items` (by, n, s, e, t, who), in order n, by recursion over the rows."""
    fresh = "(f.done OR (i.who IS NOT NULL AND i.who IS DISTINCT FROM f.who))"
    length = f"(length(i.t) + 1 + CASE WHEN {fresh} THEN 0 ELSE f.len END)"
    done = lambda n: f"(({n} >= {M.SEGMENT} AND regexp_matches(i.t, '[.!?]$')) OR {n} >= {M.SEGMENT * M.GROWTH})"
    return f"""folded({by}, n, seg, len, done, who) AS (SELECT {by}, n, 0, length(t) + 1, {done('(length(i.t) + 1)')}, who FROM {items} i WHERE n = 1
UNION ALL SELECT i.{by}, i.n, f.seg + CASE WHEN {fresh} THEN 1 ELSE 0 END, {length}, {done(length)}, CASE WHEN {fresh} THEN i.who ELSE f.who END FROM folded f JOIN {items} i ON i.{by} = f.{by} AND i.n = f.n + 1),
segmented AS (SELECT i.{by}, f.seg, min(i.s) AS "start", arg_max(i.e, i.n) AS "end", trim(regexp_replace(string_agg(i.t, ' ' ORDER BY i.n), '\\s+', ' ', 'g')) AS text, arg_min(f.who, i.n) AS who FROM folded f JOIN {items} i USING ({by}, n) GROUP BY i.{by}, f.seg)"""


def responses(s, d):
    """A recogniser's response for each conversation: every word with its time and speaker; some without words."""
    w = spoken(s, d).select("conv_id", "turn", "role", F.posexplode(F.split("line", " ")).alias("at", "word"))
    word = F.struct(F.col("word").alias("text"), F.when(F.col("at") % 9 == 8, "spacing").otherwise("word").alias("type"), (F.col("turn") * 60 + F.col("at") / 4).alias("start"), (F.col("turn") * 60 + F.col("at") / 4 + 0.2).alias("end"), F.when(F.col("role") != "system", F.concat(F.lit("speaker_"), F.when(F.col("role") == "user", "0").otherwise("1"))).alias("speaker_id"))
    rows = w.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "at", word.alias("w")))), lambda x: x["w"]).alias("words"))
    return rows.select("conv_id", F.to_json(F.struct(F.lit(" no words here ").alias("text"), F.when(F.col("conv_id") % 7 != 0, F.col("words")).alias("words"))).alias("raw"))


HEARD = f"""{SPOKEN}, words_ AS (SELECT conv_id, turn, role, i - 1 AS at_, w[i] AS t FROM (SELECT conv_id, turn, role, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, role, string_split(line, ' ') AS w FROM spoken))),
heard AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, at_) AS n, floor((turn * 60 + at_ / 4) * 1000 + 0.5) AS s, floor((turn * 60 + at_ / 4 + 0.2) * 1000 + 0.5) AS e, t, CASE role WHEN 'system' THEN NULL WHEN 'user' THEN 'Speaker 1' ELSE 'Speaker 2' END AS who FROM words_ WHERE at_ % 9 <> 8 AND t <> '' AND conv_id % 7 <> 0)"""


def verbose(s, d):
    c = table(s, d, "conversations")
    seg = F.struct((F.col("turn") * 7.3).alias("start"), (F.col("turn") * 7.3 + 5).alias("end"), F.concat(F.lit(" "), F.when(F.col("turn") % 4 != 3, F.col("text")).otherwise("")).alias("text"))
    return c.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(seg)).alias("segments"))).alias("raw"))


def pieces(s, d):
    """Orders as recordings of a length, each chunk with three segments."""
    o = table(s, d, "orders").select("o_orderkey", F.explode(M.chunk_plan(F.floor("o_totalprice") * 100)).alias("c")).select("o_orderkey", F.col("c.start").alias("chunk_start"), "c.length")
    at = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return o.withColumn("k", at).select("o_orderkey", "chunk_start", (F.col("k") * 7000).cast("long").alias("start"), (F.col("k") * 7000 + 6500).cast("long").alias("end"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("text"))


CHUNKS = f"""chunks AS (SELECT o_orderkey, CASE WHEN k = 0 THEN 0 ELSE k * {M.CHUNK * 1000} - {M.OVERLAP * 1000} END AS start, dur FROM (SELECT o_orderkey, CAST(floor(o_totalprice) * 100 AS BIGINT) AS dur, unnest(range(0, greatest(CAST(ceil(floor(o_totalprice) * 100 / {M.CHUNK * 1000}) AS BIGINT), 1))) AS k FROM orders)),
plan_ AS (SELECT o_orderkey, start, CASE WHEN dur <= {M.CHUNK * 1000} THEN dur ELSE least({(M.CHUNK + M.OVERLAP) * 1000}, dur - start) END AS length FROM chunks)"""

TITLES = ["{b} Q3 2024 earnings call", "Investor Day with {b}", "{b} keynote", "A Fireside talk", "{b} sits down with us", "Summit notes by {b}", "Episode {k} of the {b} podcast", "Plain news on {b}"]


def titles(s, d):
    p = table(s, d, "part")
    t = F.replace(F.replace(F.get(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % len(TITLES)).cast("int")), F.lit("{b}"), F.col("p_brand")), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", t.alias("title"), F.concat(F.lit("https://"), F.get(F.array(*map(F.lit, ("www.youtube.com/watch?a=1&v=", "youtu.be/", "m.youtube.com/shorts/", "other.org/x?id="))), (F.col("p_partkey") % 4).cast("int")), F.lit("vid_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("url"))


S_TITLES = f"titles AS (SELECT p_partkey, replace(replace([{', '.join(repr(t) for t in TITLES)}][CAST(p_partkey % {len(TITLES)} AS INTEGER) + 1], '{{b}}', p_brand), '{{k}}', CAST(p_partkey AS VARCHAR)) AS title, 'https://' || ['www.youtube.com/watch?a=1&v=', 'youtu.be/', 'm.youtube.com/shorts/', 'other.org/x?id='][CAST(p_partkey % 4 AS INTEGER) + 1] || 'vid_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS url FROM part)"


def listed_videos(s, d):
    v = F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.lit("https://v.org/a")).alias("webpage_url"), F.col("p_brand").alias("uploader"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("202401"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))).otherwise("soon").alias("upload_date"), (F.col("p_size") + 0.25).alias("duration"))
    return table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.to_json(F.collect_list(v)).alias("raw"))


def listings(s, d):
    p = table(s, d, "part")
    row = lambda m, base: p.filter(f"p_partkey % {m} = 0").select(F.concat(F.lit("https://v.org/"), F.col("p_partkey").cast("string")).alias("url"), "p_brand", F.concat(F.lit(base), F.col("p_name")).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("day")).withColumnRenamed("p_brand", "ticker")
    return [row(2, "a "), row(3, "b "), row(1, "c ")]


def recordings(s, d):
    c, r = caption_files(s, d), responses(s, d).withColumnRenamed("raw", "heard")
    both = r.join(c.filter("conv_id % 3 = 0"), "conv_id", "left")
    return both.select("conv_id", M.transcript(F.col("raw"), F.col("heard"), F.col("conv_id") % 2 == 0).alias("t")).select("conv_id", "t.kind", F.size("t.segments").alias("segments"), "t.error")


def cases(column, rules, otherwise):
    return reduce(lambda c, r: F.when(column.rlike(r[0]), r[1]).otherwise(c), reversed(rules), F.lit(otherwise))


QUERIES = {
    "str38_39_caption_cues": (lambda s, d: caption_files(s, d).select("conv_id", F.posexplode(M.caption_cues(F.col("raw"))).alias("pos", "c")).select("conv_id", "pos", "c.start", "c.end", "c.text"), f"WITH {CUES} SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, c[i].s AS start, c[i].e AS \"end\", c[i].t AS text FROM (SELECT conv_id, c, unnest(range(1, len(c) + 1)) AS i FROM cue_lists)"),
    "win24_str37_caption_roll": (lambda s, d: caption_files(s, d).select("conv_id", F.posexplode(M.without_roll(M.caption_cues(F.col("raw")))).alias("pos", "c")).select("conv_id", "pos", "c.start", "c.end", "c.text"), f"WITH {ROLL} SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, c[i].s AS start, c[i].e AS \"end\", c[i].t AS text FROM (SELECT conv_id, c, unnest(range(1, len(c) + 1)) AS i FROM rolled)"),
    "win25_cue_segments": (lambda s, d: caption_files(s, d).select("conv_id", F.posexplode(M.grouped(M.without_roll(M.caption_cues(F.col("raw"))))).alias("pos", "c")).select("conv_id", "pos", "c.start", "c.end", "c.text"), f"WITH RECURSIVE {ROLL}, items AS (SELECT conv_id, i AS n, c[i].s AS s, c[i].e AS e, c[i].t AS t, NULL::VARCHAR AS who FROM (SELECT conv_id, c, unnest(range(1, len(c) + 1)) AS i FROM rolled)), {s_grouped('items', 'conv_id')} SELECT conv_id, CAST(seg AS INTEGER) AS pos, start, \"end\", text FROM segmented"),
    "win26_word_segments": (lambda s, d: responses(s, d).filter("conv_id % 7 <> 0").select("conv_id", F.posexplode(M.word_segments(F.col("raw"))).alias("pos", "c")).select("conv_id", "pos", "c.start", "c.end", "c.text", "c.speaker"), f"WITH RECURSIVE {HEARD}, {s_grouped('heard', 'conv_id')} SELECT conv_id, CAST(seg AS INTEGER) AS pos, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", text, who AS speaker FROM segmented"),
    "win28_chunk_plan": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.explode(M.chunk_plan(F.floor("o_totalprice") * 100)).alias("c")).select("o_orderkey", "c.start", "c.length"), f"WITH {CHUNKS} SELECT o_orderkey, start, length FROM plan_"),
    "win29_rebased_segments": (lambda s, d: M.rebased(pieces(s, d), "o_orderkey"), f"WITH {CHUNKS}, s AS (SELECT o_orderkey, start AS chunk_start, k * 7000 AS st, k * 7000 + 6500 AS en, 'k' || k AS text FROM plan_, range(0, 3) t(k)) SELECT o_orderkey, chunk_start, chunk_start + st AS start, chunk_start + en AS \"end\", text, row_number() OVER (PARTITION BY o_orderkey ORDER BY chunk_start, chunk_start + st, chunk_start + en, text) - 1 AS index FROM s WHERE chunk_start = 0 OR st >= {M.OVERLAP * 1000}"),
    "json09_10_verbose_cues": (lambda s, d: verbose(s, d).select("conv_id", F.explode(M.verbose_cues(F.col("raw"))).alias("c")).select("conv_id", "c.start", "c.end", F.sha2("c.text", 256).alias("digest")), "SELECT conv_id, CAST(floor(turn * 7.3::DOUBLE * 1000 + 0.5) AS BIGINT) AS start, CAST(floor((turn * 7.3::DOUBLE + 5) * 1000 + 0.5) AS BIGINT) AS \"end\", sha256(trim(text)) AS digest FROM conversations WHERE turn % 4 <> 3 AND trim(text) <> ''"),
    "proj03_video_events": (lambda s, d: titles(s, d).select("p_partkey", cases(F.lower("title"), B.VIDEO_EVENTS, "video").alias("event")), f"WITH {S_TITLES} SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{e}'" for p, e in B.VIDEO_EVENTS) + " ELSE 'video' END AS event FROM titles"),
    "str46_47_video_addresses": (lambda s, d: titles(s, d).select("p_partkey", M.video_id(F.col("url")).alias("video"), M.at_second(F.col("url"), F.col("p_partkey") * 733 - 900).alias("at")), rf"WITH {S_TITLES} SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'vid_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS video, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || greatest(0, CAST(floor((p_partkey * 733 - 900) / 1000) AS BIGINT)) AS at FROM titles"),
    "src59_videos": (lambda s, d: M.videos(listed_videos(s, d), "raw"), "SELECT 'v' || p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE 'v' || p_partkey END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'https://v.org/a' ELSE 'https://www.youtube.com/watch?v=v' || p_partkey END AS url, p_brand AS channel, CASE WHEN p_partkey % 4 <> 0 THEN make_date(2024, 1, CAST(p_partkey % 28 + 1 AS INTEGER)) END AS uploaded, CAST(p_size * 1000 + 250 AS BIGINT) AS duration_ms FROM part"),
    "src32_video_discovery": (lambda s, d: M.discovered(listings(s, d)), "WITH e AS (SELECT 'https://v.org/' || p_partkey AS url, p_brand AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'a ' WHEN p_partkey % 3 = 0 THEN 'b ' ELSE 'c ' END || p_name AS title, DATE '2024-01-01' + p_size AS day FROM part) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC, url) <= 12"),
    "src58_podcast_search": (lambda s, d: M.podcasts(table(s, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("collectionName"), F.lit("t").alias("trackName"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("https://f/"), F.col("s_suppkey").cast("string"))).alias("feedUrl"), F.lit("a").alias("artistName"))).alias("results"))).alias("raw")), "raw"), "SELECT CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 't' END AS name, 'https://f/' || s_suppkey AS feed, 'a' AS publisher FROM supplier WHERE s_suppkey % 4 <> 0"),
    "src60_transcript_kinds": (recordings, f"WITH RECURSIVE {ROLL}, items AS (SELECT conv_id, i AS n, c[i].s AS s, c[i].e AS e, c[i].t AS t, NULL::VARCHAR AS who FROM (SELECT conv_id, c, unnest(range(1, len(c) + 1)) AS i FROM rolled)), {s_grouped('items', 'conv_id')}, cs AS (SELECT conv_id, count(*) AS n FROM segmented GROUP BY conv_id), " + HEARD.replace(SPOKEN + ", ", "") + ", " + s_grouped("heard", "conv_id").replace("folded", "folded2").replace("segmented", "segmented2") + ", ws AS (SELECT conv_id, count(*) AS n FROM segmented2 GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND cs.n IS NOT NULL THEN 'captions' WHEN conv_id % 2 = 0 THEN 'recognised' ELSE 'none' END AS kind, CAST(CASE WHEN conv_id % 3 = 0 AND cs.n IS NOT NULL THEN cs.n WHEN conv_id % 2 = 0 THEN CASE WHEN conv_id % 7 = 0 THEN 1 ELSE coalesce(ws.n, 0) END ELSE 0 END AS INTEGER) AS segments, CASE WHEN (conv_id % 3 <> 0 OR cs.n IS NULL) AND conv_id % 2 <> 0 THEN 'no captions and no recogniser' END AS error FROM (SELECT DISTINCT conv_id FROM spoken) LEFT JOIN cs USING (conv_id) LEFT JOIN ws USING (conv_id)"),
    "str45_speaker_labels": (lambda s, d: table(s, d, "supplier").select("s_suppkey", M.speaker_label(F.when(F.col("s_suppkey") % 3 == 0, "guest").otherwise(F.concat(F.lit("speaker_"), F.col("s_suppkey").cast("string")))).alias("label")), "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'guest' ELSE 'Speaker ' || (s_suppkey + 1) END AS label FROM supplier"),
    "fil19_episode_mentions": (lambda s, d: titles(s, d).select("p_partkey", G.mentions(F.regexp_replace("title", r"[^A-Za-z0-9 $#]", ""), F.regexp_extract("title", r"([A-Z][a-z]+)", 1), F.lit("Plain News, Inc.")).alias("named")).select("p_partkey", "named"), rf"WITH {S_TITLES}, t AS (SELECT p_partkey, regexp_replace(title, '[^A-Za-z0-9 $#]', '', 'g') AS t, regexp_extract(title, '([A-Z][a-z]+)', 1) AS k FROM titles) SELECT p_partkey, regexp_matches(t, '\b' || k || '\b') OR contains(lower(t), 'plain news, ') AS named FROM t"),
    "win37_flat_sentences": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("speaker"), (F.col("turn") * 60_000).alias("start"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")), f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS speaker, turn * 60000 AS start, CAST(i - 1 AS INTEGER) AS pos, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, role, {s_sentences('text')} AS l FROM conversations))"),
}
