"""Captions and transcripts: files of cues, words of a recogniser and chunks of a recording as rows of timed segments.

Each takes a DataFrame or column with the raw text; a malformed one gives no
cue. A recording's cues are folded in one row, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: The form of times in caption files, and of a cue's timing line.
STAMP = r"\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}|\d{1,2}:\d{2}[.,]\d{1,3}"
TIMING = rf"({STAMP})\s*-->\s*({STAMP})"
#: Seconds of a chunk sent to a recogniser, and of what chunks share.
CHUNK, OVERLAP = 1200, 10
#: Characters of a segment, and how far one without an end may grow.
SEGMENT, GROWTH = 600, 1.8

CUE = "struct<start:bigint,end:bigint,text:string,speaker:string>"
VERBOSE = "struct<text:string,segments:array<struct<start:double,end:double,text:string>>>"
WORDS = "struct<text:string,words:array<struct<text:string,type:string,start:double,end:double,speaker_id:string>>>"


def timestamp_ms(stamp: Column) -> Column:
    """h:mm:ss.mmm or m:ss,mmm as milliseconds."""
    parts = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    return F.floor(F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p) * 1000 + 0.5)


def cue_text(text: Column) -> Column:
    """A cue's words without word times, tags, a leading dash and doubled blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"^-\s*", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def caption_cues(raw: Column) -> Column:
    """The cues of a WebVTT or SRT file, as written: a timing line, and the lines up to a blank one or the next timing line."""

    def cue(block: Column) -> Column:
        lines = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
        body = F.slice(lines, 2, F.size(lines))
        blank = F.array_position(body, "")
        body = F.when(blank > 0, F.slice(body, 1, blank.cast("int") - 1)).otherwise(body)
        spoken = F.filter(body, lambda x: ~x.rlike(r"^(WEBVTT|NOTE|STYLE|REGION)\b") & ~x.rlike(r"^\d+$"))
        stamp = lambda i: timestamp_ms(F.regexp_extract(F.get(lines, 0), TIMING, i))
        return F.struct(stamp(1).alias("start"), stamp(2).alias("end"), cue_text(F.array_join(spoken, " ")).alias("text"), F.lit(None).cast("string").alias("speaker"))

    blocks = F.split(F.replace(raw, F.lit("\r"), F.lit("")), rf"(?m)(?=^[^\n]*(?:{STAMP})\s*-->\s*(?:{STAMP}))")
    return F.filter(F.transform(F.filter(blocks, lambda b: F.substring_index(b, "\n", 1).rlike(TIMING)), cue), lambda c: c["text"] != "")


def without_roll(cues: Column) -> Column:
    """Cues without repeated text: one that begins with the last kept one extends it; of any other the words that end the last kept one are cut off its front."""

    def step(acc: Column, c: Column) -> Column:
        last, before = F.element_at(acc, -1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        old, new = F.split(last["text"], " "), F.split(c["text"], " ")
        same = lambda n: F.slice(old, F.size(old) - n + 1, n) == F.slice(new, F.lit(1), n)
        shared = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size(old), F.size(new))), same))
        rest = F.trim(F.array_join(F.slice(new, shared + 1, F.size(new)), " "))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"), c["text"].alias("text"), last["speaker"].alias("speaker"))
        added = F.struct(c["start"].alias("start"), c["end"].alias("end"), rest.alias("text"), c["speaker"].alias("speaker"))
        return F.when(F.size(acc) == 0, F.array(c)).when(c["text"].startswith(last["text"]), F.concat(before, F.array(grown))).when(rest == "", acc).otherwise(F.concat(acc, F.array(added)))

    return F.aggregate(cues, F.array().cast(f"array<{CUE}>"), step)


def grouped(cues: Column, size: int = SEGMENT) -> Column:
    """Segments of cues or words: cut at the end of a sentence from `size` characters on, at GROWTH * size in any case, and where another speaker begins.

    A segment has the start and speaker of its first item and the end of its last.
    """
    item = "struct<start:bigint,end:bigint,text:string,speaker:string,length:int,done:boolean>"

    def step(acc: Column, c: Column) -> Column:
        last, before = F.element_at(acc, -1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        fresh = (F.size(acc) == 0) | last["done"] | F.coalesce(c["speaker"].isNotNull() & ~c["speaker"].eqNullSafe(last["speaker"]), F.lit(False))
        length = F.char_length(c["text"]) + 1 + F.when(fresh, 0).otherwise(last["length"])
        done = ((length >= size) & c["text"].rlike(r"[.!?]$")) | (length >= size * GROWTH)
        row = F.struct(F.when(fresh, c["start"]).otherwise(last["start"]).alias("start"), c["end"].alias("end"), F.when(fresh, c["text"]).otherwise(F.concat_ws(" ", last["text"], c["text"])).alias("text"), F.when(fresh, c["speaker"]).otherwise(last["speaker"]).alias("speaker"), length.cast("int").alias("length"), done.alias("done"))
        return F.when(fresh, F.concat(acc, F.array(row))).otherwise(F.concat(before, F.array(row)))

    folded = F.aggregate(cues, F.array().cast(f"array<{item}>"), step)
    clean = lambda s: F.trim(F.regexp_replace(s["text"], r"\s+", " "))
    return F.filter(F.transform(folded, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), clean(s).alias("text"), s["speaker"].alias("speaker"))), lambda s: s["text"] != "")


def verbose_cues(raw: Column) -> Column:
    """Cues of a recogniser's verbose response; its whole text as one where it has no segments."""
    ms = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) * 1000 + 0.5)
    none = F.lit(None).cast("string").alias("speaker")

    def cues(r: Column) -> Column:
        timed = F.transform(r["segments"], lambda s: F.struct(ms(s["start"]).alias("start"), ms(s["end"]).alias("end"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text"), none))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.trim(F.coalesce(r["text"], F.lit(""))).alias("text"), none))
        return F.filter(F.when(F.coalesce(F.size(r["segments"]), F.lit(0)) > 0, timed).otherwise(whole), lambda c: c["text"] != "")

    return T.let(F.from_json(raw, VERBOSE), cues)


def speaker_label(speaker: Column) -> Column:
    """speaker_0 as 'Speaker 1'; an id without a number at its end stays."""
    n = F.regexp_extract(speaker, r"(\d+)\s*$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker "), (n.cast("int") + 1).cast("string"))).otherwise(speaker)


def word_segments(raw: Column, size: int = SEGMENT) -> Column:
    """Segments of a recogniser's words, each of one speaker; its whole text as one where it has no words."""
    ms = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) * 1000 + 0.5)

    def segments(r: Column) -> Column:
        spoken = F.filter(r["words"], lambda w: (F.coalesce(w["type"], F.lit("word")) == "word") & (F.trim(F.coalesce(w["text"], F.lit(""))) != ""))
        cues = F.transform(spoken, lambda w: F.struct(ms(w["start"]).alias("start"), ms(F.coalesce(w["end"], w["start"])).alias("end"), F.trim(w["text"]).alias("text"), speaker_label(w["speaker_id"]).alias("speaker")))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.trim(F.coalesce(r["text"], F.lit(""))).alias("text"), F.lit(None).cast("string").alias("speaker")))
        return F.when(F.coalesce(F.size(spoken), F.lit(0)) > 0, grouped(cues, size)).otherwise(F.filter(whole, lambda c: c["text"] != ""))

    return T.let(F.from_json(raw, WORDS), segments)


def chunk_plan(duration_ms: Column, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """(start, length) of the chunks that a recording is sent in: each but the first begins `overlap` seconds early."""
    c, o = chunk * 1000, overlap * 1000
    d = duration_ms.cast("long")

    def piece(at: Column) -> Column:
        start = F.when(at == 0, F.lit(0).cast("long")).otherwise(at - o)
        return F.struct(start.alias("start"), F.least(F.lit(c + o).cast("long"), d - start).alias("length"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.greatest(d, F.lit(0).cast("long")).alias("length")))
    return F.when(d <= c, whole).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(d - 1, F.lit(0).cast("long")), F.lit(c).cast("long")), piece))


def rebased(segments: DataFrame, by: str, overlap: int = OVERLAP) -> DataFrame:
    """segments (by, chunk_start, start, end, text) at their place in the recording, numbered; what lies in the overlap with the chunk before is dropped."""
    kept = segments.filter((F.col("chunk_start") == 0) | (F.col("start") >= overlap * 1000))
    placed = kept.withColumn("start", F.col("chunk_start") + F.col("start")).withColumn("end", F.col("chunk_start") + F.col("end"))
    return placed.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("chunk_start", "start", "end", "text")) - 1)


def video_id(url: Column) -> Column:
    """The id in a watch, short or clip address of a video; null for others."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{6,})", r"youtu\.be/([A-Za-z0-9_-]{6,})", r"/shorts/([A-Za-z0-9_-]{6,})")]
    return F.coalesce(*found)


def at_second(url: Column, ms: Column) -> Column:
    """The address that plays a recording from an offset, in whole seconds, not under 0."""
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("t="), F.greatest(F.floor(ms / 1000), F.lit(0).cast("long")).cast("string"))


VIDEO = "struct<id:string,title:string,webpage_url:string,url:string,channel:string,uploader:string,upload_date:string,duration:double>"


def videos(raw: DataFrame, column: str) -> DataFrame:
    """(id, title, url, channel, uploaded, duration_ms) of listed videos; an upload date of eight digits becomes a date, another is null."""
    v = raw.select(F.inline(F.from_json(column, f"array<{VIDEO}>"))).filter("id IS NOT NULL")
    day = F.when(F.col("upload_date").rlike(r"^\d{8}$"), F.try_to_date("upload_date", "yyyyMMdd"))
    address = F.coalesce("webpage_url", "url", F.concat(F.lit("https://www.youtube.com/watch?v="), "id"))
    return v.select("id", F.coalesce("title", "id").alias("title"), address.alias("address"), F.coalesce("channel", "uploader").alias("channel"), day.alias("uploaded"), F.floor(F.col("duration") * 1000 + 0.5).alias("duration_ms")).withColumnRenamed("address", "url")


def podcasts(raw: DataFrame, column: str) -> DataFrame:
    """(name, feed, publisher) of a podcast search; a feed's address is needed."""
    rows = raw.select(F.inline(F.from_json(column, "struct<results:array<struct<collectionName:string,trackName:string,feedUrl:string,artistName:string>>>")["results"]))
    return rows.filter("coalesce(feedUrl, '') <> ''").select(F.coalesce("collectionName", "trackName", F.lit("podcast")).alias("name"), F.col("feedUrl").alias("feed"), F.col("artistName").alias("publisher"))


def discovered(sources: list[DataFrame], per_ticker: int = 12) -> DataFrame:
    """Documents (url, ticker, title, day) of several listings in order of preference: one a url, the newest `per_ticker` of a ticker."""
    every = None
    for i, s in enumerate(sources):
        s = s.select("url", "ticker", "title", "day").withColumn("_source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    one = every.groupBy("url").agg(F.min_by(F.struct("ticker", "title", "day"), F.struct("_source", "ticker", "title")).alias("d")).select("url", "d.*")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc_nulls_last("day"), "url"))
    return one.withColumn("_rank", rank).filter(F.col("_rank") <= per_ticker).drop("_rank")


def transcript(captions: Column, recognised: Column, may_recognise: Column) -> Column:
    """Struct (kind, segments, error) of a recording: its captions, else what a recogniser made of it if that is allowed, else an error."""
    from_captions = grouped(without_roll(caption_cues(F.coalesce(captions, F.lit("")))))
    from_words = word_segments(F.coalesce(recognised, F.lit("{}")))

    def choose(c: Column) -> Column:
        none = F.array().cast(f"array<{CUE}>")
        made = F.when(may_recognise & recognised.isNotNull(), F.struct(F.lit("recognised").alias("kind"), from_words.alias("segments"), F.lit(None).cast("string").alias("error")))
        return F.when(F.size(c) > 0, F.struct(F.lit("captions").alias("kind"), c.alias("segments"), F.lit(None).cast("string").alias("error"))).otherwise(F.coalesce(made, F.struct(F.lit("none").alias("kind"), none.alias("segments"), F.lit("no captions and no recogniser").alias("error"))))

    return T.let(from_captions, choose)
