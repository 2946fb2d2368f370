"""Signals out of sentences: taxonomy, boilerplate, subject attribution. A document's sentences stay one array until they are exploded, so context needs no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rulebook as B
from tidemark.functions import text as T
from tidemark.functions.math import round_half_up


def any_of(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """Whether one of the patterns is found in a text; low, if given, is its lower case.

    The rulebook's own lists are tried only on texts that hold a word without
    which none of them fits: most hold none, and patterns cost far more.
    """
    either = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    found = either([text.rlike(p) for p in patterns])
    needles = B.NEEDLES.get(tuple(patterns))
    if needles is None:
        return found
    held = lambda x: either([x.contains(w) for w in needles])
    return (held(low) if low is not None else T.let(F.lower(text), held)) & found


def with_context(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, a row a sentence: pos, sentence, before, after, and in_section: one of the six sentences before is a disclaimer.

    Null and empty texts give no row.
    """
    reach = B.DISCLAIMER_RUN

    def rows(s: Column) -> Column:
        opens = F.transform(s, lambda x: any_of(x, B.DISCLAIMER))
        near = lambda o, i: F.exists(F.slice(o, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), lambda b: b)
        return T.let(opens, lambda o: F.transform(s, lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), F.when(i > 0, F.get(s, i - 1)).alias("before"), F.get(s, i + 1).alias("after"), near(o, i).alias("in_section"))))

    exploded = docs.withColumn("_row", F.explode(T.let(T.sentences(F.col(text)), rows)))
    return exploded.select(*[c for c in docs.columns if c != text], "_row.*")


def reasons(sentence: Column, before: Column, after: Column, in_section: Column) -> Column:
    """Why a sentence is no claim of its own, in order; empty for a claim."""
    window = F.concat(F.coalesce(before, F.lit("")), F.lit(" "), sentence, F.lit(" "), F.coalesce(after, F.lit("")))
    hedged = any_of(sentence, B.HYPOTHETICAL) & ~(any_of(sentence, B.ASSERTIVE) & sentence.rlike(B.CLAIM_NUMBER))
    checks = {"disclaimer_marker": any_of(window, B.DISCLAIMER), "structural_noise": any_of(sentence, B.FURNITURE), "disclaimer_section": in_section, "hypothetical": hedged}
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda r: r.isNotNull())


def classified(docs: DataFrame, repeated: DataFrame | None = None, share: float = 0.6, size: int = 8) -> DataFrame:
    """Sentences of docs (id, ...) with reasons and is_boilerplate; repeated (shingle) adds 'corpus_repeated' where `share` of a sentence's shingles are in it.

    Shingles count as often as they stand in the sentence, and sentences of
    one fingerprint have the same, so the share is found once a fingerprint.
    Both joins are told to sort and merge: repeated shingles and fingerprints
    grow with the corpus, which Spark's estimate before the run, made from the
    size of the files, doesn't see; it would broadcast them.
    """
    rows = with_context(docs).withColumn("reasons", reasons(F.col("sentence"), F.col("before"), F.col("after"), F.col("in_section")))
    if repeated is not None:
        prints = docs.select(F.explode(T.sentences(F.col("text"))).alias("_s")).select(T.fingerprint(F.col("_s")).alias("_print")).distinct()
        parts = prints.select("_print", F.explode(T.shingles_of(F.col("_print"), size)).alias("shingle"))
        hits = parts.join(repeated.select("shingle").distinct().withColumn("_hit", F.lit(1)).hint("merge"), "shingle", "left")
        known = hits.groupBy("_print").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("_share")).filter(F.col("_share") >= share).select("_print", F.lit(True).alias("_known"))
        rows = rows.withColumn("_print", T.fingerprint(F.col("sentence"))).join(known.hint("merge"), "_print", "left")
        rows = rows.withColumn("reasons", F.when(F.col("_known"), F.concat("reasons", F.array(F.lit("corpus_repeated")))).otherwise(F.col("reasons"))).drop("_known", "_print")
    return rows.withColumn("is_boilerplate", F.size("reasons") > 0)


def signals(sentences: DataFrame, rules: list = B.SIGNAL_RULES) -> DataFrame:
    """One row per sentence and rule that fires: id, pos, ticker, event_type, direction, strength, specificity, quote, before, after, evidence_hash, signal_id.

    sentences: (id, ticker, event_date, pos, sentence, before, after,
    is_boilerplate). Of equal evidence in a document the first stays. All
    rules are one expression, so a sentence is read once.
    """
    s = F.col("sentence")
    numeric = s.rlike(B.SIGNAL_NUMBER)

    def one(rule: tuple, low: Column) -> Column:
        kind, direction, weight, patterns, unless = rule
        strength = F.least(F.lit(1.0), F.lit(weight) * F.when(numeric, 1.0).otherwise(0.9))
        found = F.struct(F.lit(kind).alias("event_type"), F.lit(direction).alias("direction"), round_half_up(strength).alias("strength"), F.when(numeric, 0.85).otherwise(0.45).alias("specificity"))
        return F.when(any_of(s, patterns, low) & ~any_of(s, unless), found)

    fired = T.let(F.lower(s), lambda low: F.filter(F.array(*[one(rule, low) for rule in rules]), lambda x: x.isNotNull()))
    rows = sentences.withColumn("_s", F.explode(fired)).withColumn("quote", F.substring(F.trim(s), 1, 500))
    rows = rows.withColumn("evidence_hash", T.short_hash(F.concat_ws("|", "ticker", "_s.event_type", "quote")))
    first = F.row_number().over(Window.partitionBy("id", "evidence_hash").orderBy("pos"))
    rows = rows.withColumn("_n", first).filter("_n = 1")
    cut = lambda c: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, 200).alias(c)
    name = F.concat_ws(":", "ticker", F.col("event_date").cast("string"), "_s.event_type", F.substring("evidence_hash", 1, 8))
    return rows.select("id", "pos", "ticker", "_s.*", "quote", cut("before"), cut("after"), "evidence_hash", name.alias("signal_id"), "is_boilerplate")


def subject_terms(ticker: Column, company: Column) -> Column:
    """What names a company: its ticker, its core name, and that name's first word if it is four letters or more."""
    core = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(company, F.lit("")), B.NAME_FURNITURE, ""), "[^A-Za-z0-9 &-]", " "), r"\s+", " "))

    def terms(c: Column) -> Column:
        first = F.substring_index(c, " ", 1)
        named = F.array(c, F.when((F.char_length(first) >= 4) & (F.lower(first) != F.lower(c)), first))
        return F.array_distinct(F.filter(F.concat(F.array(F.upper(ticker)), F.when(F.char_length(c) >= 3, named).otherwise(F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != "")))

    return T.let(core, terms)


def candidate_tickers(text: Column) -> Column:
    """Runs of two to five capitals that are no common acronym, distinct."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\$?\b([A-Z]{2,5})\b"), F.lit(1)), lambda t: ~t.isin(B.NOT_TICKERS)))


def names_subject(sentence: Column, terms: Column) -> Column:
    """Whether a sentence holds one of the terms of two letters or more, in any case; without such terms every sentence does."""
    usable = F.filter(F.transform(terms, F.lower), lambda t: F.char_length(t) >= 2)
    return T.let(F.lower(sentence), lambda low: T.let(usable, lambda u: (F.size(u) == 0) | F.exists(u, lambda t: low.contains(t))))


def other_proper_nouns(sentence: Column, allowed: Column) -> Column:
    """Capitalised words that are neither ordinary vocabulary nor part of an allowed name.

    The word that opens a sentence counts only if it has another capital or a
    verb of reporting follows it.
    """
    word = r"[A-Z][A-Za-z0-9&.'-]+\b"
    s = F.ltrim(sentence)
    opens = s.rlike("^" + word)
    follower = F.regexp_replace(F.regexp_extract(s, rf"^{word}\s*(\S*)", 1), "[^A-Za-z]", "")
    low_allowed = F.filter(F.transform(allowed, F.lower), lambda t: t != "")

    def kept(raw: Column, i: Column) -> Column:
        known = F.exists(low_allowed, lambda t: t.contains(F.lower(raw)) | F.lower(raw).contains(t))
        plain = opens & (i == 0) & ~F.substring(raw, 2, 1000).rlike("[A-Z]") & ~follower.rlike(B.REPORTING)
        return ~F.lower(raw).isin(B.NOT_COMPANIES) & ~known & ~plain

    return F.filter(F.regexp_extract_all(s, F.lit(r"\b" + word), F.lit(0)), kept)


def other_issuers(rows: DataFrame, known: DataFrame, keys: list[str], text: str, subject: str = "ticker") -> DataFrame:
    """keys of the rows whose text has a candidate ticker that is in known (symbol) and not the row's own."""
    found = rows.select(*keys, F.upper(subject).alias("_own"), F.explode(candidate_tickers(F.col(text))).alias("symbol")).filter("symbol <> _own")
    return found.join(known.select("symbol").distinct(), "symbol", "left_semi").select(*keys).distinct()


def attributed(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """sentences (id, pos, ticker, company, sentence) with attributed: whether each is about the document's subject.

    Naming the subject opens a run; another issuer or an unknown proper noun
    closes it; a sentence that names nobody goes on only by an anaphora. The
    run's state at a sentence is that of the last one that set it.
    """
    terms = subject_terms(F.col("ticker"), F.col("company"))
    rows = sentences.join(other_issuers(sentences, known, ["id", "pos"], "sentence").withColumn("_other", F.lit(True)), ["id", "pos"], "left")
    names = names_subject(F.col("sentence"), terms)
    foreign = F.coalesce("_other", F.lit(False)) | (F.size(other_proper_nouns(F.col("sentence"), F.concat(terms, F.array("ticker")))) > 0)
    rows = rows.withColumn("_names", names).withColumn("_sets", F.when(F.col("_names"), True).when(foreign, False))
    state = F.coalesce(F.last("_sets", ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    about = F.when(F.col("_names"), True).when(F.col("_sets").isNotNull(), False).otherwise(state & F.col("sentence").rlike(B.ANAPHORA))
    return rows.withColumn("attributed", about).drop("_other", "_names", "_sets")


def mentions(title: Column, ticker: Column, company: Column) -> Column:
    """Whether a headline has the ticker as a word or the company's core name, longer than three letters, in any case."""
    core = F.trim(F.regexp_replace(F.coalesce(company, F.lit("")), B.HEADLINE_FURNITURE, ""))
    word = F.regexp_like(title, F.concat(F.lit(r"\b\Q"), ticker, F.lit(r"\E\b")))
    return F.coalesce(word, F.lit(False)) | T.let(core, lambda c: (F.char_length(c) > 3) & F.coalesce(F.lower(title).contains(F.lower(c)), F.lit(False)))


def ticker_mentions(text: Column) -> Column:
    """(symbol, n, first) structs of cashtags and exchange-qualified tickers, the most frequent first, ties by first sight."""
    shape = r"([A-Za-z]{1,5}(?:\.[A-Za-z]{1,2})?)\b"
    every = F.concat(F.regexp_extract_all(text, F.lit(r"\$" + shape), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\b" + B.EXCHANGES + r"\s*[:：]\s*" + shape), F.lit(1)))

    def ranked(found: Column) -> Column:
        count = lambda t: F.size(F.filter(found, lambda x: x == t))
        rows = F.transform(F.array_distinct(found), lambda t: F.struct((-count(t)).alias("minus"), F.array_position(found, t).cast("int").alias("first"), t.alias("symbol")))
        return F.transform(F.array_sort(rows), lambda r: F.struct(r["symbol"].alias("symbol"), (-r["minus"]).alias("n"), r["first"].alias("first")))

    return T.let(F.transform(every, F.upper), ranked)


def attribute_speaker(text: Column) -> Column:
    """Struct (speaker, title, confidence, rest) of the label that opens a segment; null speaker and the text itself without one."""
    s = F.ltrim(text)
    plausible = lambda n: (F.char_length(n) >= 2) & (F.char_length(n) <= 60) & ~n.rlike(B.NO_SPEAKERS) & n.rlike("^[A-Z]")
    proper = lambda n: F.when(n == F.upper(n), F.initcap(F.lower(n))).otherwise(n)
    out = F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("title"), F.lit(0.0).alias("confidence"), text.alias("rest"))
    for pattern, confidence in reversed(B.SPEAKER_PATTERNS):
        name, title = F.trim(F.regexp_extract(s, pattern, 1)), F.trim(F.regexp_extract(s, pattern, 2))
        titled = title.rlike(B.SPEAKER_TITLES)
        fits = s.rlike(pattern) & plausible(name) & ((title == "") | titled | (F.size(F.split(title, r"\s+")) <= 6))
        label = F.struct(proper(name).alias("speaker"), F.when((title != "") & titled, title).alias("title"), F.lit(confidence).alias("confidence"), F.trim(F.regexp_replace(s, pattern, "")).alias("rest"))
        out = F.when(fits, label).otherwise(out)
    return out
