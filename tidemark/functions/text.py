"""Expressions over text: sentences, words, shingles, terms, markup, hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no phrase begins or ends with.
PHRASE_STOPWORDS = """
a about after again against all also am an and any are as at be because been before being below between both but
by can did do does doing down during each few for from further had has have having he her here hers him his how
i if in into is it its just me might more most must my no nor not now of off on once only or other our
out over own per said same says she should so some such than that the their them then there these
they this those through to too under until up us very was we were what when where which while who whom why
will with would you your
""".split()

#: Editorial words that name no subject.
NOISE = """
read reads click subscribe newsletter advertisement sponsored continue reading share comments min mins ago today yesterday
new news latest update updates best top guide review reviews https http www com
""".split()

#: Words that are no distinctive term of a claim.
CLAIM_STOPWORDS = """
the and for with that this from have has had was were will would our its their they them these those than then
into over under about which while also been being more most other such some any all can could should may might must
company companies quarter year years million billion percent said says including during through between because after before
""".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def sentence_parts(text: Column) -> Column:
    """A text cut after . ! ? before a capital, digit, $ or quote, blanks collapsed; short parts are left in."""
    return F.split(F.regexp_replace(text, r"\s+", " "), r'(?<=[.!?])\s+(?=[A-Z0-9$"“])')


def long_parts(parts: Column, shortest: int) -> Column:
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.char_length(s) > shortest)  # not F.trim itself: a second argument, the index, would be what it trims


def sentences(text: Column, shortest: int = 20) -> Column:
    """Sentences of a text in order: blanks collapsed, cut after . ! ? before a capital, digit, $ or quote; longer than `shortest`."""
    return long_parts(sentence_parts(text), shortest)


def first_sentence(text: Column, shortest: int = 20, near: int = 1000) -> Column:
    """The first of a text's sentences, sought in its first `near` characters and, if none ends there, in all of it; null without one."""
    # the last part of a cut text may go on beyond the cut; the parts before it are as in the whole text
    ended = let(sentence_parts(F.substring(text, 1, near)), lambda p: F.get(long_parts(F.slice(p, 1, F.size(p) - 1), shortest), 0))
    whole = F.get(sentences(text, shortest), 0)
    return F.when(F.char_length(text) <= near, whole).otherwise(F.coalesce(ended, whole))


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and inner signs in lower case, without hyphens and quotes at their ends: words, and what words leaves out."""
    low = F.regexp_replace(F.lower(text), "[‘’]", "'")
    return F.regexp_extract_all(low, F.lit("[a-z0-9&](?:[a-z0-9'&-]*[a-z0-9&])?"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words with inner hyphens; no pure digits, 2 to 39 long."""
    return F.filter(word_runs(text), lambda w: (F.length(w) > 1) & (F.length(w) < 40) & (F.translate(w, "0123456789", "") != ""))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks, in order."""
    count = lambda t: F.size(t) - n + 1
    runs = lambda t: F.transform(F.sequence(F.lit(1), count(t)), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(tokens, lambda t: F.when(count(t) >= 1, runs(t)).otherwise(F.array().cast("array<string>")))


def phrases(tokens: Column, longest: int = 3, edges: list[str] = PHRASE_STOPWORDS + NOISE) -> Column:
    """Distinct runs of 1 to `longest` tokens that neither begin nor end with a word in edges."""
    marked = F.transform(tokens, lambda w: F.struct(w.alias("w"), (~w.isin(edges)).alias("ok")))

    def runs(t: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.get(t, i)["ok"] & F.get(t, i + (n - 1))["ok"])
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k)["w"] for k in range(n)]))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(marked, lambda t: F.array_distinct(F.concat(*[runs(t, n) for n in range(1, longest + 1)])))


def fingerprint(sentence: Column) -> Column:
    """A sentence without what differs between issuers: digits become #, other signs blanks."""
    s = F.regexp_replace(F.lower(sentence), "[‘’“”]", "'")
    s = F.regexp_replace(F.regexp_replace(s, r"\d+", "#"), r"[^a-z#\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def headline_key(title: Column) -> Column:
    """Identity of a headline: a trailing ' - Publisher' gone, letters and digits of the rest; nothing is cut."""
    bare = F.regexp_replace(title, r"[\s\p{Z}]+[-–—|][\s\p{Z}]+[^-–—|]{2,40}\z", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def shingles(sentence: Column, n: int = 8) -> Column:
    """Overlapping runs of n words of a sentence's fingerprint; a shorter one is its own; none of an empty one."""
    return shingles_of(fingerprint(sentence), n)


def shingles_of(print_: Column, n: int = 8) -> Column:
    """As shingles, of a fingerprint."""
    none = F.array().cast("array<string>")
    whole = lambda f: F.when(f == "", none).when(F.size(F.split(f, " ")) < n, F.array(f)).otherwise(ngrams(F.split(f, " "), n))
    return let(print_, whole)


def distinctive_terms(text: Column, stopwords: list[str] = CLAIM_STOPWORDS) -> Column:
    """Numbers of two signs or more and words of five letters or more, distinct."""
    numbers = lambda low: F.transform(F.regexp_extract_all(low, F.lit(r"\$?\d[\d,.]*%?"), F.lit(0)), lambda t: F.regexp_replace(F.regexp_replace(t, "[,$]", ""), r"\.$", ""))
    long_ = lambda low: F.regexp_extract_all(low, F.lit("[a-z][a-z-]{4,}"), F.lit(0))
    return let(F.lower(text), lambda low: F.array_distinct(F.concat(F.filter(numbers(low), lambda t: F.char_length(t) >= 2), F.filter(long_(low), lambda t: ~t.isin(stopwords)))))


def overlap(terms: Column, text: Column) -> Column:
    """The share of terms that a text contains anywhere; 0 without terms."""
    return let(F.lower(text), lambda low: contained(terms, low))


def contained(terms: Column, low: Column) -> Column:
    """The share of terms that a text in lower case contains anywhere; 0 without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: low.contains(t))) / F.size(terms))


def markup_text(html: Column) -> Column:
    """Text of a page: scripts and styles gone, tags to blanks, common entities decoded."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def paragraphs(html: Column, shortest: int = 60) -> Column:
    """Texts of <p> elements longer than `shortest`, parted by blank lines."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, markup_text), lambda p: F.char_length(p) > shortest), "\n\n")


def headings(html: Column, most: int = 25) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-5][^>]*>(.*?)</h[1-5]>"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, markup_text), lambda h: h != "")), 1, most)


def host(url: Column) -> Column:
    """Host of a URL in lower case without www; the port stays."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def suffixes(h: Column) -> Column:
    """A host and all its parent domains, longest first."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def searchable(name: Column) -> Column:
    """A name as it is searched: lower case, signs to blanks, no leading 'the'."""
    s = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))
    return F.regexp_replace(s, r"^the ", "")


def abbreviated_number(text: Column) -> Column:
    """25m, 5b, 1.5k as a number; null for anything else."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^\$?([0-9]+(?:\.[0-9]+)?)([kmbt]?)$", 1)
    unit = F.regexp_extract(t, r"^\$?([0-9]+(?:\.[0-9]+)?)([kmbt]?)$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)
    return F.when(n != "", n.cast("double") * factor)


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def clock(ms: Column) -> Column:
    """Milliseconds as h:mm:ss, or m:ss under an hour."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
