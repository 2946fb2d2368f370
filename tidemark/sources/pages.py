"""Articles and pages: bodies, declared metadata and linked data out of HTML, robots rules and addresses.

A null page gives empty results; a malformed block of linked data is left out by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Named and numbered entities that are decoded before other numbers.
ENTITIES = [(r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#0?39;|&apos;|&rsquo;|&#8217;", "'"), (r"&ldquo;|&rdquo;|&#8220;|&#8221;", '"'), (r"&ndash;|&mdash;|&#8211;|&#8212;", "-"), (r"&amp;", "&")]
#: Fixed value: blocks of linked data.
LINKED = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: A backslash and a quote in a JSON text, and the signs that stand for them meanwhile.
ESCAPES = [("\\\\", "\x01"), ('\\"', "\x02")]
#: Characters that a body must have by where it was found, and that a paragraph must have.
DECLARED, INSIDE, ANYWHERE, PARAGRAPH, BODY = 400, 400, 250, 60, 200


def decode_entities(text: Column) -> Column:
    """Text with entities decoded, decimal numbers included; a number of no printable character becomes a blank."""
    return T.let(text, lambda t: F.when(t.contains("&"), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    for pattern, sign in ENTITIES:
        text = F.regexp_replace(text, pattern, sign)

    def numbered(t: Column) -> Column:
        def one(code: Column) -> Column:
            n = code.try_cast("int")
            return F.when((n > 31) & (n < 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(" ")

        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d+);"), F.lit(1)))
        return F.aggregate(codes, t, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), one(c)))

    return T.let(text, lambda t: F.when(t.contains("&#"), numbered(t)).otherwise(t))


def cleaned(text: Column, longest: int = 400) -> Column:
    """A declared value as plain text of at most `longest` characters; null for an empty one."""
    plain = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(text, r"<[^>]+>", " ")), r"\s+", " "))
    return F.nullif(F.substring(plain, 1, longest), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in double, single or no quotes; null without it."""
    forms = [rf'(?i)\b{name}\s*=\s*"([^"]*)"', rf"(?i)\b{name}\s*=\s*'([^']*)'", rf"(?i)\b{name}\s*=\s*([^\s>]+)"]
    out = F.lit(None).cast("string")
    for form in reversed(forms):
        out = F.when(tag.rlike(form), F.regexp_extract(tag, form, 1)).otherwise(out)
    return out


def meta_tags(html: Column) -> Column:
    """Structs (key, value) of a page's meta tags in order, keys in lower case; tags without a key or value are left out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    pair = lambda t: F.struct(F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"), F.lit(""))).alias("key"), attribute(t, "content").alias("value"))
    return F.filter(F.transform(tags, pair), lambda p: (p["key"] != "") & (p["value"] != ""))


def linked_data(html: Column, depth: int = 3) -> Column:
    """The objects of a page's linked data as JSON texts: those of arrays and, down to `depth`, of @graph too."""
    objects = lambda t: F.when(F.ltrim(t).startswith("["), F.from_json(t, "array<string>")).when(F.ltrim(t).startswith("{"), F.array(t)).otherwise(F.array().cast("array<string>"))
    blocks = F.filter(F.regexp_extract_all(html, F.lit(LINKED), F.lit(1)), lambda b: F.try_parse_json(b).isNotNull())
    found = F.flatten(F.transform(blocks, objects))

    def below(nodes: Column, left: int) -> Column:
        inner = lambda n: F.concat(F.array(n), F.coalesce(objects(F.get_json_object(n, "$['@graph']")), F.array().cast("array<string>")))
        return nodes if left == 0 else below(F.flatten(F.transform(nodes, inner)), left - 1)

    return below(F.filter(found, lambda n: n.isNotNull()), 1) if depth <= 1 else T.let(found, lambda n: below(F.filter(n, lambda x: x.isNotNull()), 1))


def declared(nodes: Column, path: str) -> Column:
    """The first value at a path among linked objects that isn't blank."""
    return F.get(F.filter(F.transform(nodes, lambda n: F.trim(F.get_json_object(n, path))), lambda v: F.coalesce(v, F.lit("")) != ""), 0)


def without(text: Column, low: Column, part: str, begin: str = r"\b") -> Column:
    """Text without an element's parts, each a blank then; `low`, the text or what it came from in lower case, tells whether it has any.

    A blank in a part's place joins no signs, so an end tag that `low` lacks doesn't come up later.
    """
    return T.let(text, lambda t: F.when(low.contains(f"</{part}>"), F.regexp_replace(t, rf"(?is)<{part}{begin}.*?</{part}>", " ")).otherwise(t))


def body_of_linked_data(html: Column, low: Column | None = None) -> Column:
    """The first articleBody of over BODY characters in a page's valid blocks, decoded; '' without one. `low`: the page in lower case."""
    found = F.regexp_extract_all(html, F.lit(LINKED), F.lit(1))
    if low is not None:
        found = F.when(low.contains("ld+json"), found).otherwise(F.array().cast("array<string>"))
    blocks = F.filter(found, lambda b: F.try_parse_json(b).isNotNull())
    follow = F.flatten(F.transform(blocks, lambda b: F.slice(F.split(b, r'"articleBody"\s*:\s*"'), 2, 1_000_000)))

    def value(rest: Column) -> Column:
        # escaped signs are put aside, so that the first quote left ends the value
        for escaped, sign in ESCAPES:
            rest = F.replace(rest, F.lit(escaped), F.lit(sign))
        rest = F.substring_index(rest, '"', 1)
        for escaped, sign in ESCAPES:
            rest = F.replace(rest, F.lit(sign), F.lit(escaped))
        return F.from_json(F.concat(F.lit('{"b":"'), rest, F.lit('"}')), "struct<b:string>")["b"]

    texts = F.transform(follow, value)
    return tidy(F.coalesce(F.get(F.filter(texts, lambda t: F.char_length(t) > BODY), 0), F.lit("")))


def tidy(text: Column) -> Column:
    """Decoded text with single blanks and at most one empty line."""
    blanks = F.regexp_replace(decode_entities(text), r" [ \t]+|\t[ \t]*", " ")  # lone blanks, which are most, stay as they are
    return F.trim(T.let(blanks, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)))


def body_paragraphs(html: Column) -> Column:
    """Paragraphs of over PARAGRAPH characters outside scripts, styles and page furniture, parted by empty lines."""
    return T.let(F.struct(html.alias("html"), F.lower(html).alias("low")), lambda x: _paragraphs(x["html"], x["low"]))


def _paragraphs(html: Column, low: Column) -> Column:
    bare = without(without(html, low, "script", ""), low, "style", "")
    for part in ("nav", "header", "footer", "aside", "form"):
        bare = without(bare, low, part)
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    plain = lambda p: F.when(p.contains("<"), F.regexp_replace(p, r"<[^>]+>", " ")).otherwise(p)
    return F.array_join(F.filter(F.transform(found, lambda p: tidy(plain(p))), lambda p: F.char_length(p) > PARAGRAPH), "\n\n")


def article_text(html: Column) -> Column:
    """The body that a page declares if it is long, else that of its article element if long, else all its paragraphs, else whichever there is."""

    def parts(x: Column) -> Column:
        page, low = x["html"], x["low"]
        inside = F.when(low.contains("</article>") | low.isNull(), F.regexp_extract(page, r"(?is)(<article\b.*?</article>)", 1)).otherwise("")
        return F.struct(body_of_linked_data(page, low).alias("ld"), body_paragraphs(inside).alias("own"), _paragraphs(page, low).alias("page"))

    def choose(parts: Column) -> Column:
        ld, own, page = parts["ld"], parts["own"], parts["page"]
        return F.when(F.char_length(ld) > DECLARED, ld).when(F.char_length(own) > INSIDE, own).when(F.char_length(page) > ANYWHERE, page).when(ld != "", ld).otherwise(own)

    return T.let(F.struct(html.alias("html"), F.lower(html).alias("low")), lambda x: T.let(parts(x), choose))


def page_meta(html: Column) -> Column:
    """Struct of what a page says of itself: title, description, site, author, published, canonical, image, type, language, keywords.

    What is declared for syndication comes before linked data and that before tags of the page.
    """
    first = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    canonical = F.get(F.transform(F.filter(links, lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical")), lambda t: attribute(t, "href")), 0)

    def build(x: Column) -> Column:
        named = lambda name: F.get(F.filter(x["m"], lambda p: p["key"] == F.lit(name)), 0)["value"]
        tag = lambda *names: F.coalesce(*map(named, names))
        ld = x["ld"]
        keywords = F.transform(F.split(F.coalesce(tag("keywords"), tag("news_keywords"), F.lit("")), ","), lambda k: F.coalesce(cleaned(k), F.lit("")))
        author = F.coalesce(declared(ld, "$.author[0].name"), declared(ld, "$.author.name"), F.get(F.filter(F.transform(ld, lambda n: F.get_json_object(n, "$.author")), lambda a: ~a.rlike(r"^\s*[\[{]")), 0))
        kind = F.coalesce(F.get(F.filter(F.transform(ld, lambda n: F.get_json_object(n, "$['@type']")), lambda t: ~t.rlike(r"^\s*\[")), 0), declared(ld, "$['@type'][0]"))
        return F.struct(
            cleaned(F.coalesce(tag("og:title", "twitter:title"), declared(ld, "$.headline"), first(r"(?is)<title[^>]*>(.*?)</title>"), first(r"(?is)<h1\b[^>]*>(.*?)</h1>"))).alias("title"),
            cleaned(F.coalesce(tag("og:description", "description", "twitter:description"), declared(ld, "$.description"))).alias("description"),
            cleaned(tag("og:site_name", "application-name")).alias("site"), cleaned(F.coalesce(tag("author", "article:author"), author)).alias("author"),
            F.coalesce(tag("article:published_time", "datepublished", "date"), declared(ld, "$.datePublished"), tag("article:modified_time")).alias("published"),
            cleaned(F.coalesce(canonical, tag("og:url"))).alias("canonical"), cleaned(tag("og:image", "twitter:image")).alias("image"), cleaned(F.coalesce(tag("og:type"), kind)).alias("type"),
            cleaned(first(r"""(?i)<html[^>]*\blang=["']([^"']{2,10})["']""")).alias("language"), F.slice(F.filter(keywords, lambda k: (F.char_length(k) > 1) & (F.char_length(k) < 60)), 1, 20).alias("keywords"),
        )

    return T.let(F.struct(meta_tags(html).alias("m"), linked_data(html).alias("ld")), build)


def robots_rules(raw: Column, agent: str) -> Column:
    """Struct (disallow, delay_ms) of the groups for * and for an agent: a group's lines follow its user-agent line."""
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("disallow"), F.lit(0).cast("long").alias("delay_ms"))

    def step(a: Column, p: Column) -> Column:
        mine = (p["v"] == "*") | F.lower(p["v"]).contains(agent.lower())
        delay = F.least(p["v"].try_cast("double") * 1000, F.lit(10_000.0)).cast("long")
        return F.struct(
            F.when(p["k"] == "user-agent", mine).otherwise(a["on"]).alias("on"),
            F.when(a["on"] & (p["k"] == "disallow") & (p["v"] != ""), F.concat(a["disallow"], F.array(p["v"]))).otherwise(a["disallow"]).alias("disallow"),
            F.when(a["on"] & (p["k"] == "crawl-delay") & delay.isNotNull(), delay).otherwise(a["delay_ms"]).alias("delay_ms"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.struct(a["disallow"].alias("disallow"), a["delay_ms"].alias("delay_ms")))


def private_v4(address: Column) -> Column:
    """Whether an IPv4 address is not of the public internet; one that can't be read counts as private."""
    n = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike(r"^\d{1,9}$"), p.cast("int")))

    def test(p: Column) -> Column:
        a, b = F.get(p, 0), F.get(p, 1)
        bad = (F.size(p) != 4) | F.exists(p, lambda x: x.isNull() | (x > 255))
        blocks = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(168, 0)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
        return bad | F.coalesce(blocks, F.lit(True))

    return T.let(n, test)


def private_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is not of the public internet."""
    ip = F.regexp_replace(F.lower(address), "%.*$", "")
    mapped = F.regexp_extract(ip, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v6 = F.when(mapped != "", private_v4(mapped)).otherwise(ip.isin("::", "::1") | ip.rlike("^f[cd][0-9a-f]{2}:") | ip.rlike("^fe[89ab][0-9a-f]:") | ip.rlike("^ff[0-9a-f]{2}:"))
    return F.when(address.contains(":"), v6).otherwise(private_v4(address))
