"""Bodies of pages whose patterns are tried only where they can fit, against the patterns tried on every page."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources import pages as P


def always(html):
    """article_text with every pattern on every page."""

    def entities(x):
        for pattern, sign in P.ENTITIES:
            x = F.regexp_replace(x, pattern, sign)
        codes = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#(\d+);"), F.lit(1)))
        one = lambda n: F.when((n > 31) & (n < 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(" ")
        return F.aggregate(codes, x, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), one(c.try_cast("int"))))

    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(entities(x), r"[ \t]+", " "), r"\n{3,}", "\n\n"))

    def paragraphs(x):
        bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
        for part in ("nav", "header", "footer", "aside", "form"):
            bare = F.regexp_replace(bare, rf"(?is)<{part}\b.*?</{part}>", " ")
        found = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
        return F.array_join(F.filter(F.transform(found, lambda p: tidy(F.regexp_replace(p, r"<[^>]+>", " "))), lambda p: F.char_length(p) > P.PARAGRAPH), "\n\n")

    return F.struct(P.body_of_linked_data(html).alias("ld"), paragraphs(F.regexp_extract(html, r"(?is)(<article\b.*?</article>)", 1)).alias("own"), paragraphs(html).alias("page"))


def test_same_bodies(spark):
    r = random.Random(9)
    long_ = "some plain words of a paragraph that goes on " * 6
    signs = ["<p>", "</p>", "<P class='x'>", "</P>", "<ARTICLE id=1>", "</article>", "<nav>", "</NAV>", "<n<script>", "av>", "<script>", "</Script>", "<STYLE>", "</style>", "<form >", "</form>", "<aside>", "</aside>", "<footer>", "</footer>"]
    signs += [long_, long_, long_, long_, " &amp;#65; ", "&nbsp;", "&lt;b&gt;", "&#8364;", "&#5;", "&", "\t", " \t", "\t\t x", "  ", "\n\n\n\n", "\n", "K", "İ", "<b>", '<script type="application/LD+json">{"articleBody":"' + long_ + long_ + '"}</script>']
    pages = ["".join(r.choice(signs) for _ in range(r.randrange(1, 25))) for _ in range(600)] + [None, "", "<p>" + long_ + "</p>"]
    df = spark.createDataFrame([(x,) for x in pages], "x string").repartition(4)
    part = T.let(always(F.col("x")), lambda s: F.when(F.char_length(s["ld"]) > P.DECLARED, s["ld"]).when(F.char_length(s["own"]) > P.INSIDE, s["own"]).when(F.char_length(s["page"]) > P.ANYWHERE, s["page"]).when(s["ld"] != "", s["ld"]).otherwise(s["own"]))
    rows = df.select("x", part.alias("want"), P.article_text(F.col("x")).alias("got")).collect()
    assert [x for x in rows if x["want"] != x["got"]] == [] and sum(bool(x["got"]) for x in rows) > 100


def test_lone_blanks_are_not_replaced(spark):
    """The cost that grew with words: nothing is replaced in a text of single blanks, and patterns of entities wait for an ampersand."""
    plan = spark.range(1).select(P.tidy(F.lit("x").substr(F.lit(1), F.col("id").cast("int")))).select("*")._jdf.queryExecution().analyzed().toString()
    assert "[ \\t]+|\\t" in plan and "contains" in plan.lower()
