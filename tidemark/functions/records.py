"""Expressions over addresses, names, tickers, money and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Hosts that publish paid promotion, hosts that refuse readers and hosts of throw-away mail, unless a caller gives its own lists.
PROMOTIONAL = ("stockpromo.com", "pennyalerts.net")
BLOCKED = ("paywall.com",)
DISPOSABLE = ("mailinator.com", "tempmail.org")


def belongs(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or under one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def issuer_owned(host: Column, company: Column) -> Column:
    """Whether a host's second-level label and the company's slug, both of four letters or more, hold one another."""
    label = F.element_at(F.split(host, r"\."), -2)
    slug = F.regexp_replace(F.lower(company), "[^a-z0-9]", "")
    return F.coalesce((F.char_length(label) >= 4) & (F.char_length(slug) >= 4) & (label.contains(slug) | slug.contains(label)), F.lit(False))


def looks_like_url(x: Column) -> Column:
    return F.trim(x).rlike(r"^(https?://)?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(/\S*)?$")


def unwrap_redirect(url: Column) -> Column:
    """The address that a redirect names in url= or u=, else the address itself."""
    inner = F.regexp_extract(url, r"[?&](?:url|u)=([^&#]+)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(url)


def allowed_by_robots(path: Column, disallowed: Column) -> Column:
    """No disallowed prefix begins the path."""
    return F.forall(disallowed, lambda r: ~path.startswith(r))


def source_kind(url: Column, event: Column) -> Column:
    return F.when(event == "news", "news").when(url.rlike(r"(?i)youtube|youtu\.be|\.mp4"), "video").when(url.rlike(r"(?i)podcast|\.mp3"), "audio").otherwise("transcript")


def ticker(x: Column) -> Column:
    """A ticker in capitals, or null if it hasn't a ticker's shape."""
    t = F.upper(F.trim(x))
    return F.when(t.rlike(r"^[A-Z]{1,5}([.-][A-Z]{1,2})?$"), t)


def dot_class(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"^([A-Z]+)-([A-Z])$", "$1.$2")


def exchange_name(x: Column) -> Column:
    u = F.upper(x)
    return F.when(u.contains("NASDAQ"), "NASDAQ").when(u.contains("NYSE"), "NYSE").when(u.contains("OTC"), "OTC").otherwise(u)


def email(x: Column) -> Column:
    return F.lower(F.trim(x))


def valid_email(x: Column) -> Column:
    return email(x).rlike(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$")


def mailbox(x: Column) -> Column:
    """The box that mail to an address lands in: no plus tag, and no dots at gmail."""
    local, domain = F.split_part(email(x), F.lit("@"), F.lit(1)), F.split_part(email(x), F.lit("@"), F.lit(2))
    plain = F.split_part(local, F.lit("+"), F.lit(1))
    return F.concat(F.when(domain.isin("gmail.com", "googlemail.com"), F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain), F.lit("@"), domain)


def frequency(x: Column) -> Column:
    return F.when(x.isin("daily", "weekly", "off"), x).otherwise("daily")


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def runway_months(cash: Column, operating: Column) -> Column:
    """Months that cash lasts at a yearly outflow; null for an inflow."""
    return F.when(operating < 0, F.floor(cash / (F.abs(operating) / 12) * 10 + 0.5) / 10)


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (ask - bid) / ((bid + ask) / 2) * 10_000)


def speaker(x: Column) -> Column:
    """The name before a colon or dash at a segment's start, title-cased if in capitals; null if it isn't a name's shape."""
    name = F.trim(F.regexp_extract(x, r"^([A-Z][A-Za-z .'-]{1,59}?)\s*(?::|--)\s", 1))
    name = F.when(name == F.upper(name), F.initcap(F.lower(name))).otherwise(name)
    return F.when((F.char_length(name) >= 2) & ~F.lower(F.split_part(name, F.lit(" "), F.lit(1))).isin("the", "and", "but", "so"), name)


def cue(x: Column) -> Column:
    """A caption's words without its markup."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.markup_text(x), r"\{[^}]*\}", ""), r"\s+", " "))


def duration_ms(x: Column) -> Column:
    """h:mm:ss, m:ss or seconds as milliseconds; null for anything else."""
    parts = F.transform(F.split(x, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p)
    return F.when(x.rlike(r"^\d+(:\d{1,2}){0,2}$"), total * 1000)


def age_text(seconds: Column) -> Column:
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(n(60), F.lit("m ago"))).when(seconds < 86_400, F.concat(n(3600), F.lit("h ago"))).otherwise(F.concat(n(86_400), F.lit("d ago")))


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line: quoted ones may hold commas, and doubled quotes stand for one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"((?:[^"]|"")*+)"([^,]*)|([^,]*))'), F.lit(0))

    def field(x: Column) -> Column:
        body = F.substring(x, 2, 1_000_000)
        quoted = F.regexp_extract(body, r'(?s)^"((?:[^"]|"")*+)"(.*)$', 1)
        return F.when(body.rlike(r'(?s)^"(?:[^"]|"")*+"'), F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), F.regexp_extract(body, r'(?s)^"(?:[^"]|"")*+"(.*)$', 1))).otherwise(body)

    return F.transform(found, field)


def csv_field(value: Column) -> Column:
    """A value as a CSV field: quoted if it holds a comma, a quote or a line end."""
    return F.when(value.rlike('["\\n\\r,]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves away from zero, no grouping."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def money(x: Column) -> Column:
    """A price with two decimals, four under a dollar; a dash for none."""
    return F.when(x.isNull() | F.isnan(x), "—").when(x < 1, F.concat(F.lit("$"), fixed(x, 4))).otherwise(F.concat(F.lit("$"), fixed(x, 2)))


def signed_percent(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(F.when(x > 0, "+").otherwise(""), fixed(x, 2), F.lit("%")))


def short_volume(x: Column) -> Column:
    """A volume as 1.2B, 3.4M or 5K; a dash for none."""
    return (
        F.when(x.isNull() | F.isnan(x) | (x <= 0), "—").when(x >= 1e9, F.concat(fixed(x / 1e9, 1), F.lit("B"))).when(x >= 1e6, F.concat(fixed(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e3, F.concat(fixed(x / 1e3, 0), F.lit("K"))).otherwise(fixed(x, 0))
    )


def listed(x: Column) -> Column:
    """A comma list in capitals without blanks or empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def signal_payload(site: str) -> Column:
    """The event of a signal (signal_id, ticker, kind, direction, score, event_type, event_date, speaker, source_url) as JSON: what is missing is null, the quote stays out."""
    names = ("signal_id", "ticker", "kind", "direction", "score", "event_type", "event_date", "speaker", "source_url")
    score = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score")).alias("score")
    fields = [score if n == "score" else F.col(n) for n in names]
    return F.to_json(F.struct(*fields, F.concat(F.lit(f"{site}/"), F.url_encode(F.col("ticker"))).alias("url")), {"ignoreNullFields": "false"})
