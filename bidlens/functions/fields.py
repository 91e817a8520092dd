"""Listing fields from the texts of a result card's elements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search parameters of the listing site.
COUNTRIES = {"au": ".com.au", "at": ".at", "be": ".be", "ca": ".ca", "ch": ".ch", "de": ".de", "es": ".es", "fr": ".fr", "hk": ".com.hk", "ie": ".ie", "it": ".it", "my": ".com.my", "nl": ".nl", "nz": ".co.nz", "ph": ".ph", "pl": ".pl", "sg": ".com.sg", "uk": ".co.uk", "us": ".com"}
CONDITIONS = {"all": "", "new": "&LH_ItemCondition=1000", "opened": "&LH_ItemCondition=1500", "refurbished": "&LH_ItemCondition=2500", "used": "&LH_ItemCondition=3000"}
TYPES = {"all": "&LH_All=1", "auction": "&LH_Auction=1", "bin": "&LH_BIN=1", "offers": "&LH_BO=1"}
MODES = {"completed": "&LH_Complete=1", "sold": "&LH_Complete=1&LH_Sold=1", "active": "&_sop=1"}
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Hours that listing times are behind the clock in use.
OFFSET_HOURS = 7
_CLOCK = r"([01]?\d|2[0-3]):([0-5]\d)"


def _got(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_price(s: Column) -> Column:
    return _got(F.replace(s, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)").try_cast("double")


def parse_shipping(postage: Column) -> Column:
    """No element: 0; an element without a price, as for free postage: null."""
    return F.when(postage.isNull(), 0.0).otherwise(parse_price(postage))


def parse_count(text: Column) -> Column:
    """All digits of a text joined; none: 0."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("int"), F.lit(0))


def parse_item_id(link: Column) -> Column:
    return _got(link, r"/itm/(\d+)").try_cast("bigint")


def parse_sold_date(s: Column) -> Column:
    """`Sold 1 Dec 2025`; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(s, "^[Sold ]+", ""), F.lit("d MMM yyyy")).cast("date")


def _at(day_seconds: Column, text: Column, pattern: str, group: int, hours: float) -> Column:
    clock = F.regexp_extract(text, pattern, group).try_cast("int") * 3600 + F.regexp_extract(text, pattern, group + 1).try_cast("int") * 60
    return day_seconds + clock + F.lit(int(hours * 3600))


def _day(ref: Column) -> Column:
    return F.unix_seconds(F.date_trunc("day", ref))


def parse_end_time_today(s: Column, ref: Column, hours: float = OFFSET_HOURS) -> Column:
    p = rf"^(?i:today)\S*\s+{_CLOCK}"
    return F.when(s.rlike(p), F.timestamp_seconds(_at(_day(ref), s, p, 1, hours)))


def parse_end_time_weekday(s: Column, ref: Column, hours: float = OFFSET_HOURS) -> Column:
    p = rf"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s*{_CLOCK}"
    target = F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(s, p, 1)).cast("int") - 1
    ahead = F.pmod(target - F.weekday(ref) + 7, F.lit(7))
    at = _at(_day(ref) + ahead * 86400, s, p, 2, 0)
    at = F.when(at <= F.unix_seconds(ref), at + 7 * 86400).otherwise(at)
    return F.when(s.rlike(p), F.timestamp_seconds(at + F.lit(int(hours * 3600))))


def parse_end_time_date(s: Column, ref: Column, hours: float = OFFSET_HOURS) -> Column:
    p = rf"^(\d\d?)/(\d\d?),\s*{_CLOCK}"
    g = [F.regexp_extract(s, p, i).try_cast("int") for i in range(1, 5)]
    day = F.try_make_timestamp(F.year(ref), g[1], g[0], g[2], g[3], F.lit(0))
    # a day of this year that is past is next year's
    passed = F.coalesce(day < ref, F.lit(False))
    at = F.unix_seconds(F.when(passed, F.try_make_timestamp(F.year(ref) + 1, g[1], g[0], g[2], g[3], F.lit(0))).otherwise(day))
    return F.when(s.rlike(p), F.timestamp_seconds(at + F.lit(int(hours * 3600))))


def parse_end_time(s: Column, ref: Column, hours: float = OFFSET_HOURS) -> Column:
    """What none of the three forms fits is null (and goes to quarantine), never an error."""
    t = F.btrim(s, F.lit(" ()"))
    return F.coalesce(parse_end_time_today(t, ref, hours), parse_end_time_weekday(t, ref, hours), parse_end_time_date(t, ref, hours))


def _choice(c: Column, table: dict[str, str], what: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)))


def search_url(query: Column, country: Column, condition: Column, kind: Column, mode: Column, site: str = "https://www.example") -> Column:
    """Percent-encoded with `/` kept and spaces as `+`; an unknown choice raises."""
    q = F.replace(F.replace(F.url_encode(query), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(site), _choice(country, COUNTRIES, "country"), F.lit("/sch/i.html?_from=R40&_nkw="), F.replace(q, F.lit("*"), F.lit("%2A")), _choice(mode, MODES, "mode"), _choice(condition, CONDITIONS, "condition"), _choice(kind, TYPES, "type"))
