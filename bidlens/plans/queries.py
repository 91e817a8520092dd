"""One query an operator, over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields, titles
from ..operators import ingest, market, model, outcomes, repair, runs
from ..sources import adapters
from ..sources import cards as reader
from ..streaming import ledger as ledger_stream
from ..streaming import lifecycle, refresh, upserts, verify
from .sql import EXPR, NOW, build, day, ts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = build(sql, *ctes)
        return f

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def date(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


#: What listings hold besides id, and what prices by product need of it. Only these travel to the last write of each id.
LISTED = ("category", "title", "price_pence", "bids", "end_time", "sold_date", "url")
PRICED = ("category", "title", "price_pence", "sold_date")


def listings(s, d, *columns: str) -> DataFrame:
    return ingest.latest(adapters.snapshots(s, d).select("id", "seq", *(columns or LISTED)))


def enriched(s, d, *columns: str, only: str | None = None) -> DataFrame:
    return ingest.enrich(listings(s, d, *columns), only)


def market_rows(s, d, *columns: str, only: str | None = None) -> DataFrame:
    return market.market_listing(enriched(s, d, *columns, only=only))


def written(s, df: DataFrame, what: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, in partitions by some columns: several steps read it, and its work is done once."""
    path = f"{upserts.shared_dir(s)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return s.read.schema(df.schema).parquet(path)


def ledger(s, d) -> DataFrame:
    return adapters.ledger(listings(s, d, "category", "price_pence", "end_time", "sold_date"))


def priced(s, d) -> DataFrame:
    """What prices by product need of market rows, worked out once: statistics are made of it and joined to it."""
    return written(s, market_rows(s, d, *PRICED).select("id", *market.KEYS, "price_pence", "sold_date"), "market")


def all_deals(s, d, li: DataFrame | None = None) -> DataFrame:
    """Of the listings li or, else, of their last writes: a table, of which statistics read the sold rows and deals those that end soon."""
    return market.deals(market.market_listing(ingest.enrich(li or written(s, listings(s, d), "listing"))), adapters.as_of())


def ledger_and_deals(s, d) -> tuple[DataFrame, DataFrame]:
    """Both from the same listings: their last writes are worked out once, as both plans need the same exchange."""
    li = listings(s, d)
    return adapters.ledger(li), market.deals(market.market_listing(ingest.enrich(li)), adapters.as_of())


def run_log(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("finished_at"))


def sightings(s, d) -> DataFrame:
    """Sold and completed pages for the verification of outcomes."""
    n = adapters.snapshots(s, d)
    price = (F.col("price_pence") / 100.0).alias("price")
    a = n.where("mode = 'sold' and id % 3 = 0").select("id", "mode", "seq", "bids", "sold_date", price)
    b = n.where("mode = 'active' and id % 3 = 1").select((F.col("id") + 7).alias("id"), F.lit("sold").alias("mode"), "seq", "bids", F.col("end_time").cast("date").alias("sold_date"), price)
    c = n.where("id % 5 < 2").select("id", F.lit("completed").alias("mode"), "seq", "bids", F.lit(None).cast("date").alias("sold_date"), price)
    return a.unionByName(b).unionByName(c)


# -- sources and sinks ------------------------------------------------------------------------


@query("scan_listings", f"SELECT id, category, brand, model, title, price_pence, {ts('end_time')} AS end_time FROM enriched", "enriched")
def scan_listings(s, d):
    return enriched(s, d).select("id", "category", "brand", "model", "title", "price_pence", stamp("end_time"))


@query("raw_page_landing", f"SELECT DISTINCT query, mode, '{adapters.AS_OF}' AS fetched_at, CAST(1 + (length(query) % 2 = 0)::INT AS BIGINT) AS versions FROM snap", "snap")
def raw_page_landing(s, d):
    """Pages land in a folder, the older versions first; what a second run brings again is not landed again."""
    p, path = adapters.raw_pages(s, d), f"{upserts.shared_dir(s)}/pages-{uuid.uuid4().hex}"
    ingest.land_pages(p.where(F.col("fetched_at") < adapters.as_of()), path)
    ingest.land_pages(p, path, s.read.schema("query string, fetched_at timestamp, html string, mode string").parquet(path))
    landed = s.read.schema("query string, fetched_at timestamp, html string, mode string").parquet(path)
    n = landed.groupBy("query", "mode").agg(F.count("*").alias("versions"))
    return ingest.landed_pages(landed).join(n, ["query", "mode"]).select("query", "mode", stamp("fetched_at"), "versions")


@query("page_quality_gate", "SELECT page_id, length(html) AS chars, coalesce(length(html) >= 5000, false) AS accepted FROM pages")
def page_quality_gate(s, d):
    return ingest.quality_gate(s.read.parquet(f"{d}/pages.parquet"), 5000).select("page_id", F.col("chars").cast("long"), "accepted")


_CLOCK = "lpad(CAST(id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0')"
_FEW = "CAST(id % 9 AS VARCHAR)"
_POSTAGE = f"""CASE id % 4 WHEN 0 THEN '<span class="su-styled-text secondary large"><span>Free postage</span></span>' WHEN 1 THEN '<span class="su-styled-text secondary large"><span>+£' || CASE WHEN id % 8 = 1 THEN '<b>' || {_FEW} || '</b>' ELSE {_FEW} END || '.50 postage</span></span>' ELSE '' END"""
_BIDDING = """CASE WHEN id % 9 = 5 THEN '<span class="su-styled-text secondary">99 bids watching</span>' ELSE '' END || '<span class="su-styled-text secondary large">1,' || lpad(CAST(bids AS VARCHAR), 3, '0') || ' bids</span>'"""
_LINK = "(CASE WHEN id % 97 = 0 THEN 'https://www.example.com/shop' ELSE url END || CASE WHEN id % 3 = 1 THEN '?a=1{}b=2' ELSE '' END)"
_CARD = f"""(CASE WHEN id % 7 = 3 THEN '<!-- <span class="s-card__price">£1.00</span> -->' ELSE '' END
  || CASE WHEN id % 9 = 4 THEN '<A data-n=''1 > 0'' HREF=''' || {_LINK.format('&amp;')} || '''>' ELSE '<a href="' || {_LINK.format('&amp;')} || '">' END || '</a>'
  || CASE WHEN id % 10 = 6 THEN '<div id=t class=''wide s-card__title''>' ELSE '<div class="s-card__title">' END
  || CASE WHEN id % 3 = 0 THEN '<span>New listing</span>' ELSE '' END || '<span>' || CASE WHEN id % 10 = 1 THEN chr(10) || '  ' ELSE '' END || title || CASE WHEN id % 13 = 0 THEN ' &amp; box' ELSE '' END
  || CASE WHEN id % 11 = 2 THEN '<i></i>' ELSE '' END || CASE WHEN id % 10 = 1 THEN ' &nbsp; ' ELSE '' END || '</span></div>'
  || CASE WHEN id % 6 = 5 THEN '<br><span data-x="a > b" class=''s-card__price''>£' ELSE '<span class="s-card__price">£' END
  || coalesce(CAST(price_pence // 100 AS VARCHAR) || '.' || lpad(CAST(price_pence % 100 AS VARCHAR), 2, '0'), '') || '</span>'
  || CASE WHEN id % 5 = 2 THEN {_BIDDING} || {_POSTAGE} ELSE {_POSTAGE} || {_BIDDING} END
  || CASE WHEN id % 6 = 0 THEN '<span class="s-item__reviews-count"><span>' || CAST(id % 1000 AS VARCHAR) || ' reviews</span></span>' ELSE '' END
  || CASE WHEN id % 8 = 3 THEN '<SPAN CLASS="s-card__time-left">' ELSE '<span class="s-card__time-left">' END || CASE WHEN id % 2 = 0 THEN CAST(id % 24 AS VARCHAR) || 'h left' ELSE '' END || CASE WHEN id % 8 = 3 THEN '</SPAN>' ELSE '</span>' END
  || '<span class="s-card__time-end">'
  || CASE id % 5 WHEN 0 THEN 'Today ' || {_CLOCK} WHEN 1 THEN ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][1 + CAST(id % 7 AS INT)] || ', ' || {_CLOCK}
    WHEN 2 THEN '(' || lpad(CAST(id % 31 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') || ', ' || {_CLOCK} || ')' WHEN 3 THEN 'soon' ELSE '' END || '</span>'
  || CASE WHEN sold_date IS NOT NULL THEN '<span class="su-styled-text positive default">Sold ' || strftime(sold_date, '%-d %b %Y') || '</span>' ELSE '' END || CASE WHEN id % 19 = 7 THEN '<p>unclosed' ELSE '' END || '</div>')"""


@query("split_cards", f"""SELECT query, mode, CAST(n - 1 AS INT) AS position, md5(card || CASE WHEN n = count(*) OVER (PARTITION BY query, mode) THEN '</body></html>' ELSE '' END) AS card_md5
  FROM (SELECT query, mode, card, row_number() OVER (PARTITION BY query, mode ORDER BY card) AS n FROM (SELECT query, mode, {_CARD} AS card FROM snap))""", "snap")  # fmt: skip
def split_cards(s, d):
    return ingest.split_cards(ingest.landed_pages(adapters.raw_pages(s, d))).select("query", "mode", "position", F.md5("card").alias("card_md5"))


LISTING = f"id, title, price_pence, bids, {ts('end_time')} AS end_time, {day('sold_date')} AS sold_date, url"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "price_pence", "bids", stamp("end_time"), date("sold_date"), "url")


@query("upsert_listings", f"SELECT {LISTING} FROM listing", "listing")
def upsert_listings(s, d):
    n = adapters.snapshots(s, d)
    cut = F.col("seq.ship") < F.lit("1997-01-01").cast("timestamp")
    old = ingest.latest(n.where(cut)).select("id", *ingest.SNAPSHOT)
    return shown(ingest.upsert(old, n.where(~cut)))


def _attrs(category: str, columns: tuple[str, ...]):
    """The old table holds even ids with a brand since corrected; the batch writes every third id twice."""
    name = f"upsert_attrs_{category.lower()}"
    first, rest = columns[0], ", ".join(columns[1:])

    @query(name, f"SELECT id, CASE WHEN id % 3 = 0 THEN {first} ELSE 'stale' END AS {first}, {rest} FROM enriched WHERE category = '{category}' AND (id % 2 = 0 OR id % 3 = 0)", "enriched")
    def attrs(s, d):
        e = enriched(s, d, "category", "title", only=category).select("id", *columns)
        batch = e.where("id % 3 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
        batch = batch.withColumn(first, F.when(F.col("seq") == 2, F.col(first)).otherwise("first write"))
        return ingest.upsert(e.where("id % 2 = 0").withColumn(first, F.lit("stale")), batch)

    return attrs


for _c, _cols in (("GPU", ("brand", "model", "vram")), ("CPU", ("brand", "model", "socket", "cores")), ("HDD", ("brand", "capacity_gb", "interface", "form_factor", "rpm")), ("RAM", ("brand", "capacity_gb", "ram_type", "speed"))):
    _attrs(_c, _cols)


_OLD = "(SELECT * FROM snap WHERE id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"


@query(
    "upsert_change_kind",
    f"""SELECT n.category, CASE WHEN o.id IS NULL THEN 1 WHEN o.title IS NOT DISTINCT FROM n.title AND o.price_pence IS NOT DISTINCT FROM n.price_pence AND o.bids IS NOT DISTINCT FROM n.bids
      AND o.end_time IS NOT DISTINCT FROM n.end_time AND o.sold_date IS NOT DISTINCT FROM n.sold_date AND o.url IS NOT DISTINCT FROM n.url THEN 0 ELSE 2 END AS kind, count(*) AS rows_
      FROM listing n LEFT JOIN {_OLD} o USING (id) GROUP BY ALL""",
    "listing",
)
def upsert_change_kind(s, d):
    n = adapters.snapshots(s, d).where("id % 4 <> 0")
    old = n.groupBy("id").agg(F.min_by(F.struct(*ingest.SNAPSHOT), "seq").alias("r")).select("id", "r.*")
    return ingest.change_kind(old, listings(s, d)).groupBy("category", "kind").agg(F.count("*").alias("rows_"))


@query("record_first_sighting", "SELECT id, surfaced_pence, 0 AS fresh FROM ledger UNION ALL SELECT id, price_pence, 1 FROM deal WHERE id NOT IN (SELECT id FROM ledger)", "ledger", "deal")
def record_first_sighting(s, d):
    led, found = ledger_and_deals(s, d)
    return outcomes.record_first_sighting(led.select("id", "surfaced_pence", F.lit(0).alias("fresh")), found.select("id", F.col("price_pence").alias("surfaced_pence"), F.lit(1).alias("fresh")))


@query("anti_join_first_sighting", "SELECT id, label FROM deal WHERE id NOT IN (SELECT id FROM ledger)", "ledger", "deal")
def anti_join_first_sighting(s, d):
    led, found = ledger_and_deals(s, d)
    return found.join(led.select("id"), "id", "left_anti").select("id", "label")


@query("ledger_schema_upgrade", "SELECT id, surfaced_pence, false AS gave_up, false AS ended_unsold, CAST(NULL AS BIGINT) AS final_pence FROM ledger", "ledger")
def ledger_schema_upgrade(s, d):
    led = ledger(s, d)
    model = led.select("id", "surfaced_pence", "gave_up", "ended_unsold", "final_pence")
    return outcomes.upgrade(led.select("id", "surfaced_pence"), model, {"gave_up": False, "ended_unsold": False})


@query("run_marker", f"SELECT 1 AS id, {ts('max(ts)')} AS last_scrape_at FROM events")
def run_marker(s, d):
    return ingest.run_marker(run_log(s, d)).select("id", stamp("last_scrape_at"))


@query(
    "json_export",
    """SELECT id, CAST(to_json(struct_pack(id := id, title := title, price_pence := price_pence, bids := bids, end_time := strftime(end_time, '%Y-%m-%dT%H:%M:%S'),
      sold_date := sold_date, label := label, discount_pct := discount_pct)) AS VARCHAR) AS json FROM deal""",
    "deal",
)
def json_export(s, d):
    """Written by the JSON sink, one object a line, and read back as text."""
    iso, path = "yyyy-MM-dd'T'HH:mm:ss", f"{upserts.shared_dir(s)}/json-{uuid.uuid4().hex}"
    cols = all_deals(s, d).select("id", "title", "price_pence", "bids", F.date_format("end_time", iso).alias("end_time"), "sold_date", "label", "discount_pct")
    cols.write.option("ignoreNullFields", "false").json(path)
    return s.read.text(path).select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.col("value").alias("json"))


_CPU_TOO = "(SELECT id, model FROM enriched WHERE category = 'CPU' OR (category = 'GPU' AND id % 10 = 0))"
_SUSPECT = f"""suspect AS (SELECT e.id, CASE WHEN g.id IS NOT NULL THEN 'GPU' ELSE 'CPU' END AS category, CASE WHEN g.id IS NOT NULL THEN g.model ELSE c.model END AS model, e.title, e.price_pence, e.end_time, e.sold_date,
  CASE WHEN e.end_time > {NOW} AND e.sold_date IS NULL THEN 'active' ELSE 'ended' END AS state
  FROM listing e LEFT JOIN (SELECT id, model FROM enriched WHERE category = 'GPU') g USING (id) LEFT JOIN {_CPU_TOO} c USING (id) WHERE (g.id IS NOT NULL OR c.id IS NOT NULL) AND e.price_pence < 500000)"""


def with_suspects(select: str) -> str:
    return build("", "enriched").rstrip() + ",\n" + _SUSPECT + "\n" + select


def repair_tables(s, d) -> dict[str, DataFrame]:
    """The listings' last writes, and the models of two categories, are worked out once, as each table is read more than once."""
    li = written(s, listings(s, d, "category", "title", "price_pence", "end_time", "sold_date"), "listing")
    e = written(s, ingest.enrich(li.select("id", "category", "title").where("category in ('GPU', 'CPU')")).select("id", "category", "model"), "models")
    return {"listing": li, "gpu": e.where("category = 'GPU'").select("id", "model"), "cpu": e.where("category = 'CPU' or (category = 'GPU' and id % 10 = 0)").select("id", "model"), "ledger": adapters.ledger(li)}


def suspects(s, d, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    t = tables or repair_tables(s, d)
    return repair.suspect_prices(t["listing"], t["gpu"], t["cpu"], 500_000)


def _purge(name: str, dry: bool):
    @query(name)
    def purge(s, d):
        t = repair_tables(s, d)
        kept, counts = repair.purge(t, written(s, suspects(s, d, t), "suspects"), adapters.as_of(), dry)
        left = None
        for n, df in kept.items():
            one = df.agg(F.lit(n).alias("table_name"), F.count("*").alias("left_"))
            left = one if left is None else left.unionByName(one)
        return counts.join(left, "table_name")

    deleted = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE id IN (SELECT id FROM gone)) AS deleted, {'count(*)' if dry else 'count(*) FILTER (WHERE id NOT IN (SELECT id FROM gone))'} AS left_ FROM {t}" for n, t in (("listing", "listing"), ("gpu", "(SELECT id FROM enriched WHERE category = 'GPU')"), ("cpu", _CPU_TOO), ("ledger", "(SELECT id FROM listing WHERE id % 7 = 0)")))
    SQL[name] = build("", "enriched").rstrip() + ",\n" + _SUSPECT + ", gone AS (SELECT id FROM suspect WHERE state = 'ended')\n" + deleted
    return purge


_purge("delete_cascade", False)
_purge("purge_suspects", True)


@query("semi_join_keyset")
def semi_join_keyset(s, d):
    return listings(s, d).join(suspects(s, d).select("id"), "id", "left_semi").select("id", "price_pence")


SQL["semi_join_keyset"] = with_suspects("SELECT id, price_pence FROM listing WHERE id IN (SELECT id FROM suspect)")


# -- fields of a card ------------------------------------------------------------------------

_MIDNIGHT = f"date_trunc('day', {NOW})"
_HM = "to_hours(id % 24) + to_minutes(id % 60)"
_TODAY = f"CASE WHEN id % 5 = 0 THEN {_MIDNIGHT} + {_HM} + INTERVAL 7 HOUR END"
# 1 June 2024 is a Saturday, day 5 from Monday
_WEEK = f"CASE WHEN id % 5 = 1 THEN {_MIDNIGHT} + to_days(CAST((id % 7 - 5 + 7) % 7 AS INT)) + {_HM} + INTERVAL 7 HOUR + CASE WHEN id % 7 = 5 AND {_MIDNIGHT} + {_HM} <= {NOW} THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END END"
_ON = "try_cast(y || '-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(id % 31 + 1 AS VARCHAR), 2, '0') AS TIMESTAMP)"
_DATE = f"CASE WHEN id % 5 = 2 THEN CASE WHEN {_ON.replace('y ||', chr(39) + '2024' + chr(39) + ' ||', 1)} + {_HM} < {NOW} THEN {_ON.replace('y ||', chr(39) + '2025' + chr(39) + ' ||', 1)} ELSE {_ON.replace('y ||', chr(39) + '2024' + chr(39) + ' ||', 1)} END + {_HM} + INTERVAL 7 HOUR END"
# what the first of the secondary elements says: nothing of postage where the bids come first
_SHIPPING = "CASE WHEN id % 5 = 2 THEN 0.0::DOUBLE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN id % 9 + 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_TITLE = "title || CASE WHEN id % 13 = 0 THEN ' & box' ELSE '' END"


def _end(f):
    return F.date_format(f(F.btrim("end", F.lit(" ()")), adapters.as_of()), "yyyy-MM-dd HH:mm:ss")


CARD = {
    "parse_price": ("cost", lambda: fields.parse_price(F.col("cost")), "price_pence / 100.0::DOUBLE"),
    "parse_title": ("title", lambda: F.col("title"), _TITLE),
    "parse_shipping": ("postage", lambda: fields.parse_shipping(F.col("postage")), _SHIPPING),
    "parse_bids": ("bidding", lambda: fields.parse_count(F.col("bidding")), "CAST(1000 + bids AS INT)"),
    "parse_reviews": ("reviews", lambda: fields.parse_count(F.col("reviews")), "CAST(CASE WHEN id % 6 = 0 THEN id % 1000 ELSE 0 END AS INT)"),
    "parse_item_id": ("link", lambda: fields.parse_item_id(F.col("link")), "CASE WHEN id % 97 <> 0 THEN id END"),
    "parse_time_left": ("left", lambda: F.coalesce("left", F.lit("")), "CASE WHEN id % 2 = 0 THEN CAST(id % 24 AS VARCHAR) || 'h left' ELSE '' END"),
    "parse_sold_date": ("sale", lambda: F.date_format(fields.parse_sold_date(F.col("sale")), "yyyy-MM-dd"), day("sold_date")),
    "parse_end_time_today": ("end", lambda: _end(fields.parse_end_time_today), ts(_TODAY)),
    "parse_end_time_weekday": ("end", lambda: _end(fields.parse_end_time_weekday), ts(_WEEK)),
    "parse_end_time_date": ("end", lambda: _end(fields.parse_end_time_date), ts(_DATE)),
    "parse_end_time": ("end", lambda: _end(fields.parse_end_time), ts(f"coalesce({_TODAY}, {_WEEK}, {_DATE})")),
}


def _card_query(name, element, expr, sql):
    @query(name, f"SELECT s.id, {sql} AS value FROM snap s", "snap")
    def parse(s, d):
        """From the card's element, as the reader finds it; the file's rows are dealt to all tasks, as it may have few row groups."""
        return reader.read(adapters.cards(s, d, "id").select(F.col("id").alias("number"), "card"), (element,)).select(F.col("number").alias("id"), expr().alias("value"))


for _n, (_e, _x, _s) in CARD.items():
    _card_query(_n, _e, _x, _s)


def _one_of(table: dict[str, str], by: str) -> str:
    """The values of a table in turn, as SQL."""
    return f"{list(table.values())}[1 + CAST({by} % {len(table)} AS INT)]"


@query("search_url", f"""SELECT id, 'https://www.example' || {_one_of(fields.COUNTRIES, 'id')} || '/sch/i.html?_from=R40&_nkw=' || replace(replace(url_encode(title), '%20', '+'), '%2F', '/')
  || {_one_of(fields.MODES, 'id // 2')} || {_one_of(fields.CONDITIONS, 'id // 3')} || {_one_of(fields.TYPES, 'id // 5')} AS search FROM snap""", "snap")  # fmt: skip
def search_url(s, d):
    """Every country, mode, condition and type in turn."""

    def one_of(table, by):
        return F.get(F.array(*map(F.lit, table)), F.pmod(by, F.lit(len(table))).cast("int"))

    n = [F.expr(f"id div {k}") for k in (1, 2, 3, 5)]
    return adapters.snapshots(s, d).select("id", fields.search_url(F.col("title"), one_of(fields.COUNTRIES, n[0]), one_of(fields.CONDITIONS, n[2]), one_of(fields.TYPES, n[3]), one_of(fields.MODES, n[1])).alias("search"))


_NORMAL = f"""SELECT query, mode, id, {_TITLE} AS title, price_pence / 100.0::DOUBLE AS price, {_SHIPPING} AS shipping,
  CAST(1000 + bids AS INT) AS bid_count, {ts(f"coalesce({_TODAY}, {_WEEK}, {_DATE})")} AS time_end, {day('sold_date')} AS sold_date, {_LINK.format('&')} AS url FROM snap WHERE id % 97 <> 0 AND price_pence IS NOT NULL"""


@query("normalise_listing", _NORMAL, "snap")
def normalise_listing(s, d):
    """From pages: the latest page of each query, cut into cards, each card into a typed row."""
    c = ingest.split_cards(ingest.landed_pages(adapters.raw_pages(s, d)))
    return ingest.normalise(c, adapters.as_of()).select("query", "mode", "id", "title", "price", "shipping", "bid_count", stamp("time_end"), date("sold_date"), "url")


@query(
    "card_quarantine",
    f"""SELECT category, count(*) AS cards, CAST(0 AS BIGINT) AS no_title, count(*) FILTER (WHERE price_pence IS NULL) AS no_price, count(*) FILTER (WHERE price_pence IS NOT NULL AND id % 97 = 0) AS no_id,
      count(*) FILTER (WHERE price_pence IS NOT NULL AND id % 97 <> 0 AND id % 5 < 4 AND coalesce({_TODAY}, {_WEEK}, {_DATE}) IS NULL) AS bad_end FROM snap GROUP BY 1""",
    "snap",
)
def card_quarantine(s, d):
    """What `normalise_listing` leaves out, and end times that it can't read, by category."""
    c = ingest.split_cards(ingest.landed_pages(adapters.raw_pages(s, d))).withColumn("category", F.substring("query", 1, 3))
    return ingest.quarantine(c, adapters.as_of(), ["category"])


@query(
    "land_cards",
    f"""SELECT *, CAST(sum(rows_) OVER () AS BIGINT) AS observed FROM (SELECT lack, count(*) AS rows_, count(DISTINCT md5(card)) AS cards FROM (SELECT CASE WHEN price_pence IS NULL THEN 'price' WHEN id % 97 = 0 THEN 'id' END AS lack,
      card || CASE WHEN n = count(*) OVER (PARTITION BY query, mode) THEN '</body></html>' ELSE '' END AS card FROM (SELECT *, row_number() OVER (PARTITION BY query, mode ORDER BY card) AS n FROM (SELECT *, {_CARD} AS card FROM snap))) WHERE lack IS NOT NULL GROUP BY lack)""",
    "snap",
)
def land_cards(s, d):
    """What lies in quarantine after one pass over the pages, by lack, and how many such cards that pass observed."""
    path = f"{upserts.shared_dir(s)}/cards-{uuid.uuid4().hex}"
    c = ingest.split_cards(ingest.landed_pages(adapters.raw_pages(s, d)))
    seen = ingest.land_cards(c, path, adapters.as_of())
    out = ingest.quarantined_cards(s, path).groupBy("lack").agg(F.count("*").alias("rows_"), F.count_distinct(F.md5("card")).alias("cards"))
    return out.withColumn("observed", F.lit(seen["no_title"] + seen["no_price"] + seen["no_id"]).cast("long"))


# -- title attributes ------------------------------------------------------------------------


def _title_query(name: str, category: str, sql: str):
    @query(name, f"SELECT id, {sql} AS value FROM snap WHERE category = '{category}'", "snap")
    def extract(s, d):
        return adapters.snapshots(s, d).where(F.col("category") == category).select("id", getattr(titles, name)(F.col("title")).alias("value"))


for _n in EXPR:
    if _n != "ram_capacity_any":
        _title_query(_n, "CPU" if "cpu" in _n else _n[:3].upper() if _n[:2] != "is" else "RAM", EXPR[_n])


@query("other_category", "SELECT id, '' AS brand, '' AS model, CAST(NULL AS INT) AS vram FROM snap WHERE category = 'HDD'", "snap")
def other_category(s, d):
    n = adapters.snapshots(s, d).where("category = 'HDD'").drop("category").withColumn("category", F.lit("PSU"))
    return ingest.enrich(n).select("id", "brand", "model", "vram")


@query("enrich_all", "SELECT id, category, brand, model, vram, socket, cores, capacity_gb, interface, form_factor, rpm, ram_type, speed FROM enriched", "enriched")
def enrich_all(s, d):
    return enriched(s, d).select("id", "category", "brand", "model", "vram", "socket", "cores", "capacity_gb", "interface", "form_factor", "rpm", "ram_type", "speed")


@query("extraction_rate", "SELECT category, n, extracted, extracted >= CASE category WHEN 'GPU' THEN 0.7 WHEN 'CPU' THEN 0.6 WHEN 'HDD' THEN 0.8 ELSE 0 END * n AS ok FROM (SELECT category, count(*) AS n, CAST(sum(CASE WHEN category IN ('HDD', 'RAM') THEN capacity_gb IS NOT NULL ELSE model IS NOT NULL END) AS BIGINT) AS extracted FROM enriched GROUP BY 1)", "enriched")
def extraction_rate(s, d):
    return ingest.extraction_rate(enriched(s, d), {"GPU": 0.7, "CPU": 0.6, "HDD": 0.8})


# -- projections and filters ------------------------------------------------------------------


@query("pence_to_pounds", "SELECT id, price_pence / 100.0::DOUBLE AS price FROM listing", "listing")
def pence_to_pounds(s, d):
    return listings(s, d, "price_pence").select("id", market.pounds("price_pence").alias("price"))


@query("active_in_window", f"SELECT id, {ts('end_time')} AS end_time FROM soon", "soon")
def active_in_window(s, d):
    return market.active_in_window(market_rows(s, d), adapters.as_of()).select("id", stamp("end_time"))


_STAT_JOIN = "market m JOIN clean5 c ON m.category = c.category AND m.k1 = c.k1 AND m.k2 IS NOT DISTINCT FROM c.k2"


@query("below_threshold", f"SELECT m.id, m.price_pence, c.avg_pence FROM {_STAT_JOIN} WHERE m.price_pence * 100 < c.avg_pence * 80", "clean5")
def below_threshold(s, d):
    m = priced(s, d)
    return market.below_threshold(market.with_stats(m, market.clean_stats(m))).select("id", "price_pence", "avg_pence")


@query("potential_gain", f"SELECT m.id, (c.avg_pence - m.price_pence) / 100.0::DOUBLE AS gain FROM {_STAT_JOIN}", "clean5")
def potential_gain(s, d):
    m = priced(s, d)
    return market.with_stats(m, market.clean_stats(m)).select("id", market.pounds("(avg_pence - price_pence)").alias("gain"))


@query("discount_pct", f"SELECT m.id, sign(c.avg_pence - m.price_pence) * ((2000 * abs(c.avg_pence - m.price_pence) + c.avg_pence) // (2 * c.avg_pence)) / 10.0::DOUBLE AS discount_pct FROM {_STAT_JOIN}", "clean5")
def discount_pct(s, d):
    m = priced(s, d)
    return market.with_stats(m, market.clean_stats(m)).select("id", market.tenths("(avg_pence - price_pence)", "avg_pence").alias("discount_pct"))


_CANDIDATE = f"(SELECT m.id, m.price_pence, c.avg_pence, epoch(m.end_time) - epoch({NOW}) AS ends_in FROM {_STAT_JOIN} WHERE m.sold_date IS NULL)"


@query(
    "deal_params",
    f"""SELECT p.param_id, p.hours, p.discount, count(x.id) AS deals FROM (SELECT CAST(i AS BIGINT) AS param_id, CAST(CASE WHEN i % 5 = 4 THEN 2 ELSE greatest(1, least(24, i * 3 - 6)) END AS INT) AS hours, CAST(CASE WHEN i % 7 = 6 THEN 20 ELSE greatest(0, i * 5 - 10) END AS INT) AS discount FROM range(24) r(i)) p
      LEFT JOIN {_CANDIDATE} x ON x.ends_in > 0 AND x.ends_in < p.hours * 3600 AND x.price_pence * 100 < x.avg_pence * (100 - p.discount) GROUP BY ALL""",
    "clean5",
)
def deal_params(s, d):
    i = F.col("id").cast("int")
    p = s.range(24).select(F.col("id").alias("param_id"), F.when(i % 5 == 4, "soon").otherwise((i * 3 - 6).cast("string")).alias("window"), F.when(i % 7 == 6, "x").otherwise((i * 5 - 10).cast("string")).alias("discount"))
    m = market_rows(s, d)
    found = market.with_stats(m.where("sold_date is null"), market.clean_stats(m)).withColumn("ends_in", F.unix_seconds("end_time") - F.unix_seconds(adapters.as_of()))
    return market.threshold_sweep(found, p)


@query("deal_label", "SELECT id, label FROM deal", "deal")
def deal_label(s, d):
    return all_deals(s, d).select("id", "label")


@query("price_band_filter", "SELECT id, price_pence FROM band5", "band5")
def price_band_filter(s, d):
    m = market_rows(s, d, *PRICED)
    return market.in_band(market.with_stats(market.sold(m), market.raw_stats(m))).select("id", "price_pence")


@query("match_by_id", "SELECT l.id, w.mode, s.price, s.bids FROM ledger l CROSS JOIN (SELECT unnest(['sold', 'completed']) AS mode) w JOIN (SELECT * FROM sight QUALIFY row_number() OVER (PARTITION BY id, mode ORDER BY seq DESC, price DESC) = 1) s ON s.id = l.id AND s.mode = w.mode", "ledger", "sight")
def match_by_id(s, d):
    r = ledger(s, d).select("id", F.explode(F.array(F.lit("sold"), F.lit("completed"))).alias("mode"))
    return ingest.match_by_id(r, sightings(s, d)).select("id", "mode", "price", "bids")


# -- joins ------------------------------------------------------------------------------------


@query("join_listing_attrs", "SELECT l.id, l.price_pence, e.brand, e.model FROM listing l JOIN enriched e USING (id)", "enriched")
def join_listing_attrs(s, d):
    return listings(s, d).select("id", "price_pence").join(enriched(s, d).select("id", "brand", "model"), "id")


@query("join_model_stats", f"SELECT m.id, c.k1 AS model, c.avg_pence FROM {_STAT_JOIN} WHERE m.category IN ('GPU', 'CPU')", "clean5")
def join_model_stats(s, d):
    m = priced(s, d)
    return m.where("category in ('GPU', 'CPU')").join(market.clean_stats(m).select("category", "k1", "avg_pence"), ["category", "k1"]).select("id", F.col("k1").alias("model"), "avg_pence")


@query("join_composite_nullsafe", f"SELECT m.id, c.k1, c.k2, c.avg_pence FROM {_STAT_JOIN}", "clean5")
def join_composite_nullsafe(s, d):
    m = priced(s, d)
    return market.with_stats(m, market.clean_stats(m)).select("id", "k1", "k2", "avg_pence")


@query("join_composite_plain", f"SELECT m.id, m.ram_type, m.capacity_gb, c.avg_pence FROM {_STAT_JOIN} WHERE m.category = 'RAM'", "clean5")
def join_composite_plain(s, d):
    m = market_rows(s, d, *PRICED, only="RAM")
    return m.join(market.clean_stats(m).select("k1", "k2", "avg_pence"), ["k1", "k2"]).select("id", "ram_type", "capacity_gb", "avg_pence")


@query("join_ledger_listing", f"SELECT id, category, title, price_pence, {day('sold_date')} AS sold_date FROM led", "led")
def join_ledger_listing(s, d):
    return outcomes.with_listing(ledger(s, d), listings(s, d)).select("id", "category", "title", "price_pence", date("sold_date"))


@query("left_join_category_probe")
def left_join_category_probe(s, d):
    return suspects(s, d).select("id", "category", "model")


SQL["left_join_category_probe"] = with_suspects("SELECT id, category, model FROM suspect")


@query("update_join", f"SELECT l.id, l.gave_up OR (s.sold_date IS NULL AND l.end_time < {NOW} - INTERVAL 7 DAY) AS gave_up, CASE WHEN l.final_pence IS NULL AND NOT l.ended_unsold AND s.sold_date IS NOT NULL THEN s.price_pence ELSE l.final_pence END AS final_pence FROM ledger l JOIN listing s USING (id)", "ledger")
def update_join(s, d):
    li = listings(s, d)
    return outcomes.final_price_lock(outcomes.give_up(ledger(s, d), li, adapters.as_of()), li).select("id", "gave_up", "final_pence")


# -- aggregates -------------------------------------------------------------------------------

_STATS = "SELECT category, k1, k2, sold_count, round(mean_pence, 4) AS mean_pence, round(sd_pence, 3) AS sd_pence FROM raw5"


@query("raw_stats", _STATS, "raw5")
def raw_stats(s, d):
    return market.raw_stats(market_rows(s, d, *PRICED)).select("category", "k1", "k2", "sold_count", F.round("mean_pence", 4).alias("mean_pence"), F.round("sd_pence", 3).alias("sd_pence"))


_CLEAN = "category, k1, k2, sold_count, CAST(avg_pence AS BIGINT) AS avg_pence, min_pence, max_pence"


@query("clean_stats", f"SELECT {_CLEAN} FROM clean5", "clean5")
def clean_stats(s, d):
    return market.clean_stats(market_rows(s, d, *PRICED))


def _guide(category: str):
    @query(f"price_guide_{category.lower()}", f"SELECT {_CLEAN} FROM clean3 WHERE category = '{category}'", "clean3")
    def guide(s, d):
        m = market_rows(s, d, *PRICED, only=category)
        order = [F.desc("avg_pence"), "k1"] if category in ("GPU", "CPU") else ["k1", "k2"]
        return market.price_guide(m).orderBy(*order)


for _c in adapters.CATEGORIES:
    _guide(_c)


@query("guide_order", f"SELECT {_CLEAN} FROM clean3", "clean3")
def guide_order(s, d):
    return market.price_guide(market_rows(s, d, *PRICED)).orderBy("category", F.desc("avg_pence"), "k1", "k2")


@query("guide_all_categories", f"SELECT {_CLEAN} FROM clean3", "clean3")
def guide_all_categories(s, d):
    m, out = market_rows(s, d, *PRICED), None
    for c in adapters.CATEGORIES:
        one = market.price_guide(m.where(F.col("category") == c))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("deal_counts", "SELECT v.category, count(s.id) AS deals FROM (SELECT unnest(['GPU', 'CPU', 'HDD', 'RAM']) AS category) v LEFT JOIN (SELECT s.* FROM soon s JOIN raw5 r ON s.category = r.category AND s.k1 = r.k1 AND s.k2 IS NOT DISTINCT FROM r.k2 WHERE s.price_pence * 100.0::DOUBLE < r.mean_pence * 80) s USING (category) GROUP BY 1", "soon", "raw5")
def deal_counts(s, d):
    return market.deal_counts(market_rows(s, d, *PRICED, "end_time"), adapters.as_of(), adapters.CATEGORIES)


@query("listing_totals", f"SELECT count(*) FILTER (WHERE sold_date IS NULL) AS active, count(*) FILTER (WHERE sold_date IS NOT NULL) AS sold, (SELECT {ts('max(ts)')} FROM events) AS last_run FROM listing", "listing")
def listing_totals(s, d):
    return market.listing_totals(listings(s, d, "sold_date"), run_log(s, d)).select("active", "sold", stamp("last_run"))


@query("outcome_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE paid_pence < avg_market_pence) AS beat, (SELECT count(*) FROM led WHERE sold_date IS NULL) AS pending, CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (WHERE paid_pence < avg_market_pence) * 100.0::DOUBLE / count(*), 1) ELSE 0.0::DOUBLE END AS win_rate FROM resolved", "resolved")
def outcome_summary(s, d):
    return outcomes.summary(ledger(s, d), listings(s, d)).select("total", "beat", "pending", F.col("win_rate").cast("double").alias("win_rate"))


@query("mean_or_zero", "SELECT round(coalesce(avg(price_pence), 0.0::DOUBLE), 4) AS mean FROM listing", "listing")
def mean_or_zero(s, d):
    return ingest.mean_or_zero(listings(s, d, "price_pence"), "price_pence").select(F.round("mean", 4).alias("mean"))


@query("sample_stdev_or_zero", "SELECT query, mode, round(coalesce(stddev_samp(price_pence), 0.0::DOUBLE), 3) AS stdev FROM snap GROUP BY ALL", "snap")
def sample_stdev_or_zero(s, d):
    return ingest.sample_stdev_or_zero(adapters.snapshots(s, d), ["query", "mode"], "price_pence").select("query", "mode", F.round("stdev", 3).alias("stdev"))


def _spread(value: str) -> str:
    return f"CAST(count({value}) AS HUGEINT) AS n_, sum(CAST({value} AS HUGEINT)) AS t_, sum(CAST({value} AS HUGEINT) * {value}) AS q_"


def _inside(value: str) -> str:
    """Within a sample deviation of the mean, bounds included, in whole numbers: doubles leave a price on the bound to chance."""
    return f"(n_ * {value} - t_) * (n_ * {value} - t_) * (n_ - 1) <= n_ * (n_ * q_ - t_ * t_)"


_TRIM = f"(SELECT s.* FROM snap s JOIN (SELECT query, mode, {_spread('price_pence')} FROM snap GROUP BY ALL) t USING (query, mode) WHERE s.price_pence IS NOT NULL AND {_inside('s.price_pence')})"


def _list(value: str) -> str:
    """Each page's sorted values within a sample deviation of their mean, as text."""
    return f"""(SELECT query, mode, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS l FROM (SELECT query, mode, {value} AS v FROM snap) s JOIN
      (SELECT query, mode, {_spread(value)} FROM snap GROUP BY ALL) t USING (query, mode) WHERE v IS NOT NULL AND {_inside('v')} GROUP BY ALL)"""


_SHIP = "CAST(CASE WHEN id % 5 <> 2 AND id % 4 = 1 THEN 100 * (id % 9) + 50 ELSE 0 END AS BIGINT)"


@query("page_price_summary", f"SELECT query, mode, coalesce(p.l, '') AS price_list, coalesce(q.l, '') AS shipping_list FROM (SELECT DISTINCT query, mode FROM snap) LEFT JOIN {_list('price_pence')} p USING (query, mode) LEFT JOIN {_list(_SHIP)} q USING (query, mode)", "snap")
def page_price_summary(s, d):
    """The trimmed lists as text, which compares alike everywhere."""
    c = reader.read(adapters.cards(s, d, "id").select("query", "mode", "card"), ("cost", "postage"))
    rows = c.select("query", "mode", F.round(fields.parse_price(F.col("cost")) * 100).cast("long").alias("price_pence"), F.round(fields.parse_shipping(F.col("postage")) * 100).cast("long").alias("ship_pence"))
    text = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("price_list", "shipping_list")]
    return ingest.page_price_summary(rows, ["query", "mode"]).select("query", "mode", *text)


@query("trim_one_sigma", f"SELECT id, query, mode, price_pence FROM {_TRIM}", "snap")
def trim_one_sigma(s, d):
    return ingest.trim_one_sigma(adapters.snapshots(s, d), ["query", "mode"]).select("id", "query", "mode", "price_pence")


@query("latest_snapshot", f"SELECT {LISTING} FROM listing", "listing")
def latest_snapshot(s, d):
    return shown(listings(s, d))


def store_of(s, d) -> model.Store:
    """The listing table and its market model after three batches of snapshots."""
    n = adapters.snapshots(s, d)
    kept = model.Store(s, f"{upserts.shared_dir(s)}/store-{uuid.uuid4().hex}")
    day = F.col("seq.ship")
    for number, (lo, hi) in enumerate((("1900-01-01", "1994-01-01"), ("1994-01-01", "1996-06-01"), ("1996-06-01", "2100-01-01"))):
        kept.merge(n.where((day >= F.lit(lo).cast("timestamp")) & (day < F.lit(hi).cast("timestamp"))), number)
    return kept


@query("model_clean_stats", f"SELECT {_CLEAN} FROM clean5", "clean5")
def model_clean_stats(s, d):
    """The market model kept batch by batch, with retractions."""
    return store_of(s, d).clean_stats()


@query("listing_table", f"SELECT {LISTING}, category, sold_date IS NOT NULL AS is_sold FROM listing WHERE category = 'GPU'", "listing")
def listing_table(s, d):
    """One category's partitions of the listing table, after three batches."""
    return store_of(s, d).listing().where("category = 'GPU'").select("id", "title", "price_pence", "bids", stamp("end_time"), date("sold_date"), "url", "category", "is_sold")


_SINCE = "1995-06-01"


@query(
    "market_trend",
    f"""SELECT category, k1, k2, sales, mean_pence, slope, CASE WHEN slope IS NULL OR abs(slope * 30 / mean_pence) < 0.01 THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM
      (SELECT category, k1, k2, count(*) AS sales, round(avg(price_pence), 4) AS mean_pence, round(CASE WHEN count(DISTINCT sold_date) > 1 THEN regr_slope(price_pence, date_diff('day', DATE '{_SINCE}', sold_date)) END, 4) AS slope
       FROM sold WHERE price_pence IS NOT NULL AND sold_date > DATE '{_SINCE}' - 30 AND sold_date <= DATE '{_SINCE}' GROUP BY ALL HAVING count(*) >= 5)""",
    "sold",
)
def market_trend(s, d):
    """The 30 days before a day of the listings' time."""
    t = market.trend(market_rows(s, d, *PRICED), F.lit(_SINCE).cast("timestamp"))
    return t.select("category", "k1", "k2", "sales", F.round("mean_pence", 4).alias("mean_pence"), F.round("slope", 4).alias("slope"), "direction")


# -- deals, outcomes --------------------------------------------------------------------------

DEAL = {"GPU": "brand, model, vram", "CPU": "brand, model, socket, cores", "HDD": "brand, capacity_gb, interface, form_factor, rpm", "RAM": "brand, ram_type, capacity_gb, speed"}


def _deals(category: str, columns: str):
    @query(f"deals_{category.lower()}", f"SELECT id, title, url, bids, {ts('end_time')} AS end_time, {columns}, label, price_pence / 100.0::DOUBLE AS price, avg_pence / 100.0::DOUBLE AS avg_price, min_pence / 100.0::DOUBLE AS min_price, max_pence / 100.0::DOUBLE AS max_price, gain_pence / 100.0::DOUBLE AS potential_gain, discount_pct FROM deal WHERE category = '{category}'", "deal")
    def one(s, d):
        m = market_rows(s, d, only=category)
        p = market.pounds
        found = market.deals(m, adapters.as_of()).select("id", "title", "url", "bids", stamp("end_time"), *columns.split(", "), "label", p("price_pence").alias("price"), p("avg_pence").alias("avg_price"), p("min_pence").alias("min_price"), p("max_pence").alias("max_price"), p("gain_pence").alias("potential_gain"), "discount_pct")
        return found.orderBy(F.desc("potential_gain"), "id")


for _c, _cols in DEAL.items():
    _deals(_c, _cols)

_PCT = "sign(avg_market_pence - paid_pence) * ((2000 * abs(avg_market_pence - paid_pence) + avg_market_pence) // (2 * avg_market_pence)) / 10.0::DOUBLE"


@query("outcomes_resolved", f"SELECT id, category, paid_pence, avg_market_pence, {_PCT} AS actual_pct, {ts('surfaced_at')} AS surfaced_at FROM resolved", "resolved")
def outcomes_resolved(s, d):
    return outcomes.resolved(ledger(s, d), listings(s, d)).select("id", "category", "paid_pence", "avg_market_pence", "actual_pct", stamp("surfaced_at"))


@query("outcomes_pending", f"SELECT id, category, surfaced_pence, {ts('end_time')} AS end_time FROM led WHERE sold_date IS NULL", "led")
def outcomes_pending(s, d):
    return outcomes.pending(ledger(s, d), listings(s, d)).orderBy("end_time", "id").select("id", "category", "surfaced_pence", stamp("end_time"))


@query("suspect_order")
def suspect_order(s, d):
    return suspects(s, d).select("id", "category", "price_pence").orderBy("category", "price_pence", "id")


@query("suspect_prices")
def suspect_prices(s, d):
    return suspects(s, d).select("id", "category", "model", "title", "price_pence")


@query("suspect_split")
def suspect_split(s, d):
    return repair.suspect_split(suspects(s, d), adapters.as_of()).groupBy("category", "state").agg(F.count("*").alias("n"))


@query("suspect_minus_active")
def suspect_minus_active(s, d):
    return repair.suspect_split(suspects(s, d), adapters.as_of()).where("state = 'ended'").select("id", "price_pence")


SQL["suspect_order"] = with_suspects("SELECT id, category, price_pence FROM suspect")
SQL["suspect_prices"] = with_suspects("SELECT id, category, model, title, price_pence FROM suspect")
SQL["suspect_split"] = with_suspects("SELECT category, state, count(*) AS n FROM suspect GROUP BY ALL")
SQL["suspect_minus_active"] = with_suspects("SELECT id, price_pence FROM suspect WHERE state = 'ended'")


@query("sold_plus_active", "SELECT id, price_pence, CAST(mode = 'active' AS INT) AS mode_seq FROM snap", "snap")
def sold_plus_active(s, d):
    n = adapters.snapshots(s, d).select("id", "price_pence", "mode")
    return ingest.sold_plus_active(n.where("mode = 'sold'"), n.where("mode = 'active'")).select("id", "price_pence", "mode_seq")


# -- time-driven ------------------------------------------------------------------------------

_UPCOMING = "(SELECT id, CASE WHEN sold_date IS NULL THEN end_time + to_hours(id % 240) + to_minutes(id % 70 - 5) ELSE end_time END AS end_time, sold_date FROM led)"


def upcoming(s, d) -> DataFrame:
    """Unsold ledger rows moved to end around now."""
    led = ledger(s, d).join(listings(s, d).select("id", F.col("sold_date").alias("_s")), "id")
    end = F.timestamp_seconds(F.unix_seconds("end_time") + F.col("id") % 240 * 3600 + (F.col("id") % 70 - 5) * 60)
    return led.withColumn("end_time", F.when(F.col("_s").isNull(), end).otherwise(F.col("end_time"))).drop("_s")


def refresh_state(s, d) -> DataFrame:
    ago = F.timestamp_seconds(F.unix_seconds(adapters.as_of()) - F.col("id") % 25 * 60)
    return listings(s, d).where("id % 3 <> 0").select("id", ago.alias("last_refreshed"))


@query("active_deals", f"SELECT id, {ts('end_time')} AS end_time FROM {_UPCOMING} WHERE sold_date IS NULL AND end_time > {NOW}", "led")
def active_deals(s, d):
    return outcomes.active_deals(upcoming(s, d), listings(s, d), adapters.as_of()).select("id", stamp("end_time"))


_TIER = f"(SELECT *, CASE WHEN m <= 5 THEN 1 WHEN m <= 15 THEN 5 WHEN m <= 60 THEN 15 END AS interval_ FROM (SELECT *, (epoch(end_time) - epoch({NOW})) / 60.0 AS m FROM {_UPCOMING}) WHERE sold_date IS NULL AND m > 0 AND m <= 60)"


@query("refresh_tier", f"SELECT id, interval_ AS \"interval\" FROM {_TIER}", "led")
def refresh_tier(s, d):
    return outcomes.refresh_tier(outcomes.active_deals(upcoming(s, d), listings(s, d), adapters.as_of()), adapters.as_of()).select("id", "interval")


_DUE = f"(SELECT t.id, interval_, CASE WHEN t.id % 3 <> 0 THEN t.id % 25 END AS ago, (t.id % 3 = 0 OR t.id % 25 >= interval_) AS due FROM {_TIER} t)"


@query("refresh_due", f"SELECT id, interval_ AS \"interval\", due, {ts(f'CASE WHEN due THEN {NOW} ELSE {NOW} - to_minutes(ago) END')} AS next_refreshed FROM {_DUE}", "led")
def refresh_due(s, d):
    a = outcomes.active_deals(upcoming(s, d), listings(s, d), adapters.as_of())
    return outcomes.refresh_due(a, refresh_state(s, d), adapters.as_of()).select("id", "interval", "due", stamp("next_refreshed"))


@query("give_up", f"SELECT id, sold_date IS NULL AND end_time < {NOW} - INTERVAL 7 DAY AS gave_up FROM led", "led")
def give_up(s, d):
    return outcomes.give_up(ledger(s, d), listings(s, d), adapters.as_of()).select("id", "gave_up")


@query("verify_window", f"SELECT id, {ts('end_time')} AS end_time FROM window_", "window_")
def verify_window(s, d):
    return outcomes.verify_window(ledger(s, d), listings(s, d), adapters.as_of()).select("id", stamp("end_time"))


def _resolution(s, d) -> DataFrame:
    return outcomes.resolve(outcomes.verify_window(ledger(s, d), listings(s, d), adapters.as_of()), sightings(s, d))


@query("resolve_sold", f"SELECT id, price_pence, bids, {day('sold_date')} AS sold_date FROM status WHERE status = 'SOLD'", "status")
def resolve_sold(s, d):
    return _resolution(s, d).where("status = 'SOLD'").select("id", "price_pence", "bids", date("sold_date"))


@query("resolve_unsold", f"SELECT id, {day('sold_date')} AS sold_date, true AS ended_unsold FROM status WHERE status = 'UNSOLD'", "status")
def resolve_unsold(s, d):
    return _resolution(s, d).where("status = 'UNSOLD'").select("id", date("sold_date"), "ended_unsold")


@query("unresolved_report", "SELECT status, count(*) AS n, min(id) AS first_id FROM status GROUP BY ALL", "status")
def unresolved_report(s, d):
    return _resolution(s, d).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("final_price_lock", "SELECT l.id, CASE WHEN l.final_pence IS NULL AND NOT l.ended_unsold AND s.sold_date IS NOT NULL THEN s.price_pence ELSE l.final_pence END AS final_pence FROM ledger l JOIN listing s USING (id)", "ledger")
def final_price_lock(s, d):
    return outcomes.final_price_lock(ledger(s, d), listings(s, d)).select("id", "final_pence")


@query("targeted_refresh", f"SELECT id, title, price_pence, bids FROM (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY s.seq DESC) AS n FROM snap s JOIN {_DUE} x USING (id) WHERE x.due AND s.mode = 'active') WHERE n = 1", "led")
def targeted_refresh(s, d):
    """Due listings, refreshed from their latest active sighting."""
    a = outcomes.active_deals(upcoming(s, d), listings(s, d), adapters.as_of())
    due = outcomes.refresh_due(a, refresh_state(s, d), adapters.as_of()).where("due").select("id", F.lit("active").alias("mode"))
    return ingest.match_by_id(due, adapters.snapshots(s, d)).select("id", "title", "price_pence", "bids")


_OLDEST = "(SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"
_FRESH = f"(SELECT s.* FROM snap s JOIN {_DUE} x USING (id) WHERE x.due AND s.mode = 'active' QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY s.seq DESC) = 1)"


def refreshed(s, d) -> tuple[DataFrame, DataFrame]:
    """The listings as first seen, refreshed by the latest active sightings of those that are due."""
    n = adapters.snapshots(s, d)
    a = outcomes.active_deals(upcoming(s, d), listings(s, d), adapters.as_of())
    due = outcomes.refresh_due(a, refresh_state(s, d), adapters.as_of()).where("due").select("id")
    old = n.groupBy("id").agg(F.min_by(F.struct(*ingest.SNAPSHOT), "seq").alias("r")).select("id", "r.*")
    return ingest.targeted_refresh(due, n, old)


@query("targeted_refresh_upsert", f"SELECT {LISTING} FROM {_FRESH} UNION ALL SELECT {LISTING} FROM {_OLDEST} WHERE id NOT IN (SELECT id FROM {_FRESH})", "led")
def targeted_refresh_upsert(s, d):
    return shown(refreshed(s, d)[0])


@query(
    "targeted_refresh_totals",
    f"""SELECT (SELECT count(*) FROM {_DUE} WHERE due) AS due, count(*) AS found, CAST(0 AS BIGINT) AS inserted, count(*) FILTER (WHERE NOT same) AS updated, count(*) FILTER (WHERE same) AS unchanged FROM
      (SELECT n.title = o.title AND n.price_pence IS NOT DISTINCT FROM o.price_pence AND n.bids = o.bids AND n.end_time = o.end_time AND n.sold_date IS NOT DISTINCT FROM o.sold_date AS same FROM {_FRESH} n JOIN {_OLDEST} o USING (id))""",
    "led",
)
def targeted_refresh_totals(s, d):
    return refreshed(s, d)[1]


@query(
    "stream_verify",
    """WITH d AS (SELECT event_id AS deal, user_id * 8 + event_id % 8 AS id, ts + INTERVAL 12 HOUR AS end_time FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL),
  p AS (SELECT user_id * 8 + event_id % 8 AS id, event_id AS seq, value AS price, event_id % 30 AS bids, ts, event_type = 'purchase' AS sold FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND (event_type = 'click' OR (event_type = 'purchase' AND event_id % 4 <> 0))),
  w AS (SELECT least((SELECT max(ts) FROM p) - INTERVAL 1 DAY, (SELECT max(end_time) FROM d) - INTERVAL 2 DAY) AS mark),
  j AS (SELECT d.*, p.seq, p.price, p.bids, p.ts, p.sold FROM d LEFT JOIN p ON p.id = d.id AND p.ts > end_time + INTERVAL 6 HOUR AND p.ts < end_time + INTERVAL 7 DAY),
  r AS (SELECT deal, id, end_time, max_by(struct_pack(ts := ts, price := price, bids := bids), seq) FILTER (WHERE sold) AS s, count(*) FILTER (WHERE NOT sold) AS c, count(seq) AS pages FROM j GROUP BY ALL)
  SELECT deal, id, CASE WHEN s IS NOT NULL THEN 'SOLD' WHEN c > 0 THEN 'UNSOLD' ELSE 'PENDING' END AS status, strftime(CASE WHEN s IS NOT NULL THEN s.ts WHEN c > 0 THEN end_time END, '%Y-%m-%d') AS sold_date,
    CAST(trunc(s.price * 100) AS BIGINT) AS price_pence, CAST(s.bids AS INT) AS bids, s IS NULL AND c > 0 AS ended_unsold FROM r, w WHERE pages > 0 OR end_time + INTERVAL 7 DAY <= mark""",
)
def stream_verify(s, d):
    return verify.run(s, d).select("deal", "id", "status", date("sold_date"), "price_pence", "bids", "ended_unsold")


@query("stream_first_sighting", "SELECT user_id * 16 + event_id % 16 AS id, value, event_id AS at FROM events WHERE user_id IS NOT NULL AND event_type <> 'error' AND (user_id * 16 + event_id % 16) % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id * 16 + event_id % 16 ORDER BY event_id) = 1")
def stream_first_sighting(s, d):
    return ledger_stream.run(s, d)


@query("stream_upsert", "SELECT user_id AS id, round(value, 6) AS price, CASE event_type WHEN 'purchase' THEN 'sold' ELSE 'active' END AS mode, event_id AS seq FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert(s, d):
    return upserts.run(s, d).select("id", F.round("price", 6).alias("price"), "mode", "seq")


@query(
    "stream_refresh_due",
    """WITH RECURSIVE t AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS ms, (epoch_us(ts) // 1000 // 3600000 + 1) * 3600000 - epoch_us(ts) // 1000 AS left_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  i AS (SELECT *, CASE WHEN left_ms <= 300000 THEN 1 WHEN left_ms <= 900000 THEN 5 ELSE 15 END AS minutes FROM t),
  r AS (SELECT id, seq, n, minutes, true AS due, ms AS last_ms FROM i WHERE n = 1
    UNION ALL SELECT i.id, i.seq, i.n, i.minutes, i.ms - r.last_ms >= i.minutes * 60000, CASE WHEN i.ms - r.last_ms >= i.minutes * 60000 THEN i.ms ELSE r.last_ms END FROM r JOIN i ON i.id = r.id AND i.n = r.n + 1)
  SELECT id, seq, minutes FROM r WHERE due""",
)
def stream_refresh_due(s, d):
    return refresh.run(s, d)


_DEALS = """e AS (SELECT user_id * 16 + event_id % 16 AS id, CASE WHEN event_type = 'purchase' THEN 'sold' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'completed' ELSE 'active' END AS mode, event_id AS seq, epoch_us(ts) // 1000 AS ms,
    epoch_ms(TIMESTAMP '2024-01-01') + (user_id * 16 + event_id % 16) * 37 % 720 * 3600000 + 604800000 AS over FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  f AS (SELECT id, CASE WHEN count(*) FILTER (WHERE mode = 'sold') > 0 THEN 'SOLD' WHEN count(*) FILTER (WHERE mode = 'completed') > 0 THEN 'UNSOLD' WHEN over < (SELECT max(ms) - 86400000 FROM e) THEN 'GAVE_UP' ELSE 'PENDING' END AS status,
    min(seq) FILTER (WHERE mode = 'sold') AS sale FROM e WHERE ms < over GROUP BY id, over)"""


@query("stream_deal_lifecycle", f"WITH {_DEALS} SELECT id, status, sale FROM f")
def stream_deal_lifecycle(s, d):
    return lifecycle.run(s, d)[0]


@query("stream_deal_outcomes", f"WITH {_DEALS} SELECT status, count(*) AS deals, min(id) AS first_id FROM f GROUP BY 1 UNION ALL SELECT 'LATE', count(*), min(id) FROM e WHERE ms >= over HAVING count(*) > 0")
def stream_deal_outcomes(s, d):
    """Deals by their last state, and how many sightings came a week or more after the deal's end."""
    last, late = lifecycle.run(s, d)
    rows = last.select("id", "status").unionByName(late.select("id", F.lit("LATE").alias("status")))
    return rows.groupBy("status").agg(F.count("*").alias("deals"), F.min("id").alias("first_id"))


_RUN = f"""WITH seen AS (SELECT s.id, s.category, s.title, s.price_pence, s.sold_date, s.mode, s.query, k.n FROM snap s JOIN
  (SELECT id, query, mode, seq, row_number() OVER (PARTITION BY query, mode ORDER BY {_CARD}) AS n FROM snap) k USING (id, query, mode, seq) WHERE id % 97 <> 0 AND price_pence IS NOT NULL),
kept AS (SELECT s.* FROM seen s JOIN (SELECT query, mode, {_spread('price_pence')} FROM seen GROUP BY ALL) t USING (query, mode) WHERE {_inside('price_pence')}),
last_ AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY mode = 'active' DESC, query DESC, n DESC) = 1)
"""


def _run_of(landed: DataFrame, only: str | None = None) -> DataFrame:
    """The latest pages to market products, of one category or all. Cards are read once, to typed rows, which are narrow."""
    rows = ingest.normalise(ingest.split_cards(landed), adapters.as_of()).select("query", "mode", "position", "id", "title", "sold_date", F.substring("query", 1, 3).alias("category"), F.round(F.col("price") * 100).cast("long").alias("price_pence"))
    kept = ingest.trim_one_sigma(written(landed.sparkSession, rows, "rows", "mode"), ["query", "mode"])
    both = ingest.sold_plus_active(kept.where("mode = 'sold'"), kept.where("mode = 'active'")).select("id", "category", "title", "price_pence", "sold_date", F.struct("mode_seq", "query", "position").alias("seq"))
    m = market.market_listing(ingest.enrich(ingest.latest(both), only))
    return m.groupBy("category", "k1", "k2").agg(F.count("*").alias("listings"), F.count_if(F.col("sold_date").isNotNull()).alias("sold"), F.sum("price_pence").alias("total_pence"))


@query("full_run")
def full_run(s, d):
    """Pages to market in one job for all categories; rows that can't be read don't stop it (`card_quarantine`
    counts them)."""
    return _run_of(ingest.landed_pages(adapters.raw_pages(s, d)))


def isolated(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, log, marker) of a run of one job a category over the latest pages, landed by category."""
    base, run = f"{upserts.shared_dir(s)}/runs-{uuid.uuid4().hex}", "1"
    schema = "query string, mode string, fetched_at timestamp, html string, category string"
    ingest.landed_pages(adapters.raw_pages(s, d)).withColumn("category", F.substring("query", 1, 3)).write.partitionBy("category").parquet(f"{base}/pages")
    pages = s.read.schema(schema).parquet(f"{base}/pages")
    log = runs.run_all(s, base, run, adapters.CATEGORIES, lambda c: _run_of(pages.where(F.col("category") == c).drop("category"), c).drop("category"))
    return runs.results(s, base, run, "k1 string, k2 string, listings long, sold long, total_pence long"), log, runs.marker(s, base)


_PRODUCTS = "SELECT category, k1, k2, count(*) AS listings, count(*) FILTER (WHERE sold_date IS NOT NULL) AS sold, CAST(sum(price_pence) AS BIGINT) AS total_pence FROM market GROUP BY ALL"
_OF_RUN = _RUN.strip().removeprefix("WITH ") + ",\nlisting AS (SELECT * FROM last_)"
SQL["full_run"] = build(_PRODUCTS, "market", listing=_OF_RUN)


def _each(category: str) -> str:
    """The last sightings of the run among one category's pages."""
    return f"(SELECT * FROM kept WHERE left(query, 3) = '{category}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY mode = 'active' DESC, query DESC, n DESC) = 1)"


_BY_CATEGORY = _OF_RUN.replace("listing AS (SELECT * FROM last_)", "listing AS (" + " UNION ALL ".join(f"SELECT * FROM {_each(c)}" for c in adapters.CATEGORIES) + ")")


@query("full_run_isolated")
def full_run_isolated(s, d):
    """The products of each category, by jobs of their own."""
    return isolated(s, d)[0].select("category", "k1", "k2", "listings", "sold", "total_pence")


SQL["full_run_isolated"] = build(_PRODUCTS, "market", listing=_BY_CATEGORY)


@query("run_totals", build("SELECT category, 1 AS attempts, true AS ok, count(*) AS products, CAST(sum(listings) AS BIGINT) AS listings, true AS marked FROM (" + _PRODUCTS + ") GROUP BY 1", "market", listing=_BY_CATEGORY))
def run_totals(s, d):
    """How each category's job went, with what it gave, and whether the marker stands after all of them."""
    found, log, marker = isolated(s, d)
    ended = marker.join(log.agg(F.max("ended").alias("last")), how="cross").select((F.col("last_scrape_at") >= F.col("last")).alias("marked"))  # one row each
    tries = log.groupBy("category").agg(F.count("*").cast("int").alias("attempts"), F.bool_or("ok").alias("ok"))
    given = found.groupBy("category").agg(F.count("*").alias("products"), F.sum("listings").alias("listings"))
    return tries.join(given, "category", "left").join(F.broadcast(ended), how="cross").select("category", "attempts", "ok", "products", "listings", "marked")  # a row a category, one marker


# -- presentation -----------------------------------------------------------------------------


@query("deal_filter", "SELECT id, brand, discount_pct FROM deal WHERE brand IN ('Asus', 'Intel', 'Seagate', 'Corsair') AND discount_pct >= 30 AND gain_pence >= 50000", "deal")
def deal_filter(s, d):
    return all_deals(s, d).where(F.col("brand").isin("Asus", "Intel", "Seagate", "Corsair") & (F.col("discount_pct") >= 30) & (F.col("gain_pence") >= 50_000)).select("id", "brand", "discount_pct")


@query("deal_score", f"SELECT id, round(discount_pct / ((epoch(end_time) - epoch({NOW})) / 3600.0::DOUBLE) / greatest(bids, 1), 6) AS score FROM deal", "deal")
def deal_score(s, d):
    return market.deal_score(all_deals(s, d), adapters.as_of()).select("id", F.round("score", 6).alias("score"))


@query("few_bids", "SELECT id, bids FROM deal WHERE bids < 5", "deal")
def few_bids(s, d):
    return market.few_bids(all_deals(s, d)).select("id", "bids")


@query("coming_up", f"SELECT id, {ts('end_time')} AS end_time FROM market WHERE sold_date IS NULL AND end_time > {NOW} + INTERVAL 2 HOUR AND end_time < {NOW} + INTERVAL 6 HOUR", "market")
def coming_up(s, d):
    return market.active_in_window(market_rows(s, d), adapters.as_of(), 6, 2).select("id", stamp("end_time"))


@query("urgency", f"SELECT id, CAST(epoch(end_time) - epoch({NOW}) AS BIGINT) AS seconds_left, epoch(end_time) - epoch({NOW}) < 300 AS urgent FROM soon", "soon")
def urgency(s, d):
    left = F.unix_seconds("end_time") - F.unix_seconds(adapters.as_of())
    return market.active_in_window(market_rows(s, d), adapters.as_of()).select("id", left.alias("seconds_left"), (left < 300).alias("urgent"))


@query("saving_vs_market", "SELECT id, (final_pence - avg_market_pence) / 100.0::DOUBLE AS saving FROM led WHERE final_pence IS NOT NULL", "led")
def saving_vs_market(s, d):
    return ledger(s, d).where("final_pence is not null").select("id", market.pounds("(final_pence - avg_market_pence)").alias("saving"))


@query("hide_unsold", "SELECT id, paid_pence FROM resolved WHERE NOT ended_unsold", "resolved")
def hide_unsold(s, d):
    return outcomes.resolved(ledger(s, d), listings(s, d)).where(~F.col("ended_unsold")).select("id", "paid_pence")


@query("basket_value", "SELECT count(*) AS parts, CAST(sum(avg_pence * n) AS BIGINT) AS total_pence FROM clean3 JOIN (SELECT category, k1, k2, count(*) AS n FROM deal GROUP BY ALL) b ON clean3.category = b.category AND clean3.k1 = b.k1 AND clean3.k2 IS NOT DISTINCT FROM b.k2", "clean3", "deal")
def basket_value(s, d):
    """The market value of a basket: one of each product for each of its current deals."""
    li = written(s, listings(s, d), "listing")
    basket = all_deals(s, d, li).groupBy(*market.KEYS).agg(F.count("*").alias("wanted"))
    guide = market.price_guide(market.market_listing(ingest.enrich(li.select("id", *PRICED)))).select(*market.KEYS, "avg_pence")
    return market.with_stats(basket, guide).agg(F.count("*").alias("parts"), F.sum(F.col("avg_pence") * F.col("wanted")).alias("total_pence"))


@query("price_spread", "SELECT category, k1, k2, (max_pence - min_pence) / 100.0::DOUBLE AS spread FROM clean3", "clean3")
def price_spread(s, d):
    return market.price_guide(market_rows(s, d, *PRICED)).select("category", "k1", "k2", market.pounds("(max_pence - min_pence)").alias("spread"))


@query("sort_any", "SELECT id, bids, discount_pct FROM deal", "deal")
def sort_any(s, d):
    return market.sort_any(all_deals(s, d).select("id", "bids", "discount_pct"), "discount_pct", False, ("bids", "discount_pct"))


@query("guide_search", "SELECT category, k1, k2, CAST(avg_pence AS BIGINT) AS avg_pence FROM clean3 WHERE contains(lower(category || ' ' || k1 || ' ' || coalesce(k2, '')), 'rtx')", "clean3")
def guide_search(s, d):
    label = F.lower(F.concat_ws(" ", "category", "k1", "k2"))
    return market.price_guide(market_rows(s, d, *PRICED)).where(label.contains("rtx")).select("category", "k1", "k2", "avg_pence")


@query("outcome_verdict", "SELECT id, CASE WHEN paid_pence < avg_market_pence THEN 'DEAL' ELSE 'MISS' END AS verdict FROM resolved", "resolved")
def outcome_verdict(s, d):
    return outcomes.resolved(ledger(s, d), listings(s, d)).select("id", F.when(F.col("paid_pence") < F.col("avg_market_pence"), "DEAL").otherwise("MISS").alias("verdict"))

