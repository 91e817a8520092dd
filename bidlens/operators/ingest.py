"""Pages to listings: landing, quality gate, cards, upsert, change report, cascade delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields, titles
from ..sources import cards as reader

MARKER = '<div class="su-card-container su-card-container--horizontal">'
SNAPSHOT = ("title", "price_pence", "bids", "end_time", "sold_date", "url")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def landed_pages(pages: DataFrame) -> DataFrame:
    """The latest page of each (query, mode)."""
    return pages.groupBy("query", "mode").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("html", "fetched_at").alias("html"))


def land_pages(pages: DataFrame, path: str, landed: DataFrame | None = None) -> None:
    """Appends the pages (query, mode, fetched_at, html) that `landed`, the folder's own rows, lacks; one
    folder for each mode. A run that is repeated appends nothing."""
    key = ["query", "mode", "fetched_at"]
    new = pages.dropDuplicates(key)
    new = new.join(landed.select(*key), key, "left_anti") if landed is not None else new
    new.select("query", "fetched_at", "html", "mode").write.mode("append").option("compression", "zstd").partitionBy("mode").parquet(path)


def to_fetch(requests: DataFrame, landed: DataFrame) -> DataFrame:
    """The (query, mode) requests that no landed page answers; the others reuse theirs."""
    return requests.join(landed.select("query", "mode").distinct(), ["query", "mode"], "left_anti")


def quality_gate(pages: DataFrame, min_chars: int = 50_000) -> DataFrame:
    """accepted: false for block pages, which go to quarantine."""
    return pages.withColumn("chars", F.length("html")).withColumn("accepted", F.coalesce(F.length("html") >= min_chars, F.lit(False)))


def split_cards(pages: DataFrame, skip_first: int = 1) -> DataFrame:
    """One row a card, in page order; the first card of a page is a placeholder."""
    parts = F.posexplode(F.split("html", F.lit("\\Q" + MARKER + "\\E"), -1))
    return pages.select("query", "mode", parts.alias("n", "card")).where(F.col("n") > skip_first).select("query", "mode", (F.col("n") - skip_first - 1).alias("position"), "card")


def typed(cards: DataFrame, ref, hours: float = fields.OFFSET_HOURS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a card, typed. lack: the first of title, price and id that can't be read, for which the card is left out; bad_end: a card
    that is kept has an end time that can't be read, which is null then."""
    rest = [F.col(c) for c in cards.columns if c in ("query", "mode", "position", "category", *keep)]
    c = {n: F.col(n) for n in reader.ELEMENTS}
    rows = reader.read(cards.select(*rest, "card")).select(
        *rest,
        fields.parse_item_id(c["link"]).alias("id"),
        c["title"],
        fields.parse_price(c["cost"]).alias("price"),
        fields.parse_shipping(c["postage"]).alias("shipping"),
        F.coalesce(c["left"], F.lit("")).alias("time_left"),
        fields.parse_end_time(c["end"], ref, hours).alias("time_end"),
        fields.parse_sold_date(c["sale"]).alias("sold_date"),
        fields.parse_count(c["bidding"]).alias("bid_count"),
        fields.parse_count(c["reviews"]).alias("reviews_count"),
        c["link"].alias("url"),
        (F.coalesce(c["end"], F.lit("")) != "").alias("has_end"),
    )
    lack = F.when(F.col("title").isNull(), "title").when(F.col("price").isNull(), "price").when(F.col("id").isNull(), "id")
    rows = rows.withColumn("lack", lack)
    return rows.withColumn("bad_end", F.col("lack").isNull() & F.col("has_end") & F.col("time_end").isNull()).drop("has_end")


def normalise(cards: DataFrame, ref, hours: float = fields.OFFSET_HOURS) -> DataFrame:
    """Typed rows; cards without an id, a title or a readable price are left out (see `quarantine`)."""
    return typed(cards, ref, hours).where("lack is null").drop("lack", "bad_end")


def quality() -> list:
    """How many cards there are, are left out and why, and how many of those kept have an end time that can't be read."""
    reasons = [F.count_if(F.coalesce(F.col("lack") == r, F.lit(False))).alias(f"no_{r}") for r in ("title", "price", "id")]
    return [F.count(F.lit(1)).alias("cards"), *reasons, F.count_if("bad_end").alias("bad_end")]


def quarantine(cards: DataFrame, ref, by: list[str], hours: float = fields.OFFSET_HOURS) -> DataFrame:
    """The counts of `quality` by some columns."""
    return typed(cards, ref, hours).groupBy(*by).agg(*quality())


def land_cards(cards: DataFrame, path: str, ref, hours: float = fields.OFFSET_HOURS) -> dict[str, int]:
    """Writes every card to folder `path` in one pass over them: those kept as typed rows under `kept=true`, those left out with their markup and their
    lack under `kept=false`, the quarantine. Returns the counts of `quality`, observed in that pass: nothing is read twice."""
    seen = Observation("cards")
    kept = F.col("lack").isNull()
    rows = typed(cards.withColumn("markup", F.col("card")), ref, hours, keep=("markup",)).observe(seen, *quality())
    rows = rows.withColumn("markup", F.when(~kept, F.col("markup"))).withColumn("kept", kept)
    rows.write.mode("overwrite").partitionBy("kept").parquet(path)
    return seen.get


def kept_cards(spark: SparkSession, path: str) -> DataFrame:
    """The typed rows that `land_cards` has kept; the quarantine isn't read."""
    return spark.read.parquet(path).where("cast(kept as boolean)").drop("kept", "lack", "markup", "bad_end")


def quarantined_cards(spark: SparkSession, path: str) -> DataFrame:
    """The cards that were left out, as they were, and why; they can be read again once a rule is mended."""
    rows = spark.read.parquet(path).where("not cast(kept as boolean)")
    return rows.select(*[c for c in ("query", "mode", "position", "category") if c in rows.columns], "lack", F.col("markup").alias("card"))


def enrich(listings: DataFrame, only: str | None = None) -> DataFrame:
    """listings with their titles' attributes, less those that the rules drop; of one category alone if named, for which alone the work is done."""
    listings = listings if only is None else listings.where(F.col("category") == only)
    a = titles.attributes(F.col("category"), F.col("title"), only)
    return listings.select("*", *[c.alias(n) for n, c in a.items()]).where(~F.col("dropped")).drop("dropped")


def _spread(c: str, prefix: str, integral: bool) -> list:
    """Aggregates that `_within` needs of a column: moments, and for whole numbers exact count and sums."""
    d = F.col(c).cast("decimal(19,0)") if integral else F.lit(None).cast("decimal(19,0)")
    exact = [F.count(c).alias(f"{prefix}n"), F.try_sum(d).alias(f"{prefix}t"), F.try_sum(d * d).alias(f"{prefix}q")]
    return [*exact, F.avg(c).alias(f"{prefix}m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{prefix}s"), F.min(c).alias(f"{prefix}lo"), F.max(c).alias(f"{prefix}hi")]


def _within(x, prefix: str):
    """Whether x lies within a sample deviation of the mean, bounds included: (n x - t)^2 (n - 1) <= n (n q - t^2) for the sum t and the sum
    of squares q, so that a price on the bound is never left to rounding. In doubles for fractions, and for sums that no decimal holds."""
    n, t, q, m, s = (F.col(f"{prefix}{k}") for k in "ntqms")
    n = n.cast("decimal(19,0)")
    off = F.try_subtract(F.try_multiply(n, x.cast("decimal(19,0)")), t)
    exact = F.try_multiply(F.try_multiply(off, off), n - 1) <= F.try_multiply(n, F.try_subtract(F.try_multiply(n, q), F.try_multiply(t, t)))
    return F.coalesce(exact, (F.col(f"{prefix}lo") == F.col(f"{prefix}hi")) | x.between(m - s, m + s))


def _whole(rows: DataFrame, c: str) -> bool:
    return rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")


def trim_one_sigma(rows: DataFrame, page: list[str], price: str = "price_pence") -> DataFrame:
    """Rows whose price lies within a sample deviation of its page's mean, bounds included; pages of one
    price or one row pass. The page's statistics are aggregated and joined back, so a large page costs
    one partial row a task, not a sort."""
    spread = _spread(price, "_", _whole(rows, price))
    s = rows.where(F.col(price).isNotNull()).groupBy(*page).agg(*spread)
    return rows.join(s, page).where(F.col(price).isNotNull() & _within(F.col(price), "_")).drop("_n", "_t", "_q", "_m", "_s", "_lo", "_hi")


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Last write of each key. An aggregate: repeats collapse before the shuffle. All columns of rows travel: select
    those needed before."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def upsert(target: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """target with batch's rows inserted or written over it; batch may repeat keys (last `seq` wins)."""
    new = latest(batch.select("seq", *target.columns), key).select(*target.columns)
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(key, "r.*")


def change_kind(old: DataFrame, new: DataFrame, columns=SNAPSHOT, key: str = "id") -> DataFrame:
    """1 inserted, 2 updated, 0 unchanged, for each row of new."""
    o = old.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    kind = F.when(F.col("_key").isNull(), 1).when(same, 0).otherwise(2)
    return new.join(o, F.col(key) == F.col("_key"), "left").withColumn("kind", kind).drop("_key", "_old")


def sold_plus_active(sold: DataFrame, active: DataFrame) -> DataFrame:
    """Bag union; mode_seq makes an active sighting win over a sold one of the same run."""
    return sold.withColumn("mode_seq", F.lit(0)).unionByName(active.withColumn("mode_seq", F.lit(1)))


def run_marker(run_log: DataFrame) -> DataFrame:
    return run_log.agg(F.lit(1).alias("id"), F.max("finished_at").alias("last_scrape_at"))


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the keyed rows, and the count of deleted rows a table."""
    k = keys.select(F.col(key).alias("_k")).distinct()
    kept = {n: t.join(k, F.col(key) == F.col("_k"), "left_anti") for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        one = t.join(k, F.col(key) == F.col("_k"), "left_semi").agg(F.lit(n).alias("table_name"), F.count("*").alias("deleted"))
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def extraction_rate(rows: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Share of rows whose model (or capacity) was extracted, by category, against a floor."""
    got = F.when(F.col("category").isin("HDD", "RAM"), F.col("capacity_gb").isNotNull()).otherwise(F.col("model").isNotNull())
    floor = F.lit(0.0)
    for c, v in floors.items():
        floor = F.when(F.col("category") == c, v).otherwise(floor)
    out = rows.groupBy("category").agg(F.count("*").alias("n"), F.sum(got.cast("long")).alias("extracted"))
    return out.withColumn("ok", F.col("extracted") >= floor * F.col("n"))


def mean_or_zero(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"))


def sample_stdev_or_zero(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("stdev"))


def page_price_summary(rows: DataFrame, page: list[str]) -> DataFrame:
    """price_list and shipping_list of each page, sorted: its prices, and its postages (unread ones are 0), each
    without those over a sample deviation from their own mean. One shuffle; a page is some thousand cards at most."""
    r = rows.withColumn("ship_pence", F.coalesce("ship_pence", F.lit(0).cast("long")))

    def stats(c: str):
        return [F.collect_list(c).alias(c), *_spread(c, f"{c}_", _whole(r, c))]

    def trimmed(c: str):
        return F.array_sort(F.filter(c, lambda x: _within(x, f"{c}_")))

    return r.groupBy(*page).agg(*stats("price_pence"), *stats("ship_pence")).select(*page, trimmed("price_pence").alias("price_list"), trimmed("ship_pence").alias("shipping_list"))


def targeted_refresh(due: DataFrame, rows: DataFrame, listing: DataFrame, columns: tuple[str, ...] = SNAPSHOT) -> tuple[DataFrame, DataFrame]:
    """(listing, totals) after the due ids are looked up among the active sightings `rows` (mode, seq and the listing's columns) and the latest one of each is upserted.
    totals, one row: due, found, inserted, updated, unchanged. Those not found keep their rows: they may have ended."""
    asked = due.select("id", F.lit("active").alias("mode"))
    found = match_by_id(asked, rows.select("id", "mode", "seq", *columns)).select("id", "seq", *columns)
    kinds = change_kind(listing, found, columns).agg(F.count("*").alias("found"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in ((1, "inserted"), (2, "updated"), (0, "unchanged"))])
    totals = due.agg(F.count("*").alias("due")).join(kinds, how="cross")  # one row each
    return upsert(listing.select("id", *columns), found), totals


def match_by_id(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest sighting for each requested (id, mode)."""
    w = Window.partitionBy("id", "mode").orderBy(F.desc("seq"))
    return requests.join(rows, ["id", "mode"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
