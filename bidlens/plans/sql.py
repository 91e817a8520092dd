"""DuckDB SQL for the named queries, built on shared CTEs. Independent of the Spark expressions, patterns
included, but for the fixed word lists."""

from __future__ import annotations

from ..functions import titles as T
from ..sources.adapters import AS_OF, CATEGORIES, HUGE, TITLES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(x: str, pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {lit(w)}) THEN {lit(v) if isinstance(v, str) else v}" for w, v in pairs) + f" ELSE {default} END"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def ex(pattern: str, group: int = 1, flags: str = "i", x: str = "title") -> str:
    return f"nullif(regexp_extract({x}, {lit(pattern)}, {group}, '{flags}'), '')"


NOW = f"TIMESTAMP '{AS_OF}'"
_LISTS = "[" + ", ".join("[" + ", ".join(lit(t) for t in TITLES[c]) + "]" for c in CATEGORIES) + "]"

# written from the rules, not from the Spark side's patterns
CARD = r"(rtx|gtx|titan|rx)[ \t]*([0-9]{2,4})[ \t]*(ti|super|xt)?"
RYZEN = r"ryzen[ \t]*(?:threadripper[ \t]*(?:pro[ \t]*)?)?r?([0-9]+)[ \t]+([0-9]+[a-z0-9]*)"
CORE_I = r"i([3579])[ \t-](?:cpu[ \t]+)?([0-9]{3,5}[a-z0-9]*)"
SIZE = r"([0-9]+(?:\.[0-9]+)?)[ \t]*(tb|gb)"
KIT = r"([0-9]+)[ \t]*(?:X|×)[ \t]*([0-9]+)[ \t]*GB"


def number(pattern: str, group: int = 1, flags: str = "i", x: str = "title") -> str:
    return f"CAST({ex(pattern, group, flags, x)} AS DOUBLE)"


def whole(x: str) -> str:
    return f"TRY_CAST(trunc({x}) AS INT)"


EXPR = {
    "gpu_model": f"nullif(trim(upper(coalesce({ex(CARD, 1)}, '')) || ' ' || coalesce({ex(CARD, 2)}, '') || ' ' || upper(coalesce({ex(CARD, 3)}, ''))), '')",
    "gpu_vram": f"CAST({ex('([0-9]{1,2})[ ]*gb')} AS INT)",
    "gpu_brand": case("upper(title)", T.GPU_BRANDS, f"CASE WHEN {any_of('upper(title)', T.AMD_MARKS)} THEN 'AMD' ELSE 'NVIDIA' END"),
    "is_full_system_cpu": f"({any_of('lower(title)', T.SYSTEM_WORDS)} OR (regexp_matches(lower(title), '[0-9]+ *gb *(ddr[0-9]?|ram)') AND regexp_matches(lower(title), '[0-9]+ *[tg]b *(ssd|nvme|hdd|m[.]2)')))",
    "cpu_brand": case("upper(title)", (("AMD", "AMD"), ("INTEL", "Intel")), "''"),
    "cpu_model": f"coalesce('Ryzen ' || {ex(RYZEN, 1)} || ' ' || upper({ex(RYZEN, 2)}), 'i' || {ex(CORE_I, 1)} || '-' || upper({ex(CORE_I, 2)}))",
    "cpu_socket": f"upper(replace({ex('(lga *[0-9]{3,4}|am *[2-5]|fm[12]|trx?[0-9]+)')}, ' ', ''))",
    "cpu_cores": f"coalesce(TRY_CAST({ex('([0-9]+) *[Cc]ore', 1, 'c')} AS INT), {case('lower(title)', T.CORE_NAMES)})",
    "hdd_brand": f"CASE WHEN contains(upper(title), 'WESTERN DIGITAL') OR starts_with(upper(title), 'WD ') OR contains(upper(title), ' WD ') THEN 'Western Digital' ELSE {case('upper(title)', T.HDD_BRANDS, chr(39) * 2)} END",
    "hdd_capacity_gb": whole(f"{number(SIZE)} * CASE WHEN upper({ex(SIZE, 2)}) = 'TB' THEN 1000 ELSE 1 END"),
    "hdd_interface": "CASE WHEN contains(upper(title), 'SAS') THEN 'SAS' ELSE 'SATA' END",
    "hdd_form_factor": f"coalesce({ex('([23][.]5)')}, '3.5') || '\"'",
    "hdd_rpm": f"coalesce(CAST({ex('([0-9]{4,5}) *rpm')} AS INT), {whole(number('([0-9]+(?:[.][0-9]+)?) *k(?: *rpm|' + chr(92) + 'b)') + ' * 1000')})",
    "is_full_system_ram": any_of("lower(title)", T.SYSTEM_WORDS),
    "ram_type": rf"upper({ex(r'\b(ddr[3-5])\b')})",
    "ram_capacity_any": f"coalesce({number(KIT, 1, 'c', 'upper(title)')} * {number(KIT, 2, 'c', 'upper(title)')}, list_max(list_transform(regexp_extract_all(upper(title), '([0-9]+) *GB', 1), lambda x: CAST(x AS DOUBLE))))",
    "ram_speed": f"CAST({ex('([0-9]{3,5}) *[Mm][Hh][Zz]', 1, 'c')} AS INT)",
    "ram_brand": case("upper(title)", T.RAM_BRANDS),
}
EXPR["ram_capacity_gb"] = f"CASE WHEN {EXPR['ram_capacity_any']} BETWEEN 2 AND 256 THEN CAST({EXPR['ram_capacity_any']} AS INT) END"

E = EXPR
CTES = {
    "snap0": """SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_partkey % 4 AS INT) AS c, CAST((l_partkey // 4) % 12 AS INT) AS n, l_suppkey, l_returnflag <> 'N' AS sold,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS pence, CAST(l_quantity AS INT) AS bids, l_shipdate AS ship,
      row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS seq FROM lineitem""",
    "snap": f"""SELECT id, ({list(CATEGORIES)})[c + 1] AS category,
      CASE WHEN c = 0 AND id % 499 = 0 THEN 'Asus GTX 9' || CAST(50 + id % 40 AS VARCHAR) ELSE ({_LISTS})[c + 1][n + 1] END || CASE WHEN id % 251 = 5 THEN {lit(HUGE)} ELSE '' END AS title,
      CASE WHEN NOT (sold AND id % 17 = 0) THEN pence * CASE WHEN id % 41 = 0 THEN 8 ELSE 1 END END AS price_pence, bids,
      CASE WHEN sold THEN ship + INTERVAL 12 HOUR ELSE {NOW} + to_minutes((id * 7 + l_suppkey * 13) % 2880 - 720) END AS end_time,
      CASE WHEN sold THEN CAST(ship AS DATE) END AS sold_date, 'https://www.example.com/itm/' || CAST(id AS VARCHAR) AS url,
      ({list(CATEGORIES)})[c + 1] || '-' || CAST(l_suppkey % 8 AS VARCHAR) || '-' || CAST(id // 8192 AS VARCHAR) AS query,
      CASE WHEN sold THEN 'sold' ELSE 'active' END AS mode, seq FROM snap0""",
    "listing": "SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1",
    "enriched": f"""SELECT *, CASE category WHEN 'GPU' THEN {E['gpu_brand']} WHEN 'CPU' THEN {E['cpu_brand']} WHEN 'HDD' THEN {E['hdd_brand']} WHEN 'RAM' THEN {E['ram_brand']} END AS brand,
      CASE category WHEN 'GPU' THEN {E['gpu_model']} WHEN 'CPU' THEN {E['cpu_model']} END AS model, CASE WHEN category = 'GPU' THEN {E['gpu_vram']} END AS vram,
      CASE WHEN category = 'CPU' THEN {E['cpu_socket']} END AS socket, CASE WHEN category = 'CPU' THEN {E['cpu_cores']} END AS cores,
      CASE category WHEN 'HDD' THEN {E['hdd_capacity_gb']} WHEN 'RAM' THEN {E['ram_capacity_gb']} END AS capacity_gb, CASE WHEN category = 'HDD' THEN {E['hdd_interface']} END AS interface,
      CASE WHEN category = 'HDD' THEN {E['hdd_form_factor']} END AS form_factor, CASE WHEN category = 'HDD' THEN {E['hdd_rpm']} END AS rpm,
      CASE WHEN category = 'RAM' THEN {E['ram_type']} END AS ram_type, CASE WHEN category = 'RAM' THEN {E['ram_speed']} END AS speed
      FROM listing WHERE NOT (category = 'CPU' AND {E['is_full_system_cpu']}) AND NOT (category = 'RAM' AND ({E['is_full_system_ram']} OR {E['ram_type']} IS NULL OR {E['ram_capacity_gb']} IS NULL))""",
    "market": "SELECT *, CASE category WHEN 'HDD' THEN CAST(capacity_gb AS VARCHAR) WHEN 'RAM' THEN ram_type ELSE model END AS k1, CASE category WHEN 'HDD' THEN interface WHEN 'RAM' THEN CAST(capacity_gb AS VARCHAR) END AS k2 FROM enriched",
    "sold": "SELECT * FROM market WHERE sold_date IS NOT NULL AND k1 IS NOT NULL",
    "raw5": "SELECT category, k1, k2, count(*) AS sold_count, avg(price_pence) AS mean_pence, stddev_pop(price_pence) AS sd_pence FROM sold GROUP BY ALL HAVING count(*) >= 5",
    "raw3": "SELECT category, k1, k2, count(*) AS sold_count, avg(price_pence) AS mean_pence, stddev_pop(price_pence) AS sd_pence FROM sold WHERE price_pence IS NOT NULL GROUP BY ALL HAVING count(*) >= 3",
}
for _n in ("5", "3"):
    CTES[f"band{_n}"] = f"SELECT s.*, r.sold_count FROM sold s JOIN raw{_n} r ON s.category = r.category AND s.k1 = r.k1 AND s.k2 IS NOT DISTINCT FROM r.k2 WHERE s.price_pence BETWEEN r.mean_pence - 2 * r.sd_pence AND r.mean_pence + 2 * r.sd_pence"
    CTES[f"clean{_n}"] = f"SELECT category, k1, k2, any_value(sold_count) AS sold_count, (2 * sum(price_pence) + count(*)) // (2 * count(*)) AS avg_pence, min(price_pence) AS min_pence, max(price_pence) AS max_pence FROM band{_n} GROUP BY ALL"
CTES["soon"] = f"SELECT * FROM market WHERE sold_date IS NULL AND end_time > {NOW} AND end_time < {NOW} + INTERVAL 2 HOUR"
CTES["deal"] = """SELECT s.*, c.avg_pence, c.min_pence, c.max_pence, c.avg_pence - s.price_pence AS gain_pence,
  CAST((2000 * (c.avg_pence - s.price_pence) + c.avg_pence) // (2 * c.avg_pence) AS BIGINT) / 10.0::DOUBLE AS discount_pct,
  CASE category WHEN 'HDD' THEN CASE WHEN capacity_gb >= 1000 THEN CAST(capacity_gb // 1000 AS VARCHAR) || 'TB ' || coalesce(interface, 'SATA') WHEN capacity_gb IS NOT NULL THEN CAST(capacity_gb AS VARCHAR) || 'GB ' || coalesce(interface, 'SATA') ELSE coalesce(interface, 'SATA') END
    WHEN 'RAM' THEN CAST(capacity_gb AS VARCHAR) || 'GB ' || ram_type ELSE model END AS label
  FROM soon s JOIN clean5 c USING (category, k1) WHERE s.k2 IS NOT DISTINCT FROM c.k2 AND s.price_pence * 100 < c.avg_pence * 80""".replace("USING (category, k1)", "ON s.category = c.category AND s.k1 = c.k1").replace("CASE category WHEN 'HDD'", "CASE s.category WHEN 'HDD'")
CTES["ledger"] = f"""SELECT id, category, coalesce(price_pence, 100000) * 3 // 4 AS surfaced_pence, coalesce(price_pence, 100000) * 5 // 4 AS avg_market_pence,
  CASE WHEN sold_date IS NOT NULL THEN end_time ELSE {NOW} - to_hours(id % 240) END AS end_time, false AS gave_up, price_pence IS NULL AND sold_date IS NOT NULL AS ended_unsold,
  CASE WHEN sold_date IS NOT NULL AND id % 2 = 0 THEN price_pence END AS final_pence FROM listing WHERE id % 7 = 0"""
CTES["led"] = "SELECT l.*, l.end_time - INTERVAL 90 MINUTE AS surfaced_at, s.title, s.price_pence, s.bids, s.sold_date FROM ledger l JOIN listing s USING (id)"
CTES["resolved"] = """SELECT *, coalesce(final_pence, price_pence) AS paid_pence FROM led WHERE sold_date IS NOT NULL ORDER BY surfaced_at DESC, id LIMIT 200"""
CTES["sight"] = """SELECT id, mode, seq, CAST(bids AS INT) AS bids, sold_date, price_pence / 100.0::DOUBLE AS price FROM snap WHERE mode = 'sold' AND id % 3 = 0
  UNION ALL SELECT id + 7, 'sold', seq, bids, CAST(end_time AS DATE), price_pence / 100.0::DOUBLE FROM snap WHERE mode = 'active' AND id % 3 = 1
  UNION ALL SELECT id, 'completed', seq, bids, CAST(NULL AS DATE), price_pence / 100.0::DOUBLE FROM snap WHERE id % 5 < 2"""
CTES["window_"] = f"SELECT * FROM led WHERE sold_date IS NULL AND NOT gave_up AND end_time < {NOW} - INTERVAL 6 HOUR AND end_time > {NOW} - INTERVAL 7 DAY"
CTES["status"] = """SELECT w.id, CASE WHEN s.sold_date IS NOT NULL THEN 'SOLD' WHEN c.id IS NOT NULL THEN 'UNSOLD' ELSE 'PENDING' END AS status,
  CASE WHEN s.sold_date IS NOT NULL THEN s.sold_date WHEN c.id IS NOT NULL THEN CAST(w.end_time AS DATE) END AS sold_date,
  CAST(trunc(s.price * 100) AS BIGINT) AS price_pence, s.bids FROM window_ w
  LEFT JOIN (SELECT * FROM sight WHERE mode = 'sold' AND sold_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) s USING (id)
  LEFT JOIN (SELECT DISTINCT id FROM sight WHERE mode = 'completed') c USING (id)"""

_DEPS = {
    "snap": ["snap0"], "listing": ["snap"], "enriched": ["listing"], "market": ["enriched"], "sold": ["market"], "raw5": ["sold"], "raw3": ["sold"], "band5": ["raw5"], "band3": ["raw3"], "clean5": ["band5"], "clean3": ["band3"],
    "soon": ["market"], "deal": ["soon", "clean5"], "ledger": ["listing"], "led": ["ledger"], "resolved": ["led"], "sight": ["snap"], "window_": ["led"], "status": ["window_", "sight"],
}


def build(select: str, *names: str, **instead: str) -> str:
    """select with the CTEs that it names and all that those need; `instead` gives whole texts that stand for some."""
    out: list[str] = []

    def add(n):
        for d in _DEPS.get(n, ()):
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(instead.get(n) or f"{n} AS ({CTES[n]})" for n in out) + "\n" if out else "") + select


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"
