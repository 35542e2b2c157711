"""Independent SQL for every registered query, for a second engine (DuckDB dialect).

The texts are built from the same request constants as :mod:`meterbook.plans.catalog`.
Exact decimal pricing is written with integer arithmetic on unscaled values, so the
oracle does not depend on either engine's decimal-division typing rules.
"""

from __future__ import annotations

from decimal import Decimal

from meterbook.operators.filters import UsageFilter
from meterbook.params import PricingParams
from meterbook.plans import catalog as C
from meterbook.schema import STANDARD_VIEW
from meterbook.sources.fixture import billing_view_sql

WITH_BILLING = "WITH billing AS (" + billing_view_sql("VARCHAR") + ")"
ZERO = "CAST(0 AS DECIMAL(38,12))"
TEN12 = "CAST(1000000000000 AS HUGEINT)"


def _q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _dbl(x: float) -> str:
    return f"CAST({_q(repr(float(x)))} AS DOUBLE)"


def to_double(expr: str) -> str:
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


def dec_text(expr: str, min_frac: int = 0) -> str:
    t = f"regexp_replace(regexp_replace(CAST({expr} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    if min_frac <= 0:
        return t
    frac = f"(CASE WHEN contains({t}, '.') THEN split_part({t}, '.', 2) ELSE '' END)"
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE split_part({t}, '.', 1) || '.' || "
            f"rpad({frac}, CAST(greatest(length({frac}), {min_frac}) AS INTEGER), '0') END)")


def unscaled(expr: str) -> str:
    """Unscaled HUGEINT of a DECIMAL(38,12) value."""
    return f"CAST(replace(CAST(CAST({expr} AS DECIMAL(38,12)) AS VARCHAR), '.', '') AS HUGEINT)"


def div_half_up(num: str, den: str) -> str:
    return (f"((CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END) * "
            f"((2 * abs({num}) + abs({den})) // (2 * abs({den}))))")


def from_unscaled(u: str) -> str:
    return (f"CAST((CASE WHEN ({u}) < 0 THEN '-' ELSE '' END) || CAST(abs({u}) // {TEN12} AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({u}) % {TEN12} AS VARCHAR), 12, '0') AS DECIMAL(38,12))")


def _int_scale(value: Decimal) -> tuple[int, int]:
    sign, digits, exp = Decimal(value).normalize().as_tuple()
    scale = max(0, -exp)
    return int(Decimal(value).scaleb(scale)), scale


def priced_dec(expr: str, rates: tuple[str, str, str] = ("56.25", "0.85", "1.12")) -> str:
    """round_half_up(expr * forex * vat / margin, 12) on exact integers."""
    forex, margin, vat = map(Decimal, rates)
    rate_u, rate_s = _int_scale(forex * vat)
    m_u, m_s = _int_scale(margin)
    num = f"({unscaled(expr)} * CAST({rate_u} AS HUGEINT) * CAST({10 ** m_s} AS HUGEINT))"
    den = f"CAST({m_u * 10 ** rate_s} AS HUGEINT)"
    return from_unscaled(div_half_up(num, den))


def lenient_date(expr: str) -> str:
    return f"(CASE WHEN regexp_matches({expr}, '^\\s*\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN TRY_CAST({expr} AS DATE) END)"


def where(flt: UsageFilter | None) -> str:
    if flt is None:
        return ""
    clauses = []
    if flt.search:
        term = _q(flt.search)
        clauses.append("(" + " OR ".join(
            f"lower({c}) LIKE '%' || lower({term}) || '%'" for c in flt.search_columns) + ")")
    for c, v in flt.equals.items():
        if v:
            clauses.append(f"lower({c}) = lower({_q(v)})")
    for c, v in flt.contains.items():
        if v:
            clauses.append(f"contains(lower({c}), lower({_q(v)}))")
    return (" WHERE " + " AND ".join(clauses)) if clauses else ""


def grid(params=C.PARAMS) -> dict[str, str]:
    p = params.for_grid()
    f, m, v = _dbl(p.forex), _dbl(p.margin), _dbl(p.vat)
    px = "CAST(PricingPreTaxTotal AS DOUBLE)"
    return {
        "Forex": f,
        "PreTaxWithForex": f"{px} * {f}",
        "Margin": m,
        "TotalVATEx": f"({px} * {f}) / {m}",
        "VAT": v,
        "TotalVATInc": f"(({px} * {f}) / {m}) * {v}",
    }


def grid_select(params=C.PARAMS) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in grid(params).items())


def priced_detail(flt: UsageFilter | None = None) -> str:
    return f"{WITH_BILLING} SELECT *, {grid_select()} FROM billing{where(flt)}"


def standard_view(flt: UsageFilter | None = None) -> str:
    g = grid()
    cols = ", ".join(f"{g[n]} AS {n}" if n in g else n for n in STANDARD_VIEW)
    return f"{WITH_BILLING} SELECT {cols} FROM billing{where(flt)}"


LINE_KEYS = [
    ("MeterCategory", "meter_category"), ("MeterSubCategory", "meter_sub_category"),
    ("MeterName", "meter_name"), ("MeterType", "meter_type"), ("Unit", "unit"),
    ("EntitlementDescription", "entitlement_description"), ("EntitlementId", "entitlement_id"),
]
SCOPE_KEYS = [("CustomerName", "customer_name"), ("CustomerDomainName", "customer_domain_name"),
              ("InvoiceNumber", "invoice_number")]
LINE_COLS = ", ".join(n for _, n in LINE_KEYS)
SCOPE_COLS = ", ".join(n for _, n in SCOPE_KEYS)


FOLDED = [f"lower({src})" for src, _ in SCOPE_KEYS]
K_COLS = "k1, k2, k3"
# Each invoice's smallest spellings, from the rows themselves.
NAMES_CTE = ("names AS (SELECT " + ", ".join(f"{e} AS n{i}" for i, e in enumerate(FOLDED, 1)) + ", "
             + ", ".join(f"MIN({src}) AS {n}" for src, n in SCOPE_KEYS) + " FROM billing GROUP BY " + ", ".join(FOLDED) + ")")
NAMED = "JOIN names ON " + " AND ".join(f"k{i} IS NOT DISTINCT FROM n{i}" for i in (1, 2, 3))


def sums_cte(batch: bool = False, flt: UsageFilter | None = None, lines: bool = True) -> str:
    """Sums per invoice line (or per invoice): of all rows or, in a batch, per folded invoice."""
    keys = [f"{s} AS {n}" for s, n in LINE_KEYS] if lines else []
    group = [s for s, _ in LINE_KEYS] if lines else []
    if batch:
        keys = [f"{e} AS k{i}" for i, e in enumerate(FOLDED, 1)] + keys
        group = FOLDED + group
    tag = "NULLIF(TRIM(Tags), '')"
    cols = keys + [
        f"NULLIF(string_agg(DISTINCT {tag}, ', ' ORDER BY {tag}), '') AS tags",
        "SUM(TRY_CAST(Quantity AS DECIMAL(38,12))) AS q",
        "SUM(TRY_CAST(PricingPreTaxTotal AS DECIMAL(38,12))) AS p",
        "SUM(TRY_CAST(BillingPreTaxTotal AS DECIMAL(38,12))) AS b",
        f"MIN({lenient_date('COALESCE(UsageDate, ChargeStartDate)')}) AS s",
        f"MAX({lenient_date('COALESCE(UsageDate, ChargeEndDate)')}) AS e",
    ]
    by = f" GROUP BY {', '.join(group)}" if group else ""
    return (f"{NAMES_CTE}, " if batch else "") + f"sums AS (SELECT {', '.join(cols)} FROM billing{where(flt)}{by})"


def priced_cols(rates: tuple[str, str, str] = ("56.25", "0.85", "1.12")) -> str:
    """Columns qd, pd, bd, ud, u, vd computed from q, p, b."""
    ud = (f"COALESCE(CASE WHEN q = 0 THEN {ZERO} WHEN p IS NULL OR q IS NULL THEN NULL "
          f"ELSE {from_unscaled(div_half_up(f'({unscaled('p')} * {TEN12})', unscaled('q')))} END, {ZERO})")
    u = f"COALESCE(CASE WHEN q = 0 THEN CAST(0 AS DOUBLE) ELSE {to_double('p')} / {to_double('q')} END, CAST(0 AS DOUBLE))"
    return (f"COALESCE(q, {ZERO}) AS qd, COALESCE(p, {ZERO}) AS pd, COALESCE(b, {ZERO}) AS bd, "
            f"{ud} AS ud, {u} AS u, {priced_dec(f'COALESCE(p, {ZERO})', rates)} AS vd")


def amounts() -> str:
    return ", ".join([
        f"{to_double('qd')} AS quantity", f"{dec_text('qd')} AS quantity_raw",
        "u AS unit_price", f"{dec_text('ud', 2)} AS unit_price_raw",
        f"{to_double('pd')} AS pricing_pretax_total", f"{dec_text('pd', 2)} AS pricing_pretax_total_raw",
        f"{to_double('bd')} AS billing_pretax_total", f"{dec_text('bd', 2)} AS billing_pretax_total_raw",
        f"{to_double('vd')} AS total_vat_inc", f"{dec_text('vd', 2)} AS total_vat_inc_raw",
    ])


def invoice_with(batch: bool = False, flt: UsageFilter | None = None) -> str:
    return f"{WITH_BILLING}, {sums_cte(batch, flt)}, priced AS (SELECT *, {priced_cols()} FROM sums)"


def totals(batch: bool = False, flt: UsageFilter | None = None, rates: tuple[str, str, str] = ("56.25", "0.85", "1.12")) -> str:
    scope = SCOPE_COLS + ", " if batch else ""
    return (f"{WITH_BILLING}, {sums_cte(batch, flt, lines=False)}, tpriced AS (SELECT *, {priced_cols(rates)} FROM sums) "
            f"SELECT {scope}{to_double('qd')} AS total_quantity, u AS total_unit_price, {to_double('pd')} AS total_pricing, "
            f"{to_double('bd')} AS total_billing, {to_double('vd')} AS total_vat_inc, {dec_text('qd')} AS quantity_raw, "
            f"{dec_text('ud', 2)} AS unit_price_raw, {dec_text('pd', 2)} AS pricing_raw, {dec_text('bd', 2)} AS billing_raw, "
            f"{dec_text('vd', 2)} AS total_vat_inc_raw FROM tpriced {NAMED if batch else ''}")


def period(batch: bool = False) -> str:
    scope = SCOPE_COLS + ", " if batch else ""
    label = (f"CASE WHEN s IS NULL OR e IS NULL THEN 'N/A' "
             f"WHEN strftime(s, '%Y-%m') = strftime(e, '%Y-%m') THEN strftime(s, '%B %Y') "
             f"ELSE strftime(s, '%b %d, %Y') || ' - ' || strftime(e, '%b %d, %Y') END")
    return (f"{WITH_BILLING}, {sums_cte(batch, lines=False)} SELECT {scope}CAST(s AS VARCHAR) AS period_start, "
            f"CAST(e AS VARCHAR) AS period_end, {label} AS period_label FROM sums {NAMED if batch else ''}")


def _ingest_profile() -> str:
    pr = to_double(f"COALESCE(SUM(TRY_CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO})")
    bi = to_double(f"COALESCE(SUM(TRY_CAST(BillingPreTaxTotal AS DECIMAL(38,12))), {ZERO})")
    return (f"{WITH_BILLING} SELECT COUNT(*) AS row_count, {pr} AS pricing_pretax_total, {bi} AS billing_pretax_total, "
            f"MIN({lenient_date('COALESCE(UsageDate, ChargeStartDate)')}) AS usage_start, "
            f"MAX({lenient_date('COALESCE(UsageDate, ChargeEndDate)')}) AS usage_end FROM billing")


def _billing_summary(flt: UsageFilter | None = None) -> str:
    p = C.PARAMS.for_grid()
    f, m, v = _dbl(p.forex), _dbl(p.margin), _dbl(p.vat)
    inner = (f"SELECT {to_double(f'COALESCE(SUM(CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO})')} * {f} AS tp, "
             f"{to_double(f'COALESCE(SUM(CAST(BillingPreTaxTotal AS DECIMAL(38,12))), {ZERO})')} AS total_billing, "
             f"COUNT(*) AS total_records FROM billing{where(flt)}")
    return (f"{WITH_BILLING} SELECT tp AS total_pricing, total_billing, total_records, tp / {m} AS total_vat_ex, "
            f"(tp / {m}) * {v} AS total_vat_inc FROM ({inner})")


def _top_customers(flt: UsageFilter | None = None) -> str:
    return (f"{WITH_BILLING} SELECT COALESCE(NULLIF(CustomerName, ''), 'Unknown') AS label, {to_double('cost')} AS value "
            f"FROM (SELECT CustomerName, COALESCE(SUM(CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO}) AS cost "
            f"FROM billing{where(flt)} GROUP BY CustomerName) ORDER BY cost DESC NULLS LAST, CustomerName ASC NULLS LAST LIMIT {C.TOP_K}")


def _detail_page() -> str:
    off = (C.PAGE - 1) * C.PAGE_SIZE
    return (f"{WITH_BILLING} SELECT *, {grid_select()} FROM billing "
            f"ORDER BY UsageDate DESC NULLS LAST, _row_id ASC NULLS LAST LIMIT {C.PAGE_SIZE} OFFSET {off}")


def _detail_columns(params=C.PARAMS) -> str:
    cols = [c for c in C.DETAIL_COLUMNS if c.lower() not in {n.lower() for n in grid()}]
    return f"{WITH_BILLING} SELECT {', '.join(cols)}, {grid_select(params)} FROM billing"


def _subtotals(batch: bool = False) -> str:
    gid = "GROUPING(meter_category, meter_sub_category)"
    label = (f"CASE WHEN {gid} = 0 THEN 'Subtotal for ' || COALESCE(NULLIF(meter_sub_category, ''), 'Unspecified') "
             f"ELSE 'Total' END")
    keys = f"{K_COLS}, " if batch else ""
    sets = f"(({keys}meter_category, meter_sub_category), ({K_COLS if batch else ''}))"
    inner = (f"SELECT {keys}meter_category, meter_sub_category, "
             f"CASE WHEN {gid} = 0 THEN 'subtotal' ELSE 'total' END AS level, {label} AS label, "
             f"{to_double('SUM(vd)')} AS subtotal_vat_inc, {dec_text('SUM(vd)', 2)} AS subtotal_vat_inc_raw, "
             f"{to_double('SUM(qd)')} AS subtotal_quantity FROM priced GROUP BY GROUPING SETS {sets}")
    shown = "meter_category, meter_sub_category, level, label, subtotal_vat_inc, subtotal_vat_inc_raw, subtotal_quantity"
    return f"{invoice_with(batch)} SELECT {SCOPE_COLS + ', ' if batch else ''}{shown} FROM ({inner}) {NAMED if batch else ''}"


def _export() -> str:
    blanks = ", ".join(f"COALESCE({c}, '') AS {c}" for c in ("meter_category", "meter_sub_category", "meter_name", "meter_type", "unit"))
    items = (f"SELECT 0 AS row_kind, {blanks}, {dec_text('qd')} AS quantity, {dec_text('ud', 2)} AS unit_price, "
             f"{dec_text('vd', 2)} AS total_vat_inc, COALESCE(tags, '') AS tags, "
             f"COALESCE(NULLIF(entitlement_description, ''), NULLIF(entitlement_id, ''), '') AS entitlement FROM priced")
    total = (f"SELECT 1 AS row_kind, '' AS meter_category, '' AS meter_sub_category, '' AS meter_name, '' AS meter_type, "
             f"'' AS unit, {dec_text('qd')} AS quantity, '' AS unit_price, {dec_text('vd', 2)} AS total_vat_inc, "
             f"'TOTAL' AS tags, '' AS entitlement FROM tpriced")
    return (f"{WITH_BILLING}, {sums_cte()}, priced AS (SELECT *, {priced_cols()} FROM sums), "
            f"rolled AS (SELECT SUM(q) AS q, SUM(p) AS p, SUM(b) AS b FROM sums), "
            f"tpriced AS (SELECT *, {priced_cols()} FROM rolled) {items} UNION ALL {total}")


def _csv_rows() -> str:
    headers = ("Meter Category", "Meter Subcategory", "Meter Name", "Meter Type", "Unit", "Quantity", "Unit Price",
               "Total VAT Inc", "Tags", "Entitlement")
    cells = ["COALESCE(meter_category, '')", "COALESCE(meter_sub_category, '')", "COALESCE(meter_name, '')", "COALESCE(meter_type, '')",
             "COALESCE(unit, '')", dec_text("qd"), dec_text("ud", 2), dec_text("vd", 2), "COALESCE(tags, '')",
             "COALESCE(NULLIF(entitlement_description, ''), NULLIF(entitlement_id, ''), '')"]
    order = ", ".join(f"{c} ASC NULLS LAST" for c in ("meter_category", "meter_sub_category", "meter_name", "entitlement_description",
                                                      "meter_type", "unit", "entitlement_id"))
    named = ", ".join(f'{c} AS "{h}"' for c, h in zip(cells, headers))
    total = ["''"] * 5 + [dec_text("qd"), "''", dec_text("vd", 2), "'TOTAL'", "''"]
    total_named = ", ".join(f'{c} AS "{h}"' for c, h in zip(total, headers))
    return (f"{invoice_with()}, tsums AS (SELECT SUM(q) AS q, SUM(p) AS p, SUM(b) AS b FROM sums), "
            f"tpriced AS (SELECT *, {priced_cols()} FROM tsums) "
            f'SELECT {named}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS "Position" FROM priced '
            f'UNION ALL SELECT {total_named}, CAST((SELECT COUNT(*) FROM priced) + 1 AS INTEGER) AS "Position" FROM tpriced')


def _customer_domains(limit: int | None = None) -> str:
    return (f"{WITH_BILLING} SELECT CustomerName, CustomerDomainName, domain_rank FROM ("
            f"SELECT *, CAST(row_number() OVER (PARTITION BY CustomerName ORDER BY CustomerDomainName) AS INTEGER) AS domain_rank "
            f"FROM (SELECT DISTINCT CustomerName, CustomerDomainName FROM billing "
            f"WHERE COALESCE(CustomerName, '') <> '' AND COALESCE(CustomerDomainName, '') <> ''))" + (f" WHERE domain_rank <= {limit}" if limit else ""))


def _filter_options(limit: int | None = None) -> str:
    return (f"{WITH_BILLING} SELECT value, TRIM(value) AS label, TRIM(value) AS option FROM (SELECT DISTINCT CustomerName AS value "
            f"FROM billing WHERE TRIM(COALESCE(CustomerName, '')) <> '') ORDER BY lower(label), label, value"
            + (f" LIMIT {limit}" if limit else ""))


def _invoice_list(flt: UsageFilter | None = None, limit: int | None = None) -> str:
    clause = where(flt).replace(" WHERE ", " AND ", 1)
    return (f"{WITH_BILLING} SELECT DISTINCT InvoiceNumber FROM billing WHERE TRIM(COALESCE(InvoiceNumber, '')) <> ''{clause} "
            f"ORDER BY InvoiceNumber" + (f" LIMIT {limit}" if limit else ""))


def _spend_by_upload() -> str:
    pr, bi = (to_double(f"COALESCE(SUM(CAST({c} AS DECIMAL(38,12))), {ZERO})") for c in ("PricingPreTaxTotal", "BillingPreTaxTotal"))
    return (f"{WITH_BILLING} SELECT CAST(PartnerId AS BIGINT) % 12 AS upload_id, {pr} AS total_pricing, {bi} AS total_billing, "
            f"COUNT(*) AS total_records FROM billing GROUP BY 1")


TWO_UPLOADS = f"{WITH_BILLING}, landed AS (SELECT *, CASE WHEN Unit = '1 Hour' THEN 1 ELSE 2 END AS part FROM billing)"


def _spend(upload: str, extra: str, where: str = "") -> str:
    pr, bi = (to_double(f"COALESCE(SUM(CAST({c} AS DECIMAL(38,12))), {ZERO})") for c in ("PricingPreTaxTotal", "BillingPreTaxTotal"))
    return (f"SELECT CAST({upload} AS BIGINT) AS upload_id, {pr} AS total_pricing, {bi} AS total_billing, COUNT(*) AS total_records, {extra} "
            f"FROM landed {where} GROUP BY 1")


def _landed_uploads() -> str:
    return f"{TWO_UPLOADS} {_spend('part', 'COUNT(*) FILTER (part = 2 AND Unit IS NOT NULL) AS notes')}"


def _landed_replacement() -> str:
    before, after = _spend("part", "'before' AS reader"), _spend("1", "'after' AS reader", "WHERE part = 2")
    return f"{TWO_UPLOADS} {before} UNION ALL {after}"


def _manifest_history() -> str:
    total = to_double(f"COALESCE(SUM(CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO})")

    def state(upload: int, sequence: int, superseded: str, where: str = "") -> str:
        return (f"SELECT CAST({upload} AS BIGINT) AS upload_id, CAST({sequence} AS BIGINT) AS sequence, 'completed' AS status, COUNT(*) AS row_count, "
                f"CAST(0 AS BIGINT) AS reject_count, {total} AS pricing_pretax_total, {superseded} AS superseded FROM landed {where}")

    landed = [state(1, 1, "true", "WHERE part = 1"), state(1, 2, "false"), state(2, 1, "true", "WHERE part = 2")]
    return f"{TWO_UPLOADS} {' UNION ALL '.join(landed)} UNION ALL SELECT 2, 2, 'deleted', NULL, NULL, NULL, false"


def _landed_profile() -> str:
    return _ingest_profile().replace("COUNT(*) AS row_count", "COUNT(*) AS row_count, CAST(0 AS BIGINT) AS reject_count")


MANIFEST_STATE = """
SELECT o_custkey AS upload_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END, moment) AS status,
  arg_max(o_orderkey, moment) AS row_count
FROM (SELECT *, o_orderdate + to_seconds(o_orderkey) AS moment FROM orders) GROUP BY o_custkey
"""


# Each upload's current state and the time of its first entry.
UPLOADS = """
WITH uploads AS (
  SELECT o_custkey AS upload_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END, moment) AS status,
    arg_max(o_orderkey, moment) AS row_count, min(moment) AS created_at
  FROM (SELECT *, o_orderdate + to_seconds(o_orderkey) AS moment FROM orders) GROUP BY o_custkey)
"""


def _recent_uploads() -> str:
    return (f"{UPLOADS} SELECT upload_id, status, format('{{:,}}', row_count) AS rows_text, strftime(created_at, '%Y-%m-%d %H:%M') AS created_text, "
            f"'-' AS completed_text, '' AS error_text FROM uploads ORDER BY created_at DESC, upload_id DESC LIMIT {C.RECENT_UPLOADS}")


FILE_CHECKS = """
SELECT page_id, size, page_id % 3 <> 2 AND size <= 1048.576 AS accepted,
  CASE WHEN page_id % 3 = 2 THEN 'not a .csv file' WHEN size > 1048.576 THEN 'larger than 0.001 MB' END AS reason
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages)
"""


def _deep_page() -> str:
    first = f"((SELECT COUNT(*) FROM billing) + {C.PAGE_SIZE} - 1) // {C.PAGE_SIZE} // 2 * {C.PAGE_SIZE}"
    return (f"{WITH_BILLING} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY UsageDate DESC NULLS LAST, _row_id ASC NULLS LAST) AS position FROM billing) "
            f"WHERE position > {first} AND position <= {first} + {C.PAGE_SIZE}")


def _daily_spend() -> str:
    day = lenient_date("COALESCE(UsageDate, ChargeStartDate)")
    return (f"{WITH_BILLING} SELECT d AS \"date\", {to_double(f'COALESCE(SUM(CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO})')} AS value, "
            f"COUNT(*) AS records FROM (SELECT *, {day} AS d FROM billing) GROUP BY d")


def _strategy_pricing() -> str:
    one, hundred = "CAST(1 AS DOUBLE)", "CAST(100 AS DOUBLE)"
    strategies = ("strategies AS (SELECT c_name AS customer_name, "
                  "upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) || ' plan' AS name, "
                  "CAST((c_nationkey % 5) * 5 AS DOUBLE) AS markup_percent, "
                  "CAST((c_custkey % 4) * 2.5 AS DOUBLE) AS discount_percent FROM customer)")
    price = (f"CAST(b.PricingPreTaxTotal AS DOUBLE) * ({one} + COALESCE(s.markup_percent, CAST(0 AS DOUBLE)) / {hundred}) "
             f"* ({one} - COALESCE(s.discount_percent, CAST(0 AS DOUBLE)) / {hundred})")
    return (f"{WITH_BILLING}, {strategies} SELECT b._row_id, b.CustomerName, b.PricingPreTaxTotal, "
            f"s.name AS StrategyName, {price} AS StrategyPrice FROM billing b LEFT JOIN strategies s "
            f"ON b.CustomerName = s.customer_name")


def money_text(expr: str) -> str:
    x = f"TRY_CAST({expr} AS DOUBLE)"
    return f"format('{{:,.2f}}', COALESCE(CASE WHEN isnan({x}) THEN 0 ELSE {x} END, CAST(0 AS DOUBLE)))"


MONEY_COLUMNS = ("UnitPrice", "PricingPreTaxTotal", "BillingPreTaxTotal", "PreTaxWithForex", "TotalVATEx", "TotalVATInc")


def _money_format() -> str:
    g = grid()
    cols = []
    for n in STANDARD_VIEW:
        e = g.get(n, n)
        cols.append(f"{money_text(e)} AS {n}" if n in MONEY_COLUMNS else f"{e} AS {n}")
    return f"{WITH_BILLING} SELECT {', '.join(cols)} FROM billing"


def _invoice_display() -> str:
    labels = ", ".join(f"COALESCE(NULLIF({c}, ''), '-') AS {c}" for c in ("meter_category", "meter_sub_category", "meter_name", "meter_type", "unit"))
    return (f"{invoice_with()} SELECT {labels}, {money_text(to_double('qd'))} AS quantity, {money_text('u')} AS unit_price, "
            f"{money_text(to_double('vd'))} AS total_vat_inc, COALESCE(NULLIF(tags, ''), '-') AS tags, "
            f"COALESCE(NULLIF(entitlement_description, ''), NULLIF(entitlement_id, ''), '-') AS entitlement FROM priced")


def _dashboard_rollup() -> str:
    gid = "GROUPING(CustomerName, d)"
    level = f"CASE WHEN {gid} = 3 THEN 'total' WHEN {gid} = 1 THEN 'customer' ELSE 'day' END"
    day = lenient_date("COALESCE(UsageDate, ChargeStartDate)")
    p = to_double(f"COALESCE(SUM(CAST(PricingPreTaxTotal AS DECIMAL(38,12))), {ZERO})")
    b = to_double(f"COALESCE(SUM(CAST(BillingPreTaxTotal AS DECIMAL(38,12))), {ZERO})")
    return (f"{WITH_BILLING} SELECT {level} AS level, CustomerName, d AS \"date\", {p} AS pricing, {b} AS billing, "
            f"COUNT(*) AS records FROM (SELECT *, {day} AS d FROM billing) "
            f"GROUP BY GROUPING SETS ((), (CustomerName), (d))")


# The customer's invoice as plain equality on folded text.
SCOPED = UsageFilter(equals={"CustomerName": C.INVOICE_CUSTOMER[0], "CustomerDomainName": C.INVOICE_CUSTOMER[1]})


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_profile": _ingest_profile(),
        "detail_page": _detail_page(),
        "detail_columns": _detail_columns(),
        "detail_count": f"{WITH_BILLING} SELECT COUNT(*) AS total FROM billing{where(C.COUNT_FILTER)}",
        "priced_detail": priced_detail(),
        "standard_view": standard_view(),
        "search_detail": priced_detail(UsageFilter(search=C.SEARCH_TERM)),
        "filter_equality": priced_detail(UsageFilter(equals=C.EQUALS)),
        "filter_combined": priced_detail(C.COMBINED),
        "filter_meter_contains": standard_view(UsageFilter(contains=C.CONTAINS)),
        "billing_summary": _billing_summary(),
        "top_customers": _top_customers(),
        "invoice_list": _invoice_list(limit=C.INVOICE_LIST_LIMIT),
        "invoice_lines": f"{invoice_with()} SELECT {LINE_COLS}, tags, {amounts()} FROM priced",
        "weighted_unit_price": (f"{invoice_with()} SELECT {LINE_COLS}, {dec_text('qd')} AS quantity_raw, "
                                f"{dec_text('pd', 2)} AS pricing_pretax_total_raw, u AS unit_price, "
                                f"{dec_text('ud', 2)} AS unit_price_raw FROM priced"),
        "invoice_tags": f"{WITH_BILLING}, {sums_cte()} SELECT {LINE_COLS}, tags FROM sums",
        "invoice_subtotals": _subtotals(),
        "invoice_totals": totals(),
        "invoice_period": period(),
        "invoice_export": _export(),
        "filter_options": _filter_options(),
        "customer_domains": _customer_domains(),
        "daily_spend": _daily_spend(),
        "strategy_pricing": _strategy_pricing(),
        "invoice_batch": f"{invoice_with(True)} SELECT {SCOPE_COLS}, {LINE_COLS}, tags, {amounts()} FROM priced {NAMED}",
        "invoice_batch_totals": totals(True),
        "invoice_batch_period": period(True),
        "invoice_batch_subtotals": _subtotals(True),
        "invoice_csv_rows": _csv_rows(),
        "customer_invoice_lines": f"{invoice_with(flt=SCOPED)} SELECT {LINE_COLS}, tags, {amounts()} FROM priced",
        "customer_invoice_totals": totals(flt=SCOPED),
        "default_rates_totals": totals(rates=("1", "1", "1.12")),
        "default_rates_detail": _detail_columns(PricingParams(1.0, 1.0, 1.12)),
        "filtered_summary": _billing_summary(C.REQUEST),
        "filtered_top_customers": _top_customers(C.REQUEST),
        "filtered_invoice_list": _invoice_list(C.REQUEST),
        "first_filter_options": _filter_options(C.FIRST_OPTIONS),
        "first_customer_domains": _customer_domains(1),
        "usage_days": f"{WITH_BILLING} SELECT _row_id, strftime({lenient_date('COALESCE(UsageDate, ChargeStartDate)')}, '%Y-%m-%d') AS day FROM billing",
        "spend_by_upload": _spend_by_upload(),
        "landed_detail": f"{WITH_BILLING} SELECT * EXCLUDE (_row_id) FROM billing",
        "landed_profile": _landed_profile(),
        "landed_invoice_lines": f"{invoice_with()} SELECT {LINE_COLS}, tags, {amounts()} FROM priced",
        "landed_newlines": f"{WITH_BILLING} SELECT * EXCLUDE (_row_id) REPLACE (MeterName || chr(10) || '\"' || Unit || '\",' || chr(10) || chr(10) || ',' || ChargeEndDate AS Tags) FROM billing",
        "landed_mixed_headers": f"{WITH_BILLING} SELECT * EXCLUDE (_row_id), CASE WHEN Unit <> '1 Hour' THEN lower(Unit) END AS Note FROM billing",
        "landed_uploads": _landed_uploads(),
        "landed_replacement": _landed_replacement(),
        "manifest_history": _manifest_history(),
        "deep_page": _deep_page(),
        "file_checks": FILE_CHECKS,
        "manifest_state": MANIFEST_STATE,
        "recent_uploads": _recent_uploads(),
        "newest_upload": f"{UPLOADS} SELECT arg_max(upload_id, (created_at, upload_id)) AS upload_id FROM uploads WHERE status = 'completed'",
        "money_format": _money_format(),
        "invoice_display": _invoice_display(),
        "dashboard_rollup": _dashboard_rollup(),
    }
