"""SQL counterparts of the registered queries, for checking their results.

Written from the definitions rather than generated from the Spark plans.
Fractions are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Iterable

from panelspan.plans.driver_tables import PRIORITIES

# Group id, label, sector, priority.
GROUPS = (
    ("urgent", "Urgent", "agriculture", "1-URGENT"),
    ("high", "High", "agriculture", "2-HIGH"),
    ("medium", "Medium", "manufacturing", "3-MEDIUM"),
    ("not_specified", "Not specified", "services", "4-NOT SPECIFIED"),
    ("low", "Low", "services", "5-LOW"),
)
PREFIX_FILTERS = {
    "soma_g": "true",
    "soma_l": "free",
    "soma_e": "NOT free",
    "h_livres": "free AND male",
    "m_livres": "free AND NOT male",
    "h_escr": "NOT free AND male",
    "m_escr": "NOT free AND NOT male",
}
OUTCOMES = (
    "mfg_share_change_pp", "mfg_share_log_ratio", "mfg_share_cagr", "mfg_share_logit_change",
    "non_agr_share_change_pp", "mfg_agr_ratio_change", "structural_change_index",
    "agr_exit_share", "serv_share_change_pp", "literacy_rate_change_pp", "pop_growth_rate",
)


def r(expression: str, name: str) -> str:
    """Rounded double; adding zero removes a negative zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS \"{name}\""


def rounded(names: Iterable[str]) -> str:
    return ", ".join(r(f'"{n}"', n) for n in names)


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"


def share0(a: str, b: str) -> str:
    """Undefined quotient as zero."""
    return f"coalesce(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} END, 0)"


def clamp(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0 ELSE {x} END"


def n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE)"


# ---- orders as a census ------------------------------------------------------

FACT = """fact AS (
  SELECT o_custkey AS muni_id, o_orderpriority AS cat, o_orderstatus IN ('F', 'P') AS free,
         o_orderkey % 2 = 0 AS male, o_totalprice > 250000 AS literate, o_orderdate AS day
  FROM orders)"""

WIDE_COLUMNS = [
    "soma_g_almas", "soma_l_almas", "soma_e_almas", "soma_g_sabemlereescrever",
    *[f"{prefix}_{p}" for prefix in PREFIX_FILTERS for p in PRIORITIES],
]


def _wide_aggregates() -> str:
    parts = [
        f'{n("true")} AS soma_g_almas', f'{n("free")} AS soma_l_almas',
        f'{n("NOT free")} AS soma_e_almas', f'{n("literate")} AS soma_g_sabemlereescrever',
    ]
    parts += [
        f'{n(f"cat = {chr(39)}{p}{chr(39)} AND {cond}")} AS "{prefix}_{p}"'
        for prefix, cond in PREFIX_FILTERS.items() for p in PRIORITIES
    ]
    return ", ".join(parts)


WIDE = f"{FACT}, wide AS (SELECT muni_id, {_wide_aggregates()} FROM fact GROUP BY muni_id)"
PLACES = """places AS (
  SELECT c_custkey AS muni_id, c_name AS municipio, c_nationkey AS code_state,
         'N' || c_nationkey AS abbrev_state, n_name AS name_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def _panel_aggregates(cond: str) -> dict[str, str]:
    """The seven counts of rows under a condition."""
    return {
        "n_total": n(cond), "n_free": n(f"{cond} AND free"), "n_enslaved": n(f"{cond} AND NOT free"),
        "n_male_free": n(f"{cond} AND free AND male"), "n_female_free": n(f"{cond} AND free AND NOT male"),
        "n_male_enslaved": n(f"{cond} AND NOT free AND male"),
        "n_female_enslaved": n(f"{cond} AND NOT free AND NOT male"),
    }


CONTEXT = {
    "pop_total": n("true"), "pop_free": n("free"), "pop_enslaved": n("NOT free"), "pop_literate": n("literate"),
    "occ_total": n("cat <> '5-LOW'"), "occ_free": n("cat <> '5-LOW' AND free"),
    "occ_enslaved": n("cat <> '5-LOW' AND NOT free"), "occ_male": n("cat <> '5-LOW' AND male"),
    "occ_female": n("cat <> '5-LOW' AND NOT male"),
}
AGRICULTURE, MANUFACTURING = "cat IN ('1-URGENT', '2-HIGH')", "cat = '3-MEDIUM'"
COUNTS = tuple(_panel_aggregates("true"))
SHARES = {
    "share_of_all_occupations": ("n_total", "occ_total"),
    "share_free_within_group": ("n_free", "n_total"),
    "share_enslaved_within_group": ("n_enslaved", "n_total"),
    "share_male_within_group": ("n_male", "n_total"),
    "share_female_within_group": ("n_female", "n_total"),
}
RATES = {
    "literacy_rate_population": ("pop_literate", "pop_total"),
    "enslaved_rate_population": ("pop_enslaved", "pop_total"),
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _group_rows(
    source: str, keys: str, kinds: tuple[str, ...], groups: Iterable[tuple[str, ...]] = GROUPS, context: dict[str, str] = CONTEXT,
) -> str:
    """One SELECT per group over a grouped source, stacked."""
    blocks = []
    if "Occupation" in kinds:
        for gid, label, sector, cat in groups:
            counts = _panel_aggregates(f"cat = '{cat}'")
            blocks.append(
                f"SELECT {keys}, 'Occupation' AS group_type, '{gid}' AS group_id, '{label}' AS group_label, "
                f"'{sector}' AS sector, {_select(context)}, {_select(counts)} FROM {source} GROUP BY {keys}")
    if "Sector" in kinds:
        agriculture, manufacturing = _panel_aggregates(AGRICULTURE), _panel_aggregates(MANUFACTURING)
        every = _panel_aggregates("true")
        whole = every | {"n_total": CONTEXT["occ_total"], "n_free": CONTEXT["occ_free"],
                         "n_enslaved": CONTEXT["occ_enslaved"]}
        services = {c: clamp(f"({whole[c]} - {agriculture[c]} - {manufacturing[c]})") for c in COUNTS}
        for sector, counts in (("agriculture", agriculture), ("manufacturing", manufacturing),
                               ("services", services)):
            blocks.append(
                f"SELECT {keys}, 'Sector' AS group_type, '{sector}' AS group_id, "
                f"'{sector.capitalize()}' AS group_label, '{sector}' AS sector, "
                f"{_select(CONTEXT)}, {_select(counts)} FROM {source} GROUP BY {keys}")
    return " UNION ALL ".join(blocks)


def _with_shares(rows: str) -> str:
    sexes = "n_male_free + n_male_enslaved AS n_male, n_female_free + n_female_enslaved AS n_female"
    derived = {k: div(a, b) for k, (a, b) in (RATES | SHARES).items()}
    return (
        f"SELECT *, {_select(derived)}, CAST(NULL AS DOUBLE) AS n_literate_within_group, "
        f"CAST(NULL AS DOUBLE) AS share_literate_within_group FROM (SELECT *, {sexes} FROM ({rows}))"
    )


PANEL_VALUES = (*CONTEXT, *RATES, *COUNTS, "n_male", "n_female", *SHARES,
                "n_literate_within_group", "share_literate_within_group")
PANEL_TEXTS = "group_type, group_id, group_label, sector"


def _panel(kind: str) -> str:
    return (f"WITH {FACT} SELECT muni_id, {PANEL_TEXTS}, {rounded(PANEL_VALUES)} "
            f"FROM ({_with_shares(_group_rows('fact', 'muni_id', (kind,)))})")


DASH_VALUES = (
    "n_total", "n_free", "n_enslaved", "n_male", "n_female", *CONTEXT, *RATES, *SHARES,
    "n_literate_within_group", "share_literate_within_group",
)
DASH_TEXTS = "geography_level, geography_id, geography_name, " + PANEL_TEXTS
BOTH = ("Occupation", "Sector")
MUNI_KEYS = "muni_id, municipio, code_state, abbrev_state, name_state"
STATE_KEYS = "code_state, abbrev_state, name_state"


def _dashboard_cte() -> str:
    zeroed = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*RATES, *SHARES))
    plain = [c for c in DASH_VALUES if c not in RATES and c not in SHARES]
    return f"""{FACT}, {PLACES},
located AS (SELECT * FROM fact JOIN places USING (muni_id) WHERE code_state IS NOT NULL),
muni AS ({_with_shares(_group_rows('located', MUNI_KEYS, BOTH))}),
state AS ({_with_shares(_group_rows('located', STATE_KEYS, BOTH))}),
stacked AS (
  SELECT 'Municipality' AS geography_level, CAST(muni_id AS VARCHAR) AS geography_id,
         municipio AS geography_name, {PANEL_TEXTS}, {', '.join(DASH_VALUES)} FROM muni
  UNION ALL
  SELECT 'State', CAST(code_state AS VARCHAR), name_state, {PANEL_TEXTS}, {', '.join(DASH_VALUES)} FROM state),
dash AS (SELECT {DASH_TEXTS}, {', '.join(plain)}, {zeroed} FROM stacked)"""


NATIONAL = {
    "share_of_national_occupations": "n_total", "share_free_of_national_group": "n_free",
    "share_enslaved_of_national_group": "n_enslaved", "share_male_of_national_group": "n_male",
    "share_female_of_national_group": "n_female", "literacy_rate_of_national_pop": "pop_literate",
    "enslaved_rate_of_national_pop": "pop_enslaved",
}
PLAIN_NATIONAL = {k: v for k, v in NATIONAL.items() if v in ("n_total", "n_male", "n_female", "pop_literate")}


def _national_cte(measures: dict[str, str]) -> str:
    sums = ", ".join(f"coalesce(sum({m}), 0) AS {m}_national" for m in measures.values())
    shares = ", ".join(f"{share0(m, m + '_national')} AS {name}" for name, m in measures.items())
    return f"""totals AS (SELECT group_type, group_id, {sums} FROM dash
  WHERE geography_level = 'Municipality' GROUP BY group_type, group_id),
panel AS (SELECT *, {shares} FROM dash LEFT JOIN totals USING (group_type, group_id))"""


PANEL = f"{_dashboard_cte()}, {_national_cte(NATIONAL)}"
PANEL_KEYS = "geography_level, geography_id, group_type, group_id"


def _national(cte: str, measures: dict[str, str]) -> str:
    names = [*[f"{m}_national" for m in measures.values()], *measures]
    return f"WITH {cte} SELECT {PANEL_KEYS}, {rounded(names)} FROM panel"


def _wide_panel(rows: str, source: str, key: str, groups: Iterable[str], measures: Iterable[str]) -> str:
    cells = ", ".join(
        r(f"max(CASE WHEN group_id = '{g}' THEN {m} END)", f"{m}_{g}") for m in measures for g in groups)
    return (f"WITH {source} SELECT {key}, {r('max(literacy_rate_population)', 'literacy_rate_population')}, "
            f"{cells} FROM ({rows}) GROUP BY {key}")


WIDE_MEASURES = ("n_total", *SHARES)
SECTORS = ("agriculture", "manufacturing", "services")

# ---- line items as a census ---------------------------------------------------

LINES = """line AS (
  SELECT l_suppkey AS muni_id, l_quantity AS q, l_linestatus = 'F' AS male, l_linenumber AS k,
         l_discount > 0.05 AS literate, l_returnflag IN ('A', 'N') AS occupied
  FROM lineitem)"""
SUPPLIER_PLACES = PLACES.replace("customer", "supplier").replace("c_custkey", "s_suppkey").replace(
    "c_name", "s_name").replace("c_nationkey", "s_nationkey")


def q(condition: str) -> str:
    return f"coalesce(sum(q) FILTER (WHERE {condition}), 0)"


LINE_CONTEXT = {
    "pop_total": q("true"), "pop_literate": q("literate"), "occ_total": q("occupied"),
    "occ_male": q("male"), "occ_female": q("NOT male"),
}
LINE_SHARES = {name: SHARES[name] for name in
               ("share_of_all_occupations", "share_male_within_group", "share_female_within_group")}
LINE_MEASURES = ("n_total", *LINE_SHARES)
LINE_GAPS = ("n_free", "n_enslaved", "pop_free", "pop_enslaved", "enslaved_rate_population", "occ_free",
             "occ_enslaved", "share_free_within_group", "share_enslaved_within_group",
             "n_literate_within_group", "share_literate_within_group")


def _line_rows(source: str, keys: str) -> str:
    def counts(cond: str) -> dict[str, str]:
        return {"n_total": q(cond), "n_male": q(f"{cond} AND male"), "n_female": q(f"{cond} AND NOT male")}

    agriculture, manufacturing = counts("k BETWEEN 1 AND 2"), counts("k BETWEEN 3 AND 5")
    whole = {"n_total": LINE_CONTEXT["occ_total"], "n_male": q("male"), "n_female": q("NOT male")}
    services = {c: clamp(f"({whole[c]} - {agriculture[c]} - {manufacturing[c]})") for c in whole}
    blocks = [
        f"SELECT {keys}, 'Sector' AS group_type, '{s}' AS group_id, '{s.capitalize()}' AS group_label, "
        f"'{s}' AS sector, {_select(LINE_CONTEXT)}, {_select(c)} FROM {source} GROUP BY {keys}"
        for s, c in zip(SECTORS, (agriculture, manufacturing, services))
    ]
    derived = {"literacy_rate_population": div("pop_literate", "pop_total")}
    derived |= {k: div(a, b) for k, (a, b) in LINE_SHARES.items()}
    gaps = ", ".join(f"CAST(NULL AS DOUBLE) AS {g}" for g in LINE_GAPS)
    return f"SELECT *, {_select(derived)}, {gaps} FROM ({' UNION ALL '.join(blocks)})"


LINE_VALUES = (*LINE_CONTEXT, "literacy_rate_population", "n_total", "n_male", "n_female",
               *LINE_SHARES, *LINE_GAPS)


def _line_dashboard_cte() -> str:
    zero = ("literacy_rate_population", *LINE_SHARES)
    zeroed = ", ".join(f"coalesce({c}, 0) AS {c}" for c in zero)
    plain = ", ".join(c for c in DASH_VALUES if c not in zero)
    return f"""{LINES}, {SUPPLIER_PLACES},
located AS (SELECT * FROM line JOIN places USING (muni_id) WHERE code_state IS NOT NULL),
muni AS ({_line_rows('located', MUNI_KEYS)}),
state AS ({_line_rows('located', STATE_KEYS)}),
stacked AS (
  SELECT 'Municipality' AS geography_level, CAST(muni_id AS VARCHAR) AS geography_id,
         municipio AS geography_name, {PANEL_TEXTS}, {', '.join(DASH_VALUES)} FROM muni
  UNION ALL
  SELECT 'State', CAST(code_state AS VARCHAR), name_state, {PANEL_TEXTS}, {', '.join(DASH_VALUES)} FROM state),
dash AS (SELECT {DASH_TEXTS}, {plain}, {zeroed} FROM stacked)"""


# ---- comparison ----------------------------------------------------------------

STATUS_VARIABLES = (
    "pop_total", "pop_enslaved", "pop_literate", "occ_total", "agr_total", "mfg_total", "serv_total",
    "enslaved_share", "enslaved_mfg_share", "enslaved_agr_share",
    "mfg_share", "agr_share", "serv_share", "non_agr_share", "literacy_rate",
)
PLAIN_VARIABLES = (
    "pop_total", "pop_literate", "occ_total", "agr_total", "mfg_total", "serv_total",
    "mfg_share", "agr_share", "serv_share", "non_agr_share", "mfg_agr_ratio", "literacy_rate", "mfg_percapita",
)
COMPARED = [*[f"{v}_a" for v in STATUS_VARIABLES], *[f"{v}_b" for v in PLAIN_VARIABLES],
            "mfg_agr_ratio_a", *OUTCOMES]


def _accounts(key: str, when: str, suffix: str, names: tuple[str, ...]) -> str:
    levels = {
        "pop_total": n("true"), "pop_enslaved": n("NOT free"), "pop_literate": n("literate"),
        "occ_total": n("cat <> '5-LOW'"), "agr_total": n(AGRICULTURE), "mfg_total": n(MANUFACTURING),
        "agr_enslaved": n(f"{AGRICULTURE} AND NOT free"), "mfg_enslaved": n(f"{MANUFACTURING} AND NOT free"),
    }
    derived = {
        "serv_total": clamp("(occ_total - agr_total - mfg_total)"),
        "mfg_share": div("mfg_total", "occ_total"), "agr_share": div("agr_total", "occ_total"),
        "serv_share": div(clamp("(occ_total - agr_total - mfg_total)").join("()"), "occ_total"),
        "non_agr_share": f"1 - coalesce({div('agr_total', 'occ_total')}, 1)",
        "literacy_rate": div("pop_literate", "pop_total"),
        "enslaved_share": div("pop_enslaved", "pop_total"),
        "enslaved_mfg_share": div("mfg_enslaved", "mfg_total"),
        "enslaved_agr_share": div("agr_enslaved", "agr_total"),
        "mfg_agr_ratio": div("mfg_total", "agr_total"), "mfg_percapita": div("mfg_total", "pop_total"),
    }
    kept = ", ".join(f"{v} AS {v}_{suffix}" for v in names)
    return (f"SELECT {key}, {kept} FROM (SELECT *, {_select(derived)} FROM ("
            f"SELECT {key}, {_select(levels)} FROM keyed WHERE {when} GROUP BY {key}))")


def _outcomes() -> str:
    positive = "mfg_share_a > 0 AND mfg_share_b > 0"
    inside = f"{positive} AND mfg_share_a < 1 AND mfg_share_b < 1"

    def logit(p: str) -> str:
        c = f"greatest(least({p}, 1 - 1e-8), 1e-8)"
        return f"ln({c} / (1 - {c}))"

    columns = {
        "mfg_share_change_pp": "mfg_share_b - mfg_share_a",
        "mfg_share_log_ratio": f"CASE WHEN {positive} THEN ln(mfg_share_b / mfg_share_a) END",
        "mfg_share_cagr": f"CASE WHEN {positive} THEN pow(mfg_share_b / mfg_share_a, 1.0 / 4) - 1 END",
        "mfg_share_logit_change": f"CASE WHEN {inside} THEN {logit('mfg_share_b')} - {logit('mfg_share_a')} END",
        "non_agr_share_change_pp": "non_agr_share_b - non_agr_share_a",
        "mfg_agr_ratio_a": div("mfg_total_a", "agr_total_a"),
        "mfg_agr_ratio_change": f"mfg_agr_ratio_b - {div('mfg_total_a', 'agr_total_a')}",
        "structural_change_index": "abs(mfg_share_b - mfg_share_a) + abs(agr_share_b - agr_share_a) "
                                   "+ abs(serv_share_b - serv_share_a)",
        "agr_exit_share": "agr_share_a - agr_share_b",
        "serv_share_change_pp": "serv_share_b - serv_share_a",
        "literacy_rate_change_pp": "literacy_rate_b - literacy_rate_a",
        "pop_growth_rate": "CASE WHEN pop_total_a > 0 AND pop_total_b > 0 "
                           "THEN ln(pop_total_b / pop_total_a) / 4 END",
    }
    return _select(columns)


def _compared(key: str, keyed: str) -> str:
    return f"""{FACT}, keyed AS ({keyed}),
first_period AS ({_accounts(key, "day < TIMESTAMP '1998-01-01'", 'a', STATUS_VARIABLES)}),
second_period AS ({_accounts(key, "day >= TIMESTAMP '1998-01-01'", 'b', PLAIN_VARIABLES)}),
compared AS (SELECT *, {_outcomes()} FROM first_period JOIN second_period USING ({key}))"""


MAJORITY = """majority AS (
  SELECT code_amc, state_code FROM (
    SELECT c_custkey % 300 AS code_amc, CAST(c_nationkey AS VARCHAR) AS state_code,
           row_number() OVER (PARTITION BY c_custkey % 300
                              ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR)) AS place
    FROM customer GROUP BY 1, c_nationkey) WHERE place = 1)"""
AREA = (
    _compared("code_amc", "SELECT muni_id % 300 AS code_amc, * FROM fact JOIN customer ON muni_id = c_custkey")
    + f", {MAJORITY}, area AS (SELECT * FROM compared LEFT JOIN majority USING (code_amc))"
)

# ---- regression ----------------------------------------------------------------


def _tail(t: str, df: str) -> str:
    """Two-sided Student-t tail for whole df: the finite trigonometric series."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = (f"sin({theta}) * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos({theta}), 2 * k)))")
    odd = (f"2 / pi() * ({theta} + sin({theta}) * coalesce(list_sum(list_transform("
           f"range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda k: sqrt(pi()) / 2 * "
           f"exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({theta}), 2 * k + 1))), 0))")
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


CRITICAL = f"""
dfs AS (SELECT DISTINCT df FROM fits),
search(df, low, high, step) AS (
  SELECT df, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM dfs
  UNION ALL
  SELECT df, CASE WHEN {_tail('(low + high) / 2', 'df')} > 0.05 THEN (low + high) / 2 ELSE low END,
         CASE WHEN {_tail('(low + high) / 2', 'df')} > 0.05 THEN high ELSE (low + high) / 2 END, step + 1
  FROM search WHERE step < 50),
critical AS (SELECT df, (low + high) / 2 AS tc FROM search WHERE step = 50),
inferred AS (
  SELECT fits.*, coef / se AS t_value, {_tail('(coef / se)', 'fits.df')} AS p_value,
         coef - tc * se AS ci_lower, coef + tc * se AS ci_upper
  FROM fits JOIN critical USING (df))"""
LONG = """
long AS (
  SELECT state_code, enslaved_share_a AS x, y_metric, y
  FROM (UNPIVOT area ON {columns} INTO NAME y_metric VALUE y)
  WHERE enslaved_share_a IS NOT NULL AND y IS NOT NULL AND state_code IS NOT NULL)""".format(
    columns=", ".join(OUTCOMES))
STATE_FITS = f"""{AREA}, {LONG},
fits AS (
  SELECT state_code, y_metric, count(*) AS n_amc, corr(y, x) AS coef,
         sqrt((1 - corr(y, x) * corr(y, x)) / (count(*) - 2)) AS se, count(*) - 2 AS df
  FROM long GROUP BY state_code, y_metric
  HAVING count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y)), {CRITICAL}"""
POOLED_FITS = """
pooled AS (
  SELECT y_metric, count(*) AS n_obs, 'pooled' AS model, corr(y, x) AS coef,
         sqrt((1 - corr(y, x) * corr(y, x)) / (count(*) - 2)) AS se, count(*) - 2 AS df
  FROM long GROUP BY y_metric HAVING count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y))"""
# Fixed effects by demeaning the globally standardised values within states.
WITHIN_FITS = """
scaled AS (
  SELECT y_metric, state_code,
         (x - avg(x) OVER m) / stddev_samp(x) OVER m AS xs, (y - avg(y) OVER m) / stddev_samp(y) OVER m AS ys
  FROM long WINDOW m AS (PARTITION BY y_metric)),
demeaned AS (
  SELECT y_metric, state_code, xs - avg(xs) OVER g AS xd, ys - avg(ys) OVER g AS yd
  FROM scaled WINDOW g AS (PARTITION BY y_metric, state_code)),
slopes AS (
  SELECT y_metric, count(*) AS n_obs, count(DISTINCT state_code) AS g, sum(xd * yd) / sum(xd * xd) AS coef,
         sum(xd * xd) AS wxx, sum(xd * yd) AS wxy, sum(yd * yd) AS wyy FROM demeaned GROUP BY y_metric),
within AS (
  SELECT y_metric, n_obs, 'state_fe' AS model, coef,
         sqrt((wyy - wxy * wxy / wxx) / (n_obs - g - 1) / wxx) AS se, n_obs - g - 1 AS df FROM slopes)"""
FIT_VALUES = ("coef", "se", "t_value", "p_value", "ci_lower", "ci_upper")


def _national_fits(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {AREA}, {LONG}, {ctes}, {CRITICAL} {select}"


# Labels of the outcomes, as in the metric registry.
LABELS = {
    "mfg_share_change_pp": "Mfg share change (pp)", "mfg_share_log_ratio": "Mfg share log ratio",
    "mfg_share_cagr": "Mfg share CAGR", "mfg_share_logit_change": "Mfg share logit change",
    "non_agr_share_change_pp": "Non-agr share change (pp)", "mfg_agr_ratio_change": "Mfg/agr ratio change",
    "structural_change_index": "Structural change index", "agr_exit_share": "Agr exit share",
    "serv_share_change_pp": "Services share change (pp)", "literacy_rate_change_pp": "Literacy rate change (pp)",
    "pop_growth_rate": "Pop growth rate",
}
LABEL_CASE = "CASE y_metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"


def _quantiles(source: str, column: str, probabilities: Iterable[float]) -> str:
    cells = ", ".join(r(f"quantile_cont(CAST({column} AS DOUBLE), {p})", f"q{i}")
                      for i, p in enumerate(probabilities))
    return f"SELECT count({column}) AS n, {cells} FROM {source}"


def _quartiles() -> str:
    contrasts = (
        ("a sector shares (baseline)",
         {"Agriculture": "agr_share_a", "Manufacturing": "mfg_share_a", "Services": "serv_share_a"}),
        ("a-b sector share change (pp)",
         {"Agriculture": "agr_share_b - agr_share_a", "Manufacturing": "mfg_share_change_pp",
          "Services": "serv_share_change_pp"}),
    )
    blocks = " UNION ALL ".join(
        f"SELECT quartile, count(*) AS n, '{sector}' AS sector, {r(f'avg({column})', 'mean_share')}, "
        f"'{label}' AS panel FROM binned GROUP BY quartile"
        for label, columns in contrasts for sector, column in columns.items())
    return f"""WITH {AREA},
cases AS (SELECT * FROM area WHERE enslaved_share_a IS NOT NULL AND mfg_share_change_pp IS NOT NULL
          AND serv_share_change_pp IS NOT NULL),
breaks AS (SELECT quantile_cont(enslaved_share_a, [0.25, 0.5, 0.75]) AS b FROM cases),
binned AS (SELECT *, CASE WHEN enslaved_share_a <= b[1] THEN 'Q1 (lowest)' WHEN enslaved_share_a <= b[2] THEN 'Q2'
           WHEN enslaved_share_a <= b[3] THEN 'Q3' ELSE 'Q4 (highest)' END AS quartile FROM cases, breaks)
{blocks}"""


def percent(x: str) -> str:
    """One decimal, half to even, space between thousands."""
    return f"CASE WHEN {x} IS NULL THEN 'No data' ELSE printf('%.1f', round_even({x} * 100, 1)) || '%' END"


def whole(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'No data' ELSE format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) END"


STATE_NAMES = """states(name_state, code_state, abbrev_state) AS (VALUES
  ('Amazonas', 13, 'AM'), ('Pará', 15, 'PA'), ('Maranhão', 21, 'MA'), ('Piauhy', 22, 'PI'), ('Ceará', 23, 'CE'),
  ('Rio Grande do Norte', 24, 'RN'))"""  # the codes that nations 0 to 24 can meet


def _folded(x: str) -> str:
    for letter, ascii_ in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O")):
        x = f"replace({x}, '{letter}', '{ascii_}')"
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9_]', '', 'g')"


EXPORTED = (
    "mfg_share_b", "agr_share_b", "non_agr_share_b", "mfg_agr_ratio_b", "literacy_rate_b", "mfg_percapita_b",
    *OUTCOMES, "enslaved_share_a", "enslaved_mfg_share_a", "enslaved_agr_share_a", "mfg_share_a",
    "literacy_rate_a", "agr_share_a", "serv_share_a", "serv_share_b",
)
SHORT = {"gl": "geography_level", "gid": "geography_id", "gn": "geography_name", "gt": "group_type",
         "grid": "group_id", "glab": "group_label"}
SHORT_VALUES = [
    *[c for c in DASH_VALUES if "literate_within" not in c],
    *[f"{m}_national" for m in NATIONAL.values()], *NATIONAL,
]
STATE_FIT_SELECT = f"SELECT state_code, y_metric, n_amc, {rounded(FIT_VALUES)} FROM inferred"


# The same orders in 38 categories.
FULL_GROUPS = [(f"k{i:02}", f"k{i:02}", "agriculture" if i < 15 else "manufacturing" if i < 22 else "services", f"k{i:02}") for i in range(38)]
FULL_FACT = FACT.replace("o_orderpriority AS cat", "'k' || lpad(CAST(CAST(trunc(o_totalprice) AS BIGINT) % 38 AS VARCHAR), 2, '0') AS cat")
FULL_ROWS = _with_shares(_group_rows(
    "fact", "muni_id", ("Occupation",), FULL_GROUPS, {k: v.replace("cat <> '5-LOW'", "cat < 'k30'") for k, v in CONTEXT.items()}))
# Areas of three quarters of the customers, as the quality report's flow has them.
KNOWN = "c_custkey % 4 <> 3"
KNOWN_AREA = AREA.replace("FROM fact JOIN customer ON muni_id = c_custkey", f"FROM fact JOIN customer ON muni_id = c_custkey WHERE {KNOWN}") \
    .replace("FROM customer GROUP BY", f"FROM customer WHERE {KNOWN} GROUP BY")


def _flow_quality() -> str:
    def codes(period: str, when: str) -> str:
        return "".join(
            f"SELECT '{period} period: areas of codes' AS stage, '{measure}' AS measure, count(DISTINCT o_custkey) AS n "
            f"FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE {when}{condition} UNION ALL "
            for measure, condition in (("rows", ""), ("unmatched", f" AND ({KNOWN}) IS NOT TRUE")))
    fits = f"{KNOWN_AREA}, {LONG}, " + STATE_FITS.split(f"{LONG},", 1)[1]
    return (f"WITH RECURSIVE {fits} " + codes("first", "o_orderdate < TIMESTAMP '1998-01-01'") + codes("second", "o_orderdate >= TIMESTAMP '1998-01-01'")
            + "SELECT 'areas', 'rows', count(*) FROM area UNION ALL SELECT 'areas', 'without_state', count(*) FROM area WHERE state_code IS NULL "
            "UNION ALL SELECT 'state models', 'rows', count(*) FROM inferred UNION ALL SELECT 'state models', 'significant', count(*) FROM inferred WHERE p_value < 0.05 "
            "UNION ALL SELECT 'national models', 'rows', 2 * count(*) FROM (SELECT y_metric FROM long GROUP BY y_metric "
            "HAVING count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y))")


def _distinct_rollup() -> str:
    levels = {"nation": "CAST(n_nationkey AS VARCHAR)", "region": "CAST(n_regionkey AS VARCHAR)", "all": "'all'"}
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, {key} AS id, count(DISTINCT l_partkey) AS parts, true AS estimate_is_near "
        f"FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY {key}" for level, key in levels.items())


def statements() -> dict[str, str]:
    context_rates = {k: div(a, b) for k, (a, b) in RATES.items()}
    line_literacy = {"literacy_rate_population": div("pop_literate", "pop_total")}
    scatter = f"""WITH {AREA} SELECT code_amc, state_code, {r('enslaved_share_a', 'x')},
        {r('mfg_share_log_ratio', 'y')}, n_name AS state_name
        FROM area LEFT JOIN {{names}} ON state_code = CAST(n_nationkey AS VARCHAR)
        WHERE enslaved_share_a IS NOT NULL AND mfg_share_log_ratio IS NOT NULL"""
    fitted_names = """(SELECT * FROM nation WHERE CAST(n_nationkey AS VARCHAR) IN (
        SELECT state_code FROM area WHERE mfg_share_log_ratio IS NOT NULL AND enslaved_share_a IS NOT NULL
        GROUP BY state_code HAVING count(*) >= 5 AND min(enslaved_share_a) < max(enslaved_share_a)
        AND min(mfg_share_log_ratio) < max(mfg_share_log_ratio))) AS named"""
    comparison = (f"WITH {AREA} SELECT CAST(code_amc AS VARCHAR) AS code_amc, state_code, "
                  + ", ".join(r(f"round_even({c}, 6)", c) for c in EXPORTED) + " FROM area")
    forest = f"""WITH RECURSIVE {STATE_FITS}
            SELECT y_metric, state_code, n_name || ' (n=' || n_amc || ')' AS label, {r('coef', 'coef')},
                   p_value < 0.05 AS significant,
                   CAST(row_number() OVER (PARTITION BY y_metric ORDER BY coef, state_code, y_metric) AS INTEGER) AS position
            FROM inferred LEFT JOIN nation ON state_code = CAST(n_nationkey AS VARCHAR)"""
    return {
        "wide_counts": f"WITH {WIDE} SELECT muni_id, {rounded(WIDE_COLUMNS)} FROM wide",
        "denominators": f"WITH {FACT} SELECT muni_id, {rounded([*CONTEXT, *RATES])} FROM (SELECT *, "
                        f"{_select(context_rates)} FROM (SELECT muni_id, {_select(CONTEXT)} FROM fact GROUP BY muni_id))",
        "denominators_exact": f"WITH {LINES} SELECT muni_id, {rounded([*LINE_CONTEXT, *line_literacy])} FROM (SELECT *, "
                              f"{_select(line_literacy)} FROM (SELECT muni_id, {_select(LINE_CONTEXT)} FROM line GROUP BY muni_id))",
        "occupation_panel": _panel("Occupation"),
        "sector_panel": _panel("Sector"),
        "panel_store_update": _panel("Sector"),
        "sector_panel_exact": f"WITH {LINES} SELECT muni_id, {PANEL_TEXTS}, {rounded(LINE_VALUES)} "
                              f"FROM ({_line_rows('line', 'muni_id')})",
        "parent_rollup": f"WITH {FACT}, {PLACES} SELECT {STATE_KEYS}, {rounded(WIDE_COLUMNS)} FROM (SELECT {STATE_KEYS}, "
                         f"{_wide_aggregates()} FROM fact JOIN places USING (muni_id) "
                         f"WHERE code_state IS NOT NULL GROUP BY {STATE_KEYS})",
        "prefix_rollup": f"WITH {FACT} SELECT state_code, {rounded(WIDE_COLUMNS)} FROM (SELECT "
                         f"substr(CAST(muni_id AS VARCHAR), 1, 2) AS state_code, {_wide_aggregates()} FROM fact GROUP BY 1)",
        "dashboard_panel": f"WITH {_dashboard_cte()} SELECT {DASH_TEXTS}, {rounded(DASH_VALUES)} FROM dash",
        "dashboard_panel_exact": f"WITH {_line_dashboard_cte()} SELECT {DASH_TEXTS}, {rounded(DASH_VALUES)} FROM dash",
        "national_share": _national(PANEL, NATIONAL),
        "national_share_exact": _national(f"{_line_dashboard_cte()}, {_national_cte(PLAIN_NATIONAL)}", PLAIN_NATIONAL),
        "sector_wide": _wide_panel(_with_shares(_group_rows("fact", "muni_id", ("Sector",))), FACT, "muni_id",
                                   SECTORS, WIDE_MEASURES),
        "sector_wide_exact": _wide_panel(_line_rows("line", "muni_id"), LINES, "muni_id", SECTORS, LINE_MEASURES),
        "occupation_wide": _wide_panel(_with_shares(_group_rows("fact", "muni_id", ("Occupation",))), FACT,
                                       "muni_id", [g[0] for g in GROUPS], WIDE_MEASURES),
        "occupation_panel_full": f"WITH {FULL_FACT} SELECT muni_id, {PANEL_TEXTS}, {rounded(PANEL_VALUES)} FROM ({FULL_ROWS})",
        "occupation_wide_full": _wide_panel(FULL_ROWS, FULL_FACT, "muni_id", [g[0] for g in FULL_GROUPS], WIDE_MEASURES),
        "category_dictionary": """
            WITH parts AS (SELECT concat_ws(' ', p_name, p_brand, p_type) AS description, count(*) AS parts FROM part GROUP BY 1),
            patterns AS (SELECT unnest(string_split(p_name, ' ')) AS pattern FROM part UNION SELECT p_brand FROM part)
            SELECT pattern, CAST(sum(parts) AS BIGINT) AS parts, count(*) AS descriptions
            FROM patterns JOIN parts ON contains(description, pattern) WHERE pattern <> '' GROUP BY pattern""",
        "crosswalk_cache": "SELECT c_custkey % 300 AS code_amc, CAST(c_custkey AS VARCHAR) AS muni_code FROM customer",
        "flow_quality": _flow_quality(),
        "distinct_rollup": _distinct_rollup(),
        "missing_keys": "WITH " + _compared("state_code", "SELECT CASE WHEN muni_id % 25 = 7 THEN '-' ELSE CAST(muni_id % 25 AS VARCHAR) END AS state_code, * FROM fact")
        + f""" SELECT nullif(state_code, '-') AS state_code, coalesce(n_name, 'Unit ' || nullif(state_code, '-'), 'Unknown') AS geography_name,
            {rounded(('pop_total_a', 'pop_total_b', *OUTCOMES))}
            FROM compared LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) ON state_code = CAST(n_nationkey AS VARCHAR)""",
        "normalised_names": f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS doc_code, {_folded('text')} AS folded FROM documents",
        "category_groups": f"""SELECT l_returnflag, group_id, {r('sum(l_quantity)', 'n_total')}
            FROM lineitem JOIN part ON l_partkey = p_partkey
            JOIN (VALUES ('sized', 'small|medium|large'), ('priced', 'econo|promo'), ('regular', 'standard|med'))
              AS g(group_id, pattern) ON regexp_matches(lower(p_type), pattern)
            GROUP BY l_returnflag, group_id""",
        "state_lookup": f"""WITH {STATE_NAMES} SELECT c_nationkey AS code_state, count(*) AS customers,
            name_state, abbrev_state FROM customer LEFT JOIN states ON c_nationkey = code_state
            GROUP BY c_nationkey, name_state, abbrev_state""",
        "geography_match": f"""WITH {PLACES} SELECT name_state, count(*) AS n,
            CASE WHEN muni_id IN (SELECT o_custkey FROM orders) THEN 'matched' ELSE 'unmatched' END AS side
            FROM places GROUP BY 1, 3""",
        "crosswalk_explode": "SELECT c_custkey % 300 AS code_amc, CAST(c_custkey AS VARCHAR) AS muni_code FROM customer",
        "crosswalk_rollup": f"WITH {FACT} SELECT code_amc, {rounded(WIDE_COLUMNS)} FROM (SELECT c_custkey % 300 AS code_amc, "
                            f"{_wide_aggregates()} FROM fact JOIN customer ON muni_id = c_custkey GROUP BY 1)",
        "unmatched": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "quality_report": f"""WITH {AREA}
            SELECT 'crosswalk: codes in several areas' AS "check",
                   CAST(coalesce(sum(CASE WHEN times > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n, count(*) AS total
            FROM (SELECT doc_id, count(*) AS times FROM labels GROUP BY doc_id)
            UNION ALL SELECT 'documents: rows without area',
                   count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)), count(*) FROM documents
            UNION ALL SELECT 'customers: rows without area',
                   count(*) FILTER (WHERE c_custkey NOT IN (SELECT doc_id FROM labels)), count(*) FROM customer
            UNION ALL SELECT 'areas: rows', count(*), count(*) FROM area""",
        "crosswalk_stats": "SELECT count(*) AS mappings, count(DISTINCT c_custkey % 300) AS areas FROM customer",
        "majority_state": f"WITH {MAJORITY} SELECT code_amc, state_code FROM majority",
        "two_period_panel": f"WITH {AREA} SELECT code_amc, state_code, {rounded(COMPARED)} FROM area",
        "state_two_period": "WITH " + _compared(
            "state_code", "SELECT substr(CAST(muni_id AS VARCHAR), 1, 2) AS state_code, * FROM fact")
        + f" SELECT state_code, {rounded(COMPARED)} FROM compared",
        "state_regression": f"WITH RECURSIVE {STATE_FITS} {STATE_FIT_SELECT}",
        "pooled_regression": _national_fits(
            f"{POOLED_FITS}, fits AS (SELECT * FROM pooled)",
            f"SELECT model, y_metric, n_obs, {rounded(FIT_VALUES)} FROM inferred"),
        "fe_regression": _national_fits(
            f"{WITHIN_FITS}, fits AS (SELECT * FROM within)",
            f"SELECT model, y_metric, n_obs, {rounded(FIT_VALUES)} FROM inferred"),
        "regression_table": forest,
        "regression_refresh": forest,
        "national_table": _national_fits(
            f"{POOLED_FITS}, {WITHIN_FITS}, fits AS (SELECT * FROM pooled UNION ALL SELECT * FROM within)",
            f"""SELECT model, y_metric, {LABEL_CASE} AS label, {r('coef', 'coef')}, p_value < 0.05 AS significant,
            CAST(row_number() OVER (PARTITION BY model ORDER BY round(coef, 6), y_metric) AS INTEGER) AS position
            FROM inferred"""),
        "scatter_data": scatter.format(names="nation"),
        "scatter_fitted_names": scatter.format(names=fitted_names),
        "scatter_band": f"""WITH RECURSIVE {AREA},
            m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
                         regr_sxy(y, x) AS sxy, min(x) AS low, max(x) AS high
                  FROM (SELECT enslaved_share_a AS x, mfg_share_change_pp AS y FROM area
                        WHERE enslaved_share_a IS NOT NULL AND mfg_share_change_pp IS NOT NULL)),
            fits AS (SELECT n - 2 AS df, CAST(1 AS DOUBLE) AS coef, CAST(1 AS DOUBLE) AS se FROM m), {CRITICAL},
            points AS (SELECT CAST(i AS INTEGER) AS point, low + (high - low) / 79 * i AS x,
                              my + sxy / sxx * (low + (high - low) / 79 * i - mx) AS fit,
                              sqrt((syy - sxy * sxy / sxx) / (n - 2))
                                * sqrt(1.0 / n + pow(low + (high - low) / 79 * i - mx, 2) / sxx) AS se, tc
                       FROM m, critical, range(80) AS t(i))
            SELECT point, {rounded(('x', 'fit', 'se'))}, {r('fit - tc * se', 'lower')}, {r('fit + tc * se', 'upper')}
            FROM points""",
        "standardised_values": f"""SELECT c_custkey, c_nationkey, {r('c_acctbal', 'c_acctbal')},
            {r('(c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w', 'c_acctbal_std')}
            FROM customer WINDOW w AS (PARTITION BY c_nationkey)""",
        "quartile_breaks": f"WITH {AREA} {_quantiles('area', 'enslaved_share_a', (0, 0.25, 0.5, 0.75, 1))}",
        "price_quantiles": _quantiles("lineitem", "l_extendedprice", (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)),
        "quartile_comparison": _quartiles(),
        "panel_slice": f"""WITH {PANEL} SELECT geography_id AS code_state_chr, n_regionkey AS shape, geography_name,
            {r('share_of_national_occupations', 'map_value')}, {r('n_total', 'numerator')},
            {r('n_total_national', 'denominator')}, 'Share of national occupations' AS metric_label,
            'Total in group' AS num_label, 'National total in group' AS den_label, true AS is_pct, false AS is_diverging
            FROM panel JOIN nation ON geography_id = CAST(n_nationkey AS VARCHAR)
            WHERE geography_level = 'State' AND group_type = 'Occupation' AND group_id = 'medium'""",
        "group_choices": f"""WITH {PANEL} SELECT DISTINCT group_id, group_label FROM panel
            WHERE geography_level = 'Municipality' AND group_type = 'Occupation'""",
        "top15_metric": f"""WITH {PANEL} SELECT geography_name AS geography, {percent('share_of_all_occupations')} AS metric,
            {whole('n_total')} AS numerator, {whole('occ_total')} AS denominator FROM (
              SELECT * FROM panel WHERE geography_level = 'Municipality' AND group_type = 'Sector'
              AND group_id = 'manufacturing' ORDER BY share_of_all_occupations DESC NULLS LAST, geography_id LIMIT 15)""",
        "top15_change": f"""WITH {AREA} SELECT CAST(code_amc AS VARCHAR) AS unit,
            CAST(round_even(mfg_share_log_ratio, 4) AS VARCHAR) AS metric FROM area
            WHERE mfg_share_log_ratio IS NOT NULL ORDER BY mfg_share_log_ratio DESC, code_amc LIMIT 15""",
        "top15_state_change": "WITH " + _compared(
            "state_code", "SELECT substr(CAST(muni_id AS VARCHAR), 1, 2) AS state_code, * FROM fact")
        + """ SELECT state_code AS unit, CAST(round_even(mfg_share_log_ratio, 4) AS VARCHAR) AS metric FROM compared
            WHERE mfg_share_log_ratio IS NOT NULL ORDER BY mfg_share_log_ratio DESC, state_code LIMIT 15""",
        "regression_map": f"""WITH RECURSIVE {STATE_FITS}
            SELECT state_code AS code, n_regionkey AS shape, y_metric, n_amc, {r('coef', 'map_value')}, true AS is_diverging
            FROM inferred JOIN nation ON state_code = CAST(n_nationkey AS VARCHAR) WHERE y_metric = 'mfg_share_change_pp' AND n_nationkey <> 3""",
        "slice_batch": f"""WITH {PANEL} SELECT r_name AS selection, geography_level, group_type, group_id, geography_id,
            {rounded(('n_total', 'share_of_national_occupations'))}
            FROM panel JOIN region ON geography_level = CASE WHEN r_regionkey % 2 = 0 THEN 'State' ELSE 'Municipality' END
              AND group_type = CASE WHEN r_regionkey < 3 THEN 'Occupation' ELSE 'Sector' END
              AND group_id = coalesce(CASE r_regionkey WHEN 0 THEN 'urgent' WHEN 1 THEN 'medium' WHEN 3 THEN 'manufacturing' END, group_id)""",
        "metric_domain": f"""WITH {AREA} SELECT true AS diverging, {r('-max(abs(mfg_share_change_pp))', 'low')},
            {r('max(abs(mfg_share_change_pp))', 'high')}, 'mfg_share_change_pp' AS metric FROM area
            UNION ALL SELECT false, {r('min(literacy_rate_b)', 'low')}, {r('max(literacy_rate_b)', 'high')},
            'literacy_rate_b' FROM area""",
        "short_names": f"WITH {PANEL} SELECT " + ", ".join(f"{v} AS {k}" for k, v in SHORT.items())
                       + f", {rounded(SHORT_VALUES)} FROM panel",
        "json_columns": comparison,
        "json_document": comparison,
        "json_records": f"WITH RECURSIVE {STATE_FITS} SELECT state_code, y_metric, n_amc, "
                        f"{rounded(('coef', 'se', 'ci_lower', 'ci_upper', 'p_value'))} FROM inferred",
        "panel_store": f"""WITH {PANEL} SELECT geography_level, group_type, group_id, geography_id,
            {rounded(('n_total', 'share_of_all_occupations', 'share_of_national_occupations'))}
            FROM panel WHERE geography_level = 'Municipality' AND group_type = 'Sector' AND group_id = 'services'""",
    }
