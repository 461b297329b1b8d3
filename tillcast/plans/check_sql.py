"""The registered queries once more, as plain SQL on the parquet tables.

Each statement is written on its own from the definition of the query, by brute force where
the Spark job uses a faster way (every name against every text, every pair of words).
"""

from __future__ import annotations

from tillcast.functions.text import RESTRICTED_KEYWORDS
from tillcast.operators import linking
from tillcast.operators.selection import EXCLUDED_BRANCHES, EXCLUDED_DATES, EXCLUDED_ITEMS
from tillcast.plans import catalog as c


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# --- shared table expressions ------------------------------------------------------------

POS = """pos AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_type AS item_group, p_name AS item_name,
         s_name AS warehouse, lower(n_name) AS branch, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

SALES = POS + """, sales AS (
  SELECT date, branch, item_group, item_name, sum(qty) AS qty_sold
  FROM pos GROUP BY date, branch, item_group, item_name)"""

ROLLUP = POS + """, rolled AS (
  SELECT date, item_group, item_name, warehouse, branch, sum(qty) AS qty_sold
  FROM pos GROUP BY ALL)"""

PLACES = """places AS (
  SELECT lower(n_name) AS branch, r_name AS city, CAST(n_nationkey AS DOUBLE) AS latitude,
         CAST(n_regionkey AS DOUBLE) AS longitude
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

WEATHER = PLACES + """, weather AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(n_nationkey AS DOUBLE) AS latitude,
         CAST(n_regionkey AS DOUBLE) AS longitude,
         max(o_totalprice) AS temperature_2m_max, min(o_totalprice) AS temperature_2m_min
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

ENRICHED = SALES + ", " + WEATHER + """, enriched AS (
  SELECT sales.date, branch, item_group, item_name, qty_sold, dayname(sales.date) AS day,
         isodow(sales.date) >= 6 AS is_weekend, temperature_2m_max, temperature_2m_min
  FROM sales LEFT JOIN places USING (branch)
  LEFT JOIN weather ON weather.date = sales.date AND weather.latitude = places.latitude
                   AND weather.longitude = places.longitude)"""

MEANS = """means AS (
  SELECT avg(temperature_2m_max) AS mean_max, avg(temperature_2m_min) AS mean_min
  FROM enriched)"""


def training(where: str = "TRUE") -> str:
    """Training rows of the enriched sales that satisfy ``where``."""
    return ENRICHED.replace(
        "longitude = places.longitude)", f"longitude = places.longitude WHERE {where})"
    ) + ", " + MEANS + f""", training AS (
  SELECT date, branch, item_group, item_name, qty_sold, is_weekend,
         coalesce(temperature_2m_max, mean_max) AS temperature_2m_max,
         coalesce(temperature_2m_min, mean_min) AS temperature_2m_min,
         CAST(day(date) AS INT) AS day
  FROM enriched, means
  WHERE lower(branch) NOT IN ({quoted(b.lower() for b in EXCLUDED_BRANCHES)})
    AND item_name NOT IN ({quoted(EXCLUDED_ITEMS)})
    AND date NOT IN ({", ".join(f"DATE '{d}'" for d in EXCLUDED_DATES)}))"""


SPLIT = """aged AS (
  SELECT *, row_number() OVER (PARTITION BY branch, item_name
                               ORDER BY date DESC, item_group DESC) AS age,
         count(*) OVER (PARTITION BY branch, item_name) AS size
  FROM training), split AS (
  SELECT *, CASE WHEN age <= 7 THEN 'test' ELSE 'train' END AS part FROM aged WHERE size > 7),
eligible AS (
  SELECT branch, item_name, count(*) AS train_rows, count(qty_sold) AS train_values
  FROM split WHERE part = 'train' GROUP BY branch, item_name HAVING count(qty_sold) >= 2)"""

CAP = """SELECT branch, item_name, qty_sold AS cap FROM (
    SELECT branch, item_name, qty_sold,
           row_number() OVER (PARTITION BY branch, item_name
                              ORDER BY count(*) DESC, qty_sold) AS place
    FROM {rows} GROUP BY branch, item_name, qty_sold) WHERE place = 1"""

HOLIDAYS = """holidays AS (
  SELECT DISTINCT date, CASE WHEN date = date_trunc('quarter', date) THEN 'first day'
                             ELSE 'last day' END AS holiday
  FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem)
  WHERE date = date_trunc('quarter', date) OR date + 1 = date_trunc('quarter', date + 1))"""

NO_HOLIDAYS = """holidays AS (
  SELECT DATE '1900-01-01' AS date, 'none' AS holiday WHERE FALSE)"""

REGRESSORS = ["CAST(is_weekend AS DOUBLE)", "temperature_2m_max", "temperature_2m_min",
              "CAST(day AS DOUBLE)"]
HOLIDAY_NAMES = ["first day", "last day"]
QUARTER = "(4 * year(date) + quarter(date))"
ROUNDS, RIDGE = 6, 0.1


def raw_terms(names: list[str], regressors: bool) -> list[str]:
    week = [f"{f}(2 * pi() * {k} * (isodow(date) - 1) / 7)" for k in (1, 2, 3) for f in ("sin", "cos")]
    feasts = [f"CASE WHEN holiday = '{n}' THEN 1.0 ELSE 0.0 END" for n in names]
    found = ["1.0", *week, *feasts, *(REGRESSORS if regressors else [])]
    return [f"CAST({x} AS DOUBLE)" for x in found]


def elimination(name: str, matrix: str, size: int) -> str:
    """Lines of coefficients and a right side; solved at ``j`` = size + 1."""
    return f"""{name} AS (
  SELECT branch, item_name, 1 AS j, m FROM {matrix}
  UNION ALL
  SELECT branch, item_name, j + 1, list_transform(m, lambda line, i: CASE WHEN i = j
      THEN list_transform(line, lambda v: v / m[j][j])
      ELSE list_transform(line, lambda v, c: v - line[j] * m[j][c] / m[j][j]) END)
  FROM {name} WHERE j <= {size})"""


def model(rows: str, holidays: str = NO_HOLIDAYS, regressors: bool = True) -> str:
    """Table expressions up to ``model``: one row per series, fitted on table ``rows``.

    Every round reads every row: curve, slopes and all products with the terms.
    """
    names = HOLIDAY_NAMES if holidays == HOLIDAYS else []
    raw = raw_terms(names, regressors)
    p, r = len(raw), len(REGRESSORS) if regressors else 0
    plain = p - r
    centre = ["0.0"] * plain + [f"avg(raw[{k + 1}])" for k in range(plain, p)]
    scale = ["1.0"] * plain + [
        f"CASE WHEN var_pop(raw[{k + 1}]) > 1e-9 * avg(raw[{k + 1}] * raw[{k + 1}])"
        f" THEN 1 / stddev_pop(raw[{k + 1}]) ELSE 0 END" for k in range(plain, p)
    ]
    terms = f"range(1, {p + 1})"
    sql = f"""{holidays}, caps AS ({CAP.format(rows=rows)}),
lines AS (
  SELECT branch, item_name, max(date) AS last_date,
         arg_min(item_group, (date, item_group)) AS item_group
  FROM {rows} GROUP BY branch, item_name HAVING count(qty_sold) >= 2),
fit_rows AS (
  SELECT r.branch, r.item_name, qty_sold AS y, {QUARTER.replace("date", "r.date")} AS q,
         [{", ".join(raw).replace("date", "r.date")}] AS raw
  FROM {rows} r LEFT JOIN holidays h ON r.date = h.date WHERE qty_sold IS NOT NULL),
norms AS (
  SELECT branch, item_name, min(q) AS first_quarter, [{", ".join(centre)}] AS centre,
         [{", ".join(scale)}] AS scale
  FROM fit_rows GROUP BY branch, item_name),
z_rows AS MATERIALIZED (
  SELECT branch, item_name, y, cap, (q - first_quarter) / 4.0 AS t,
         list_transform(raw, lambda v, k: (v - centre[k]) * scale[k]) AS z
  FROM fit_rows JOIN norms USING (branch, item_name) JOIN caps USING (branch, item_name)
  JOIN lines USING (branch, item_name)),
products AS MATERIALIZED (
  SELECT branch, item_name, i, list(s ORDER BY k) AS line FROM (
    SELECT branch, item_name, i, k,
           sum(z[i] * z[k]) + CASE WHEN i = k THEN {RIDGE} ELSE 0 END AS s
    FROM z_rows, unnest({terms}) a(i), unnest({terms}) b(k)
    GROUP BY branch, item_name, i, k)
  GROUP BY branch, item_name, i),
curve0 AS (SELECT branch, item_name, 0.0::DOUBLE AS growth, 0.0::DOUBLE AS rate FROM lines)"""
    for k in range(ROUNDS + 1):
        sql += f""",
at{k} AS MATERIALIZED (
  SELECT branch, item_name, y, z, growth, rate, cap * s AS c, cap * s * (1 - s) AS ja,
         t * cap * s * (1 - s) AS jb
  FROM (SELECT *, 1 / (1 + exp(-(growth + rate * t))) AS s
        FROM z_rows JOIN curve{k} USING (branch, item_name))),
side{k} AS (
  SELECT branch, item_name, i, sum(ja * z[i]) AS a, sum(jb * z[i]) AS b,
         sum((y - c) * z[i]) AS o
  FROM at{k}, unnest({terms}) u(i) GROUP BY ALL)"""
        if k == ROUNDS:
            break
        sql += f""",
own{k} AS (
  SELECT branch, item_name, sum(ja * ja) + {RIDGE} AS aa, sum(ja * jb) AS ab,
         sum(jb * jb) + {RIDGE} AS bb, sum(ja * (y - c)) - {RIDGE} * any_value(growth) AS oa,
         sum(jb * (y - c)) - {RIDGE} * any_value(rate) AS ob
  FROM at{k} GROUP BY branch, item_name),
matrix{k} AS (
  SELECT branch, item_name, list_concat(
      [list_concat(list_concat([any_value(aa), any_value(ab)], list(a ORDER BY i)), [any_value(oa)]),
       list_concat(list_concat([any_value(ab), any_value(bb)], list(b ORDER BY i)), [any_value(ob)])],
      list(list_concat(list_concat([a, b], line), [o]) ORDER BY i)) AS m
  FROM own{k} JOIN side{k} USING (branch, item_name) JOIN products USING (branch, item_name, i)
  GROUP BY branch, item_name),
{elimination(f"solved{k}", f"matrix{k}", p + 2)},
curve{k + 1} AS MATERIALIZED (
  SELECT branch, item_name, growth + greatest(-1, least(1, m[1][{p + 3}])) AS growth,
         rate + greatest(-1, least(1, m[2][{p + 3}])) AS rate
  FROM curve{k} JOIN (SELECT * FROM solved{k} WHERE j = {p + 3}) USING (branch, item_name))"""
    return sql + f""",
last_matrix AS (
  SELECT branch, item_name, list(list_concat(line, [o]) ORDER BY i) AS m
  FROM side{ROUNDS} JOIN products USING (branch, item_name, i) GROUP BY branch, item_name),
{elimination("last_solved", "last_matrix", p)},
model AS MATERIALIZED (
  SELECT *, list_transform(m, lambda line: line[{p + 1}]) AS weights
  FROM lines JOIN caps USING (branch, item_name) JOIN norms USING (branch, item_name)
  JOIN curve{ROUNDS} USING (branch, item_name)
  JOIN (SELECT branch, item_name, m FROM last_solved WHERE j = {p + 1})
    USING (branch, item_name))"""


def predicted(frame: str, regressors: bool = True, names: list[str] | None = None) -> str:
    """Predictions for table ``frame``: dates, series and regressors."""
    raw = ", ".join(raw_terms(names or [], regressors))
    return f"""predicted AS (
  SELECT date, CAST(round_even(abs(round(
           cap / (1 + exp(-(growth + rate * ({QUARTER} - first_quarter) / 4.0)))
           + list_sum(list_transform([{raw}],
               lambda v, k: weights[k] * (v - centre[k]) * scale[k])), 6)), 0)
           AS INT) AS prediction, item_name, branch, item_group
  FROM (SELECT {frame}.*, holiday FROM {frame} LEFT JOIN holidays USING (date)) f
  JOIN (SELECT * EXCLUDE (item_group) FROM model) m USING (branch, item_name))"""


FUTURE = """usual AS (
  SELECT avg(temperature_2m_max) AS usual_max, avg(temperature_2m_min) AS usual_min
  FROM training),
coming AS (
  SELECT CAST(last_date + ahead AS DATE) AS date, branch, item_name, item_group
  FROM lines JOIN eligible USING (branch, item_name),
       (SELECT CAST(unnest(range(1, 8)) AS INT) AS ahead)),
future AS (
  SELECT c.date, c.branch, item_name, item_group, isodow(c.date) >= 6 AS is_weekend,
         coalesce(w.temperature_2m_max, usual_max) AS temperature_2m_max,
         coalesce(w.temperature_2m_min, usual_min) AS temperature_2m_min,
         CAST(day(c.date) AS INT) AS day
  FROM coming c LEFT JOIN places p ON p.branch = c.branch
  LEFT JOIN weather w ON w.date = c.date AND w.latitude = p.latitude
                     AND w.longitude = p.longitude
  CROSS JOIN usual)"""


def forward(holidays: str = NO_HOLIDAYS, regressors: bool = True, where: str = "TRUE") -> str:
    """To follow WITH: the elimination calls itself."""
    names = HOLIDAY_NAMES if holidays == HOLIDAYS else []
    return "RECURSIVE " + ", ".join(
        [training(where), SPLIT, model("training", holidays, regressors), FUTURE,
         predicted("future", regressors, names)]
    )


BACKTEST = "RECURSIVE " + ", ".join(
    [training(), SPLIT, "train AS (SELECT * FROM split WHERE part = 'train')",
     "test AS (SELECT * FROM split WHERE part = 'test')", model("train"), predicted("test")]
)

MATCHED = BACKTEST + """, matched AS (
  SELECT DISTINCT date, item_name, branch, item_group, prediction, qty_sold,
         abs(qty_sold - prediction) AS absolute_error
  FROM predicted JOIN sales USING (date, item_name, branch, item_group))"""

NAIVE = MATCHED + """, naive AS (
  SELECT *, abs(qty_sold - lag(qty_sold) OVER (PARTITION BY branch, item_name
                                               ORDER BY date, item_group)) AS naive_error
  FROM matched)"""

SCORED = MATCHED + """, scored AS (
  SELECT m.*, CASE WHEN sd > 0 THEN (absolute_error - mean) / sd END AS zscore
  FROM matched m, (SELECT avg(absolute_error) AS mean, stddev_samp(absolute_error) AS sd
                   FROM matched)),
bucketed AS (
  SELECT *, CASE WHEN zscore < -1 THEN 'z < -1' WHEN zscore <= 1 THEN '-1 <= z <= 1'
                 WHEN zscore > 1 THEN 'z > 1' END AS bucket
  FROM scored)"""

LEDGER = """ledger AS (
  SELECT warehouse, item_code, posting_date, docstatus, voucher_type,
         5000 - sum(moved) OVER (PARTITION BY warehouse, item_code
                                 ORDER BY posting_date, docstatus, voucher_type
                                 ROWS UNBOUNDED PRECEDING) AS qty_after_transaction
  FROM (SELECT s_name AS warehouse, l_partkey AS item_code,
               CAST(l_shipdate AS DATE) AS posting_date,
               CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS docstatus,
               CASE l_returnflag WHEN 'N' THEN 'POS Invoice' WHEN 'A' THEN 'Stock Entry'
                                 ELSE 'Stock Reconciliation' END AS voucher_type,
               sum(l_quantity) AS moved
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)),
stocked AS (
  SELECT warehouse, lower(n_name) AS branch, p_name AS item_name, p_type AS item_group,
         posting_date, docstatus, voucher_type, qty_after_transaction
  FROM ledger JOIN part ON item_code = p_partkey JOIN supplier ON warehouse = s_name
  JOIN nation ON s_nationkey = n_nationkey)"""

BALANCE = LEDGER + """, balance AS (
  SELECT item_name, branch, item_group, posting_date AS date,
         CAST(trunc(min(qty_after_transaction)) AS INT) AS balance
  FROM stocked WHERE voucher_type = 'POS Invoice' GROUP BY item_name, branch, item_group, date)"""

STOCK_TODAY = """stock_today AS (
  SELECT warehouse, branch, item_name, min(qty_after_transaction) AS quantity_present_in_branch
  FROM stocked WHERE docstatus = 1
    AND posting_date = (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)
  GROUP BY warehouse, branch, item_name)"""

QUESTIONS = r"""questions AS (
  SELECT concat_ws('-', conv_id, turn) AS text_id, conv_id,
         trim(regexp_replace(lower(concat_ws(' ', text, CASE role
           WHEN 'user' THEN concat_ws(' ', 'how many', p_name, 'were sold at', lower(n_name))
           WHEN 'assistant' THEN concat_ws(' ', 'stock of', left(p_name, length(p_name) - 1))
           ELSE '' END)), '[\s\p{Z}]+', ' ', 'g')) AS text
  FROM conversations LEFT JOIN part ON conv_id = p_partkey
  LEFT JOIN supplier ON conv_id = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""

NAMES = QUESTIONS + f""", {SALES}, {BALANCE}, items AS (
  SELECT lower(item_name) AS name FROM sales UNION SELECT lower(item_name) FROM balance
  UNION SELECT lower(p_name) FROM part),
branches AS (SELECT branch AS name FROM sales UNION SELECT branch FROM balance)"""

MENTIONS = NAMES + """, mentions AS (
  SELECT text_id,
         coalesce((SELECT bool_or(contains(text, name)) FROM items), FALSE) AS has_item,
         coalesce((SELECT bool_or(contains(text, name)) FROM branches), FALSE) AS has_branch
  FROM questions)"""

# Edit distances count bytes here, so letters outside ASCII become one byte that fits no name.
LINK = NAMES + rf""", used AS (
  SELECT DISTINCT text_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS token
  FROM questions),
spelt AS (
  SELECT kind, name, unnest(list_distinct(regexp_extract_all(name, '[\p{{L}}\p{{N}}_]+'))) AS word
  FROM (SELECT 'item' AS kind, name FROM items UNION ALL SELECT 'branch', name FROM branches)),
alike AS (
  SELECT token, word
  FROM (SELECT DISTINCT token FROM used), (SELECT DISTINCT word FROM spelt)
  WHERE token = word
     OR (abs(length(token) - length(word)) <= 1
         AND 100 * (greatest(length(token), length(word)) - 1)
           >= {linking.SIMILAR_WORDS} * greatest(length(token), length(word))
         AND levenshtein(regexp_replace(token, '[^a-z0-9_]', '#', 'g'), word) <= 1)),
scored AS (
  SELECT text_id, kind, name, 100.0 * count(DISTINCT word) / any_value(n) AS score
  FROM used JOIN alike USING (token) JOIN spelt USING (word)
  JOIN (SELECT kind, name, count(*) AS n FROM spelt GROUP BY ALL) USING (kind, name)
  GROUP BY text_id, kind, name),
gathered AS (
  SELECT text_id,
    coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = 'item' AND score >= 60), '')
      AS found_items,
    coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = 'branch' AND score >= 40), '')
      AS found_branches,
    coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = 'item' AND score >= 40), '')
      AS near_items
  FROM questions LEFT JOIN scored USING (text_id) GROUP BY text_id),
linked AS (
  SELECT text_id, found_items, found_branches,
         CASE WHEN found_items = '' AND found_branches = '' THEN near_items ELSE '' END
           AS suggested_items
  FROM gathered),
answered AS (
  SELECT *, CASE
    WHEN found_items <> '' OR found_branches <> '' THEN
      CASE WHEN found_items <> '' THEN 'Items found in your query: ' || found_items || '. '
           ELSE '' END ||
      CASE WHEN found_branches <> ''
           THEN 'Branches found in your query: ' || found_branches || '. ' ELSE '' END
    WHEN suggested_items <> '' THEN 'Did you mean these items: ' || suggested_items || '?'
    ELSE '{linking.NOTHING_FOUND}' END AS context
  FROM linked)"""

EDGE = r"[^\p{L}\p{N}_]"
VALID = (
    f"NOT regexp_matches(text, '(?i)(^|{EDGE})({'|'.join(RESTRICTED_KEYWORDS)})({EDGE}|$)')"
)

SCREEN = """abuse AS (
  SELECT text_id, toxic * 0.9 > 0.6 OR (1 - quality) * 0.5 > 0.6 AS is_abusive
  FROM questions JOIN labels ON conv_id = doc_id)"""

BRANCH_LIST, GROUP_LIST, ITEM_LIST = quoted(c.BRANCHES), quoted(c.GROUPS), quoted(c.ITEMS)
IN_RANGE = f"date BETWEEN DATE '{c.RANGE[0]}' AND DATE '{c.RANGE[1]}'"
CHOSEN = f"{IN_RANGE} AND branch IN ({BRANCH_LIST}) AND item_group IN ({GROUP_LIST})"
SALES_COLUMNS = "date, branch, item_group, item_name, qty_sold"


def ranking(where: str, top: bool, what: str = "item_name, sum(qty_sold) AS qty_sold",
            group: str = "GROUP BY item_name", ties: str = "item_name") -> str:
    return (
        f"WITH {SALES} SELECT {what} FROM sales WHERE {where} {group} "
        f"ORDER BY qty_sold {'DESC' if top else 'ASC'}, {ties} LIMIT 5"
    )


def daily(top: bool) -> str:
    where = f"branch = '{c.BRANCH}' AND date = DATE '{c.DAY}'"
    return ranking(where, top, "item_name, item_group, qty_sold", "", "item_name, item_group")


def weekly(top: bool) -> str:
    return ranking(
        f"branch = '{c.BRANCH}' AND date_trunc('week', date) = date_trunc('week', DATE '{c.DAY}')",
        top,
    )


def monthly(top: bool) -> str:
    return ranking(
        f"branch = '{c.BRANCH}' AND item_group IN ({GROUP_LIST}) AND "
        f"date_trunc('month', date) = date_trunc('month', DATE '{c.DAY}')",
        top,
    )


def branches(order: str) -> str:
    return (
        f"WITH {SALES} SELECT branch, sum(qty_sold) AS qty_sold FROM sales GROUP BY branch "
        f"ORDER BY qty_sold {order}, branch LIMIT 5"
    )


def today_view(kind: str) -> str:
    as_of = "(SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)"
    before = f"sales.date < {as_of}"
    return f"""WITH {forward(where=before)}, {LEDGER}, {STOCK_TODAY}, yesterday AS (
      SELECT branch, item_name, item_group, qty_sold FROM (
        SELECT *, row_number() OVER (PARTITION BY branch, item_name ORDER BY item_group) AS place
        FROM sales WHERE date = {as_of} - 1) WHERE place = 1),
    planned AS (SELECT * FROM predicted WHERE date = {as_of}),
    in_hand AS (SELECT branch, item_name,
                       sum(quantity_present_in_branch) AS quantity_present_in_branch
                FROM stock_today GROUP BY ALL)
    SELECT DISTINCT {as_of} AS date, branch, coalesce(y.item_group, p.item_group) AS item_group,
           item_name, qty_sold AS previous_day_sales, prediction AS today_forecast,
           quantity_present_in_branch
    FROM yesterday y {kind} JOIN planned p USING (branch, item_name)
    LEFT JOIN in_hand USING (branch, item_name)"""


FORECAST_COLUMNS = "SELECT date, prediction, item_name, branch, item_group FROM predicted"
FORWARD_SQL = f"WITH {forward()} {FORECAST_COLUMNS}"
YEAR_SALES = f"year(date) = {c.YEAR}"


CHECK_SQL: dict[str, str] = {
    "scan_invoice_items": f"""WITH {POS}
        SELECT date AS creation, item_group, item_name, warehouse, qty FROM pos""",
    "csv_roundtrip_forecast": FORWARD_SQL,
    "branch_dim": f"WITH {PLACES} SELECT branch, city, latitude, longitude FROM places",
    "branch_map": """SELECT s_name AS code, lower(n_name) AS branch
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "weather_rows": f"WITH {WEATHER} SELECT * FROM weather",
    "filter_range_selection": f"""WITH {SALES} SELECT {SALES_COLUMNS} FROM sales
        WHERE {CHOSEN} AND item_name IN ({ITEM_LIST})""",
    "filter_range_selection_table": f"""WITH {SALES} SELECT {SALES_COLUMNS} FROM sales
        WHERE {CHOSEN}
          AND item_name IN (SELECT p_name FROM part WHERE p_retailprice >= 990)""",
    "sales_history_range": f"""WITH {SALES} SELECT date AS "Date", item_name AS "Item",
        item_group AS "Group", qty_sold AS quantity_sold, branch FROM sales
        WHERE {CHOSEN} AND item_name IN ({ITEM_LIST})""",
    "sales_history_single_day": f"""WITH {SALES} SELECT date AS "Date", item_name AS "Item",
        item_group AS "Group", qty_sold AS quantity_sold, branch FROM sales
        WHERE date = DATE '1998-02-28' AND branch IN ({BRANCH_LIST})
          AND item_group IN ({GROUP_LIST}, 'LARGE', 'ECONOMY')
          AND item_name IN ('red ring', 'small gear', 'blue bolt', 'old rod', 'cold ring',
                            'hot rod', 'new plate')""",
    "weekly_forecast_view": f"""WITH {forward()} SELECT date AS "Date", item_name AS "Item",
        item_group AS "Group", prediction AS model_prediction, branch FROM predicted
        WHERE branch IN ({BRANCH_LIST}) AND item_group IN ({GROUP_LIST})""",
    "exclude_items_dates": f"""WITH {SALES}, {PLACES} SELECT {SALES_COLUMNS} FROM sales
        WHERE item_name NOT IN ({ITEM_LIST})
          AND date NOT IN (DATE '{c.RANGE[0]}', DATE '{c.RANGE[1]}', DATE '{c.DAY}')
          AND branch NOT IN (SELECT branch FROM places WHERE longitude = 0)""",
    "facet_branches": f"WITH {SALES} SELECT DISTINCT branch FROM sales",
    "facet_groups": f"WITH {SALES} SELECT DISTINCT item_group FROM sales",
    "facet_items_by_group": f"""WITH {SALES} SELECT DISTINCT item_name FROM sales
        WHERE item_group = '{c.GROUPS[0]}'""",
    "available_range": f"""WITH {SALES}
        SELECT min(date) AS min_date, max(date) AS max_date FROM sales""",
    "clamp_range": f"""WITH {SALES}, ranges AS (
        SELECT branch, item_name, min(date) AS start_date, max(date) AS end_date
        FROM sales WHERE {IN_RANGE} GROUP BY ALL)
        SELECT *, CASE WHEN end_date - start_date > 60
                       THEN CAST(end_date - INTERVAL 2 MONTH AS DATE) ELSE start_date END
                  AS clamped_start FROM ranges""",
    "map_branches": f"""WITH {ROLLUP}
        SELECT date, item_group, item_name, qty_sold, branch FROM rolled""",
    "map_branches_unknown": f"""WITH {ROLLUP} SELECT date, item_group, item_name, qty_sold,
        CASE WHEN branch = '{c.BRANCH}' THEN warehouse ELSE branch END AS branch FROM rolled""",
    "unknown_branches": """SELECT branch FROM (
          SELECT n_name AS branch FROM nation UNION ALL SELECT r_name FROM region)
        WHERE lower(branch) NOT IN (
          SELECT lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "enrich_branch": f"""WITH {SALES}, {PLACES}
        SELECT {SALES_COLUMNS}, city, latitude, longitude
        FROM sales LEFT JOIN places USING (branch)""",
    "enrich_weather": f"""WITH {SALES}, {WEATHER}
        SELECT sales.date, branch, item_group, item_name, qty_sold, city, places.latitude,
               places.longitude, temperature_2m_max, temperature_2m_min
        FROM sales LEFT JOIN places USING (branch)
        LEFT JOIN weather ON weather.date = sales.date AND weather.latitude = places.latitude
                         AND weather.longitude = places.longitude""",
    "distinct_locations": f"""WITH {SALES}, {PLACES} SELECT DISTINCT latitude, longitude
        FROM sales LEFT JOIN places USING (branch)""",
    "daily_total_window": f"""WITH {ROLLUP} SELECT DISTINCT date, item_group, item_name, branch,
        sum(qty_sold) OVER (PARTITION BY branch, item_name, date) AS qty_sold FROM rolled""",
    "calendar_features": f"""WITH {SALES} SELECT {SALES_COLUMNS}, dayname(date) AS day,
        isodow(date) >= 6 AS is_weekend FROM sales""",
    "encode_day": f"""WITH {SALES}, labels AS (
        SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS code
        FROM (SELECT DISTINCT dayname(date) AS day FROM sales))
        SELECT {SALES_COLUMNS}, code AS day
        FROM sales JOIN labels ON dayname(date) = labels.day""",
    "fill_mean_temperature": f"""WITH {ENRICHED}, {MEANS}
        SELECT {SALES_COLUMNS}, day, is_weekend,
               round(coalesce(temperature_2m_max, mean_max), 4) AS temperature_2m_max,
               round(coalesce(temperature_2m_min, mean_min), 4) AS temperature_2m_min
        FROM enriched, means""",
    "ffill_regressor": f"""WITH {ENRICHED} SELECT {SALES_COLUMNS}, day, is_weekend,
        last_value(temperature_2m_max IGNORE NULLS) OVER (
          PARTITION BY branch, item_name ORDER BY date, item_group
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS temperature_2m_max,
        temperature_2m_min FROM enriched""",
    "preprocess": f"""WITH {ENRICHED}, {MEANS}, labels AS (
        SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS code
        FROM (SELECT DISTINCT day FROM enriched))
        SELECT {SALES_COLUMNS}, code AS day, is_weekend,
               round(coalesce(temperature_2m_max, mean_max), 4) AS temperature_2m_max,
               round(coalesce(temperature_2m_min, mean_min), 4) AS temperature_2m_min
        FROM enriched JOIN labels USING (day), means""",
    "daily_rollup": f"""WITH {ROLLUP}
        SELECT date, item_group, item_name, warehouse, qty_sold FROM rolled""",
    "incremental_rollup": f"""WITH {ROLLUP}
        SELECT date, item_group, item_name, warehouse, qty_sold FROM rolled
        WHERE date >= DATE '{c.CUT}' - 1""",
    "resum_after_mapping": f"WITH {SALES} SELECT {SALES_COLUMNS} FROM sales",
    "dedup_first": f"""WITH {SALES} SELECT {SALES_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY branch, item_name, date ORDER BY item_group)
               AS place FROM sales) WHERE place = 1""",
    "ingest_upsert": f"WITH {SALES} SELECT {SALES_COLUMNS} FROM sales",
    "stream_daily_rollup": """SELECT CAST(ts AS DATE) AS date, event_type,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS qty_sold
        FROM events GROUP BY ALL""",
    "branch_totals": f"""WITH {SALES}
        SELECT branch, sum(qty_sold) AS qty_sold FROM sales GROUP BY branch""",
    "branch_count": f"WITH {SALES} SELECT count(DISTINCT branch) AS branches FROM sales",
    "top5_branches": branches("DESC"),
    "bottom5_branches": branches("ASC"),
    "group_summary": f"""WITH {SALES}
        SELECT item_group, coalesce(sum(qty_sold), 0) AS qty_sold,
               count(DISTINCT item_name) AS unique_items
        FROM (SELECT unnest([{quoted(c.GROUPS_WITH_UNKNOWN)}]) AS item_group)
        LEFT JOIN (SELECT * FROM sales WHERE branch = '{c.BRANCH}') USING (item_group)
        GROUP BY item_group""",
    "chart_qty_by_item": f"""WITH {SALES}
        SELECT item_name, item_group, sum(qty_sold) AS qty_sold FROM sales
        WHERE branch = '{c.BRANCH}' AND item_group IN ({GROUP_LIST}) GROUP BY ALL""",
    "daily_top5": daily(True),
    "daily_bottom5": daily(False),
    "weekly_top5": weekly(True),
    "weekly_bottom5": weekly(False),
    "monthly_top5": monthly(True),
    "monthly_bottom5": monthly(False),
    "enriched_upsert": f"""WITH {ENRICHED} SELECT * REPLACE (
  round(temperature_2m_max, 4) AS temperature_2m_max,
  round(temperature_2m_min, 4) AS temperature_2m_min) FROM enriched""",
    "stock_unknown_choice": f"""SELECT 'branch' AS kind, name, 'no warehouse of this branch' AS reason
  FROM (SELECT unnest([{quoted([*c.BRANCHES, "Europe", "NATION_3", "nowhere"])}]) AS name)
  WHERE lower(name) NOT IN (SELECT lower(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)
  UNION ALL SELECT 'item', name, 'no item of this name'
  FROM (SELECT unnest([{quoted([*c.ITEMS, "red rign", "Blue Bolt"])}]) AS name)
  WHERE name NOT IN (SELECT p_name FROM part)""",
    "stream_sales": f"""WITH {ENRICHED} SELECT * REPLACE (
  round(temperature_2m_max, 4) AS temperature_2m_max,
  round(temperature_2m_min, 4) AS temperature_2m_min) FROM enriched""",
    "stream_ledger": f"""SELECT batch, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_late,
  CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
  FROM (SELECT l_shipdate, CAST(CASE {" ".join(
      f"WHEN l_shipdate < DATE '{end}' THEN {k}" for k, end in enumerate(c.ARRIVALS[1:])
  )} END AS BIGINT) AS batch FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey) GROUP BY batch""",
    "series_statistics": f"""WITH {SALES} SELECT branch, item_name, count(*) AS n_rows,
  count(qty_sold) AS n_values, max(date) AS last_date FROM sales GROUP BY ALL""",
    "forecast_training_set": f"""WITH {training()} SELECT {SALES_COLUMNS}, day, is_weekend,
        round(temperature_2m_max, 4) AS temperature_2m_max,
        round(temperature_2m_min, 4) AS temperature_2m_min FROM training""",
    "train_test_split": f"WITH {training()}, {SPLIT} SELECT {SALES_COLUMNS}, part FROM split",
    "eligible_series": f"WITH {training()}, {SPLIT} SELECT * FROM eligible",
    "series_cap_mode": f"""WITH {training()}, {SPLIT},
        train AS (SELECT * FROM split WHERE part = 'train') {CAP.format(rows='train')}""",
    "future_frame": f"""WITH {training()}, {SPLIT}, {NO_HOLIDAYS},
        caps AS ({CAP.format(rows='training')}),
        lines AS (SELECT branch, item_name, max(date) AS last_date, '' AS item_group
                  FROM training GROUP BY ALL), {FUTURE}, frame AS (
        SELECT date, branch, item_name, is_weekend, temperature_2m_max, temperature_2m_min, day
        FROM training UNION ALL
        SELECT date, branch, item_name, is_weekend, temperature_2m_max, temperature_2m_min, day
        FROM future)
        SELECT date, branch, item_name, cap, is_weekend,
               round(temperature_2m_max, 4) AS temperature_2m_max,
               round(temperature_2m_min, 4) AS temperature_2m_min, day
        FROM frame JOIN caps USING (branch, item_name)
        JOIN eligible USING (branch, item_name)""",
    "series_forecast": FORWARD_SQL,
    "series_forecast_trend": f"WITH {forward(regressors=False)} {FORECAST_COLUMNS}",
    "series_forecast_holidays": f"WITH {forward(HOLIDAYS)} {FORECAST_COLUMNS}",
    "series_backtest": f"WITH {BACKTEST} {FORECAST_COLUMNS}",
    "forecast_gate": FORWARD_SQL,
    "forecast_errors": f"WITH {MATCHED} SELECT * FROM matched",
    "naive_errors": f"WITH {NAIVE} SELECT * FROM naive",
    "mase": f"""WITH {NAIVE} SELECT round(avg(absolute_error), 4) AS mae,
        round(avg(naive_error), 4) AS naive_mae,
        round(avg(absolute_error) / nullif(avg(naive_error), 0), 4) AS mase FROM naive""",
    "relative_error": f"""WITH {MATCHED} SELECT *,
        round(absolute_error / nullif(qty_sold, 0) * 100, 4) AS relative_error FROM matched""",
    "zscore_error": f"WITH {SCORED} SELECT * REPLACE (round(zscore, 4) AS zscore) FROM scored",
    "zscore_buckets": f"""WITH {SCORED} SELECT bucket, count(*) AS rows FROM bucketed
        WHERE bucket IS NOT NULL GROUP BY bucket""",
    "zscore_bucket_rows": f"""WITH {SCORED} SELECT bucket, date AS "Date", item_name AS "Item",
        item_group AS "Group", qty_sold AS quantity_sold, prediction AS model_prediction,
        round(zscore, 4) AS zscore_error, branch FROM bucketed WHERE bucket IS NOT NULL""",
    "melt_actual_vs_forecast": f"""WITH {MATCHED}
        SELECT date AS "Date", 'Quantity Sold' AS "Metric", qty_sold AS "Value"
        FROM matched WHERE branch IN ({BRANCH_LIST}) UNION ALL
        SELECT date, 'Model Prediction', CAST(prediction AS DOUBLE)
        FROM matched WHERE branch IN ({BRANCH_LIST})""",
    "stock_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "stock_min_range": f"""WITH {LEDGER} SELECT branch, item_name, posting_date,
        CAST(trunc(min(qty_after_transaction)) AS INT) AS balance FROM stocked
        WHERE docstatus = 1 AND branch IN ({BRANCH_LIST}) AND item_name IN ({ITEM_LIST})
          AND posting_date BETWEEN DATE '{c.RANGE[0]}' AND DATE '{c.RANGE[1]}'
        GROUP BY warehouse, branch, item_name, posting_date""",
    "stock_min_day": f"""WITH {LEDGER} SELECT branch, item_name, posting_date,
        CAST(trunc(min(qty_after_transaction)) AS INT) AS balance FROM stocked
        WHERE docstatus = 1 AND branch IN ({BRANCH_LIST}) AND posting_date = DATE '{c.DAY}'
        GROUP BY warehouse, branch, item_name, posting_date""",
    "stock_today": f"""WITH {LEDGER}, {STOCK_TODAY}
        SELECT branch, item_name, quantity_present_in_branch FROM stock_today""",
    "balance_view": f"""WITH {LEDGER} SELECT item_name AS "Item", branch AS "Branch",
        posting_date AS "Date", CAST(trunc(min(qty_after_transaction)) AS INT) AS "Balance"
        FROM stocked
        WHERE docstatus = 1 AND branch IN ({BRANCH_LIST}) AND item_name IN ({ITEM_LIST})
          AND posting_date BETWEEN DATE '1998-02-28' AND DATE '1998-04-30'
        GROUP BY warehouse, branch, item_name, posting_date""",
    "price_list": """SELECT p_name AS item_name,
        CAST(round_even(max(p_retailprice), 0) AS INT) AS takeaway_price
        FROM part GROUP BY p_name""",
    "today_forecast": today_view("LEFT"),
    "today_forecast_full": today_view("FULL"),
    "ask_top_branch": f"""WITH {SALES} SELECT branch, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY branch ORDER BY qty_sold DESC, branch LIMIT 1""",
    "ask_group_year_qty": f"""WITH {SALES} SELECT sum(qty_sold) AS qty_sold FROM sales
        WHERE lower(item_group) = 'promo' AND {YEAR_SALES}""",
    "ask_item_year_avg": f"""WITH {SALES} SELECT round(avg(qty_sold), 4) AS avg_qty_sold
        FROM sales WHERE item_name = '{c.ITEM}' AND {YEAR_SALES}""",
    "ask_peak_date": f"""WITH {SALES} SELECT date, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY date ORDER BY qty_sold DESC, date LIMIT 1""",
    "ask_top_group": f"""WITH {SALES}
        SELECT lower(item_group) AS item_group, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY ALL ORDER BY qty_sold DESC, item_group LIMIT 1""",
    "ask_item_branch_week": f"""WITH {SALES}
        SELECT date, item_name, branch, sum(qty_sold) AS qty_sold FROM sales
        WHERE item_name = 'large plate' AND branch = '{c.BRANCH}'
          AND date BETWEEN DATE '1999-11-01' AND DATE '1999-11-07'
        GROUP BY ALL ORDER BY date LIMIT 10""",
    "ask_item_branch_day": f"""WITH {SALES}
        SELECT item_name, branch, sum(qty_sold) AS qty_sold FROM sales
        WHERE item_name = 'large plate' AND branch = '{c.BRANCH}' AND date = DATE '1999-11-04'
        GROUP BY ALL""",
    "ask_group_balance_report": f"""WITH {BALANCE}
        SELECT item_name, lower(item_group) AS item_group, branch, date, balance FROM balance
        WHERE item_group = 'PROMO' AND branch = '{c.BRANCH}' AND date = DATE '2000-01-27'""",
    "ask_item_balance": f"""WITH {BALANCE} SELECT item_name, branch, date, balance FROM balance
        WHERE item_name = 'large plate' AND branch = '{c.BRANCH}' AND date = DATE '2000-01-27'""",
    "ask_item_price": f"""SELECT p_name AS item_name,
        CAST(round_even(max(p_retailprice), 0) AS INT) AS price, 'PKR' AS currency
        FROM part WHERE p_name = '{c.ITEM}' GROUP BY p_name""",
    "normalize_names": """SELECT p_partkey, '  ' || upper(p_name[1]) ||
          substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) ||
          substr(split_part(p_name, ' ', 2), 2) || ' (' || p_brand || ') ' AS raw_name,
          p_name || ' ' || lower(p_brand) AS item_name FROM part""",
    "catalog_items": f"""WITH {SALES}, {BALANCE}
        SELECT item_name FROM sales UNION SELECT item_name FROM balance
        UNION SELECT p_name FROM part""",
    "catalog_branches": f"""WITH {SALES}, {BALANCE}
        SELECT branch FROM sales UNION SELECT branch FROM balance""",
    "text_normalize": f"WITH {QUESTIONS} SELECT text_id, text FROM questions",
    "text_mentions": f"WITH {MENTIONS} SELECT * FROM mentions",
    "fuzzy_entity_link": f"WITH {LINK} SELECT * FROM answered",
    "keyword_screen": f"WITH {QUESTIONS} SELECT text_id, {VALID} AS is_valid FROM questions",
    "score_screen": f"WITH {QUESTIONS}, {SCREEN} SELECT * FROM abuse",
    "answer_route": f"""WITH {LINK}, {MENTIONS[len(NAMES) + 2:]}, {SCREEN}, judged AS (
        SELECT text_id, {VALID} AS is_valid, coalesce(is_abusive, FALSE) AS is_abusive,
               has_item OR has_branch AS named, context
        FROM questions JOIN mentions USING (text_id) JOIN answered USING (text_id)
        LEFT JOIN abuse USING (text_id))
        SELECT text_id, CASE WHEN NOT is_valid THEN 'unsafe' WHEN is_abusive THEN 'abusive'
                             WHEN named THEN 'linked' ELSE 'passed on' END AS route,
               CASE WHEN NOT is_valid THEN '{linking.UNSAFE}'
                    WHEN is_abusive THEN '{linking.ABUSIVE}'
                    WHEN named THEN context END AS answer
        FROM judged""",
}
