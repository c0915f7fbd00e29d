"""DuckDB SQL of the general problems, written from their statements."""

from __future__ import annotations

from ..operators.units import TOTAL_ROW
from ..operators.wide_table import AGING_PATTERNS, PLACEHOLDERS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACES = "'   ', '   '"
_THOUSAND = r"(?i)(?:(?:^|[^0-9 ]) *\bthousands?\b|\btsd\b|\$ ?k\b|\bk (?:usd|\$)|\busd k\b|(?:^|[^0-9,.])'?000'?s?\b|\bx ?1,?000\b)"
_MILLION = r"(?i)(?:(?:^|[^0-9 ]) *\bmillions?\b|\bmio\b|\bmm\b|\$ ?mm?\b|\bm\$|\b(?:us\$|usd) ?mm?\b)"
_BPS = r"(?i)(?:\bbps?\b|\bb\.p\.|\bbasis points?\b)"
_NOTE = r"(?i)^\s*(?:\*|note\s*:|basis\s*:|n\.\s?b\.)"


def _stated(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_q(_MILLION)}) THEN 6 WHEN regexp_matches({c}, {_q(_THOUSAND)}) THEN 3 END"


def _amounts(src: str, field: str, name: str, header: str, pct: str) -> str:
    number = r"^(?:usd|us\$|\$)? ?(\d[\d, ]*(?:\.\d+)?) ?([^\d].*|'000s?)?$"
    text = f"trim(regexp_replace(lower(translate({field}, {_SPACES})), '\\s+', ' ', 'g'))"
    return f"""
SELECT '{src}' AS src_table, row_id, '{field}' AS field, CAST(round(n * CAST(pow(10, coalesce(own, CASE WHEN total AND lvl IS NOT NULL THEN coalesce(said, 0) - shift END, said, 0)) AS DECIMAL(18,6))) AS BIGINT) AS value_key,
       coalesce(own, CASE WHEN total AND lvl IS NOT NULL THEN coalesce(said, 0) - shift END, said, 0) <> 0 AS odd
FROM (SELECT *, list_reduce([0, 3, 6, -3, -6], lambda a, b: CASE WHEN abs(y - b) < abs(y - a) THEN b ELSE a END) AS shift FROM (
    SELECT p.*, f.said, f.lvl, log10(CASE WHEN n > 0 THEN n END) + coalesce(f.said, 0) - f.lvl AS y FROM (
        SELECT row_id, file_id, CAST(replace(replace(regexp_extract(t, {_q(number)}, 1), ' ', ''), ',', '') AS DECIMAL(20,6)) AS n, total,
            CASE WHEN regexp_matches(trim(regexp_extract(t, {_q(number)}, 2)), '^(?:k|thousand|\\(000s\\)|usd''000)$') THEN 3 WHEN regexp_matches(trim(regexp_extract(t, {_q(number)}, 2)), '^(?:m|mm|mio|million)$') THEN 6 END AS own
        FROM (SELECT row_id, file_id, {text} AS t, coalesce(regexp_matches({name}, {_q(TOTAL_ROW)}), false) AS total FROM {src}) WHERE regexp_matches(t, {_q(number)})) p
    JOIN (SELECT file_id, max(said) AS said, avg(CASE WHEN own IS NULL AND NOT total AND n > 0 THEN log10(n) - log10(CASE WHEN pc > 0 THEN pc / 100 END) END) + coalesce(max(said), 0) AS a,
              log10(sum(CASE WHEN own IS NULL AND NOT total THEN n END)) + coalesce(max(said), 0) AS b, avg(CASE WHEN own IS NOT NULL AND NOT total AND n > 0 THEN log10(n) + own - log10(CASE WHEN pc > 0 THEN pc / 100 END) END) AS c,
              log10(sum(CASE WHEN own IS NOT NULL AND NOT total THEN n * pow(10, own) END)) AS d, coalesce(a, c, b, d) AS lvl
          FROM (SELECT file_id, total, pc, said, CASE WHEN regexp_matches(t, {_q(number)}) THEN CAST(replace(replace(regexp_extract(t, {_q(number)}, 1), ' ', ''), ',', '') AS DOUBLE) END AS n,
                    CASE WHEN regexp_matches(trim(regexp_extract(t, {_q(number)}, 2)), '^(?:k|thousand|\\(000s\\)|usd''000)$') THEN 3 WHEN regexp_matches(trim(regexp_extract(t, {_q(number)}, 2)), '^(?:m|mm|mio|million)$') THEN 6 END AS own
                FROM (SELECT file_id, {text} AS t, coalesce(regexp_matches({name}, {_q(TOTAL_ROW)}), false) AS total, TRY_CAST(replace({pct}, '%', '') AS DOUBLE) AS pc,
                          coalesce({_stated(header)}, {_stated("sheet_title")}, CASE WHEN regexp_matches({name}, {_q(_NOTE)}) THEN {_stated(name)} END) AS said FROM {src})) GROUP BY file_id) f USING (file_id)))
"""


_RATE = r"^(\d[\d,]*(?:\.\d+)?)(?: (\d+)/([1-9]\d*))? ?([^\d].*)?$"
_RATES = f"""
SELECT 'debt_schedule' AS src_table, row_id, 'interest_rate' AS field, CAST(round(n * unit * times * 1000) AS BIGINT) AS value_key, unit <> 1 OR times <> 1 AS odd FROM (
    SELECT row_id, n, times, CASE WHEN regexp_matches(u, '^(?:bps?|b\\.p\\.|basis points?)') THEN 0.01 WHEN regexp_matches(u, '^(?:%|percent|per cent|pct)') THEN 1 WHEN said IS NOT NULL THEN 0.01 WHEN n < 1 AND n <> 0 THEN 100 ELSE 1 END AS unit FROM (
        SELECT row_id, file_id, u, CAST(replace(regexp_extract(t, {_q(_RATE)}, 1), ',', '') AS DOUBLE) + coalesce(TRY_CAST(nullif(regexp_extract(t, {_q(_RATE)}, 2), '') AS DOUBLE) / TRY_CAST(nullif(regexp_extract(t, {_q(_RATE)}, 3), '') AS DOUBLE), 0) AS n,
            CASE WHEN regexp_matches(u, '/ ?mo\\b|per month|p\\.m\\.|monthly') THEN 12 WHEN regexp_matches(u, 'quarter') THEN 4 ELSE 1 END AS times
        FROM (SELECT row_id, file_id, t, trim(regexp_extract(t, {_q(_RATE)}, 4)) AS u FROM (SELECT row_id, file_id, trim(regexp_replace(lower(translate(interest_rate, {_SPACES})), '\\s+', ' ', 'g')) AS t FROM debt_schedule) WHERE regexp_matches(t, {_q(_RATE)})))
    JOIN (SELECT file_id, max(CASE WHEN regexp_matches(sheet_title, {_q(_BPS)}) OR (regexp_matches(instrument, {_q(_NOTE)}) AND regexp_matches(instrument, {_q(_BPS)})) THEN 1 END) AS said FROM debt_schedule GROUP BY 1) USING (file_id))
"""

P2_SQL = f"""
SELECT src_table, row_id, field, value_key FROM (
{_amounts("revenue_breakdown", "revenue", "customer", "revenue_header", "pct_of_revenue")} UNION ALL
{_amounts("debt_schedule", "principal", "instrument", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")} UNION ALL {_RATES}) WHERE odd
"""

_ATTR = "CASE " + " ".join(f"WHEN regexp_full_match(label, {_q(p)}) THEN {_q(a)}" for a, p in AGING_PATTERNS.items()) + " END"
P3_SQL = f"""
WITH r AS (SELECT file_id, row_id, loaded_at, regexp_replace(regexp_replace(trim(regexp_replace(translate(lower(metric), '   ‐‑‒–—−_', '   ------ '), '\\s+', ' ', 'g')), ' ?[:*]+$', ''), ' ?- ?', '-', 'g') AS label,
    trim(regexp_replace(translate(value, '   −', '   -'), '\\s+', ' ', 'g')) AS t FROM ar_aging WHERE file_id IS NOT NULL),
a AS (SELECT file_id, row_id, loaded_at, t, {_ATTR} AS field_name FROM r WHERE t IS NOT NULL AND lower(t) NOT IN ({", ".join(map(_q, PLACEHOLDERS))})),
k AS (SELECT a.*, data_type, regexp_replace(lower(t), 'us\\$|usd|\\$|%|percent|pct\\.?|days?|\\s', '', 'g') AS p FROM a JOIN aging_fields USING (field_name)),
n AS (SELECT *, regexp_replace(p, '^[-(]+|[-)]+$', '', 'g') AS g FROM k),
m AS (SELECT *, CASE WHEN regexp_full_match(g, '(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)?(?:\\.\\d+)?') AND regexp_matches(g, '\\d') THEN CAST(replace(g, ',', '') AS DECIMAL(28,6)) END * CASE WHEN regexp_matches(p, '^\\(.*\\)$|^-|-$') THEN -1 ELSE 1 END AS num FROM n),
v AS (SELECT file_id, field_name, loaded_at, row_id, CASE WHEN data_type IN ('amount', 'integer') THEN CAST(CAST(round(num) AS BIGINT) AS VARCHAR) WHEN data_type = 'percent' THEN CAST(CAST(round(num * 100) AS BIGINT) AS VARCHAR)
    WHEN data_type = 'decimal' THEN CAST(CAST(round(num * 10) AS BIGINT) AS VARCHAR) WHEN data_type = 'text' THEN upper(t)
    WHEN data_type = 'date' THEN strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%B %d, %Y'), try_strptime(t, '%d %b %Y')), '%Y-%m-%d') END AS value_key FROM m)
SELECT file_id, field_name, arg_max(value_key, (loaded_at, row_id)) AS value_key FROM v WHERE value_key IS NOT NULL GROUP BY 1, 2
"""

_SQL_TYPES = {"amount": "BIGINT", "integer": "BIGINT", "percent": "DOUBLE", "decimal": "DOUBLE", "date": "VARCHAR", "text": "VARCHAR"}
_TENS = {"percent": 100, "decimal": 10}
_KINDS = {
    "top_customer_pct": "percent", "top5_pct": "percent", "invoice_count": "integer", "customer_count": "integer", "as_of_date": "date", "currency_code": "text", "dso_days": "decimal",
}


def _wide_column(a: str) -> str:
    kind = _KINDS.get(a, "amount")
    cell = f"max(value_key) FILTER (WHERE field_name = '{a}')"
    return f"CAST({f'CAST({cell} AS DECIMAL(18,0)) / {_TENS[kind]}' if kind in _TENS else cell} AS {_SQL_TYPES[kind]}) AS {a}"


P3_WIDE_SQL = f"SELECT file_id, {', '.join(map(_wide_column, AGING_PATTERNS))} FROM ({P3_SQL}) GROUP BY file_id"

_FIELD = r'"(?:[^"]|"")*"|[^",]*'


def _records(src: str, header: str, n: int, kinds: list[str], out: str) -> str:
    amount = r"\s*\$?\s*(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\((?:\$\s*)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\))\s*"
    def test(kind: str, v: str) -> str:
        return {
            "name": f"trim({v}) <> ''",
            "amount": f"regexp_full_match({v}, {_q(amount)})",
            "optional": f"(trim({v}) = '' OR regexp_full_match({v}, {_q(amount)}))",
            "percent": rf"regexp_full_match({v}, '\s*-?(?:\d+(?:\.\d*)?|\.\d+)\s*%?\s*')",
            "date": rf"(CASE WHEN regexp_full_match(trim({v}), '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime(trim({v}), '%Y-%m-%d') WHEN regexp_full_match(trim({v}), '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime(trim({v}), '%m/%d/%Y') END) IS NOT NULL",
        }[kind]

    good = " AND ".join(test(k, f"v[{i + 1}]") for i, k in enumerate(kinds))
    return f"""
SELECT {out}, CASE WHEN NOT quoted THEN 'quoting' WHEN broken OR len(f) <> {n} THEN 'column_count' WHEN NOT ({good}) THEN 'invalid_value' END AS reason FROM (
    SELECT line_id, file_id, regexp_full_match(c0, {_q(f"(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*")}) AS quoted, regexp_extract_all(c0 || ',', {_q(f"(?s)({_FIELD}),")}, 1) AS f, len(list_filter(f, lambda x: NOT starts_with(x, '"') AND regexp_matches(x, '[\\r\\n]'))) > 0 AS broken,
        list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS v
    FROM (SELECT l.*, first_line FROM {src} l LEFT JOIN (SELECT file_id, min(line_no) AS first_line FROM {src} WHERE trim(lower(c0)) = lower({_q(header)}) GROUP BY 1) USING (file_id))
    WHERE c0 IS NOT NULL AND NOT regexp_full_match(c0, '[,\\s]*') AND NOT starts_with(ltrim(c0), 'Note') AND NOT starts_with(ltrim(c0), '*') AND trim(lower(c0)) <> lower({_q(header)}) AND (first_line IS NULL OR line_no > first_line))
"""


def _bad(src: str, header: str, n: int, kinds: list[str]) -> str:
    return _records(src, header, n, kinds, f"'{src}' AS src_table, line_id")


def _amount(v: str) -> str:
    """An amount or percentage as a number."""
    digits = f"nullif(regexp_replace(trim({v}), '[$,()%\\s]', '', 'g'), '')"
    return f"CAST({digits} AS DOUBLE) * CASE WHEN trim({v}) LIKE '(%' OR trim({v}) LIKE '$%(%' THEN -1 ELSE 1 END"


def _loaded(src: str, header: str, kinds: list[str], names: list[str]) -> str:
    day = "strftime(coalesce(try_strptime(trim({0}), '%Y-%m-%d'), try_strptime(trim({0}), '%m/%d/%Y')), '%Y-%m-%d')"
    read = {"name": lambda v: f"trim({v})", "amount": _amount, "optional": _amount, "percent": _amount, "date": day.format}
    columns = ", ".join(f"{read[k](f'v[{i + 1}]')} AS {c}" for i, (k, c) in enumerate(zip(kinds, names)))
    return f"SELECT line_id, file_id, {columns} FROM ({_records(src, header, len(kinds), kinds, 'line_id, file_id, v')}) WHERE reason IS NULL"


P6_SQL = f"""
SELECT src_table, line_id, reason FROM ({_bad("ugly_debt_schedule", "Facility,Outstanding,Rate,Maturity,Annual P&I", 5, ["name", "amount", "percent", "date", "optional"])} UNION ALL
{_bad("ugly_revenue_breakdown", "Customer / Account,Revenue,% Mix", 3, ["name", "amount", "percent"])}) WHERE reason IS NOT NULL
"""

SQL = {
    "p2_found": P2_SQL, "p3_found": P3_SQL, "p3_wide": P3_WIDE_SQL, "p6_found": P6_SQL,
    "p2_silent": "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part WHERE p_partkey // 40 % 4 = 2",
    "p6_debt_loaded": _loaded("ugly_debt_schedule", "Facility,Outstanding,Rate,Maturity,Annual P&I", ["name", "amount", "percent", "date", "optional"], ["facility", "outstanding", "rate", "maturity", "annual_pi"]),
    "p6_revenue_loaded": _loaded("ugly_revenue_breakdown", "Customer / Account,Revenue,% Mix", ["name", "amount", "percent"], ["customer", "revenue", "mix"]),
}
