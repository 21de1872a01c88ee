"""DuckDB SQL for the registered queries, on the star-schema views.

Every statement is ``WITH <mapping CTEs> <body>``.  Money is kept in whole cents
(``*_c`` columns) and ratios are rounded with integer arithmetic.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
CUTOFF = "DATE '2000-08-01'"


# --- arithmetic -------------------------------------------------------------------

def half_up(num: str, den: str) -> str:
    """Integer quotient rounded half away from zero, NULL for a zero divisor."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (
        f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END"
        f" * ((2 * abs({n}) + abs({d})) // nullif(2 * abs({d}), 0)))"
    )


def usd(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100.0::DOUBLE)"


def mean_usd(cents: str, count: str) -> str:
    return usd(half_up(cents, count))


def ratio2(num: str, den: str) -> str:
    return usd(half_up(f"({num}) * 100", den))


def pct2(num: str, den: str) -> str:
    return usd(half_up(f"CAST({num} AS HUGEINT) * 10000", den))


def even(value: str, digits: int) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({value}) * {scale}, 0) / {scale})"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


# --- the four tables, and frames derived from them ----------------------------------

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def seeded(seed: int) -> str:
    """The first 32 bits of the MD5 of ``customer_id:seed``."""
    return f"CAST('0x' || substr(md5(customer_id || ':{seed}'), 1, 8) AS BIGINT)"


cte(
    "history",
    [],
    """SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
       FROM orders GROUP BY o_custkey""",
)
cte(
    "people",
    ["history"],
    f"""SELECT c_custkey AS customer_id, c_name AS name,
          'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
          first_day AS signup_date, r_name AS country, CAST(18 + c_custkey % 48 AS BIGINT) AS age,
          CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'Other' END AS gender,
          c_mktsegment AS acquisition_channel,
          CAST(CASE WHEN last_day < {CUTOFF} THEN 1 ELSE 0 END AS BIGINT) AS is_churned,
          CASE WHEN last_day < {CUTOFF} THEN last_day END AS churn_date
        FROM customer JOIN history ON o_custkey = c_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
cte(
    "ordered",
    [],
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS k,
          lead(CAST(o_orderdate AS DATE)) OVER w AS next_day, lead(o_orderkey) OVER w AS next_key
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""",
)
cte(
    "subs",
    ["ordered"],
    f"""SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
          CASE k WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' ELSE 'enterprise' END AS plan,
          CAST((CASE k WHEN 0 THEN 0 WHEN 1 THEN 19 WHEN 2 THEN 49 ELSE 149 END) * (90 + o_orderkey % 21) AS BIGINT) AS mrr_c,
          day AS start_date,
          CASE WHEN next_key IS NOT NULL THEN next_day WHEN day < {CUTOFF} THEN day END AS end_date,
          CASE WHEN next_key IS NULL AND day < {CUTOFF} THEN 'cancelled' WHEN next_key IS NULL THEN 'active'
               WHEN next_key % 4 >= k THEN 'upgraded' ELSE 'downgraded' END AS status
        FROM ordered""",
)
cte(
    "txns",
    [],
    """SELECT o_orderkey AS transaction_id,
          o_custkey + CASE WHEN o_custkey % 17 = 0 THEN 1 ELSE 0 END AS customer_id,
          CAST(o_orderdate AS DATE) AS transaction_date,
          CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS amount_c,
          o_orderpriority AS product_category, o_orderstatus AS payment_method
       FROM orders""",
)
cte(
    "acts",
    [],
    """SELECT l_orderkey * 8 + l_linenumber AS event_id,
          o_custkey + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS customer_id,
          CAST(l_shipdate AS DATE) AS event_date,
          CASE WHEN l_partkey % 10 <= 2 THEN 'login' WHEN l_partkey % 10 <= 5 THEN 'page_view'
               WHEN l_partkey % 10 <= 7 THEN 'feature_use' WHEN l_partkey % 10 = 8 THEN 'support_ticket'
               ELSE 'feedback' END AS event_type,
          CASE WHEN l_partkey % 10 > 2 THEN l_returnflag END AS event_detail
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
cte(
    "spend",
    ["txns"],
    "SELECT customer_id, sum(amount_c) AS spend_c, count(*) AS n FROM txns GROUP BY customer_id",
)
cte(
    "act_counts",
    ["acts"],
    """SELECT customer_id, count(*) AS total_events,
          count(*) FILTER (WHERE event_type = 'login') AS logins,
          count(*) FILTER (WHERE event_type = 'feature_use') AS feature_uses,
          count(*) FILTER (WHERE event_type = 'support_ticket') AS support_tickets,
          count(*) FILTER (WHERE event_type = 'page_view') AS page_views
       FROM acts GROUP BY customer_id""",
)
cte(
    "event_profile",
    ["people", "act_counts"],
    """SELECT customer_id, CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status,
          total_events, logins, feature_uses, support_tickets, page_views
       FROM people JOIN act_counts USING (customer_id)""",
)
cte(
    "c360",
    ["people", "spend", "act_counts"],
    f"""SELECT people.*, coalesce({usd('spend_c')}, 0.0::DOUBLE) AS total_spend, coalesce(spend_c, 0) AS spend_c,
          coalesce(n, 0) AS num_transactions, coalesce(total_events, 0) AS total_events,
          coalesce(logins, 0) AS logins, coalesce(feature_uses, 0) AS feature_uses,
          CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status,
          CAST({AS_OF} - signup_date AS BIGINT) AS tenure_days
        FROM people LEFT JOIN spend USING (customer_id) LEFT JOIN act_counts USING (customer_id)""",
)

# --- reports ------------------------------------------------------------------------

cte(
    "month_rows",
    ["txns"],
    """SELECT strftime(transaction_date, '%Y-%m') AS month, sum(amount_c) AS c, count(*) AS n,
          count(DISTINCT customer_id) AS payers FROM txns GROUP BY 1""",
)
cte(
    "monthly",
    ["month_rows"],
    f"""SELECT month, {usd('c')} AS revenue, c, {big('payers')} AS paying_customers,
          {mean_usd('c', 'payers')} AS avg_revenue_per_customer,
          {pct2('(c - prev)', 'prev')} AS mom_growth_pct
        FROM (SELECT *, lag(c) OVER (ORDER BY month) AS prev FROM month_rows)""",
)
cte(
    "plans_active",
    ["subs"],
    f"""SELECT plan, count(DISTINCT customer_id) AS customers, sum(mrr_c) AS c, {usd('sum(mrr_c)')} AS total_mrr,
          {mean_usd('sum(mrr_c)', 'count(*)')} AS avg_mrr
        FROM subs WHERE status = 'active' GROUP BY plan""",
)
cte(
    "segments_q",
    ["people", "spend"],
    f"""SELECT acquisition_channel AS segment, count(*) AS total_customers, {big('sum(is_churned)')} AS churned,
          {pct2('sum(is_churned)', 'count(*)')} AS churn_rate_pct,
          {mean_usd('sum(spend_c)', 'count(spend_c)')} AS avg_spend
        FROM people LEFT JOIN spend USING (customer_id) GROUP BY acquisition_channel""",
)
cte(
    "retention",
    ["people", "acts"],
    f"""SELECT cohort, period, {big('count(DISTINCT customer_id)')} AS retained_customers,
          {big('any_value(cohort_size)')} AS cohort_size,
          {pct2('count(DISTINCT customer_id)', 'any_value(cohort_size)')} AS retention_rate
        FROM (SELECT p.customer_id, p.cohort, p.cohort_size,
                CAST((year(event_date) * 12 + month(event_date))
                   - (year(signup_date) * 12 + month(signup_date)) AS BIGINT) AS period
              FROM (SELECT customer_id, signup_date, strftime(signup_date, '%Y-%m') AS cohort,
                      count(*) OVER (PARTITION BY strftime(signup_date, '%Y-%m')) AS cohort_size
                    FROM people) p JOIN acts USING (customer_id))
        WHERE period BETWEEN 0 AND 12 GROUP BY cohort, period""",
)
cte(
    "engagement",
    ["people", "act_counts"],
    f"""SELECT CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status,
          {ratio2('sum(total_events)', 'count(total_events)')} AS avg_events,
          {ratio2('sum(logins)', 'count(logins)')} AS avg_logins,
          {ratio2('sum(feature_uses)', 'count(feature_uses)')} AS avg_feature_uses,
          {ratio2('sum(support_tickets)', 'count(support_tickets)')} AS avg_support_tickets
        FROM people LEFT JOIN act_counts USING (customer_id) GROUP BY 1""",
)

# --- features -----------------------------------------------------------------------

cte(
    "obs",
    ["people"],
    f"""SELECT *, CAST(CASE WHEN is_churned = 0 OR churn_date IS NULL THEN {AS_OF}
          WHEN w > 30 THEN churn_date - CAST(14 + {seeded(123)} % (least(60, w // 2) - 13) AS INTEGER)
          ELSE churn_date - CAST(greatest(1, w // 3) AS INTEGER) END AS DATE) AS obs_date
        FROM (SELECT *, churn_date - signup_date AS w FROM people)""",
)
cte(
    "f_txn",
    ["obs", "txns"],
    """SELECT customer_id, sum(amount_c) AS spend_c, count(*) AS n
       FROM txns JOIN obs USING (customer_id) WHERE transaction_date <= obs_date GROUP BY customer_id""",
)
cte(
    "f_sub",
    ["obs", "subs"],
    """SELECT customer_id, plan, mrr_c FROM (
         SELECT customer_id, plan, mrr_c,
           row_number() OVER (PARTITION BY customer_id ORDER BY start_date DESC, subscription_id DESC) AS newest
         FROM subs JOIN obs USING (customer_id) WHERE start_date <= obs_date) WHERE newest = 1""",
)
cte(
    "f_evt",
    ["obs", "acts"],
    """SELECT customer_id, count(*) AS total_events,
          count(*) FILTER (WHERE event_type = 'login') AS login_count,
          count(*) FILTER (WHERE event_type = 'feature_use') AS feature_use_count,
          count(*) FILTER (WHERE event_type = 'support_ticket') AS support_ticket_count,
          count(*) FILTER (WHERE event_type = 'page_view') AS page_view_count,
          count(*) FILTER (WHERE event_date >= obs_date - 30) AS events_last_30d,
          count(*) FILTER (WHERE event_date >= obs_date - 7) AS events_last_7d,
          max(event_date) AS last_event_date
       FROM acts JOIN obs USING (customer_id) WHERE event_date <= obs_date GROUP BY customer_id""",
)
_FILLED = ", ".join(
    f"coalesce({c}, 0) AS {c}"
    for c in [
        "total_events",
        "login_count",
        "feature_use_count",
        "support_ticket_count",
        "page_view_count",
        "events_last_30d",
        "events_last_7d",
    ]
)
cte(
    "feats",
    ["obs", "f_txn", "f_sub", "f_evt"],
    f"""SELECT customer_id, CAST(obs_date - signup_date AS BIGINT) AS tenure_days, age, country, acquisition_channel,
          coalesce({usd('spend_c')}, 0.0::DOUBLE) AS total_spend,
          coalesce({usd('spend_c')} / n, 0.0::DOUBLE) AS avg_order_value,
          coalesce(n, 0) AS num_transactions, coalesce(plan, 'free') AS plan,
          coalesce({usd('mrr_c')}, 0.0::DOUBLE) AS current_mrr, {_FILLED},
          CAST(coalesce(obs_date - last_event_date, 999) AS BIGINT) AS days_since_last_event, is_churned
        FROM obs LEFT JOIN f_txn USING (customer_id) LEFT JOIN f_sub USING (customer_id)
        LEFT JOIN f_evt USING (customer_id)""",
)
cte(
    "h_dates",
    ["people"],
    f"""SELECT p.*, CAST(last_day(m) AS DATE) AS obs_date
        FROM people p, generate_series(date_trunc('month', signup_date), date_trunc('month', {AS_OF}), INTERVAL 1 MONTH) AS g(m)
        WHERE last_day(m) <= {AS_OF}""",
)
cte(
    "h_txn",
    ["h_dates", "txns"],
    """SELECT customer_id, obs_date, sum(amount_c) AS spend_c, count(*) AS n
       FROM txns JOIN h_dates USING (customer_id) WHERE transaction_date <= obs_date GROUP BY ALL""",
)
cte(
    "h_sub",
    ["h_dates", "subs"],
    """SELECT customer_id, obs_date, plan, mrr_c FROM (
         SELECT customer_id, obs_date, plan, mrr_c,
           row_number() OVER (PARTITION BY customer_id, obs_date ORDER BY start_date DESC, subscription_id DESC) AS newest
         FROM subs JOIN h_dates USING (customer_id) WHERE start_date <= obs_date) WHERE newest = 1""",
)
cte(
    "h_evt",
    ["h_dates", "acts"],
    """SELECT customer_id, obs_date, count(*) AS total_events,
          count(*) FILTER (WHERE event_type = 'login') AS login_count,
          count(*) FILTER (WHERE event_type = 'feature_use') AS feature_use_count,
          count(*) FILTER (WHERE event_type = 'support_ticket') AS support_ticket_count,
          count(*) FILTER (WHERE event_type = 'page_view') AS page_view_count,
          count(*) FILTER (WHERE event_date >= obs_date - 30) AS events_last_30d,
          count(*) FILTER (WHERE event_date >= obs_date - 7) AS events_last_7d,
          max(event_date) AS last_event_date
       FROM acts JOIN h_dates USING (customer_id) WHERE event_date <= obs_date GROUP BY ALL""",
)
cte(
    "h_feats",
    ["h_dates", "h_txn", "h_sub", "h_evt"],
    f"""SELECT customer_id, obs_date, CAST(obs_date - signup_date AS BIGINT) AS tenure_days, age, country,
          acquisition_channel, coalesce({usd('spend_c')}, 0.0::DOUBLE) AS total_spend,
          coalesce({usd('spend_c')} / n, 0.0::DOUBLE) AS avg_order_value,
          coalesce(n, 0) AS num_transactions, coalesce(plan, 'free') AS plan,
          coalesce({usd('mrr_c')}, 0.0::DOUBLE) AS current_mrr, {_FILLED},
          CAST(coalesce(obs_date - last_event_date, 999) AS BIGINT) AS days_since_last_event, is_churned
        FROM h_dates LEFT JOIN h_txn USING (customer_id, obs_date) LEFT JOIN h_sub USING (customer_id, obs_date)
        LEFT JOIN h_evt USING (customer_id, obs_date)""",
)
PLAN_CODE = "CAST(CASE plan WHEN 'starter' THEN 1 WHEN 'pro' THEN 2 WHEN 'enterprise' THEN 3 ELSE 0 END AS BIGINT)"
PER_WEEK = even("total_events / (greatest(tenure_days, 7) / 7.0::DOUBLE)", 2)
TICKETS = even("support_ticket_count / CAST(greatest(total_events, 1) AS DOUBLE)", 4)
CHANNELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
DUMMIES = ", ".join(
    [f"CAST(acquisition_channel = '{c}' AS BIGINT) AS \"channel_{c}\"" for c in CHANNELS]
    + [f"CAST(country = '{c}' AS BIGINT) AS \"country_{c}\"" for c in COUNTRIES]
)

# --- deterministic scores, labels and predictions --------------------------------------

PROBABILITY = """(CASE customer_id % 50 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.6::DOUBLE
                  ELSE ((customer_id * 37) % 1001) / 1000.0::DOUBLE END)"""
cte(
    "scores",
    ["feats"],
    f"""SELECT customer_id, {even('p', 4)} AS churn_probability,
          CASE WHEN p > 0 AND p <= 0.3::DOUBLE THEN 'Low' WHEN p > 0.3::DOUBLE AND p <= 0.6::DOUBLE THEN 'Medium'
               WHEN p > 0.6::DOUBLE AND p <= 1 THEN 'High' END AS risk_tier,
          is_churned, total_spend, current_mrr, tenure_days, events_last_30d, days_since_last_event
        FROM (SELECT *, {PROBABILITY} AS p FROM feats)""",
)
cte(
    "valued",
    ["scores", "people"],
    f"""SELECT *, {even('monthly_value * 12 * churn_probability', 2)} AS annual_risk_value
        FROM (SELECT s.*, p.name, p.country, p.acquisition_channel, p.signup_date,
                CASE WHEN current_mrr > 0 THEN current_mrr
                     ELSE total_spend / greatest(tenure_days / 30.0::DOUBLE, 1.0::DOUBLE) END AS monthly_value
              FROM scores s LEFT JOIN people p USING (customer_id))""",
)
cte(
    "offers",
    ["valued"],
    """SELECT *, CASE risk_tier WHEN 'High' THEN 'Personal outreach + 20% discount'
            WHEN 'Medium' THEN 'Automated email + 10% discount' ELSE 'No intervention needed' END AS recommended_action,
          CAST(CASE risk_tier WHEN 'High' THEN 50 WHEN 'Medium' THEN 15 ELSE 0 END AS DOUBLE) AS intervention_cost,
          CAST(CASE risk_tier WHEN 'High' THEN 0.35 WHEN 'Medium' THEN 0.25 ELSE 0 END AS DOUBLE) AS success_rate
       FROM valued""",
)
cte(
    "recs",
    ["offers"],
    f"""SELECT * EXCLUDE (success_rate),
          CASE WHEN intervention_cost > 0
               THEN {even('(expected_save_value - intervention_cost) / intervention_cost', 2)}
               ELSE 0.0::DOUBLE END AS expected_roi
        FROM (SELECT *, {even('annual_risk_value * success_rate', 2)} AS expected_save_value FROM offers)""",
)
cte(
    "judged",
    ["feats"],
    f"""SELECT customer_id, is_churned, {PROBABILITY} AS score,
          CASE WHEN {PROBABILITY} > 0.5::DOUBLE THEN 1 ELSE 0 END AS said FROM feats""",
)
cte(
    "confusion",
    ["judged"],
    """SELECT count(*) FILTER (WHERE is_churned = 1 AND said = 1) AS tp,
          count(*) FILTER (WHERE is_churned = 0 AND said = 1) AS fp,
          count(*) FILTER (WHERE is_churned = 1 AND said = 0) AS fn,
          count(*) FILTER (WHERE is_churned = 0 AND said = 0) AS tn FROM judged""",
)


def _mean2(column: str, digits: int = 2) -> str:
    exact = f"sum(CAST(CAST({column} AS DECIMAL(18,2)) * 100 AS BIGINT))"
    return even(f"{usd(exact)} / count({column})", digits)


cte(
    "profiles",
    ["feats"],
    f"""SELECT customer_id % 4 AS segment, count(*) AS size, {_mean2('total_spend')} AS avg_spend,
          {_mean2('total_events')} AS avg_events, {_mean2('current_mrr')} AS avg_mrr,
          {_mean2('is_churned')} AS churn_rate, {_mean2('tenure_days')} AS avg_tenure
        FROM feats GROUP BY 1""",
)
cte(
    "split",
    ["feats"],
    f"""SELECT *, place <= CAST(floor(members * 0.8::DOUBLE) AS BIGINT) AS is_train FROM (
         SELECT *, count(*) OVER (PARTITION BY is_churned) AS members,
           row_number() OVER (PARTITION BY is_churned
             ORDER BY {seeded(42)} % 65521, customer_id) AS place FROM feats)""",
)


def statement(needs: list[str], body: str) -> str:
    """``body`` preceded by the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in ordered) + "\n" + body


# --- one statement per registered query ---------------------------------------------------

_COLUMNS = {
    "customers": (
        "people",
        ["customer_id", "name", "email", "signup_date", "country", "age", "gender", "acquisition_channel", "is_churned", "churn_date"],
    ),
    "subscriptions": (
        "subs",
        ["subscription_id", "customer_id", "plan", "mrr_c", "start_date", "end_date", "status"],
    ),
    "transactions": (
        "txns",
        ["transaction_id", "customer_id", "transaction_date", "amount_c", "product_category", "payment_method"],
    ),
    "events": ("acts", ["event_id", "customer_id", "event_date", "event_type", "event_detail"]),
}
_TYPES = {
    "customers": ["bigint", "string", "string", "date", "string", "int", "string", "string", "int", "date"],
    "subscriptions": ["bigint", "bigint", "string", "decimal(12,2)", "date", "date", "string"],
    "transactions": ["bigint", "bigint", "date", "decimal(12,2)", "string", "string"],
    "events": ["bigint", "bigint", "date", "string", "string"],
}
_ALL = ["people", "subs", "txns", "acts"]
_OPTIONAL = {"churn_date", "end_date", "event_detail"}


def _logical(column: str) -> str:
    return {"mrr_c": "mrr", "amount_c": "amount"}.get(column, column)


def _cells(measure) -> str:
    parts = []
    for table, (source, columns) in _COLUMNS.items():
        for column, kind in zip(columns, _TYPES[table]):
            parts.append(measure(table, source, column, kind))
    return "\nUNION ALL ".join(p for p in parts if p)


def _value_counts(pairs: list[tuple[str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS \"rows\" FROM {s} GROUP BY {c}" for s, c in pairs
    )


def _bins(source: str, value: str, bins: int, extra: str = "") -> str:
    group = f"{extra}, " if extra else ""
    return f"""SELECT {group}bin, lo + (hi - lo) / {bins}.0::DOUBLE * bin AS bin_start, count(*) AS "rows"
        FROM (SELECT {group}lo, hi, CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}.0::DOUBLE, 0)), 0), {bins - 1}) AS BIGINT) AS bin
              FROM (SELECT {group}{value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi FROM {source}))
        GROUP BY ALL"""


def _integrity() -> str:
    keys = [("customers", "customer_id", "primary_key"), ("subscriptions", "subscription_id", "primary_key")]
    keys += [("transactions", "transaction_id", "primary_key"), ("events", "event_id", "primary_key")]
    keys += [("customers", "email", "unique")]
    parts = [
        f"SELECT '{t}' AS table_name, '{k}' AS column_name, '{r}' AS rule, count(*) AS violations"
        f" FROM (SELECT {k} FROM {_COLUMNS[t][0]} GROUP BY {k} HAVING count(*) > 1)"
        for t, k, r in keys
    ]
    parts += [
        f"SELECT '{t}', '{_logical(c)}', 'not_null', count(*) - count({c}) FROM {s}"
        for t, (s, columns) in _COLUMNS.items()
        for c in columns
        if c not in _OPTIONAL
    ]
    parts += [
        f"SELECT '{t}', 'customer_id', 'foreign_key', count(*) FROM {_COLUMNS[t][0]} f"
        " WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.customer_id = f.customer_id)"
        for t in ("subscriptions", "transactions", "events")
    ]
    return "\nUNION ALL ".join(parts)


def _boxes() -> str:
    long = "\nUNION ALL ".join(
        f"SELECT status, '{m}' AS event_type, CAST({m} AS DOUBLE) AS v FROM event_profile"
        for m in ["logins", "feature_uses", "support_tickets", "page_views"]
    )
    return f"""SELECT event_type, status, q1, median, q3, count(*) AS customers,
          min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS lower_fence,
          max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS upper_fence,
          count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT *, quantile_cont(v, 0.25) OVER g AS q1, quantile_cont(v, 0.5) OVER g AS median,
                quantile_cont(v, 0.75) OVER g AS q3 FROM ({long})
              WINDOW g AS (PARTITION BY event_type, status))
        GROUP BY event_type, status, q1, median, q3"""


COMPARED = {
    "avg_spend": "total_spend",
    "avg_transactions": "num_transactions",
    "avg_events": "total_events",
    "avg_logins": "logins",
    "avg_feature_uses": "feature_uses",
    "avg_tenure": "tenure_days",
    "avg_age": "age",
}


def _comparison() -> str:
    rows = {"count": "CAST(count(*) AS DOUBLE)", "median_spend": even("median(total_spend)", 1)}
    rows |= {name: _mean2(column, 1) for name, column in COMPARED.items()}
    long = "\nUNION ALL ".join(
        f"SELECT '{name}' AS metric, status, {value} AS v FROM c360 GROUP BY status" for name, value in rows.items()
    )
    return f"""SELECT metric, max(v) FILTER (WHERE status = 'Active') AS "Active",
          max(v) FILTER (WHERE status = 'Churned') AS "Churned" FROM ({long}) GROUP BY metric"""


CORRELATED = ["is_churned", "total_spend", "num_transactions", "total_events", "logins", "feature_uses", "tenure_days", "age"]


def _correlations(pairs) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {even(f'corr({a}, {b})', 6)} + 0.0::DOUBLE AS r FROM c360" for a, b in pairs
    )


NUMERIC = """tenure_days age total_spend avg_order_value num_transactions current_mrr total_events login_count
    feature_use_count support_ticket_count page_view_count events_last_30d events_last_7d days_since_last_event
    plan_encoded avg_events_per_week support_ticket_ratio""".split()
LTV = """tenure_days age num_transactions total_events login_count feature_use_count current_mrr plan_encoded
    events_last_30d""".split()
SCALED = [
    "tenure_days",
    "total_spend",
    "num_transactions",
    "total_events",
    "login_count",
    "feature_use_count",
    "events_last_30d",
    "current_mrr",
]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, needs: list[str], body: str) -> None:
        q[name] = statement(needs, body)

    # tables
    add("load_customers", ["people"], "SELECT * REPLACE (CAST(age AS INTEGER) AS age, CAST(is_churned AS INTEGER) AS is_churned) FROM people")
    add("load_subscriptions", ["subs"], f"SELECT * EXCLUDE (mrr_c), {usd('mrr_c')} AS mrr FROM subs")
    add("load_transactions", ["txns"], f"SELECT * EXCLUDE (amount_c), {usd('amount_c')} AS amount FROM txns")
    add("load_events", ["acts"], "SELECT * FROM acts")

    # reports
    add("monthly_revenue", ["monthly"], "SELECT * EXCLUDE (c) FROM monthly")
    add("revenue_by_plan", ["plans_active"], "SELECT plan, customers, total_mrr, avg_mrr FROM plans_active")
    add(
        "revenue_by_category",
        ["txns"],
        f"""SELECT product_category, count(*) AS transaction_count, {usd('sum(amount_c)')} AS total_revenue,
              {mean_usd('sum(amount_c)', 'count(*)')} AS avg_transaction FROM txns GROUP BY product_category""",
    )
    add("cohort_retention", ["retention"], "SELECT * FROM retention")
    add(
        "top_customers",
        ["people", "spend"],
        f"""SELECT customer_id, name, country, signup_date, acquisition_channel, {usd('spend_c')} AS total_spend,
              coalesce(n, 0) AS num_transactions, {mean_usd('spend_c', 'n')} AS avg_order_value,
              CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status
            FROM people LEFT JOIN spend USING (customer_id)
            ORDER BY spend_c DESC NULLS LAST, customer_id LIMIT 20""",
    )
    add(
        "customer_lifetime_value",
        ["people", "txns"],
        f"""SELECT customer_id, name, signup_date, acquisition_channel,
              {mean_usd('c', 'months')} AS avg_monthly_revenue, {big('months')} AS active_months,
              {usd('c')} AS estimated_ltv, CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status
            FROM people JOIN (SELECT customer_id, sum(amount_c) AS c,
                count(DISTINCT strftime(transaction_date, '%Y-%m')) AS months FROM txns GROUP BY customer_id)
              USING (customer_id)""",
    )
    add("customer_segments", ["segments_q"], "SELECT * FROM segments_q")
    add(
        "conversion_funnel",
        ["people", "acts", "txns"],
        f"""SELECT CAST(stage_order AS BIGINT) AS stage_order, stage, users,
              {pct2('users', '(SELECT count(*) FROM people)')} AS pct_of_signups
            FROM (SELECT 1 AS stage_order, 'Signed Up' AS stage, count(DISTINCT customer_id) AS users FROM people
              UNION ALL SELECT 2, 'Logged In', count(DISTINCT customer_id) FILTER (WHERE event_type = 'login') FROM acts
              UNION ALL SELECT 3, 'Viewed Pages', count(DISTINCT customer_id) FILTER (WHERE event_type = 'page_view') FROM acts
              UNION ALL SELECT 4, 'Used Features', count(DISTINCT customer_id) FILTER (WHERE event_type = 'feature_use') FROM acts
              UNION ALL SELECT 5, 'Made Purchase', count(DISTINCT customer_id) FROM txns)""",
    )
    add("daily_active_users", ["acts"], "SELECT event_date AS date, count(DISTINCT customer_id) AS dau FROM acts GROUP BY event_date")
    q["daily_active_users_clicks"] = (
        "SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS dau FROM events GROUP BY CAST(ts AS DATE)"
    )
    add(
        "rolling_active_users",
        ["acts"],
        """SELECT day AS date, count(DISTINCT customer_id) FILTER (WHERE event_date > day - 7) AS users_7d,
             count(DISTINCT customer_id) AS users_30d
           FROM (SELECT CAST(d AS DATE) AS day FROM (SELECT min(event_date) AS a, max(event_date) AS z FROM acts),
                   generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY) AS g(d))
           JOIN (SELECT DISTINCT customer_id, event_date FROM acts) ON event_date BETWEEN day - 29 AND day
           GROUP BY day""",
    )
    add(
        "monthly_active_users",
        ["acts"],
        """SELECT strftime(event_date, '%Y-%m') AS month, count(DISTINCT customer_id) AS users
           FROM acts GROUP BY 1""",
    )
    add(
        "monthly_amount_quantiles",
        ["txns"],
        f"""SELECT month, n AS "rows", p, {usd('amount_c')} AS quantile
            FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY amount_c) AS place,
                    count(*) OVER (PARTITION BY month) AS n
                  FROM (SELECT strftime(transaction_date, '%Y-%m') AS month, amount_c FROM txns))
            JOIN (SELECT unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS p) ON place = ceil(round(p * n, 6))""",
    )
    add("engagement_by_churn_status", ["engagement"], "SELECT * FROM engagement")
    add(
        "churn_by_segment",
        ["people", "subs"],
        f"""SELECT country, acquisition_channel, plan, count(DISTINCT customer_id) AS total,
              {big('sum(is_churned)')} AS churned, {pct2('sum(is_churned)', 'count(DISTINCT customer_id)')} AS churn_rate
            FROM people LEFT JOIN (SELECT customer_id, plan FROM subs WHERE status IN ('active', 'cancelled'))
              USING (customer_id)
            GROUP BY country, acquisition_channel, plan HAVING count(DISTINCT customer_id) >= 5""",
    )

    # features
    add("observation_points", ["obs"], "SELECT customer_id, obs_date FROM obs")
    add(
        "txn_features_asof",
        ["f_txn"],
        f"SELECT customer_id, {usd('spend_c')} AS total_spend, {usd('spend_c')} / n AS avg_order_value, n AS num_transactions FROM f_txn",
    )
    add("latest_subscription_asof", ["f_sub"], f"SELECT customer_id, plan, {usd('mrr_c')} AS mrr FROM f_sub")
    add("event_features_asof", ["f_evt"], "SELECT * FROM f_evt")
    add(
        "feature_matrix",
        ["feats"],
        f"""SELECT * EXCLUDE (plan, country, acquisition_channel), {PLAN_CODE} AS plan_encoded,
              {PER_WEEK} AS avg_events_per_week, {TICKETS} AS support_ticket_ratio, {DUMMIES} FROM feats""",
    )
    add(
        "feature_history",
        ["h_feats"],
        f"""SELECT * EXCLUDE (plan), {PLAN_CODE} AS plan_encoded, {PER_WEEK} AS avg_events_per_week,
              {TICKETS} AS support_ticket_ratio FROM h_feats""",
    )
    add("plan_encoded", ["feats"], f"SELECT customer_id, plan, {PLAN_CODE} AS plan_encoded FROM feats")
    add("avg_events_per_week", ["feats"], f"SELECT customer_id, {PER_WEEK} AS avg_events_per_week FROM feats")
    add("support_ticket_ratio", ["feats"], f"SELECT customer_id, {TICKETS} AS support_ticket_ratio FROM feats")
    add("one_hot", ["people"], f"SELECT customer_id, {DUMMIES} FROM people")

    # models, on fixed scores
    add("stratified_split", ["split"], "SELECT customer_id, is_churned, is_train FROM split")
    add(
        "standard_scale",
        ["split"],
        "SELECT customer_id, "
        + ", ".join(
            even(
                f"({c} - (SELECT avg({c}) FROM split WHERE is_train)) / (SELECT stddev_pop({c}) FROM split WHERE is_train)",
                6,
            )
            + f" + 0.0::DOUBLE AS {c}"
            for c in SCALED
        )
        + " FROM split",
    )
    add("risk_tier", ["scores"], "SELECT customer_id, churn_probability, risk_tier FROM scores")
    area = """(SELECT (sum(place * is_churned) - CAST(sum(is_churned) * (sum(is_churned) + 1) AS DOUBLE) / 2)
                 / (CAST(sum(is_churned) AS DOUBLE) * sum(1 - is_churned))
               FROM (SELECT is_churned, rank() OVER (ORDER BY score)
                       + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS place FROM judged))"""
    add(
        "churn_metrics",
        ["confusion"],
        f"""SELECT 'fixed' AS model, {even(area, 4)} AS auc_roc,
              {even('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)', 4)} AS f1 FROM confusion""",
    )
    add(
        "classification_report",
        ["confusion"],
        f"""SELECT "class", precision, recall, f1, support FROM (
              WITH c AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
                           CAST(tn AS DOUBLE) AS tn FROM confusion),
              k AS (SELECT '0' AS "class", tn / (tn + fn) AS precision, tn / (tn + fp) AS recall,
                      2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS s FROM c
                    UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c),
              n AS (SELECT max(CASE "class" WHEN '0' THEN s END) AS n0, max(CASE "class" WHEN '1' THEN s END) AS n1,
                      max(CASE "class" WHEN '0' THEN precision END) AS p0, max(CASE "class" WHEN '1' THEN precision END) AS p1,
                      max(CASE "class" WHEN '0' THEN recall END) AS r0, max(CASE "class" WHEN '1' THEN recall END) AS r1,
                      max(CASE "class" WHEN '0' THEN f1 END) AS f0, max(CASE "class" WHEN '1' THEN f1 END) AS f1 FROM k)
              SELECT "class", precision, recall, f1, CAST(s AS BIGINT) AS support FROM k
              UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT (tp + tn) / (tp + fp + fn + tn) AS a,
                                                            CAST(tp + fp + fn + tn AS BIGINT) AS s FROM c)
              UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n0 + n1 AS BIGINT) FROM n
              UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
                         (f0 * n0 + f1 * n1) / (n0 + n1), CAST(n0 + n1 AS BIGINT) FROM n)""",
    )
    add("segment_profiles", ["profiles"], "SELECT * FROM profiles")
    add(
        "segment_names",
        ["profiles"],
        """SELECT * EXCLUDE (m), CASE WHEN avg_spend > m AND churn_rate < 0.2::DOUBLE THEN 'High-Value Loyal'
              WHEN avg_spend > m THEN 'High-Value At Risk' WHEN churn_rate < 0.2::DOUBLE THEN 'Growth Potential'
              ELSE 'Low-Value Churning' END AS segment_name
            FROM (SELECT *, (SELECT median(avg_spend) FROM profiles) AS m FROM profiles)""",
    )
    guess = "total_spend * (0.9::DOUBLE + (customer_id % 21) / 100.0::DOUBLE)"
    add(
        "ltv_metrics",
        ["feats"],
        f"""SELECT {even('avg(abs(total_spend - guess))', 2)} AS mae,
              {even('1 - sum((total_spend - guess) * (total_spend - guess)) / (var_pop(total_spend) * count(*))', 4)} AS r2
            FROM (SELECT total_spend, {guess} AS guess FROM feats)""",
    )

    # decisions
    add(
        "customer_context",
        ["scores", "people"],
        "SELECT s.*, p.name, p.country, p.acquisition_channel, p.signup_date FROM scores s LEFT JOIN people p USING (customer_id)",
    )
    add("monthly_value", ["valued"], "SELECT customer_id, monthly_value FROM valued")
    add("annual_risk_value", ["valued"], "SELECT customer_id, annual_risk_value FROM valued")
    add("intervention_lookup", ["offers"], "SELECT customer_id, risk_tier, recommended_action, intervention_cost, success_rate FROM offers")
    add("expected_save_value", ["recs"], "SELECT customer_id, expected_save_value FROM recs")
    add("expected_roi", ["recs"], "SELECT customer_id, expected_roi FROM recs")
    add("recommendations", ["recs"], "SELECT * FROM recs")

    def total(column: str, where: str) -> str:
        return f"coalesce({usd(f'sum(CAST(CAST({column} AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE {where})')}, 0.0::DOUBLE)"

    acting = "risk_tier IN ('High', 'Medium')"
    add(
        "summary_report",
        ["recs"],
        f"""SELECT *, {even('(total_expected_savings - total_intervention_cost) / greatest(total_intervention_cost, 1.0::DOUBLE) * 100', 2)} AS net_roi_pct
            FROM (SELECT count(*) AS total_customers, count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_count,
              count(*) FILTER (WHERE risk_tier = 'Medium') AS medium_risk_count,
              count(*) FILTER (WHERE risk_tier = 'Low') AS low_risk_count,
              {total('annual_risk_value', acting)} AS total_revenue_at_risk,
              {total('intervention_cost', acting)} AS total_intervention_cost,
              {total('expected_save_value', acting)} AS total_expected_savings,
              {even(total('annual_risk_value', "risk_tier = 'High'") + " / count(*) FILTER (WHERE risk_tier = 'High')", 2)} AS high_risk_avg_value,
              {even(total('annual_risk_value', "risk_tier = 'Medium'") + " / count(*) FILTER (WHERE risk_tier = 'Medium')", 2)} AS medium_risk_avg_value
            FROM recs)""",
    )

    # views
    add(
        "executive_kpis",
        ["monthly", "segments_q"],
        f"""SELECT (SELECT {usd('sum(c)')} FROM monthly) AS total_revenue,
              (SELECT revenue FROM monthly ORDER BY month DESC LIMIT 1) AS latest_month_revenue,
              (SELECT mom_growth_pct FROM monthly ORDER BY month DESC LIMIT 1) AS latest_growth_pct,
              (SELECT {big('sum(total_customers)')} FROM segments_q) AS total_customers,
              (SELECT {usd('sum(CAST(round(churn_rate_pct * 100) AS BIGINT))')} / count(*) FROM segments_q) AS avg_churn_rate_pct""",
    )
    add(
        "plan_revenue_share",
        ["plans_active"],
        f"SELECT plan, total_mrr, {pct2('c', '(SELECT sum(c) FROM plans_active)')} AS share_pct FROM plans_active",
    )
    add(
        "retention_matrix",
        ["retention"],
        "SELECT cohort, "
        + ", ".join(f'max(retention_rate) FILTER (WHERE period = {i}) AS "{i}"' for i in range(13))
        + " FROM retention GROUP BY cohort",
    )
    add(
        "engagement_long",
        ["engagement"],
        "\nUNION ALL ".join(
            f"SELECT status, '{m}' AS metric, {m} AS average FROM engagement"
            for m in ["avg_logins", "avg_feature_uses", "avg_support_tickets"]
        ),
    )
    add("risk_filter", ["scores"], "SELECT * FROM scores WHERE risk_tier IN ('High', 'Medium') AND churn_probability >= 0.35::DOUBLE")
    add(
        "risk_tier_counts",
        ["scores"],
        "SELECT t AS risk_tier, count(customer_id) AS customers FROM (VALUES ('High'), ('Medium'), ('Low')) v(t)"
        " LEFT JOIN scores ON risk_tier = t GROUP BY t",
    )
    add(
        "risk_histogram",
        ["scores"],
        "SELECT CAST(least(floor(churn_probability * 40), 39) AS BIGINT) AS bin, risk_tier, count(*) AS customers FROM scores GROUP BY 1, 2",
    )
    add(
        "top_roi",
        ["recs"],
        "SELECT * FROM recs WHERE expected_roi > 0 ORDER BY expected_roi DESC, annual_risk_value DESC, customer_id LIMIT 50",
    )
    add(
        "recommendation_table",
        ["recs"],
        """SELECT customer_id, name, country, risk_tier, churn_probability, monthly_value, annual_risk_value,
             recommended_action, intervention_cost, expected_save_value, expected_roi
           FROM recs WHERE risk_tier IN ('High', 'Medium')""",
    )
    add(
        "customer_lookup",
        ["recs"],
        """SELECT customer_id, churn_probability,
             CAST(customer_id AS VARCHAR) || ' — ' || name || ' (' || coalesce(risk_tier, 'nan') || ' risk)' AS label
           FROM recs""",
    )

    add(
        "customer_lookup_tier",
        ["recs"],
        """SELECT customer_id, churn_probability,
             CAST(customer_id AS VARCHAR) || ' — ' || name || ' (' || coalesce(risk_tier, 'nan') || ' risk)' AS label
           FROM recs WHERE risk_tier = 'High'""",
    )
    add("customer_profile", ["recs"], "SELECT * FROM recs WHERE customer_id = 42")

    # trained models: what a right fit shows
    add("churn_random_forest", ["split"], "SELECT count(*) AS test_rows, true AS better FROM split WHERE NOT is_train")
    add("ltv_model", ["feats"], "SELECT count(*) - CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS test_rows, true AS better FROM feats")
    levels = " UNION ALL ".join(
        f"SELECT DISTINCT '{prefix}_vector_' || {column} FROM people UNION ALL SELECT '{prefix}_vector___unknown'"
        for column, prefix in (("acquisition_channel", "channel"), ("country", "country"))
    )
    numeric = ", ".join(f"('{name}')" for name in NUMERIC)
    slots = f"(SELECT col0 AS feature FROM (VALUES {numeric}) UNION ALL {levels})"
    add("churn_logistic", ["people"], f"SELECT feature, true AS stationary FROM {slots}")
    add("churn_feature_importance", ["people"], f"SELECT feature, true AS sound FROM {slots}")
    q["ltv_feature_importance"] = "SELECT col0 AS feature, true AS sound FROM (VALUES {})".format(
        ", ".join(f"('{name}')" for name in LTV)
    )
    q["select_best_model"] = "SELECT col0 AS model, true AS right FROM (VALUES ('RandomForest'), ('LogisticRegression'))"
    add("predict_churn", ["people"], "SELECT customer_id, true AS agrees FROM people")
    add("save_load_models", ["people"], "SELECT customer_id, true AS same FROM people")
    add("customer_segmentation", ["people"], "SELECT customer_id, true AS nearest, true AS centred FROM people")
    add("trained_segment_profiles", ["people"], "SELECT CAST(4 AS BIGINT) AS segments, count(*) AS customers, true AS named FROM people")
    q["trained_ltv_metrics"] = "SELECT col0 AS metric, true AS agrees FROM (VALUES ('mae'), ('r2'))"
    q["run_pipeline"] = """SELECT col0 AS metric, true AS agrees FROM (VALUES ('total_customers'), ('high_risk_count'),
        ('total_revenue_at_risk'), ('total_intervention_cost'), ('total_expected_savings'))"""
    # models trained on planted answers, which the right fit finds
    def planted(name: str, step: str, kind: str = "DOUBLE") -> str:
        return f"CAST({step} + CAST(floor(abs({name})) AS BIGINT) % 5 AS {kind}) AS {name}"

    leaves = "customer_id % 3 = 0"

    def numbered(name: str, kind: str = "BIGINT") -> str:
        place = NUMERIC.index(name)
        return f"CAST(CASE WHEN {leaves} THEN {100 + place} ELSE {place} END AS {kind}) AS {name}"

    # A probability of zero lies in no tier.
    add(
        "planted_churn_scores",
        ["feats"],
        f"""SELECT customer_id, CASE WHEN {leaves} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS churn_probability,
              CASE WHEN {leaves} THEN 'High' END AS risk_tier, CAST({leaves} AS BIGINT) AS is_churned,
              {numbered('total_spend', 'DOUBLE')}, {numbered('current_mrr', 'DOUBLE')}, {numbered('tenure_days')},
              {numbered('events_last_30d')}, {numbered('days_since_last_event')} FROM feats""",
    )
    q["planted_churn_metrics"] = """SELECT col0 AS model, 1.0::DOUBLE AS auc_roc, 1.0::DOUBLE AS f1, col1 AS chosen
        FROM (VALUES ('RandomForest', true), ('LogisticRegression', false))"""
    step = "customer_id % 4 * 1000"
    averages = {"total_spend": "avg_spend", "total_events": "avg_events", "current_mrr": "avg_mrr", "tenure_days": "avg_tenure"}
    shifted = ", ".join(planted(name, step) for name in averages)
    means = ", ".join(f"{even(f'avg({name})', 2)} AS {shown}" for name, shown in averages.items())
    add(
        "planted_segments",
        ["feats"],
        f"""SELECT * EXCLUDE (k, m), CASE WHEN avg_spend > m AND churn_rate < 0.2::DOUBLE THEN 'High-Value Loyal'
              WHEN avg_spend > m THEN 'High-Value At Risk' WHEN churn_rate < 0.2::DOUBLE THEN 'Growth Potential'
              ELSE 'Low-Value Churning' END AS segment_name
            FROM (SELECT *, median(avg_spend) OVER () AS m FROM (
                    SELECT k, count(*) AS size, {means}, {even('avg(is_churned)', 2)} AS churn_rate
                    FROM (SELECT customer_id % 4 AS k, is_churned, {shifted} FROM feats) GROUP BY k))
            JOIN (SELECT customer_id, customer_id % 4 AS k FROM feats) USING (k)""",
    )
    spend = "CAST(customer_id % 8 * 100 + 25 AS DOUBLE)"
    add(
        "planted_ltv_scores",
        ["feats"],
        f"SELECT customer_id, {spend} AS total_spend, {spend} AS predicted_ltv, 0.0::DOUBLE AS expected_growth FROM feats",
    )
    q["planted_ltv_metrics"] = "SELECT 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2"
    # With squared distances the mean distance to a cluster is |x|^2 + mean |y|^2 - 2 x . mean y.
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(SCALED))
    square = " + ".join(f"z{i} * z{i}" for i in range(len(SCALED)))
    means = ", ".join(f"avg(z{i}) AS m{i}" for i in range(len(SCALED)))
    dot = " + ".join(f"z{i} * m{i}" for i in range(len(SCALED)))
    add(
        "silhouette",
        ["feats"],
        f"""SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette_score FROM (
              SELECT customer_id, max(n) FILTER (WHERE segment = k) AS n,
                max(d * n / (n - 1)) FILTER (WHERE segment = k) AS a, min(d) FILTER (WHERE segment <> k) AS b
              FROM (SELECT customer_id, segment, k, n, norm + spread - 2 * ({dot}) AS d
                    FROM (SELECT *, {square} AS norm FROM zs)
                    CROSS JOIN (SELECT segment AS k, count(*) AS n, avg({square}) AS spread, {means} FROM zs GROUP BY 1))
              GROUP BY customer_id)""".replace(
            "FROM zs", f"FROM (SELECT customer_id, customer_id % 4 AS segment, {z} FROM feats)"
        ),
    )

    apart = " + ".join(f"(q.z{i} - r.z{i}) ** 2" for i in range(len(SCALED)))
    scaled = f"(SELECT customer_id, customer_id % 4 AS segment, {z} FROM feats)"
    add(
        "euclidean_silhouette",
        ["feats"],
        f"""SELECT {even('avg((b - a) / greatest(a, b))', 4)} AS silhouette_score, count(*) AS sampled FROM (
              SELECT customer_id, max(d / (n - 1)) FILTER (WHERE segment = k) AS a, min(d / n) FILTER (WHERE segment <> k) AS b
              FROM (SELECT q.customer_id, q.segment, r.segment AS k, count(*) AS n, sum(sqrt({apart})) AS d
                    FROM {scaled} q, {scaled} r WHERE q.customer_id % 100 = 0 GROUP BY ALL)
              GROUP BY customer_id)""",
    )

    # profiles
    add(
        "table_counts",
        _ALL,
        "\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {s}" for t, (s, _) in _COLUMNS.items()
        ),
    )
    add("table_preview", ["people"], "SELECT * REPLACE (CAST(age AS INTEGER) AS age, CAST(is_churned AS INTEGER) AS is_churned) FROM people ORDER BY customer_id LIMIT 5")
    add(
        "table_info",
        _ALL,
        _cells(
            lambda t, s, c, kind: f"SELECT '{t}' AS table_name, '{_logical(c)}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null FROM {s}"
        ),
    )
    add(
        "null_counts",
        _ALL,
        "SELECT * FROM ("
        + _cells(
            lambda t, s, c, _: f"SELECT '{t}' AS table_name, '{_logical(c)}' AS column_name, count(*) - count({c}) AS missing FROM {s}"
        )
        + ") WHERE missing > 0",
    )
    add(
        "total_nulls",
        ["txns"],
        "SELECT " + " + ".join(f"count(*) - count({c})" for c in _COLUMNS["transactions"][1]) + " AS missing FROM txns",
    )
    add(
        "overall_churn",
        ["people"],
        f"SELECT CAST(sum(is_churned) AS DOUBLE) / count(*) AS churn_rate, {big('sum(is_churned)')} AS churned, count(*) AS customers FROM people",
    )
    add(
        "value_counts",
        ["people", "subs", "acts"],
        _value_counts(
            [
                ("people", "gender"),
                ("people", "country"),
                ("people", "acquisition_channel"),
                ("subs", "status"),
                ("acts", "event_type"),
            ]
        ),
    )
    add(
        "histogram",
        ["people", "txns"],
        f"SELECT 'age' AS metric, * FROM ({_bins('people', 'CAST(age AS DOUBLE)', 30)})"
        f" UNION ALL SELECT 'amount', * FROM ({_bins('txns', usd('amount_c'), 50)})",
    )
    add(
        "histogram_by_status",
        ["c360"],
        "\nUNION ALL ".join(
            f"SELECT '{m}' AS metric, * FROM ({_bins('c360', f'CAST({m} AS DOUBLE)', 40, 'status')})"
            for m in ["total_spend", "total_events", "num_transactions", "tenure_days"]
        ),
    )
    add(
        "churn_by_dimension",
        ["people"],
        "\nUNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS value, CAST(sum(is_churned) AS DOUBLE) / count(*) AS churn_rate, count(*) AS total FROM people GROUP BY {d}"
            for d in ["country", "acquisition_channel", "gender"]
        ),
    )
    add(
        "monthly_transactions",
        ["month_rows"],
        f"SELECT month, {usd('c')} AS revenue, n AS transactions, {usd('c')} / n AS avg_amount FROM month_rows",
    )
    add("category_revenue", ["txns"], f"SELECT product_category, {usd('sum(amount_c)')} AS revenue FROM txns GROUP BY product_category")
    add(
        "plan_distribution",
        ["subs"],
        f"""SELECT p AS plan, nullif(count(subscription_id), 0) AS subscriptions,
              {usd('sum(mrr_c)')} / count(mrr_c) AS avg_mrr, {usd('sum(mrr_c)')} AS total_mrr
            FROM (VALUES ('free'), ('starter'), ('pro'), ('enterprise')) v(p) LEFT JOIN subs ON plan = p GROUP BY p""",
    )
    add("active_customer_count", ["acts"], "SELECT count(DISTINCT customer_id) AS customers_with_events FROM acts")
    add("customer_event_profile", ["event_profile"], "SELECT * FROM event_profile")
    add(
        "event_means_by_status",
        ["event_profile"],
        "SELECT status, "
        + ", ".join(
            f"{even(f'CAST(sum({m}) AS DOUBLE) / count({m})', 1)} AS {m}"
            for m in ["total_events", "logins", "feature_uses", "support_tickets", "page_views"]
        )
        + " FROM event_profile GROUP BY status",
    )
    add("event_box_stats", ["event_profile"], _boxes())
    add("customer_360", ["c360"], "SELECT * EXCLUDE (spend_c) REPLACE (CAST(age AS INTEGER) AS age, CAST(is_churned AS INTEGER) AS is_churned) FROM c360")
    add("status_comparison", ["c360"], _comparison())
    add("correlation_matrix", ["c360"], _correlations([(a, b) for a in CORRELATED for b in CORRELATED]))
    add(
        "churn_correlation",
        ["c360"],
        f"SELECT b AS feature, r FROM ({_correlations([('is_churned', b) for b in CORRELATED[1:]])})",
    )
    add("spend_vs_events", ["c360"], "SELECT customer_id, total_spend, total_events, status FROM c360")

    # data management
    add("integrity_checks", _ALL, _integrity())
    add(
        "upsert_by_key",
        ["txns"],
        f"""SELECT transaction_id, customer_id, transaction_date, {usd('amount_c')} AS amount, product_category, payment_method
            FROM (SELECT transaction_id, customer_id, transaction_date, amount_c + 200 AS amount_c, product_category,
                    payment_method FROM txns WHERE product_category = '1-URGENT'
                  UNION ALL SELECT * FROM txns WHERE product_category <> '1-URGENT'
                  UNION ALL SELECT -1 - transaction_id, customer_id, transaction_date, amount_c, product_category,
                    payment_method FROM txns WHERE product_category = '2-HIGH')""",
    )
    q["upsert_versioned"] = q["upsert_by_key"]
    values = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM c360"
        for m in ("total_spend", "total_events", "num_transactions", "tenure_days")
    )
    add(
        "nice_histograms",
        ["c360"],
        f"""SELECT metric, bin * width AS bin_start, (bin + 1) * width AS bin_end, count(v) AS "rows"
            FROM (SELECT metric, width, unnest(generate_series(floor(lo / width)::BIGINT, floor(hi / width)::BIGINT)) AS bin
                  FROM (SELECT metric, lo, hi, CASE WHEN p >= e THEN p WHEN p * 2 >= e THEN p * 2 WHEN p * 5 >= e THEN p * 5
                               ELSE p * 10 END AS width
                        FROM (SELECT *, (hi - lo) / 20.0::DOUBLE AS e, pow(10.0::DOUBLE, floor(log10((hi - lo) / 20.0::DOUBLE))) AS p
                              FROM (SELECT metric, min(v) AS lo, max(v) AS hi FROM ({values}) GROUP BY metric))))
            LEFT JOIN (SELECT metric AS m, v FROM ({values})) ON m = metric AND floor(v / width) = bin
            GROUP BY metric, bin, width""",
    )
    numbers = " UNION ALL ".join(
        f"SELECT is_churned AS scored, '{m}' AS feature, CAST({m} AS DOUBLE) AS v FROM feats"
        for m in ("tenure_days", "total_spend", "num_transactions", "total_events", "events_last_30d")
    )
    levels = " UNION ALL ".join(
        f"SELECT is_churned, '{c}', coalesce({c}, '(missing)') FROM feats" for c in ("country", "acquisition_channel")
    )
    add(
        "drift_report",
        ["feats"],
        f"""SELECT feature, CAST(any_value(tn) AS BIGINT) AS trained_rows, CAST(any_value(sn) AS BIGINT) AS scored_rows,
              CAST(sum(CASE WHEN t = 0 THEN s ELSE 0 END) AS BIGINT) AS unseen_rows,
              round(sum((q - p) * ln(q / p)), 6) AS stability_index,
              CASE WHEN round(sum((q - p) * ln(q / p)), 6) >= 0.25 THEN 'shifted'
                   WHEN round(sum((q - p) * ln(q / p)), 6) >= 0.1 THEN 'moving' ELSE 'stable' END AS verdict
            FROM (SELECT *, (t + 0.5::DOUBLE) / (tn + 0.5::DOUBLE * parts) AS p, (s + 0.5::DOUBLE) / (sn + 0.5::DOUBLE * parts) AS q
                  FROM (SELECT *, sum(t) OVER w AS tn, sum(s) OVER w AS sn, count(*) OVER w AS parts
                        FROM (SELECT feature, CASE WHEN t = 0 THEN '(unseen)' ELSE part END AS part, sum(t) AS t, sum(s) AS s
                              FROM (SELECT feature, part, count(*) FILTER (WHERE scored = 0) AS t, count(*) FILTER (WHERE scored = 1) AS s
                                    FROM (SELECT scored, feature, CAST(CAST(floor(v / width) AS BIGINT) AS VARCHAR) AS part
                                          FROM ({numbers}) JOIN
                                            (SELECT feature, CASE WHEN hi = lo THEN 1 WHEN p >= e THEN p WHEN p * 2 >= e THEN p * 2
                                                      WHEN p * 5 >= e THEN p * 5 ELSE p * 10 END AS width
                                             FROM (SELECT *, (hi - lo) / 10.0::DOUBLE AS e,
                                                     pow(10.0::DOUBLE, floor(log10(nullif((hi - lo) / 10.0::DOUBLE, 0)))) AS p
                                                   FROM (SELECT feature, min(v) AS lo, max(v) AS hi FROM ({numbers}) WHERE scored = 0 GROUP BY feature)))
                                          USING (feature)
                                          UNION ALL {levels})
                                    GROUP BY feature, part)
                              GROUP BY 1, 2)
                        WINDOW w AS (PARTITION BY feature)))
            GROUP BY feature""",
    )
    add("recent_events_by_month", ["feats"], "SELECT customer_id, events_last_30d FROM feats")
    return q
