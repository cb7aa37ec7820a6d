"""Driver tables and the derived fixtures built from them.

Each derived fixture is one SQL statement over the driver tables, written once
and run by both engines: Spark binds ``{table}`` placeholders to DataFrames
(``spark.sql(text, table=df)``), the DuckDB oracle binds them to its views.  So
the fixture and its oracle cannot drift apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# FIXED VALUES: derived-fixture definitions.
FIXTURE_SQL = {
    # lineitem with injected nulls (null-dependent operators)
    "li_nulls": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS l_tax,
               CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate
        FROM {lineitem}""",
    # numeric part of li_nulls plus a key
    "li_num": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS l_tax
        FROM {lineitem}""",
    # parts with missing numbers, in several patterns
    "part_nulls": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS p_retailprice,
               CASE WHEN p_partkey % 4 = 0 OR p_partkey % 35 = 0 THEN NULL ELSE CAST(p_partkey % 97 AS DOUBLE) END AS p_mod
        FROM {part}""",
    # few columns -> many duplicate rows
    "li_dups": "SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
    # a constant and an all-null column
    "li_const": """
        SELECT l_orderkey, l_quantity, l_extendedprice, l_discount,
               CAST(1.0 AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS n
        FROM {lineitem}""",
    # a rare class
    "li_imbalanced": """
        SELECT l_orderkey, l_quantity, l_extendedprice,
               CASE WHEN l_orderkey % 50 = 0 THEN 'rare' ELSE 'common' END AS grade
        FROM {lineitem}""",
    # planted outliers
    "li_outliers": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount,
               CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END
                   AS l_extendedprice
        FROM {lineitem}""",
    # right-skewed column with nulls
    "li_skewed": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE exp(l_quantity / 10.0) END AS skewed,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
               l_tax
        FROM {lineitem}""",
    # dates as text: a clean one and one with 1 % junk
    "ev_datestr": """
        SELECT event_id, user_id, event_type, value,
               CAST(CAST(ts AS DATE) AS STRING) AS day,
               CASE WHEN event_id % 100 = 0 THEN 'n/a' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day_dirty
        FROM {events}""",
    # deterministic score / label for metric operators (ties on purpose)
    "det_score": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               l_discount * 10 + l_tax AS score,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               l_quantity AS actual,
               l_quantity * 0.9 + l_discount * 20 AS predicted,
               l_returnflag AS actual_class,
               CASE WHEN l_discount >= 0.05 THEN 'R' WHEN l_tax >= 0.04 THEN 'N' ELSE 'A' END AS predicted_class
        FROM {lineitem}""",
    # modelling frame: numeric features, a regression, a 3-class and a binary target
    "li_ml": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
               l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
        FROM {lineitem}""",
    # conversation text with reasoning blocks on odd turns
    "think_text": """
        SELECT conv_id, turn, role,
               CASE WHEN turn % 2 = 1
                    THEN concat('<think>a', chr(10), 'b</think> ', text)
                    ELSE text END AS text
        FROM {conversations}""",
    # conversation text with a keyword chosen by turn
    "intent_text": """
        SELECT conv_id, turn, role,
               concat(CASE turn % 10
                        WHEN 0 THEN 'Please search for '
                        WHEN 1 THEN 'Show the correlation of '
                        WHEN 2 THEN 'Clean the missing values in '
                        WHEN 3 THEN 'Train a random forest on '
                        WHEN 4 THEN 'Build a neural network for '
                        WHEN 5 THEN 'Plot a heatmap of '
                        WHEN 6 THEN 'Forecast the next value of '
                        WHEN 7 THEN 'Export a summary report of '
                        WHEN 8 THEN 'What is '
                        ELSE '' END, text) AS text
        FROM {conversations}""",
    # assistant replies carrying JSON task plans (valid, empty, missing key, none, broken)
    "plan_text": """
        SELECT conv_id, turn,
               CASE turn % 5
                    WHEN 0 THEN concat('Plan follows. {{"tasks": [{{"agent": "data_analyst", "task": "summarise conversation ',
                                       CAST(conv_id AS STRING), '", "priority": 1}}, {{"agent": "visualizer", "task": "plot turn ',
                                       CAST(turn AS STRING), '", "priority": 2}}]}} Done.')
                    WHEN 1 THEN '{{"tasks": []}}'
                    WHEN 2 THEN concat('{{"note": "no tasks here"}} ', CAST(conv_id AS STRING))
                    WHEN 3 THEN concat('no plan at all for ', CAST(conv_id AS STRING))
                    ELSE concat('{{"tasks": [broken ', CAST(turn AS STRING), '}}') END AS text
        FROM {conversations}""",
    # personal data at the start, in the middle, and none
    "pii_strings": """
        SELECT c_custkey, c_name,
               CASE c_custkey % 6
                    WHEN 0 THEN concat('user', CAST(c_custkey AS STRING), '@example.com')
                    WHEN 1 THEN concat('contact: user', CAST(c_custkey AS STRING), '@example.com')
                    WHEN 2 THEN concat('555-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-1234')
                    WHEN 3 THEN concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-45-6789')
                    WHEN 4 THEN '4111 1111 1111 1111'
                    ELSE 'none' END AS contact
        FROM {customer}""",
    # NaN and infinities in a float column
    "li_nan": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN l_orderkey % 17 = 0 THEN CAST('Infinity' AS DOUBLE)
                    WHEN l_orderkey % 19 = 0 THEN CAST('-Infinity' AS DOUBLE)
                    ELSE l_quantity END AS l_quantity,
               l_returnflag
        FROM {lineitem}""",
    # search-result page markup assembled from pages (half with redirect links)
    "serp_html": """
        SELECT page_id,
               concat('<table><tr><td><a rel="nofollow" class="result-link" href="',
                      CASE WHEN page_id % 2 = 0
                           THEN concat('https://duckduckgo.com/l/?uddg=', replace(replace(url, ':', '%3A'), '/', '%2F'), '&amp;rut=x')
                           ELSE url END,
                      '">Result ', CAST(page_id AS STRING), ' &amp; more</a></td></tr>',
                      '<tr><td class="result-snippet">Snippet <b>', CAST(page_id AS STRING), '</b> for   ', url, '</td></tr>',
                      '<tr><td><a rel="nofollow" class="result-link" href="', url, '">Mirror ', CAST(page_id % 7 AS STRING), '</a></td></tr>',
                      '<tr><td class="result-snippet">Second  snippet</td></tr></table>') AS html
        FROM {pages}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived fixture as a Spark DataFrame (literal
    braces in fixture SQL are doubled, as ``spark.sql`` formats its text)."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = FIXTURE_SQL[name]
    refs = set(_PLACEHOLDER.findall(text))
    return spark.sql(text, **{r: table(spark, sf_dir, r) for r in refs})


def duck_fixture(name: str) -> str:
    """The same fixture as DuckDB SQL over the pre-registered views."""
    text = FIXTURE_SQL[name]
    text = _PLACEHOLDER.sub(lambda m: m.group(1), text)
    return text.replace("{{", "{").replace("}}", "}").replace("AS STRING)", "AS VARCHAR)")


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with CTEs for the named fixtures (merging with a
    leading WITH of the query itself)."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({duck_fixture(n)})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
