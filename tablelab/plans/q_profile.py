"""Registered queries: sources (S) and profile / health (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.functions import fixed
from tablelab.operators import profile as P
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.registry import per_column, register, union_all

LI_NULLS_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_NULLS_NUM = LI_NULLS_COLS[:8]
LI_NULLS_CAT = ["l_returnflag", "l_linestatus"]
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# DuckDB type name -> Spark simpleString, and role
DUCK_DTYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT' THEN 'float'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END"""


def _r(x: str, d: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


# ------------------------------------------------------------------ sources

@register("source_parquet_scan", "SELECT count(*) AS n_rows, sum(l_quantity) AS sum_qty FROM lineitem", "S2", "S4")
def source_parquet_scan(spark, sf_dir):
    from tablelab.sources.io import load_table
    df = load_table(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


# ------------------------------------------------------------------ P1-P3

ROLES_ORACLE = with_fixtures(
    """
    WITH chk AS (SELECT count(event_type) = count(try_cast(event_type AS TIMESTAMP)) AS et,
                        count(day) = count(try_cast(day AS TIMESTAMP)) AS d,
                        count(day_dirty) = count(try_cast(day_dirty AS TIMESTAMP)) AS dd
                 FROM ev_datestr)
    SELECT 0 AS ordinal, 'event_id' AS "column", 'bigint' AS dtype, 'numeric' AS role
    UNION ALL SELECT 1, 'user_id', 'bigint', 'numeric'
    UNION ALL SELECT 2, 'event_type', 'string', CASE WHEN et THEN 'datetime' ELSE 'categorical' END FROM chk
    UNION ALL SELECT 3, 'value', 'double', 'numeric'
    UNION ALL SELECT 4, 'day', 'string', CASE WHEN d THEN 'datetime' ELSE 'categorical' END FROM chk
    UNION ALL SELECT 5, 'day_dirty', 'string', CASE WHEN dd THEN 'datetime' ELSE 'categorical' END FROM chk
    """, "ev_datestr")


@register("column_roles", ROLES_ORACLE, "P1")
def column_roles(spark, sf_dir):
    return P.column_roles(fixture(spark, sf_dir, "ev_datestr"))


@register("shape", "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem", "P2")
def shape(spark, sf_dir):
    return P.shape(fixture(spark, sf_dir, "lineitem"))


@register("dtypes", f"""
    SELECT CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS "column", {DUCK_DTYPE} AS dtype
    FROM information_schema.columns WHERE table_name = 'orders'""", "P3")
def dtypes(spark, sf_dir):
    return P.dtypes(fixture(spark, sf_dir, "orders"))


# ------------------------------------------------------------------ P4-P7

MISSING_ORACLE = with_fixtures(
    "SELECT m.ordinal, m.\"column\", n.n_rows, m.n_missing, "
    "round(m.n_missing * 100.0 / n.n_rows, 2) AS missing_pct, "
    "round((1 - m.n_missing * 1.0 / n.n_rows) * 100, 2) AS density_pct FROM ("
    + per_column(LI_NULLS_COLS, "{i} AS ordinal, '{c}' AS \"column\", count(*) - count({c}) AS n_missing", "li_nulls")
    + ") m, (SELECT count(*) AS n_rows FROM li_nulls) n", "li_nulls")


@register("missing_counts", MISSING_ORACLE, "P4", "P5", "P19")
def missing_counts(spark, sf_dir):
    return P.missing_counts(fixture(spark, sf_dir, "li_nulls"))


@register("duplicate_rows", with_fixtures(
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li_dups)) AS BIGINT) AS n_duplicates "
    "FROM li_dups", "li_dups"), "P6")
def duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(fixture(spark, sf_dir, "li_dups"))


def _mem_sql() -> str:
    widths = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
              "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8}
    parts = [f"count(*) * {w}" for w in widths.values()]
    parts += ["coalesce(sum(strlen(l_returnflag)), 0)", "coalesce(sum(strlen(l_linestatus)), 0)"]
    total = " + ".join(parts)
    return with_fixtures(f"SELECT CAST({total} AS BIGINT) AS bytes, round(({total}) / (1024.0 * 1024.0), 2) AS memory_mb "
                         "FROM li_nulls", "li_nulls")


@register("memory_estimate", _mem_sql(), "P7")
def memory_estimate(spark, sf_dir):
    return P.memory_estimate(fixture(spark, sf_dir, "li_nulls"))


# ------------------------------------------------------------------ P8, P9

NUMSUM_ORACLE = with_fixtures(per_column(
    LI_NULLS_NUM,
    "{i} AS ordinal, '{c}' AS \"column\", count({c}) AS count, " + ", ".join([
        _r("avg({c})") + " AS mean", _r("stddev_samp({c})") + " AS std", _r("min({c})") + " AS min",
        _r("quantile_cont({c}, 0.25)") + " AS q25", _r("quantile_cont({c}, 0.5)") + " AS q50",
        _r("quantile_cont({c}, 0.75)") + " AS q75", _r("max({c})") + " AS max"]),
    "li_nulls"), "li_nulls")


@register("numeric_summary", NUMSUM_ORACLE, "P8")
def numeric_summary(spark, sf_dir):
    return P.numeric_summary(fixture(spark, sf_dir, "li_nulls"), LI_NULLS_NUM)


def _cat_long(cols: list[str], source: str) -> str:
    return union_all([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS s FROM {source}" for c in cols])


CATSUM_ORACLE = with_fixtures(f"""
    WITH vc AS (SELECT "column", s, count(*) AS cnt FROM ({_cat_long(LI_NULLS_CAT, 'li_nulls')}) x
                WHERE s IS NOT NULL GROUP BY "column", s),
         rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, s) AS rn,
                       count(*) OVER (PARTITION BY "column") AS n_unique FROM vc)
    SELECT "column", n_unique, s AS top, cnt AS freq FROM rk WHERE rn = 1""", "li_nulls")


@register("categorical_summary", CATSUM_ORACLE, "P9")
def categorical_summary(spark, sf_dir):
    return P.categorical_summary(fixture(spark, sf_dir, "li_nulls"), LI_NULLS_CAT)


# ------------------------------------------------------------------ P10

def _pii_sql(source: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        for kind, pat in fixed.PII_PATTERNS.items():
            parts.append(
                f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS pii_type, "
                f"CAST(count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '^(?:{pat})')) AS BIGINT) AS n_match "
                f"FROM {source}")
    return f"SELECT *, n_match > 0 AS detected FROM ({union_all(parts)}) t"


@register("pii_detection", with_fixtures(_pii_sql("pii_strings", ["c_custkey", "c_name", "contact"]),
                                         "pii_strings"), "P10")
def pii_detection(spark, sf_dir):
    return P.pii_detection(fixture(spark, sf_dir, "pii_strings"))


@register("pii_documents", _pii_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]), "P10")
def pii_documents(spark, sf_dir):
    return P.pii_detection(fixture(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ P11-P15, P23

def _issues_sql(source: str, cols: list[str], cats: list[str]) -> str:
    miss = per_column(cols, "'{c}' AS \"column\", round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct", source)
    parts = [f"""SELECT 'missing' AS kind, "column",
                 CASE WHEN pct > 50 THEN 'CRITICAL' WHEN pct > 20 THEN 'HIGH' ELSE 'MODERATE' END AS severity,
                 CAST(pct AS DOUBLE) AS value FROM ({miss}) m WHERE pct > 5""",
             f"""SELECT 'duplicates', CAST(NULL AS VARCHAR), 'HIGH', CAST(d AS DOUBLE) FROM
                 (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS d FROM {source})
                 WHERE d > 0"""]
    if cats:
        parts.append(f"""SELECT 'imbalance', "column", 'HIGH', round(top_share, 6) FROM (
                 SELECT "column", count(*) AS nu, max(cnt) * 1.0 / sum(cnt) AS top_share FROM (
                   SELECT "column", s, count(*) AS cnt FROM ({_cat_long(cats, source)}) x
                   WHERE s IS NOT NULL GROUP BY "column", s) v GROUP BY "column") g
                 WHERE nu <= 10 AND top_share > 0.9""")
    return union_all(parts)


@register("health_issues", with_fixtures(_issues_sql("li_nulls", LI_NULLS_COLS, LI_NULLS_CAT), "li_nulls"),
          "P11", "P12", "P13")
def health_issues(spark, sf_dir):
    return P.health_issues(fixture(spark, sf_dir, "li_nulls"))


@register("health_issues_dups", with_fixtures(
    _issues_sql("li_dups", ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus"]),
    "li_dups"), "P12")
def health_issues_dups(spark, sf_dir):
    return P.health_issues(fixture(spark, sf_dir, "li_dups"))


@register("severe_imbalance", with_fixtures("""
    SELECT "column", nu AS n_unique, top_share FROM (
      SELECT 'grade' AS "column", count(*) AS nu, max(cnt) * 1.0 / sum(cnt) AS top_share
      FROM (SELECT grade, count(*) AS cnt FROM li_imbalanced WHERE grade IS NOT NULL GROUP BY grade) v) g
    WHERE nu <= 10 AND top_share > 0.9""", "li_imbalanced"), "P13")
def severe_imbalance(spark, sf_dir):
    return P.imbalance(fixture(spark, sf_dir, "li_imbalanced"), ["grade"])


def _label(x: str) -> str:
    return (f"CASE WHEN {x} >= 80 THEN 'Excellent' WHEN {x} >= 60 THEN 'Good' "
            f"WHEN {x} >= 40 THEN 'Fair' ELSE 'Critical' END")


@register("health_score", with_fixtures(f"""
    SELECT n_issues, health_score, {_label('health_score')} AS health_label FROM (
      SELECT CAST(count(*) AS BIGINT) AS n_issues, CAST(greatest(0, 100 - 8 * count(*)) AS INTEGER) AS health_score
      FROM ({_issues_sql('li_nulls', LI_NULLS_COLS, LI_NULLS_CAT)}) i) s""", "li_nulls"), "P14", "P15")
def health_score(spark, sf_dir):
    return P.health_score(fixture(spark, sf_dir, "li_nulls"))


@register("post_clean_health", with_fixtures(f"""
    SELECT n_issues, health_score, {_label('health_score')} AS health_label FROM (
      SELECT CAST(count(*) FILTER (WHERE pct > 20) AS BIGINT) AS n_issues,
             CAST(greatest(0, 100 - 8 * count(*) FILTER (WHERE pct > 20)) AS INTEGER) AS health_score
      FROM ({per_column(LI_NULLS_COLS, "round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct", 'li_nulls')}) m) s""",
    "li_nulls"), "P23")
def post_clean_health(spark, sf_dir):
    return P.post_clean_health(fixture(spark, sf_dir, "li_nulls"))


# ------------------------------------------------------------------ P16

def _target_sql() -> str:
    rows = []
    for i, c in enumerate(LI_NULLS_COLS):
        lc = c.lower()
        if lc in fixed.ID_LIKE_NAMES or any(h in lc for h in fixed.ID_LIKE_SUBSTRINGS):
            continue
        name_score = 3 if any(h in lc for h in fixed.TARGET_NAME_HINTS) else 0
        isnum = "TRUE" if c in LI_NULLS_NUM else "FALSE"
        rows.append(f"SELECT {i} AS ordinal, '{c}' AS \"column\", {isnum} AS is_numeric, {name_score} AS name_score, "
                    f"count(DISTINCT {c}) AS nu, (count(*) - count({c})) * 100.0 / count(*) AS mp FROM li_nulls")
    types = f"SELECT column_name AS \"column\", {DUCK_DTYPE} AS dtype FROM information_schema.columns WHERE table_name = 'lineitem'"
    return with_fixtures(f"""
        WITH st AS ({union_all(rows)}),
             sc AS (SELECT st.*, t.dtype, CAST(name_score + CASE WHEN nu <= 20 THEN 2 ELSE 0 END
                          + CASE WHEN is_numeric AND nu > 20 THEN 2 ELSE 0 END
                          - CASE WHEN mp > 50 THEN 2 WHEN mp > 20 THEN 1 ELSE 0 END AS INTEGER) AS hint_score
                    FROM st JOIN ({types}) t USING ("column")),
             rk AS (SELECT *, row_number() OVER (ORDER BY hint_score DESC, ordinal) AS rank FROM sc WHERE hint_score > 0)
        SELECT CAST(rank AS INTEGER) AS rank, "column", dtype, CAST(nu AS BIGINT) AS n_unique,
               round(mp, 2) AS missing_pct, hint_score FROM rk WHERE rank <= 8""", "li_nulls")


@register("target_candidates", _target_sql(), "P16")
def target_candidates(spark, sf_dir):
    return P.target_candidates(fixture(spark, sf_dir, "li_nulls"))


# ------------------------------------------------------------------ P17, P18, P20-P22, P24

@register("preview", """
    SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""", "P17")
def preview(spark, sf_dir):
    return P.preview(fixture(spark, sf_dir, "lineitem"), LI_KEY, 10)


def _detail_sql() -> str:
    types = f"SELECT column_name AS \"column\", {DUCK_DTYPE} AS dtype FROM information_schema.columns WHERE table_name = 'lineitem'"
    base = per_column(LI_NULLS_COLS,
                      "{i} AS ordinal, '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
                      "round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, "
                      "CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique", "li_nulls")
    samples = per_column(LI_NULLS_COLS,
                         "'{c}' AS \"column\", list(CAST({c} AS VARCHAR) ORDER BY l_orderkey, l_linenumber, l_partkey, "
                         "l_suppkey) FILTER (WHERE {c} IS NOT NULL)[1:5] AS sample_values", "li_nulls")
    num = per_column(LI_NULLS_NUM, "'{c}' AS \"column\", " + ", ".join([
        _r("min({c})") + " AS min", _r("max({c})") + " AS max", _r("avg({c})") + " AS mean",
        _r("stddev_samp({c})") + " AS std", _r("skewness({c})") + " AS skewness"]), "li_nulls")
    return with_fixtures(f"""
        SELECT b.ordinal, b."column", t.dtype, b.n_missing, b.missing_pct, b.n_unique, s.sample_values,
               n.min, n.max, n.mean, n.std, n.skewness
        FROM ({base}) b JOIN ({types}) t USING ("column") LEFT JOIN ({samples}) s USING ("column")
        LEFT JOIN ({num}) n USING ("column")""", "li_nulls")


@register("column_detail", _detail_sql(), "P18")
def column_detail(spark, sf_dir):
    return P.column_detail(fixture(spark, sf_dir, "li_nulls"), LI_KEY)


LI_CONST_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "k", "n"]


@register("column_flags", with_fixtures(
    "SELECT ordinal, \"column\", round(nn * 100.0 / n_rows, 2) AS density_pct, nu = 1 AS is_constant, "
    "(nu * 1.0 / n_rows < 0.01 AND nu > 1) AS is_near_constant, FALSE AS is_high_cardinality FROM ("
    + per_column(LI_CONST_COLS, "{i} AS ordinal, '{c}' AS \"column\", count({c}) AS nn, count(*) AS n_rows, "
                 "count(DISTINCT {c}) AS nu", "li_const") + ") x", "li_const"), "P19", "P20", "P21", "P22")
def column_flags(spark, sf_dir):
    return P.column_flags(fixture(spark, sf_dir, "li_const"))


@register("high_cardinality", """
    SELECT ordinal, "column", round(nn * 100.0 / n_rows, 2) AS density_pct, nu = 1 AS is_constant,
           (nu * 1.0 / n_rows < 0.01 AND nu > 1) AS is_near_constant, (is_cat AND nu > 100) AS is_high_cardinality
    FROM (SELECT 0 AS ordinal, 'p_partkey' AS "column", FALSE AS is_cat, count(p_partkey) AS nn, count(*) AS n_rows, count(DISTINCT p_partkey) AS nu FROM part
          UNION ALL SELECT 1, 'p_name', TRUE, count(p_name), count(*), count(DISTINCT p_name) FROM part
          UNION ALL SELECT 2, 'p_brand', TRUE, count(p_brand), count(*), count(DISTINCT p_brand) FROM part
          UNION ALL SELECT 3, 'p_type', TRUE, count(p_type), count(*), count(DISTINCT p_type) FROM part
          UNION ALL SELECT 4, 'p_size', FALSE, count(p_size), count(*), count(DISTINCT p_size) FROM part
          UNION ALL SELECT 5, 'p_retailprice', FALSE, count(p_retailprice), count(*), count(DISTINCT p_retailprice) FROM part) x""",
          "P22")
def high_cardinality(spark, sf_dir):
    return P.column_flags(fixture(spark, sf_dir, "part"))


@register("null_safe_output", with_fixtures("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN isnan(l_quantity) OR isinf(l_quantity) THEN NULL ELSE l_quantity END AS l_quantity, l_returnflag
    FROM li_nan""", "li_nan"), "P24")
def null_safe_output(spark, sf_dir):
    return P.null_safe(fixture(spark, sf_dir, "li_nan"))


# ------------------------------------------------------------------ flagship

def _profile_sql() -> str:
    types = (f"SELECT column_name AS \"column\", {DUCK_DTYPE} AS dtype, CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE') "
             "THEN 'numeric' WHEN data_type = 'TIMESTAMP' THEN 'datetime' ELSE 'categorical' END AS role "
             "FROM information_schema.columns WHERE table_name = 'lineitem'")
    base = per_column(LI_NULLS_COLS,
                      "{i} AS ordinal, '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
                      "round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, "
                      "CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique", "li_nulls")
    num = per_column(LI_NULLS_NUM, "'{c}' AS \"column\", " + ", ".join([
        _r("avg({c})") + " AS mean", _r("stddev_samp({c})") + " AS std", _r("min({c})") + " AS min",
        _r("quantile_cont({c}, 0.25)") + " AS q25", _r("quantile_cont({c}, 0.5)") + " AS q50",
        _r("quantile_cont({c}, 0.75)") + " AS q75", _r("max({c})") + " AS max"]), "li_nulls")
    cat = f"""SELECT "column", s AS top, CAST(cnt AS BIGINT) AS freq FROM (
                SELECT "column", s, cnt, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, s) AS rn FROM (
                  SELECT "column", s, count(*) AS cnt FROM ({_cat_long(LI_NULLS_CAT, 'li_nulls')}) x
                  WHERE s IS NOT NULL GROUP BY "column", s) v) r WHERE rn = 1"""
    return with_fixtures(f"""
        SELECT b.ordinal, b."column", t.dtype, t.role, b.n_missing, b.missing_pct, b.n_unique,
               n.mean, n.std, n.min, n.q25, n.q50, n.q75, n.max, c.top, c.freq
        FROM ({base}) b JOIN ({types}) t USING ("column") LEFT JOIN ({num}) n USING ("column")
        LEFT JOIN ({cat}) c USING ("column")""", "li_nulls")


@register("column_profile", _profile_sql(), "P4", "P5", "P8", "P9")
def column_profile(spark, sf_dir):
    return P.column_profile(fixture(spark, sf_dir, "li_nulls"))
