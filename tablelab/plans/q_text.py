"""Registered queries: text and web-page operators (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.functions import fixed
from tablelab.operators import text as X
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.q_profile import LI_NULLS_CAT, LI_NULLS_COLS, LI_NULLS_NUM, _issues_sql, _pii_sql
from tablelab.plans.registry import register

CONV_KEY = ["conv_id", "turn"]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_contains(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_lit(w)})" for w in words) + ")"


def _intent_sql(text: str, has_dataset: bool) -> str:
    t = f"lower(coalesce({text}, ''))"
    parts = [f"WHEN {_any_contains(t, kws)} THEN {_lit(name)}" for name, kws in fixed.INTENT_KEYWORDS]
    if has_dataset:
        parts.append(f"WHEN {_any_contains(t, fixed.QUESTION_MARKERS)} THEN 'data_qa'")
    return "CASE " + " ".join(parts) + " ELSE 'casual_chat' END"


# ------------------------------------------------------------------ X1-X3

@register("intent_label", with_fixtures(
    f"SELECT conv_id, turn, role, text, {_intent_sql('text', False)} AS intent FROM intent_text", "intent_text"), "X1")
def intent_label(spark, sf_dir):
    return X.intent_labels(fixture(spark, sf_dir, "intent_text"))


@register("intent_label_session", with_fixtures(
    f"SELECT conv_id, turn, role, text, {_intent_sql('text', True)} AS intent FROM conversations", "intent_text"), "X1")
def intent_label_session(spark, sf_dir):
    return X.intent_labels(fixture(spark, sf_dir, "conversations"), has_dataset=True)


def _roles_case(col: str) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN [{', '.join(_lit(r) for r in v)}]" for k, v in fixed.INTENT_ROLES.items())
    return f"CASE {col} {whens} END"


@register("route_roles", with_fixtures(f"""
    WITH i AS (SELECT conv_id, turn, {_intent_sql('text', False)} AS intent FROM intent_text),
         r AS (SELECT *, {_roles_case('intent')} AS roles FROM i)
    SELECT conv_id, turn, intent, CAST(unnest(range(len(roles))) AS INTEGER) AS role_seq, unnest(roles) AS agent_role
    FROM r""", "intent_text"), "X2")
def route_roles(spark, sf_dir):
    df = X.intent_labels(fixture(spark, sf_dir, "intent_text")).select("conv_id", "turn", "intent")
    return X.route_roles(df)


@register("search_trigger", with_fixtures(
    f"SELECT conv_id, turn, {_any_contains('lower(coalesce(text, ' + _lit('') + '))', fixed.SEARCH_TRIGGERS)} AS needs_search "
    "FROM intent_text", "intent_text"), "X3")
def search_trigger(spark, sf_dir):
    df = fixture(spark, sf_dir, "intent_text")
    return df.select("conv_id", "turn", X.search_trigger(F.col("text")).alias("needs_search"))


# ------------------------------------------------------------------ X4-X6

WS = "[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]"  # Unicode white space, spelled out
STRIP = "regexp_replace({x}, '^" + WS + "+|" + WS + "+$', '', 'g')"


@register("strip_think", with_fixtures(
    "SELECT conv_id, turn, " + STRIP.format(x="regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')")
    + " AS text FROM think_text", "think_text"), "X4")
def strip_think(spark, sf_dir):
    df = fixture(spark, sf_dir, "think_text")
    return df.select("conv_id", "turn", X.strip_think(F.col("text")).alias("text"))


@register("recent_context", """
    SELECT conv_id, turn, role,
           coalesce(array_to_string(list('<|im_start|>' || role || chr(10) || coalesce(text, '') || chr(10) || '<|im_end|>' || chr(10))
                    OVER w, ''), '') AS history,
           CAST(count(*) OVER w AS INTEGER) AS n_history
    FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""", "X5")
def recent_context(spark, sf_dir):
    return X.recent_context(fixture(spark, sf_dir, "conversations"))


PLAN_TYPE = """'[{"agent":"VARCHAR","task":"VARCHAR","priority":"INTEGER"}]'"""


@register("extract_plan", with_fixtures(f"""
    WITH p AS (SELECT conv_id, turn, text, regexp_extract(text, '(?s)\\{{.*\\}}', 0) AS raw FROM plan_text),
         v AS (SELECT *, CASE WHEN raw <> '' AND coalesce(json_valid(raw), false) THEN json_type(raw) = 'OBJECT'
                                ELSE false END AS ok FROM p),
         t AS (SELECT conv_id, turn,
                      CASE WHEN ok THEN coalesce(from_json(json_extract(raw, '$.tasks'), {PLAN_TYPE}), [])
                           ELSE [{{'agent': 'data_analyst', 'task': text, 'priority': 1}}] END AS tasks FROM v)
    SELECT conv_id, turn, CAST(unnest(range(len(tasks))) AS INTEGER) AS task_seq,
           unnest(tasks).agent AS agent, unnest(tasks).task AS task, CAST(unnest(tasks).priority AS INTEGER) AS priority
    FROM t""", "plan_text"), "X6")
def extract_plan(spark, sf_dir):
    return X.extract_plan(fixture(spark, sf_dir, "plan_text"), keys=CONV_KEY)


# ------------------------------------------------------------------ X7, X8

def _collapse_sql(x: str) -> str:
    return STRIP.format(x=f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")


def _unescape_sql(x: str) -> str:
    # the entities present in the driver pages; '&amp;' last so decoding is single-pass
    for ent, ch in [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, {_lit(ent)}, {_lit(ch)})"
    return x


def _html_text_sql(h: str) -> str:
    t = f"regexp_replace({h}, '(?i)<script[^>]*>[\\s\\S]*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<style[^>]*>[\\s\\S]*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    return _collapse_sql(_unescape_sql(t))


@register("collapse_whitespace", f"""
    SELECT doc_id, {_collapse_sql('text')} AS clean_text, CAST(length({_collapse_sql('text')}) AS INTEGER) AS n_clean
    FROM documents""", "X7")
def collapse_whitespace(spark, sf_dir):
    df = fixture(spark, sf_dir, "documents")
    c = X.collapse_ws(F.col("text"))
    return df.select("doc_id", c.alias("clean_text"), F.length(c).alias("n_clean"))


@register("html_to_text", f"""
    WITH t AS (SELECT page_id, {_html_text_sql('html')} AS t FROM pages)
    SELECT page_id, CASE WHEN length(t) > 3000 THEN regexp_replace(substring(t, 1, 3000), '{WS}+$', '') || '...' ELSE t END AS text
    FROM t""", "X8")
def html_to_text(spark, sf_dir):
    df = fixture(spark, sf_dir, "pages")
    return df.select("page_id", X.html_to_text(F.col("html"), fixed.PAGE_TEXT_MAX_CHARS).alias("text"))


@register("html_full_text", f"""
    WITH big AS (SELECT page_id, repeat(html, CAST(ceil(220000.0 / length(html)) AS INTEGER)) || '&nbsp;&nbsp;the end' AS html FROM pages
                 WHERE page_id % 10 = 0 UNION ALL SELECT -1 - page_id, html FROM pages)
    SELECT page_id, length(t) AS n, t[-200:] AS tail FROM (SELECT page_id, {_html_text_sql('html')} AS t FROM big) x""", "X7", "X8")
def html_full_text(spark, sf_dir):
    """Whole pages, and pages repeated beyond 220,000 characters: nothing is cut."""
    df = fixture(spark, sf_dir, "pages").select("page_id", "html")
    big = df.where("page_id % 10 = 0").select("page_id", F.concat(F.repeat("html", F.ceil(
        F.lit(220000.0) / F.length("html")).cast("int")), F.lit("&nbsp;&nbsp;the end")).alias("html"))
    text = X.html_to_text(F.col("html"))
    return big.unionByName(df.select((-1 - F.col("page_id")).alias("page_id"), "html")).select(
        "page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.substring("t", -200, 200).alias("tail"))


# ------------------------------------------------------------------ X9-X13

def _serp_sql(max_results: int = 10) -> str:
    link = fixed.LINK_RE.replace("'", "''")
    snip = fixed.SNIPPET_RE.replace("'", "''")
    return f"""
    WITH e AS (SELECT page_id, regexp_extract_all(html, '{link}', 1) AS hrefs, regexp_extract_all(html, '{link}', 2) AS titles,
                      regexp_extract_all(html, '{snip}', 1) AS snips FROM serp_html),
         z AS (SELECT page_id, snips, unnest(range(least(len(hrefs), {max_results}))) AS pos,
                      unnest(hrefs[1:{max_results}]) AS href, unnest(titles[1:{max_results}]) AS title FROM e),
         d AS (SELECT *, regexp_extract(regexp_extract(href, '^[^?#]*\\?([^#]*)', 1), '(?:^|&)uddg=([^&]*)', 1) AS v FROM z)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, {_collapse_sql(_unescape_sql('title'))} AS title,
           CASE WHEN v <> '' THEN url_decode(v) ELSE href END AS url,
           coalesce(CASE WHEN pos < len(snips) THEN {_collapse_sql(STRIP.format(x=_unescape_sql("regexp_replace(snips[pos + 1], '<[^>]+>', ' ', 'g')")))} END, '') AS snippet
    FROM d"""


@register("serp_results", with_fixtures(_serp_sql(), "serp_html"), "X9", "X10")
def serp_results(spark, sf_dir):
    return X.serp_results(fixture(spark, sf_dir, "serp_html"), "page_id")


@register("redirect_decode", """
    SELECT page_id, url AS href, url AS decoded FROM pages
    UNION ALL
    SELECT page_id, 'https://duckduckgo.com/l/?uddg=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&amp;rut=1',
           url_decode(regexp_extract(regexp_extract('https://duckduckgo.com/l/?uddg=' || replace(replace(url, ':', '%3A'), '/', '%2F')
                      || '&amp;rut=1', '^[^?#]*\\?([^#]*)', 1), '(?:^|&)uddg=([^&]*)', 1))
    FROM pages""", "X10")
def redirect_decode(spark, sf_dir):
    p = fixture(spark, sf_dir, "pages")
    red = F.concat(F.lit("https://duckduckgo.com/l/?uddg="),
                   F.replace(F.replace(F.col("url"), F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("&amp;rut=1"))
    a = p.select("page_id", F.col("url").alias("href"))
    b = p.select("page_id", red.alias("href"))
    return a.unionByName(b).select("page_id", "href", X.redirect_decode(F.col("href")).alias("decoded"))


@register("dedup_urls", with_fixtures(f"""
    SELECT page_id, pos, title, url, snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM ({_serp_sql()}) r WHERE url <> '') x
    WHERE rn = 1""", "serp_html"), "X11")
def dedup_urls(spark, sf_dir):
    return X.dedup_urls(X.serp_results(fixture(spark, sf_dir, "serp_html"), "page_id"), "page_id")


@register("citations", with_fixtures(f"""
    SELECT page_id, pos, coalesce(title, url) AS title, url, snippet
    FROM ({_serp_sql()}) r WHERE pos < 5 AND coalesce(url, '') <> ''""", "serp_html"), "X12")
def citations(spark, sf_dir):
    return X.citations(X.serp_results(fixture(spark, sf_dir, "serp_html"), "page_id"), "page_id")


@register("render_context", with_fixtures(f"""
    WITH r AS ({_serp_sql()}),
         l AS (SELECT page_id, count(*) AS n,
                      string_agg('[' || CAST(pos + 1 AS VARCHAR) || '] ' || title || chr(10) || '    URL: ' || url || chr(10)
                                 || '    Summary: ' || snippet, chr(10) ORDER BY pos) AS body
               FROM r WHERE pos < 3 GROUP BY page_id),
         t AS (SELECT page_id, url, {_html_text_sql('html')} AS t FROM pages)
    SELECT l.page_id, CASE WHEN t.page_id IS NOT NULL
                           THEN '=== WEB SEARCH RESULTS ===' || chr(10) || body || chr(10) || chr(10) || '=== PAGE EXCERPTS ===' || chr(10)
                                || 'Source: ' || t.url || ' — ' || t.url || chr(10) || 'Excerpt: ' || substring(t.t, 1, 600)
                           ELSE '=== WEB SEARCH RESULTS ===' || chr(10) || body END AS context,
           CAST(n AS INTEGER) AS n_results
    FROM l LEFT JOIN t ON l.page_id = t.page_id
    UNION ALL SELECT -1 - page_id, '[No web search results found]', 0 FROM pages""", "serp_html"), "X13")
def render_context(spark, sf_dir):
    res = X.serp_results(fixture(spark, sf_dir, "serp_html"), "page_id")
    none = fixture(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("page_id"))  # searches without results
    res = res.unionByName(none, allowMissingColumns=True)
    pages = fixture(spark, sf_dir, "pages")
    pt = pages.select("page_id", F.col("url").alias("title"), "url",
                      X.html_to_text(F.col("html")).alias("text"))
    return X.render_context(res, pt, "page_id")


# ------------------------------------------------------------------ X14, X15

@register("output_digest", """
    WITH last AS (SELECT conv_id, role, max_by(text, turn) AS t FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, string_agg('**' || upper(left(role, 1)) || lower(substring(role, 2)) || ':** ' || substring(coalesce(t, ''), 1, 400),
                               chr(10) || chr(10) ORDER BY role) AS digest
    FROM last GROUP BY conv_id""", "X14")
def output_digest(spark, sf_dir):
    return X.output_digest(fixture(spark, sf_dir, "conversations"))


def _pylist_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"''{i}''" for i in items) + "]"


def _context_sql() -> str:
    cols, num, cat = LI_NULLS_COLS, LI_NULLS_NUM, LI_NULLS_CAT
    issues = _issues_sql("li_nulls", cols, cat)
    pii = _pii_sql("li_nulls", cols)
    return with_fixtures(f"""
        WITH iss AS ({issues}),
             sc AS (SELECT CAST(greatest(0, 100 - 8 * count(*)) AS INTEGER) AS s FROM iss),
             il AS (SELECT coalesce(list(kind || ':' || coalesce("column", '*') || ':' || severity ORDER BY
                                    kind || ':' || coalesce("column", '*') || ':' || severity), []) AS l FROM iss),
             pl AS (SELECT coalesce(list("column" || ':' || pii_type ORDER BY "column" || ':' || pii_type)
                                    FILTER (WHERE detected), []) AS l FROM ({pii}) p)
        SELECT '=== DATASET ===' || chr(10) || 'File: lineitem.parquet' || chr(10)
               || 'Shape: (' || CAST((SELECT count(*) FROM li_nulls) AS VARCHAR) || ', {len(cols)})' || chr(10)
               || 'Columns: {_pylist_sql(cols)}' || chr(10) || 'Numeric: {_pylist_sql(num)}' || chr(10)
               || 'Categorical: {_pylist_sql(cat)}' || chr(10) || 'Health: ' || CAST(sc.s AS VARCHAR) || '/100' || chr(10)
               || 'Issues: [' || array_to_string(list_transform(il.l, lambda x: '''' || x || ''''), ', ') || ']' || chr(10)
               || 'PII: [' || array_to_string(list_transform(pl.l, lambda x: '''' || x || ''''), ', ') || ']' || chr(10) AS context
        FROM sc, il, pl""", "li_nulls")


@register("dataset_context", _context_sql(), "X15")
def dataset_context(spark, sf_dir):
    return X.dataset_context(fixture(spark, sf_dir, "li_nulls"), "lineitem.parquet")

