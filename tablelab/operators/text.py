"""Text and web-page operators over table columns.

All of them are column expressions (JVM-side, whole texts) except HTML entity
decoding, whose full table only exists in Python: that one step is an
Arrow-batched pandas UDF applied only to values containing ``&``.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions import fixed
from tablelab.functions.stats import prefix_sums, q

# --------------------------------------------------------------------------
# small column helpers
# --------------------------------------------------------------------------

WS = r"(?U)[\s\x1c-\x1f]+"  # Unicode white space: also no-break and ideographic spaces


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` on whitespace."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace -> one space, trimmed, null -> ''."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else v)


def unescape(c: Column) -> Column:
    """Full HTML entity decoding (the Python table), only where needed."""
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


# --------------------------------------------------------------------------
# X1-X3 intent, routing, search trigger
# --------------------------------------------------------------------------

def intent_expr(text: Column, has_dataset: bool = False) -> Column:
    """First intent (fixed priority) with a keyword contained in the
    lower-cased text; question-like text means data_qa when a dataset is
    loaded; otherwise casual_chat."""
    t = lower(text)
    e = None
    for intent, kws in fixed.INTENT_KEYWORDS:
        hit = F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.contains(t, k))
        e = F.when(hit, F.lit(intent)) if e is None else e.when(hit, F.lit(intent))
    if has_dataset:
        qhit = F.exists(F.array(*[F.lit(k) for k in fixed.QUESTION_MARKERS]), lambda k: F.contains(t, k))
        e = e.when(qhit, F.lit("data_qa"))
    return e.otherwise(F.lit("casual_chat"))


def intent_labels(df: DataFrame, text_col: str = "text", has_dataset: bool = False) -> DataFrame:
    return df.withColumn("intent", intent_expr(q(text_col), has_dataset))


def route_roles(df: DataFrame, intent_col: str = "intent") -> DataFrame:
    """One row per (message, role) from the fixed routing table (a literal
    map, no join)."""
    m = F.create_map(*[x for k, v in fixed.INTENT_ROLES.items()
                       for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return df.select("*", F.posexplode(F.element_at(m, q(intent_col))).alias("role_seq", "agent_role"))


def search_trigger(text: Column) -> Column:
    """Any trigger substring in the lower-cased text."""
    t = lower(text)
    return F.exists(F.array(*[F.lit(k) for k in fixed.SEARCH_TRIGGERS]), lambda k: F.contains(t, k))


# --------------------------------------------------------------------------
# X4-X6 reasoning blocks, recent context, JSON plans
# --------------------------------------------------------------------------

def strip_think(text: Column) -> Column:
    """Drop ``<think>...</think>`` blocks (non-greedy, across lines), strip."""
    return strip_ws(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def recent_context(df: DataFrame, group: str = "conv_id", order: str = "turn", role: str = "role",
                   text: str = "text", k: int = fixed.RECENT_TURNS) -> DataFrame:
    """For every message, the k previous messages of its conversation
    rendered as chat turns (oldest first).

    Positions come from the exact rank table (so a huge conversation is split
    into range buckets), then each message is copied to the k positions after
    it and joined on (conversation, position): only equi-joins on unique keys,
    no window over a whole conversation."""
    base = df.select(q(group).alias("_g"), q(order).alias("_o"), q(role).alias("_r"), q(text).alias("_t"))
    # conversations grow with the data: no broadcast of per-conversation tables
    pos = prefix_sums(base.select("_g", "_o").withColumn("cnt", F.lit(1)), "_g", "_o", ("cnt",),
                      few_groups=False).select("_g", "_o", F.col("cnt_before").alias("_pos"))
    msgs = base.join(pos, ["_g", "_o"])
    rendered = F.concat(F.lit("<|im_start|>"), F.col("_r"), F.lit("\n"), F.coalesce(F.col("_t"), F.lit("")),
                        F.lit("\n<|im_end|>\n"))
    prev = msgs.select("_g", F.col("_pos").alias("_src"), rendered.alias("_line"),
                       F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_d")).select(
        "_g", "_src", "_line", (F.col("_src") + F.col("_d")).alias("_pos"))
    ctx = prev.groupBy("_g", "_pos").agg(
        F.array_sort(F.collect_list(F.struct("_src", "_line"))).alias("_l"))   # at most k entries
    out = msgs.join(ctx, ["_g", "_pos"], "left").select(
        F.col("_g").alias(group), F.col("_o").alias(order), F.col("_r").alias(role),
        F.array_join(F.transform(F.coalesce("_l", F.array().cast("array<struct<_src:long,_line:string>>")),
                                 lambda s: s["_line"]), "").alias("history"),
        F.coalesce(F.size("_l"), F.lit(0)).alias("n_history"))
    return out.withColumn("n_history", F.greatest(F.col("n_history"), F.lit(0)))


PLAN_SCHEMA = "struct<tasks: array<struct<agent: string, task: string, priority: int>>>"


def extract_plan(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The text from the first ``{`` to the last ``}`` parsed as JSON; its
    ``tasks`` list (empty if the key is missing) becomes one row per task.
    No braces or invalid JSON falls back to one data_analyst task carrying
    the whole text with priority 1."""
    keys = keys or []
    raw = F.regexp_extract(q(text_col), r"(?s)\{.*\}", 0)
    valid = (raw != "") & F.json_object_keys(raw).isNotNull()
    tasks = F.from_json(raw, PLAN_SCHEMA)["tasks"]
    default = F.array(F.struct(F.lit("data_analyst").alias("agent"), q(text_col).alias("task"),
                               F.lit(1).alias("priority")))
    chosen = F.when(valid, F.coalesce(tasks, F.array().cast(
        "array<struct<agent: string, task: string, priority: int>>"))).otherwise(default)
    return df.select(*[q(k) for k in keys], F.posexplode(chosen).alias("task_seq", "t")).select(
        *[q(k) for k in keys], "task_seq", "t.agent", "t.task", "t.priority")


# --------------------------------------------------------------------------
# X7-X13 pages and result pages
# --------------------------------------------------------------------------

def html_to_text(html: Column, max_chars: int | None = None) -> Column:
    """Drop script and style blocks, tags -> space, decode entities,
    collapse whitespace; with ``max_chars`` cut there (right-stripped) + '...'."""
    t = F.regexp_replace(html, r"(?i)<script[^>]*>[\s\S]*?</script>", " ")
    t = F.regexp_replace(t, r"(?i)<style[^>]*>[\s\S]*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = collapse_ws(unescape(t))
    if max_chars is None:
        return t
    cut = F.regexp_replace(F.substring(t, 1, max_chars), r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(F.length(t) > max_chars, F.concat(cut, F.lit("..."))).otherwise(t)


def redirect_decode(href: Column) -> Column:
    """The URL-decoded ``uddg`` query parameter of a redirect link, else
    the link itself."""
    query = F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)
    v = F.regexp_extract(query, r"(?:^|&)uddg=([^&]*)", 1)
    return F.when(v != "", F.coalesce(F.try_url_decode(v), v)).otherwise(href)


def serp_results(df: DataFrame, key: str, html_col: str = "html", max_results: int = 10) -> DataFrame:
    """X9 + X10: result links and snippet cells zipped by position (snippet ''
    when missing), at most ``max_results`` per page.
    Output (key, pos, title, url, snippet)."""
    h = q(html_col)
    hrefs = F.regexp_extract_all(h, F.lit(fixed.LINK_RE), 1)
    titles = F.regexp_extract_all(h, F.lit(fixed.LINK_RE), 2)
    snips = F.regexp_extract_all(h, F.lit(fixed.SNIPPET_RE), 1)
    z = df.select(q(key), F.posexplode(F.slice(F.arrays_zip(hrefs.alias("href"), titles.alias("title")),
                                                1, max_results)).alias("pos", "z"), snips.alias("_sn"))
    snippet = F.when(F.col("pos") < F.size("_sn"),
                     collapse_ws(strip_ws(unescape(F.regexp_replace(F.element_at("_sn", F.col("pos") + 1),
                                                                    r"<[^>]+>", " ")))))
    return z.select(q(key), F.col("pos").cast("int").alias("pos"),
                    collapse_ws(unescape(F.col("z.title"))).alias("title"),
                    redirect_decode(F.col("z.href")).alias("url"),
                    F.coalesce(snippet, F.lit("")).alias("snippet"))


def dedup_urls(results: DataFrame, key: str) -> DataFrame:
    """X11: first occurrence of each URL per search, empty URLs dropped
    (groups are one URL of one search: small)."""
    from pyspark.sql import Window
    w = Window.partitionBy(q(key), "url").orderBy("pos")
    return (results.where(F.col("url") != "").withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def citations(results: DataFrame, key: str, k: int = fixed.CITATIONS_MAX) -> DataFrame:
    """The first k results (limit before filter), those with a URL, title
    defaulting to the URL.  ``pos`` is the position in the result list."""
    from pyspark.sql import Window
    w = Window.partitionBy(q(key)).orderBy("pos")   # one search's results
    top = results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.where(F.coalesce(F.col("url"), F.lit("")) != "").select(
        q(key), "pos", F.coalesce("title", "url").alias("title"), "url", "snippet")


def render_context(results: DataFrame, pages_text: DataFrame | None, key: str, max_results: int = 3,
                   excerpt: int = fixed.EXCERPT_MAX_CHARS) -> DataFrame:
    """Numbered result lines (first ``max_results``) and page excerpts cut
    at ``excerpt`` characters, as one text per search.  A search whose results
    are one row with a null position has no results and says so."""
    empty = results.groupBy(q(key)).agg(F.count("pos").alias("_n")).where("_n = 0").select(
        q(key), F.lit(fixed.NO_RESULTS_LINE).alias("context"), F.lit(0).alias("n_results"))
    top = results.where(F.col("pos") < max_results)
    line = F.format_string("[%d] %s\n    URL: %s\n    Summary: %s", F.col("pos") + 1, "title", "url", "snippet")
    lines = top.groupBy(q(key)).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("_a"))
    body = F.concat(F.lit("=== WEB SEARCH RESULTS ===\n"), F.array_join(F.transform("_a", lambda s: s["l"]), "\n"))
    out = lines.select(q(key), body.alias("context"), F.size("_a").alias("n_results"))
    if pages_text is not None:
        ex = pages_text.select(q(key), F.format_string("Source: %s — %s\nExcerpt: %s", "title", "url",
                                                       F.substring("text", 1, excerpt)).alias("_ex"))
        out = out.join(ex, key, "left").select(
            q(key), F.when(F.col("_ex").isNotNull(), F.concat("context", F.lit("\n\n=== PAGE EXCERPTS ===\n"), "_ex"))
            .otherwise(F.col("context")).alias("context"), "n_results")
    return out.unionByName(empty)


# --------------------------------------------------------------------------
# X14 digest, X15 dataset context
# --------------------------------------------------------------------------

def output_digest(df: DataFrame, group: str = "conv_id", role: str = "role", order: str = "turn",
                  text: str = "text", max_chars: int = fixed.DIGEST_MAX_CHARS) -> DataFrame:
    """Each role's latest text cut to ``max_chars``, merged as
    ``**Role:** text`` paragraphs (roles in name order).  Per conversation the
    list has one entry per role, so it is bounded."""
    last = df.groupBy(q(group), q(role)).agg(F.max_by(q(text), q(order)).alias("_t"))
    part = F.concat(F.lit("**"), F.initcap(q(role)), F.lit(":** "), F.substring(F.coalesce("_t", F.lit("")), 1, max_chars))
    return last.groupBy(q(group)).agg(F.array_sort(F.collect_list(F.struct(q(role), part.alias("p")))).alias("_a")).select(
        q(group), F.array_join(F.transform("_a", lambda s: s["p"]), "\n\n").alias("digest"))


def py_list(items: Column) -> Column:
    """Render an array<string> like a Python list literal: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "),
                    F.lit("]"))


def dataset_context(df: DataFrame, filename: str) -> DataFrame:
    """The dataset block handed to the assistant, from the profile."""
    from tablelab.operators.profile import health_issues, health_score, infer_roles, pii_detection
    roles = infer_roles(df)
    spark = df.sparkSession
    meta = spark.createDataFrame([(filename, df.columns, roles["numeric"], roles["categorical"])],
                                 "file string, cols array<string>, num array<string>, cat array<string>")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    hs = health_score(df, roles)
    iss = health_issues(df, roles).agg(F.array_sort(F.collect_list(
        F.concat_ws(":", "kind", F.coalesce("column", F.lit("*")), "severity"))).alias("issues"))   # one per issue
    pii = pii_detection(df).where("detected").agg(F.array_sort(F.collect_list(
        F.concat_ws(":", "column", "pii_type"))).alias("pii"))
    from tablelab.functions.stats import attach
    row = attach(attach(attach(attach(meta, n), hs), iss), pii)
    text = F.concat(
        F.lit("=== DATASET ===\nFile: "), F.col("file"),
        F.lit("\nShape: ("), F.col("n_rows").cast("string"), F.lit(", "), F.size("cols").cast("string"), F.lit(")"),
        F.lit("\nColumns: "), py_list(F.col("cols")), F.lit("\nNumeric: "), py_list(F.col("num")),
        F.lit("\nCategorical: "), py_list(F.col("cat")), F.lit("\nHealth: "), F.col("health_score").cast("string"),
        F.lit("/100\nIssues: "), py_list(F.col("issues")), F.lit("\nPII: "), py_list(F.col("pii")), F.lit("\n"))
    return row.select(text.alias("context"))
