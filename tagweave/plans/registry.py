"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracle SQL.

Every query reads the given test tables (or data Spark derives from them)
over whole tables and whole texts. Float outputs are rounded to 6 places on
both sides so that summation order does not matter.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.operators import features as FE
from tagweave.operators.keywords import keyword_tags
from tagweave.operators.vectors import Bags
from tagweave.plans import sql as S
from tagweave.session import checkpoint_dir, cut_lineage
from tagweave.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def _docs(spark, sf_dir):
    return FE.prepare_documents(TB.read_table(spark, sf_dir, "documents"))


# --- 1. cleaning and term statistics -------------------------------------

@register("preprocess", f"SELECT doc_id, array_to_string({S.clean_tokens('text')}, ' ') AS clean FROM documents")
def q_preprocess(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("clean"))


@register("term_freq", S.with_docs("SELECT doc_id, term, tf FROM tf"))
def q_term_freq(spark, sf_dir):
    return FE.term_frequencies(_docs(spark, sf_dir)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@register("doc_freq", S.with_docs("SELECT term, count(*) AS df FROM tf GROUP BY term"))
def q_doc_freq(spark, sf_dir):
    return FE.document_frequency(FE.term_frequencies(_docs(spark, sf_dir)))


@register("tfidf")
def q_tfidf(spark, sf_dir):
    w = FE.tfidf(_docs(spark, sf_dir))
    return w.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), r6(F.col("weight")).alias("weight"))


ORACLES["tfidf"] = (f"WITH docs AS ({S.docs_cte()}),{S.TOKENS_TF}{S.tfidf_ctes()}\n"
                    "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w")


@register("tfidf_df_filtered")
def q_tfidf_df_filtered(spark, sf_dir):
    w = FE.tfidf(_docs(spark, sf_dir), max_df=0.95, min_df=2)
    return w.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), r6(F.col("weight")).alias("weight"))


ORACLES["tfidf_df_filtered"] = (f"WITH docs AS ({S.docs_cte()}),{S.TOKENS_TF}{S.tfidf_ctes(0.95, 2)}\n"
                                "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w")


@register("ngram_counts")
def q_ngram_counts(spark, sf_dir):
    return FE.ngram_counts(_docs(spark, sf_dir), 1, 2).select(
        "doc_id", "term", F.col("tf").cast("long").alias("tf"))


ORACLES["ngram_counts"] = f"""WITH docs AS ({S.docs_cte()}),
grams AS (SELECT doc_id, unnest(tokens) AS term FROM docs
          UNION ALL
          SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS term
          FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM docs))
SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term"""


@register("tfidf_ngram_features")
def q_tfidf_ngram_features(spark, sf_dir):
    w = FE.tfidf(_docs(spark, sf_dir), max_features=2000, ngram_range=(1, 2))
    return w.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), r6(F.col("weight")).alias("weight"))


ORACLES["tfidf_ngram_features"] = f"""WITH docs AS ({S.docs_cte()}),
grams AS (SELECT doc_id, unnest(tokens) AS term FROM docs
          UNION ALL
          SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS term
          FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM docs)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term){S.tfidf_ctes(max_features=2000)}
SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w"""


@register("apply_idf_conversations")
def q_apply_idf(spark, sf_dir):
    _, idf = FE.tfidf(_docs(spark, sf_dir), return_idf=True)
    conv = FE.prepare_documents(TB.conversation_documents(spark, sf_dir))
    w = FE.apply_idf(conv, idf)
    return w.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), r6(F.col("weight")).alias("weight"))


ORACLES["apply_idf_conversations"] = f"""WITH docs AS ({S.docs_cte()}),{S.TOKENS_TF}{S.tfidf_ctes()},
conv AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text
         FROM conversations GROUP BY conv_id),
cdocs AS ({S.docs_cte('conv')}),
ctf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM cdocs)
        GROUP BY doc_id, term),
craw AS (SELECT c.doc_id, c.term, c.tf, c.tf * i.idf AS weight FROM ctf c JOIN idf i USING (term))
SELECT doc_id, term, tf, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight
FROM craw"""


@register("top_tfidf_terms")
def q_top_tfidf_terms(spark, sf_dir):
    w = FE.top_terms(FE.tfidf(_docs(spark, sf_dir), max_df=0.95, min_df=2), 10)
    return w.select("doc_id", F.col("rank").cast("long").alias("rank"), "term", r6(F.col("weight")).alias("weight"))


ORACLES["top_tfidf_terms"] = (f"WITH docs AS ({S.docs_cte()}),{S.TOKENS_TF}{S.tfidf_ctes(0.95, 2)}\n"
                              "SELECT doc_id, rank, term, round(weight, 6) AS weight FROM "
                              "(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank"
                              " FROM w) WHERE rank <= 10")


@register("single_doc_tfidf", S.with_docs(
    "SELECT doc_id, term, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS score FROM tf"))
def q_single_doc_tfidf(spark, sf_dir):
    return FE.single_doc_tfidf(_docs(spark, sf_dir)).select(
        "doc_id", "term", F.col("tf").cast("long").alias("tf"), r6(F.col("score")).alias("score"))


@register("one_topic_lda", S.with_docs(
    "SELECT doc_id, rank, term, round(prob, 6) AS prob FROM ("
    " SELECT doc_id, term, (tf + 1.0) / (sum(tf) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id))"
    " AS prob, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM tf) WHERE rank <= 10"))
def q_one_topic_lda(spark, sf_dir):
    return FE.one_topic_lda(_docs(spark, sf_dir)).select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "term", r6(F.col("prob")).alias("prob"))


# --- 2. keyword tags -------------------------------------------------------

@register("keyword_tags", f"WITH {S.keyword_tags_sql(S.docs_cte())}\n"
                          "SELECT doc_id, rank, tag, round(score, 6) AS score FROM kw")
def q_keyword_tags(spark, sf_dir):
    tags = keyword_tags(_docs(spark, sf_dir), threshold=0.2)
    return tags.select("doc_id", F.col("rank").cast("long").alias("rank"), "tag", r6(F.col("score")).alias("score"))


# --- 3. pages --------------------------------------------------------------

from tagweave.sources import pages as PG  # noqa: E402
from tagweave.functions.text import escape_html  # noqa: E402

ABSENT_URLS = ("https://absent.example.org/a", "https://absent.example.org/b")


def _links(spark, sf_dir):
    pages = TB.read_table(spark, sf_dir, "pages")
    extra = spark.createDataFrame([(u,) for u in ABSENT_URLS], "url string")
    return pages.select("url").unionByName(extra).unionByName(pages.select("url"))


def _sql_unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"),
                    ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


_SQL_TITLE = ("CASE WHEN regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) <> '' THEN "
              + _sql_unescape("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)") + " END")
_SQL_STRIPPED = ("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
                 "'(?is)(<script\\b[^>]*>).*?</script\\s*>', '\\1', 'g'), "
                 "'(?is)(<style\\b[^>]*>).*?</style\\s*>', '\\1', 'g')")


@register("link_info", f"""WITH links AS (SELECT url FROM pages UNION SELECT unnest({S.str_list(ABSENT_URLS)})),
info AS (SELECT url, {_SQL_TITLE} AS title,
                array_to_string(list_transform(regexp_extract_all({_SQL_STRIPPED}, '<([a-zA-Z][^\\t\\n\\r\\f />]*)', 1),
                                               lambda t: lower(t)), ' ') AS tags FROM pages)
SELECT l.url, i.title, i.tags FROM links l LEFT JOIN info i USING (url)""")
def q_link_info(spark, sf_dir):
    info = PG.link_info(_links(spark, sf_dir), TB.read_table(spark, sf_dir, "pages"))
    return info.select("url", "title", F.array_join("tags", " ").alias("tags"))


@register("internal_url_filter", "SELECT page_id, url FROM pages WHERE "
          + " AND ".join(f"NOT starts_with(url, {S.q(p)})" for p in PG.INTERNAL_URL_PREFIXES))
def q_internal_url_filter(spark, sf_dir):
    return PG.drop_internal_urls(TB.read_table(spark, sf_dir, "pages")).select("page_id", "url")


@register("escaped_titles", "SELECT page_id, replace(replace(replace(replace(replace(" + _SQL_TITLE +
          ", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS title_html FROM pages")
def q_escaped_titles(spark, sf_dir):
    pages = TB.read_table(spark, sf_dir, "pages")
    return PG.page_outline(pages, "page_id").select("page_id", escape_html(F.col("title")).alias("title_html"))


@register("page_fields")
def q_page_fields(spark, sf_dir):
    f = PG.extract_page_fields(TB.read_table(spark, sf_dir, "pages"))
    return f.select("page_id", "url", "title", "texts", F.size("headers").alias("n_headers"),
                    F.array_join("headers", ". ").alias("headers"), F.size("styled_texts").alias("n_styled"),
                    F.array_join("styled_texts", ". ").alias("styled_texts"))


# the stored pages: text outside tags, comments, scripts and styles, references decoded
def _sql_text(html: str) -> str:
    return _sql_unescape_all(f"regexp_replace({html}, '(?s)<[^>]*>', '', 'g')")


def _sql_unescape_all(x: str) -> str:
    for ent, ch in (("&copy;", "\u00a9"), ("&middot;", "\u00b7")):
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return _sql_unescape(x)


_SQL_HEADS = ("list_transform(regexp_extract_all(html, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1), lambda x: trim("
              + _sql_unescape_all("x") + "))")
_SQL_STYLED = ("list_transform(regexp_extract_all(html, '(?s)<b>(.*?)(?:</b>|<br>|<p>|</p>)', 1), lambda x: trim("
               + _sql_unescape_all("x") + "))")


@register("page_headings", f"SELECT page_id, {_SQL_TITLE} AS title, len({_SQL_HEADS}) AS n_headers, "
          f"array_to_string({_SQL_HEADS}, '. ') AS headers, len({_SQL_STYLED}) AS n_styled, "
          f"array_to_string({_SQL_STYLED}, '. ') AS styled_texts FROM pages")
def q_page_headings(spark, sf_dir):
    """S2 without the body text; X13: texts joined by '. '."""
    f = PG.extract_page_fields(TB.read_table(spark, sf_dir, "pages"))
    return f.select("page_id", "title", F.size("headers").cast("long").alias("n_headers"),
                    F.array_join("headers", ". ").alias("headers"), F.size("styled_texts").cast("long").alias("n_styled"),
                    F.array_join("styled_texts", ". ").alias("styled_texts"))


@register("page_plain_text", f"SELECT page_id, {_sql_text(_SQL_STRIPPED)} AS text FROM pages")
def q_page_plain_text(spark, sf_dir):
    return PG.html_to_text(TB.read_table(spark, sf_dir, "pages"))


# body text: tags become blanks, which tokens do not notice
_SQL_BODY = ("regexp_replace(regexp_extract(" + _SQL_STRIPPED + ", '(?s)<body[^>]*>(.*)', 1), '(?s)<[^>]*>', ' ', 'g')")
_SQL_PAGE_DOCS = S.docs_cte(f"(SELECT page_id, url, html, {_sql_unescape_all(_SQL_BODY)} AS text, "
                            f"array_to_string({_SQL_HEADS}, '. ') AS h, array_to_string({_SQL_STYLED}, '. ') AS s FROM pages "
                            "WHERE " + " AND ".join(f"NOT starts_with(url, {S.q(p)})" for p in PG.INTERNAL_URL_PREFIXES) + ")",
                            "page_id").replace(" FROM (SELECT", ", h, s FROM (SELECT", 1)


@register("page_keyword_tags", f"WITH {S.keyword_tags_sql(_SQL_PAGE_DOCS, headers='h', styled='s')}\n"
          "SELECT doc_id AS page_id, rank, tag, round(score, 6) AS score FROM kw")
def q_page_keyword_tags(spark, sf_dir):
    from tagweave.plans.tag_pages import tag_pages
    tags, _ = tag_pages(TB.read_table(spark, sf_dir, "pages"))
    return tags.select("page_id", F.col("rank").cast("long").alias("rank"), "tag", r6(F.col("score")).alias("score"))


# --- 4. rules, groups, selections -------------------------------------------

from tagweave.operators import rules as RU  # noqa: E402
from tagweave.streaming import tag_edits as TE  # noqa: E402

# Test rules (fixture rows): overlaps, a rule without conditions, an unknown
# source, a type other than Contains, an empty value, and a tag condition.
TEST_RULES = [
    (1, "English", [(3, 1, " the ")]),
    (2, "Eau", [(3, 1, "EAU")]),
    (3, "IngNoEau", [(3, 1, "ing"), (3, 2, "eau")]),
    (4, "Src1x", [(2, 1, "src1")]),
    (5, "All", []),
    (6, "Unknown", [(9, 1, "x")]),
    (7, "Type7", [(2, 7, "src2")]),
    (8, "Empty", [(2, 1, "")]),
    (9, "TagOeau", [(1, 1, "OEAU")]),
]


def _rule_docs(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    tags = keyword_tags(FE.prepare_documents(docs), 0.2)
    tag_arr = tags.groupBy("doc_id").agg(F.collect_list("tag").alias("tags"))
    return (docs.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
                .join(tag_arr, "doc_id", "left"))


def _sql_rule_cond(src, typ, val):
    v = S.q(val.lower())
    if src == 1:
        hit = f"coalesce(list_contains(t.tags, {v}), false)"
    elif src == 2:
        hit = f"contains(lower(coalesce(d.source, '')), {v})"
    elif src == 3:
        hit = f"contains(lower(coalesce(d.text, '')), {v})"
    else:
        return "false"
    return hit if typ == 1 else f"NOT {hit}"


def _sql_rule_matches() -> str:
    parts = []
    for o, n, conds in TEST_RULES:
        cond = " AND ".join(_sql_rule_cond(*c) for c in conds) or "true"
        parts.append(f"SELECT d.doc_id, CAST({o} AS BIGINT) AS ord, {S.q(n)} AS name FROM documents d "
                     f"LEFT JOIN tagarr t USING (doc_id) WHERE {cond}")
    return " UNION ALL ".join(parts)


_SQL_RULE_BASE = (f"WITH {S.keyword_tags_sql(S.docs_cte())},\n"
                  "tagarr AS (SELECT doc_id, list(tag) AS tags FROM kw GROUP BY doc_id),\n"
                  f"m AS ({_sql_rule_matches()})\n")


@register("rule_matches", _SQL_RULE_BASE + "SELECT doc_id, ord, name FROM m")
def q_rule_matches(spark, sf_dir):
    return RU.match_rules(_rule_docs(spark, sf_dir), TEST_RULES).select(
        "doc_id", F.col("ord").cast("long").alias("ord"), "name")


@register("rule_groups", _SQL_RULE_BASE +
          "SELECT doc_id, string_agg(name, '+' ORDER BY ord) AS group_title FROM m GROUP BY doc_id")
def q_rule_groups(spark, sf_dir):
    return RU.rule_groups(_rule_docs(spark, sf_dir), TEST_RULES)


@register("applied_groups", _SQL_RULE_BASE +
          "SELECT doc_id, arg_max(name, ord) AS group_title FROM m GROUP BY doc_id")
def q_applied_groups(spark, sf_dir):
    m = RU.match_rules(_rule_docs(spark, sf_dir), TEST_RULES)
    return RU.apply_groups(m.select("ord", F.col("name").alias("group_title"), "doc_id"))


_RULE_WORDS = "[\\x20\\x09-\\x0D]+"


def _rule_table(spark, sf_dir):
    """``TEST_RULES`` and rules read off ``benchmark``: two neighbouring words in the content, some of them without the
    third or with a title, and single words among the tags; stored and loaded like a user's rules (S6)."""
    words = TB.read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.filter(F.split(F.coalesce("text", F.lit("")), _RULE_WORDS), lambda w: w != "").alias("ws"))
    at = words.select("item_id", "ws", F.posexplode("ws").alias("i", "a")).withColumns(
        {"b": F.get("ws", F.col("i") + 1), "c": F.get("ws", F.col("i") + 2)}).where(F.col("c").isNotNull())

    def cond(source, kind, value):
        return F.struct(F.lit(source).alias("source"), F.lit(kind).alias("type"), value.alias("value"))

    pair, kind = F.concat_ws(" ", "a", "b"), F.col("i") % 4
    conditions = (F.when(kind == 0, F.array(cond(3, 1, pair)))
                   .when(kind == 1, F.array(cond(3, 1, pair), cond(3, 2, F.col("c"))))
                   .when(kind == 2, F.array(cond(3, 1, pair), cond(2, 1, F.lit("SRC1"))))
                   .otherwise(F.array(cond(1, 1, F.col("a")))))
    mined = at.select((F.col("item_id") * 10000 + F.col("i") + 100).cast("int").alias("ord"), pair.alias("name"),
                      conditions.cast(schemas.RULES["conditions"].dataType).alias("conditions"))
    path = f"{checkpoint_dir(spark)}/rules-{uuid.uuid4().hex[:12]}"
    RU.save_rules(mined.unionByName(spark.createDataFrame(TEST_RULES, schemas.RULES)), path)
    return RU.read_rules(spark, path)


_SQL_RULE_TABLE = f"""WITH {S.keyword_tags_sql(S.docs_cte())},
tagarr AS (SELECT doc_id, list(tag) AS tags FROM kw GROUP BY doc_id),
d AS (SELECT doc_id, lower(coalesce(source, '')) AS title, lower(coalesce(text, '')) AS content,
             coalesce(tags, []) AS tags FROM documents LEFT JOIN tagarr USING (doc_id)),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
       FROM benchmark),
mined AS (SELECT item_id * 10000 + i + 99 AS ord, ws[i] AS a, ws[i + 1] AS b, lower(ws[i + 2]) AS c, (i - 1) % 4 AS kind
          FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM bw)),
m AS ({_sql_rule_matches()}),
n AS (SELECT *, a || ' ' || b AS name, lower(a || ' ' || b) AS pair FROM mined)
SELECT doc_id, ord, name FROM m
UNION ALL SELECT doc_id, ord, name FROM n JOIN d ON kind < 3 AND contains(content, pair)
  AND (kind <> 1 OR NOT contains(content, c)) AND (kind <> 2 OR contains(title, 'src1'))
UNION ALL SELECT doc_id, ord, name FROM n JOIN (SELECT doc_id, unnest(tags) AS tag FROM d) t ON kind = 3 AND t.tag = lower(a)"""


@register("rule_table_matches", _SQL_RULE_TABLE)
def q_rule_table_matches(spark, sf_dir):
    """S6 + J2 with a stored rule table of any length."""
    docs = cut_lineage(_rule_docs(spark, sf_dir))
    return RU.match_rules(docs, _rule_table(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "name")


@register("rule_table_groups", _SQL_RULE_TABLE.replace("SELECT doc_id, ord, name FROM m\nUNION ALL", "SELECT * FROM (SELECT doc_id, ord, name FROM m\nUNION ALL", 1)
          .replace("WITH ", "WITH all_ AS (WITH ", 1) + """))
SELECT group_title, count(*) AS n_docs, min(doc_id) AS first_doc
FROM (SELECT doc_id, string_agg(name, '+' ORDER BY ord, name) AS group_title FROM all_ GROUP BY doc_id) GROUP BY group_title""")
def q_rule_table_groups(spark, sf_dir):
    """C9 + C5 with a stored rule table: the groups, their sizes and first documents."""
    docs = cut_lineage(_rule_docs(spark, sf_dir))
    groups = RU.rule_groups(docs, _rule_table(spark, sf_dir))
    return groups.groupBy("group_title").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _doc_groups(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    labels = TB.read_table(spark, sf_dir, "labels")
    labeled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")
    gid = labeled.groupBy("source").agg(F.min("doc_id").alias("group_id"))
    return labeled.join(gid, "source").select("doc_id", "group_id", F.col("source").alias("group_title"))


_SQL_DOC_GROUPS = """WITH labeled AS (SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)),
gid AS (SELECT source, min(doc_id) AS group_id FROM labeled GROUP BY source),
dg AS (SELECT l.doc_id, g.group_id, l.source AS group_title FROM labeled l JOIN gid g USING (source)),
rows AS (SELECT d.doc_id, d.lang, coalesce(dg.group_id, -1) AS group_id, coalesce(dg.group_title, 'No group') AS group_title
         FROM documents d LEFT JOIN dg USING (doc_id))
"""


@register("tab_rows", _SQL_DOC_GROUPS + "SELECT doc_id, group_id, group_title FROM rows")
def q_tab_rows(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id")
    return RU.rows_with_group(docs, _doc_groups(spark, sf_dir)).select("doc_id", "group_id", "group_title")


@register("group_breaks", _SQL_DOC_GROUPS + "SELECT doc_id, lang, group_id, "
          "(lag(group_id) OVER (PARTITION BY lang ORDER BY doc_id)) IS DISTINCT FROM group_id AS is_break FROM rows")
def q_group_breaks(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = RU.rows_with_group(docs, _doc_groups(spark, sf_dir))
    return RU.group_breaks(rows, "lang", "doc_id", bucket_width=64).select("doc_id", "lang", "group_id", "is_break")


@register("selected_docs", "SELECT doc_id, source FROM documents WHERE doc_id IN "
          "(SELECT doc_id FROM labels WHERE quality = 1)")
def q_selected_docs(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "source")
    sel = TB.read_table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return RU.select_rows(docs, sel)


_SQL_EVENTS = """ev AS (SELECT user_id AS doc_id, event_id AS seq,
            CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'remove'
                            WHEN 'signup' THEN 'set' END AS op,
            't' || CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS BIGINT) AS tag
     FROM events WHERE event_type IN ('click', 'purchase', 'error', 'signup')),
evn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM ev),
fold(doc_id, i, tags) AS (
  SELECT DISTINCT doc_id, 0, CAST([] AS VARCHAR[]) FROM evn
  UNION ALL
  SELECT f.doc_id, e.i,
         CASE e.op WHEN 'add' THEN list_append(f.tags, e.tag)
                   WHEN 'set' THEN [e.tag]
                   ELSE CASE WHEN NOT list_contains(f.tags, e.tag) THEN f.tags
                             ELSE list_concat(list_slice(f.tags, 1, list_position(f.tags, e.tag) - 1),
                                              list_slice(f.tags, list_position(f.tags, e.tag) + 1, len(f.tags))) END
         END
  FROM fold f JOIN evn e ON e.doc_id = f.doc_id AND e.i = f.i + 1),
final AS (SELECT f.doc_id, f.tags FROM fold f
          JOIN (SELECT doc_id, max(i) AS i FROM evn GROUP BY doc_id) m ON m.doc_id = f.doc_id AND m.i = f.i),
tagrows AS (SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM final)
"""


@register("tag_fold", "WITH RECURSIVE " + _SQL_EVENTS + "SELECT doc_id, pos, tag FROM tagrows")
def q_tag_fold(spark, sf_dir):
    ev = TE.events_to_tag_events(TB.read_table(spark, sf_dir, "events"))
    # small seq buckets so that the cross-bucket carries are exercised at test scale
    return TE.fold_tag_events(ev, bucket_width=4096).select("doc_id", F.col("pos").cast("long").alias("pos"), "tag")


@register("untagged_docs", "WITH RECURSIVE " + _SQL_EVENTS +
          "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tagrows)")
def q_untagged_docs(spark, sf_dir):
    ev = TE.events_to_tag_events(TB.read_table(spark, sf_dir, "events"))
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id")
    return RU.untagged(docs, TE.fold_tag_events(ev))


# --- 5. clustering, similarity ------------------------------------------------

from tagweave.operators import clustering as CL  # noqa: E402
from tagweave.operators import similarity as SIM  # noqa: E402

MIN_COS = 0.875

_SQL_W = f"WITH docs AS ({S.docs_cte()}),{S.TOKENS_TF}{S.tfidf_ctes()},\n"
_SQL_LANG = ("labels_l AS (SELECT d.doc_id, g.cluster FROM documents d JOIN "
             "(SELECT lang, min(doc_id) AS cluster FROM documents GROUP BY lang) g USING (lang)),\n")


def _weights(spark, sf_dir):
    """Tokens and TF-IDF weights, persisted: the clustering queries read both several times."""
    from tagweave.session import reuse
    docs = reuse(_docs(spark, sf_dir))
    return docs, reuse(FE.tfidf(docs))


def _bags(spark, sf_dir):
    """The documents as stored bags of words, for operators that compare them."""
    return Bags(_docs(spark, sf_dir))


def _lang_labels(spark, sf_dir):
    d = TB.read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("raw"))
    return CL.canonical_labels(d, "raw")


@register("cluster_keywords_by_lang", _SQL_W + _SQL_LANG + """s AS (SELECT l.cluster, w.term, sum(w.weight) AS score
      FROM w JOIN labels_l l USING (doc_id) GROUP BY l.cluster, w.term)
SELECT cluster, term, round(score, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rk FROM s) WHERE rk = 1""")
def q_cluster_keywords_by_lang(spark, sf_dir):
    _, w = _weights(spark, sf_dir)
    kw = CL.cluster_keywords(_lang_labels(spark, sf_dir), w, 1)
    return kw.select("cluster", "term", r6(F.col("score")).alias("score"))


@register("cluster_members_by_lang", "WITH " + _SQL_LANG[:-2] +
          "\nSELECT cluster, min(doc_id) AS first_doc, count(*) AS n_docs FROM labels_l GROUP BY cluster")
def q_cluster_members_by_lang(spark, sf_dir):
    return CL.cluster_members(_lang_labels(spark, sf_dir))


@register("cluster_top_keywords_by_lang", _SQL_W + _SQL_LANG + """s AS (SELECT l.cluster, w.term, sum(w.weight) AS score
      FROM w JOIN labels_l l USING (doc_id) GROUP BY l.cluster, w.term)
SELECT cluster, rank, term, round(score, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""")
def q_cluster_top_keywords_by_lang(spark, sf_dir):
    """C6 with five keywords."""
    _, w = _weights(spark, sf_dir)
    kw = CL.cluster_keywords(_lang_labels(spark, sf_dir), w, 5)
    return kw.select("cluster", F.col("rank").cast("long").alias("rank"), "term", r6(F.col("score")).alias("score"))


KMEANS = dict(k=3, seed=42, max_iter=25)


def _sql_kmeans() -> str:
    """CTEs up to klab(doc_id, cluster) over docs and w: seeding and every round, written out."""
    k, seed = KMEANS["k"], KMEANS["seed"]
    u = lambda i: f"(('0x' || substr(md5(doc_id || '|{seed}|{i}'), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    out = ["pt AS MATERIALIZED (SELECT d.doc_id, coalesce(n2, 0.0) AS n2 FROM docs d LEFT JOIN "
           "(SELECT doc_id, sum(weight * weight) AS n2 FROM w GROUP BY doc_id) USING (doc_id))",
           "gap0 AS MATERIALIZED (SELECT doc_id, n2, 1.0::DOUBLE AS d2 FROM pt)"]
    for i in range(k):
        out.append(f"ch{i} AS MATERIALIZED (SELECT doc_id, n2 FROM gap{i} WHERE d2 > 0 ORDER BY round(-ln({u(i)}) / d2, 9), doc_id LIMIT 1)")
        out.append(f"gd{i} AS MATERIALIZED (SELECT a.doc_id, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (term) JOIN ch{i} c ON c.doc_id = b.doc_id GROUP BY a.doc_id)")
        d2 = (f"CASE WHEN g.doc_id = c.doc_id THEN 0.0 ELSE round(greatest(0.0, g.n2 - 2.0 * coalesce(d.dot, 0.0) + c.n2), 9) END")
        out.append(f"gap{i + 1} AS MATERIALIZED (SELECT g.doc_id, g.n2, " + (f"least(g.d2, {d2})" if i else d2)
                   + f" AS d2 FROM gap{i} g LEFT JOIN gd{i} d ON d.doc_id = g.doc_id, ch{i} c)")
    out.append("cen0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS c, term, weight AS x FROM w JOIN ch{i} USING (doc_id)" for i in range(k)) + ")")
    for r in range(KMEANS["max_iter"] + 1):
        out.append(f"nrm{r} AS MATERIALIZED (SELECT c, sum(x * x) AS n FROM cen{r} GROUP BY c)")
        out.append(f"dot{r} AS MATERIALIZED (SELECT doc_id, c, sum(weight * x) AS dot FROM w JOIN cen{r} USING (term) GROUP BY doc_id, c)")
        out.append(f"lab{r} AS MATERIALIZED (SELECT doc_id, c FROM (SELECT p.doc_id, i.c, row_number() OVER (PARTITION BY p.doc_id "
                   f"ORDER BY round(greatest(0.0, p.n2 - 2.0 * coalesce(d.dot, 0.0) + coalesce(n.n, 0.0)), 9), i.c) AS rk "
                   f"FROM pt p CROSS JOIN (SELECT unnest(range(0, {k})) AS c) i LEFT JOIN nrm{r} n ON n.c = i.c "
                   f"LEFT JOIN dot{r} d ON d.doc_id = p.doc_id AND d.c = i.c) WHERE rk = 1)")
        if r < KMEANS["max_iter"]:
            out.append(f"cen{r + 1} AS MATERIALIZED (SELECT l.c, w.term, sum(w.weight) / any_value(s.n) AS x FROM w JOIN lab{r} l USING (doc_id) "
                       f"JOIN (SELECT c, count(*) AS n FROM lab{r} GROUP BY c) s ON s.c = l.c GROUP BY l.c, w.term "
                       f"UNION ALL SELECT c, term, x FROM cen{r} WHERE c NOT IN (SELECT c FROM lab{r}))")
    out.append(f"klab AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS cluster FROM lab{KMEANS['max_iter']})")
    return ",\n".join(out)


def _sql_kmeans_groups(base: str, n_keywords: int) -> str:
    return base.rstrip().rstrip(",") + ",\n" + _sql_kmeans() + f""",
s AS (SELECT l.cluster, w.term, sum(w.weight) AS score FROM w JOIN klab l USING (doc_id) GROUP BY l.cluster, w.term),
kw AS (SELECT cluster, string_agg(term, ',' ORDER BY rk) AS title FROM
       (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rk FROM s) WHERE rk <= {n_keywords} GROUP BY cluster)
SELECT d.doc_id, d.cluster, coalesce(k.title, '') AS group_title FROM klab d LEFT JOIN kw k USING (cluster)"""


@register("kmeans_groups", _sql_kmeans_groups(_SQL_W, 1))
def q_kmeans_groups(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    w = FE.tfidf_blocks(docs)
    labels = CL.kmeans(w, docs.select("doc_id"), **KMEANS)
    return CL.cluster_groups(labels, w)


_SQL_REPS = """bags AS (SELECT doc_id, array_to_string(list_sort(tokens), ' ') AS bag FROM docs),
mult AS (SELECT min(doc_id) AS rep, count(*) AS m FROM bags GROUP BY bag),
grp AS (SELECT b.doc_id, m.rep FROM bags b JOIN (SELECT bag, min(doc_id) AS rep FROM bags GROUP BY bag) m USING (bag)),
rw AS (SELECT * FROM w WHERE doc_id IN (SELECT rep FROM mult)),
pairs AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS cos
          FROM rw a JOIN rw b ON a.term = b.term AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING sum(a.weight * b.weight) >= """ + repr(MIN_COS - 1e-12) + ")\n"


@register("copy_groups", f"WITH docs AS ({S.docs_cte()}),\n" + _SQL_REPS.split("rw AS")[0].rstrip().rstrip(",") +
          "\nSELECT g.doc_id, g.rep AS rep_id, m.m AS n_copies FROM grp g JOIN mult m USING (rep)")
def q_copy_groups(spark, sf_dir):
    return SIM.copy_groups(_docs(spark, sf_dir))


@register("similar_pairs", _SQL_W + _SQL_REPS + "SELECT doc_a, doc_b, round(cos, 6) AS cos FROM pairs")
def q_similar_pairs(spark, sf_dir):
    w = _bags(spark, sf_dir)
    reps = SIM.copy_groups(w).select(F.col("rep_id").alias("doc_id")).distinct()
    pairs = SIM.similar_pairs(w.only(reps), MIN_COS)
    return pairs.select("doc_a", "doc_b", r6(F.col("cos")).alias("cos"))


_SQL_DBSCAN = ("WITH RECURSIVE" + (_SQL_W + _SQL_REPS)[4:] + """, both_ AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
deg AS (SELECT r.rep, r.m + coalesce((SELECT sum(m2.m) FROM both_ JOIN mult m2 ON m2.rep = both_.b
                                      WHERE both_.a = r.rep), 0) AS deg FROM mult r),
core AS (SELECT rep FROM deg WHERE deg >= 5),
cedge AS (SELECT a, b FROM both_ WHERE a IN (SELECT rep FROM core) AND b IN (SELECT rep FROM core)),
reach(node, c) AS (SELECT rep, rep FROM core UNION SELECT e.b, r.c FROM reach r JOIN cedge e ON e.a = r.node),
comp AS (SELECT node, min(c) AS cluster FROM reach GROUP BY node),
border AS (SELECT b2.a AS node, min(cp.cluster) AS cluster FROM both_ b2 JOIN comp cp ON cp.node = b2.b
           WHERE b2.a NOT IN (SELECT rep FROM core) GROUP BY b2.a),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
dlab AS (SELECT g.doc_id, coalesce(l.cluster, -1) AS cluster FROM grp g LEFT JOIN lab l ON l.node = g.rep)
""")


def _dbscan_labels(spark, sf_dir):
    w = _bags(spark, sf_dir)
    return SIM.dbscan(w, w, eps=0.5, min_samples=5)


@register("dbscan", _SQL_DBSCAN + "SELECT doc_id, cluster FROM dlab")
def q_dbscan(spark, sf_dir):
    return _dbscan_labels(spark, sf_dir)


@register("dbscan_counts", _SQL_DBSCAN + "SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, "
          "count(*) FILTER (WHERE cluster = -1) AS n_noise FROM dlab")
def q_dbscan_counts(spark, sf_dir):
    return CL.cluster_counts(_dbscan_labels(spark, sf_dir))


@register("dbscan_keywords", _SQL_DBSCAN + """, s AS (SELECT l.cluster, w.term, sum(w.weight) AS score
      FROM w JOIN dlab l USING (doc_id) GROUP BY l.cluster, w.term)
SELECT cluster, term, round(score, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rk FROM s) WHERE rk = 1""")
def q_dbscan_keywords(spark, sf_dir):
    w = _bags(spark, sf_dir)
    labels = SIM.dbscan(w, w, eps=0.5, min_samples=5)
    return CL.cluster_keywords(labels, w, 1).select("cluster", "term", r6(F.col("score")).alias("score"))


# --- 6. extractor comparison -------------------------------------------------

from tagweave.operators import evaluate as EV  # noqa: E402
from tagweave.operators import graph as GR  # noqa: E402

TR_ROUNDS = 250   # of the oracle; contraction 0.85 a round leaves less than 1e-15
TR_TOL = 1e-15     # of the query: rounds go on until the scores stand still


def _eval_docs(spark, sf_dir):
    return TB.evaluation_corpus(spark, sf_dir)


def _textrank(spark, sf_dir):
    return GR.textrank(_eval_docs(spark, sf_dir), top_n=10, max_iter=1000, tol=TR_TOL, rank_digits=9)


@register("textrank", "WITH RECURSIVE " + S.raw_token_cte() + ",\n" + S.textrank_ctes(TR_ROUNDS) +
          "\nSELECT doc_id, rank, term, round(score, 6) AS score FROM tr")
def q_textrank(spark, sf_dir):
    return _textrank(spark, sf_dir).select("doc_id", F.col("rank").cast("long").alias("rank"), "term",
                                            r6(F.col("score")).alias("score"))


@register("pair_counts")
def q_pair_counts(spark, sf_dir):
    return GR.pair_counts(_docs(spark, sf_dir), k=5).select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "term", "count")


_SQL_EVAL = ("WITH RECURSIVE " + S.eval_docs_cte() + "," + S.TOKENS_TF + S.tfidf_ctes(0.95, 2) + ",\n"
             "top10 AS (SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER "
             "(PARTITION BY doc_id ORDER BY weight DESC, term) AS rk FROM w) WHERE rk <= 10),\n"
             + S.textrank_ctes(TR_ROUNDS) + ",\n"
             "trm_tf AS (SELECT doc_id, lower(term) AS term, count(*) AS tf FROM tr GROUP BY doc_id, lower(term)),\n"
             "trm_raw AS (SELECT t.doc_id, t.term, t.tf * i.idf AS weight FROM trm_tf t JOIN idf i USING (term)),\n"
             "trm AS (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight "
             "FROM trm_raw),\n"
             "ntop AS (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight "
             "FROM top10)\n")


def _eval_bags(spark, sf_dir, ranked=True):
    """The evaluation corpus as stored bags, tokenized once; with ``ranked`` beside the ten TextRank terms of each document."""
    rt = GR.raw_tokens(_eval_docs(spark, sf_dir)).withColumn("tokens", F.transform(
        F.filter(F.arrays_zip("rt", "keep"), lambda z: z["keep"]), lambda z: F.lower(z["rt"])))
    if not ranked:
        return Bags(rt.select("doc_id", "tokens")).within(0.95, 2)
    rank = lambda rows: GR.textrank_rows(rows, top_n=10, max_iter=1000, tol=TR_TOL, rank_digits=9)
    return Bags(GR.word_graph(rt, keep=("tokens",)), keep=("ea", "eb"), extend=rank).within(0.95, 2)


def _matrices(bags, top=True, ranked=True):
    """Number of documents, TF-IDF top-10 and TextRank matrices; a matrix not asked for is None."""
    top10 = cut_lineage(bags.top(10).select("doc_id", "term", "weight")) if top else None
    tr = bags.table.select("doc_id", F.explode("tr").alias("term")) if ranked else None
    return F.lit(bags.n_docs), top10, cut_lineage(EV.keyword_matrix_from_terms(tr, bags.idf())) if ranked else None


def _eval_matrices(spark, sf_dir, top=True, ranked=True):
    bags = _eval_bags(spark, sf_dir, ranked)
    out = _matrices(bags, top, ranked)
    bags.release()
    return out


@register("eval_tfidf_top10", _SQL_EVAL + "SELECT doc_id, term, round(weight, 6) AS weight FROM top10")
def q_eval_tfidf_top10(spark, sf_dir):
    _, top10, _ = _eval_matrices(spark, sf_dir, ranked=False)
    return top10.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@register("textrank_matrix", _SQL_EVAL + "SELECT doc_id, term, round(weight, 6) AS weight FROM trm")
def q_textrank_matrix(spark, sf_dir):
    _, _, trm = _eval_matrices(spark, sf_dir, top=False)
    return trm.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@register("mean_cosine", _SQL_EVAL + """, su AS (SELECT term, sum(weight) AS su FROM ntop GROUP BY term),
sv AS (SELECT term, sum(weight) AS sv FROM trm GROUP BY term)
SELECT round(coalesce(sum(su * sv), 0) / ((SELECT count(*) FROM docs) * (SELECT count(*) FROM docs)), 6) AS mean_cos
FROM su JOIN sv USING (term)""")
def q_mean_cosine(spark, sf_dir):
    n, top10, trm = _eval_matrices(spark, sf_dir)
    return EV.mean_cosine(top10, trm, n, n).select(r6(F.col("mean_cos")).alias("mean_cos"))


@register("extractor_agreement", _SQL_EVAL + """SELECT a.doc_id, round(sum(a.weight * b.weight), 6) AS cos
FROM ntop a JOIN trm b ON a.doc_id = b.doc_id AND a.term = b.term GROUP BY a.doc_id""")
def q_extractor_agreement(spark, sf_dir):
    _, top10, trm = _eval_matrices(spark, sf_dir)
    return EV.agreement(top10, trm).select("doc_id", r6(F.col("cos")).alias("cos"))


@register("extractor_top_cosines", _SQL_EVAL + """, dots AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b,
  sum(a.weight * b.weight) AS cos FROM ntop a JOIN trm b USING (term) GROUP BY a.doc_id, b.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_a ORDER BY round(cos, 9) DESC, doc_b) AS rank
           FROM dots WHERE round(cos, 9) > 0)
SELECT doc_a, doc_b, rank, round(cos, 6) AS cos FROM ranked WHERE rank <= 10""")
def q_extractor_top_cosines(spark, sf_dir):
    """For each document's TF-IDF keywords the ten most similar TextRank rows."""
    from tagweave.operators.topk import top_cosines
    _, top10, trm = _eval_matrices(spark, sf_dir)
    return top_cosines(top10, trm, 10).select("doc_a", "doc_b", "rank", r6(F.col("cos")).alias("cos"))


def _truth(spark, sf_dir):
    """Truth keywords: the cleaned terms of ``benchmark``."""
    bench = FE.prepare_documents(TB.read_table(spark, sf_dir, "benchmark"), id_col="item_id")
    return FE.term_frequencies(bench).select("term").distinct()


def _tfidf_features_pred(spark, sf_dir, n_features=5):
    """A5 per document: the ``n_features`` uni/bigram features with the largest counts (ties: term)."""
    return FE.top_ngrams(_docs(spark, sf_dir), n_features, 1, 2).select(
        "doc_id", F.lit("tfidf").alias("extractor"), "term")


_SQL_TRUTH = (f"truth AS (SELECT term FROM (WITH docs AS ({S.docs_cte('benchmark', 'item_id')}),{S.TOKENS_TF}\n"
              f"SELECT DISTINCT term FROM tf))")


@register("keyword_quality_tfidf", f"""WITH {_SQL_TRUTH},
docs AS ({S.docs_cte()}),
grams AS (SELECT doc_id, unnest(tokens) AS term FROM docs
          UNION ALL
          SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS term
          FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM docs)),
gc AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY doc_id, term),
pred AS (SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, term) AS rk
         FROM gc) WHERE rk <= 5)
SELECT doc_id, 'tfidf' AS extractor, count(*) AS n_pred,
       count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) AS hits,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / count(*), 6) AS precision,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / (SELECT count(*) FROM truth), 6)
         AS recall
FROM pred GROUP BY doc_id""")
def q_keyword_quality_tfidf(spark, sf_dir):
    q = EV.keyword_quality(_tfidf_features_pred(spark, sf_dir), _truth(spark, sf_dir))
    return q.select("doc_id", "extractor", "n_pred", "hits", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"))


@register("keyword_quality")
def q_keyword_quality(spark, sf_dir):
    pc = GR.pair_counts(_docs(spark, sf_dir), k=5).select("doc_id", F.lit("combinations").alias("extractor"), "term")
    lda = FE.one_topic_lda(_docs(spark, sf_dir)).select("doc_id", F.lit("lda").alias("extractor"), "term")
    pred = _tfidf_features_pred(spark, sf_dir).unionByName(pc).unionByName(lda)
    q = EV.keyword_quality(pred, _truth(spark, sf_dir))
    return q.select("doc_id", "extractor", "n_pred", "hits", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"))


# --- 7. entities, lemmas -----------------------------------------------------

from tagweave.operators import entities as EN  # noqa: E402
from tagweave.operators.lemma import Lemmatizer, NOUN_RULES, corpus_lexicon  # noqa: E402

LEMMA_EXCEPTIONS = [("men", "man"), ("women", "woman"), ("children", "child"), ("mice", "mouse"),
                    ("geese", "goose"), ("feet", "foot"), ("teeth", "tooth"), ("people", "person")]


def _entity_tags(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    gaz = EN.default_gazetteer(spark, sf_dir)
    return EN.entity_tags(EN.entity_spans(EN.entity_words(docs), gaz))


def _corpus_gazetteer(spark, sf_dir):
    """Capitalised words (ORG) and the two-word names that start with one (PERSON) of ``benchmark``."""
    words = EN.entity_words(TB.read_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    cap = lambda w: w != F.lower(w)
    one = words.select(F.explode(F.filter("words", cap)).alias("surface"), F.lit("ORG").alias("label"))
    pairs = F.filter(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b")),
                     lambda z: cap(z["a"]) & z["b"].isNotNull())
    two = words.select(F.explode(pairs).alias("z")).select(F.concat_ws(" ", "z.a", "z.b").alias("surface"),
                                                           F.lit("PERSON").alias("label"))
    return one.unionByName(two).distinct()


_SQL_CORPUS_GAZ = ("bw AS (SELECT list_filter(regexp_extract_all(coalesce(text, ''), " + S.q(S.RAW_TOKEN) + "), "
                   "lambda t: regexp_full_match(t, '[\\pL\\pN_]+') AND NOT list_contains(" + S.STOP_LIST
                   + ", lower(t))) AS words FROM benchmark),\n"
                   "bp AS (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM bw),\n"
                   "gaz AS (SELECT DISTINCT words[i] AS entity, 'ORG' AS label FROM bp WHERE words[i] <> lower(words[i])\n"
                   "  UNION SELECT DISTINCT words[i] || ' ' || words[i + 1], 'PERSON' FROM bp "
                   "WHERE words[i] <> lower(words[i]) AND i < len(words)),\n")


def _sql_entities() -> str:
    gaz_rows = list(EN.LICENSE_ENTITIES) + [(m, "DATE") for m in EN.MONTHS]
    gaz_vals = ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in gaz_rows)
    g = max(len(a.split(" ")) for a, _ in gaz_rows)
    grams = " UNION ALL ".join(
        f"SELECT doc_id, i AS start, {n} AS n, array_to_string(words[i + 1:i + {n}], ' ') AS entity "
        f"FROM (SELECT doc_id, words, unnest(range(0, len(words) - {n} + 1)) AS i FROM ew)" for n in range(1, g + 1))
    return f"""WITH ew AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), {S.q(S.RAW_TOKEN)}),
                 lambda t: regexp_full_match(t, '[\\pL\\pN_]+') AND NOT list_contains({S.STOP_LIST}, lower(t))) AS words
            FROM documents),
gaz AS (SELECT DISTINCT surface AS entity, label FROM (SELECT * FROM (VALUES {gaz_vals}) v(surface, label)
        UNION ALL SELECT n_name, 'GPE' FROM nation UNION ALL SELECT r_name, 'LOC' FROM region)),
grams AS ({grams}),
named AS (SELECT g.doc_id, g.start, g.n, g.entity, z.label FROM grams g JOIN gaz z USING (entity)),
uni AS (SELECT doc_id, i - 1 AS start, 1 AS n, words[i] AS entity FROM
        (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM ew)),
pat AS (SELECT doc_id, start, n, entity,
               CASE WHEN regexp_matches(entity, '{EN.YEAR_PATTERN}') THEN 'DATE'
                    WHEN regexp_matches(entity, '{EN.ORDINAL_PATTERN}') THEN 'ORDINAL'
                    WHEN regexp_matches(entity, '{EN.CARDINAL_PATTERN}') THEN 'CARDINAL' END AS label FROM uni),
spans AS (SELECT * FROM named UNION ALL SELECT * FROM pat WHERE label IS NOT NULL),
longest AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans t WHERE t.doc_id = s.doc_id
            AND t.start <= s.start AND s.start + s.n <= t.start + t.n AND t.n > s.n)),
kept AS (SELECT * FROM longest WHERE label NOT IN ('CARDINAL', 'ORDINAL')),
first AS (SELECT doc_id, label, entity, min(start) AS pos FROM kept GROUP BY ALL),
lab AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos), label) AS label_rank
        FROM first GROUP BY doc_id, label)
SELECT f.doc_id, l.label_rank, upper(f.label[1]) || lower(f.label[2:]) AS title,
       row_number() OVER (PARTITION BY f.doc_id, f.label ORDER BY f.pos, f.entity) AS entity_rank, f.entity
FROM first f JOIN lab l USING (doc_id, label)"""


@register("entity_tags", _sql_entities())
def q_entity_tags(spark, sf_dir):
    return _entity_tags(spark, sf_dir).select("doc_id", F.col("label_rank").cast("long").alias("label_rank"), "title",
                                              F.col("entity_rank").cast("long").alias("entity_rank"), "entity")


def _sql_corpus_entities() -> str:
    sql = _sql_entities()
    a, b = sql.index("gaz AS ("), sql.index("grams AS (")
    return sql[:a] + _SQL_CORPUS_GAZ + sql[b:]


@register("entity_tags_corpus", _sql_corpus_entities())
def q_entity_tags_corpus(spark, sf_dir):
    """E1-E3 with many nested and repeated names, from a gazetteer read off ``benchmark``."""
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tags = EN.entity_tags(EN.entity_spans(EN.entity_words(docs), _corpus_gazetteer(spark, sf_dir)))
    return tags.select("doc_id", F.col("label_rank").cast("long").alias("label_rank"), "title",
                       F.col("entity_rank").cast("long").alias("entity_rank"), "entity")


def _invoices(spark, sf_dir):
    """One line of text for each order: nation, total, largest discount, number of lines, year."""
    lines = TB.read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.max("l_discount") * 100).cast("long").alias("off"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.format_string("Invoice K%d from %s: $%d.%02d at %d %% off, $%d million in %d.", "o_orderkey", "n_name",
                           F.floor(cents / 100), cents % 100, F.coalesce("off", F.lit(0)), F.coalesce("lines", F.lit(0)),
                           F.year("o_orderdate"))
    return (TB.read_table(spark, sf_dir, "orders")
            .join(TB.read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(TB.read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@register("invoice_entities", """WITH li AS (SELECT l_orderkey, count(*) AS lines, CAST(round(max(l_discount) * 100) AS BIGINT) AS off
  FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS doc_id, n_name, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, coalesce(off, 0) AS off,
             coalesce(lines, 0) AS lines, year(o_orderdate) AS y
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN li ON o_orderkey = l_orderkey)
SELECT doc_id, 1::BIGINT AS label_rank, 'Gpe' AS title, 1::BIGINT AS entity_rank, n_name AS entity FROM o
UNION ALL SELECT doc_id, 2, 'Money', 1, '$' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') FROM o
UNION ALL SELECT doc_id, 2, 'Money', 2, '$' || lines || ' million' FROM o
UNION ALL SELECT doc_id, 3, 'Percent', 1, off || ' %' FROM o
UNION ALL SELECT doc_id, 4, 'Date', 1, CAST(y AS VARCHAR) FROM o""")
def q_invoice_entities(spark, sf_dir):
    """E1-E3 with amounts: MONEY and PERCENT beside names and years."""
    docs = _invoices(spark, sf_dir)
    spans = EN.entity_spans(EN.entity_words(docs), EN.default_gazetteer(spark, sf_dir), docs)
    return EN.entity_tags(spans).select("doc_id", F.col("label_rank").cast("long").alias("label_rank"), "title",
                                        F.col("entity_rank").cast("long").alias("entity_rank"), "entity")


def _sql_lemmas() -> str:
    exc = ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in LEMMA_EXCEPTIONS)
    rules = ", ".join(f"({S.q(a)}, {S.q(b)}, {i + 1})" for i, (a, b) in enumerate(NOUN_RULES))
    return f"""WITH docs AS ({S.docs_cte()}),
toks AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM docs),
lex AS (SELECT term AS lemma FROM (SELECT DISTINCT doc_id, term FROM toks) GROUP BY term HAVING count(*) >= 2),
exc AS (SELECT * FROM (VALUES {exc}) v(form, lemma)),
rules AS (SELECT * FROM (VALUES {rules}) v(suf, rep, prio)),
terms AS (SELECT DISTINCT term FROM toks),
cand AS (SELECT term, term AS c, 0 AS prio FROM terms
         UNION ALL SELECT t.term, e.lemma, 1 FROM terms t JOIN exc e ON e.form = t.term
         UNION ALL SELECT t.term, left(t.term, length(t.term) - length(r.suf)) || r.rep, r.prio FROM terms t, rules r
                   WHERE ends_with(t.term, r.suf) AND t.term NOT IN (SELECT form FROM exc)),
ok AS (SELECT * FROM cand WHERE c IN (SELECT lemma FROM lex)),
mp AS (SELECT term, arg_min(c, length(c) * 100 + prio) AS lemma FROM ok GROUP BY term),
lt AS (SELECT doc_id, string_agg(coalesce(mp.lemma, toks.term), ' ' ORDER BY pos) AS clean
       FROM toks LEFT JOIN mp USING (term) GROUP BY doc_id)
SELECT d.doc_id, coalesce(lt.clean, '') AS clean FROM documents d LEFT JOIN lt USING (doc_id)"""


@register("lemmatized", _sql_lemmas())
def q_lemmatized(spark, sf_dir):
    plain = cut_lineage(_docs(spark, sf_dir).select("doc_id", "tokens"))
    exc = spark.createDataFrame(LEMMA_EXCEPTIONS, "form string, lemma string")
    lem = Lemmatizer(corpus_lexicon(plain, 2), exc)
    return lem.apply(plain).select("doc_id", F.array_join("tokens", " ").alias("clean"))


# --- 8. topics -----------------------------------------------------------------

from tagweave.operators import topics as TP  # noqa: E402


def _topics(bags):
    return TP.fit_topics(bags, cut_lineage(bags.docs), k=5, seed=0)


def _sql_digamma(x: str) -> str:
    series = "1/12.0::DOUBLE - z * (1/120.0::DOUBLE - z * (1/252.0::DOUBLE - z * (1/240.0::DOUBLE - z / 132)))"
    y = f"({x} + {TP.SHIFT})"
    z = f"(1.0::DOUBLE / ({y} * {y}))"
    return f"(ln({y}) - 0.5::DOUBLE / {y} - {z} * ({series.replace('z', z)})" + "".join(f" - 1.0::DOUBLE / ({x} + {i})" for i in range(TP.SHIFT)) + ")"


def _sql_topics(k: int = 5, seed: int = 0) -> str:
    """CTEs lam(term, l0..), theta(doc_id, t0..) over w: every round and pass of the fit, written out."""
    ks = range(k)
    prior = repr(1.0 / k)
    cols = lambda f, sep=", ": sep.join(f(i) for i in ks)
    start = cols(lambda i: f"0.5::DOUBLE + ('0x' || substr(md5(term || '|{i}|{seed}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS l{i}")
    out = [f"lam0 AS MATERIALIZED (SELECT term, {start} FROM (SELECT DISTINCT term FROM w))"]
    gsum = "(" + cols(lambda i: f"g{i}", " + ") + ")"

    def e_step(name: str, lam: str) -> None:
        psi = _sql_digamma("x")
        out.append(f"{name}b AS MATERIALIZED (SELECT term, " + cols(lambda i: f"e[{i + 1}] AS b{i}") + " FROM (SELECT term, list_transform(["
                   + cols(lambda i: f"l{i}") + f"], lambda x, i: exp({psi} - p[i])) AS e FROM {lam}, (SELECT list_transform(["
                   + cols(lambda i: f"sum(l{i})") + f"], lambda x: {psi}) AS p FROM {lam})))")
        out.append(f"{name}x AS MATERIALIZED (SELECT doc_id, term, weight, " + cols(lambda i: f"b{i}") + f" FROM w JOIN {name}b USING (term))")
        out.append(f"{name}g0 AS MATERIALIZED (SELECT doc_id, " + cols(lambda i: f"1.0::DOUBLE AS g{i}") + " FROM (SELECT DISTINCT doc_id FROM w))")
        for p in range(TP.PASSES + 1):
            psi = _sql_digamma("x")
            out.append(f"{name}t{p} AS MATERIALIZED (SELECT doc_id, " + cols(lambda i: f"e[{i + 1}] AS t{i}") + " FROM (SELECT doc_id, "
                       f"list_transform(g, lambda x: exp({psi} - p[1])) AS e FROM (SELECT doc_id, [" + cols(lambda i: f"g{i}")
                       + f"] AS g, list_transform([{gsum}], lambda x: {psi}) AS p FROM {name}g{p})))")
            if p < TP.PASSES:
                share = "weight / (" + cols(lambda i: f"t{i} * b{i}", " + ") + ")"
                out.append(f"{name}g{p + 1} AS MATERIALIZED (SELECT doc_id, "
                           + cols(lambda i: f"{prior} + any_value(t{i}) * sum(sh * b{i}) AS g{i}")
                           + f" FROM (SELECT *, {share} AS sh FROM {name}x JOIN {name}t{p} USING (doc_id)) GROUP BY doc_id)")

    for r in range(TP.ROUNDS):
        e_step(f"r{r}", f"lam{r}")
        share = "weight / (" + cols(lambda i: f"t{i} * b{i}", " + ") + ")"
        out.append(f"lam{r + 1} AS MATERIALIZED (SELECT term, " + cols(lambda i: f"{prior} + sum(t{i} * sh * b{i}) AS l{i}")
                   + f" FROM (SELECT *, {share} AS sh FROM r{r}x JOIN r{r}t{TP.PASSES} USING (doc_id)) GROUP BY term)")
    e_step("z", f"lam{TP.ROUNDS}")
    rows = " UNION ALL ".join(f"SELECT {i} AS topic, term, l{i} / sum(l{i}) OVER () AS weight FROM lam{TP.ROUNDS}" for i in ks)
    out.append(f"ltt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, {TP.DIGITS}) DESC, term) AS rank "
               f"FROM ({rows})) WHERE rank <= 10)")
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS topic, g{i} / {gsum} AS theta FROM zg{TP.PASSES}" for i in ks)
    out.append(f"ltheta AS (SELECT d.doc_id, k.topic, coalesce(t.theta, {prior}) AS theta FROM docs d, "
               f"(SELECT unnest(range(0, {k})) AS topic) k LEFT JOIN ({rows}) t ON t.doc_id = d.doc_id AND t.topic = k.topic)")
    return ",\n".join(out) + "\n"


_SQL_LDA = _SQL_EVAL.rstrip() + ",\n" + _sql_topics()


@register("topic_top_terms", _SQL_LDA + "SELECT topic, term, round(weight, 6) AS weight FROM ltt WHERE rank = 1")
def q_topic_top_terms(spark, sf_dir):
    tt, _ = _topics(_eval_bags(spark, sf_dir, ranked=False))
    return TP.top_term_per_topic(tt).select(F.col("topic").cast("long").alias("topic"), "term", r6(F.col("weight")).alias("weight"))


@register("topic_keyword_mean_cosine", _SQL_LDA + """, lm AS (SELECT doc_id, term, sum(theta) AS weight FROM ltheta JOIN ltt USING (topic) GROUP BY doc_id, term),
lu AS (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS x FROM lm),
su AS (SELECT term, sum(x) AS su FROM lu GROUP BY term),
sv AS (SELECT 'lda_tfidf' AS pair, term, sum(weight) AS sv FROM ntop GROUP BY term
       UNION ALL SELECT 'lda_textrank', term, sum(weight) FROM trm GROUP BY term)
SELECT pair, round(coalesce(sum(su * sv), 0) / ((SELECT count(*) FROM docs) * (SELECT count(*) FROM docs)), 6) AS mean_cos
FROM sv LEFT JOIN su USING (term) GROUP BY pair""")
def q_topic_keyword_mean_cosine(spark, sf_dir):
    """A18 of the topic model with both other extractors."""
    bags = _eval_bags(spark, sf_dir)
    n, top10, trm = _matrices(bags)
    tt, theta = _topics(bags)
    lda_m = EV.topic_keyword_matrix(theta, tt, 10)
    pairs = [EV.mean_cosine(lda_m, m, n, n).select(F.lit(name).alias("pair"), r6(F.col("mean_cos")).alias("mean_cos"))
             for name, m in (("lda_tfidf", top10), ("lda_textrank", trm))]
    return pairs[0].unionByName(pairs[1])


@register("keyword_quality_topics", f"""WITH docs AS ({S.docs_cte()}),
grams AS (SELECT doc_id, unnest(tokens) AS term FROM docs
          UNION ALL
          SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS term
          FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM docs)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term){S.tfidf_ctes(max_features=5)},
{_sql_topics(2)}, {_SQL_TRUTH},
pred AS (SELECT term FROM ltt WHERE rank = 1)
SELECT 'lda' AS extractor, count(*) AS n_pred, count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) AS hits,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / count(*), 6) AS precision,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / (SELECT count(*) FROM truth), 6) AS recall
FROM pred""")
def q_keyword_quality_topics(spark, sf_dir):
    """A17 of the topic model: the top feature of each of two topics over the five most frequent n-grams."""
    w = FE.tfidf(_docs(spark, sf_dir), max_features=5, ngram_range=(1, 2))
    tt, _ = TP.fit_topics(w, w.select("doc_id").distinct(), k=2, seed=0)
    pred = TP.top_term_per_topic(tt).select(F.lit(0).cast("long").alias("doc_id"), F.lit("lda").alias("extractor"), "term")
    q = EV.keyword_quality(pred, _truth(spark, sf_dir))
    return q.select("extractor", "n_pred", "hits", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


# θ given by a table (labels: quality and toxicity as two topics) makes A13 and A18 exact
def _given_topics(spark, sf_dir):
    from tagweave.session import reuse
    lab = TB.read_table(spark, sf_dir, "labels")
    theta = lab.select("doc_id", F.posexplode(F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")))
                       .alias("topic", "theta"))
    _, top10, _ = _eval_matrices(spark, sf_dir, ranked=False)
    top10 = reuse(top10)   # ten rows a document, read again by the mean cosine
    summed = top10.join(theta, "doc_id").groupBy("topic", "term").agg(F.round(F.sum(F.col("theta") * F.col("weight")), 6).alias("weight"))
    return theta, FE.top_terms(summed, 10, by="topic"), top10


_SQL_GIVEN = _SQL_EVAL + """, theta AS (SELECT doc_id, 0 AS topic, quality::DOUBLE AS theta FROM labels
  UNION ALL SELECT doc_id, 1, toxic::DOUBLE FROM labels),
tsum AS (SELECT topic, term, round(sum(theta * weight), 6) AS weight FROM top10 JOIN theta USING (doc_id) GROUP BY topic, term),
tt AS (SELECT topic, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
       FROM tsum) WHERE rank <= 10),
tkm AS (SELECT doc_id, term, sum(theta) AS weight FROM theta JOIN tt USING (topic) GROUP BY doc_id, term)
"""


@register("given_topic_terms", _SQL_GIVEN + "SELECT topic::BIGINT AS topic, rank, term FROM tt")
def q_given_topic_terms(spark, sf_dir):
    """A12/A14 on given topics."""
    _, tt, _ = _given_topics(spark, sf_dir)
    return tt.select(F.col("topic").cast("long").alias("topic"), F.col("rank").cast("long").alias("rank"), "term")


@register("given_topic_matrix", _SQL_GIVEN + "SELECT doc_id, term, round(weight, 6) AS weight FROM tkm")
def q_given_topic_matrix(spark, sf_dir):
    """A13 on given topics."""
    theta, tt, _ = _given_topics(spark, sf_dir)
    return EV.topic_keyword_matrix(theta, tt, 10).select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@register("given_topic_mean_cosine", _SQL_GIVEN + """, u AS (SELECT doc_id, term, CASE WHEN n > 0 THEN weight / n ELSE 0 END AS x
  FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS n FROM tkm)),
su AS (SELECT term, sum(x) AS su FROM u GROUP BY term), sv AS (SELECT term, sum(weight) AS sv FROM ntop GROUP BY term)
SELECT round(coalesce(sum(su * sv), 0) / ((SELECT count(DISTINCT doc_id) FROM theta) * (SELECT count(*) FROM docs)), 6) AS mean_cos
FROM su JOIN sv USING (term)""")
def q_given_topic_mean_cosine(spark, sf_dir):
    theta, tt, top10 = _given_topics(spark, sf_dir)
    n_u = theta.select(F.count_distinct("doc_id")).scalar()
    n_v = FE.doc_count(_eval_docs(spark, sf_dir))
    return (EV.mean_cosine(EV.topic_keyword_matrix(theta, tt, 10), top10, n_u, n_v)
              .select(r6(F.col("mean_cos")).alias("mean_cos")))


DENSITY = dict(min_samples=5, xi=0.05, min_cluster_size=2)


def _sql_density() -> str:
    """The whole hierarchy over every distance, by Prim's order: the components at any distance are its intervals.

    Each position is the heaviest of one interval, which ends before the next heavier keys on both sides."""
    p = DENSITY
    base = "WITH RECURSIVE" + (_SQL_W + _SQL_REPS)[4:].split("pairs AS (SELECT")[0]
    return base.rstrip() + f"""
dots AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS cos
         FROM rw a JOIN rw b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
pts AS (SELECT rep, m, rep NOT IN (SELECT doc_id FROM w) AS blank, row_number() OVER (ORDER BY rep) AS i FROM mult),
dist AS MATERIALIZED (SELECT p.rep AS a, q.rep AS b, q.m, q.i, CASE WHEN p.blank OR q.blank THEN 1.0
         ELSE round(sqrt(greatest(0.0, 2.0 - 2.0 * coalesce(x.cos, 0))), 6) END AS d
         FROM pts p JOIN pts q ON p.rep <> q.rep LEFT JOIN dots x ON x.a = p.rep AND x.b = q.rep),
nb AS (SELECT a AS rep, d, m FROM dist UNION ALL SELECT rep, 0.0, m FROM pts),
cum AS (SELECT rep, d, sum(m) OVER (PARTITION BY rep ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM nb),
core AS (SELECT rep, min(d) AS core_d FROM cum WHERE c >= {p['min_samples']} GROUP BY rep),
adj AS MATERIALIZED (SELECT p.i, list({{'i': x.i, 'mr': greatest(ca.core_d, cb.core_d, x.d)}}) AS e
        FROM dist x JOIN core ca ON ca.rep = x.a JOIN core cb ON cb.rep = x.b JOIN pts p ON p.rep = x.a GROUP BY p.i),
prim(i, key, step) USING KEY (i) AS (
  SELECT p.i, CASE WHEN p.i = (SELECT min(i) FROM pts JOIN core USING (rep)) THEN -1.0 ELSE 1e9 END, 0
  FROM pts p JOIN core USING (rep)
  UNION
  (WITH pick AS (SELECT i, key, (SELECT max(step) + 1 FROM recurring.prim) AS step FROM recurring.prim
                 WHERE step = 0 ORDER BY key, i LIMIT 1),
        reach AS (SELECT e.i, e.mr FROM (SELECT unnest(a.e) AS e FROM adj a JOIN pick USING (i)))
   SELECT i, key, step FROM pick
   UNION ALL
   SELECT o.i, r.mr, 0 FROM recurring.prim o JOIN reach r ON r.i = o.i
   WHERE o.step = 0 AND r.mr < o.key AND o.i <> (SELECT i FROM pick))),
seq AS (SELECT step AS pos, rep, m, core_d, CASE WHEN key < 0 THEN 1e9 ELSE key END AS key
        FROM prim JOIN pts USING (i) JOIN core USING (rep)),
ends AS (SELECT pos, key FROM seq UNION ALL SELECT max(pos) + 1, 1e9 FROM seq),
spans AS (SELECT s.key AS h, (SELECT max(e.pos) FROM ends e WHERE e.pos < s.pos AND e.key > s.key) AS lo,
                 (SELECT min(e.pos) FROM ends e WHERE e.pos > s.pos AND e.key > s.key) AS hi
          FROM seq s WHERE s.pos > 1),
comps AS (SELECT h, lo, hi, least(a.key, b.key) AS leaving
          FROM (SELECT DISTINCT h, lo, hi FROM spans) JOIN ends a ON a.pos = lo JOIN ends b ON b.pos = hi
          UNION ALL SELECT s.core_d, s.pos, s.pos + 1, least(s.key, e.key) FROM seq s JOIN ends e ON e.pos = s.pos + 1),
tall AS (SELECT c.h, c.lo, c.hi, c.leaving, min(s.rep) AS name, sum(s.m) AS size
         FROM comps c JOIN seq s ON s.pos >= c.lo AND s.pos < c.hi GROUP BY c.h, c.lo, c.hi, c.leaving),
good AS (SELECT * FROM tall WHERE size >= {p['min_cluster_size']} AND leaving < 1e9 AND h <= (1.0 - {p['xi']}) * leaving),
inner_ AS (SELECT s.rep AS node, arg_min(g.name, g.hi - g.lo) AS cluster
           FROM seq s JOIN good g ON s.pos >= g.lo AND s.pos < g.hi GROUP BY s.rep
           UNION ALL SELECT rep, (SELECT min(rep) FROM core) FROM core
           WHERE (SELECT count(*) FROM good) = 0 AND (SELECT sum(m) FROM pts) >= {p['min_cluster_size']})
SELECT g.doc_id, coalesce(i.cluster, -1) AS cluster FROM grp g LEFT JOIN inner_ i ON i.node = g.rep"""


# --- 9. density clusters ---------------------------------------------------------

from tagweave.operators import density as DN  # noqa: E402


def _density(spark, sf_dir):
    w = _bags(spark, sf_dir)
    return DN.density_clusters(w, w, **DENSITY)


@register("density_clusters")
def q_density_clusters(spark, sf_dir):
    return _density(spark, sf_dir)


@register("density_cluster_counts")
def q_density_cluster_counts(spark, sf_dir):
    return CL.cluster_counts(_density(spark, sf_dir))


# --- 10. small operators: F8, X11, F9, J5, S7, C4 ------------------------------------

from tagweave.functions.text import ENGLISH_STOP_WORDS, remove_stop_words, script_clean  # noqa: E402
from tagweave.plans import cluster_pages as CP  # noqa: E402

_SQL_STOP_EN = S.str_list(ENGLISH_STOP_WORDS)
_SQL_SPLIT = ("list_filter(regexp_split_to_array(trim(coalesce({x}, '')), " + S.q("[" + S.PY_SPACE_CLASS + "]+")
              + "), lambda w: w <> '' AND NOT list_contains(" + _SQL_STOP_EN + ", lower(w)))")


@register("stop_words_removed", "SELECT doc_id, array_to_string(" + _SQL_SPLIT.replace("{x}", "text") +
          ", ' ') AS text FROM documents")
def q_stop_words_removed(spark, sf_dir):
    d = TB.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", remove_stop_words(F.col("text")).alias("text"))


_SQL_X11 = ("regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\p{Nd}+', '', 'g'), "
            "'[\\n\\\\]', '', 'g'), " + S.q("[^\\pL\\pN_" + S.PY_SPACE_CLASS + "]") + ", '', 'g')")


@register("script_clean", "SELECT doc_id, array_to_string(" + _SQL_SPLIT.replace("{x}", _SQL_X11) +
          ", ' ') AS text FROM documents")
def q_script_clean(spark, sf_dir):
    d = TB.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", script_clean(F.col("text")).alias("text"))


@register("text_from_tags", f"WITH {S.keyword_tags_sql(S.docs_cte())}\n"
          "SELECT d.doc_id, coalesce((SELECT string_agg(tag, ' ' ORDER BY rank) FROM kw WHERE kw.doc_id = d.doc_id), '')"
          " AS text FROM documents d")
def q_text_from_tags(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    tags = keyword_tags(FE.prepare_documents(docs), 0.2)
    return CP.text_source(docs, tags, "tags")


@register("current_tags", "WITH RECURSIVE " + _SQL_EVENTS + "," + S.keyword_tags_sql(S.docs_cte()) + """,
stored AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tagrows GROUP BY doc_id),
fresh AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY rank) AS tags FROM kw GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.tags, f.tags, '') AS tags FROM documents d
LEFT JOIN stored s USING (doc_id) LEFT JOIN fresh f USING (doc_id)""")
def q_current_tags(spark, sf_dir):
    """F3 + J5: stored tag lists win; untagged documents get fresh keyword tags."""
    docs = TB.read_table(spark, sf_dir, "documents")
    stored = TE.fold_tag_events(TE.events_to_tag_events(TB.read_table(spark, sf_dir, "events")))
    stored_s = stored.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("pos", "tag"))), lambda x: x["tag"]), " ").alias("tags"))
    pending = RU.untagged(docs, stored)
    fresh = keyword_tags(FE.prepare_documents(pending), 0.2)
    fresh_s = fresh.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("rank", "tag"))), lambda x: x["tag"]), " ").alias("tags"))
    base = docs.select("doc_id", F.lit("").alias("tags"))
    return CP.upsert(CP.upsert(base, fresh_s, "doc_id", ["tags"]), stored_s, "doc_id", ["tags"])


@register("service_replies")
def q_service_replies(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    tags = keyword_tags(FE.prepare_documents(docs), 0.2)
    ents = _entity_tags(spark, sf_dir)
    return CP.service_reply(tags, ents)


_SEL_TABLE = "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
_SQL_DBSCAN_SEL = _SQL_DBSCAN.replace(S.docs_cte(), S.docs_cte(_SEL_TABLE), 1)


@register("cluster_selected_dbscan", _SQL_DBSCAN_SEL + """, s AS (SELECT l.cluster, w.term, sum(w.weight) AS score
      FROM w JOIN dlab l USING (doc_id) GROUP BY l.cluster, w.term),
kw AS (SELECT cluster, term FROM
       (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rk FROM s) WHERE rk = 1)
SELECT d.doc_id, d.cluster, coalesce(k.term, '') AS group_title FROM dlab d LEFT JOIN kw k USING (cluster)""")
def q_cluster_selected_dbscan(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    sel = TB.read_table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return CP.cluster_documents(docs, sel, algorithm="dbscan", eps=0.5, min_samples=5)


@register("cluster_selected_kmeans", _sql_kmeans_groups(_SQL_W.replace(S.docs_cte(), S.docs_cte(_SEL_TABLE), 1), 5))
def q_cluster_selected_kmeans(spark, sf_dir):
    """C4 by k-means over a selection, titled with five keywords."""
    docs = TB.read_table(spark, sf_dir, "documents")
    sel = TB.read_table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return CP.cluster_documents(docs, sel, algorithm="kmeans", n_keywords=5, **KMEANS)


_SQL_DENSITY_SEL = _sql_density().replace(S.docs_cte(), S.docs_cte(_SEL_TABLE), 1)


@register("cluster_selected_density", _SQL_DENSITY_SEL.replace("\nSELECT g.doc_id, coalesce(i.cluster, -1) AS cluster FROM grp g "
          "LEFT JOIN inner_ i ON i.node = g.rep", """,
dlab AS (SELECT g.doc_id, coalesce(i.cluster, -1) AS cluster FROM grp g LEFT JOIN inner_ i ON i.node = g.rep),
s AS (SELECT l.cluster, w.term, sum(w.weight) AS score FROM w JOIN dlab l USING (doc_id) GROUP BY l.cluster, w.term),
kw AS (SELECT cluster, term FROM
       (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rk FROM s) WHERE rk = 1)
SELECT d.doc_id, d.cluster, coalesce(k.term, '') AS group_title FROM dlab d LEFT JOIN kw k USING (cluster)"""))
def q_cluster_selected_density(spark, sf_dir):
    """C4 by the density hierarchy over a selection."""
    docs = TB.read_table(spark, sf_dir, "documents")
    sel = TB.read_table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return CP.cluster_documents(docs, sel, algorithm="optics", **DENSITY)


@register("page_content")
def q_page_content(spark, sf_dir):
    return PG.page_content(TB.read_table(spark, sf_dir, "pages"))


def _sql_exact_pairs(sel: str, name: str) -> str:
    """CTEs computing exact ordered-pair counts for the pairs in ``sel`` (doc_id, ta, tb, fa)."""
    return f"""{name}_rows AS (
  SELECT c.doc_id, c.ta, c.tb, c.fa, t.pos, t.term = c.ta AS is_a, t.term = c.tb AS is_b
  FROM {sel} c JOIN toks t ON t.doc_id = c.doc_id AND t.term = c.ta
  UNION ALL
  SELECT c.doc_id, c.ta, c.tb, c.fa, t.pos, false, true
  FROM {sel} c JOIN toks t ON t.doc_id = c.doc_id AND t.term = c.tb WHERE c.ta <> c.tb),
{name}_run AS (SELECT *, coalesce(sum(CASE WHEN is_a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ta, tb ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a_before FROM {name}_rows),
{name} AS (SELECT doc_id, ta, tb, fa, sum(CASE WHEN is_b THEN a_before ELSE 0 END) AS n,
                  min(CASE WHEN is_b AND a_before > 0 THEN pos END) AS fb FROM {name}_run GROUP BY doc_id, ta, tb, fa)"""


ORACLES["pair_counts"] = f"""WITH docs AS ({S.docs_cte()}),
toks AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM docs),
uni AS (SELECT doc_id, term, count(*) AS c, min(pos) AS first FROM toks GROUP BY doc_id, term),
urank AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS rk FROM uni),
kth AS (SELECT doc_id, coalesce(max(c) FILTER (WHERE rk = 5), 0) AS kth FROM urank GROUP BY doc_id),
cand0 AS (SELECT a.doc_id, a.term AS ta, b.term AS tb, a.first AS fa,
                 CASE WHEN a.term = b.term THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END AS ub
          FROM uni a JOIN uni b USING (doc_id) JOIN kth k USING (doc_id)
          WHERE (CASE WHEN a.term = b.term THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END) > k.kth),
sel1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ub DESC, ta, tb) AS r FROM cand0)
         WHERE r <= 10),
{_sql_exact_pairs("sel1", "ex1")},
e1 AS (SELECT doc_id, c AS n, 0 AS kind, first AS i, 0 AS j FROM uni
       UNION ALL SELECT doc_id, n, 1, fa, fb FROM ex1 WHERE n > 0),
t1 AS (SELECT doc_id, coalesce(max(n) FILTER (WHERE r = 5), 0) AS t FROM
       (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind, i, j) AS r FROM e1)
       GROUP BY doc_id),
sel2 AS (SELECT c.* FROM cand0 c JOIN t1 USING (doc_id) WHERE c.ub >= t1.t),
{_sql_exact_pairs("sel2", "ex2")},
allv AS (SELECT doc_id, c AS n, 0 AS kind, first AS i, 0 AS j, term FROM uni
         UNION ALL SELECT doc_id, n, 1, fa, fb, ta || ' ' || tb FROM ex2 WHERE n > 0)
SELECT doc_id, rank, term, n AS count FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind, i, j) AS rank FROM allv)
WHERE rank <= 5"""


def _sql_keyword_quality() -> str:
    pc = ORACLES["pair_counts"].replace("\nSELECT doc_id, rank, term, n AS count FROM",
                                        ",\npc AS (SELECT doc_id, rank, term, n AS count FROM", 1) + ")"
    return pc + f""",
{_SQL_TRUTH},
grams AS (SELECT doc_id, unnest(tokens) AS term FROM docs
          UNION ALL
          SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS term
          FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM docs)),
gc AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY doc_id, term),
pred AS (SELECT doc_id, 'tfidf' AS extractor, term FROM
           (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, term) AS rk FROM gc) WHERE rk <= 5
         UNION ALL SELECT doc_id, 'combinations', term FROM pc
         UNION ALL SELECT doc_id, 'lda', term FROM
           (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, term) AS rk FROM
             (SELECT doc_id, term, count(*) AS c FROM toks GROUP BY doc_id, term)) WHERE rk <= 10)
SELECT doc_id, extractor, count(*) AS n_pred,
       count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) AS hits,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / count(*), 6) AS precision,
       round(count(DISTINCT CASE WHEN term IN (SELECT term FROM truth) THEN term END) / (SELECT count(*) FROM truth), 6)
         AS recall
FROM pred GROUP BY doc_id, extractor"""


ORACLES["keyword_quality"] = _sql_keyword_quality()


def _sql_service_replies() -> str:
    ent_sql = _sql_entities()
    body = ent_sql[len("WITH "):]
    cut = body.rindex("\nSELECT f.doc_id")
    ent_ctes = body[:cut] + ",\nent AS (" + body[cut + 1:] + ")"
    return ("WITH " + S.keyword_tags_sql(S.docs_cte()) + ",\n" + ent_ctes + """,
tg AS (SELECT doc_id, list(tag ORDER BY rank) AS tags FROM kw GROUP BY doc_id),
pl AS (SELECT doc_id, label_rank, title, list(entity ORDER BY entity_rank) AS tags FROM ent
       GROUP BY doc_id, label_rank, title),
nr AS (SELECT doc_id, list({'title': title, 'tags': tags} ORDER BY label_rank) AS ner_tags FROM pl GROUP BY doc_id)
SELECT coalesce(tg.doc_id, nr.doc_id) AS doc_id,
       CAST(to_json({'ner_tags': coalesce(nr.ner_tags, CAST([] AS STRUCT(title VARCHAR, tags VARCHAR[])[])),
                     'tags': coalesce(tg.tags, CAST([] AS VARCHAR[]))}) AS VARCHAR) AS reply
FROM tg FULL JOIN nr ON tg.doc_id = nr.doc_id""")


ORACLES["service_replies"] = _sql_service_replies()


ORACLES["density_clusters"] = _sql_density()
ORACLES["density_cluster_counts"] = _sql_density().replace(
    "\nSELECT g.doc_id, coalesce(i.cluster, -1) AS cluster FROM grp g LEFT JOIN inner_ i ON i.node = g.rep",
    ",\ndl AS (SELECT g.doc_id, coalesce(i.cluster, -1) AS cluster FROM grp g LEFT JOIN inner_ i ON i.node = g.rep)\n"
    "SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, "
    "count(*) FILTER (WHERE cluster = -1) AS n_noise FROM dl")
