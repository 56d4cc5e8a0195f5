"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string restates a query's semantics over the raw test tables, built
from the same fixed values as the Spark code (stop list, punctuation,
whitespace class) so that both sides clean text identically.
"""

from __future__ import annotations

from tagweave.functions.text import ASCII_PUNCTUATION, DEFAULT_STOP_WORDS, PY_SPACE_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


STOP_LIST = str_list(DEFAULT_STOP_WORDS)


def normalized(col: str) -> str:
    s = f"lower(coalesce({col}, ''))"
    s = f"replace({s}, '{{html}}', '')"
    s = f"regexp_replace({s}, '<.*?>', ' ', 'g')"
    s = f"regexp_replace({s}, {q('http[^' + PY_SPACE_CLASS + ']+')}, '', 'g')"
    s = f"replace({s}, chr(10), ' ')"
    s = f"regexp_replace({s}, '[0-9]+', '', 'g')"
    s = f"translate({s}, {q(ASCII_PUNCTUATION)}, '')"
    return f"replace({s}, chr(13), ' ')"


def clean_tokens(col: str, stop_list: str = STOP_LIST) -> str:
    toks = f"regexp_extract_all({normalized(col)}, '[\\pL\\pN_]+')"
    return f"list_filter({toks}, lambda w: length(w) >= 3 AND NOT list_contains({stop_list}, w))"


def docs_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    return f"SELECT {id_col} AS doc_id, {clean_tokens(text_col)} AS tokens FROM {table}"


TOKENS_TF = """
toks AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)"""


def with_docs(body: str, docs: str | None = None) -> str:
    return f"WITH docs AS ({docs or docs_cte()}),{TOKENS_TF}\n{body}"


def tfidf_ctes(max_df: float | int = 1.0, min_df: int = 1, max_features: int | None = None,
               tf_name: str = "tf") -> str:
    """CTEs idf(term, df, idf) and w(doc_id, term, tf, weight) over ``tf``; needs docs."""
    conds = ["length(term) >= 2"]
    hav = []
    if isinstance(max_df, float) and max_df < 1.0:
        hav.append(f"count(*) <= {max_df} * (SELECT count(*) FROM docs)")
    elif isinstance(max_df, int):
        hav.append(f"count(*) <= {max_df}")
    if min_df > 1:
        hav.append(f"count(*) >= {min_df}")
    having = ("HAVING " + " AND ".join(hav)) if hav else ""
    limit = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f""",
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {tf_name} WHERE {' AND '.join(conds)}
          GROUP BY term {having} {limit}),
idf AS (SELECT term, df, ln((1 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1 AS idf FROM stats),
raw AS (SELECT t.doc_id, t.term, t.tf, t.tf * i.idf AS weight FROM {tf_name} t JOIN idf i USING (term)),
w AS (SELECT doc_id, term, tf, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight
      FROM raw)"""


def keyword_tags_sql(docs: str, threshold: float = 0.2, top_n: int = 10,
                     headers: str | None = None, styled: str | None = None) -> str:
    """A10 over ``docs`` (doc_id, tokens[, headers, styled]); yields kw(doc_id, rank, tag, score)."""
    h = headers or "CAST(NULL AS VARCHAR)"
    s = styled or "CAST(NULL AS VARCHAR)"
    return f"""
kdocs AS ({docs}),
ktoks AS (SELECT doc_id, unnest(tokens) AS term FROM kdocs),
ktf AS (SELECT doc_id, term, count(*) AS tf FROM ktoks GROUP BY doc_id, term),
kst AS (SELECT doc_id, sum(tf) AS n_tok, count(*) AS n_terms,
               sqrt(sum(CASE WHEN length(term) >= 2 THEN tf * tf END)) AS norm FROM ktf GROUP BY doc_id),
ksc AS (SELECT f.doc_id, f.term, f.tf,
               CASE WHEN length(f.term) >= 2 THEN f.tf / st.norm END AS a,
               (f.tf + 1.0) / (st.n_tok + st.n_terms) AS b,
               row_number() OVER (PARTITION BY f.doc_id ORDER BY f.tf DESC, f.term) AS br,
               CASE WHEN contains(d.h, f.term) THEN 1.5 WHEN contains(d.s, f.term) THEN 1.2 ELSE 1.0 END AS boost
        FROM ktf f JOIN kst st USING (doc_id)
        JOIN (SELECT doc_id, {h} AS h, {s} AS s FROM kdocs) d USING (doc_id)),
kent AS (SELECT doc_id, term, br,
                CASE WHEN (a > {threshold} OR br <= {top_n}) AND a * boost > {threshold} THEN a * boost END AS ak,
                CASE WHEN br <= {top_n} AND b * boost > {threshold} THEN b * boost END AS bk
         FROM ksc),
kord AS (SELECT doc_id, term, least(ak, bk) AS lo, greatest(ak, bk) AS hi,
                CASE WHEN ak IS NOT NULL AND (bk IS NULL OR ak <= bk) THEN 0 ELSE 1 END AS kind, br
         FROM kent WHERE ak IS NOT NULL OR bk IS NOT NULL),
kw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo, kind,
                                         CASE WHEN kind = 1 THEN br ELSE 0 END, term) AS rank,
              term AS tag, hi AS score FROM kord)"""


RAW_TOKEN = "[\\pL\\pN_]+|[^" + PY_SPACE_CLASS + "\\pL\\pN_]"


def raw_token_cte() -> str:
    """rtok(doc_id, rt, keep) over documents."""
    return (f"rtok AS (SELECT doc_id, rt, list_transform(rt, lambda t: regexp_full_match(t, '\\pL+') AND "
            f"NOT list_contains({STOP_LIST}, lower(t))) AS keep FROM "
            f"(SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q(RAW_TOKEN)}) AS rt FROM documents))")


def eval_docs_cte() -> str:
    """docs(doc_id, tokens): alphabetic non-stop tokens, lower case."""
    return (raw_token_cte() + ",\n"
            "docs AS (SELECT doc_id, list_transform(list_filter(list_zip(rt, keep), lambda z: z[2]), "
            "lambda z: lower(z[1])) AS tokens FROM rtok)")


def textrank_ctes(iters: int, alpha: float = 0.85, top_n: int = 10) -> str:
    """CTEs after rtok: tr(doc_id, rank, term, score) after ``iters`` PageRank rounds, in a WITH RECURSIVE."""
    return f"""ue AS (SELECT DISTINCT doc_id, least(rt[i], rt[i + 1]) AS a, greatest(rt[i], rt[i + 1]) AS b
       FROM (SELECT doc_id, rt, keep, unnest(range(1, len(rt))) AS i FROM rtok) WHERE keep[i] AND keep[i + 1]),
de AS (SELECT doc_id, a AS src, b AS dst FROM ue UNION ALL SELECT doc_id, b, a FROM ue WHERE a <> b),
nodes AS (SELECT doc_id, src AS node, count(*) AS outdeg,
                 row_number() OVER (ORDER BY doc_id, src) AS id FROM de GROUP BY doc_id, src),
nn AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY doc_id),
dew AS MATERIALIZED (SELECT s.id AS src, t.id AS dst, s.outdeg, c.n FROM de d
        JOIN nodes s ON s.doc_id = d.doc_id AND s.node = d.src JOIN nodes t ON t.doc_id = d.doc_id AND t.node = d.dst
        JOIN nn c ON c.doc_id = d.doc_id),
pr(id, x, k) USING KEY (id) AS (
  SELECT n.id, 1.0::DOUBLE / c.n, 0 FROM nodes n JOIN nn c USING (doc_id)
  UNION
  SELECT d.dst, {alpha} * sum(p.x / d.outdeg) + (1 - {alpha}) / any_value(d.n), any_value(p.k) + 1
  FROM pr p JOIN dew d ON p.id = d.src WHERE p.k < {iters} GROUP BY d.dst),
tr AS (SELECT doc_id, rank, term, score FROM (SELECT doc_id, node AS term, x AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 9) DESC, node) AS rank
         FROM nodes JOIN pr USING (id)) WHERE rank <= {top_n})"""
