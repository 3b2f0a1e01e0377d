"""The FIXTURES.md §2 relations in DuckDB SQL, for the oracle side.

``with_rel(body, *names)`` prefixes a query with the CTEs it needs (and
their dependencies) in definition order.
"""

from __future__ import annotations

from ..functions.text import WS

# SQL spellings of the shared text rules.
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tok_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WS}+'), lambda t: t <> '')"


REL: dict[str, tuple[tuple[str, ...], str]] = {
    "PAIRS": ((), """
        SELECT conv_id, turn, query_text, gold_passage FROM (
          SELECT conv_id, turn, role, text AS query_text,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold_passage
          FROM conversations) t
        WHERE role = 'user' AND next_role = 'assistant'"""),
    "PASS": ((), "SELECT CAST(doc_id AS VARCHAR) AS corpus_id, text, lang, source FROM documents"),
    "BQ": ((), "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark"),
    "BQREL": (("BQ", "PASS"), """
        SELECT b.query_id, p.corpus_id, CAST(1 AS INTEGER) AS score
        FROM BQ b JOIN PASS p ON contains(p.text, b.text)"""),
    "QRELS_DIRTY": (("BQREL",), """
        SELECT query_id, corpus_id, score FROM BQREL
        UNION ALL SELECT query_id, corpus_id || '-missing', score FROM BQREL
        UNION ALL SELECT query_id || '-missing', corpus_id, score FROM BQREL"""),
    "DIRTY_B": ((), """
        SELECT doc_id, lang,
               CASE WHEN doc_id % 23 = 0 THEN '   '
                    ELSE split_part(text, chr(10), 1) END AS query_text,
               text AS gold_passage,
               CASE WHEN doc_id % 17 = 0 THEN NULL
                    WHEN doc_id % 19 = 0 THEN text
                    ELSE lead(text) OVER (PARTITION BY lang ORDER BY doc_id) END AS hard_negative
        FROM documents"""),
    "DIRTY": (("DIRTY_B",), """
        SELECT lang, query_text, gold_passage, hard_negative FROM DIRTY_B
        UNION ALL
        SELECT lang, query_text, gold_passage, hard_negative FROM DIRTY_B WHERE doc_id % 29 = 0"""),
    "LANGEVAL": ((), """
        SELECT CASE lang WHEN 'de' THEN 'in_distribution' WHEN 'fr' THEN 'in_distribution'
                         WHEN 'es' THEN 'out_of_distribution' WHEN 'en' THEN 'zero_shot' ELSE 'unlisted' END AS setting,
               coalesce(lang, 'und') AS lang, split_part(text, chr(10), 1) AS query, text AS passage
        FROM documents"""),
    "VEC": ((), "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"),
    "RESP": ((), """
        SELECT doc_id AS id, CASE (n + coalesce(doc_id, 0)) % 14
            WHEN 0 THEN CAST(n % 101 AS VARCHAR) WHEN 1 THEN '0.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') WHEN 2 THEN '1'
            WHEN 3 THEN CAST(n % 120 AS VARCHAR) || '/100' WHEN 4 THEN CAST(n % 12 AS VARCHAR) || ' out of 10'
            WHEN 5 THEN 'Score: ' || CAST(n % 101 AS VARCHAR) WHEN 6 THEN CAST(n % 150 AS VARCHAR) || '%'
            WHEN 7 THEN CAST(n % 5 AS VARCHAR) || '/4' WHEN 8 THEN 'VERY HARD, ' || head
            WHEN 9 THEN 'MODERATELY HARD: ' || head WHEN 10 THEN 'VERY EASY because ' || head
            WHEN 11 THEN 'nan' WHEN 12 THEN head ELSE '' END AS response
        FROM (SELECT doc_id, coalesce(length(text), 0) AS n, coalesce(split_part(text, chr(10), 1), '') AS head FROM documents)"""),
    "SCORED": (("DIRTY",), """
        SELECT lang, query_text, gold_passage, hard_negative,
               CAST(((length(gold_passage) * 37 + length(query_text)) % 101) AS DOUBLE) / 100.0 AS rag_score
        FROM DIRTY WHERE hard_negative IS NOT NULL"""),
    "EXPECT": ((), """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'HARD' ELSE 'EASY' END AS expected,
               CASE WHEN toxic = 0 THEN 'HARD' ELSE 'EASY' END AS predicted
        FROM labels"""),
    "PAIRRESP": ((), """
        SELECT doc_id AS id,
          CASE doc_id % 5
            WHEN 0 THEN 'CLASSIFICATION: HARD' || chr(10) || 'CONFIDENCE: 0.9' || chr(10) || 'REASON: ' || text
            WHEN 1 THEN 'Classification: regular' || chr(10) || 'Confidence: 0.35' || chr(10) || 'Reason: not hard, ' || text
            WHEN 2 THEN 'CLASSIFICATION: REGULAR' || chr(10) || 'REASON: ' || text
            WHEN 3 THEN ''
            ELSE 'CLASSIFICATION: HARD' || chr(10) || 'CONFIDENCE: high' END AS response
        FROM documents"""),
    "NUMRESP": ((), """
        SELECT doc_id AS id,
          CASE doc_id % 4
            WHEN 0 THEN '1. ' || replace(text, chr(10), chr(10) || '2. ')
            WHEN 1 THEN text
            WHEN 2 THEN 'Sure, here they are:' || chr(10) || '1. ' || split_part(text, chr(10), 1)
                        || chr(10) || '   more words' || chr(10) || chr(10) || '2. ' || text
                        || chr(10) || '3.' || chr(10) || '4. ' || split_part(text, chr(10), 1)
            ELSE '' END AS response
        FROM documents"""),
}


def dense_context_sql(queries: str, passages: str, k: int = 3, dim: int = 64) -> str:
    """CTEs up to CTX ``(query_text, rn, passage)``: the ``k`` nearest
    ``passage`` of each ``query_text`` by hashed bag of words."""
    def side(name: str, col: str, rows: str) -> str:
        return f"""
{name}0 AS (SELECT DISTINCT {col} AS t FROM ({rows}) WHERE {col} IS NOT NULL),
{name}1 AS (SELECT t, CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % {dim} AS b, count(*) AS c
        FROM (SELECT t, unnest({tok_sql('t')}) AS w FROM {name}0) GROUP BY ALL),
{name}2 AS (SELECT t, b, c / sqrt(sum(c * c) OVER (PARTITION BY t)) AS x FROM {name}1)"""
    return f"""{side('CQ', 'query_text', queries)},{side('CP', 'passage', passages)},
CS AS (SELECT q.t AS query_text, p.t AS passage, sum(q.x * p.x) AS s FROM CQ2 q JOIN CP2 p USING (b) GROUP BY ALL),
CTX AS (SELECT query_text, passage, rn FROM (
  SELECT q.t AS query_text, p.t AS passage,
         row_number() OVER (PARTITION BY q.t ORDER BY round(coalesce(s.s, 0.0), 9) DESC, md5(p.t)) AS rn
  FROM CQ0 q CROSS JOIN CP0 p LEFT JOIN CS s ON s.query_text = q.t AND s.passage = p.t) WHERE rn <= {k})"""


def with_rel(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in REL[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({REL[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
