"""Queries for the column expressions of SURVEY §2.2: each runs an expression
over a whole table (table in, table out)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import bm25, clean, dense, relate
from ..sources import testdata as td
from .mining import _CLEAN_PAIRS
from .registry import query, r6
from .relations_sql import dense_context_sql, strip_sql, tok_sql, with_rel

WS = T.WS
NUM = T.NUMBER


def _sql_str(s: str) -> str:
    """A SQL literal for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def _sql_template(template: str, **slots: str) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(_sql_str(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(_sql_str(rest[:i]))
        out.append(f"CAST({slots[rest[i + 1:j]]} AS VARCHAR)")
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


# ---- ids, lengths, truncation -------------------------------------------------

@query("cast_ids", with_rel("""
SELECT p.corpus_id, l.quality FROM PASS p
JOIN (SELECT CAST(doc_id AS VARCHAR) AS corpus_id, quality FROM labels) l USING (corpus_id)""", "PASS"))
def q_cast_ids(spark, sf_dir):
    from ..operators.relate import cast_ids
    labels = cast_ids(td.table(spark, sf_dir, "labels"), ["doc_id"]) \
        .withColumnRenamed("doc_id", "corpus_id")
    return td.passages(spark, sf_dir).join(labels, "corpus_id").select("corpus_id", "quality")


@query("title_concat", """
SELECT conv_id, turn, 'turn ' || CAST(turn AS VARCHAR) || ' ' || text AS passage FROM conversations""")
def q_title_concat(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations")
    title = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", T.title_concat(title, "text").alias("passage"))


@query("char_length", """
SELECT doc_id, length(text) AS n_chars, n_chars AS stored_chars FROM documents""")
def q_char_length(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.char_length("text").alias("n_chars"), F.col("n_chars").alias("stored_chars"))


@query("strip_text", with_rel(f"""
SELECT DISTINCT lang, md5(gold_passage) AS gold_md5, {strip_sql('query_text')} AS query_stripped
FROM DIRTY""", "DIRTY"))
def q_strip_text(spark, sf_dir):
    d = td.dirty(spark, sf_dir)
    return d.select("lang", F.md5("gold_passage").alias("gold_md5"),
                    T.strip_text("query_text").alias("query_stripped")).distinct()


@query("tokenize", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tok_sql('text')} AS toks FROM documents)""")
def q_tokenize(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", T.tokenize("text").alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


_WIDTHS = (100, 120, 200, 300, 500)


@query("truncate_text", "SELECT doc_id, " + ", ".join(
    f"substr(text, 1, {n}) AS t{n}" for n in _WIDTHS) + " FROM documents")
def q_truncate_text(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[T.truncate_text("text", n).alias(f"t{n}") for n in _WIDTHS])


@query("length_ratio", with_rel("""
SELECT lang, md5(gold_passage) AS gold_md5, md5(query_text) AS query_md5,
       round(CAST(length(query_text) AS DOUBLE) / nullif(length(gold_passage), 0), 6) AS query_gold,
       round(CAST(length(query_text) AS DOUBLE) / nullif(length(hard_negative), 0), 6) AS query_neg,
       round(CAST(length(gold_passage) AS DOUBLE) / nullif(length(hard_negative), 0), 6) AS gold_neg
FROM DIRTY""", "DIRTY"))
def q_length_ratio(spark, sf_dir):
    d = td.dirty(spark, sf_dir)
    return d.select("lang", F.md5("gold_passage").alias("gold_md5"), F.md5("query_text").alias("query_md5"),
                    r6(T.length_ratio("query_text", "gold_passage")).alias("query_gold"),
                    r6(T.length_ratio("query_text", "hard_negative")).alias("query_neg"),
                    r6(T.length_ratio("gold_passage", "hard_negative")).alias("gold_neg"))


@query("score_cache_key", with_rel("""
SELECT lang, md5(query_text || '|' || gold_passage || '|'
                 || hard_negative) AS cache_key
FROM SCORED""", "SCORED"))
def q_score_cache_key(spark, sf_dir):
    s = td.scored(spark, sf_dir)
    return s.select("lang", T.score_cache_key("query_text", "gold_passage", "hard_negative").alias("cache_key"))


# ---- prompts -----------------------------------------------------------------------

@query("build_grading_prompt", with_rel("SELECT lang, md5(" + _sql_template(
    T.GRADING_PROMPT, query="substr(query_text, 1, 200)", gold="substr(gold_passage, 1, 300)",
    negative="substr(hard_negative, 1, 300)") + ") AS prompt_md5 FROM SCORED", "SCORED"))
def q_build_grading_prompt(spark, sf_dir):
    s = td.scored(spark, sf_dir)
    return s.select("lang", F.md5(T.grading_prompt("query_text", "gold_passage", "hard_negative"))
                    .alias("prompt_md5"))


@query("build_generation_prompt", with_rel("SELECT conv_id, turn, " + _sql_template(
    T.GENERATION_PROMPT, n="3", query="query_text", positive="substr(gold_passage, 1, 200)")
    + " AS prompt FROM PAIRS", "PAIRS"))
def q_build_generation_prompt(spark, sf_dir):
    p = td.pairs(spark, sf_dir)
    return p.select("conv_id", "turn", T.generation_prompt("query_text", "gold_passage", 3).alias("prompt"))


@query("build_pair_prompt", with_rel("SELECT lang, md5(" + _sql_template(
    T.PAIR_PROMPT, query="query_text", negative="hard_negative") + ") AS prompt_md5 FROM SCORED",
    "SCORED"))
def q_build_pair_prompt(spark, sf_dir):
    s = td.scored(spark, sf_dir)
    return s.select("lang", F.md5(T.pair_prompt("query_text", "hard_negative")).alias("prompt_md5"))


_CTX_SQL = with_rel(f"""
WITH {_CLEAN_PAIRS},{dense_context_sql("SELECT query_text FROM cleaned", "SELECT gold_passage AS passage FROM cleaned")},
ctxl AS (SELECT query_text, string_agg('• ' || substr(passage, 1, 120), chr(10) ORDER BY rn) AS bullets FROM CTX GROUP BY ALL)
SELECT c.conv_id, c.turn, md5(""" + _sql_template(
    T.CONTEXT_PROMPT,
    enhanced_query="'Query: ' || c.query_text || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(x.bullets, '')",
    gold="substr(c.gold_passage, 1, 200)", negative="substr(c.query_text, 1, 200)") + """) AS prompt_md5
FROM cleaned c LEFT JOIN ctxl x USING (query_text)""", "PAIRS")


@query("build_context_prompt", _CTX_SQL)
def q_build_context_prompt(spark, sf_dir):
    cleaned = clean.clean_dataset(td.pairs(spark, sf_dir), negative=None)
    corpus = bm25.build_corpus(cleaned, cols=["gold_passage"])
    top = dense.nearest_texts(cleaned, corpus, dense.hashed_bow_encoder(64), k=3)
    out = relate.attach_context(cleaned, top, "query_text", k=3)
    # the query stands in as its own negative text here
    return out.select("conv_id", "turn", F.md5(T.context_prompt(
        "query_text", "gold_passage", "query_text", "contexts")).alias("prompt_md5"))


# ---- parsers --------------------------------------------------------------------------

def hardness_sql(extended: bool) -> str:
    """SQL for parse_hardness over a column ``s`` = upper(strip(reply))."""
    cands = [f"CASE WHEN regexp_matches(s, '{NUM}') THEN "
             f"(CASE WHEN CAST(s AS DOUBLE) > 1 THEN CAST(s AS DOUBLE) / 100.0 ELSE CAST(s AS DOUBLE) END) END"]
    pats = list(T.SCORE_PATTERNS) + (list(T.EXTENDED_PATTERNS) if extended else [])
    for p, d in pats:
        cands.append(f"CASE WHEN regexp_matches(s, '{p}') THEN "
                     f"CAST(regexp_extract(s, '{p}', 1) AS DOUBLE) / {d} END")
    if extended:
        rp = T.RATIO_PATTERN
        cands.append(f"CASE WHEN regexp_matches(s, '{rp}') AND CAST(regexp_extract(s, '{rp}', 2) AS DOUBLE) > 0 "
                     f"THEN CAST(regexp_extract(s, '{rp}', 1) AS DOUBLE) / CAST(regexp_extract(s, '{rp}', 2) AS DOUBLE) END")
    sc = f"coalesce({', '.join(cands)})"
    clamped = f"CASE WHEN ({sc}) IS NOT NULL THEN least(greatest({sc}, 0.0), 1.0) END"
    if extended:
        kw = " ".join(f"WHEN contains(s, '{w}') THEN {v}" for w, v in T.HARDNESS_KEYWORDS)
        clamped = f"coalesce({clamped}, CASE {kw} END)"
    return f"coalesce({clamped}, 0.5)"


def upper_strip_sql(col: str) -> str:
    return f"upper({strip_sql('coalesce(' + col + ', ' + chr(39) * 2 + ')')})"


def _sql_hardness(extended: bool) -> str:
    return (f"SELECT id, response, round({hardness_sql(extended)}, 6) AS score "
            f"FROM (SELECT id, response, {upper_strip_sql('response')} AS s FROM RESP)")


@query("parse_hardness", with_rel(_sql_hardness(False), "RESP"))
def q_parse_hardness(spark, sf_dir):
    r = td.replies(spark, sf_dir)
    return r.select("id", "response", r6(T.parse_hardness("response")).alias("score"))


@query("parse_hardness_extended", with_rel(_sql_hardness(True), "RESP"))
def q_parse_hardness_extended(spark, sf_dir):
    r = td.replies(spark, sf_dir)
    return r.select("id", "response", r6(T.parse_hardness("response", extended=True)).alias("score"))


@query("parse_score_strict", with_rel(f"""
SELECT id, response, round(coalesce(CASE WHEN regexp_matches(s, '{NUM}') THEN least(greatest(
    (CASE WHEN CAST(s AS DOUBLE) > 1 THEN CAST(s AS DOUBLE) / 100.0 ELSE CAST(s AS DOUBLE) END),
  0.0), 1.0) END, 0.5), 6) AS score
FROM (SELECT id, response, {strip_sql("coalesce(response, '')")} AS s FROM RESP)""", "RESP"))
def q_parse_score_strict(spark, sf_dir):
    r = td.replies(spark, sf_dir)
    return r.select("id", "response", r6(T.parse_score_strict("response")).alias("score"))


@query("hardness_label", with_rel(f"""
WITH parsed AS ({_sql_hardness(False)})
SELECT id,
  CASE WHEN response = '' THEN 'UNKNOWN' WHEN score > 0.5 THEN 'HARD' ELSE 'EASY' END AS llm_classification,
  CASE WHEN response = '' THEN NULL ELSE score > 0.5 END AS is_hard,
  CASE WHEN response = '' THEN 0.5 ELSE score END AS hardness_score
FROM parsed""", "RESP"))
def q_hardness_label(spark, sf_dir):
    r = td.replies(spark, sf_dir).withColumn("score", r6(T.parse_hardness("response")))
    label, is_hard, score = T.hardness_label("score", F.col("response") != "")
    return r.select("id", label.alias("llm_classification"), is_hard.alias("is_hard"),
                    score.alias("hardness_score"))


@query("parse_pair_verdict", with_rel(f"""
SELECT id,
  CASE WHEN response IS NULL OR response = '' THEN false
       ELSE contains(t, 'HARD') AND contains(t, 'CLASSIFICATION:') END AS is_hard_negative,
  CASE WHEN response IS NULL OR response = '' THEN 0.5
       ELSE coalesce(CASE WHEN contains(t, 'CONFIDENCE:') AND regexp_matches(f, '{NUM}')
                          THEN CAST(f AS DOUBLE) END, 0.7) END AS confidence,
  CASE WHEN response IS NULL OR response = '' THEN 'Empty response' END AS error
FROM (SELECT id, response, t,
             {strip_sql("split_part(regexp_extract(t, '([^' || chr(10) || ']*CONFIDENCE:[^' || chr(10) || ']*)', 1), ':', 2)")} AS f
      FROM (SELECT id, response, upper(response) AS t FROM PAIRRESP))""", "PAIRRESP"))
def q_parse_pair_verdict(spark, sf_dir):
    r = td.verdict_replies(spark, sf_dir)
    hard, conf, err = T.parse_pair_verdict("response")
    return r.select("id", hard.alias("is_hard_negative"), conf.alias("confidence"), err.alias("error"))


_NUMBERED_SQL = with_rel(f"""
WITH lines AS (
  SELECT id, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln
  FROM (SELECT id, string_split(coalesce(response, ''), chr(10)) AS parts FROM NUMRESP)),
marked AS (
  SELECT id, ln, st, st <> '' AND regexp_matches(st, '^[1-9][.]') AS marker
  FROM (SELECT id, ln, {strip_sql('line')} AS st FROM lines)),
items AS (
  SELECT id, ln,
         sum(CASE WHEN marker THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ln
                                                       ROWS UNBOUNDED PRECEDING) AS item_grp,
         CASE WHEN marker THEN {strip_sql('substr(st, 3)')} ELSE st END AS content
  FROM marked),
grouped AS (
  SELECT id, item_grp, string_agg(content, ' ' ORDER BY ln) AS item
  FROM items WHERE content <> '' GROUP BY id, item_grp)
SELECT id, CAST(item_no AS INTEGER) AS item_no, item FROM (
  SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY item_grp) AS item_no FROM grouped)
WHERE item_no <= 3""", "NUMRESP")


@query("parse_numbered_list", _NUMBERED_SQL)
def q_parse_numbered_list(spark, sf_dir):
    r = td.list_replies(spark, sf_dir)
    items = r.select("id", F.posexplode(T.parse_numbered_list("response", 3)).alias("pos", "item"))
    return items.select("id", (F.col("pos") + 1).cast("int").alias("item_no"), "item")


# ---- vector and ranking maths ---------------------------------------------------------

@query("normalize_vector", with_rel("""
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS value
FROM (SELECT vec_id, embedding, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM VEC)""",
                                          "VEC"))
def q_normalize_vector(spark, sf_dir):
    v = td.vectors(spark, sf_dir).select("vec_id", V.normalize_vector("embedding").alias("u"))
    return v.select("vec_id", F.posexplode("u").alias("pos", "value")) \
        .select("vec_id", (F.col("pos") + 1).cast("int").alias("pos"), r6(F.col("value")).alias("value"))


@query("cosine", with_rel("""
SELECT a.vec_id, b.vec_id AS other_id,
       round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] * p[2]))
             / (sqrt(list_sum(list_transform(a.embedding, lambda x: x * x)))
                * sqrt(list_sum(list_transform(b.embedding, lambda x: x * x))) + 1e-8), 6) AS cosine
FROM VEC a JOIN VEC b ON b.vec_id = a.vec_id + 1""", "VEC"))
def q_cosine(spark, sf_dir):
    v = td.vectors(spark, sf_dir)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"),
                 F.col("embedding").alias("e2"))
    return v.join(b, "vec_id").select("vec_id", "other_id",
                                      r6(V.cosine("embedding", "e2")).alias("cosine"))
