"""Model-graded negatives: the Spark job around a pluggable language model.

The model pass itself (retries, batches, dead letters) is ``model_pass``;
everything before (prompt building) and after (parsing, labelling, selection)
is Spark SQL expressions.

The offline models below are deterministic stand-ins (token overlap) so the
jobs can run and be checked without a model server; they say nothing about
model quality.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .model_pass import Model, ModelPass, call_model, split_pass
from .ordering import flag_first

CONTEXT_WIDTHS = {"passage": X.CONTEXT_PASSAGE_WIDTH, "gold": X.CONTEXT_GOLD_WIDTH}

# Names tried, in order, for the negative-passage column.
NEGATIVE_COLUMNS = ["hard_negative", "negative", "neg_text", "negative_text", "hard_neg", "neg_passage"]


# --- offline stand-in models -------------------------------------------------------------

def _toks(s) -> list[str]:
    return [] if s is None else s.lower().split()


def overlap_grader() -> Callable[[dict], str]:
    """Hardness 0-100 = share of the negative's distinct tokens that occur in
    query or gold, as given.  Blank query -> failure."""
    def call(r: dict) -> str:
        q = r.get("query_text")
        if q is None or not q.strip():
            raise ValueError("empty query")
        neg = set(_toks(r.get("hard_negative")))
        ctx = set(_toks(q)) | set(_toks(r.get("gold_passage")))
        if not neg:
            return "no idea"
        return str(math.floor(100.0 * len(neg & ctx) / len(neg) + 0.5))
    return call


def pair_judge(threshold: float = 0.3) -> Model:
    """CLASSIFICATION/CONFIDENCE reply from the share of the negative's
    distinct tokens found in the query; empty negative -> empty reply."""
    def factory():
        def call(r: dict) -> str:
            neg = set(_toks(r.get("negative")))
            if not neg:
                return ""
            share = len(neg & set(_toks(r.get("query")))) / len(neg)
            label = "HARD" if share >= threshold else "REGULAR"
            return f"CLASSIFICATION: {label}\nCONFIDENCE: {share:.2f}\nREASON: token overlap"
        return call
    return factory


def list_generator(n: int = 3, most: int | None = None) -> Model:
    """Numbered reply built from the first ``n`` lines of the positive, after
    a one-line preamble (which the parser keeps as item 1).  A positive of
    over ``most`` characters is more than it takes: that call fails."""
    def factory():
        def call(r: dict) -> str:
            if most is not None and len(r.get("gold_passage") or "") > most:
                raise ValueError("positive too long")
            lines = (r.get("gold_passage") or "").split("\n")[:n]
            return "Here are the passages:\n" + "\n".join(f"{i + 1}. {t}" for i, t in enumerate(lines))
        return call
    return factory


def context_scorer() -> Callable[[dict], str]:
    """Hardness 0-100 = share of the negative's distinct tokens occurring in
    the query or its retrieved contexts."""
    def call(r: dict) -> str:
        neg = set(_toks(r.get("hard_negative")))
        if not neg:
            return "50"
        ctx = set(_toks(r.get("query_text")))
        for c in (r.get("contexts") if r.get("contexts") is not None else []):
            ctx |= set(_toks(c))
        return str(math.floor(100.0 * len(neg & ctx) / len(neg) + 0.5))
    return call


# --- jobs --------------------------------------------------------------------------------

def _cut(df: DataFrame, cuts: dict) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the model's cut fields as further columns, and the names of
    all; a field without a cut (None) is its own column, not a copy."""
    made = {f"_rs_{c}": v for c, v in cuts.items() if v is not None}
    return df.withColumns(made), {c: f"_rs_{c}" if v is not None else c for c, v in cuts.items()}


def _upto(col: str, width: int | None):
    return None if width is None else X.truncate_text(col, width)


def grade_negatives(df: DataFrame, model: Model = overlap_grader, retries: int = 3,
                    extended: bool = False, keep_status: bool = False,
                    widths: dict[str, int | None] | None = X.GRADE_WIDTHS) -> DataFrame:
    """Triplets -> classified triplets (``llm_classification`` HARD / EASY /
    UNKNOWN, ``is_hard``, ``hardness_score``).  The prompt and the model's
    fields have ``widths`` characters of each text (None: the whole text)."""
    widths = widths or dict.fromkeys(X.GRADE_WIDTHS)
    p = df.withColumn("prompt", X.grading_prompt("query_text", "gold_passage", "hard_negative", widths))
    p, fields = _cut(p, {"query_text": _upto("query_text", widths["query"]), "gold_passage": _upto("gold_passage", widths["gold"]),
                         "hard_negative": _upto("hard_negative", widths["negative"])})
    r = call_model(p, model, {"prompt": "prompt", **fields}, retries)
    score = X.parse_hardness("reply", extended=extended)
    label, is_hard, hs = X.hardness_label(score, F.col("success"))
    out = r.withColumn("llm_classification", label).withColumn("is_hard", is_hard) \
        .withColumn("hardness_score", hs)
    keep = [*df.columns, "llm_classification", "is_hard", "hardness_score"]
    return out.select(*keep, "success", "error") if keep_status else out.select(*keep)


def grade_batch(df: DataFrame, order: Sequence, limit: int | None = None, on_error: str = "keep",
                model: Model = overlap_grader, retries: int = 3,
                widths: dict[str, int | None] | None = X.GRADE_WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Grade the first ``limit`` rows (explicit order) or all; failed rows
    are kept as UNKNOWN (``keep``) or dropped (``drop``).  Returns
    ``(graded, errors)``; ``errors`` holds the failed rows with messages.  The
    model is called once: both frames read what that pass wrote."""
    src = df.orderBy(*order).limit(limit) if limit is not None else df
    done = split_pass(grade_negatives(src, model, retries, keep_status=True, widths=widths))
    graded = done.replies if on_error == "drop" else done.replies.unionByName(done.dead_letters)
    return graded, done.dead_letters


def negative_column(columns: Sequence[str]) -> str | None:
    """The negative-passage column: the first known name that is there, else
    the first column that speaks of a negative."""
    known = [name for name in NEGATIVE_COLUMNS if name in set(columns)]
    return next(iter(known + [c for c in columns if "neg" in c.casefold()]), None)


def grade_pairs(df: DataFrame, query: str = "query", negative: str = "negative",
                model: Model = pair_judge(), strict: bool = False) -> DataFrame:
    """(query, negative) rows -> ``is_hard_negative``, ``confidence``,
    ``error`` (+ ``raw_response``)."""
    p = df.withColumn("prompt", X.pair_prompt(query, negative))
    inp = p.withColumn("query", F.col(query)).withColumn("negative", F.col(negative)) \
        if (query, negative) != ("query", "negative") else p
    r = call_model(inp, model, ["prompt", "query", "negative"])
    hard, conf, err = X.parse_pair_verdict(F.col("reply"), strict=strict)
    err = F.coalesce(F.col("error"), err)
    return r.select(*df.columns, F.when(F.col("success"), hard).otherwise(F.lit(False)).alias("is_hard_negative"),
                    F.when(F.col("success"), conf).otherwise(F.lit(0.0)).alias("confidence"),
                    err.alias("error"), F.col("reply").alias("raw_response"))


def grade_pairs_partial(df: DataFrame, sample_limit: int, order: Sequence,
                        model: Model = pair_judge(), negative: str | None = None) -> DataFrame:
    """Grade the first ``sample_limit`` rows (explicit order) into
    ``llm_classification`` hard / regular / unknown with
    ``llm_confidence``; the remaining rows are ``unknown`` / 0.0.  Rows with
    an empty query or negative are ``unknown`` without a model call.  Without
    a negative column (``negative``, or one found by name) ``df`` comes back
    unchanged."""
    neg = negative or negative_column(df.columns)
    if neg not in df.columns:
        return df
    qcol = "query_text" if "query_text" in df.columns else "query"
    parts = flag_first(df, sample_limit, order, "_in_head")
    head, rest = (parts.filter(F.col("_in_head") == side).drop("_in_head") for side in (True, False))
    missing = (F.coalesce(F.col(qcol), F.lit("")) == "") | (F.coalesce(F.col(neg), F.lit("")) == "")
    todo = head.filter(~missing)
    graded = grade_pairs(todo, qcol, neg, model).select(
        *df.columns,
        F.when(F.col("error").isNotNull(), F.lit("unknown"))
         .when(F.col("is_hard_negative"), F.lit("hard")).otherwise(F.lit("regular")).alias("llm_classification"),
        F.when(F.col("error").isNotNull(), F.lit(0.0)).otherwise(F.col("confidence")).alias("llm_confidence"))
    skipped = head.filter(missing).select(*df.columns, F.lit("unknown").alias("llm_classification"),
                                          F.lit(None).cast("double").alias("llm_confidence"))
    others = rest.select(*df.columns, F.lit("unknown").alias("llm_classification"),
                         F.lit(0.0).alias("llm_confidence"))
    return graded.unionByName(skipped).unionByName(others)


def _generation_calls(df: DataFrame, n: int, model: Model | None) -> DataFrame:
    p = df.withColumn("prompt", X.generation_prompt("query_text", "gold_passage", n))
    return call_model(p, model or list_generator(n), ["prompt", "query_text", "gold_passage"])


def _parsed(df: DataFrame, replies: DataFrame, n: int, fallback_chars: int | None, drop_preamble: bool) -> DataFrame:
    items = X.parse_numbered_list("reply", n, fallback_chars, drop_preamble)
    return replies.select(*[c for c in df.columns if c != "hard_negative"], F.posexplode(items).alias("_pos", "hard_negative")) \
        .withColumn("negative_num", (F.col("_pos") + 1).cast("int")).drop("_pos")


def generate_negatives(df: DataFrame, n: int = 3, model: Model | None = None,
                       fallback_chars: int | None = None, drop_preamble: bool = False) -> DataFrame:
    """One row per generated negative: triplet + ``negative_num`` (1-based).
    Failed calls produce no rows; ``generation_pass`` keeps them."""
    return _parsed(df, _generation_calls(df, n, model).filter("success"), n, fallback_chars, drop_preamble)


def generation_pass(df: DataFrame, n: int = 3, model: Model | None = None, fallback_chars: int | None = None,
                    path: str | None = None, drop_preamble: bool = False) -> tuple[DataFrame, ModelPass]:
    """``generate_negatives`` with its model pass, whose dead letters are the
    rows without negatives: the model is called once for both."""
    done = split_pass(_generation_calls(df, n, model), path)
    return _parsed(df, done.replies, n, fallback_chars, drop_preamble), done


def generation_report(df: DataFrame, n: int = 3, model: Model | None = None) -> DataFrame:
    """One row: calls, failed calls, and one of their error messages."""
    return generation_pass(df, n, model)[1].report()


def assemble_final(hard: DataFrame, generated: DataFrame, keep_extra: bool = False) -> DataFrame:
    """Hard classified triplets followed by generated ones (no dedup)."""
    cols = ["query_text", "gold_passage", "hard_negative"]
    if keep_extra:
        return hard.unionByName(generated, allowMissingColumns=True)
    return hard.select(*cols).unionByName(generated.select(*cols))


def score_with_context(df: DataFrame, model: Model = context_scorer,
                       widths: dict[str, int | None] | None = CONTEXT_WIDTHS) -> DataFrame:
    """Rows with a ``contexts`` array -> ``rag_score`` from the context
    prompt (number reply, else 0.5; failed call 0.5).  The prompt and the
    model's fields have ``widths`` characters of each text (None: the whole
    text); the query is always whole."""
    widths = widths or dict.fromkeys(CONTEXT_WIDTHS)
    p = df.withColumn("prompt", X.context_prompt("query_text", "gold_passage", "hard_negative", "contexts",
                                                 widths["passage"], widths["gold"]))
    short = None if widths["passage"] is None else F.transform("contexts", lambda c: X.truncate_text(c, widths["passage"]))
    p, fields = _cut(p, {"gold_passage": _upto("gold_passage", widths["gold"]),
                         "hard_negative": _upto("hard_negative", widths["gold"]), "contexts": short})
    r = call_model(p, model, {"prompt": "prompt", "query_text": "query_text", **fields})
    return r.select(*df.columns, F.when(F.col("success"), X.parse_score_strict("reply"))
                    .otherwise(F.lit(0.5)).alias("rag_score"))


def score_dedup_by_key(df: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                       key: str = "cache_key", width: int | None = None) -> DataFrame:
    """Score each cache key once and give every row its key's score.

    The representative row of a key is its smallest full triplet (a
    deterministic ``min_by``); ``scorer`` maps those rows to ``rag_score``.
    Adds ``key_rows`` (rows sharing the key).  The key covers whole texts, or
    ``width`` characters of each."""
    k = df.withColumn(key, X.score_cache_key("query_text", "gold_passage", "hard_negative", width))
    trip = F.struct("query_text", "gold_passage", "hard_negative")
    reps = k.groupBy(key).agg(F.min(trip).alias("t"), F.count(F.lit(1)).alias("key_rows")) \
        .select(key, "key_rows", "t.*")
    scored = scorer(reps).select(key, "key_rows", "rag_score")
    return k.drop("rag_score").join(scored, key)


def grader_accuracy(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Per expected category: correct / incorrect; plus an ``ALL`` row with
    accuracy % and the verdict band (>= 87.5 excellent, >= 75 good,
    >= 62.5 fair, else poor)."""
    ok = F.col(expected) == F.col(predicted)
    per = df.groupBy(expected).agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))
    tot = df.agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect")) \
        .withColumn(expected, F.lit("ALL"))
    both = per.unionByName(tot.select(expected, "correct", "incorrect"))
    acc = F.try_divide(F.col("correct") * F.lit(100.0), (F.col("correct") + F.col("incorrect")).cast("double"))
    band = F.when(acc >= 87.5, "EXCELLENT").when(acc >= 75, "GOOD").when(acc >= 62.5, "FAIR").otherwise("POOR")
    return both.withColumn("accuracy_pct", acc).withColumn("verdict", band)
