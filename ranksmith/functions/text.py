"""Column expressions over text.

Everything here returns a ``Column`` built from Spark built-ins, so it runs
inside whole-stage codegen; nothing is a Python UDF.  The regular expressions
stay in the subset that Java regex and RE2 (the DuckDB oracle) read the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The characters Python's ``str.isspace`` treats as whitespace
# (what ``str.strip()`` and ``str.split()`` use), written as one character
# class that Java regex and RE2 both accept.
# ---------------------------------------------------------------------------
WS = ("[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# A literal Python's ``float()`` accepts and Spark/DuckDB cast identically.
NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Unicode whitespace strip (Python ``str.strip``); plain ``trim`` only
    removes spaces."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def is_blank(c) -> Column:
    return strip_text(c) == F.lit("")


def tokenize(c) -> Column:
    """``text.lower().split()``: lower-case, split on whitespace runs, drop
    the empty pieces a leading/trailing run leaves."""
    return F.filter(F.split(F.lower(_c(c)), f"{WS}+"), lambda t: t != F.lit(""))


def char_length(c) -> Column:
    """Code-point length, as Python ``len``."""
    return F.length(_c(c)).cast("long")


def truncate_text(c, n: int | None) -> Column:
    """First ``n`` code points (Python ``s[:n]``); ``None``: the whole text."""
    return _c(c) if n is None else F.substring(_c(c), 1, n)


def title_concat(title, text) -> Column:
    """``title + " " + text``; null if either side is null (pandas ``+``)."""
    return F.concat(_c(title), F.lit(" "), _c(text))


def length_ratio(a, b) -> Column:
    """len(a) / len(b); null when len(b) is 0."""
    return F.try_divide(F.length(_c(a)).cast("double"), F.length(_c(b)).cast("double"))


def score_cache_key(q, g, n, width: int | None = None) -> Column:
    """md5 of ``q|g|n`` (hex), over whole texts.  With a ``width`` only that
    many characters of each count, and triplets that begin alike share a key."""
    return F.md5(F.concat_ws("|", truncate_text(q, width), truncate_text(g, width),
                             truncate_text(n, width)))


# ---------------------------------------------------------------------------
# Prompt texts sent to the grading / generating model.  They
# must stay byte-identical so that the same model gives the same answers.
# ---------------------------------------------------------------------------
GRADING_PROMPT = (
    "Rate the hardness of this negative passage for training (0-100).\n\n"
    "Query: {query}\n\n"
    "Gold Passage: {gold}\n\n"
    "Negative Passage: {negative}\n\n"
    "HARD negatives (70-100):\n"
    "- Topically related but factually different\n"
    "- Similar keywords but wrong answer\n"
    "- Requires understanding to distinguish\n\n"
    "EASY negatives (0-30):\n"
    "- Clearly unrelated topic\n"
    "- Different domain/keywords\n\n"
    "Provide ONLY a number from 0-100:"
)

GENERATION_PROMPT = (
    "Generate {n} HARD NEGATIVE passages for this query-passage pair.\n\n"
    "Query: {query}\n\n"
    "Correct Passage: {positive}\n\n"
    "Requirements:\n"
    "1. Topically related to query\n"
    "2. Similar keywords as correct passage\n"
    "3. BUT does NOT answer the query\n"
    "4. Each 50-150 words\n"
    "5. Diverse hard negatives\n\n"
    "Output ONLY passages, numbered 1., 2., 3.:"
)

CONTEXT_PROMPT = (
    "Rate hardness (0-100):\n\n"
    "{enhanced_query}\n\n"
    "Gold: {gold}\n"
    "Negative: {negative}\n\n"
    "HARD (70-100): Related but wrong answer\n"
    "EASY (0-30): Unrelated topic\n\n"
    "Number only:"
)

PAIR_PROMPT = (
    "\nAnalyze this query-passage pair for retrieval training:\n\n"
    "QUERY: \"{query}\"\n"
    "NEGATIVE PASSAGE: \"{negative}\"\n\n"
    "Determine if this negative passage is a \"hard negative\" or \"regular negative\":\n\n"
    "- HARD NEGATIVE: Semantically similar to the query topic but factually incorrect, "
    "misleading, or doesn't answer the query properly. These are challenging cases that "
    "help improve model discrimination.\n\n"
    "- REGULAR NEGATIVE: Clearly different topic, obviously irrelevant, or easy to "
    "distinguish from the query.\n\n"
    "Respond with ONLY:\n"
    "CLASSIFICATION: [HARD or REGULAR]\n"
    "CONFIDENCE: [0.0-1.0]\n"
    "REASON: [Brief explanation]\n"
)

# Truncation widths of the prompts (characters): the defaults of the prompt
# functions' ``width`` arguments, where None means the whole text.
GRADE_WIDTHS = {"query": 200, "gold": 300, "negative": 300}
GENERATION_POSITIVE_WIDTH = 200
CONTEXT_PASSAGE_WIDTH = 120
CONTEXT_GOLD_WIDTH = 200


def fill_template(template: str, **parts) -> Column:
    """Render ``template`` with column-valued ``{name}`` slots via ``concat``.

    ``concat`` keeps the template text literal (no ``%`` escaping issues) and
    is null if any slot is null, like a Python f-string raising on None.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(_c(parts[rest[start + 1:end]]).cast("string"))
        rest = rest[end + 1:]
    return F.concat(*pieces)


def grading_prompt(query, gold, negative, widths: dict[str, int | None] = GRADE_WIDTHS) -> Column:
    return fill_template(GRADING_PROMPT,
                         query=truncate_text(query, widths["query"]),
                         gold=truncate_text(gold, widths["gold"]),
                         negative=truncate_text(negative, widths["negative"]))


def generation_prompt(query, positive, n: int = 3, width: int | None = GENERATION_POSITIVE_WIDTH) -> Column:
    return fill_template(GENERATION_PROMPT, n=F.lit(str(n)), query=query,
                         positive=truncate_text(positive, width))


def context_bullets(contexts, width: int | None = CONTEXT_PASSAGE_WIDTH) -> Column:
    """One line ``• text`` per element of an array column, ``width``
    characters of each."""
    return F.array_join(
        F.transform(_c(contexts), lambda c: F.concat(F.lit("• "), truncate_text(c, width))), "\n")


def context_prompt(query, gold, negative, contexts, passage_width: int | None = CONTEXT_PASSAGE_WIDTH,
                   gold_width: int | None = CONTEXT_GOLD_WIDTH) -> Column:
    enhanced = F.concat(F.lit("Query: "), _c(query), F.lit("\n\nContext:\n"),
                        context_bullets(contexts, passage_width))
    return fill_template(CONTEXT_PROMPT, enhanced_query=enhanced,
                         gold=truncate_text(gold, gold_width),
                         negative=truncate_text(negative, gold_width))


def pair_prompt(query, negative) -> Column:
    return fill_template(PAIR_PROMPT, query=query, negative=negative)


# ---------------------------------------------------------------------------
# Response parsers
# ---------------------------------------------------------------------------

def _clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _strict_number(s: Column) -> Column:
    """The value of ``s`` if it is a plain decimal literal, else null."""
    return F.when(s.rlike(NUMBER), s.cast("double"))


# Score patterns tried in order, each (regex, divisor).
# ``(?i)`` mirrors re.IGNORECASE; [0-9] stands for \d.
SCORE_PATTERNS = [
    (f"([0-9]+){WS}*(?:OUT OF|/){WS}*100", 100.0),
    (f"([0-9]+){WS}*(?:OUT OF|/){WS}*10", 10.0),
    (f"(?i)SCORE[:{WS[1:-1]}]*([0-9]+\\.?[0-9]*)", 100.0),
]
EXTENDED_PATTERNS = [
    (f"([0-9]+\\.?[0-9]*){WS}*%", 100.0),
]
RATIO_PATTERN = f"([0-9]+\\.?[0-9]*){WS}*/{WS}*([0-9]+\\.?[0-9]*)"

# Keyword -> score, checked in this order with ``in``.
HARDNESS_KEYWORDS = [
    ("EXTREMELY HARD", 0.95),
    ("VERY HARD", 0.85),
    ("QUITE HARD", 0.75),
    ("HARD", 0.70),
    ("MODERATELY HARD", 0.60),
    ("SOMEWHAT HARD", 0.55),
    ("MEDIUM", 0.50),
    ("SOMEWHAT EASY", 0.40),
    ("MODERATELY EASY", 0.35),
    ("FAIRLY EASY", 0.30),
    ("EASY", 0.25),
    ("VERY EASY", 0.10),
    ("EXTREMELY EASY", 0.05),
    ("TRIVIAL", 0.02),
]


def _pattern_score(s: Column, pattern: str, divisor: float) -> Column:
    hit = s.rlike(pattern)
    return F.when(hit, F.regexp_extract(s, pattern, 1).cast("double") / F.lit(divisor))


def parse_hardness(response, extended: bool = False) -> Column:
    """Reply text -> hardness in [0, 1].

    A bare number counts as a percentage when above 1; otherwise ``n/100``,
    ``n out of 10``, ``score: n`` (and with ``extended``: ``n%``, ``a/b`` and
    the keyword table); anything else 0.5.  Null replies give 0.5.
    """
    s = F.upper(strip_text(F.coalesce(_c(response), F.lit(""))))
    bare = _strict_number(s)
    bare = F.when(bare > 1.0, bare / 100.0).otherwise(bare)
    candidates = [bare]
    candidates += [_pattern_score(s, p, d) for p, d in SCORE_PATTERNS]
    if extended:
        candidates += [_pattern_score(s, p, d) for p, d in EXTENDED_PATTERNS]
        num = F.regexp_extract(s, RATIO_PATTERN, 1).cast("double")
        den = F.regexp_extract(s, RATIO_PATTERN, 2).cast("double")
        candidates.append(F.when(s.rlike(RATIO_PATTERN) & (den > 0), num / den))
    score = F.coalesce(*candidates)
    clamped = F.when(score.isNotNull(), _clamp01(score))
    if extended:
        kw = None
        for word, value in HARDNESS_KEYWORDS:
            kw = (F.when(s.contains(word), F.lit(value)) if kw is None
                  else kw.when(s.contains(word), F.lit(value)))
        clamped = F.coalesce(clamped, kw)
    return F.coalesce(clamped, F.lit(0.5))


def parse_score_strict(response) -> Column:
    """Number only (percentage above 1), clamped; else 0.5."""
    s = strip_text(F.coalesce(_c(response), F.lit("")))
    v = _strict_number(s)
    v = F.when(v > 1.0, v / 100.0).otherwise(v)
    return F.coalesce(F.when(v.isNotNull(), _clamp01(v)), F.lit(0.5))


def hardness_label(score, success) -> tuple[Column, Column, Column]:
    """(classification, is_hard, hardness_score) from a parsed score and a
    success flag: HARD iff score > 0.5; failures UNKNOWN / null / 0.5."""
    ok = _c(success)
    sc = _c(score)
    is_hard = F.when(ok, sc > 0.5)
    label = F.when(~ok, F.lit("UNKNOWN")).when(sc > 0.5, F.lit("HARD")).otherwise(F.lit("EASY"))
    return label, is_hard, F.when(ok, sc).otherwise(F.lit(0.5))


def parse_pair_verdict(response, strict: bool = False) -> tuple[Column, Column, Column]:
    """(is_hard, confidence, error) for a CLASSIFICATION/CONFIDENCE reply.

    Hard iff the upper-cased reply contains ``HARD`` anywhere and
    ``CLASSIFICATION:``; ``strict`` reads only the CLASSIFICATION line.
    Confidence is the second ``:``-field of the first line holding
    ``CONFIDENCE:``, default 0.7.  Empty reply: not hard, 0.5, error.
    """
    r = _c(response)
    empty = r.isNull() | (r == F.lit(""))
    t = F.upper(r)
    if strict:
        cls_line = F.regexp_extract(t, "([^\\n]*CLASSIFICATION:[^\\n]*)", 1)
        hard = t.contains("CLASSIFICATION:") & F.split_part(cls_line, F.lit("CLASSIFICATION:"), F.lit(2)).contains("HARD")
    else:
        hard = t.contains("HARD") & t.contains("CLASSIFICATION:")
    conf_line = F.regexp_extract(t, "([^\\n]*CONFIDENCE:[^\\n]*)", 1)
    field = strip_text(F.split_part(conf_line, F.lit(":"), F.lit(2)))
    conf = F.coalesce(F.when(t.contains("CONFIDENCE:"), _strict_number(field)), F.lit(0.7))
    return (F.when(empty, F.lit(False)).otherwise(hard),
            F.when(empty, F.lit(0.5)).otherwise(conf),
            F.when(empty, F.lit("Empty response")))


def parse_numbered_list(text, n: int, fallback_chars: int | None = None, drop_preamble: bool = False) -> Column:
    """Reply -> array of at most ``n`` items.

    Lines are stripped; a line starting ``1.``..``9.`` opens a new item (its
    text after the first dot), other non-empty lines join the current item
    with a space.  Lines before the first number form an item of their own,
    or are left out with ``drop_preamble`` (a reply without numbers stays).
    Empty result: ``[]``, or ``[text[:fallback_chars]]`` when set.
    """
    lines = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), strip_text)
    if drop_preamble:
        first = F.array_position(F.transform(lines, lambda x: x.rlike("^[1-9]\\.")), True).cast("int")
        lines = F.when(first > 0, F.slice(lines, first, F.size(lines))).otherwise(lines)
    acc0 = F.struct(F.array().cast("array<string>").alias("items"),
                    F.lit(None).cast("string").alias("cur"))

    def step(acc, line):
        marker = (line != F.lit("")) & line.rlike("^[1-9]\\.")
        items = F.when(marker & acc["cur"].isNotNull(),
                       F.concat(acc["items"], F.array(acc["cur"]))).otherwise(acc["items"])
        cur = F.when(marker, F.lit(None).cast("string")).otherwise(acc["cur"])
        content = F.when(marker, strip_text(F.substring(line, 3, 1 << 30))).otherwise(line)
        cur = F.when(content == F.lit(""), cur).otherwise(
            F.when(cur.isNull(), content).otherwise(F.concat(cur, F.lit(" "), content)))
        return F.struct(items.alias("items"), cur.alias("cur"))

    def finish(acc):
        return F.when(acc["cur"].isNotNull(), F.concat(acc["items"], F.array(acc["cur"]))) \
            .otherwise(acc["items"])

    items = F.aggregate(lines, acc0, step, finish)
    out = F.slice(items, 1, n)
    if fallback_chars is not None:
        out = F.when(F.size(out) == 0, F.array(truncate_text(text, fallback_chars))).otherwise(out)
    return out
