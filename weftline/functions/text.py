"""Source text and model answers: citations, JSON answers, suspicious comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comment patterns that read like orders to a model, and why.
INJECTION = [
    (r"(?i)//\s*(ignore|disregard|forget)\b[^\n]{0,80}(instruction|prompt|above|previous)", "comment asks to ignore prior instructions"),
    (r"(?i)//\s*(you are|act as|system\s*:|assistant\s*:)", "comment role-plays as system/assistant"),
    (r"(?i)//\s*(always|never)\s+(output|return|respond|emit)\b", "comment dictates model output"),
    (r"(?i)/\*\s*(ignore|disregard|forget)\b[\s\S]{0,120}?\*/", "block comment asks to ignore instructions"),
    (r"(?i)//\s*IMPORTANT\s*:.*\b(do not|don't)\s+(follow|obey|use)\b", "comment overrides analysis instructions"),
]


def scan_patterns(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]], width: int = 100) -> DataFrame:
    """key, why and excerpt: the first match of each pattern in each text, white space squeezed. One pass over the texts."""
    found = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(why).alias("why"), F.regexp_extract(text, p, 0).alias("m")) for i, (p, why) in enumerate(patterns)])
    hits = texts.select(key, F.explode(F.filter(found, lambda h: h["m"] != "")).alias("h"))
    return hits.select(key, "h.pos", "h.why", F.substring(F.trim(F.regexp_replace("h.m", r"\s+", " ")), 1, width).alias("excerpt"))


def injections(texts: DataFrame, key: str, text: str) -> DataFrame:
    return scan_patterns(texts, key, text, INJECTION)


def injection_diagnostics(found: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    return found.select(*(by or []), F.concat(F.lit("prompt-injection-risk "), F.col(key), F.lit(": "), "why", F.lit(" — "), "excerpt").alias("text"))


def quotes_real_code(evidence: Column, text: Column, least: int = 6) -> Column:
    """Whether a quoted or back-ticked fragment of enough characters occurs in the text; apostrophes quote apart from the others."""
    parts = [F.regexp_extract_all(evidence, F.lit(p % least), F.lit(1)) for p in (r"[`\"]([^`\"]{%d,})[`\"]", r"'([^']{%d,})'")]
    return F.exists(F.concat(*parts), lambda p: F.contains(text, p))


def cites_lines(evidence: Column, text: Column) -> Column:
    """Whether it names lines, each of which the text has, whatever they say."""
    lines = F.regexp_extract_all(evidence, F.lit(r"(?i)\bline\s+(\d+)"), F.lit(1))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.try_cast("int").between(F.lit(1), n))


def verified_citation(evidence: Column, text: Column) -> Column:
    return F.coalesce(quotes_real_code(evidence, text) | cites_lines(evidence, text), F.lit(False))


def json_answer(raw: Column) -> Column:
    """The JSON of an answer: inside a fence, else the whole, else from the first to the last brace."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull(), c) for c in (F.trim(fenced), F.trim(raw), braces)])


def agrees(answer: Column) -> Column:
    """The agree flag of a judge's answer, true only for a JSON true or the text true or yes."""
    return F.coalesce(F.lower(F.get_json_object(json_answer(answer), "$.agree")).isin("true", "yes"), F.lit(False))


def judge_outcome(agree: Column, cited: Column, has_fix: Column) -> Column:
    """What a verdict leads to."""
    return F.when(agree & cited & has_fix, "corrected").when(agree & cited, "invalid").when(~agree, "confirmed").otherwise("unverifiable")


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1) and text of every line."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


def words_in(text: Column, needle: Column) -> Column:
    """Loose presence: the text holds the needle, or its last dotted part of at least two characters, in any case."""
    t, n = F.lower(text), F.lower(needle)
    last = F.substring_index(n, ".", -1)
    return F.coalesce((n == "") | F.contains(t, n) | (F.length(last) >= 2) & F.contains(t, last), F.lit(False))


#: A call by a bare name, also through ``this``; what stands before it is looked at and not taken, so calls within calls are found.
BARE_CALL = r"(?<![\w.])(?:this\.)?([a-z]\w*)\s*\("


def called_names(code: Column) -> Column:
    """Bare names that are called, however deep."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(BARE_CALL), F.lit(1)))


def calls(code: Column) -> Column:
    """Array of (name, depth) of the bare calls in order; the depth counts the parentheses around a call."""
    tokens = F.regexp_extract_all(code, F.lit(BARE_CALL + r"|[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<name: string, depth: int>>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        name = F.regexp_extract(token, r"(\w+)\s*\($", 1)
        found = F.when(name != "", F.concat(state["found"], F.array(F.struct(name.alias("name"), state["depth"].alias("depth"))))).otherwise(state["found"])
        return F.struct(F.greatest(F.lit(0), state["depth"] + F.when(token == ")", -1).otherwise(1)).alias("depth"), found.alias("found"))

    return F.aggregate(tokens, start, step, lambda state: state["found"])


def qualified_calls(code: Column) -> Column:
    """Class.method calls, however deep."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?<![\w.])([A-Z]\w*\.\w+)\s*\("), F.lit(1)))


def identifiers(code: Column) -> Column:
    """Names that don't follow a dot."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?:^|[^\w.])([A-Za-z_]\w*)"), F.lit(1)))


#: Steps of an answer's pipeline.
ANSWER_STEPS = "array<struct<kind: string, sourceField: string, condition: string, op: string, value: string, targetField: string, summary: string>>"


def field_answer(raw: Column) -> Column:
    """A model's answer about a field as (recognised, target_field, pipeline, reason); null where it is no JSON object.

    Kinds and operations are lower-cased, summaries trimmed and blank ones left out. A pipeline that is no list is null, and so
    are a target field and a reason that are no text. Recognised is what a script would take for true: a JSON false, 0, null,
    an empty text or nothing is false.
    """
    body = json_answer(raw)
    typed = F.from_json(body, "recognized string, pipeline string, targetField string, reason string")
    quoted = lambda name: F.when(F.regexp(body, F.lit(rf'"{name}"\s*:\s*"')), F.get_json_object(body, f"$.{name}"))
    steps = F.from_json(F.when(F.startswith(F.trim(typed["pipeline"]), F.lit("[")), typed["pipeline"]), ANSWER_STEPS)
    clean = F.transform(steps, lambda s: s.withField("kind", F.lower(F.coalesce(s["kind"], F.lit("")))).withField("op", F.lower(s["op"])).withField("summary", F.nullif(F.trim(s["summary"]), F.lit(""))))
    known = F.coalesce(~typed["recognized"].isin("false", "0", "", "null"), F.lit(False))
    answer = F.struct(known.alias("recognised"), quoted("targetField").alias("target_field"), clean.alias("pipeline"), quoted("reason").alias("reason"))
    return F.when(F.startswith(F.trim(body), F.lit("{")), answer)


def statement_offset(source: Column, statement: Column) -> Column:
    """Where a statement begins in its source, from 0: as it stands, or else its first line; null if neither occurs."""
    place = lambda t: F.nullif(F.position(t, source), F.lit(0)) - 1
    return F.coalesce(place(statement), place(F.substring_index(statement, "\n", 1)))
