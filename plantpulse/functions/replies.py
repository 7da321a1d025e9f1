"""Free-text explanations to structured columns: fenced, embedded, broken and plain replies, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
PARTIAL_NOTE = "A resposta da IA veio parcialmente fora do formato esperado; o sistema recuperou os trechos uteis."
PLAIN_NOTE = "A resposta da IA veio fora do formato JSON esperado; o sistema exibiu a leitura em modo texto seguro."
PLAIN_ACTION = "Validar este alerta junto das regras, tendencias e prescricao deterministica do sistema."
PARTIAL_SUMMARY = "A IA retornou uma leitura parcial."
PARTIAL_ENDING = ". Leitura parcial recuperada da IA."
NOTHING_USABLE = "A IA respondeu, mas nao retornou um texto aproveitavel."
RISKS = ["low", "medium", "high"]
DEFAULT_RISK, SALVAGED_CONFIDENCE, PLAIN_CONFIDENCE = "medium", 0.45, 0.35
#: what a caller of a screen passes as limits; by default texts stay whole
FIELD_LIMIT, PLAIN_LIMIT, LONG_SUMMARY = 700, 900, 90
# --- end of fixed values ---

SCHEMA = (
    "summary string, insights array<string>, observations array<string>, false_positive_risk string, confidence double, "
    "hypotheses array<struct<causa: string, confianca: double, racional: string>>, recommended_actions array<string>"
)
_LISTS = ("insights", "observations", "recommended_actions")


def strip_fence(text: Column) -> Column:
    """Drop a leading fence line and a trailing one."""
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = trimmed.startswith("```")
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"\A```[^\n]*(\n|\z)", ""), r"(\A|\n)[ \t]*```[^\n]*\z", "")
    return F.when(fenced, F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(trimmed)


def cut_object(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL without both."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


def _strict(text: Column) -> Column:
    """A JSON object that has a summary; anything else is NULL. Optional parts get their defaults."""
    parsed = F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"})
    whole = text.startswith("{") & F.rtrim(text).endswith("}")
    listed = {c: F.coalesce(parsed[c], F.array().cast("array<string>")).alias(c) for c in _LISTS}
    return F.when(whole & parsed["summary"].isNotNull(), F.struct(
        parsed["summary"].alias("summary"), listed["insights"], listed["observations"],
        F.coalesce(parsed["false_positive_risk"], F.lit(DEFAULT_RISK)).alias("false_positive_risk"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["hypotheses"], F.from_json(F.lit("[]"), "array<struct<causa: string, confianca: double, racional: string>>")).alias("hypotheses"),
        listed["recommended_actions"]))


def _shortened(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def _tidy(text: Column, limit: int | None) -> Column:
    """One line, no surrounding spaces or commas, shortened if a limit is given; empty becomes NULL."""
    line = F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit(" ")), r"(?U)\s+", " ")
    bare = F.regexp_replace(line, r"^[ ,]+|[ ,]+$", "")
    return F.when(F.length(bare) > 0, _shortened(bare, limit))


def text_field(text: Column, name: str, limit: int | None = None) -> Column:
    """Value of a quoted field, closed or not; escapes are undone."""
    raw = F.regexp_extract(text, rf'(?s)"{name}"\s*:\s*"((?:\\.|[^"\\])*)', 1)
    return _tidy(F.regexp_replace(raw, r"(?s)\\(.)", "$1"), limit)


def list_field(text: Column, name: str, limit: int | None = None) -> Column:
    """Complete quoted items of a list, closed or not."""
    inside = F.regexp_extract(text, rf'(?s)"{name}"\s*:\s*\[([^\]]*)', 1)
    items = F.regexp_extract_all(inside, F.lit(r'(?s)"((?:\\.|[^"\\])*)"'), F.lit(1))
    return F.filter(F.transform(items, lambda item: _tidy(item, limit)), lambda t: t.isNotNull())


def number_field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'"{name}"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1).try_cast("double")


def choice_field(text: Column, name: str) -> Column:
    word = F.lower(F.trim(F.regexp_extract(text, rf'"{name}"\s*:\s*"([^"]+)"', 1)))
    return F.when(word.isin(RISKS), word).otherwise(F.lit(DEFAULT_RISK))


def distinct_texts(items: Column) -> Column:
    """Trimmed, without case-insensitive repeats, first spelling kept."""
    trimmed = F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    lowered = F.transform(trimmed, lambda t: F.lower(t))
    return F.filter(trimmed, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def _ended(summary: Column) -> Column:
    bare = F.regexp_replace(summary, r"[ ,;]+$", "")
    return (
        F.when(summary.rlike(r"[.!?]\z"), summary)
        .when(F.length(summary) >= LONG_SUMMARY, F.concat(bare, F.lit(PARTIAL_ENDING)))
        .otherwise(F.concat(bare, F.lit(".")))
    )


def salvage(text: Column, limit: int | None = None) -> Column:
    """Fields of a broken reply by pattern; NULL when none is found."""
    summary = text_field(text, "summary", limit)
    lists = {name: list_field(text, name, limit) for name in _LISTS}
    found = summary.isNotNull() | (F.size(lists["insights"]) > 0) | (F.size(lists["observations"]) > 0) | (F.size(lists["recommended_actions"]) > 0)
    number = number_field(text, "confidence")
    return F.when(found, F.struct(
        _ended(F.coalesce(summary, F.get(lists["insights"], 0), F.lit(PARTIAL_SUMMARY))).alias("summary"),
        distinct_texts(lists["insights"]).alias("insights"),
        distinct_texts(F.concat(lists["observations"], F.array(F.lit(PARTIAL_NOTE)))).alias("observations"),
        choice_field(text, "false_positive_risk").alias("false_positive_risk"),
        F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(F.lit(SALVAGED_CONFIDENCE)).alias("confidence"),
        F.from_json(F.lit("[]"), "array<struct<causa: string, confianca: double, racional: string>>").alias("hypotheses"),
        distinct_texts(lists["recommended_actions"]).alias("recommended_actions")))


def plain(text: Column, limit: int | None = None) -> Column:
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(F.length(line) > 0, _shortened(line, limit)).otherwise(F.lit(NOTHING_USABLE)).alias("summary"), none.alias("insights"),
        F.array(F.lit(PLAIN_NOTE)).alias("observations"), F.lit(DEFAULT_RISK).alias("false_positive_risk"),
        F.lit(PLAIN_CONFIDENCE).alias("confidence"),
        F.from_json(F.lit("[]"), "array<struct<causa: string, confianca: double, racional: string>>").alias("hypotheses"),
        F.array(F.lit(PLAIN_ACTION)).alias("recommended_actions"))


def classified_reply(text: Column, field_limit: int | None = None, plain_limit: int | None = None) -> Column:
    """The first reading that works, with its kind: the whole reply, the object inside it, salvaged fields, plain text."""
    bare = strip_fence(text)
    readings = {"whole": _strict(bare), "embedded": _strict(cut_object(bare)), "salvaged": salvage(bare, field_limit), "plain": plain(text, plain_limit)}
    return F.coalesce(*[F.when(found.isNotNull(), F.struct(F.lit(kind).alias("kind"), found.alias("reply"))) for kind, found in readings.items()])


def parse_reply(text: Column, field_limit: int | None = None, plain_limit: int | None = None) -> Column:
    return classified_reply(text, field_limit, plain_limit)["reply"]


def reply_kind(text: Column) -> Column:
    return classified_reply(text)["kind"]
