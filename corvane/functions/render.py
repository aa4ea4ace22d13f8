"""Renderings of units, states, actions and packages for models and judges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the templates.
META = "[EVIDENCE_META] id={} path={} type={} symbol={} lines={}-{}"
HEADS = ("[QUESTION]\n", "\n\n[CURRENT EVIDENCE METADATA]\n", "\n\n[CURRENT EVIDENCE BODY]\n", "\n\n[CANDIDATE ACTION]\n")
EMPTY, NONE, STOP, BODY = "[EMPTY]", "[NONE]", "[STOP]", "[STATE BODY] evidence_id="
RULE = "\n\n---\n\n"
PACKAGE = ("证据 ID：", "\n位置：", "\n类型：", "\n")
PLAN = ("Evidence ID：", "\n位置：", "\n类型：", "\n符号：", "\n", "[正文因 Planner 上下文预算省略]")


def _text(c: Column, null: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null))


def _joined(parts: Column, by: str, empty: str) -> Column:
    return F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) > 0, F.array_join(parts, by)).otherwise(F.lit(empty))


def unit(u: Column) -> Column:
    """A unit (struct with path, unit_type, start_line, end_line, symbol, content) with its header; no line for a missing
    or empty symbol."""
    symbol = F.when(_text(u["symbol"]) != "", F.concat(F.lit("\n[SYMBOL] "), u["symbol"])).otherwise("")
    return F.concat(F.lit("[PATH] "), _text(u["path"]), F.lit("\n[TYPE] "), _text(u["unit_type"]), F.lit("\n[LINES] "), _text(u["start_line"]), F.lit("-"), _text(u["end_line"]), symbol, F.lit("\n[CONTENT]\n"), _text(u["content"]))


def metadata(u: Column) -> Column:
    """One line on a unit of a state; missing values show as None."""
    words = META.split("{}")
    fields = ("evidence_id", "path", "unit_type", "symbol", "start_line", "end_line")
    return F.concat(*(x for w, f in zip(words, fields) for x in (F.lit(w), _text(u[f], "None"))))


def action(question: Column, held: Column, body_ids: Column, candidates: Column) -> Column:
    """The input of a scorer: question, metadata of all that is held, the bodies that the budget leaves, and the action's
    units, none for STOP. held and candidates are arrays of units in order."""
    bodies = F.transform(F.filter(held, lambda u: F.array_contains(body_ids, u["evidence_id"])), lambda u: F.concat(F.lit(BODY), u["evidence_id"], F.lit("\n"), _text(u["content"])))
    parts = (_text(question), _joined(F.transform(held, metadata), "\n", EMPTY), _joined(bodies, "\n\n", NONE), _joined(F.transform(candidates, unit), "\n\n", STOP))
    return F.concat(*(x for h, p in zip(HEADS, parts) for x in (F.lit(h), p)))


def state(held: Column, body_ids: Column) -> Column:
    """What a planner sees: every unit with place, type and name, and its body or a note that it was left out."""

    def one(u):
        name = F.coalesce(F.nullif(u["qualified_name"], F.lit("")), _text(u["symbol"]))
        body = F.when(F.array_contains(body_ids, u["evidence_id"]), _text(u["content"])).otherwise(PLAN[5])
        place = F.concat(_text(u["path"]), F.lit(":"), _text(u["start_line"]), F.lit("-"), _text(u["end_line"]))
        return F.concat(*(x for w, p in zip(PLAN, (u["evidence_id"], place, _text(u["unit_type"]), name, body)) for x in (F.lit(w), p)))

    return _joined(F.transform(held, one), RULE, EMPTY)


def package(units: Column) -> Column:
    """What a judge sees: every unit with place, type and body. An empty package is an empty text."""

    def one(u):
        place = F.concat(_text(u["path"]), F.lit(":"), _text(u["start_line"]), F.lit("-"), _text(u["end_line"]))
        return F.concat(*(x for w, p in zip(PACKAGE, (u["evidence_id"], place, _text(u["unit_type"]), _text(u["content"]))) for x in (F.lit(w), p)))

    return _joined(F.transform(units, one), RULE, "")
