"""Declarative checks and overlays of configuration-like rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """Limits of one column. Missing values pass unless `required`; value checks are skipped if `instead_of` is set."""

    column: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()
    needs: tuple[str, ...] = field(default=())
    instead_of: str | None = None


def _broken(rule: Rule) -> list[Column]:
    value = F.col(rule.column)
    present = value.isNotNull()
    checked = present & F.col(rule.instead_of).isNull() if rule.instead_of else present
    tests = [(rule.required, value.isNull(), "required")]
    tests += [(True, present & F.col(n).isNull(), f"needs {n}") for n in rule.needs]
    tests += [
        (rule.high is not None, checked & (value > rule.high), "above maximum"),
        (rule.low is not None, checked & (value < rule.low), "below minimum"),
        (bool(rule.allowed), checked & ~F.lower(value.cast("string")).isin(list(rule.allowed)), "not allowed"),
    ]
    label = lambda text: F.struct(F.lit(rule.column).alias("field"), F.lit(text).alias("problem"))
    return [F.when(broken, label(text)) for wanted, broken, text in tests if wanted]


def violations(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per key and broken rule, found in a single pass."""
    found = F.array_compact(F.array(*[c for rule in rules for c in _broken(rule)]))
    return rows.select(*keys, F.explode(found).alias("_v")).select(*keys, "_v.field", "_v.problem")


def overlay_map(base: str, new: str) -> Column:
    """Entries of `new` override those of `base`."""
    return F.expr(f"map_concat(map_filter({base}, (k, v) -> NOT map_contains_key({new}, k)), {new})")


def unknown_keys(base: str, new: str) -> Column:
    return F.expr(f"array_sort(array_except(map_keys({new}), map_keys({base})))")


def block_listed(words: DataFrame, blocked: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is not in the blocked table."""
    return words.join(blocked.select(word), word, "left_anti")
