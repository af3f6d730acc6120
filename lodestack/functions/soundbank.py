"""What the packed numbers of sound bank objects say, by version, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes of an event action by number; 4 exists before version 125 alone.
MODES = {0: "none", 1: "one", 2: "all", 4: "all_except"}


def action_scope(packed: Column) -> Column:
    return F.when(packed.bitwiseAND(1) == 0, "global").otherwise("game_object")


def action_mode(packed: Column, version: Column) -> Column:
    mode = F.shiftright(packed.cast("int"), 1).bitwiseAND(F.when(version < 125, 7).otherwise(3))
    out = F.lit("none")
    for n, name in MODES.items():
        out = F.when(mode == n, name).otherwise(out)
    return out


def with_action_mode(packed: Column, version: Column, mode: str) -> Column:
    """The number with another mode; ``all_except`` fails from version 125 on."""
    number = next(n for n, name in MODES.items() if name == mode)
    kept = packed.cast("int").bitwiseAND(F.when(version < 125, ~0x0E).otherwise(~0x06))
    value = kept.bitwiseOR(number << 1)
    return F.when(version >= 125, F.raise_error(F.lit("all_except ended with version 124")).cast("int")).otherwise(value) if mode == "all_except" else value
