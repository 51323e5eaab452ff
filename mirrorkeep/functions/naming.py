"""Rename rules between source and destination names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks inside core names (before the replica number) and node
# names (after host and port), and the key of the rule for all other names.
REPLICA_MARK = "_replica"
NODE_CONTEXT = "_solr"
DEFAULT_RULE = "default"


@dataclass(frozen=True)
class Rules:
    """Ordered (left, right) pairs and the text under ``default``, if any."""

    pairs: tuple[tuple[str, str], ...] = ()
    default: str | None = None


def parse_rules(text: str | None) -> Rules:
    """Read ``"left:right,left:right,default:text"``; blank text means no rules."""
    if text is None or not text.strip():
        return Rules()
    pairs, default = [], None
    for part in text.split(","):
        left, colon, right = part.partition(":")
        if not colon or not left or not right or ":" in right:
            raise ValueError(f"bad rule {part!r} in {text!r}: expected <match>:<replacement>")
        if left.lower() == DEFAULT_RULE:
            default = right
        else:
            pairs.append((left, right))
    return Rules(tuple(pairs), default)


def _first_rule(name: Column, cases: list[tuple[str, Column]], otherwise: Column) -> Column:
    """The value of the first case whose text is contained in the name."""
    if not cases:
        return otherwise
    out = None
    for match, value in cases:
        hit = name.contains(match)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def map_forward(name: Column, rules: Rules) -> Column:
    """Source name to destination name; without a default a name no rule hits stays."""
    cases = [(a, F.replace(name, F.lit(a), F.lit(b))) for a, b in rules.pairs]
    rest = F.concat(name, F.lit(rules.default)) if rules.default else name
    return _first_rule(name, cases, rest)


def map_reverse(name: Column, rules: Rules) -> Column:
    """Destination name back to source name; the default text is removed wherever it occurs."""
    cases = [(b, F.replace(name, F.lit(b), F.lit(a))) for a, b in rules.pairs]
    rest = F.replace(name, F.lit(rules.default), F.lit("")) if rules.default else name
    return _first_rule(name, cases, rest)


def map_config(name: Column, rules: Rules, own: Column | None = None) -> Column:
    """Configuration of a collection: its own without rules, else by the first rule hit."""
    if not rules.pairs and not rules.default:
        if own is None:
            raise ValueError("no configuration rules given and no configuration column either")
        return own
    cases = [(a, F.lit(b)) for a, b in rules.pairs]
    return _first_rule(name, cases, F.lit(rules.default))


def shard_key(core: Column) -> Column:
    """Core name up to its replica suffix."""
    return F.split_part(core, F.lit(REPLICA_MARK), F.lit(1))


def node_name(full: Column) -> Column:
    """Host out of ``host:port_context``."""
    address = F.split_part(full, F.lit(NODE_CONTEXT), F.lit(1))
    return F.split_part(address, F.lit(":"), F.lit(1))


def replica_number(core: Column) -> Column:
    """Number at the end of a core name, null if there is none."""
    return F.regexp_extract(core, REPLICA_MARK + r"(\d+)$", 1).try_cast("int")
