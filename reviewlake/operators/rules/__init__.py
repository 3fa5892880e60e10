"""Source rules as predicates over the token table."""

from reviewlake.operators.rules.catalogue import default_rules
from reviewlake.operators.rules.registry import RuleSpec
from reviewlake.operators.rules.scan import gated, scan, second_lines

__all__ = ["default_rules", "RuleSpec", "gated", "scan", "second_lines"]
