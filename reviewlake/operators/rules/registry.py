"""The rule extension point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleSpec:
    """A rule decided at one token of the structured token table.

    ``when`` picks the tokens; ``line`` is the line to report, which also has
    to be a changed one. ``repeat`` gives the number of findings per token and
    ``place`` the token position that orders the finding within its file. Every
    file with a finding contains ``word``, where one is named: a scan for such
    rules alone reads no other file.
    """

    rule: str
    severity: str
    message: Column | str
    when: Column
    line: Column
    place: Column | None = None
    repeat: Column | None = None
    word: str | None = None

    def text(self) -> Column:
        return F.lit(self.message) if isinstance(self.message, str) else self.message
