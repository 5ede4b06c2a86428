"""What an answer cites, and texts without citations.

An answer may end with a marker, a colon and a JSON list of codes. Marker and form of a code are the caller's.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _behind(text: Column, marker: str) -> Column:
    """What stands behind the first marker and its colon on that line; null without one."""
    at = F.instr(text, marker + ":")
    line = F.substring_index(F.substr(text, at + len(marker) + 1), "\n", 1)
    return F.when(at > 0, F.trim(line))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def cited(text: Column, marker: str, code: str) -> Column:
    """The codes of the list behind the marker; without a list that parses, the distinct codes in bold, in order. `code`: a pattern with one group."""
    behind = _behind(text, marker)
    end = F.length(behind) - F.instr(F.reverse(behind), "]") + 1
    listed = F.when(F.substring(behind, 1, 1) == "[", F.from_json(F.substr(behind, F.lit(1), end), "array<string>"))
    return F.coalesce(listed, F.array_distinct(F.regexp_extract_all(text, F.lit(code), 1)))


def cleaned(text: Column, marker: str) -> Column:
    """Without the first marker and its list."""
    at = F.instr(text, marker + ":")
    behind = _behind(text, marker)
    rest = F.substr(text, at + F.length(F.substring_index(F.substr(text, at), "\n", 1)))
    before = F.regexp_replace(F.substr(text, F.lit(1), at - 1), "\n\\z", "")
    return _stripped(F.when((at > 0) & (F.substring(behind, 1, 1) == "[") & F.contains(behind, F.lit("]")), F.concat(before, rest)).otherwise(text))


def sanitised(query: Column, marker: str) -> Column:
    """Without any list that a marker, in either case, announces: a query can't plant citations."""
    pieces = F.split(query, rf"(?i){marker}[ ]*:[ ]*\[")
    kept = F.transform(pieces, lambda p, i: F.when((i > 0) & F.contains(p, F.lit("]")), F.substr(p, F.instr(p, "]") + 1)).otherwise(p))
    return _stripped(F.array_join(kept, ""))
