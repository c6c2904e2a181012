"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ferrule.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PARTS = r"regexp_extract_all(regexp_replace(i, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"


def tokens(text: str) -> str:
    """The tokenizer of ``functions.text``; RE2 has no lookahead, so words in capitals are cut by a replacement first."""
    return f"""flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda i:
      CASE WHEN len({_PARTS}) > 1 THEN list_concat([lower(i)], list_filter(list_transform({_PARTS}, lambda p: lower(p)), lambda p: p NOT IN ({_STOP})))
           WHEN lower(i) IN ({_STOP}) THEN [] ELSE [lower(i)] END))"""


def squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f\x0B]+', ' ', 'g'))"


LINES = """lines AS (SELECT doc_id, i AS line, ls[i] AS text, len(ls) AS n FROM
  (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""
