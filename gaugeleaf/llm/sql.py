"""SQL fragments of the operators' oracles."""

from __future__ import annotations

#: A row with t, the table of CRC-32 (reflected polynomial 0xEDB88320), computed bit by bit.
CRCS = """crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string; crcs is in the query's FROM."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295)"
