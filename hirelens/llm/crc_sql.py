"""CRC-32 in SQL for engines without such a function: one byte a step over a table made from the polynomial."""

#: Common table expressions (the statement needs WITH RECURSIVE) that `crc32_sql` reads.
CRC_TABLE = """crc_bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
 SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text; the query has to join `crc_table`."""
    steps = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])))"
