"""SQL of the operators that SQL can express."""

from __future__ import annotations


def crc_table() -> list[int]:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, folded over the list of its bytes."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda s, b: xor(s >> 8, {crc_table()}[(xor(s, b) & 255) + 1])), 4294967295)"


def _draw(i: int) -> str:
    return f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"


FILL_MIDDLE = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
         e AS (SELECT *, len(u) AS n, {_draw(0)} % (len(u) + 1) AS a, {_draw(1)} % (len(u) + 1) AS b FROM d),
         f AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
                      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(2)} % 100 >= 90 THEN 'plain' WHEN {_draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM f
"""

SHARDS = f"""
    WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
         o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
         s AS (SELECT *, least((2 * before + size) * 40 // (2 * total), 39)::INTEGER AS shard FROM o)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM s
"""


def _grown(value: str, cost: str, letter: str, line: str | None) -> str:
    """A path with one edit before it; ``line`` is what the edit writes."""
    return f"{{'c': {value}.c + {cost}, 'a': '{letter}' || {value}.a, 'o': {f'chr(10) || {line} || ' if line else ''}{value}.o}}"


def _options(state: int) -> str:
    """The least of the edits of a row in a state: deletion, another role, keeping it."""
    following = {0: ("v2", "user"), 1: ("v2", "user"), 2: ("v3", "assistant"), 3: ("v2", "user")}[state]
    kept = {0: (("s", "v1"), ("u", "v2")), 1: (("u", "v2"),), 2: (("a", "v3"),), 3: (("u", "v2"),)}[state]
    own = [_grown(f"v{state}", "3", "D", None), f"CASE WHEN free THEN {_grown(following[0], '2 + extra', 'R', chr(39) + following[1] + ':' + chr(39) + ' || text')} END"]
    own += [f"CASE WHEN free AND head = '{head}' THEN {_grown(value, 'extra', 'K', 'role || ' + chr(39) + ':' + chr(39) + ' || text')} END" for head, value in kept]
    return f"list_min([{', '.join(own)}]) AS w{state}"


_USER, _ASSISTANT = "'user:'", "'assistant:'"

CONVERSATIONS = f"""
    WITH RECURSIVE
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
    m AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE d <> 0),
    o AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS head, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM m),
    f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(head) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM o),
    g AS (SELECT conv_id, i, role, text, head, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra FROM f),
    w AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (past || head NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    z AS (SELECT {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS done),
    y AS (SELECT done, {_grown('done', '2', 'I', _ASSISTANT)} AS half FROM z),
    p AS (
        SELECT conv_id, n AS i, done AS v0, {_grown('half', '2', 'I', _USER)} AS v1, half AS v2, done AS v3 FROM w, y
        UNION ALL
        SELECT conv_id, i - 1, list_min([w0, {_grown("x2", "2", "I", _USER)}]), list_min([w1, {_grown('x2', '2', 'I', _USER)}]), x2, list_min([w3, {_grown('w2', '2', 'I', _USER)}])
        FROM (SELECT *, list_min([w2, {_grown('w3', '2', 'I', _ASSISTANT)}]) AS x2 FROM (
            SELECT p.conv_id, p.i, {', '.join(_options(s) for s in range(4))} FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i)))
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
           coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(substr(coalesce(v0.o, ''), 2)) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 0
"""
