"""The same results in DuckDB's SQL, for queries that SQL can express.

Patterns are the plain ones of the contracts; windows and counts are taken one
by one. Not expressible: XXH64 (op4), tokenizers (op6), packing plans (op7) and a
trained model (op1); tests hold those against brute force.
"""

from __future__ import annotations

from gleaner.llm import pii, quality, secrets

SPACES = r"[^\x20\x09-\x0D]+"


def _spans(text: str, pattern: str, kind: int, test: str = "true") -> str:
    """List of {s, k, e, m} of the matches of a pattern; ``test`` sees m."""
    m, g = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    upto = lambda xs, n: f"coalesce(list_sum(list_transform(({xs})[1:{n}], lambda x: length(x))), 0)"
    one = f"{{'s': CAST({upto(g, 'i')} + {upto(m, 'i - 1')} AS BIGINT), 'k': {kind}, 'e': CAST({upto(g, 'i')} + {upto(m, 'i')} AS BIGINT), 'm': ({m})[i]}}"
    return f"list_filter(list_transform(range(1, len({m}) + 1), lambda i: {one}), lambda y: {test.replace('$m', 'y.m')})"


def _joined(spans: str, kinds: list[str]) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return f"array_to_string(list_transform(list_sort({spans}), lambda y: concat({names}[y.k + 1], ':', y.s, ':', y.e)), ',')"


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def op2() -> str:
    names = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    candidate = "[A-Za-z0-9+/_=-]{20,}"
    w = secrets.WINDOW
    windows = f"list_max(list_transform(range(1, length($m) - {w} + 2), lambda j: list_entropy(string_split(substring($m, j, {w}), ''))))"
    limit = "CASE " + " ".join(f"WHEN regexp_full_match($m, '{p.strip('^$')}') THEN {x}" for _, p, x in secrets.CLASSES) + " END"
    allow = secrets.ALLOW.replace("'", "''")
    entropy = f"length($m) >= 20 AND regexp_matches($m, '[0-9]') AND regexp_matches($m, '[A-Za-z]') AND NOT regexp_matches($m, '{allow}') AND {windows} > {limit}"
    base = "list_concat(list_concat(a, b), c)"
    apart = f"list_filter(d, lambda y: len(list_filter({base}, lambda z: z.s < y.e AND y.s < z.e)) = 0)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), f AS (SELECT doc_id,
    {_spans('x', assign, 0, f"length(regexp_extract($m, '{assign}', 1)) >= 8")} AS a, {_spans('x', 'AKIA[A-Z0-9]+', 1, 'length($m) >= 16')} AS b, {_spans('x', '[0-9a-f]{32,}', 2)} AS c,
    {_spans('x', candidate, 3, entropy)} AS d FROM t)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(b) AS BIGINT) AS n_access, CAST(len(c) AS BIGINT) AS n_hex, sha256({_joined(base, secrets.KINDS)}) AS base_sha256, {_joined(f'list_concat({base}, {apart})', secrets.KINDS)} AS spans FROM f"""


def op3() -> str:
    """The CRC-32 runs over the bytes by the usual table, made by eight shifts."""
    return """WITH RECURSIVE k(i, n, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE n < 8),
    tab AS (SELECT list(c ORDER BY i) AS t FROM k WHERE n = 8), d AS (SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    h AS (SELECT doc_id, strlen(x) + 1 AS size, list_prepend(4294967295, list_transform(range(0, strlen(x)), lambda i: (instr('0123456789ABCDEF', substring(hx, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substring(hx, 2 * i + 2, 1)) - 1)) AS b FROM d),
    e AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM h, tab),
    p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) AS r FROM e),
    q AS (SELECT *, least(7, CAST(((2 * before + size) * 8) // (2 * total) AS INTEGER)) AS shard FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q"""


def op5() -> str:
    hexed = "upper(sha1(p))"
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: bin(instr('0123456789ABCDEF', substring({hexed}, i, 1)) + 15)[2:5]), '')"
    digest = f"array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substring(b, i * 5 + j, 1) = '1' THEN CAST(pow(2, 5 - j) AS INTEGER) ELSE 0 END)) AS INTEGER) + 1, 1)), '')"
    return f"""WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages), d AS (SELECT page_id, strlen(p) AS n, {bits} AS b, max(page_id) OVER (PARTITION BY p) AS best, count(*) OVER (PARTITION BY p) AS k FROM t)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {digest} AS payload_digest, CASE WHEN k > 1 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k > 1 AND page_id IS DISTINCT FROM best THEN best END AS refers_to FROM d"""


def op8() -> str:
    run, c, (low, high) = pii.RUN, pii.CONTEXT, pii.LETTERS
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    digits = "regexp_replace($m, '[^0-9]', '', 'g')"
    each = f"CAST(substring(reverse({digits}), i, 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {each} ELSE {each} * 2 % 10 + {each} // 5 END)) % 10 = 0"
    base = [
        _spans("x", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0), _spans("x", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 1, rf"regexp_full_match($m, '{part}(?:\.{part}){{3}}')"),
        _spans("x", r"[0-9](?:[\x20-]?[0-9])+", 2, f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"), _spans("x", r"\+[0-9][\x20().0-9-]+[0-9]", 3, f"length({digits}) BETWEEN 10 AND 15"),
    ]
    joined = base[0]
    for b in base[1:]:
        joined = f"list_concat({joined}, {b})"
    # Words of the context that are not cut by its edge and touch no base span, by their place in the whole text.
    count = lambda k: f"CAST(len(list_filter(b, lambda y: y.k = {k})) AS BIGINT)"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), f AS (SELECT r, doc_id, x, list_sort({joined}) AS b FROM t),
    cuts AS (SELECT r, unnest(string_split_regex(x, '{run}')) AS g, unnest(list_concat(regexp_extract_all(x, '{run}'), [''])) AS m, unnest(range(1, len(regexp_extract_all(x, '{run}')) + 2)) AS i FROM f),
    placed AS (SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM cuts),
    words AS (SELECT r, lower(m) AS term, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(lower(m)) BETWEEN {low} AND {high}),
    terms AS (SELECT term, count(*) AS n_term FROM words GROUP BY 1),
    o AS (SELECT r, length(x) AS n, unnest(b) AS p FROM f), ent AS (SELECT r, n, p.s AS ps, p.e AS pe, concat(p.k, ':', lower(p.m)) AS entity FROM o),
    hidden AS (SELECT DISTINCT w.r, w.s FROM words w JOIN ent ON w.r = ent.r AND w.s < ent.pe AND ent.ps < w.e),
    free AS (SELECT w.* FROM words w ANTI JOIN hidden h ON w.r = h.r AND w.s = h.s),
    near AS (SELECT entity, term FROM ent JOIN free w ON w.r = ent.r AND ((w.e <= ps AND (w.s > ps - {c} OR (w.s = 0 AND ps <= {c}))) OR (w.s >= pe AND (w.e < pe + {c} OR (w.e = n AND n <= pe + {c}))))),
    pair AS (SELECT entity, term, count(*) AS n_pair FROM near GROUP BY 1, 2), entities AS (SELECT entity, count(*) AS n_entity FROM ent GROUP BY 1),
    scored AS (SELECT term, n_pair, n_term, least(0.5, n_entity / (SELECT greatest(1, sum(n_term)) FROM terms)::DOUBLE) AS prior FROM pair JOIN terms USING (term) JOIN entities USING (entity)),
    flagged AS (SELECT term, max(round(1 - log2(least(1.0, (n_pair + prior) / (n_term + 1))) / log2(prior), 9)) AS disclosure FROM scored GROUP BY 1 HAVING disclosure >= {pii.GENERALISE}),
    marked AS (SELECT r, list({{'s': s, 'k': 4, 'e': e, 'm': CASE WHEN disclosure >= {pii.REMOVE} THEN 'remove' ELSE 'generalise' END}}) AS more FROM free JOIN flagged USING (term) GROUP BY r)
    SELECT doc_id, {count(0)} AS n_email, {count(1)} AS n_ip, {count(2)} AS n_card, {count(3)} AS n_phone, sha256({_joined('b', pii.KINDS)}) AS base_sha256,
    {_joined("list_concat(b, coalesce(more, []))", pii.KINDS)} AS spans, array_to_string(list_transform(list_sort(coalesce(more, [])), lambda y: concat(y.s, ':', y.e, ':', y.m)), ',') AS actions FROM f LEFT JOIN marked USING (r)"""


def op9() -> str:
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{rx}')"
    return f"""WITH i AS (SELECT item_id, {words} AS w FROM benchmark), win AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM win),
    p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes), q AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM p),
    h AS (SELECT r, k, q.n, item_id FROM q JOIN win ON q.g = win.g AND q.n = win.n), c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM h) GROUP BY r),
    s AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""


def op10() -> str:
    lim = quality.LIMITS
    lines = "list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"
    solid = "regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT r, doc_id, x, regexp_extract_all(x, '{SPACES}') AS ws FROM t),
    p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS k, ws FROM w WHERE len(ws) > 2), g AS (SELECT r, k, array_to_string(ws[k:k + 2], ' ') AS g FROM p), n AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM g),
    rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([k, k + 1, k + 2]) AS j FROM n WHERE c > 1) GROUP BY r),
    m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len({lines}) - len(list_distinct({lines})) AS BIGINT) AS n_dup_lines, CAST(len({lines}) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      1 - length(regexp_replace({solid}, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) / greatest(1, length({solid}))::DOUBLE AS letters FROM w LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > {lim['symbols_per_word']} * greatest(1, n_words) OR word_chars > {lim['longest_mean_word']} * greatest(1, n_words)
      OR (n_lines > 3 AND 2 * n_dup_lines > n_lines AND n_dup_lines > {lim['dup_lines_per_word']} * n_words) OR letters < {lim['letters_share']}) AS kept FROM b"""


ORACLE_SQL = {"op2_secret_scan": op2(), "op3_sharding": op3(), "op5_warc": op5(), "op8_pii": op8(), "op9_decontamination": op9(), "op10_quality_rules": op10()}
