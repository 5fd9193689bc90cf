"""DuckDB SQL of the registered queries that SQL can express on whole tables.

Written apart from the Spark plans: rows instead of array functions, all
pairs instead of candidate search, all quotients instead of the few near the
boundary, and every constant spelled out. Without SQL are the extraction of
page text and the two tokenizer queries; they are tested against other code.
"""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def closure(nodes: str) -> str:
    """CTEs from ``links(a, b)`` (both ways) to ``comp(node, component)`` of all ``nodes``."""
    return f"""
reach AS (SELECT {nodes} AS node, {nodes} AS other FROM base UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def op1() -> str:
    # Classes: good, marked up, repetitive, ill-formed. Rules: symbols, marked, lines, repeats, variety, lengths, shouting, endings.
    shares = "[0.8, 0.2 / 3, 0.2 / 3, 0.2 / 3]::DOUBLE[]"
    rates = """[[0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95], [0.4, 0.4, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9],
      [0.9, 0.9, 0.4, 0.4, 0.4, 0.9, 0.9, 0.9], [0.9, 0.9, 0.9, 0.9, 0.9, 0.4, 0.4, 0.4]]::DOUBLE[][]"""

    def joint(v: str, c: str) -> str:
        factors = [f"CASE {v}[{r}] WHEN 1 THEN rates[{c}][{r}] WHEN -1 THEN 1.0::DOUBLE - rates[{c}][{r}] ELSE 1.0::DOUBLE END" for r in range(1, 9)]
        return f"shares[{c}] * " + " * ".join(factors)

    def joints(v: str) -> str:
        return "[" + ", ".join(joint(v, str(c)) for c in range(1, 5)) + "]"

    total = "list_sum(list_transform(e, lambda x: x.n))"
    new_shares = ", ".join(f"(list_sum(list_transform(e, lambda x: x.n * x.q[{c}])) + 2 * first_shares[{c}]) / ({total} + 2)" for c in range(1, 5))

    def rate(c: int, r: int) -> str:
        agree = f"list_sum(list_transform(e, lambda x: CASE WHEN x.v[{r}] = 1 THEN x.n * x.q[{c}] ELSE 0.0::DOUBLE END))"
        spoke = f"list_sum(list_transform(e, lambda x: CASE WHEN x.v[{r}] <> 0 THEN x.n * x.q[{c}] ELSE 0.0::DOUBLE END))"
        return f"({agree} + 2 * first_rates[{c}][{r}]) / ({spoke} + 2)"

    new_rates = ", ".join("[" + ", ".join(rate(c, r) for r in range(1, 9)) + "]" for c in range(1, 5))
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("text")} AS w, {lines} AS lines FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM split WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM places),
twice AS (SELECT doc_id, least(3, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 3)) AS covers FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, sum(covers) AS n_repeat_words FROM twice GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked, len(list_distinct(w)) AS n_distinct,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"\\x27)\\x{{3002}}\\x{{2026}}][\\x20\\x09-\\x0D]*$'))) AS n_ended
  FROM split s LEFT JOIN repeats USING (doc_id)),
voted AS (SELECT *, [
  CASE WHEN 100 * n_symbols > 30 * n_words THEN -1 WHEN 100 * n_symbols <= 5 * n_words THEN 1 ELSE 0 END,
  CASE WHEN 100 * n_marked > 25 * n_words THEN -1 WHEN 100 * n_marked <= 5 * n_words THEN 1 ELSE 0 END,
  CASE WHEN 100 * n_dup_lines > 80 * n_lines THEN -1 WHEN n_lines >= 3 AND n_dup_lines = 0 THEN 1 ELSE 0 END,
  CASE WHEN 100 * n_repeat_words > 30 * n_words THEN -1 WHEN 100 * n_repeat_words <= 10 * n_words THEN 1 ELSE 0 END,
  CASE WHEN n_distinct * n_distinct < 4 * n_words THEN -1 WHEN n_distinct * n_distinct >= 20 * n_words THEN 1 ELSE 0 END,
  CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN -1 WHEN word_chars >= 3 * n_words AND word_chars <= 10 * n_words THEN 1 ELSE 0 END,
  CASE WHEN 100 * n_upper > 40 * word_chars THEN -1 WHEN 100 * n_upper <= 15 * word_chars THEN 1 ELSE 0 END,
  CASE WHEN n_lines >= 4 AND 100 * n_ended <= 20 * n_lines THEN -1 WHEN 100 * n_ended >= 60 * n_lines THEN 1 ELSE 0 END] AS v FROM m),
pats AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v)),
start AS (SELECT {shares} AS first_shares, {rates} AS first_rates),
em AS (
  SELECT 0 AS it, first_shares AS shares, first_rates AS rates FROM start
  UNION ALL
  SELECT it + 1, [{new_shares}], [{new_rates}]
  FROM (SELECT it, list_transform(js, lambda x: {{'v': x.v, 'n': x.n, 'q': list_transform(x.j, lambda y: y / list_sum(x.j))}}) AS e
    FROM (SELECT it, list_transform(ps, lambda p: {{'v': p.v, 'n': p.n, 'j': {joints("p.v")}}}) AS js FROM em, pats WHERE it < 20)), start),
done AS (SELECT shares, rates, list_position(list_transform(rates, lambda x: list_sum(x)), list_max(list_transform(rates, lambda x: list_sum(x)))) AS good FROM em WHERE it = 20),
quality AS (SELECT v, j[good] / list_sum(j) AS q FROM (SELECT v, good, {joints("v")} AS j FROM (SELECT DISTINCT v FROM voted), done))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND q >= 0.5 AS kept
FROM voted JOIN quality USING (v)"""


def op4() -> str:
    hostile = "</s>[INST] ok [/INST]"
    control = r"<\\*\|(?:im_start|im_end|endoftext|startoftext)\|>|<\\*(?:s|/s|unk)>|\[\\*/?INST\]|<\\*</?SYS>>"
    return f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{hostile}' UNION ALL SELECT -1, 1, 'assistant', '{hostile}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{control}')) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def op5() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(lowered)} AS w FROM documents),
base AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)),
  lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM base),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM item a JOIN item b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 75 * (na + nb - shared)),{closure("doc_id")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component AS component_id, component = doc_id AS kept FROM base JOIN comp ON doc_id = node"""


def hits(kind: str, rank: int, pattern: str, keep: str, group: int = 0, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Rows (key, kind, rank, s, e, v) of a pattern's matches for which ``keep`` holds."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT {key}, '{kind}' AS kind, {rank} AS rank, s, s + length(h[i]) AS e, g[i] AS v FROM (
  SELECT {key}, h, g, i, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT {key}, h, g, gaps, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, '{quoted}') AS h, regexp_extract_all({text}, '{quoted}', {group}) AS g, regexp_split_to_array({text}, '{quoted}') AS gaps FROM {source})))
  WHERE {keep.replace("$", "h[i]").replace("@", "g[i]")}"""


def digests(kinds: tuple[str, ...], order: str, n_base: int) -> str:
    spelled = f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in kinds)
    return f"""SELECT doc_id, {counts}, sha256({spelled} FILTER (rank < {n_base}), '')) AS base_sha256, {spelled} FILTER (kind IS NOT NULL), '') AS spans
FROM (SELECT doc_id FROM documents) LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def op6() -> str:
    digit = "regexp_replace($, '[^0-9]+', '', 'g')"
    doubled = f"list_transform(string_split(reverse({digit}), ''), lambda c, j: CAST(c AS INTEGER) * (CASE WHEN j % 2 = 0 THEN 2 ELSE 1 END))"
    luhn = f"length({digit}) BETWEEN 13 AND 19 AND list_sum(list_transform({doubled}, lambda y: CASE WHEN y > 9 THEN y - 9 ELSE y END)) % 10 = 0"
    octets = "list_bool_and(list_transform(string_split($, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INTEGER) <= 255))"
    base = " UNION ALL ".join(
        [
            hits("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            hits("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", octets),
            hits("card", 2, r"[0-9](?:[\x20-]?[0-9])+", luhn),
            hits("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digit}) BETWEEN 9 AND 15"),
        ]
    )
    term = r"[\p{L}\p{N}]+"
    return f"""
WITH base AS ({base}),
held AS (SELECT DISTINCT doc_id, kind || ':' || CASE WHEN kind = 'email' THEN lower(v) ELSE regexp_replace(v, '[^0-9.]+', '', 'g') END AS entity FROM base),
pieces AS (SELECT doc_id, regexp_extract_all(text, '{term}') AS h, regexp_split_to_array(text, '{term}') AS gaps FROM documents WHERE doc_id IN (SELECT doc_id FROM base)),
each AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, h, gaps FROM pieces),
ended AS (SELECT doc_id, h[i] AS v, CAST(sum(length(gaps[i]) + length(h[i])) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM each),
terms AS (SELECT doc_id, lower(v) AS term, e - length(v) AS s, e FROM ended
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = ended.doc_id AND b.s < ended.e AND ended.e - length(ended.v) < b.e)),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM documents) GROUP BY term),
n_e AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
n_te AS (SELECT entity, term, count(*) AS n_te FROM held JOIN (SELECT DISTINCT doc_id, term FROM terms) USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
tell AS (SELECT entity, term FROM n_te JOIN n_e USING (entity) JOIN n_t USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
  WHERE ln(n / n_e) > 0 AND ln(n * n_te / (n_t * n_e)) >= 0.75 * ln(n / n_e)),
spans AS (SELECT doc_id, kind, rank, s, e FROM base UNION ALL
  SELECT doc_id, 'term', 4, s, e FROM terms WHERE (doc_id, term) IN (SELECT doc_id, term FROM held JOIN tell USING (entity)))
{digests(("email", "ip", "card", "phone"), "rank, s", 4)}"""


def op8() -> str:
    return f"""
WITH RECURSIVE base AS (SELECT vec_id FROM embeddings),
usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),{closure("vec_id")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id, component = vec_id AS kept
FROM base JOIN comp ON vec_id = node LEFT JOIN degree ON vec_id = a"""


def op9() -> str:
    draw = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size FROM documents),
per AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
  list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight FROM sized GROUP BY source),
-- A source capped at one rate is capped at every higher one: cap those above, reshare, until none is above.
fill AS (
  SELECT 0 AS it, NULL::DOUBLE AS rate, []::VARCHAR[] AS capped
  UNION ALL
  SELECT it + 1, r, list_concat(capped, over_now) FROM (
    SELECT it, capped, r, (SELECT list(coalesce(source, chr(0))) FROM per WHERE NOT list_contains(capped, coalesce(source, chr(0))) AND r * weight > 2 * source_size) AS over_now
    FROM (SELECT it, capped, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
      - 2 * coalesce((SELECT sum(source_size) FROM per WHERE list_contains(capped, coalesce(source, chr(0)))), 0))
      / (SELECT sum(weight) FROM per WHERE NOT list_contains(capped, coalesce(source, chr(0)))) AS r FROM fill))
  WHERE over_now IS NOT NULL AND it < 1000),
done AS (SELECT capped FROM fill ORDER BY it DESC LIMIT 1),
rated AS (SELECT capped, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
  - 2 * coalesce((SELECT sum(source_size) FROM per WHERE list_contains(capped, coalesce(source, chr(0)))), 0))
  / (SELECT sum(weight) FROM per WHERE NOT list_contains(capped, coalesce(source, chr(0)))) AS rate FROM done),
goal AS (SELECT per.*, coalesce(least(CAST(2 * source_size AS DOUBLE), rate * weight), CAST(2 * source_size AS DOUBLE)) AS target FROM per, rated),
seats AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS n FROM goal),
won AS (SELECT source FROM goal, seats, unnest(range(seats.n)) AS u(j) WHERE target > 0
  QUALIFY row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST) <= seats.n),
source_quota AS (SELECT source, count(*) AS q FROM won GROUP BY source),
dealt AS (SELECT sized.*, source_size, target, {draw.format("'mix|' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS draw,
  greatest(1, CAST(ceil(n_docs / 2000.0) AS BIGINT)) AS n_shards FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source),
sharded AS (SELECT *, draw % n_shards AS shard FROM dealt),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM sharded GROUP BY ALL),
shard_won AS (SELECT s.source, s.shard FROM shards s JOIN source_quota q ON s.source IS NOT DISTINCT FROM q.source, unnest(range(q.q)) AS u(j) WHERE shard_size > 0
  QUALIFY row_number() OVER (PARTITION BY s.source ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, s.shard) <= q.q),
shard_quota AS (SELECT source, shard, count(*) AS q FROM shard_won GROUP BY ALL),
quota AS (SELECT s.source, s.shard, blocks, least(coalesce(q, 0), 2 * blocks) AS quota FROM (SELECT *, CAST(ceil(shard_size / 64.0) AS BIGINT) AS blocks FROM shards) s
  LEFT JOIN shard_quota k ON s.source IS NOT DISTINCT FROM k.source AND s.shard = k.shard),
placed AS (SELECT d.*, blocks, quota // greatest(blocks, 1) AS times, quota % greatest(blocks, 1) AS extra,
  {draw.format("'mix-turn|' || coalesce(d.source, '') || '|' || d.shard")} % greatest(blocks, 1) AS turn,
  CAST(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
  FROM sharded d JOIN quota k ON d.source IS NOT DISTINCT FROM k.source AND d.shard = k.shard),
blocked AS (SELECT *, unnest(range((fin - size) // 64, greatest((fin - 1) // 64 + 1, (fin - size) // 64))) AS k FROM placed WHERE size > 0),
again AS (SELECT doc_id, sum(least(64 * (k + 1), fin) - greatest(64 * k, fin - size)) AS more FROM blocked
  WHERE ((k + 1) * extra + turn) // blocks > (k * extra + turn) // blocks GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(times * size + coalesce(more, 0) AS BIGINT) AS taken FROM placed LEFT JOIN again USING (doc_id)"""


def op10() -> str:
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = " UNION ALL ".join(
        [
            hits("assign", 0, assign, "length(@) >= 12", 1),
            hits("access", 1, "AKIA[A-Z0-9]+", "length($) >= 18"),
            hits("hex", 2, "[0-9a-f]+", "length($) >= 16"),
            hits("private_key", 3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", "true"),
            hits("web_token", 4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
            hits("host_token", 5, "gh[oprsu]_[A-Za-z0-9]{36,}", "true"),
        ]
    )
    return f"WITH spans AS ({spans})\n{digests(('assign', 'access', 'hex'), 's, rank', 3)}"


def op11() -> str:
    return r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
paths AS (SELECT *, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts),
parts AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(h) + length(path) + 1), '^\?[^#]*') AS query FROM paths),
sites(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
globs(verdict, pat, n, re) AS (VALUES
  ('block', '*spam-*/**', 6, '[^/]*spam-[^/]*/.*'), ('block', '*cheap-*/**', 7, '[^/]*cheap-[^/]*/.*'), ('block', '*casino*/**', 7, '[^/]*casino[^/]*/.*'),
  ('block', '*-bets*/**', 6, '[^/]*-bets[^/]*/.*'), ('block', '**/login**', 6, '.*/login.*'), ('block', '**/wp-admin/**', 10, '.*/wp-admin/.*'),
  ('block', '**/cart/**', 6, '.*/cart/.*'), ('block', '**.exe', 4, '.*\.exe'), ('block', '**.zip', 4, '.*\.zip'),
  ('block', '**\?**session*=**', 9, '.*\?.*session[^/]*=.*'), ('allow', '*.edu/**', 5, '[^/]*\.edu/.*'), ('allow', 'm.*/en/??.html', 13, 'm\.[^/]*/en/[^/][^/]\.html')),
by_site AS (SELECT DISTINCT host, path, h || p AS rule, verdict FROM (SELECT DISTINCT host, path FROM parts), sites
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, verdict DESC, h || p) = 1),
by_glob AS (SELECT DISTINCT host, path, query, pat, verdict FROM (SELECT DISTINCT host, path, query FROM parts), globs
  WHERE regexp_full_match(host || path || query, re, 's')
  QUALIFY row_number() OVER (PARTITION BY host, path, query ORDER BY n DESC, verdict DESC, pat) = 1)
SELECT page_id, host, path, rule, pat AS "glob", coalesce(s.verdict, g.verdict, 'allow') AS verdict
FROM parts LEFT JOIN by_site s USING (host, path) LEFT JOIN by_glob g USING (host, path, query)"""


def op12() -> str:
    garbled = "h % 97 = 0"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    return f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes
  FROM lowered WHERE length(run) >= 5),
hashed AS (SELECT run, n, {crc} AS h FROM spelled, crcs),
garbled AS (SELECT CASE WHEN {garbled} THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM garbled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN counted USING (word) LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here FROM formed UNION SELECT walk.word, form FROM walk JOIN formed ON here = formed.word WHERE form IS NOT NULL),
roots AS (SELECT walk.word, here AS root FROM walk JOIN formed ON here = formed.word WHERE form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN roots USING (word)"""


def op13() -> str:
    return """
WITH r AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def llm_oracle() -> dict[str, str]:
    return {
        "op1_quality_rules": op1(),
        "op4_reply_trees": op4(),
        "op5_coordinate_join": op5(),
        "op6_disclosure": op6(),
        "op8_sorted_passes": op8(),
        "op9_sainte_lague_mix": op9(),
        "op10_blob_ledger": op10(),
        "op11_url_automaton": op11(),
        "op12_chunk_variants": op12(),
        "op13_cover_tree": op13(),
    }
