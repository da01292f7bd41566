"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


_HOST = lower("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")
_QUERY = "regexp_extract(url, '^(?s:.*?)://[^?#]*\\?([^#]*)', 1)"
OP3 = f"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(regexp_replace({_QUERY}, '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
keyed AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '')
              || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon
  FROM parts),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
listed AS (SELECT DISTINCT canon FROM keyed WHERE page_id % 100 = 0 AND canon IS NOT NULL),
judged AS (
  SELECT k.*, (SELECT max_by(r.rule, length(r.rule)) FROM rules r
               WHERE (k.host = r.rhost OR ends_with(k.host, '.' || r.rhost)) AND starts_with(k.path, r.rpath)) AS rule
  FROM keyed k)
SELECT j.page_id, j.host, j.path, j.rule,
       CASE WHEN j.rule IS NOT NULL THEN r.verdict WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN rules r ON r.rule = j.rule LEFT JOIN listed l ON l.canon = j.canon
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM g
"""

SQL = {"op3_url_filter": OP3, "op9_warc": OP9}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
OP2 = f"""
WITH d AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, length(text) AS chars, length(regexp_replace(text, '[\\p{{L}}\\s]+', '', 'g')) AS odd FROM documents),
q AS (SELECT *, greatest(0.05::DOUBLE, CASE WHEN size > 0 THEN pow(1 - odd / chars, 2) / (1 + 4 * pow(ln(chars / size / 6), 2)) ELSE 0 END) AS quality FROM d),
k AS (SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || '0'), 1, 13) AS BIGINT) + 0.5)
             / 4503599627370496.0) / quality AS key FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
        list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, arg_min(level, cap / w) FILTER (cap >= w * level) OVER () AS free FROM lv),
t AS (SELECT source, source_size, CASE WHEN free IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), w * free) END AS target FROM f),
e AS (SELECT *, least(3, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) AS epochs FROM t),
j AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)
        - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN epochs >= 3 THEN 0 ELSE least(size, greatest(0, room)) END AS BIGINT) AS taken
FROM j
"""

SQL["op2_mixing"] = OP2

_WORDS = f"regexp_extract_all({lower("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1 = f"""
WITH b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, 13) AS size, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(n - 13, 0) + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM bw),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
h AS (SELECT dw.doc_id, dw.size, dw.i, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
SQL["op1_decontaminate"] = OP1

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM gone),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN cover USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
SQL["op7_substring_dedup"] = OP7

_BLANK_WORDS = f"coalesce(regexp_extract_all({lower("text")}, '[^\\x20\\x09-\\x0D]+'), [])"
OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.seen),
comp AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
SQL["op8_minhash"] = OP8

OP10 = r"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
w AS (SELECT * FROM o WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT row_number() OVER (ORDER BY line) AS node, line FROM (SELECT DISTINCT line FROM w)),
sh AS (SELECT DISTINCT node, substr(line, i, 9) AS s FROM (SELECT node, line, unnest(range(1, greatest(length(line) - 8, 1) + 1)) AS i FROM d)),
n AS (SELECT node, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.node AS a, b.node AS b, count(*) AS met FROM sh a JOIN sh b ON a.s = b.s AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT a, a FROM ways UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen),
comp AS (SELECT node, min(seen) AS label FROM reach GROUP BY 1),
placed AS (SELECT w.doc_id, w.pos, coalesce(label, d.node) AS label FROM w JOIN d USING (line) LEFT JOIN comp ON comp.node = d.node),
nth AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, pos) AS k FROM placed)
SELECT doc.doc_id, CAST(count(nth.pos) AS BIGINT) AS n_lines, CAST(count(nth.pos) FILTER (k > 1) AS BIGINT) AS n_removed,
       coalesce(string_agg(CAST(nth.pos AS VARCHAR), ',' ORDER BY nth.pos) FILTER (k > 1), '') AS removed
FROM documents doc LEFT JOIN nth USING (doc_id) GROUP BY doc.doc_id
"""
SQL["op10_line_dedup"] = OP10

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_TOKEN = "[A-Za-z0-9+/_=-]{20,}"
_KINDS = ((_ASSIGN, 1, "length(inn) >= 6"), ("AKIA[A-Z0-9]+", 0, "length(hit) >= 20"), ("[0-9a-f]{24,}", 0, "true"), (_TOKEN, 0, "true"))
_PIECES = " UNION ALL ".join(
    f"SELECT row, {i} AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {g}) AS inners FROM d WHERE regexp_matches(text, '{p}')"
    for i, (p, g, _) in enumerate(_KINDS)
)
_KEPT = " OR ".join(f"kind = {i} AND {c}" for i, (_, _, c) in enumerate(_KINDS))
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_PIECES}),
m AS (SELECT row, kind, unnest(range(1, len(hits) + 1)) AS pos, unnest(hits) AS hit, unnest(inners) AS inn, unnest(gaps[1:len(hits)]) AS gap FROM p),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY pos) AS BIGINT) AS e FROM m),
spans AS (SELECT row, kind, e - length(hit) AS s, e, hit FROM placed WHERE {_KEPT}),
base AS (SELECT row, kind, s, e FROM spans WHERE kind < 3),
t AS (SELECT row_number() OVER () AS id, row, s, e, hit, CAST(length(hit) AS DOUBLE) AS n, CAST(floor(log2(length(hit))) AS INT) AS band,
        CASE WHEN regexp_full_match(hit, '[0-9]+') THEN 1 WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 2 WHEN regexp_full_match(hit, '[A-Z2-7]+=*|[a-z0-9]+') THEN 3 ELSE 4 END AS enc
      FROM spans WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = spans.row AND b.s < spans.e AND spans.s < b.e)),
c AS (SELECT id, i, CAST(ascii(ch) AS DOUBLE) AS x FROM (SELECT id, unnest(range(1, length(hit) + 1)) AS i, unnest(string_split(hit, '')) AS ch FROM t)),
pairs AS (SELECT id, CAST(sum(k * (k - 1)) AS DOUBLE) AS pairs FROM (SELECT id, x, count(*) AS k FROM c GROUP BY ALL) GROUP BY id),
sums AS (SELECT id, sum(x) AS s1, sum(x * x) AS q, coalesce(sum(x * nx), 0) AS cr, arg_min(x, i) AS first, arg_max(x, i) AS last FROM (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY i) AS nx FROM c) GROUP BY id),
v AS (SELECT t.*, pairs, [0.2, 0.12, 0.06, 0.05][enc]::DOUBLE AS s2, [0.05, 0.02, 0.0042, 0.003][enc]::DOUBLE AS s3, s1, q, cr, first, last, s1 / n AS mean,
        CAST(greatest(length(regexp_replace(hit, '[+/_=-]+', '', 'g')) - 1, 1) AS DOUBLE) AS m,
        CAST(greatest(length(regexp_replace(regexp_replace(hit, '[+/_=-]+', '', 'g'), '[0-9]+|[A-Z]+|[a-z]+', 'x', 'g')) - 1, 0) AS DOUBLE) AS changes
      FROM t JOIN pairs USING (id) JOIN sums USING (id)),
z AS (SELECT *, (n * (n - 1) * s2 - pairs) / sqrt(2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)) AS uniform,
        CASE WHEN enc > 1 THEN (changes - m * 0.27::DOUBLE) / sqrt(m * (0.27::DOUBLE * (1 - 0.27::DOUBLE))) ELSE 0 END AS runs,
        CASE WHEN q - n * mean * mean > 0.5 THEN (-abs((cr - mean * (2 * s1 - first - last) + (n - 1) * mean * mean) / (q - n * mean * mean)) + 0.1::DOUBLE) * sqrt(n) ELSE -sqrt(n) END AS serial FROM v),
y AS (SELECT *, (uniform + runs + serial) / sqrt(CASE WHEN enc > 1 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END) AS zz FROM z),
tested AS (SELECT *, CAST(least(400, floor(10 * CASE WHEN zz > 0 THEN (zz * zz / 2 - ln(4 / sqrt(2 * pi()) / (3 * zz + sqrt(zz * zz + 8)))) / ln(10) ELSE 0 END)) AS INT) AS bin FROM y),
ranked AS (SELECT band, bin, sum(count(*)) OVER (PARTITION BY band ORDER BY bin DESC) AS rank, sum(count(*)) OVER (PARTITION BY band) AS total FROM tested GROUP BY band, bin),
cuts AS (SELECT band, min(bin) AS cut FROM ranked WHERE pow(10, -bin / 10) <= 0.001 * rank / total GROUP BY band),
found AS (SELECT row, kind, s, e FROM base UNION ALL SELECT row, 3, s, e FROM tested JOIN cuts USING (band) WHERE bin >= cut),
named AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS span FROM found),
agg AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM named GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (row)
"""
SQL["op6_secrets"] = OP6

SQL["op4_sharding"] = """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, true AS in_target FROM documents
"""


def _op11() -> str:
    """The repair letter by letter: for each row, of each state (begin, s, u, a) the cheapest edits and of these the least.

    crc32 is computed bit by bit. Inserts stand just before the turn that needs them, since D comes before I.
    """
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: list_reduce(list_prepend(xor(h, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

    def way(state: str, cost: str, letters: str, turns: str | None) -> str:
        added = f"list_concat({state}.turns, {turns})" if turns else f"{state}.turns"
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letters}', 'turns': {added}}}"

    name, insert = {"u": "user", "a": "assistant"}, {"u": "assistant:", "a": "user:"}

    def ways(to: str) -> str:
        out = [way(to, "4", "D", None)]
        sources = {"b": [], "s": [("b", False)], "u": [("b", False), ("s", False), ("a", False), ("u", True)], "a": [("u", False), ("b", True), ("s", True), ("a", True)]}[to]
        for state, added in sources:
            more = "3 + " if added else ""
            first = f"'{insert[to]}', " if added else ""
            dead = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END"
            out.append(way(state, f"{more}{dead} + CASE WHEN initial = '{to}' THEN 0 ELSE 1000000000 END", "IK" if added else "K", f"[{first}role || ':' || text]"))
            if to != "s":
                out.append(way(state, f"{more}3 + {dead}", "IR" if added else "R", f"[{first}'{name[to]}:' || text]"))
        return f"list_min([{', '.join(out)}])"

    start = "{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}"
    never = start.replace("0::", "1000000000000::")
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS clash, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, n, {start} AS b, {never} AS s, {never} AS u, {never} AS a FROM judged
  UNION ALL
  SELECT w.conv_id, j.i, w.n, {ways("b")}, {ways("s")}, {ways("u")}, {ways("a")} FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1),
ended AS (SELECT conv_id, list_min([b, {way("s", "6", "II", "['user:', 'assistant:']")}, {way("u", "3", "I", "['assistant:']")}, a]) AS best FROM walk WHERE i = n),
counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (clash) AS illegal FROM judged GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL["op11_conversation_repair"] = _op11()

# Every group with every kept term, in 128-bit integers.
SQL["op13_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  {lower("unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM documents),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term, count(*) AS total FROM d GROUP BY ALL HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
had AS (SELECT d.lang, d.source, d.term, count(*) AS count FROM d JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(count)::HUGEINT AS n FROM had GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.count, 0) AS count, 1 + (1000000000 * (coalesce(h.count, 0)::HUGEINT + 1)) // (coalesce(s.n, 0) + l.v) AS p,
  1 + (1000000000 * (k.total::HUGEINT + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE count > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
