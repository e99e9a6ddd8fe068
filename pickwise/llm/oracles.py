"""DuckDB SQL for the operators that SQL can state, over the tables ``documents`` and ``pages``."""

from __future__ import annotations

from pickwise.llm import quality, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(spread: float = 6.0, accuracy: float = 0.01) -> str:
    """Base counts by lists of words and lines; quartiles from the same logarithmic buckets."""
    ratios = {"symbol_ratio": "n_symbols / greatest(n_words, 1)::DOUBLE", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
              "chars_per_word": "word_chars / greatest(n_words, 1)::DOUBLE"}
    value = "CASE WHEN {b} < 0 THEN 0.0 ELSE 1e-3 * pow(" + str(1 + accuracy) + ", {b} + 0.5) END"
    values = " UNION ALL ".join(f"SELECT row_id, lang, source, '{k}' AS ratio, {v} AS v, {quality.RATIOS[k]} AS least, {i} AS rank FROM counted WHERE NOT base_failed"
                                for i, (k, v) in enumerate(ratios.items()))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM texts),
windows AS (SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY row_id),
base AS (SELECT split.row_id, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                coalesce(repeats.n, 0) AS n_repeat_words
         FROM split LEFT JOIN repeats USING (row_id)),
counted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
vals AS ({values}),
buckets AS (SELECT lang, source, ratio, b, count(*) AS n FROM (SELECT *, CASE WHEN v < 1e-3 THEN -1 ELSE floor(ln(v / 1e-3) / ln({1 + accuracy}))::INT END AS b FROM vals) GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total FROM buckets),
quart AS (SELECT lang, source, ratio, min(CASE WHEN upto >= total * 0.25 THEN b END) AS b1, min(CASE WHEN upto >= total * 0.75 THEN b END) AS b3 FROM ranked GROUP BY ALL),
cuts AS (SELECT lang, source, ratio, {value.format(b='b1')} AS q1, {value.format(b='b3')} AS q3 FROM quart),
failed AS (SELECT row_id, arg_min(ratio, rank) AS failed_ratio FROM vals JOIN cuts USING (lang, source, ratio) WHERE v > q3 + {spread} * greatest(q3 - q1, least) GROUP BY row_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND failed_ratio IS NULL AS kept, failed_ratio
FROM counted LEFT JOIN failed USING (row_id)"""


def warc_sql() -> str:
    digits = " || ".join(
        f"substr('{UPPER}234567', ((CAST('0x' || substr(h, {i + 1}, 5) AS BIGINT) >> {shift}) & 31)::INT + 1, 1)" for i in range(0, 40, 5) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS size, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to FROM d"""


def url_sql(rules=urls.RULES, strict=urls.STRICT, soft=urls.SOFT, soft_limit: int = 2) -> str:
    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def hit(term):
        return f"regexp_matches(said, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"

    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    fits = [(r, f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})") for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {quoted(r.name)}" for r, c in fits) + " END"
    told = "CASE " + " ".join(f"WHEN {c} THEN {quoted(r.verdict)}" for r, c in fits) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, host || translate(path, '{UPPER}', '{LOWER}') AS said FROM c)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({told}, CASE WHEN {' OR '.join(map(hit, strict))} OR {' + '.join(f'{hit(t)}::INT' for t in soft)} >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM d"""


def jaccard_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS x, b AS y FROM edges UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM sets"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit (3988292384 is the reflected polynomial)."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)")


def repair_sql() -> str:
    """Damage, faults, cost to go from the last row back as strings of cost and audit, and the repaired rows."""
    spaces = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

    def go(cost: str, edit: str, value: str) -> str:
        return f"(printf('%09d', substr({value}, 1, 9)::INT + {cost}) || '{edit}' || substr({value}, 10))"

    #: states: 0 start, 1 after system, 2 after user, 3 after assistant
    kept = {0: "CASE f.init WHEN 's' THEN v1 WHEN 'u' THEN v2 END", 1: "CASE f.init WHEN 'u' THEN v2 END", 2: "CASE f.init WHEN 'a' THEN v3 END", 3: "CASE f.init WHEN 'u' THEN v2 END"}
    gone = "f.fault IN ('blank', 'duplicate')"
    plain = ", ".join("least({}, CASE WHEN {} THEN NULL ELSE {} END, CASE WHEN {} THEN NULL ELSE {} END) AS b{}".format(
        go("3", "D", f"v{q}"), gone, go("f.extra", "K", f"({kept[q]})"), gone, go("2 + f.extra", "R", "v3" if q == 2 else "v2"), q) for q in range(4))
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                {_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {spaces}) AS solid FROM damaged),
faults AS (SELECT conv_id, pos, role, text, substr(role, 1, 1) AS init,
                  CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  (solid <> '' AND nth = 1 AND right(solid, 1) NOT IN ('.', '!', '?'))::INT AS extra,
                  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair FROM placed),
plan AS (
  SELECT conv_id, max(pos) + 1 AS pos, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, least(b0, {go('2', 'I', 'u')}), least(b1, {go('2', 'I', 'u')}), u, least(b3, {go('2', 'I', 'b2')})
  FROM (SELECT *, least(b2, {go('2', 'I', 'b3')}) AS u FROM (
    SELECT plan.conv_id, f.pos, {plain} FROM plan JOIN faults f ON f.conv_id IS NOT DISTINCT FROM plan.conv_id AND f.pos = plan.pos - 1))),
best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM plan WHERE pos = 1),
edits AS (SELECT conv_id, i, substr(audit, i, 1) AS edit, length(replace(substr(audit, 1, i), 'I', '')) AS pos, length(replace(substr(audit, 1, i), 'D', '')) AS out
          FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM best)),
named AS (SELECT e.*, f.role, f.text, max(CASE WHEN out = 1 AND edit = 'K' AND f.init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
          FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos AND edit <> 'I' WHERE edit <> 'D'),
told AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY out)) AS sha
         FROM named GROUP BY conv_id),
counts AS (SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
spans AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM damaged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(told.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN spans ON spans.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id"""


def trie_sql() -> str:
    """Prefixes as concatenated digests of turns; descendants by pairs of prefixes of one conversation."""
    return f"""
WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), k) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM placed)),
heads AS (SELECT c.conv_id, p.i, p.k, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 20 AND p.i <= c.h),
walks AS (SELECT * FROM heads UNION ALL
          SELECT c.conv_id, p.i - c.h + coalesce(n, 0), p.k, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i > c.h
          LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id) b ON b.conv_id = c.conv_id),
steps AS (SELECT conv_id, i AS depth, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY i) AS node, len(regexp_extract_all(text, '{WORD}')) AS words FROM walks
          UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM steps),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, length(n.node) - 32)),
kids AS (SELECT parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT top, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves
         FROM below JOIN nodes n USING (node) LEFT JOIN kids ON kids.parent = n.node GROUP BY top)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sums.n_leaves, sums.saved_tokens, l.ends_sha256
FROM linked l JOIN sums ON sums.top = l.node LEFT JOIN kids ON kids.parent = l.node"""


def suffix_sql(depth: int = 400) -> str:
    """Every window of every text as hexadecimal digits, grouped by its MD5; runs of repeated ones cut out."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, hex(encode(coalesce(text, ''))) AS digits FROM documents),
pieces AS (SELECT row_id, base, substr(digits, 2 * base + 1, 2 * (1000 + {depth - 1})) AS d FROM (SELECT row_id, digits, unnest(range(0, n_bytes - {depth} + 1, 1000)) AS base FROM texts WHERE n_bytes >= {depth})),
windows AS (SELECT row_id, base + i AS pos, md5(substr(d, 2 * i + 1, {2 * depth})) AS w FROM (SELECT row_id, base, d, unnest(range(0, least(1000, length(d) // 2 - {depth - 1}))) AS i FROM pieces)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT row_id, pos, lag(pos) OVER (PARTITION BY row_id ORDER BY pos) AS before FROM windows JOIN twice USING (w)),
runs AS (SELECT row_id, pos, sum((before IS NULL OR before + {depth} < pos)::INT) OVER (PARTITION BY row_id ORDER BY pos) AS run FROM hits),
spans AS (SELECT row_id, min(pos) AS start, max(pos) + {depth} AS stop FROM runs GROUP BY row_id, run),
cuts AS (SELECT row_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY row_id ORDER BY start), 0) AS from_, lead(stop) OVER (PARTITION BY row_id ORDER BY start) IS NULL AS ends FROM spans),
kept AS (SELECT row_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans,
                string_agg(substr(digits, 2 * from_ + 1, 2 * (start - from_)) || CASE WHEN ends THEN substr(digits, 2 * stop + 1) ELSE '' END, '' ORDER BY start) AS rest
         FROM cuts JOIN texts USING (row_id) GROUP BY row_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, digits))) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)"""
