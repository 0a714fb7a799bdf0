"""The registered queries that SQL can express, in DuckDB's dialect; the others are tested against brute force.

Documents' and vectors' ids are taken to be distinct, as they are in the tables.
"""

#: Words are runs of other than ASCII white space.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
    WITH docs AS (
      SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents
    ), places AS (
      SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35
    ), windows AS (
      SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS passage FROM places
    ), repeats AS (
      SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY passage) > 1
    ), gone AS (
      SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM repeats
    ), each AS (
      SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs
    ), kept AS (
      SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
    )
    SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept k USING (doc_id)
"""

OP4 = rf"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs
    ), shingles AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
    ), links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), either AS (
      SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reached AS (
      SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reached r JOIN either e ON r.other = e.x
    ), least AS (
      SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

OP8 = """
    WITH fine AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    )
    SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
"""


#: Candidates with their places: the k-th begins after k gaps and the matches between them.
_PLACED = """
      SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, unnest(matches) AS match, unnest(hits) AS hit,
        unnest(list_transform(range(1, len(hits) + 1), lambda k: coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(matches[1:k - 1], lambda m: length(m))), 0))) AS place
      FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}', 0) AS matches, regexp_extract_all({text}, '{pattern}', {group}) AS hits, string_split_regex({text}, '{pattern}') AS gaps FROM docs)"""

#: The dialect's patterns can't look around.  With every other character doubled, a match may take one on each side: its neighbours have their own.
_IBAN = r"(?:^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:(?:\x20\x20)?[A-Z0-9]{4}){2,7}(?:(?:\x20\x20)?(?:[0-9][A-Z0-9]{0,2}|[A-Z][0-9][A-Z0-9]?|[A-Z]{2}[0-9]))?)(?:[^A-Za-z0-9]|$)"
_SSN = (
    r"(?:^|[^0-9-])((?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9]))-(?:0[1-9]|[1-9][0-9])-"
    r"(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3}))(?:[^0-9-]|$)"
)
_PATTERNS = [
    ("email", "text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0),
    ("ip", "text", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0),
    ("card", "text", r"[0-9](?:[\x20-]?[0-9])+", 0),
    ("phone", "text", r"\+[0-9][\x20().0-9-]+[0-9]", 0),
    ("iban", "words_apart", _IBAN, 1),
    ("ssn", "digits_apart", _SSN, 1),
]

OP6 = rf"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '([^A-Za-z0-9])', '\1\1', 'g') AS words_apart,
        regexp_replace(coalesce(text, ''), '([^0-9-])', '\1\1', 'g') AS digits_apart
      FROM documents
    ), candidates AS ({" UNION ALL ".join(_PLACED.format(kind=kind, order=i, text=text, pattern=pattern, group=group) for i, (kind, text, pattern, group) in enumerate(_PATTERNS))}
    ), begun AS (
      SELECT *, place + CASE WHEN kind IN ('iban', 'ssn') AND NOT regexp_matches(match, '^[A-Z0-9]') THEN 1 ELSE 0 END AS offset_there FROM candidates
    ), placed AS (
      SELECT b.doc_id, kind, kind_order, d.text,
        CAST(offset_there - CASE kind WHEN 'iban' THEN length(regexp_replace(substring(d.words_apart, 1, CAST(offset_there AS BIGINT)), '[A-Za-z0-9]', '', 'g')) // 2
          WHEN 'ssn' THEN length(regexp_replace(substring(d.digits_apart, 1, CAST(offset_there AS BIGINT)), '[0-9-]', '', 'g')) // 2 ELSE 0 END AS BIGINT) AS start,
        CASE kind WHEN 'iban' THEN replace(hit, '  ', ' ') ELSE hit END AS hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS packed
      FROM begun b JOIN docs d USING (doc_id)
    ), spans AS (
      SELECT doc_id, kind, kind_order, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM placed
      WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
          lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT) ELSE 2 * CAST(reverse(digits)[i] AS INT) - CASE WHEN CAST(reverse(digits)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'iban' THEN length(packed) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(packed[5:] || packed[:4], ''),
          lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
        WHEN 'ssn' THEN regexp_matches(lower(substring(text, greatest(start - 40, 0) + 1, least(40, start))), '\b(?:ssn|social security)')
        ELSE true END
    )
    SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
      sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_order) FILTER (kind_order < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind_order), '') AS spans
    FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1, "op4_neardup": OP4, "op6_pii": OP6, "op8_topk": OP8}
