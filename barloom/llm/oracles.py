"""DuckDB SQL for the operators that SQL can express."""

LINES = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
wide AS (SELECT trim(line, ' ') AS name, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)) <> '' GROUP BY trim(line, ' ') HAVING count(DISTINCT source) >= 10),
marked AS (SELECT l.*, coalesce({'d': doc_id, 'p': pos} <> wide.first, false) AS gone FROM l LEFT JOIN wide ON wide.name = trim(l.line, ' ')),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines_removed, length(t) AS n_chars_left, md5(t) AS text_md5 FROM documents LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), it AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[k + 1 : k + n], ' ') AS g FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS k FROM it WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, item, k, n FROM grams JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
own AS (SELECT item, k, n, o, lower(w[k + o + 1]) AS term FROM (SELECT item, w, k, n, unnest(range(n)) AS o FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS k FROM it WHERE len(w) > 0))),
spot AS (SELECT doc_id, lower(w[p + 1]) AS term, p FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d)),
often AS (SELECT term, count(*) AS times FROM spot GROUP BY term),
ranked AS (SELECT item, k, n, term, row_number() OVER (PARTITION BY item, k ORDER BY times, term, o) AS r, count(*) OVER (PARTITION BY item, k) AS present FROM own JOIN often USING (term)),
rare AS (SELECT DISTINCT item, t1, t2 FROM (SELECT item, k, max(term) FILTER (r = 1) AS t1, max(term) FILTER (r = 2) AS t2 FROM ranked WHERE present = n GROUP BY item, k) WHERE t2 IS NOT NULL),
near AS (SELECT x.doc_id, count(DISTINCT item) AS n_near FROM rare JOIN spot x ON x.term = t1 JOIN spot y ON y.term = t2 AND y.doc_id = x.doc_id WHERE abs(x.p - y.p) BETWEEN 1 AND 13 GROUP BY x.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

NEAR_COPIES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) c USING (doc_id)
"""

#: Kind, pattern, counted group, least characters of it.
_SECRETS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# Matches and the gaps between them alternate, so a match begins after the gaps up to it and the matches before.
_FOUND = " UNION ALL ".join(
    f"SELECT {rank} AS rank, '{kind}' AS kind, {least} AS least, doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS part, "
    f"list_transform(regexp_split_to_array(t, '{pattern}'), lambda g: length(g)) AS gaps FROM d"
    for rank, (kind, pattern, group, least) in enumerate(_SECRETS)
)
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_FOUND}),
each AS (SELECT rank, kind, least, doc_id, unnest(m) AS m, unnest(part) AS part, unnest(gaps[1 : len(m)]) AS gap, unnest(range(len(m))) AS nth FROM found WHERE len(m) > 0),
placed AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY nth) AS stop FROM each),
spans AS (SELECT doc_id, rank, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(part) >= least),
own AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, sha256(t) AS blob_sha256 FROM d LEFT JOIN own USING (doc_id)
"""

_JOINED = "array_to_string(w[k + 1 : k + m], ' ')"
COLLOCATIONS = rf"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents)),
g AS (SELECT lang, m, {_JOINED} AS phrase FROM (SELECT lang, w, m, unnest(range(len(w) - m + 1)) AS k FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS cut FROM f WHERE m >= 2)),
each AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, fx.a AS l, fy.a AS r, n.n, (1000::HUGEINT * cuts.a * n.n) // (fx.a::HUGEINT * fy.a) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = cuts.x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = cuts.y JOIN n ON n.lang = cuts.lang),
least AS (SELECT lang, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM each) WHERE nth = 1),
inner_of AS (SELECT lang, a, array_to_string(w[k + 1 : k + j], ' ') AS phrase FROM (SELECT *, unnest(range(m - j + 1)) AS k FROM (SELECT *, unnest(range(2, m)) AS j FROM f WHERE m >= 3))),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inner_of i ON i.lang = f.lang AND i.phrase = f.phrase WHERE 100 * i.a >= 100 * f.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_HTML = "coalesce(html, '')"
ARCHIVED = f"""
WITH p AS (SELECT page_id, {_HTML} AS t, octet_length(encode({_HTML})) AS n FROM pages), best AS (SELECT t, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.t) AS payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to FROM p LEFT JOIN best ON best.t = p.t
"""
