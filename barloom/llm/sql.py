"""DuckDB twins of the queries that SQL can express."""

#: a-z for A-Z and nothing else, unlike lower().
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, {FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), found AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first AS gone
    FROM keyed k LEFT JOIN found f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_ESCAPED = "regexp_replace({0}, '([\\\\<\\[])', '\\1\\\\', 'g')"
OP6 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
           length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), '<n')) + 1
             + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1 AS chars
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS total FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(total) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

_WORDS = "list_filter(string_split_regex({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP8 = f"""
WITH items AS (
    SELECT item_id, {_WORDS.format(FOLD.format("coalesce(text, '')"))} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
        SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: w[i : i + 12])) AS win
        FROM items WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, {_WORDS.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents
), starts AS (
    SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS pos
    FROM docs, (SELECT DISTINCT n FROM windows) s WHERE len(w) >= s.n
), hits AS (
    SELECT s.doc_id, s.pos, s.n, v.item_id
    FROM starts s JOIN windows v ON v.n = s.n AND v.win = array_to_string(s.w[s.pos : s.pos + s.n - 1], ' ')
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

_SPACED = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP9 = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, {_SPACED.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, hash(s) AS h FROM (
        SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
        FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""

OP10 = f"""
WITH docs AS (
    SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 19], ' ')) AS h FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM docs WHERE len(w) >= 20)
), repeated AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM repeated
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

OP12 = f"""
WITH known AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS w FROM documents
), judged AS (
    SELECT part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
           [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
    FROM docs LEFT JOIN known k USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS f,
           list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before
    FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), seen AS (
    SELECT part, filter_order, step, f, n, good, toxic, fails[ascii(f) - 64] AS failing,
           len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
    FROM counted, steps
), summed AS (
    SELECT part, filter_order, step, f, sum(n) FILTER (NOT failing AND NOT gone) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
           sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (failing AND n_fails = 1) AS unique_fails,
           sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
    FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""

OP13 = """
WITH parts AS (
    SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(u, '^([^/?#]*)([^?#]*)', 2) AS path
    FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages)
), rules(rule, host, path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
    SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, b.rule, CASE
    WHEN b.rule IS NOT NULL THEN b.verdict
    WHEN list_has_any(string_split_regex(p.host, '[.-]'), ['ads', 'adult', 'bet', 'bets', 'betting', 'casino', 'escort', 'gambling', 'pills',
        'poker', 'porn', 'sex', 'slots', 'spam', 'viagra', 'warez', 'xxx']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op5_exact_top_k": OP5,
    "op6_chat_formatting": OP6,
    "op8_decontamination": OP8,
    "op9_ngram_jaccard_join": OP9,
    "op10_substring_dedup": OP10,
    "op12_filter_audit": OP12,
    "op13_url_filter": OP13,
}
