"""DuckDB SQL for the queries that SQL can express."""

#: Words of a text: the runs outside white space.
_N_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mix_sql(documents: str = "documents") -> str:
    """Water-filling by level, then prefix sums in the order of md5(seed:epoch:doc_id)."""
    levels, select = [], []
    weight = {
        "domain": "CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 30 WHEN 'news' THEN 20 WHEN 'code' THEN 10 ELSE 5 END",
        "lang": "CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 5 END",
        "source": "1",
    }
    keys = ["domain", "lang", "source"]
    for depth in (1, 2, 3):
        own, up, name = ", ".join(keys[:depth]), keys[: depth - 1], keys[depth - 1]
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        budget = "p.allot" if up else "(SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * 3 // 5 FROM leaf)"
        join = f"JOIN a{depth - 1} p USING ({', '.join(up)})" if up else ""
        levels.append(f"""
 c{depth} AS (SELECT {own}, CAST(sum(tokens) * 2 AS BIGINT) AS cap, CAST({weight[name]} AS BIGINT) AS weight FROM leaf GROUP BY {own}),
 b{depth} AS (SELECT {own}, cap, weight, {budget} AS budget FROM c{depth} {join}),
 d{depth} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM b{depth} WINDOW w AS ({part} ORDER BY cap / weight, {name})),
 e{depth} AS (SELECT *, cap * rest_weight <= (budget - cap_before) * weight AS filled FROM d{depth}),
 a{depth} AS (SELECT {own}, CASE WHEN filled THEN cap ELSE
   CAST((budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER w, 0)) * weight // sum(CASE WHEN NOT filled THEN weight END) OVER w AS BIGINT) END AS allot
   FROM e{depth} WINDOW w AS ({part}))""")
    select = ",".join(levels)
    return f"""WITH meta0 AS (SELECT doc_id, regexp_extract(source, '([0-9]{{1,9}})', 1) AS number, coalesce(lang, 'und') AS lang,
   coalesce(source, 'none') AS source, CAST({_N_TOKENS} AS BIGINT) AS n_tokens FROM {documents}),
 meta AS (SELECT doc_id, CASE WHEN number IS NULL OR number = '' THEN 'other' ELSE ['web', 'books', 'news', 'code'][CAST(number AS INT) % 4 + 1] END AS domain,
   lang, source, n_tokens FROM meta0 WHERE n_tokens > 0),
 leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM meta GROUP BY ALL),{select},
 goal AS (SELECT domain, lang, source, allot // tokens AS epochs, allot % tokens AS rest FROM leaf JOIN a3 USING (domain, lang, source)),
 ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('17:', epochs, ':', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id, n_tokens
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM meta JOIN goal USING (domain, lang, source)),
 taken AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(greatest(0, least(n_tokens, rest - before)) AS BIGINT) AS prefix_tokens FROM ordered)
SELECT *, epochs * n_tokens + prefix_tokens AS taken_tokens FROM taken WHERE epochs * n_tokens + prefix_tokens > 0"""


MIX_SQL = mix_sql()


def lines_sql(documents: str = "documents") -> str:
    """Line deduplication: equal words, or one word replaced, inserted or deleted, against any earlier line."""
    return rf"""WITH line AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line, list_filter(regexp_split_to_array(x[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
   FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {documents})),
 place AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM line WHERE len(words) > 0),
 uniq AS (SELECT words, min(id) AS id FROM place GROUP BY words),
 variant AS (SELECT id, len(words) AS n, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM uniq WHERE len(words) >= 5)),
 near AS (SELECT b.id FROM variant a JOIN variant b ON a.rest = b.rest AND a.i = b.i AND a.id < b.id
   UNION SELECT greatest(v.id, u.id) FROM variant v JOIN uniq u ON v.rest = u.words AND v.n > 5 AND u.id <> v.id),
 gone AS (SELECT p.doc_id, p.line_no FROM place p JOIN uniq u USING (words) WHERE p.id <> u.id OR u.id IN (SELECT id FROM near)),
 dropped AS (SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.doc_id) AS BIGINT) AS n_dropped,
   string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.doc_id IS NULL) AS text FROM line l LEFT JOIN gone g USING (doc_id, line_no) GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, CASE WHEN n_dropped = 0 OR regexp_matches(text, '[^\x20\x09-\x0D]') THEN text END AS text FROM dropped"""


LINES_SQL = lines_sql()


def audit_sql(documents: str = "documents", labels: str = "labels") -> str:
    """Failing filters of each document, then every order and step over them."""
    return rf"""WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM {documents}),
 word AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM doc),
 marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM {labels} GROUP BY doc_id),
 flag AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
   + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
   + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS INT) AS s FROM word LEFT JOIN marks USING (doc_id)),
 pattern AS (SELECT part, s, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flag GROUP BY part, s),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 ord AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
 place AS (SELECT filter_order, step, filter_order[step] AS own, 1 << (ascii(filter_order[step]) - 65) AS bit,
   coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM ord, (SELECT unnest(range(1, 6)) AS step)),
 res AS (SELECT part, filter_order, step, own, sum(n) FILTER (s & bit = 0 AND s & before = 0) AS kept, sum(n) FILTER (s & bit <> 0 AND s & before = 0) AS removed,
   sum(n) FILTER (s & bit <> 0 AND s & before <> 0) AS redundant, sum(n) FILTER (s = bit) AS unique_fails,
   sum(good) FILTER (s & bit <> 0 AND s & before = 0) AS good_lost, sum(toxic) FILTER (s & bit <> 0 AND s & before = 0) AS toxic_lost FROM pattern, place GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
 CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM res"""


AUDIT_SQL = audit_sql()
