"""DuckDB SQL for every registered query (the brute-force check of the Spark plans).

Tables ``part documents pages ...`` are views over the same Parquet files. The
SQL is plain CTEs, cross joins where that is the simplest statement. It shares the fixed
patterns (tokens, tags, whitespace) with the library, so it cannot see an error in those;
tests/test_text.py and tests/test_skills_delta.py hold literal expected values for them.
"""

from __future__ import annotations

# Fixed values shared with skillsift.functions.text (same meaning, SQL syntax):
# tokenizer pattern and Python's whitespace set.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
PY_WS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_RE}')"


def ngram(t: str, n: int) -> str:
    """n-grams of a token-list column ``t`` (t must be a plain column name)."""
    if n == 1:
        return t
    return (f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)")


# References a page may hold, by what they decode to (fixed values of HTML).
NAMED = {"amp": 38, "AMP": 38, "Tab": 9, "NewLine": 10, "nbsp": 160, "NonBreakingSpace": 160, "ensp": 8194,
         "emsp": 8195, "emsp13": 8196, "emsp14": 8197, "numsp": 8199, "puncsp": 8200, "thinsp": 8201,
         "ThinSpace": 8201, "hairsp": 8202, "VeryThinSpace": 8202, "MediumSpace": 8287}


def unescaped(s: str) -> str:
    """Every reference replaced by its character; numbers of HTML's non-characters and Windows-1252 give none."""
    num = ("coalesce(TRY_CAST(nullif(regexp_extract(r, '^#([0-9]{1,7});?', 1), '') AS BIGINT), "
           "TRY_CAST(nullif('0x' || regexp_extract(r, '^#[xX]([0-9a-fA-F]{1,6});?', 1), '0x') AS BIGINT))")
    ok = ("n IN (9, 10, 12, 13) OR n BETWEEN 32 AND 126 OR (n >= 160 AND n < 55296) OR (n > 57343 AND n < 1114112)")
    names = " ".join(f"WHEN '{k}' THEN chr({v})" for k, v in NAMED.items())
    name = "regexp_extract(r, '^([a-zA-Z][a-zA-Z0-9]*);', 1)"
    rest = "regexp_replace(r, '^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[a-zA-Z][a-zA-Z0-9]*;)', '')"
    one = (f"list_transform([{num}], lambda n: CASE WHEN n IS NOT NULL THEN (CASE WHEN {ok} THEN chr(CAST(n AS INTEGER)) "
           f"ELSE '' END) || {rest} WHEN {name} <> '' THEN (CASE {name} {names} ELSE '' END) || {rest} "
           f"ELSE '&' || r END)[1]")
    return (f"array_to_string(list_concat([string_split({s}, '&')[1]], "
            f"list_transform(string_split({s}, '&')[2:], lambda r: {one})), '')")


def clean_html(x: str) -> str:
    s = x
    for pat in (r"(?is)<script(\s[^>]*)?>.*?</script\s*>", r"(?is)<style(\s[^>]*)?>.*?</style\s*>",
                r"(?is)<template(\s[^>]*)?>.*?</template\s*>", r"(?s)<!--.*?-->", r"<[a-zA-Z/!?][^>]*>"):
        s = f"regexp_replace({s}, '{pat}', '', 'g')"
    s = unescaped(s)
    s = f"replace({s}, '&', 'and')"
    s = f"regexp_replace({s}, '[^a-zA-Z0-9{PY_WS}]', '', 'g')"
    s = f"replace({s}, chr(10) || chr(10), ' ')"
    s = f"replace({s}, chr(10), ' ')"
    s = f"replace({s}, '  ', ' ')"
    return f"lower({s})"


def contained_ratio(t: str, q: str) -> str:
    lq, lt = f"length(lower({q}))", f"length(lower({t}))"
    return f"(CASE WHEN {lq} + {lt} = 0 THEN 1.0 ELSE 2.0 * {lq} / ({lq} + {lt}) END)"


def match(t: str, q: str, th: float) -> str:
    return f"(contains(lower({t}), lower({q})) AND {contained_ratio(t, q)} >= {th})"


JOBS = """jobs AS (
  SELECT p.p_partkey AS job_id, p.p_name AS title, p.p_type AS category, p.p_brand AS level,
         p.p_retailprice AS salary, d.text AS skills_extracts
  FROM part p JOIN documents d ON d.doc_id = p.p_partkey % (SELECT count(*) FROM documents))"""

TITLE_REQUESTS = """req AS (SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name)"""

INDEX = f"""dtok AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM dtok GROUP BY doc_id, term),
voc AS (SELECT term, count(*) AS df,
               ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
        FROM dtf GROUP BY term),
post AS (SELECT doc_id AS course_id, term, tf,
                (tf * idf) / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS weight
         FROM dtf JOIN voc USING (term))"""


def recommend_sql(req_cte: str, sizes: tuple[int, ...], k: int, th: float = 0.9) -> str:
    grams = "\n  UNION ALL ".join(
        f"SELECT query_id, {n}::BIGINT AS n, unnest({ngram('t', n)}) AS term FROM mtok" for n in sizes)
    return f"""WITH {JOBS},
{req_cte},
{INDEX},
mt AS (SELECT r.query_id, j.skills_extracts
       FROM req r JOIN (SELECT DISTINCT title FROM jobs) t ON {match('t.title', 'r.query', th)}
       JOIN jobs j ON j.title = t.title),
mtok AS (SELECT query_id, {tok('skills_extracts')} AS t FROM mt),
grams AS ({grams}),
cnt AS (SELECT query_id, n, term, count(*) AS cnt FROM grams GROUP BY query_id, n, term),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY cnt DESC, term ASC) AS rk
        FROM cnt QUALIFY rk <= 10),
sq AS (SELECT query_id, n, string_agg(term, ', ' ORDER BY rk) AS skills_query FROM top GROUP BY query_id, n),
qtok AS (SELECT query_id, n, unnest({tok('skills_query')}) AS term FROM sq),
qtf AS (SELECT query_id, n, term, count(*) AS tf FROM qtok GROUP BY query_id, n, term),
qv AS (SELECT query_id, n, term,
              tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id, n)) AS qweight
       FROM qtf JOIN voc USING (term)),
sc AS (SELECT query_id, n, course_id, sum(qweight * weight) AS score FROM qv JOIN post USING (term)
       GROUP BY query_id, n, course_id),
allc AS (SELECT sq.query_id, sq.n, c.doc_id AS course_id, coalesce(sc.score, 0.0) AS score
         FROM sq CROSS JOIN documents c
         LEFT JOIN sc ON sc.query_id = sq.query_id AND sc.n = sq.n AND sc.course_id = c.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY round(score, 9) DESC, course_id)
                  AS rank
           FROM allc QUALIFY rank <= {k})
SELECT r.query_id, r.n, sq.skills_query, r.rank, r.course_id AS referenceNumber, d.source AS title,
       d.text AS combined_features, round(r.score, 9) AS score
FROM ranked r JOIN sq USING (query_id, n) JOIN documents d ON d.doc_id = r.course_id"""


SQL: dict[str, str] = {}

SQL["recommend_unigram"] = recommend_sql("req AS (SELECT 1::BIGINT AS query_id, 'red plate' AS query)", (1,), 10)
SQL["recommend_bigram"] = recommend_sql("req AS (SELECT 1::BIGINT AS query_id, 'red plate' AS query)", (2,), 10)
SQL["recommend_batch"] = recommend_sql(TITLE_REQUESTS, (1, 2), 5)
SQL["recommend_display"] = f"""SELECT query_id, n, skills_query, rank AS "Rank", title AS "Course Title",
       referenceNumber AS "Course Reference Number", combined_features AS "Course Skills"
FROM ({recommend_sql("req AS (SELECT 1::BIGINT AS query_id, 'red plate' AS query)", (1, 2), 5)})"""

SQL["tokens"] = f"""SELECT doc_id, pos, term FROM (
  SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, {tok('text')} AS t FROM documents))"""

SQL["ngrams_2"] = f"""SELECT doc_id, pos, term FROM (
  SELECT doc_id, unnest(g) AS term, unnest(range(len(g))) AS pos
  FROM (SELECT doc_id, {ngram('t', 2)} AS g FROM (SELECT doc_id, {tok('text')} AS t FROM documents)))"""

for _n in (1, 2):
    SQL[f"term_counts_{_n}"] = f"""SELECT term, count(*) AS cnt FROM (
  SELECT unnest({ngram('t', _n)}) AS term FROM (SELECT {tok('text')} AS t FROM documents))
GROUP BY term"""

SQL["top_terms"] = f"""WITH {JOBS},
{TITLE_REQUESTS},
mt AS (SELECT r.query_id, j.skills_extracts
       FROM req r JOIN (SELECT DISTINCT title FROM jobs) t ON {match('t.title', 'r.query', 0.9)}
       JOIN jobs j ON j.title = t.title),
cnt AS (SELECT query_id, term, count(*) AS cnt
        FROM (SELECT query_id, unnest({tok('skills_extracts')}) AS term FROM mt) GROUP BY query_id, term),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, term) AS rank FROM cnt
        QUALIFY rank <= 10)
SELECT query_id, rank, term, cnt,
       string_agg(term, ', ' ORDER BY rank) OVER (PARTITION BY query_id) AS skills_query
FROM top"""

SQL["idf"] = f"""WITH {INDEX}
SELECT term, df, round(idf, 9) AS idf FROM voc"""

SQL["course_index"] = f"""WITH {INDEX}
SELECT course_id, term, tf, round(weight, 9) AS weight FROM post"""

SQL["score_courses"] = f"""WITH {INDEX},
qtf AS (SELECT item_id AS query_id, term, count(*) AS tf
        FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY item_id, term),
qv AS (SELECT query_id, term,
              tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) AS qweight
       FROM qtf JOIN voc USING (term))
SELECT query_id, course_id, round(sum(qweight * weight), 9) AS score
FROM qv JOIN post USING (term) GROUP BY query_id, course_id"""

SQL["match_title"] = f"""WITH {JOBS}
SELECT job_id, title FROM jobs WHERE {match('title', "'red plate'", 0.9)}"""

SQL["match_titles_batch"] = f"""WITH req AS (
  SELECT min(p_partkey) AS query_id, string_split(p_name, ' ')[-1] AS query FROM part GROUP BY 2)
SELECT r.query_id, r.query, p.p_partkey AS job_id, p.p_name AS title
FROM req r JOIN part p ON {match('p.p_name', 'r.query', 0.7)}"""

SQL["keyword_filter"] = """SELECT p_partkey AS job_id, p_name AS title FROM part
WHERE contains(lower(p_name), lower('Plate'))"""

SQL["clean_html"] = f"SELECT page_id, {clean_html('html')} AS description FROM pages"


# --- M1 ------------------------------------------------------------------------

DICTIONARY = f"""btok AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
dict AS (SELECT DISTINCT unnest({ngram('t', 2)}) AS phrase FROM btok),
dic AS (SELECT phrase, pt, len(pt) AS m, len(list_distinct(pt)) AS d
        FROM (SELECT phrase, regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}_]+[+#]*') AS pt FROM dict)
        WHERE len(pt) > 0)"""


# M1's words: a run of word characters, the plus or number signs that close it, and a dot, number or at sign that
# opens it after white space or at the start. While words are cut, letters that no text holds stand for the openers.
OPENERS = {".": "\ua4f8", "#": "\ua4f9", "@": "\ua4fa"}
WORD_RE = r"[\p{L}\p{N}_]+[+#]*"
JOINED_RE = r"[\p{L}\p{N}_]+([&.-][\p{L}\p{N}_]+)*[+#]*"


def words(x: str, pattern: str = WORD_RE) -> str:
    s, back = f"lower({x})", "x"
    for sign, letter in OPENERS.items():
        s = f"regexp_replace({s}, '(^|[ \\t\\n\\f\\r])[{sign}]([\\p{{L}}\\p{{N}}_])', '\\1{letter}\\2', 'g')"
        back = f"replace({back}, '{letter}', '{sign}')"
    return f"list_transform(regexp_extract_all({s}, '{pattern}'), lambda x: {back})"


def skills_sql(docs: str, theta: float = 0.75) -> str:
    """CTEs ending in ``sk(doc_id, skills)`` for a CTE ``{docs}(doc_id, text)``; needs DICTIONARY."""
    return f"""dt1 AS (SELECT doc_id, {words('text')} AS t FROM {docs}),
dt2 AS (SELECT doc_id, {words('text', JOINED_RE)} AS t FROM {docs}),
dtk AS (SELECT * FROM dt1 UNION ALL SELECT * FROM dt2 WHERE EXISTS (SELECT 1 FROM dic WHERE regexp_matches(phrase, '[&.-]'))),
grams AS (SELECT doc_id, unnest(t) AS k FROM dtk
          UNION ALL SELECT doc_id, unnest({ngram('t', 2)}) AS k FROM dtk),
fullm AS (SELECT g.doc_id, d.phrase FROM grams g JOIN dic d ON g.k = array_to_string(d.pt, ' ')),
dtt AS (SELECT DISTINCT doc_id, unnest(t) AS token FROM dtk),
ptt AS (SELECT DISTINCT phrase, d, unnest(pt) AS token FROM dic WHERE m >= 2),
partm AS (SELECT dtt.doc_id, ptt.phrase FROM dtt JOIN ptt USING (token) WHERE length(token) > 1
          GROUP BY dtt.doc_id, ptt.phrase, ptt.d HAVING count(*) / ptt.d >= {theta}),
pairs AS (SELECT doc_id, phrase FROM fullm UNION SELECT doc_id, phrase FROM partm),
sk AS (SELECT x.doc_id, coalesce(array_to_string(list_sort(list(DISTINCT p.phrase)), ', '), '') AS skills
       FROM {docs} x LEFT JOIN pairs p ON p.doc_id = x.doc_id GROUP BY x.doc_id)"""


SQL["extract_skills"] = f"""WITH {DICTIONARY},
docs AS (SELECT doc_id, text FROM documents),
{skills_sql('docs')}
SELECT doc_id, skills FROM sk"""

SHORT_DICTIONARY = f"""btok AS (SELECT DISTINCT unnest({tok('text')}) AS t FROM benchmark),
dict AS (SELECT DISTINCT unnest([t[1], t[1] || '++', t || '###', t[1] || ' ' || t, '.' || t, t[1] || '&' || t,
                                 t[1] || '-' || t]) AS phrase FROM btok),
dic AS (SELECT phrase, pt, len(pt) AS m, len(list_distinct(pt)) AS d
        FROM (SELECT phrase, string_split(phrase, ' ') AS pt FROM dict))"""

SQL["extract_skills_short"] = f"""WITH {SHORT_DICTIONARY},
docs AS (SELECT doc_id, text FROM documents),
{skills_sql('docs')}
SELECT doc_id, skills FROM sk"""

SQL["clean_html_refs"] = f"""WITH p AS (SELECT page_id, '<p>x&#' || (page_id % 300) || ';y&#x' || upper(to_hex(page_id % 12400))
  || ';z&' || (['amp', 'AMP', 'nbsp', 'ensp', 'emsp', 'thinsp', 'Tab', 'NewLine', 'lt', 'hellip'])[page_id % 10 + 1]
  || ';w &#' || (page_id % 90 + 38) || ' &amp;lt; & &;</p>' || url AS html FROM pages)
SELECT page_id, {clean_html('html')} AS description FROM p"""

SQL["recommend_served"] = recommend_sql(TITLE_REQUESTS, (1, 2), 5)
SQL["recommend_pruned"] = SQL["recommend_served"]
SQL["top_terms_served"] = SQL["top_terms"]
SQL["top_terms_rolled"] = f"""WITH {JOBS},
req AS (SELECT min(p_partkey) AS query_id, string_split(p_name, ' ')[-1] AS query FROM part GROUP BY 2),
mtok AS (SELECT r.query_id, {tok('j.skills_extracts')} AS t
         FROM req r JOIN (SELECT DISTINCT title FROM jobs) t ON {match('t.title', 'r.query', 0.7)}
         JOIN jobs j ON j.title = t.title),
grams AS (SELECT query_id, 1::BIGINT AS n, unnest(t) AS term FROM mtok
          UNION ALL SELECT query_id, 2::BIGINT, unnest({ngram('t', 2)}) FROM mtok),
cnt AS (SELECT query_id, n, term, count(*) AS cnt FROM grams GROUP BY query_id, n, term)
SELECT query_id, n, row_number() OVER (PARTITION BY query_id, n ORDER BY cnt DESC, term) AS rank, term, cnt
FROM cnt QUALIFY rank <= 10"""

SUPPORTED = "(doc_id % 10 = 0 OR DATE '2022-06-01' + CAST(doc_id % 900 AS INTEGER) >= DATE '2024-01-15' - 365)"

# Pages as landed: page 0 twice, page 1 not at all, page 2 unreadable.
SQL["flow_summary"] = f"""WITH docs AS (
  SELECT 'jobs' AS flow, p_partkey AS id, p_partkey // 100 AS page, true AS kept, false AS odd FROM part
  UNION ALL
  SELECT 'courses', doc_id, doc_id // 100, {SUPPORTED} OR doc_id % 97 = 5, doc_id % 10 <> 0 AND doc_id % 97 = 5 FROM documents),
sound AS (SELECT * FROM docs WHERE page NOT IN (1, 2) UNION ALL SELECT * FROM docs WHERE page = 0),
tot AS (SELECT flow, count(*) AS total, count(DISTINCT page) FILTER (WHERE page = 2) AS cut,
               count(DISTINCT page) FILTER (WHERE page = 0) AS twice FROM docs GROUP BY flow),
gaps AS (SELECT flow, count(*) AS n FROM (SELECT flow, unnest(range(0, CAST(ceil(total / 100) AS BIGINT))) AS page FROM tot) e
         WHERE (flow, page) NOT IN (SELECT (flow, page) FROM sound) GROUP BY flow)
SELECT t.flow, '20240115' AS load_date, count(*) FILTER (WHERE s.kept) AS rows_in,
       count(DISTINCT s.id) FILTER (WHERE s.kept) AS unique_keys, 0::BIGINT AS null_keys,
       count(DISTINCT s.id) FILTER (WHERE s.kept) AS delta_rows, t.total AS reported_total,
       coalesce(any_value(g.n), 0) AS missing_pages, t.twice AS repeated_pages, t.cut AS bad_documents,
       count(*) FILTER (WHERE s.odd) AS unread_dates, t.cut AS quarantined
FROM tot t JOIN sound s USING (flow) LEFT JOIN gaps g USING (flow) GROUP BY t.flow, t.total, t.twice, t.cut"""

SQL["bronze_runs"] = """SELECT 'JOB-' || p_partkey AS job_id, p_name AS title, '20240115' AS load_date,
       (SELECT count(DISTINCT p_partkey // 100 % 2) FROM part) AS runs, true AS in_gold
FROM part"""

SQL["serving_capped"] = f"""WITH {JOBS},
cap AS (SELECT 'JOB-' || job_id AS jobPostId, title, skills_extracts FROM jobs ORDER BY jobPostId LIMIT 300),
w AS (SELECT title, count(DISTINCT term) AS words
      FROM (SELECT title, unnest({tok('skills_extracts')}) AS term FROM cap) GROUP BY title)
SELECT jobPostId, cap.title, coalesce(words, 0) AS words FROM cap LEFT JOIN w ON w.title = cap.title"""

SQL["feedback_once"] = """SELECT DISTINCT role AS Search_input, text AS Feedback, CAST(turn % 6 AS INTEGER) AS User_rating,
       5 AS Recommended_course_number, CASE WHEN turn > 2 THEN true END AS Show_score, stamp AS Timestamp
FROM conversations, (VALUES ('15/01/2024 10:30:00'), ('16/01/2024 09:00:00')) t(stamp)"""

SQL["jobs_newest_keyword"] = """SELECT 'JOB-' || p_partkey AS job_id, p_name AS title, '20240115' AS load_date FROM part
WHERE contains(lower(p_name), 'plate')
ORDER BY p_size DESC, 'JOB-' || p_partkey LIMIT 300"""

SQL["page_descriptions"] = f"""SELECT p.p_partkey AS job_id, {clean_html('g.html')} AS description,
  concat_ws(' ', array_to_string(string_split(p.p_name, ' '), ','), {clean_html('g.html')}) AS combined_description
FROM part p JOIN pages g ON g.page_id = p.p_partkey % (SELECT count(*) FROM pages)"""

# --- dates -----------------------------------------------------------------------

SQL["effective_since"] = """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 365 DAY"""

SQL["date_texts"] = """SELECT event_id, strftime(ts, '%Y%m%d') AS load_date, strftime(ts, '%Y-%b-%d_%H-%M-%S') AS stamp,
       strftime(ts, '%d/%m/%Y %H:%M:%S') AS shown_at,
       strftime(DATE '2024-01-31' - INTERVAL 365 DAY, '%Y%m%d') AS cutoff
FROM events"""

# --- de-dup / delta ----------------------------------------------------------------

SQL["dedupe_latest"] = """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_partkey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY l_partkey
                           ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC,
                                    l_returnflag DESC) = 1"""

SQL["distinct_keys"] = "SELECT count(*) AS rows_in, count(DISTINCT l_partkey) AS unique_keys FROM lineitem"

SQL["key_estimates"] = """SELECT strftime(ts, '%Y%m') AS month, count(*) AS rows, count(DISTINCT user_id) AS exact_keys,
       true AS within FROM events GROUP BY 1"""

SQL["batch_metrics"] = """SELECT count(*) AS rows_in, count(DISTINCT l_partkey) AS unique_keys,
       count(*) FILTER (WHERE l_partkey IS NULL) AS null_keys,
       count(DISTINCT l_partkey) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO'))
         AS delta_keys
FROM lineitem"""

SQL["delta_anti_diff_key"] = """SELECT c_custkey, c_name, c_mktsegment FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = '1-URGENT' AND o.o_custkey = c.c_custkey)"""

SQL["delta_anti_using"] = """SELECT doc_id, lang, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

SQL["missing_pages"] = """WITH pg AS (
  SELECT regexp_extract(url, '//([^/:?#]+)', 1) AS source,
         CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS page FROM pages),
tot AS (SELECT source, max((page + 1) * 100) AS total FROM pg GROUP BY source),
expected AS (SELECT source, unnest(range(0, CAST(ceil(total / 100) AS BIGINT))) AS page FROM tot)
SELECT source, page FROM expected e
WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.source = e.source AND pg.page = e.page)"""

# --- shaping ------------------------------------------------------------------------

SQL["flatten_nested"] = """SELECT 'JOB-' || p_partkey AS job_id, p_name AS title, p_brand AS company_name,
       'UEN' || p_size AS uen, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS employment_type,
       p_brand AS level, p_type AS category,
       CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice END AS salary_min,
       CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice + p_size END AS salary_max,
       CASE WHEN p_size > 45 THEN NULL ELSE 'Monthly' END AS salary_type,
       array_to_string(string_split(p_name, ' '), ',') AS skills, 'u' || p_partkey AS job_uuid
FROM part"""

SQL["pluck_first"] = """SELECT o.o_orderkey, list(l.l_partkey ORDER BY l.l_linenumber, l.l_partkey)[1] AS first_part,
       string_agg(CAST(l.l_partkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey) AS parts
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey"""

SQL["flatten_struct"] = """SELECT CAST(doc_id AS VARCHAR) AS c_referenceNumber, source AS c_title, lang AS c_content,
       CAST(NULL AS VARCHAR) AS c_outcome, source AS c_fieldOfStudies1,
       (SELECT count(*) FROM documents) AS total, CAST(NULL AS VARCHAR) AS c_not_there
FROM documents"""

SQL["array_text"] = """SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS plain,
       '[' || array_to_string(string_split(p_name, ' '), ', ') || ']' AS bracketed FROM part"""

SQL["course_concat"] = """SELECT p_partkey,
       p_name || p_brand || coalesce(CASE WHEN p_size > 45 THEN NULL ELSE p_type END, '') || p_type AS concat
FROM part"""

SQL["cast_all"] = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part"""

SQL["union_pages"] = """SELECT doc_id, lang, source FROM documents WHERE lang = 'en'
UNION ALL BY NAME
SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en'"""

SQL["array_union_skills"] = """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(
         string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))), ', ') AS skills FROM part"""

# --- order / limit -------------------------------------------------------------------

SQL["latest_n"] = """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
ORDER BY o_orderdate DESC, o_orderkey LIMIT 500"""

SQL["snapshot_limit"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10000"

SQL["table_bytes"] = """SELECT CAST(sum(octet_length(encode(CAST(p_partkey AS VARCHAR)))) AS BIGINT) AS p_partkey_bytes,
       CAST(sum(octet_length(encode(p_name))) AS BIGINT) AS p_name_bytes,
       CAST(sum(octet_length(encode(p_brand))) AS BIGINT) AS p_brand_bytes,
       CAST(sum(octet_length(encode(p_type))) AS BIGINT) AS p_type_bytes,
       CAST(sum(octet_length(encode(CAST(p_size AS VARCHAR)))) AS BIGINT) AS p_size_bytes,
       CAST(sum(octet_length(encode(CAST(p_retailprice AS VARCHAR)))) AS BIGINT) AS p_retailprice_bytes,
       CAST(sum(octet_length(encode(concat(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)))) AS BIGINT)
         AS total_bytes,
       count(*) AS rows FROM part"""

# --- sinks and flows ------------------------------------------------------------------

SQL["bronze_roundtrip"] = """SELECT event_id, user_id, event_type, value, strftime(ts, '%Y%m%d') AS load_date
FROM events WHERE strftime(ts, '%Y%m%d') = '20240115'"""

SQL["jobs_gold_load"] = f"""WITH {DICTIONARY},
base AS (SELECT 'JOB-' || p.p_partkey AS jobPostId, p.p_name AS title,
                array_to_string(string_split(p.p_name, ' '), ',') AS requiredSkills,
                {clean_html('g.html')} AS description
         FROM part p JOIN pages g ON g.page_id = p.p_partkey % (SELECT count(*) FROM pages)),
gj AS (SELECT *, concat_ws(' ', requiredSkills, description) AS combined_description FROM base),
docs AS (SELECT jobPostId AS doc_id, combined_description AS text FROM gj),
{skills_sql('docs')}
SELECT gj.jobPostId, gj.title, gj.requiredSkills, gj.description, gj.combined_description,
       sk.skills AS skills_extracts
FROM gj JOIN sk ON sk.doc_id = gj.jobPostId"""

SQL["courses_gold_load"] = f"""WITH {DICTIONARY},
docs AS (SELECT doc_id, text FROM documents),
{skills_sql('docs')}
SELECT CAST(d.doc_id AS VARCHAR) AS referenceNumber, d.source AS title, d.lang || '-' || d.doc_id AS seoName,
       d.text AS objective, d.lang AS content, CAST(NULL AS VARCHAR) AS outcome,
       CAST(NULL AS VARCHAR) AS specialisation, '[{{"name":"' || d.lang || '","code":"' || d.source || '"}}]' AS taggings, CAST(NULL AS VARCHAR) AS tags,
       CAST(NULL AS VARCHAR) AS areaOfTrainings, d.source AS fieldOfStudies1, CAST(NULL AS VARCHAR) AS fieldOfStudies2,
       CAST(NULL AS VARCHAR) AS skillsConnectReferenceNumber, CAST(NULL AS VARCHAR) AS skillsFrameworks,
       CAST(NULL AS VARCHAR) AS skillsFutureCreditReferenceNumber,
       d.text || d.source || d.source || d.lang AS concat, sk.skills AS SkillsTaxonomy
FROM documents d JOIN sk ON sk.doc_id = d.doc_id WHERE {SUPPORTED.replace('doc_id', 'd.doc_id')}"""

SQL["serving_export"] = f"""WITH {DICTIONARY},
docs AS (SELECT doc_id, text FROM documents),
{skills_sql('docs')}
SELECT CAST(d.doc_id AS VARCHAR) AS referenceNumber, d.source AS title, sk.skills AS combined_features,
       CAST(len(list_distinct({tok('sk.skills')})) AS BIGINT) AS n_terms, (SELECT count(*) FROM part) AS n_jobs
FROM documents d JOIN sk ON sk.doc_id = d.doc_id WHERE {SUPPORTED.replace('doc_id', 'd.doc_id')}"""

SQL["stream_feedback_once"] = """SELECT DISTINCT role AS Search_input, text AS Feedback, CAST(turn % 6 AS INTEGER) AS User_rating,
       5 AS Recommended_course_number, true AS Show_score, '15/01/2024 10:30:00' AS Timestamp FROM conversations"""

SQL["feedback_append"] = """SELECT CASE WHEN turn = 0 THEN NULL ELSE 'conv ' || conv_id END AS Search_input,
       text AS Feedback, CAST(turn % 6 AS INTEGER) AS User_rating,
       CAST(conv_id % 6 + 5 AS INTEGER) AS Recommended_course_number, turn % 2 = 0 AS Show_score,
       '15/01/2024 10:30:00' AS Timestamp
FROM conversations WHERE role = 'user'"""

SQL["stream_bronze_ingest"] = SQL["flatten_nested"].replace(
    "'u' || p_partkey AS job_uuid", "'u' || p_partkey AS job_uuid, '20240115' AS load_date")

SQL["stream_feedback"] = """SELECT 'conv ' || conv_id AS Search_input, text AS Feedback, CAST(turn % 6 AS INTEGER) AS User_rating,
       5 AS Recommended_course_number, true AS Show_score, '15/01/2024 10:30:00' AS Timestamp
FROM conversations WHERE role = 'user'"""
