"""DuckDB SQL with the meaning of each registered query, written from the definitions.

Queries are assembled from named table expressions; each states the rule on its
own (windows by position, ranks by window functions) rather than following the
Spark form.
"""

from __future__ import annotations

from passagemill import values as V
from passagemill.operators.answers import ENGLISH as W
from passagemill.operators.encoding import HASH_DIM
from passagemill.plans import fixtures as D


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- Expressions ------------------------------------------------------------

def strip(x: str) -> str:
    return f"trim({x}, {lit(V.WHITESPACE)})"


def norm(x: str) -> str:
    nbsp = f"replace(coalesce({x}, ''), chr(160), ' ')"
    return strip(
        f"regexp_replace(regexp_replace({nbsp}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    )


def flat(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{V.WS}]+', ' ', 'g'))"


def cut(f: str, n: int) -> str:
    """Of a flattened text."""
    return (
        f"CASE WHEN length({f}) <= {n} THEN {f} "
        f"ELSE rtrim(substr({f}, 1, {n}), {lit(V.WHITESPACE)}) || '{V.ELLIPSIS}' END"
    )


def summary(f: str, n: int) -> str:
    """Of a flattened text: RE2 has no look-behind, so mark the breaks first."""
    parts = (
        f"list_filter(string_split(regexp_replace({f}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda s: length(s) > {V.SUMMARY_MIN_SENTENCE})"
    )
    return (
        f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}[1:{n}], ' ') "
        f"ELSE {cut(f, V.SUMMARY_SNIP)} END"
    )


def words(x: str, n: int = V.MIN_KEYWORD_LEN) -> str:
    split = f"string_split_regex(lower(coalesce({x}, '')), '[^{V.WORD_CHARS}]+')"
    return f"list_filter({split}, lambda w: length(w) >= {n})"


def keywords(x: str, cap: int | None = None) -> str:
    w = words(x)
    first = f"list_filter({w}, lambda w, i: list_position({w}, w) = i)"
    return first if cap is None else f"{first}[1:{cap}]"


def mark(text: str, kws: str) -> str:
    ordered = f"list_sort(list_transform({kws}, lambda k: {{'l': -length(k), 'k': k}}))"
    pattern = f"'(?i)(' || array_to_string(list_transform({ordered}, lambda s: s.k), '|') || ')'"
    return (
        f"CASE WHEN coalesce(len({kws}), 0) = 0 THEN {text} "
        f"ELSE regexp_replace({text}, {pattern}, '<mark>\\1</mark>', 'g') END"
    )


def occurs(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)})"


def noise(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    return (
        f"(length({t}) < 60 OR {occurs(t, '|')} > 25 OR {occurs(t, '+')} > 25 "
        f"OR ({occurs(t, '| |')} > 10 AND contains({t}, '+')))"
    )


def doc_id(kind: str, url: str, title: str, text: str) -> str:
    return f"substr(sha1({kind} || '|' || {url} || '|' || {title} || '|' || substr(sha1({text}), 1, 10)), 1, 16)"


def has_kw(text: str, kws: str) -> str:
    return f"(len({kws}) = 0 OR len(list_filter({kws}, lambda k: contains(lower({text}), k))) >= 1)"


def cites(x: str, k: str) -> str:
    found = f"list_transform(regexp_extract_all({x}, '\\[([0-9]{{1,2}})\\]', 1), lambda s: s::INT)"
    return f"list_sort(list_distinct(list_filter({found}, lambda n: n >= 1 AND n <= {k})))"


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def ensured(answer: str, used: str) -> str:
    body = strip(answer)
    listed = (
        f"CASE WHEN len({used}) > 0 THEN array_to_string(list_transform({used}, lambda n: '[' || n || ']'), ', ') "
        f"ELSE {lit(W.no_sources)} END"
    )
    return (
        f"CASE WHEN regexp_matches({answer}, '(?i)\\b{W.sources_label}\\b[{V.WS}]*:') THEN {body} "
        f"ELSE {strip(f'({body} || chr(10) || chr(10) || {lit(f"**{W.sources_label.capitalize()}:** ")} || ({listed}))')} END"
    )


def gone(html: str, *tags: str) -> str:
    for t in tags:
        html = f"regexp_replace({html}, '(?is)<{t}\\b[^<>]*>.*?(?:</{t}\\s*>|\\z)', '', 'g')"
    return html


def body_of(html: str, tag: str) -> str:
    return f"regexp_extract({html}, '(?is)<{tag}\\b[^<>]*>(.*?)(?:</{tag}\\s*>|\\z)', 1)"


def nodes(html: str) -> str:
    text = "n"
    # references of the given pages and other common ones; the ampersand comes last
    for name, value in (
        ("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'"), ("&apos;", "\'"),
        ("&copy;", "\xa9"), ("&reg;", "\xae"), ("&middot;", "\xb7"), ("&laquo;", "\xab"), ("&raquo;", "\xbb"),
        ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{name}', {lit(value)})"
    split = f"string_split_regex({html}, '<[/a-zA-Z!?][^<>]*>')"
    return (
        f"array_to_string(list_filter(list_transform({split}, lambda n: {strip(text)}), "
        f"lambda n: n <> ''), chr(10))"
    )


def page_lines(x: str) -> str:
    split = f"string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    kept = (
        f"list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: length(s) >= 2 "
        f"AND {occurs('s', '|')} <= 10 AND {occurs('s', '+')} <= 10 "
        f"AND NOT regexp_matches(s, '\\|[{V.WS}]*\\|[{V.WS}]*\\+'))"
    )
    return norm(f"array_to_string({kept}, chr(10))")


def parts(text: str, size: int, overlap: int) -> str:
    """Window starts of a normalised text, one row each."""
    return f"unnest(range(0, greatest(length({text}) - {overlap}, 1), {size - overlap}))"


# --- Table expressions ------------------------------------------------------

def docs_sql(url: str) -> str:
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.TYPE_BY_LANG.items())
    return f"""
    SELECT doc_id AS row_id, CASE lang {kinds} ELSE 'other' END AS source_type, {url} AS url,
           substr(string_split(text, chr(10))[1], 1, 60) AS title, text AS raw_text,
           CAST(DATE '2024-01-01' + CAST(n_chars % 60 AS INT) AS VARCHAR) AS date,
           CASE WHEN lang = 'es' AND n_chars >= 1000 THEN source || '/' || doc_id || '.txt' END AS file_name,
           CASE WHEN lang = 'es' AND n_chars >= 500 AND n_chars < 1000
                THEN source || '/' || doc_id || '.txt' END AS saved_as
    FROM documents"""


def chunk_sql(source: str) -> str:
    """Chunks of a table with row_id, source_type, url, title, raw_text, date."""
    return f"""
    SELECT *, printf('%s_%s_%03d', source_type, doc_id, part) AS chunk_id FROM (
      SELECT * EXCLUDE (w, start), w AS text, row_number() OVER (PARTITION BY row_id ORDER BY start) - 1 AS part
      FROM (
        SELECT * EXCLUDE (body), {strip(f'substr(body, start + 1, {V.CHUNK_SIZE})')} AS w FROM (
          SELECT *, {parts('body', V.CHUNK_SIZE, V.CHUNK_OVERLAP)} AS start FROM (
            SELECT * EXCLUDE (raw_text), {doc_id('source_type', 'url', 'title', 'body')} AS doc_id FROM (
              SELECT * REPLACE ({strip("coalesce(nullif(title, ''), nullif(" + strip('url') + ", ''), 'document')")} AS title,
                                {strip('url')} AS url),
                     {norm('raw_text')} AS body
              FROM {source}) WHERE body <> ''))
      ) WHERE w <> '')"""


CTE: dict[str, str] = {
    "docs": docs_sql("'https://' || source || '.example.org/' || doc_id"),
    "copies": docs_sql("'https://' || lang || '.example.org/'"),
    "chunks": chunk_sql("docs"),
    "copy_chunks": chunk_sql("copies"),
    "qs": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "rules": """
    SELECT min(item_id) OVER (PARTITION BY text) AS query_id, text AS query,
           CASE WHEN item_id % 3 = 1 THEN substr(text, 20, 30) ELSE '' END AS m_text,
           CASE WHEN item_id % 3 = 2 THEN 'web' END AS m_type,
           CASE item_id % 3 WHEN 0 THEN 'https://src' || (item_id % 20) || '.example.org/'
                            WHEN 2 THEN 'example.org/' ELSE '' END AS m_url
    FROM benchmark""",
    "chunk_terms": f"""
    SELECT chunk_id, term, count(*) AS tf FROM (
      SELECT chunk_id, unnest({words('text')}) AS term FROM chunks) GROUP BY ALL""",
    "query_terms": f"""
    SELECT query_id, term, count(*) AS tf FROM (
      SELECT query_id, unnest({words('query')}) AS term FROM qs) GROUP BY ALL""",
    "pairs": f"""
    SELECT d.query_id, d.chunk_id,
           round(d.dot / sqrt(cn.norm2::DOUBLE * qn.norm2::DOUBLE), 6) AS score
    FROM (SELECT query_id, chunk_id, sum(q.tf * c.tf)::DOUBLE AS dot
          FROM query_terms q JOIN chunk_terms c USING (term) GROUP BY ALL) d
    JOIN (SELECT chunk_id, sum(tf * tf)::BIGINT AS norm2 FROM chunk_terms GROUP BY ALL) cn USING (chunk_id)
    JOIN (SELECT query_id, sum(tf * tf)::BIGINT AS norm2 FROM query_terms GROUP BY ALL) qn USING (query_id)""",
    "found": f"""
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM (
      SELECT p.query_id, q.query, p.score, p.first_rank, c.* FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first_rank
        FROM pairs) p
      JOIN qs q USING (query_id) JOIN chunks c USING (chunk_id)
      WHERE p.first_rank <= {V.internal_k()} AND p.score >= {D.LEXICAL_MIN_SCORE})
    WHERE NOT {noise('text')}
      AND ({has_kw('text', keywords('query'))}
           OR {has_kw("coalesce(title, '') || ' ' || coalesce(url, '')", keywords('query'))})""",
    "top": f"SELECT * FROM found WHERE rank <= {V.TOP_K}",
    "lenient": """
    SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM (
      SELECT *, bool_or(source_type = 'web') OVER (PARTITION BY query_id) AS any_ok FROM found)
    WHERE source_type = 'web' OR NOT any_ok""",
    "lenient_two": """
    SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM (
      SELECT *, bool_or(source_type IN ('web', 'local')) OVER (PARTITION BY query_id) AS any_ok FROM found)
    WHERE source_type IN ('web', 'local') OR NOT any_ok""",
    "messages": f"""
    SELECT 'ch' || (conv_id % 10) AS channel, conv_id * 8 + turn AS msg_id, ts, event_type,
           coalesce(value > 10, false) AS has_media, role <> 'system' AS is_message,
           json_extract(props, '$.k')::INT AS views,
           'tg:ch' || (conv_id % 10) || ':' || (conv_id * 8 + turn) AS message_key,
           CASE WHEN event_type IS DISTINCT FROM 'view' AND {strip('text')} <> '' THEN {strip('text')}
                WHEN coalesce(value > 10, false) THEN {lit(V.MEDIA_PLACEHOLDER)} ELSE '' END AS text
    FROM conversations LEFT JOIN events ON event_id = conv_id * 8 + turn""",
    "known": "SELECT DISTINCT message_key FROM messages WHERE event_type = 'purchase' AND text <> ''",
    "classified": f"""
    SELECT *, CASE WHEN NOT is_message OR ts < TIMESTAMP '2024-01-03' - INTERVAL {D.SINCE_DAYS} DAY THEN 'skipped'
                   WHEN message_key IN (FROM known) THEN 'duplicate'
                   WHEN text = '' THEN 'empty' ELSE 'kept' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC NULLS LAST, msg_id DESC) AS place
          FROM messages) WHERE place <= {D.CHANNEL_CAP}""",
    "message_parts": f"""
    SELECT * EXCLUDE (w, start), w AS part_text,
           row_number() OVER (PARTITION BY message_key ORDER BY start) - 1 AS part FROM (
      SELECT *, {strip(f'substr(body, start + 1, {V.MESSAGE_CHUNK_SIZE})')} AS w FROM (
        SELECT *, {parts('body', V.MESSAGE_CHUNK_SIZE, V.MESSAGE_CHUNK_OVERLAP)} AS start FROM (
          SELECT *, {norm('text')} AS body, 'https://t.me/' || channel || '/' || msg_id AS url,
                 'Telegram: ' || channel || ' / ' || msg_id AS title FROM messages) WHERE body <> ''))
    WHERE w <> ''""",
    "message_chunks": f"""
    SELECT *, printf('%s_%s_%03d', 'msg', {doc_id("'msg'", 'url', 'title', 'body')}, part) AS chunk_id
    FROM message_parts""",
    "new_messages": """
    SELECT c.* FROM message_chunks c JOIN classified k USING (message_key) WHERE k.status = 'kept'""",
    "shown": f"""
    SELECT page_id, {strip('url')} AS url, html,
           {gone("regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')", 'script', 'style', 'noscript')} AS shown
    FROM pages""",
    "framed": f"""
    SELECT *, {gone('shown', 'nav', 'header', 'footer', 'aside', 'form')} AS framed FROM shown""",
    "page_texts": f"""
    SELECT page_id, url, html,
           {nodes(f"CASE WHEN regexp_matches(shown, '(?i)<main\\b[^<>]*>') THEN {body_of('shown', 'main')} ELSE shown END")} AS visible,
           {nodes(f"CASE WHEN {body_of('framed', 'article')} <> '' THEN {body_of('framed', 'article')} ELSE {body_of('framed', 'main')} END")} AS main
    FROM framed""",
    "page_clean": f"""
    SELECT page_id, url, html, {page_lines('CASE WHEN length(main) >= 200 THEN main ELSE visible END')} AS raw_text
    FROM page_texts""",
    "page_ok": f"""
    SELECT *, coalesce(nullif({flat("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, ''), url) AS title,
           CASE WHEN url = '' THEN 'skipped'
                WHEN length(raw_text) >= {V.PAGE_MIN_CHARS} AND NOT contains(lower(raw_text), ' und ')
                     AND (contains(lower(raw_text), ' the ') OR contains(lower(raw_text), ' que ')) THEN 'ok'
                ELSE 'skipped' END AS status
    FROM page_clean""",
    "page_chunks": f"""
    SELECT * EXCLUDE (w, start), w AS text, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS part FROM (
      SELECT *, {strip(f'substr(body, start + 1, {V.CHUNK_SIZE})')} AS w FROM (
        SELECT *, {parts('body', V.CHUNK_SIZE, V.CHUNK_OVERLAP)} AS start FROM (
          SELECT *, {norm('raw_text')} AS body FROM page_ok WHERE status = 'ok') WHERE body <> ''))
    WHERE w <> ''""",
    "new_pages": """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY page_id, part) AS copy FROM (
        SELECT *, printf('web_web::%s_%03d', url, part) AS chunk_id FROM page_chunks))
    WHERE copy = 1 AND NOT contains(url, '/en/')""",
    "page_log": """
    SELECT o.page_id, o.url, o.status,
           CASE WHEN o.status = 'skipped' AND o.url <> '' THEN 'not_relevant_or_too_short' END AS reason,
           (SELECT count(*) FROM page_chunks c WHERE c.page_id = o.page_id) AS chunks,
           count(n.chunk_id) AS added
    FROM page_ok o LEFT JOIN new_pages n USING (page_id) GROUP BY ALL""",
    "message_counts": """
    SELECT channel, count(*) AS processed, count(*) FILTER (status = 'skipped') AS skipped,
           count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'empty') AS "empty",
           (SELECT count(*) FROM new_messages n WHERE n.channel = c.channel) AS added
    FROM classified c GROUP BY channel""",
    "judged": """
    SELECT r.query_id, r.query, f.rank, f.score, f.url, f.source_type,
           f.rank IS NOT NULL
           AND (contains(lower(coalesce(f.text, '')), lower(r.m_text)) OR contains(lower(coalesce(f.title, '')), lower(r.m_text)))
           AND (r.m_type IS NULL OR lower(f.source_type) = r.m_type)
           AND contains(lower(coalesce(f.url, '')), r.m_url) AS hit
    FROM rules r LEFT JOIN found f USING (query_id)""",
    "lab": f"""
    SELECT l.doc_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(l.doc_id AS INT)), '%Y-%m-%d %H:%M:%S') AS ts,
           d.title AS query, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE -1 END AS rating,
           CASE WHEN toxic = 1 THEN 'bad_answer' WHEN quality = 0 THEN 'bad_retrieval' ELSE 'good' END AS verdict,
           ' seen ' || l.doc_id AS comment
    FROM labels l LEFT JOIN docs d ON d.row_id = l.doc_id""",
    "completed": """
    SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'timeout' END AS error,
           CASE WHEN query_id % 7 = 0 THEN cited || ' Sadly the passages do not say.'
                WHEN query_id % 11 = 0 THEN text
                WHEN query_id % 13 = 0 THEN cited || chr(10) || 'Sources : [1]' ELSE cited END AS answer
    FROM (SELECT *, conv_id * 8 + turn AS query_id, text || ' [' || (turn % 9) || '] [' || (conv_id % 9) || ']' AS cited
          FROM conversations WHERE role = 'assistant')""",
    "vec_index": """
    SELECT 'vec_' || e.vec_id AS chunk_id, d.raw_text AS text, d.title, d.source_type, d.url,
           e.embedding::DOUBLE[] AS v
    FROM embeddings e JOIN docs d ON d.row_id = e.vec_id""",
    "means": """
    SELECT label, list(m ORDER BY i) AS v FROM (
      SELECT label, i, avg(x::DOUBLE) AS m FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
      GROUP BY label, i) GROUP BY label""",
    "vec_pairs": """
    SELECT m.label::BIGINT AS query_id, b.text AS query, x.chunk_id, x.text, x.title, x.url,
           round(list_inner_product(m.v, x.v) / sqrt(list_inner_product(m.v, m.v)), 6) AS score
    FROM means m LEFT JOIN benchmark b ON b.item_id = m.label CROSS JOIN vec_index x""",
}

DEPENDS: dict[str, tuple[str, ...]] = {
    "chunks": ("docs",), "copy_chunks": ("copies",), "chunk_terms": ("chunks",), "query_terms": ("qs",),
    "pairs": ("chunk_terms", "query_terms"), "found": ("pairs", "qs", "chunks"), "top": ("found",),
    "lenient": ("found",), "lenient_two": ("found",), "known": ("messages",),
    "classified": ("messages", "known"), "message_parts": ("messages",),
    "message_chunks": ("message_parts",), "new_messages": ("message_chunks", "classified"),
    "framed": ("shown",), "page_texts": ("framed",), "page_clean": ("page_texts",),
    "page_ok": ("page_clean",), "page_chunks": ("page_ok",), "new_pages": ("page_chunks",),
    "page_log": ("page_ok", "new_pages", "page_chunks"), "message_counts": ("classified", "new_messages"),
    "judged": ("rules", "found"), "lab": ("docs",),
    "vec_index": ("docs",), "vec_pairs": ("means", "vec_index"),
}


def add(name: str, depends: tuple[str, ...], sql: str) -> None:
    CTE[name] = sql
    DEPENDS[name] = depends


def with_ctes(sql: str, *names: str) -> str:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for needed in DEPENDS.get(name, ()):
            visit(needed)
        seen.append(name)

    for name in names:
        visit(name)
    if not seen:
        return sql.strip()
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in seen)
    return f"WITH {heads}\n{sql.strip()}"


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, *names: str) -> None:
    ORACLE[name] = with_ctes(sql, *names)


# --- Text and identity ------------------------------------------------------

oracle("normalize_ws", f"SELECT doc_id, {norm('text')} AS text FROM documents")
oracle("flatten_text", f"SELECT doc_id, {flat('text')} AS text FROM documents")
oracle("snip", f"SELECT doc_id, {cut('f', V.SNIP)} AS text FROM (SELECT doc_id, {flat('text')} AS f FROM documents)")
oracle("short_summary", f"""
SELECT doc_id, {summary('f', 2)} AS two, {summary('f', 1)} AS one
FROM (SELECT doc_id, {flat('text')} AS f FROM documents)""")
oracle("query_keywords", f"SELECT item_id, unnest(list_distinct({words('text')})) AS keyword FROM benchmark")
oracle("query_keywords_ordered",
       f"SELECT item_id, array_to_string({keywords('text', 12)}, ' ') AS keywords FROM benchmark")
oracle("doc_ids", f"""
SELECT row_id, sha1(t) AS content_hash, {doc_id('source_type', 'url', 'title', 't')} AS doc_id
FROM (SELECT *, {norm('raw_text')} AS t FROM docs)""", "docs")
oracle("highlight", f"""
SELECT conv_id, turn, {mark('text', 'kws')} AS text FROM (
  SELECT c.conv_id, c.turn, c.text, {keywords('f.text', 12)} AS kws
  FROM conversations c LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) f USING (conv_id))""")
oracle("channel_handle", f"""
SELECT msg_id, line,
       {strip(f"trim(trim({strip('''replace(replace(replace(line, 'https://t.me/', ''), 'http://t.me/', ''), 't.me/', '')''')}, '@'), '/')")} AS handle,
       try_cast(line AS BIGINT) AS number
FROM (SELECT msg_id, unnest([form, '@extra/', msg_id::VARCHAR]) AS line FROM (
  SELECT conv_id * 8 + turn AS msg_id,
         CASE role WHEN 'user' THEN 'https://t.me/ch' || (conv_id % 10)
                   WHEN 'assistant' THEN '@ch' || (conv_id % 10)
                   ELSE 't.me/ch' || (conv_id % 10) || '/' END AS form
  FROM conversations))""")
oracle("mask_secret", f"""
SELECT CASE WHEN length(w) <= 4 THEN repeat('*', length(w))
            ELSE left(w, 2) || repeat('*', length(w) - 4) || right(w, 2) END AS masked, count(*) AS n
FROM (SELECT unnest({words('text', 1)}) AS w FROM documents) GROUP BY 1""")
oracle("redact_logs", f"""
SELECT doc_id, r AS text, r <> text AS changed FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(text,
    '(?i)password[{V.WS}]*=[{V.WS}]*[^{V.WS}]+', 'password=***', 'g'),
    '(?i)token[{V.WS}]*=[{V.WS}]*[^{V.WS}]+', 'token=***', 'g') AS r FROM documents)""")
oracle("ensure_sources", f"SELECT query_id, {ensured('answer', cites('answer', '6'))} AS answer FROM completed",
       "completed")
oracle("parse_citations", f"""
SELECT conv_id, turn, {ints(cites('t', '6'))} AS used FROM (
  SELECT conv_id, turn, text || ' [' || (turn % 9) || '] [0' || (conv_id % 9) || '] [333]' AS t FROM conversations)""")

# --- Pages ------------------------------------------------------------------

oracle("page_titles", f"""
SELECT page_id, coalesce(nullif({flat("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, ''), url) AS title
FROM pages""")
oracle("page_text", "SELECT page_id, visible AS text FROM page_texts", "page_texts")
oracle("page_main_text", "SELECT page_id, main AS text FROM page_texts", "page_texts")
oracle("clean_lines", f"SELECT doc_id, {page_lines('text')} AS text FROM documents")
oracle("page_relevance", "SELECT page_id, status = 'ok' AS relevant FROM page_ok", "page_ok")

# --- Filters ----------------------------------------------------------------

oracle("keyword_filter", f"""
SELECT row_id, turn FROM (
  SELECT d.*, c.turn, {keywords('c.text')} AS kws FROM docs d LEFT JOIN conversations c ON c.conv_id = d.row_id)
WHERE {has_kw('raw_text', 'kws')} OR {has_kw("title || ' ' || url", 'kws')}""", "docs")
oracle("noise_filter", f"SELECT chunk_id, part FROM chunks WHERE NOT {noise('text')}", "chunks")
oracle("filter_results", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id
FROM found WHERE lower(source_type) IN ('web', 'portal')""", "found")
add("scope", ("chunks",), "SELECT DISTINCT doc_id FROM chunks WHERE row_id IN (SELECT doc_id FROM labels)")
oracle("filter_scope", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id
FROM found WHERE source_type IN ('web', 'local') AND doc_id IN (FROM scope)""", "found", "scope")
oracle("filter_fallback", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id FROM (
  SELECT *, bool_or(doc_id IN (FROM scope)) OVER (PARTITION BY query_id) AS any_in FROM lenient)
WHERE NOT any_in OR doc_id IN (FROM scope)""", "lenient", "scope")

# --- Corpus -----------------------------------------------------------------

oracle("chunk_docs", """
SELECT chunk_id, part, text, title, source_type, url, date, doc_id, source_type AS extra_type, file_name
FROM chunks""", "chunks")
oracle("dedup_chunks", """
SELECT chunk_id, row_id, part FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id, part) AS copy FROM copy_chunks)
WHERE copy = 1 AND chunk_id NOT IN (
  SELECT chunk_id FROM copy_chunks WHERE row_id IN (SELECT doc_id FROM labels))""", "copy_chunks")
oracle("dedup_messages", """
SELECT DISTINCT message_key FROM messages WHERE message_key NOT IN (FROM known)""", "messages", "known")
oracle("known_keys", """
SELECT DISTINCT 'doc_id' AS key, doc_id AS value FROM chunks
UNION ALL SELECT DISTINCT 'file_name', file_name FROM chunks WHERE file_name IS NOT NULL
UNION ALL SELECT DISTINCT 'saved_as', saved_as FROM chunks WHERE saved_as IS NOT NULL""", "chunks")
# Each document adds an array line (no record), a record with a foreign key, one with
# a repeated key and one with NaN.
oracle("stats_by_type", """
SELECT CASE WHEN source_type = 'portal' AND NOT odd THEN 'other' ELSE source_type END AS source_type, count(*) AS n
FROM (SELECT source_type, unnest(CASE WHEN part = 0 THEN [false, true, false, false] ELSE [false] END) AS odd FROM chunks)
GROUP BY 1""", "chunks")
oracle("stats_by_date", "SELECT date, count(*) AS n FROM chunks GROUP BY date", "chunks")
oracle("doc_labels", """
SELECT doc_id, coalesce(arg_min(file_name, chunk_id), arg_min(saved_as, chunk_id), doc_id) AS label
FROM chunks WHERE source_type = 'local' GROUP BY doc_id""", "chunks")
oracle("jsonl_scan", """
SELECT chunk_id, CASE WHEN source_type <> 'portal' OR odd THEN source_type END AS source_type, length(text) AS chars
FROM (SELECT *, unnest(CASE WHEN part = 0 THEN [false, true, false, false] ELSE [false] END) AS odd FROM chunks)""", "chunks")
oracle("chunk_scan_strict", """
SELECT chunk_id, source_type,
       2 + (file_name IS NOT NULL)::BIGINT + (saved_as IS NOT NULL)::BIGINT AS n_extra
FROM (SELECT *, unnest(CASE WHEN part = 0 THEN [1, 2] ELSE [1] END) FROM chunks)
WHERE source_type <> 'portal'""", "chunks")
oracle("log_tail", "SELECT doc_id, ts, query, verdict FROM lab ORDER BY ts DESC, doc_id DESC LIMIT 50", "lab")
oracle("value_scan", """
SELECT chunk_id, unnest(CASE WHEN part = 0 THEN ['OBJECT', 'ARRAY', 'OBJECT', NULL, NULL] ELSE ['OBJECT'] END) AS kind
FROM chunks""", "chunks")
oracle("overwrite_chunks", """
SELECT chunk_id, sha1(text) AS text_hash, title, source_type, url, date, file_name
FROM chunks WHERE source_type <> 'portal'""", "chunks")
add("word_places", ("chunks",), f"""
SELECT chunk_id, ('0x' || substr(h, 1, 8))::BIGINT % {HASH_DIM} AS place,
       sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS x
FROM (SELECT chunk_id, sha1(unnest({words('text', 1)})) AS h FROM chunks) GROUP BY ALL""")
add("vectors", ("word_places", "chunks"), f"""
SELECT chunk_id, string_agg(floor(coalesce((x / nullif(length, 0))::FLOAT, 0)::DOUBLE * 100000 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY place) AS shown,
       CASE WHEN any_value(length) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
FROM (SELECT c.chunk_id, p.place, coalesce(w.x, 0) AS x, coalesce(l.length, 0) AS length
      FROM chunks c JOIN (SELECT unnest(range({HASH_DIM})) AS place) p ON true
      LEFT JOIN word_places w ON w.chunk_id = c.chunk_id AND w.place = p.place
      LEFT JOIN (SELECT chunk_id, sqrt(sum(x * x)) AS length FROM word_places GROUP BY chunk_id) l ON l.chunk_id = c.chunk_id)
GROUP BY chunk_id""")
oracle("encode_hash", "SELECT chunk_id, shown AS embedding FROM vectors", "vectors")
oracle("build_index", f"""
SELECT chunk_id, {HASH_DIM}::BIGINT AS dim, norm, sha1(shown) AS vector_hash FROM vectors""", "vectors")

# --- Search -----------------------------------------------------------------

oracle("vector_normalize", """
SELECT vec_id, array_to_string(list_transform(v, lambda x:
         CAST(CAST(round(x / sqrt(list_inner_product(v, v)), 5) AS DECIMAL(9, 5)) AS VARCHAR)), ',') AS unit
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings)""")
VECTOR_SEARCH = f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank, chunk_id, score, title FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first_rank FROM vec_pairs)
WHERE first_rank <= {V.internal_k()} AND score >= {D.VECTOR_MIN_SCORE} AND NOT {noise('text')}
  AND ({has_kw("coalesce(text, '')", keywords('query'))}
       OR {has_kw("coalesce(title, '') || ' ' || coalesce(url, '')", keywords('query'))})"""
oracle("vector_search", VECTOR_SEARCH, "vec_pairs")
oracle("vector_search_blocks", VECTOR_SEARCH, "vec_pairs")
oracle("lexical_search", "SELECT query_id, rank, chunk_id, score FROM found", "found")

add("reranked_all", ("found",), f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS new_rank FROM (
  SELECT *, round(score + CASE WHEN len(kws) > 0 THEN
      len(list_filter(kws, lambda k: contains(lower(text), k)))::DOUBLE / len(kws) ELSE 0 END, 6) AS new_score
  FROM (SELECT *, {keywords('query')} AS kws FROM found) WHERE rank <= {V.RERANK_TOP_N})""")
add("reranked_two", ("lenient_two",), CTE["reranked_all"].replace("FROM found", "FROM lenient_two"))
add("best", ("reranked_two",), f"""
SELECT * REPLACE (new_rank AS rank, new_score AS score) FROM reranked_two WHERE new_rank <= {V.TOP_K}""")

oracle("rerank", f"""
SELECT query_id, new_rank AS rank, chunk_id, new_score AS score FROM reranked_all WHERE new_rank <= {V.TOP_K}""",
       "reranked_all")
oracle("retrieval_debug", f"""
SELECT query_id, coalesce(a.n, 0) AS after_search, coalesce(b.n, 0) AS after_filters,
       CASE WHEN b.n IS NULL THEN 0 ELSE least(b.n, {V.TOP_K}) END AS returned, {V.internal_k()} AS internal_k, 'index' AS mode,
       {D.LEXICAL_MIN_SCORE}::DOUBLE AS min_score, true AS keyword_filter
FROM qs LEFT JOIN (SELECT query_id, count(*) AS n FROM found GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM lenient GROUP BY 1) b USING (query_id)""", "qs", "found", "lenient")

# --- Answers ----------------------------------------------------------------


def source_line() -> str:
    title = flat("coalesce(nullif(title, ''), 'source')")
    return (
        f"'[' || rank || '] [' || replace(replace({title}, '[', '('), ']', ')') || '](' || coalesce(url, '') || "
        f"') — `' || coalesce(nullif(source_type, ''), 'unknown') || '` • ' || coalesce(date, '') || "
        f"' • score=' || CAST(CAST(round(CAST(score AS DECIMAL(18, 6)), 3) AS DECIMAL(18, 3)) AS VARCHAR)"
    )


def answer_ctes(prefix: str, results: str) -> None:
    """Source lines, bullets and answers over a table of ranked results."""
    add(f"{prefix}_lines", (results,), f"""
    SELECT query_id, string_agg({source_line()}, chr(10) ORDER BY rank) AS sources
    FROM {results} WHERE rank <= 5 GROUP BY query_id""")
    add(f"{prefix}_summaries", (results,), f"""
    SELECT query_id, rank, CASE WHEN rank = 1 THEN {summary('f', 2)} ELSE {summary('f', 1)} END AS summary
    FROM (SELECT query_id, rank, {flat('text')} AS f FROM {results} WHERE rank <= 5)""")
    add(f"{prefix}_bullets", (f"{prefix}_summaries",), f"""
    SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS bullet, summary FROM (
      SELECT s.*, {strip('lower(s.summary)')} AS n, {strip('lower(l.summary)')} AS lead,
             row_number() OVER (PARTITION BY s.query_id, s.rank = 1, {strip('lower(s.summary)')} ORDER BY s.rank) AS copy
      FROM {prefix}_summaries s JOIN {prefix}_summaries l ON l.query_id = s.query_id AND l.rank = 1)
    WHERE (rank = 1 AND summary <> '') OR (rank > 1 AND length(n) >= 30 AND n <> lead AND copy = 1)
    QUALIFY bullet <= 3""")
    add(f"{prefix}_answers", ("qs", f"{prefix}_lines", f"{prefix}_bullets"), f"""
    SELECT query_id, query, sources,
           CASE WHEN sources IS NULL THEN {lit(W.question)} || query || chr(10) || chr(10) || {lit(W.nothing_found)}
                ELSE {mark('md', keywords('query', 12))} END AS markdown,
           CASE WHEN sources IS NULL THEN [] ELSE used END AS used_sources,
           CASE WHEN sources IS NULL THEN 'no_results' ELSE '' END AS warnings
    FROM (SELECT q.query_id, q.query, l.sources,
                 list_sort(list_distinct(list_append(coalesce(b.ranks, []), 1))) AS used,
                 {lit(W.question)} || q.query || chr(10) || chr(10) || {lit(W.extractive_head)} || chr(10)
                   || coalesce(b.lines, {lit(W.no_text)}) || {lit(chr(10) * 2 + '---' + chr(10) + W.sources_head + chr(10))}
                   || l.sources AS md
          FROM qs q LEFT JOIN {prefix}_lines l USING (query_id)
          LEFT JOIN (SELECT query_id, list(rank ORDER BY rank) AS ranks,
                            string_agg('- ' || summary || ' **[' || rank || ']**', chr(10) ORDER BY bullet) AS lines
                     FROM {prefix}_bullets GROUP BY query_id) b USING (query_id))""")


answer_ctes("top", "top")
answer_ctes("best", "best")

oracle("source_lines", "SELECT query_id, sources FROM top_lines", "top_lines")
oracle("answer_bullets", "SELECT query_id, rank, bullet, summary FROM top_bullets", "top_bullets")
oracle("answer_extractive", f"""
SELECT query_id, markdown, {ints('used_sources')} AS used_sources, warnings FROM best_answers""", "best_answers")


def pieces(results: str) -> str:
    def shown(c: str) -> str:
        return f"coalesce({c}, 'None')"

    body = (
        f"'[' || rank || '] (' || {shown('source_type')} || ') ' || {shown('title')} || chr(10) || 'URL: ' || "
        f"{shown('url')} || chr(10) || 'DATE: ' || {shown('date')} || chr(10) || 'TEXT: ' || {shown('text')} || chr(10)"
    )
    return f"""
    SELECT query_id, rank, piece,
           sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS running_chars,
           count(*) OVER (PARTITION BY query_id) AS k_max
    FROM (SELECT query_id, rank, {strip(f'({body})')} || chr(10) || chr(10) AS piece FROM {results} WHERE rank <= 6)"""


add("found_pieces", ("found",), pieces("found"))
add("top_pieces", ("top",), pieces("top"))
oracle("context_pack", "SELECT query_id, rank, piece, running_chars FROM found_pieces WHERE running_chars <= 3000",
       "found_pieces")
oracle("prompt_batch", f"""
SELECT query_id, {lit(W.system)} AS system,
       {lit(W.user_head)} || query || {lit(chr(10) * 2 + W.user_context)} || context
         || {lit(chr(10) * 2 + W.user_tail)} AS user, k_max
FROM qs JOIN (SELECT query_id, max(k_max) AS k_max,
                     coalesce(string_agg(piece, '' ORDER BY rank) FILTER (running_chars <= 3000), '') AS context
              FROM top_pieces GROUP BY query_id) USING (query_id)""", "qs", "top_pieces")


def no_data(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(p)})" for p in W.no_data_phrases) + ")"


oracle("audit_answers", f"""
SELECT query_id,
       CASE WHEN lost THEN {strip('content')} WHEN k_max = 0 OR error IS NOT NULL THEN plain
            ELSE {mark('md', keywords('query', 12))} END AS markdown,
       {ints('CASE WHEN lost THEN used WHEN k_max = 0 OR error IS NOT NULL THEN plain_used ELSE used END')} AS used_sources,
       CASE WHEN lost THEN concat_ws(',', 'question_not_found', 'llm_error: ' || error)
            WHEN k_max = 0 THEN plain_warnings
            WHEN error IS NOT NULL THEN 'llm_error: ' || error
            ELSE concat_ws(',', CASE WHEN len(used) = 0 THEN 'no_citations_found' END,
                           CASE WHEN {no_data('content')} THEN 'llm_says_no_data' END) END AS warnings
FROM (
  SELECT *, {lit(W.question)} || query || {lit(chr(10) * 2 + W.generated_head + chr(10))} || {strip('content')}
            || {lit(chr(10) * 2 + '---' + chr(10) + W.sources_head + chr(10))} || sources AS md
  FROM (
    SELECT *, {ensured('answer', 'used')} AS content FROM (
      SELECT c.query_id, c.answer, c.error, a.query, a.sources, a.markdown AS plain, a.used_sources AS plain_used,
             a.warnings AS plain_warnings, coalesce(n.k, 0) AS k_max, {cites('c.answer', 'coalesce(n.k, 0)')} AS used,
             a.markdown IS NULL AS lost
      FROM completed c LEFT JOIN top_answers a USING (query_id)
      LEFT JOIN (SELECT query_id, least(count(*), 6) AS k FROM top GROUP BY 1) n USING (query_id))))""",
       "completed", "top_answers", "top")
oracle("citation_map", """
SELECT query_id, n, chunk_id FROM (SELECT query_id, unnest(used_sources) AS n FROM top_answers)
JOIN (SELECT query_id, rank AS n, chunk_id FROM top) USING (query_id, n)""", "top_answers", "top")
oracle("source_table", f"""
SELECT t.query_id, t.rank, list_contains(a.used_sources, t.rank) AS used,
       round(CAST(t.score AS DECIMAL(18, 6)), 4)::DOUBLE AS score, t.title,
       t.source_type, t.date, t.url, t.doc_id,
       CASE WHEN length(t.text) > 180 THEN substr(t.text, 1, 180) || '{V.ELLIPSIS}' ELSE t.text END AS snippet
FROM top t JOIN top_answers a USING (query_id) WHERE list_contains(a.used_sources, t.rank)""", "top", "top_answers")

# --- Ingest -----------------------------------------------------------------

oracle("ingest_pages", f"""
SELECT chunk_id, part, page_id, text, title, url, '{D.PAGE_DAY}' AS date, 'web::' || url AS doc_id, 'pages' AS origin
FROM new_pages""", "new_pages")
oracle("ingest_pages_log", "SELECT page_id, url, status, reason, chunks, added FROM page_log", "page_log")
oracle("ingest_pages_report", """
SELECT 'web' AS source, count(*) AS processed, sum(added)::BIGINT AS added,
       count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors
FROM page_log""", "page_log")
oracle("ingest_messages", """
SELECT chunk_id, part, part_text AS text, title, url, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, message_key,
       views::VARCHAR AS views, has_media::VARCHAR AS has_media FROM new_messages""", "new_messages")
oracle("ingest_messages_report", "SELECT * FROM message_counts", "message_counts")
oracle("sync_corpus", """
SELECT chunk_id, 'web' AS source_type, url, sha1(text) AS text_hash FROM new_pages
UNION ALL SELECT chunk_id, 'msg', url, sha1(part_text) FROM new_messages""", "new_pages", "new_messages")
oracle("sync_summary", """
SELECT ((SELECT sum(added) FROM page_log) + (SELECT sum(added) FROM message_counts))::BIGINT AS total_added,
       (SELECT count(*) FROM page_log WHERE status = 'error') AS total_errors, true AS index_ok, true AS messages_synced""",
       "page_log", "message_counts")
oracle("sync_job", """
SELECT run, CASE run WHEN 'first' THEN added ELSE 0 END AS total_added, errors AS total_errors, true AS index_ok,
       true AS messages_synced, n + added AS chunks
FROM (SELECT ((SELECT sum(added) FROM page_log) + (SELECT sum(added) FROM message_counts))::BIGINT AS added,
             (SELECT count(*) FROM page_log WHERE status = 'error') AS errors) total,
     (SELECT count(DISTINCT chunk_id) AS n FROM (
        SELECT printf('web_web::%s_%03d', url, part) AS chunk_id FROM page_chunks WHERE contains(url, '/en/')
        UNION ALL SELECT chunk_id FROM message_chunks WHERE message_key IN (FROM known))) start,
     (SELECT unnest(['first', 'again']) AS run)""",
       "page_log", "message_counts", "page_chunks", "message_chunks", "known")
oracle("stream_messages", f"""
SELECT c.chunk_id, c.message_key, sha1(c.part_text) AS text_hash FROM message_chunks c
WHERE c.message_key IN (FROM known)
   OR (c.is_message AND (c.ts IS NULL OR c.ts >= TIMESTAMP '2024-01-03' - INTERVAL {D.SINCE_DAYS} DAY))""",
       "message_chunks", "known")

# --- Evaluation and feedback ------------------------------------------------


def rows_sql(cut: bool) -> str:
    ok = f"rank <= {V.TOP_K}" if cut else "true"
    return f"""
    SELECT query_id, coalesce(bool_or(hit AND {ok}), false) AS hit, min(rank) FILTER (hit AND {ok}) AS hit_rank,
           round(count(*) FILTER (hit AND {ok}) / {float(V.TOP_K)}, 4) AS precision_at_k,
           max(score) FILTER (rank = 1) AS top1_score, max(url) FILTER (rank = 1) AS top1_url,
           max(source_type) FILTER (rank = 1) AS top1_type, 'index' AS mode
    FROM judged GROUP BY query_id"""


add("rows_cut", ("judged",), rows_sql(True))
add("rows_all", ("judged",), rows_sql(False))


def metrics_sql(table: str, extra: str) -> str:
    hits = ", ".join(f"round(count(*) FILTER (hit_rank <= {k}) / count(*), 6) AS hit_at_{k}" for k in (1, 3, 5))
    return f"""
    SELECT count(*) AS n, {V.TOP_K} AS top_k, round(count(*) FILTER (hit) / count(*), 6) AS recall_at_k,
           round(sum(CASE WHEN hit THEN 1.0::DOUBLE / hit_rank ELSE 0 END) / count(*), 6) AS mrr_at_k, {hits},
           round(avg(top1_score), 6) AS top1_score_mean, round(median(top1_score), 8) AS top1_score_median{extra}
    FROM {table}"""


oracle("eval_rows", "SELECT * FROM rows_cut", "rows_cut")
oracle("eval_metrics", metrics_sql("rows_cut", f""",
       round(avg(precision_at_k), 6) AS avg_precision_at_k, 'index' AS mode,
       {D.LEXICAL_MIN_SCORE}::DOUBLE AS min_score, true AS keyword_filter"""), "rows_cut")
oracle("eval_metrics_merged", metrics_sql("rows_cut", ", round(avg(precision_at_k), 6) AS avg_precision_at_k"), "rows_cut")
oracle("eval_report_rows", "SELECT * FROM rows_cut", "rows_cut")
oracle("eval_report_metrics", f"""
SELECT n, recall_at_k, mrr_at_k, hit_at_1, hit_at_3, hit_at_5, avg_precision_at_k
FROM ({metrics_sql("rows_cut", ", round(avg(precision_at_k), 6) AS avg_precision_at_k")})""", "rows_cut")
oracle("eval_metrics_uncut", metrics_sql("rows_all", ""), "rows_all")
oracle("eval_hit_ratio", "SELECT hit, count(*) AS n FROM rows_cut GROUP BY hit", "rows_cut")
oracle("eval_rank_hist", "SELECT hit_rank, count(*) AS n FROM rows_all WHERE hit GROUP BY hit_rank", "rows_all")
SCORE_HISTOGRAM = """
SELECT bin, round(lo + (hi - lo) * bin / 10, 8) AS lower, round(lo + (hi - lo) * (bin + 1) / 10, 8) AS upper,
       (SELECT count(*) FROM rows_cut
        WHERE top1_score IS NOT NULL AND least(floor((top1_score - lo) / (hi - lo) * 10), 9) = bin) AS n
FROM (SELECT unnest(range(10)) AS bin, lo, hi
      FROM (SELECT min(top1_score) AS lo, max(top1_score) AS hi FROM rows_cut))"""
oracle("eval_score_hist", SCORE_HISTOGRAM, "rows_cut")
oracle("eval_score_hist_merged", SCORE_HISTOGRAM, "rows_cut")
oracle("feedback_payload", f"""
SELECT l.doc_id % {D.RATED_QUESTIONS} AS query_id, l.ts, l.rating, {strip('l.comment')} AS comment,
       left(coalesce(a.markdown, ''), {V.ANSWER_SNIP}) AS answer_snippet,
       coalesce({ints('a.used_sources')}, '') AS used_sources, coalesce(s.listed, '') AS retrieval_sources,
       {D.LEXICAL_MIN_SCORE}::DOUBLE AS min_score, true AS keyword_filter
FROM lab l LEFT JOIN top_answers a ON a.query_id = l.doc_id % {D.RATED_QUESTIONS}
LEFT JOIN (SELECT query_id, string_agg(rank || ':' || chunk_id, ',' ORDER BY rank) AS listed
           FROM found WHERE rank <= {V.FEEDBACK_SOURCES} GROUP BY 1) s ON s.query_id = l.doc_id % {D.RATED_QUESTIONS}""",
       "lab", "top_answers", "found")
oracle("bad_feedback", "SELECT ts, query, comment, rating FROM lab WHERE rating = -1", "lab")
oracle("feedback_counts", """
SELECT rating, NULL::VARCHAR AS verdict, count(*) AS n FROM lab GROUP BY rating
UNION ALL SELECT NULL, verdict, count(*) FROM lab GROUP BY verdict""", "lab")
