"""DuckDB SQL for the named queries that SQL can express."""

from corvane.functions.text import SEARCH_STOPWORDS
from corvane.operators import advice, analysis, tools
from corvane.operators.labels import ALIASES, LABELS
from corvane.operators.search import CLUSTER_STOPWORDS

TOKENS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9.+_-]*'), lambda x: trim(lower(x), '._-+')), lambda x: length(x) > 1)"
CLEAN = r"trim(regexp_replace(coalesce({}, ''), '[\s\v\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
POST = f"tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
MATCHES = "m AS (SELECT doc_id, 'quality' AS label, 0.9::DOUBLE AS confidence FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', 0.8::DOUBLE FROM labels WHERE toxic = 1)"
BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * greatest(len, 1.0) / greatest(average, 1.0)))"
TITLE = r"array_to_string(list_transform(regexp_extract_all({}, '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(left(r, 1)) || lower(substring(r, 2))), '')"
UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
WORDS = lambda words: f"({' + '.join(f'''CASE WHEN len(list_filter(w, lambda x: starts_with(x, '{p}'))) > 0 THEN 1 ELSE 0 END''' for p in words)})"
_SECRETS = [
    (r"(?i)\b(HF_TOKEN|HUGGINGFACEHUB_API_TOKEN|OPENAI_API_KEY|GITHUB_TOKEN|GH_TOKEN|ANTHROPIC_API_KEY|API_KEY|TOKEN|PASSWORD|SECRET)\b\s*[:=]\s*[''\"]?[^''\"\s,;}]+", r"\1=[REDACTED_SECRET]"),
    (r"\bBearer\s+[A-Za-z0-9._\-+/=]{16,}\b", "[REDACTED_SECRET]"),
    (r"\bhf_[A-Za-z0-9]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bsk-[A-Za-z0-9_\-]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bghp_[A-Za-z0-9]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_SECRET]"),
]
REDACTED = "text"
for _p, _r in _SECRETS:
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '{_r}', 'g')"
MARKERS = "(" + " + ".join(f"(length(html) - length(replace(html, '{m}', ''))) // {len(m)}" for m in ("{", "}", ";", "!important", "rgba(", "linear-gradient")) + ")"
SIGNAL = CLEAN.format("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')")

KEYWORD = "term NOT IN ({}) AND NOT starts_with(term, 'region') AND NOT regexp_full_match(term, '[0-9]+')".format(", ".join(f"'{w}'" for w in CLUSTER_STOPWORDS))
_END = "least(length({0}), greatest(0, coalesce(list_min(list_filter([strpos(lower({0}), t) - 1 for t in ['the', 'ering', 'tion']], lambda p: p >= 0)), 0) - 85) + 170)"
SNIPPET = f"(CASE WHEN {_END} > 170 THEN '... ' ELSE '' END || trim(substring({{0}}, greatest(0, {_END} - 170) + 1, least({_END}, 170))) || CASE WHEN {_END} < length({{0}}) THEN ' ...' ELSE '' END)"
CLUSTERS = f"""
        pr AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text, n_chars, source, lang, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS raw FROM documents JOIN embeddings ON doc_id = vec_id),
        z AS (SELECT raw, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM pr GROUP BY 1),
        ids AS (SELECT *, 'cluster-' || row_number() OVER (ORDER BY n DESC, cx, cy) AS cluster_id FROM z),
        named AS (SELECT *, CASE WHEN {CLEAN.format('title')} = '' THEN 'Untitled project' ELSE {CLEAN.format('title')} END AS shown FROM pr)"""

_SAFE = REDACTED.replace("text", "@", 1)
_CUT = "CASE WHEN length({0}) > {1} THEN left({0}, {1} - length(chr(10) || '[truncated ' || (length({0}) - {1}) || ' chars before privacy filtering]')) || chr(10) || '[truncated ' || (length({0}) - {1}) || ' chars before privacy filtering]' ELSE {0} END"
RECORDS = f"""
        r AS (SELECT conv_id, turn, role, replace(text || ' API_KEY=abc, at /home/me/x', '/home/me', '~') AS m0, text AS o0 FROM conversations),
        u AS (SELECT conv_id, turn, role, {_SAFE.replace('@', 'm0')} AS m, {_SAFE.replace('@', 'o0')} AS o FROM r),
        rec AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'session_meta' WHEN role = 'user' THEN 'event_msg' ELSE 'response_item' END AS type,
          CASE WHEN turn = 0 THEN '{{"cwd":"~/work","git":{{"branch":"main","n":3}},"id":"' || conv_id || '"}}'
            WHEN role = 'user' THEN '{{"images":[' || to_json(o) || ',"TOKEN=[REDACTED_SECRET]"],"message":' || to_json({_CUT.format('m', 300)}) || ',"type":"user_message"}}'
            WHEN role = 'system' THEN NULL
            ELSE '{{"arguments":{{"a":{{"b":{{"c":{{"d":[{{"other":"plain","text":' || to_json({_CUT.format('o', 1000)}) || '}}]}}}}}}}},"name":"look","output":' || to_json({_CUT.format('o', 120)}) || ',"type":"function_call_output"}}' END AS public,
          CASE WHEN turn = 0 THEN 0 WHEN role = 'user' THEN 3 WHEN role = 'system' THEN 0 ELSE 2 END AS texts,
          CASE WHEN turn = 0 OR role = 'system' THEN 0 WHEN role = 'user' THEN (length(m) > 300)::INTEGER ELSE (length(o) > 120)::INTEGER + (length(o) > 1000)::INTEGER END AS cut,
          CASE WHEN turn = 0 OR role = 'system' THEN 0 WHEN role = 'user' THEN greatest(0, length(m) - 300) ELSE greatest(0, length(o) - 120) + greatest(0, length(o) - 1000) END AS omitted FROM u)"""
TRAIN = """
        l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
        n AS (SELECT doc_id, 'natural' AS variant, 'doc ' || doc_id AS title, source || ',' || lang AS tags, md5(left({0}, 3000)) AS readme, 'app' AS app, coalesce(q, 0) = 1 AS a, coalesce(x, 0) = 1 AS b FROM documents JOIN l USING (doc_id)),
        every AS (FROM n UNION ALL (SELECT doc_id, 'app_only', title, tags, md5('(no README description provided)'), app, a, false FROM n WHERE a ORDER BY doc_id LIMIT 16)
          UNION ALL (SELECT doc_id, 'missing_app_file', title, tags, readme, '(no app file available)', false, b FROM n WHERE b ORDER BY doc_id LIMIT 16)
          UNION ALL (SELECT doc_id, 'noisy_metadata', title || ' ::: TODO copy of template (do not read title)', tags || ',asdf123,xx,region:us,untitled,draft', readme, app, a, b FROM n WHERE a OR b ORDER BY a::INTEGER + b::INTEGER DESC, doc_id LIMIT 8)),
        ex AS (SELECT *, a::INTEGER + b::INTEGER AS k, '{{"matches":[' || CASE WHEN b THEN '{{"quest":"Modal","confidence":0.75,"evidence":"toxic","source":"readme"}}' ELSE '' END || CASE WHEN a AND b THEN ',' ELSE '' END
          || CASE WHEN a THEN '{{"quest":"Codex","confidence":0.5,"evidence":"quality","source":"app_file"}}' ELSE '' END || ']}}' AS completion FROM every),
        sums AS (SELECT 'total' AS what, 'rows' AS name, count(*) AS n FROM ex UNION ALL SELECT 'total', 'empty', count(*) FILTER (k = 0) FROM ex UNION ALL SELECT 'variant', variant, count(*) FROM ex GROUP BY variant)""".format(CLEAN.format("text"))

ORACLE_SQL = {
    "bm25_search": f"""
        WITH {POST}, l AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1),
        s AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS average, (SELECT count(*) FROM documents) AS n FROM l),
        f AS (SELECT term, count(*) AS df FROM post GROUP BY 1)
        SELECT doc_id, round(sum({BM25}), 6) AS score FROM post JOIN f USING (term) JOIN l USING (doc_id), s
        WHERE term IN ('the', 'ering', 'tion', 'and', 'with') GROUP BY doc_id ORDER BY sum({BM25}) DESC, doc_id LIMIT 12""",
    "bm25_fields": f"""
        WITH tok AS (
          SELECT doc_id, 4.0::DOUBLE AS w, unnest({TOKENS.replace('text', "split_part(text, chr(10), 1)")}) AS term FROM documents
          UNION ALL SELECT doc_id, 0.9::DOUBLE, unnest({TOKENS}) FROM documents),
        post AS (SELECT doc_id, term, sum(w) AS tf FROM tok GROUP BY ALL),
        l AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1),
        s AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS average, (SELECT count(*) FROM documents) AS n FROM l),
        f AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        q(term, o) AS (VALUES ('ering', 1), ('tion', 2), ('with', 3))
        SELECT doc_id, round(sum({BM25}), 6) AS score, string_agg(term, ',' ORDER BY term) AS matched
        FROM post JOIN f USING (term) JOIN l USING (doc_id) JOIN q USING (term), s GROUP BY doc_id ORDER BY sum({BM25}) DESC, doc_id LIMIT 10""",
    "doc_frequency": f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY 1",
    "weighted_tf": f"WITH {POST} SELECT doc_id, term, tf::DOUBLE AS tf FROM post",
    "distinctive_keywords": f"""
        WITH tok AS (SELECT lang, doc_id, unnest({TOKENS}) AS term FROM documents),
        p AS (SELECT lang, doc_id, term, count(*) AS n FROM tok WHERE {KEYWORD} GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        o AS (SELECT lang, term, sum(n) AS tf, count(*) AS docs FROM p GROUP BY ALL),
        z AS (SELECT lang, count(*) AS members FROM documents GROUP BY 1),
        k AS (SELECT lang, term, tf::BIGINT AS tf, docs, df, members, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) AS w FROM o JOIN d USING (term) JOIN z USING (lang)),
        r AS (SELECT *, (1 + ln(tf)) * w * (0.35 + 0.65 * docs / df) * (0.35 + 0.65 * docs / members) AS s FROM k WHERE docs >= CASE WHEN members <= 3 THEN 1 ELSE 2 END AND w > 0)
        SELECT * FROM (SELECT lang, term, tf, docs, df, round(s, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY s DESC, docs DESC, tf DESC, term) AS rank FROM r) WHERE rank <= 5""",
    "top_docs": "SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, source DESC, doc_id DESC LIMIT 8",
    "recent_activity": "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id LIMIT 6",
    "leaderboard": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY n DESC, value DESC, o_custkey DESC LIMIT 8",
    "corpus_overview": "SELECT count(*) AS rows, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars >= 2000) AS long, count(*) FILTER (trim(text) = '') AS blank FROM documents",
    "coverage_order": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "knn_search": f"""
        WITH v AS (SELECT vec_id AS id, {UNIT} AS v FROM embeddings),
        p AS (SELECT a.id AS id, b.id AS other, list_inner_product(a.v, b.v) AS s FROM v a, v b WHERE a.id % 20 = 0 AND a.id <> b.id)
        SELECT id, other, round(greatest(0, least(1, (s + 1) / 2)), 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other DESC) <= 5""",
    "gap_rank": f"""
        WITH v AS (SELECT vec_id AS id, {UNIT} AS v FROM embeddings),
        p AS (SELECT a.id AS seed, b.id, list_inner_product(a.v, b.v) AS s FROM v a, v b WHERE a.id % 20 = 0 AND a.id <> b.id),
        k AS (SELECT seed, greatest(0, least(1, (s + 1) / 2)) AS s FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY p.s DESC, id DESC) <= 3),
        g AS (SELECT seed, avg(s) AS a FROM k GROUP BY 1)
        SELECT seed, round(a, 6) AS saturation, round(greatest(0, least(1, 1 - greatest(0, a - 0.35) / 0.60)), 6) AS gap FROM g""",
    "nearest_links": f"""
        WITH v AS (SELECT vec_id AS id, {UNIT} AS v FROM embeddings),
        p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS s FROM v a, v b WHERE a.id <> b.id),
        k AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b DESC) <= 2)
        SELECT least(a, b) AS source, greatest(a, b) AS target, round(greatest(0, least(1, max(s))), 4) AS score FROM k GROUP BY 1, 2""",
    "cluster_centroids": "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 4) AS x, round(avg(embedding[2]::DOUBLE), 4) AS y FROM embeddings GROUP BY 1",
    "cluster_relabel": "SELECT label, n, 'cluster-' || row_number() OVER (ORDER BY n DESC, label) AS cluster_id FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
    "cluster_representatives": "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents QUALIFY rank <= 4",
    "quest_report": f"""
        WITH {MATCHES}, dim(pos, label) AS (VALUES (0, 'quality'), (1, 'toxic'), (2, 'unused')),
        t AS (SELECT label, doc_id, max(confidence) AS c FROM m GROUP BY ALL),
        r AS (SELECT t.*, row_number() OVER (PARTITION BY label ORDER BY c DESC, n_chars DESC NULLS LAST, doc_id) AS k FROM t LEFT JOIN documents USING (doc_id))
        SELECT pos, dim.label, count(r.doc_id) AS rows, coalesce(string_agg(r.doc_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 4), '') AS examples FROM dim LEFT JOIN r USING (label) GROUP BY ALL""",
    "label_coverage": "SELECT lang, count(*) AS n, count(quality) AS labelled, sum(quality)::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "classification_eval": f"""
        WITH r AS (SELECT toxic = 1 AS g, len(list_intersect({TOKENS}, ['idiot', 'moron', 'scum', 'loser'])) > 0 AS p FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (g = p) AS exact, count(*) AS n FROM r),
        q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS a, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS b FROM c)
        SELECT tp, fp, fn, exact, n, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS f1 FROM q""",
    "declared_labels": """
        WITH k(tag, label) AS (VALUES ('src0', 'zero'), ('src1', 'one'), ('fr', 'french'), ('es', 'spanish'))
        SELECT DISTINCT doc_id, label, 1.0::DOUBLE AS confidence, 'official Space tag ' || tag AS evidence, 'metadata' AS source FROM documents, k WHERE tag = documents.source OR tag = lang""",
    "merge_labels": f"""
        WITH {MATCHES}, u AS (SELECT doc_id, 'quality' AS label, 1.0::DOUBLE AS confidence, 0 AS p FROM documents WHERE lang = 'fr' UNION ALL SELECT *, 1 FROM m)
        SELECT doc_id, label, confidence FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY p) = 1""",
    "remaining_labels": f"""
        WITH {MATCHES}, d(pos, label) AS (VALUES (0, 'quality'), (1, 'toxic'), (2, 'unused'))
        SELECT doc_id, string_agg(label, ',' ORDER BY pos) AS labels FROM documents, d WHERE NOT EXISTS (FROM m WHERE m.doc_id = documents.doc_id AND m.label = d.label) GROUP BY doc_id""",
    "clean_text": f"SELECT doc_id, md5({CLEAN.format('text')}) AS digest, length({CLEAN.format('text')}) AS n FROM documents",
    "bounded_text": f"SELECT doc_id, CASE WHEN length(c) <= 200 THEN c ELSE rtrim(left(c, 97)) || ' ... ' || ltrim(right(c, 97)) END AS text FROM (SELECT doc_id, {CLEAN.format('text')} AS c FROM documents)",
    "style_blob_filter": f"SELECT page_id, {MARKERS}::BIGINT AS markers, length(html) >= 80 AND {MARKERS} >= 8 AND {MARKERS} / length(html) > 0.015 AS is_blob FROM pages",
    "html_signals": f"""
        SELECT page_id, md5(CASE WHEN length(html) >= 80 AND {MARKERS} >= 8 AND {MARKERS} / length(html) > 0.015 THEN '' ELSE html END) AS digest FROM (SELECT page_id, {SIGNAL} AS html FROM pages)""",
    "frontmatter_fields": "SELECT doc_id, 'Doc ' || doc_id AS title, lang, length(trim(text)) AS n FROM documents",
    "secret_redaction": f"SELECT doc_id, md5({REDACTED}) AS digest, {REDACTED} <> text AS changed FROM documents",
    "truncate_fields": """
        SELECT conv_id, turn, CASE WHEN n > 0 THEN left(text, 120 - length(mark)) || mark ELSE text END AS text, greatest(0, n)::INTEGER AS omitted
        FROM (SELECT *, length(text) - 120 AS n, chr(10) || '[truncated ' || (length(text) - 120) || ' chars before privacy filtering]' AS mark FROM conversations)""",
    "clip_titles": f"""
        SELECT doc_id, CASE WHEN length(c) <= 40 THEN c ELSE rtrim(left(c, 40)) || ' ...' END AS title
        FROM (SELECT doc_id, CASE WHEN t = '' THEN 'Untitled project' ELSE t END AS c FROM (SELECT doc_id, {CLEAN.format("split_part(text, chr(10), 1)")} AS t FROM documents))""",
    "search_snippets": f"""
        WITH c AS (SELECT doc_id, {CLEAN.format('text')} AS f FROM documents),
        p AS (SELECT *, CASE WHEN contains(lower(f), 'with') THEN strpos(lower(f), 'with') - 1 END AS a, CASE WHEN contains(lower(f), 'ering') THEN strpos(lower(f), 'ering') - 1 END AS b FROM c),
        e AS (SELECT *, least(length(f), greatest(0, coalesce(least(a, b), 0) - 85) + 170) AS z FROM p)
        SELECT doc_id, CASE WHEN z > 170 THEN '... ' ELSE '' END || trim(substring(f, greatest(0, z - 170) + 1, least(z, 170))) || CASE WHEN z < length(f) THEN ' ...' ELSE '' END AS snippet FROM e""",
    "history_tail": f"""
        WITH h AS (SELECT conv_id, turn, role, left({CLEAN.format('text')}, 80) AS text FROM conversations WHERE role IN ('user', 'assistant') AND {CLEAN.format('text')} <> ''),
        m AS (SELECT *, role = 'assistant' AND coalesce(text = lead(text) OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn), false) AS echo, count(*) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM h),
        e AS (SELECT *, bool_or(echo) OVER (PARTITION BY conv_id, run) AS echoed FROM m),
        k AS (SELECT conv_id, turn, role, text FROM e WHERE NOT CASE WHEN role = 'assistant' THEN echo ELSE echoed END)
        SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
    "near_duplicates": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, {UNIT} AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
        e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.45
          UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM documents WHERE text IS NOT NULL),
        s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
        r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a)
        SELECT node AS doc_id, min(root) AS first FROM r GROUP BY node HAVING node <> min(root)""",
    "length_floor": "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) >= 400",
    "text_digest": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "hash_scatter": "SELECT doc_id, (8 + ('0x' || left(h, 4))::BIGINT % 84)::INTEGER AS x, (8 + ('0x' || substring(h, 5, 4))::BIGINT % 84)::INTEGER AS y FROM (SELECT doc_id, sha256('doc-' || doc_id) AS h FROM documents)",
    "incremental_reuse": "SELECT lang, CASE WHEN lang <> 'es' THEN 'reused' ELSE 'new' END AS state, count(*) AS n FROM documents GROUP BY ALL",
    "cache_status": "SELECT CASE WHEN lang = 'es' THEN 'absent' WHEN lang = 'fr' THEN 'invalid_schema:1' WHEN source = 'src1' THEN 'invalid_payload' ELSE 'hit' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "coverage_check": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "integrity_check": """
        SELECT 'lineitem-orders' AS edge, count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'customer-nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
    "fuzzy_resolve": """
        WITH q AS (SELECT 'orders from ' || lower(n_name) || ' please' AS question FROM nation)
        SELECT question, max_by(n_name, length(n_name)) AS match FROM q JOIN nation ON contains(question, lower(n_name)) AND length(n_name) >= 3 GROUP BY 1""",
    "score_rubric": f"""
        WITH s AS (SELECT doc_id, {TOKENS} AS w, 0.05 + (doc_id % 10) * 0.05 AS top FROM documents),
        r AS (SELECT doc_id, top, greatest(1, least(10, 10 - round_even(round(top * 18, 6), 0)))::INTEGER AS originality,
          greatest(1, least(10, 4 + 2 * {WORDS(['story', 'visual', 'game', 'ritual', 'share', 'voice'])})) AS delight,
          greatest(1, least(10, 3 + 2 * {WORDS(['agent', 'model', 'embed', 'search', 'personal', 'speech', 'local'])})) AS ai_necessity,
          greatest(1, least(10, 8 - {WORDS(['realtime', 'video', 'multiplayer', 'payments', 'social'])})) AS feasibility,
          greatest(1, least(10, 4 + 2 * {WORDS(['local', 'offline', 'small', 'llama', 'fine', 'trace', 'gradio'])} + 1)) AS goal_fit FROM s)
        SELECT doc_id, originality, delight, ai_necessity, feasibility, goal_fit, CASE WHEN top < 0.16 THEN 'UNWRITTEN' ELSE 'ECHO x1' END AS verdict,
          round((originality * 0.3 + delight * 0.2 + ai_necessity * 0.2 + feasibility * 0.15 + goal_fit * 0.15)::DOUBLE, 4) AS mean FROM r""",
    "turn_profile": """
        SELECT user_id AS turn_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS events, max(floor(value))::BIGINT AS tokens,
          count(*) FILTER (event_type = 'click') AS tools, bool_or(event_type = 'purchase') AS fell_back FROM events GROUP BY 1""",
    "session_stats": """
        SELECT user_id, count(*) AS records, count(*) FILTER (value >= 50) AS published, count(*) - count(*) FILTER (value >= 50) AS dropped,
          strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1""",
    "selected_sessions": """
        SELECT conv_id, arg_min(r, turn) AS reason FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'with') THEN 'with' WHEN contains(lower(text), 'ering') THEN 'ering' WHEN contains(lower(text), 'de la') THEN 'de la' END AS r FROM conversations)
        WHERE r IS NOT NULL GROUP BY 1""",
    "events_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "sft_examples": """
        SELECT conv_id, turn, text AS prompt, a AS answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(a) <> ''""",
    "sft_manifest": """
        SELECT lang, v AS variant, count(*) * CASE WHEN v = 'good' THEN 3 ELSE 1 END AS n FROM (SELECT lang, CASE WHEN quality IS NULL THEN 'empty' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang, v""",
    "idea_titles": f"""
        WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents),
        m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Idea: ' || left(l, 30) || ' -- ' || l WHEN 1 THEN 'make ' || lower(left(l, 20)) ELSE l END AS text FROM f),
        c AS (SELECT doc_id, {CLEAN.format('text')} AS w FROM m),
        p AS (SELECT *, CASE WHEN starts_with(lower(w), 'i want to build') THEN trim(substring(w, 16), ' :-') WHEN starts_with(lower(w), 'build') THEN trim(substring(w, 6), ' :-')
          WHEN starts_with(lower(w), 'make') THEN trim(substring(w, 5), ' :-') WHEN starts_with(lower(w), 'my idea is') THEN trim(substring(w, 11), ' :-') WHEN starts_with(lower(w), 'idea:') THEN trim(substring(w, 6), ' :-') ELSE w END AS t FROM c),
        s AS (SELECT *, strpos(t, ' -- ') AS a FROM p),
        r AS (SELECT *, CASE WHEN a > 0 THEN trim(left(t, a - 1)) ELSE t END AS raw, CASE WHEN a > 0 THEN trim(substring(t, a + 4)) ELSE w END AS pitch FROM s),
        k AS (SELECT *, CASE WHEN trim(left(raw, 64), ' .') = '' THEN 'Unwritten Page' ELSE trim(left(raw, 64), ' .') END AS cut FROM r),
        h AS (SELECT *, CASE WHEN length(raw) > 64 OR (a = 0 AND length(cut) < length(w)) THEN trim(left(cut, 58)) || '...' ELSE cut END AS shown FROM k)
        SELECT doc_id, CASE WHEN w = '' THEN 'Blank Page' ELSE upper(left(shown, 1)) || CASE WHEN regexp_matches(shown, '[\\p{{Lu}}\\p{{Nd}}]') THEN substring(shown, 2) ELSE lower(substring(shown, 2)) END END AS title,
          md5(CASE WHEN w = '' THEN 'A project direction waiting for one concrete user and one concrete tension.' ELSE pitch END) AS pitch FROM h""",
    "tool_calls": """
        SELECT n_nationkey, CASE WHEN ok THEN tool ELSE 'search' END AS name, CASE WHEN ok THEN 'valid' ELSE 'defaulted' END AS status,
          CASE WHEN ok THEN '{"place":"' || place || '"}' ELSE '{"query":"' || n_name || '"}' END AS arguments
        FROM (SELECT *, tool = 'count' OR place <> '' AS ok FROM (SELECT *, CASE WHEN n_regionkey = 0 THEN 'look' ELSE 'count' END AS tool, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS place FROM nation))""",
    "trace_lines": """SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}' AS line FROM conversations""",
    "field_notes": """
        WITH r AS (SELECT source, 'doc ' || doc_id || ', ' || n_chars || ' characters' AS line, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
        SELECT source, '## ' || source || chr(10) || chr(10) || string_agg('- ' || line, chr(10) ORDER BY k) AS page FROM r WHERE k <= 3 GROUP BY source""",
    "map_dots": """
        WITH c AS (SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 22),
        b AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM c WHERE lang <> 'fr' ORDER BY n_chars DESC, doc_id LIMIT 16)
        SELECT doc_id, (8 + ('0x' || left(h, 4))::BIGINT % 84)::INTEGER AS x, (8 + ('0x' || substring(h, 5, 4))::BIGINT % 84)::INTEGER AS y, 3 AS radius FROM b""",
    "model_ledger": "SELECT p_brand, sum(p_size)::BIGINT AS total, arg_max(p_partkey, p_size::BIGINT * 1000000000 + p_partkey) AS largest FROM part GROUP BY 1",
    "log_tail": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 80",
    "filled_session_ids": """
        WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) END AS size FROM conversations)
        SELECT conv_id, turn, arg_max(size, turn) FILTER (size IS NOT NULL) OVER (PARTITION BY conv_id) AS size FROM r""",
    "dedupe_echoes": """
        WITH h AS (SELECT conv_id, turn, role, text FROM conversations),
        m AS (SELECT *, role = 'assistant' AND coalesce(text = lead(text) OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn), false) AS echo, count(*) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM h),
        e AS (SELECT *, bool_or(echo) OVER (PARTITION BY conv_id, run) AS echoed FROM m),
        k AS (SELECT conv_id, turn, role, text FROM e WHERE NOT CASE WHEN role = 'assistant' THEN echo ELSE echoed END)
        SELECT * FROM k""",
    "search_full": f"""
        WITH dd AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, source || ' ' || lang AS tags, source || '-doc_' || doc_id AS slug, n_chars FROM documents),
        tok AS (SELECT doc_id, 4.0::DOUBLE AS w, unnest({TOKENS.replace('text', 'title')}) AS term FROM dd UNION ALL SELECT doc_id, 3.2::DOUBLE, unnest({TOKENS.replace('text', 'slug')}) FROM dd
          UNION ALL SELECT doc_id, 2.0::DOUBLE, unnest({TOKENS.replace('text', 'tags')}) FROM dd UNION ALL SELECT doc_id, 0.9::DOUBLE, unnest({TOKENS}) FROM dd),
        post AS (SELECT doc_id, term, sum(w) AS tf FROM tok GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1),
        s AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS average, (SELECT count(*) FROM documents) AS n FROM l), f AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        hit AS (SELECT doc_id, sum({BM25}) AS score, string_agg(term, ',' ORDER BY list_position(['the', 'ering', 'tion'], term)) AS matched FROM post JOIN f USING (term) JOIN l USING (doc_id), s WHERE term IN ('the', 'ering', 'tion') GROUP BY doc_id),
        r AS (SELECT dd.*, coalesce(score, 0) + CASE WHEN contains(lower(title), 'src0 doc') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(translate(slug, '-_', '  ')), 'src0 doc') THEN 1.4 ELSE 0 END AS raw, coalesce(matched, '') AS matched FROM dd LEFT JOIN hit USING (doc_id)),
        g AS (SELECT *, count(*) OVER () AS total, max(raw) OVER () AS best FROM r WHERE raw > 0),
        top AS (SELECT * FROM g ORDER BY raw DESC, n_chars DESC, lower(title) DESC, doc_id LIMIT 12),
        c AS (SELECT *, {CLEAN.format('title')} AS a, {CLEAN.format('text')} AS b, len(list_intersect({TOKENS.replace('text', 'title')}, ['the', 'ering', 'tion'])) > 0 AS in_a, len(list_intersect({TOKENS}, ['the', 'ering', 'tion'])) > 0 AS in_b FROM top),
        e AS (SELECT *, {SNIPPET.format('a')} AS sa, {SNIPPET.format('b')} AS sb FROM c)
        SELECT doc_id, round(raw / best, 6) AS score, round(raw, 6) AS raw_score, total, matched,
          to_json(list_filter([CASE WHEN in_a AND sa <> '' THEN {{'source': 'Title', 'text': sa}} END, CASE WHEN in_b AND sb <> '' THEN {{'source': 'README', 'text': sb}} END], lambda x: x IS NOT NULL))::VARCHAR AS snippets FROM e""",
    "dashboard_clusters": f"""
        WITH {CLUSTERS}, tok AS (SELECT raw, doc_id, unnest({TOKENS.replace('text', 'title')}) AS term FROM pr),
        p AS (SELECT raw, doc_id, term, count(*) AS n FROM tok WHERE {KEYWORD} GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        o AS (SELECT raw, term, sum(n) AS tf, count(*) AS docs FROM p GROUP BY ALL),
        k AS (SELECT raw, term, tf, docs, df, n AS members, ln((1 + (SELECT count(*) FROM pr)) / (1 + df)) AS w FROM o JOIN d USING (term) JOIN z USING (raw)),
        r AS (SELECT *, (1 + ln(tf)) * w * (0.35 + 0.65 * docs / df) * (0.35 + 0.65 * docs / members) AS s FROM k WHERE docs >= CASE WHEN members <= 3 THEN 1 ELSE 2 END AND w > 0),
        q AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY s DESC, docs DESC, tf DESC, term) AS rank FROM r QUALIFY rank <= 5),
        kw AS (SELECT raw, string_agg(term, ',' ORDER BY rank) AS keywords, string_agg({TITLE.format('term')}, ' / ' ORDER BY rank) FILTER (rank <= 2) AS label FROM q GROUP BY 1),
        b AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY n_chars DESC, source DESC, lower(title) DESC, doc_id DESC) AS rank FROM named QUALIFY rank <= 4),
        t1 AS (SELECT raw, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS representatives FROM b GROUP BY 1),
        t2 AS (SELECT raw, string_agg(shown, ' / ' ORDER BY k) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY rank) AS k FROM b WHERE shown <> 'Untitled project' QUALIFY k <= 2) GROUP BY 1)
        SELECT cluster_id, coalesce(label, titles, 'Mixed projects') AS label, coalesce(keywords, '') AS keywords, n AS project_count, round(cx, 4) AS x, round(cy, 4) AS y, representatives
        FROM ids LEFT JOIN kw USING (raw) LEFT JOIN t2 USING (raw) JOIN t1 USING (raw)""",
    "dashboard_points": f"""
        WITH {CLUSTERS}, {MATCHES}, own AS (SELECT doc_id, string_agg(label, ',' ORDER BY confidence DESC, label) AS q FROM m GROUP BY 1)
        SELECT doc_id, shown AS title, md5({CLEAN.format('text')}) AS summary, n_chars AS likes, source || ',' || lang AS tags, round(x, 6) AS x, round(y, 6) AS y, cluster_id, coalesce(q, '') AS quest_ids
        FROM named JOIN ids USING (raw) LEFT JOIN own USING (doc_id)""",
    "labelled_points": f"""
        WITH {CLUSTERS}, {MATCHES} SELECT DISTINCT doc_id, n_chars AS likes, cluster_id FROM pr JOIN ids USING (raw) JOIN m USING (doc_id) WHERE cluster_id = 'cluster-1' ORDER BY n_chars DESC, doc_id LIMIT 12""",
    "public_records": f"WITH {RECORDS} SELECT conv_id, turn, type, public, texts, cut, omitted FROM rec",
    "publication_manifest": f"WITH {RECORDS} SELECT count(DISTINCT conv_id) AS sessions, count(*) AS records, count(public) AS published, count(*) - count(public) AS dropped, sum(texts)::BIGINT AS texts, sum(cut)::BIGINT AS truncated_fields, sum(omitted)::BIGINT AS omitted_chars FROM rec",
    "redaction_totals": "SELECT role, sum(length(regexp_replace(text, '[^A-Z]', '', 'g')))::BIGINT AS capitals, sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits FROM conversations GROUP BY 1",
    "sft_branches": f"WITH {TRAIN} SELECT doc_id, variant, title, tags, readme, app, completion FROM ex",
    "sft_counts": f"WITH {TRAIN} FROM sums UNION ALL SELECT 'label', v.name, CASE v.name WHEN 'Codex' THEN (SELECT count(*) FROM ex WHERE a) WHEN 'Modal' THEN (SELECT count(*) FROM ex WHERE b) ELSE 0 END FROM (VALUES {', '.join(f"('{i}')" for i, _ in LABELS)}) v(name)",
    "sft_lines": f"""
        WITH {TRAIN}, c AS (FROM sums UNION ALL SELECT 'label', 'Codex', (SELECT count(*) FROM ex WHERE a) UNION ALL SELECT 'label', 'Modal', (SELECT count(*) FROM ex WHERE b) UNION ALL SELECT 'label', 'Nemotron', 0)
        SELECT 0 AS pos, NULL::BIGINT AS doc_id, NULL::VARCHAR AS variant, '{{"type":"lora_sft_manifest","counts":{{' || string_agg('"' || what || ':' || name || '":' || n, ',' ORDER BY what || ':' || name) || '}}}}' AS line FROM c
        UNION ALL SELECT 1, doc_id, variant, '{{"type":"lora_sft_example","doc_id":' || doc_id || ',"variant":"' || variant || '","match_count":' || k || ',"completion":' || to_json(completion) || '}}' FROM ex""",
    "sft_violations": """
        SELECT doc_id, 'natural' AS variant, CASE WHEN doc_id % 3 = 0 THEN 'remote inference, yet Off the Grid' ELSE 'OpenBMB without a model of its family' END AS problem FROM documents WHERE doc_id % 2 = 0""",
    "app_segments": """
        WITH a AS (SELECT doc_id, left('from gradio import Blocks' || chr(10) || 'from torch.nn import Linear' || chr(10) || chr(10) || text || chr(10) || 'from gradio import Blocks' || chr(10) || 'from gradio import Blocks' || chr(10) || '  from torch.nn import Linear', 3800) AS head, 'org/model-' || doc_id AS own FROM documents)
        SELECT doc_id, md5(head || chr(10) || chr(10) || 'ASSETS: acme/x.y, ' || own) AS digest FROM a""",
    "index_build": f"""
        SELECT doc_id, sha256(text) AS text_digest, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, len(u)::INTEGER AS dimensions, round(round(u[1], 8), 6) AS first
        FROM (SELECT doc_id, text, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT doc_id, text, {UNIT} AS v FROM documents JOIN embeddings ON doc_id = vec_id))""",
    "index_problems": """
        SELECT coalesce(doc_id, vec_id) AS doc_id, CASE WHEN vec_id IS NULL THEN 'not indexed' WHEN doc_id % 7 = 0 THEN 'text digest differs' ELSE 'not normalized' END AS problem
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL OR doc_id % 7 = 0 OR doc_id % 11 = 0""",
    "point_marks": """
        SELECT doc_id, round(0.62 + least(0.72, sqrt(n_chars) * 0.12), 6) AS radius, CASE WHEN length(f) > 22 THEN trim(left(f, 20)) || '...' ELSE f END AS title,
          'My ' || upper(left(source, 1)) || substring(source, 2) || ' 2' || upper(left(lang, 1)) || substring(lang, 2) AS name, 'https://' || source || '.hf.space' AS host, '~/' || source AS path
        FROM (SELECT *, trim(split_part(text, chr(10), 1)) AS f FROM documents)""",
    "lookups": "SELECT c_custkey::VARCHAR AS asked, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT lower(c_name), c_custkey::VARCHAR FROM customer",
    "first_seen_sources": "SELECT user_id, string_agg(event_type, ',' ORDER BY a) AS types FROM (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY ALL) GROUP BY 1",
    "snapshot_listing": "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 HAVING NOT bool_and(p_size = 1)",
    "unused_labels": """
        WITH used AS (SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 2), best AS (SELECT min(r_regionkey) AS b FROM region WHERE r_regionkey NOT IN (SELECT k FROM used))
        SELECT r_name AS label, CASE WHEN r_regionkey = b THEN -1 ELSE r_regionkey END AS place, 0.0::DOUBLE AS score FROM region, best""",
}

#: Ideas of a table asked(key..., text): the rule of idea_titles.
MAILS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LAYOUT = f"""
        lay AS (SELECT vec_id AS doc_id, label AS raw, round(3 + (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 94, 4) AS x, round(3 + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 94, 4) AS y
          FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)),
        pr AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text, n_chars, source, lang, x, y, raw FROM documents JOIN lay USING (doc_id)),
        z AS (SELECT raw, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM pr GROUP BY 1),
        ids AS (SELECT *, 'cluster-' || row_number() OVER (ORDER BY n DESC, cx, cy) AS cluster_id FROM z),
        named AS (SELECT *, CASE WHEN {CLEAN.format('title')} = '' THEN 'Untitled project' ELSE {CLEAN.format('title')} END AS shown FROM pr)"""
_CLUSTERS_SQL = ORACLE_SQL["dashboard_clusters"]
_BODY = _CLUSTERS_SQL[_CLUSTERS_SQL.index("tok AS (SELECT raw"):_CLUSTERS_SQL.index("        SELECT cluster_id, coalesce(label")]
_LINKS = ORACLE_SQL["nearest_links"].strip().removeprefix("WITH ").replace("FROM embeddings", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
_LINKS, _, _LAST = _LINKS.rpartition("\n        SELECT ")
ORACLE_SQL["dashboard_payload"] = f"""
        WITH {LAYOUT}, {MATCHES}, {_BODY.rstrip()},
        cl AS (SELECT cluster_id, coalesce(label, titles, 'Mixed projects') || ';' || coalesce(keywords, '') || ';' || representatives AS what, n, round(cx, 4) AS x, round(cy, 4) AS y FROM ids LEFT JOIN kw USING (raw) LEFT JOIN t2 USING (raw) JOIN t1 USING (raw)),
        own AS (SELECT doc_id, string_agg(label, ',' ORDER BY confidence DESC, label) AS q FROM m GROUP BY 1),
        links AS (WITH {_LINKS} SELECT {_LAST}),
        dim(pos, label) AS (VALUES (0, 'quality'), (1, 'toxic'), (2, 'unused')),
        mt AS (SELECT label, doc_id, max(confidence) AS c FROM m WHERE doc_id IN (SELECT doc_id FROM pr) GROUP BY ALL),
        mr AS (SELECT mt.*, row_number() OVER (PARTITION BY label ORDER BY c DESC, n_chars DESC, doc_id) AS k FROM mt JOIN pr USING (doc_id))
        SELECT 'header' AS part, 'analyzed' AS item, 'marks' AS what, count(*) AS n, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM pr
        UNION ALL SELECT 'cluster', cluster_id, what, n, x, y FROM cl
        UNION ALL SELECT 'point', doc_id::VARCHAR, cluster_id || ';' || source || ',' || lang || ';' || coalesce(q, ''), n_chars, x, y FROM named JOIN ids USING (raw) LEFT JOIN own USING (doc_id)
        UNION ALL SELECT 'link', source || '-' || target, NULL, NULL, score, NULL FROM links
        UNION ALL SELECT 'label', dim.label, coalesce(string_agg(mr.doc_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 4), ''), count(mr.doc_id), NULL, NULL FROM dim LEFT JOIN mr USING (label) GROUP BY dim.label"""
ORACLE_SQL["crawled_cards"] = rf"""
        WITH r AS (SELECT *, doc_id % 4 AS k, regexp_replace(regexp_replace(text, '^[\s\v\x1c-\x1f\x85\x{{a0}}\x{{3000}}]+', ''), '[\s\v\x1c-\x1f\x85\x{{a0}}\x{{3000}}]+$', '') AS body, left(text, 3000) AS app FROM documents WHERE doc_id % 10 <> 9),
        c AS (SELECT *, {CLEAN.format('app')} AS flat FROM r)
        SELECT 'org/doc_' || doc_id || '-2go' AS id, CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id ELSE 'Doc ' || doc_id || ' 2Go' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'about' ELSE '' END AS summary,
          least(source, lang) || ',' || greatest(source, lang) AS tags, n_chars AS likes, 'https://' || source || '.hf.space' AS host, CASE WHEN k = 0 THEN 'src/app.txt' ELSE '' END AS app_file,
          md5(left(body, 24000)) AS readme, length(app) AS app_chars,
          md5(CASE WHEN k <> 0 OR trim(app) = '' THEN '' WHEN length(flat) <= 2000 THEN flat ELSE rtrim(left(flat, 997)) || ' ... ' || ltrim(right(flat, 997)) END) AS embedded,
          CASE WHEN k = 1 THEN 'invalid app_file path: ../up.txt' END AS error FROM c"""
ORACLE_SQL["privacy_redaction"] = f"SELECT doc_id, md5(regexp_replace(text, '{MAILS}', '[MAIL]', 'g')) AS digest, len(regexp_extract_all(text, '{MAILS}')) AS mails FROM documents"
ORACLE_SQL["resolve_names"] = """
        WITH c AS (SELECT c_custkey AS pos, 'org/c-' || c_custkey AS id, lower(c_name) AS title FROM customer),
        n AS (SELECT pos, id, id AS name, 0 AS place FROM c UNION ALL SELECT pos, id, split_part(id, '/', 2), 1 FROM c UNION ALL SELECT pos, id, title, 2 FROM c),
        q AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN upper('org/c-' || c_custkey) WHEN 1 THEN '  ' || lower(c_name) WHEN 2 THEN 'Tell me about ' || c_name || '!' WHEN 3 THEN 'open c-' || c_custkey || ' now' ELSE 'unknown ' || c_custkey END AS question FROM customer),
        f AS (SELECT question, trim(lower(question)) AS low FROM q),
        e AS (SELECT question, arg_min(id, pos) AS exact FROM f JOIN n ON low = name GROUP BY 1),
        h AS (SELECT question, arg_min(id, (-length(name), pos, place)) AS contained FROM f JOIN n ON contains(low, name) AND length(name) >= 4 GROUP BY 1)
        SELECT question, coalesce(exact, contained) AS match FROM f LEFT JOIN e USING (question) LEFT JOIN h USING (question)"""
ORACLE_SQL["tool_violations"] = """
        WITH b AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations),
        g AS (SELECT *, CASE WHEN n % 13 = 0 THEN 'jump' WHEN turn % 2 = 0 THEN 'look' ELSE 'set' END AS tool,
          CASE WHEN n % 11 = 0 THEN '[1]' WHEN n % 11 = 1 THEN '{broken'
            WHEN turn % 2 = 0 THEN '{"place":' || CASE WHEN n % 7 = 0 THEN '5' ELSE to_json(left(text, 30)) END || CASE n % 3 WHEN 0 THEN ',"how":"near"' WHEN 1 THEN ',"how":"up"' ELSE '' END || CASE n % 5 WHEN 0 THEN ',"count":1.5' WHEN 1 THEN ',"count":3' ELSE '' END || '}'
            ELSE '{' || CASE WHEN n % 4 > 0 THEN '"names":["a",' ELSE '"zeta":[' END || CASE WHEN n % 6 = 0 THEN '1,null' ELSE '"b"' END || '],"exact":' || CASE WHEN n % 5 = 0 THEN '"yes"' ELSE 'true' END || ',"share":0.5,"more":{"x":[1]}}' END AS given FROM b),
        spec(tool, field, kind, needed, allowed, item) AS (VALUES ('look', 'place', 'string', true, NULL, NULL), ('look', 'how', 'string', false, ['near', 'far'], NULL), ('look', 'count', 'integer', false, NULL, NULL),
          ('set', 'names', 'array', true, NULL, 'string'), ('set', 'exact', 'boolean', false, NULL, NULL), ('set', 'share', 'number', false, NULL, NULL), ('set', 'more', 'object', false, NULL, NULL)),
        types(json, kind) AS (VALUES ('VARCHAR', 'string'), ('UBIGINT', 'integer'), ('BIGINT', 'integer'), ('DOUBLE', 'number'), ('UBIGINT', 'number'), ('BIGINT', 'number'), ('BOOLEAN', 'boolean'), ('ARRAY', 'array'), ('OBJECT', 'object')),
        ok AS (SELECT * FROM g WHERE json_valid(given) AND left(given, 1) = '{' AND tool <> 'jump'),
        a AS (SELECT conv_id, turn, tool, unnest(json_keys(given)) AS field, given FROM ok),
        v AS (SELECT *, json_type(given, '$.' || field) AS kind_found, json_extract_string(given, '$.' || field) AS value, json_extract(given, '$.' || field) AS json FROM a),
        bad AS (
          SELECT conv_id, turn, 0 AS o, '' AS f, 0 AS i, 'unexpected arguments for ' || tool || ': ' || string_agg(field, ', ' ORDER BY field) AS e FROM v ANTI JOIN spec USING (tool, field) GROUP BY conv_id, turn, tool
          UNION ALL SELECT conv_id, turn, 1, '', 0, 'missing required arguments for ' || tool || ': ' || string_agg(field, ', ' ORDER BY field) FROM ok JOIN spec USING (tool) WHERE needed AND NOT list_contains(json_keys(given), field) GROUP BY conv_id, turn, tool
          UNION ALL SELECT conv_id, turn, 2, field, 0, tool || '.' || field || CASE WHEN NOT EXISTS (FROM types WHERE types.json = kind_found AND types.kind = spec.kind) THEN ' must be ' || kind ELSE ' must be one of: ' || array_to_string(allowed, ', ') END
            FROM v JOIN spec USING (tool, field) WHERE NOT EXISTS (FROM types WHERE types.json = kind_found AND types.kind = spec.kind) OR allowed IS NOT NULL AND NOT list_contains(allowed, value)
          UNION ALL SELECT conv_id, turn, 2, field, i, tool || '.' || field || '[' || i || '] must be ' || item FROM (SELECT *, unnest(range(json_array_length(v.json)::BIGINT)) AS i FROM v JOIN spec USING (tool, field) WHERE item IS NOT NULL AND kind_found = 'ARRAY')
            WHERE NOT EXISTS (FROM types WHERE types.json = json_type(given, '$.' || field || '[' || i || ']') AND types.kind = item)),
        e AS (SELECT conv_id, turn, string_agg(e, '; ' ORDER BY o, f, i) AS errors FROM bad GROUP BY ALL),
        r AS (SELECT g.*, CASE WHEN NOT json_valid(given) THEN 'function arguments are not valid JSON' WHEN left(given, 1) <> '{' THEN 'function arguments must be a JSON object' WHEN tool = 'jump' THEN 'unknown tool: jump' ELSE coalesce(errors, '') END AS errors FROM g LEFT JOIN e USING (conv_id, turn))
        SELECT conv_id, turn, CASE WHEN errors = '' THEN 'valid' ELSE 'defaulted' END AS status, CASE WHEN errors = '' THEN tool WHEN turn % 3 > 0 AND trim(left(text, 20)) <> '' THEN 'search_projects' ELSE 'find_whitespace' END AS name,
          md5(CASE WHEN errors = '' THEN CASE WHEN tool = 'look' THEN '{' || CASE WHEN n % 5 = 1 THEN '"count":3,' ELSE '' END || CASE WHEN n % 3 = 0 THEN '"how":"near",' ELSE '' END || '"place":' || to_json(left(text, 30)) || '}'
              ELSE '{"exact":true,"more":{"x":[1]},"names":["a","b"],"share":0.5}' END
            WHEN turn % 3 > 0 AND trim(left(text, 20)) <> '' THEN '{"query":' || to_json(trim(left(text, 20))) || '}' ELSE '{}' END) AS arguments, errors FROM r"""
_ASKED = """
        b AS (SELECT conv_id, turn, left(text, 40) AS s, length(text) % 12 AS k FROM conversations),
        a AS (SELECT conv_id, turn, CASE WHEN k IN (1, 5) THEN '' ELSE s END AS s, ['', 'projects', 'read project https://example.org/spaces/org/', 'Compare ideas ', 'make a plan  for ', 'find a gap', 'search for ', 'show me the cluster ', 'who completed most quests: ', 'latest ', 'hello ', 'how many '][k + 1] AS p FROM b),
        m AS (SELECT conv_id, turn, {0} AS text FROM (SELECT conv_id, turn, p || s AS raw FROM a)),
        l AS (SELECT *, lower(text) AS low FROM m)""".format(CLEAN.format("raw"))
_IS = lambda words: "(" + " OR ".join(f"low = '{w}' OR starts_with(low, '{w} ')" for w in words) + ")"
_HAS = lambda words: "(" + " OR ".join("contains(low, '{}')".format(w.replace("'", "''")) for w in words) + ")"
_LISTING = "(low IN ({}) OR {})".format(", ".join(f"'{w}'" for w in tools.LISTING_WORDS), " OR ".join(f"starts_with(low, '{w}')" for w in tools.LISTING_PREFIXES))
_KNOWN = r"trim(regexp_extract(regexp_replace(regexp_replace(text, '^(?i)(read|open|show) (project|space) +', ''), '^(?i)https?://[^/\s]+/spaces/', ''), '^\S*'), '.,;:!?\"''')"
ORACLE_SQL["advisor_routes"] = f"""
        WITH {_ASKED}, r AS (SELECT *, CASE WHEN text = '' OR {_LISTING} THEN 'list_projects' WHEN regexp_matches(low, '^(read|open|show) (project|space) ') AND {_KNOWN} <> '' THEN 'get_project'
          {' '.join(f"WHEN {_IS(words)} THEN '{tool}'" for tool, words in tools.COMMANDS.items())} ELSE 'save_idea' END AS name FROM l)
        SELECT conv_id, turn, name, CASE name WHEN 'list_projects' THEN '{{"sort":"likes"}}' WHEN 'get_project' THEN '{{"id":' || to_json({_KNOWN}) || '}}' WHEN 'search_projects' THEN '{{"query":' || to_json(text) || '}}' WHEN 'save_idea' THEN NULL ELSE '{{}}' END AS arguments FROM r"""
ORACLE_SQL["chat_routes"] = f"""
        WITH {_ASKED}, i AS (SELECT *, {_HAS(tools.DETAIL)} AS detail FROM l),
        r AS (SELECT *, CASE WHEN {_HAS(tools.LEADERS)} THEN 'top_projects_by_quests' WHEN {_HAS(tools.CLUSTERS)} THEN CASE WHEN detail THEN 'show_cluster' ELSE 'list_clusters' END WHEN {_HAS(tools.QUESTS)} THEN CASE WHEN detail THEN 'show_quest' ELSE 'list_quests' END
          WHEN {_HAS(tools.RECENT)} THEN 'recent_activity' WHEN {_HAS(tools.OVERVIEW)} THEN 'atlas_overview' WHEN {_HAS(tools.INSIDE)} OR detail THEN 'show_project' WHEN {_HAS(tools.SEARCHES)} OR text <> '' THEN 'search_projects' ELSE 'atlas_overview' END AS name FROM i)
        SELECT conv_id, turn, name, CASE name WHEN 'show_cluster' THEN '{{"label":' || to_json(text) || '}}' WHEN 'show_quest' THEN '{{"quest":' || to_json(text) || '}}' WHEN 'show_project' THEN '{{"project":' || to_json(text) || '}}' WHEN 'search_projects' THEN '{{"query":' || to_json(text) || '}}' ELSE '{{}}' END AS arguments,
          rtrim(low, '.!?') = '' OR {_IS(tools.SMALLTALK).replace('low', "rtrim(low, '.!?')")} AS smalltalk FROM r"""
ORACLE_SQL["session_states"] = """
        WITH e AS (SELECT conv_id::VARCHAR AS session, turn, CASE WHEN turn % 4 = 3 THEN 'set_goals' WHEN role = 'user' THEN 'save_idea' ELSE 'update_profile' END AS action, left(text, 1) AS title, left(text, 2) AS pitch, left(text, 20) AS value, length(text) % 2 = 0 AS even FROM conversations),
        s AS (SELECT *, coalesce(lower(trim(title)) <> lag(lower(trim(title))) OVER w OR trim(pitch) <> lag(trim(pitch)) OVER w, true) AS another FROM e WHERE action = 'save_idea' WINDOW w AS (PARTITION BY session ORDER BY turn)),
        n AS (SELECT *, sum(another::INTEGER) OVER (PARTITION BY session ORDER BY turn) AS idea FROM s),
        i AS (SELECT session, idea, arg_max(title, turn) AS title, arg_max(pitch, turn) AS pitch, max(turn) AS saved, min(turn) AS born FROM n GROUP BY ALL),
        o AS (SELECT *, coalesce(lead(born) OVER (PARTITION BY session ORDER BY idea), 1000000000) AS until FROM i),
        g AS (SELECT session, turn, CASE WHEN even THEN 'Off-Brand' ELSE '' END AS goals FROM e WHERE action = 'set_goals'),
        k AS (SELECT o.session, idea, title, pitch, coalesce((SELECT arg_max(goals, turn) FROM g WHERE g.session = o.session AND g.turn < until), 'Off the Grid+Well-Tuned+Off-Brand') AS goals FROM o),
        l AS (SELECT session, string_agg(title || '/' || pitch || '/' || goals, '|' ORDER BY idea) AS ideas FROM k GROUP BY 1),
        p AS (SELECT session, arg_max(value, turn) FILTER (action = 'update_profile' AND even) AS time, arg_max(value, turn) FILTER (action = 'update_profile' AND NOT even) AS skills, max(turn) AS seq FROM e GROUP BY 1),
        t AS (SELECT session, string_agg(turn || ':' || action, ',' ORDER BY turn) AS trace FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 12) GROUP BY 1),
        z AS (SELECT session, arg_max(goals, turn) AS goals FROM g GROUP BY 1)
        SELECT session, seq, coalesce(ideas, '') AS ideas, coalesce(z.goals, 'Off the Grid+Well-Tuned+Off-Brand') AS goals, time, skills, trace FROM p LEFT JOIN l USING (session) LEFT JOIN t USING (session) LEFT JOIN z USING (session)"""
ORACLE_SQL["turn_stages"] = """
        WITH e AS (SELECT user_id, ts, event_id AS seq, value, CASE event_type WHEN 'view' THEN 'stage' WHEN 'click' THEN 'tool_event' WHEN 'purchase' THEN 'model_progress' WHEN 'search' THEN 'start' WHEN 'error' THEN 'fallback' ELSE 'done' END AS type FROM events),
        s AS (SELECT *, CASE WHEN type <> 'stage' THEN NULL WHEN value < 20 THEN 'planning' WHEN value < 40 THEN 'running_tool' ELSE 'writing' END AS stage FROM e),
        p AS (SELECT *, CASE type WHEN 'start' THEN 0 WHEN 'model_progress' THEN 2 WHEN 'tool_event' THEN 4 WHEN 'token' THEN 6 WHEN 'done' THEN 7 WHEN 'stage' THEN CASE stage WHEN 'planning' THEN 1 WHEN 'running_tool' THEN 3 ELSE 5 END END AS phase FROM s),
        w AS (SELECT user_id, bool_and(coalesce(phase >= before, true)) AS in_order FROM (SELECT *, max(phase) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p WHERE phase IS NOT NULL) GROUP BY 1),
        g AS (SELECT user_id, min(ts) AS a, coalesce(min(ts) FILTER (type = 'done'), max(ts)) AS z, min(ts) FILTER (stage = 'planning') AS p, min(ts) FILTER (stage = 'running_tool') AS r, min(ts) FILTER (stage = 'writing') AS w,
          max(floor(value)::BIGINT) FILTER (type = 'model_progress') AS tokens, count(*) FILTER (type = 'tool_event') AS tools, bool_or(type = 'fallback') AS fell_back FROM s GROUP BY 1)
        SELECT user_id AS turn_id, round((epoch_us(z) - epoch_us(a)) / 1000, 0) AS total_ms, round((epoch_us(r) - epoch_us(p)) / 1000, 0) AS decode_ms, round((epoch_us(w) - epoch_us(r)) / 1000, 0) AS tools_ms, round((epoch_us(z) - epoch_us(w)) / 1000, 0) AS write_ms,
          ((p IS NOT NULL)::INTEGER + (r IS NOT NULL)::INTEGER + (w IS NOT NULL)::INTEGER) AS stages, tokens, tools, fell_back, coalesce(in_order, true) AS in_order FROM g LEFT JOIN w USING (user_id)"""
_LABEL_IDS = ",".join(f'"{i}"' for i, _ in LABELS)
_ANALYZER = '{"adapter":{"id":"a","revision":"r"},"generation":{"sample":false,"temperature":0.5},"model":"m"}'
ORACLE_SQL["cache_identity"] = f"""
        WITH t AS (SELECT sha256('{{"labels":[{_LABEL_IDS}],"prompt_version":"v1"}}') AS h)
        SELECT doc_id, sha256(text) AS prompt_hash, sha256('{{"analyzer_fingerprint":{_ANALYZER},"project_id":"' || doc_id || '","prompt_hash":"' || sha256(text) || '","schema_version":1,"taxonomy_hash":"' || h || '"}}') AS cache_key,
          sha256('{{"k":' || to_json(left(text, 10)) || ',"z":[1,{{"a":null,"b":' || n_chars || '}}]}}') AS canonical FROM documents, t"""
_HEAD = "\n".join(analysis.PROMPT_HEAD).replace("'", "''")
_RULES = "\n".join(analysis.PROMPT_RULES).replace("'", "''")
_LISTED = "\n".join(f"- {i}: {x} Signals: the words {x}" for i, x in LABELS).replace("'", "''")
_CLIPPED = "CASE WHEN length(trim({0})) = 0 THEN '{2}' WHEN length(trim({0})) <= {1} THEN trim({0}) ELSE rtrim(left(trim({0}), {1})) || ' ...' END"
ORACLE_SQL["quest_prompts"] = f"""
        WITH r AS (SELECT *, left({CLEAN.format('text')}, 3000) AS readme, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN left(text, 3800) ELSE '' END AS app FROM documents),
        p AS (SELECT doc_id, '{_HEAD}' || chr(10) || '{_LISTED}' || chr(10) || '{_RULES}' || chr(10) || 'METADATA: {{"title": ' || to_json(trim(split_part(text, chr(10), 1))) || ', "sdk": "' || source || '", "declared_models": ["' || lang || '", "org/x"], "tags": ["' || source || '", "' || lang || '"]}}'
          || chr(10) || chr(10) || '[README]' || chr(10) || {_CLIPPED.format('readme', 1500, '(no README description provided)')} || chr(10) || chr(10) || '[APP_FILE] ' || CASE WHEN doc_id % 2 = 0 THEN 'app.py' ELSE '(unknown)' END || chr(10) || {_CLIPPED.format('app', 1900, '(no app file available)')} AS made FROM r)
        SELECT doc_id, md5(made) AS digest, length(made) AS n FROM p"""
ORACLE_SQL["label_ladder"] = f"""
        WITH r AS (SELECT doc_id, source, length(text) % 6 AS k, regexp_replace(left(text, 30), '["\\\\]', '''', 'g') AS raw FROM documents),
        e AS (SELECT *, {CLEAN.format('raw')} AS e, source <> 'src1' AS asked, source = 'src2' AS declared FROM r),
        o AS (SELECT *, CASE WHEN NOT asked THEN NULL WHEN k = 3 THEN 'ValueError: no answer; repair failed: no JSON object in the answer' WHEN k = 4 THEN 'no JSON object in the answer; repair failed: no JSON object in the answer' WHEN e = '' THEN 'evidence must not be empty; repair failed: evidence must not be empty' END AS error FROM e)
        SELECT doc_id, CASE WHEN NOT asked OR error IS NOT NULL THEN 'declared' WHEN k = 2 THEN 'repaired' ELSE 'parsed' END AS rung,
          CASE WHEN declared THEN 'Modal/1.0/tag/metadata' ELSE '' END || CASE WHEN NOT asked OR error IS NOT NULL THEN '' WHEN k = 5 THEN CASE WHEN declared THEN '|' ELSE '' END || 'OpenBMB/0.75/' || e || '/readme|Codex/0.75/' || e || '/readme' WHEN declared THEN '' ELSE 'Modal/0.75/' || e || '/readme' END AS matches, error FROM o"""

_FOLD = "replace(lower({}), 'ß', 'ss')"
_RAW = r"regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{M}}\p{{N}}_][\p{{L}}\p{{M}}\p{{N}}_.+-]*')"
_WHOLE = "list_filter(list_transform(" + _RAW + ", lambda r: trim(r, '._+-/')), lambda w: w <> '')"
_PARTS = "list_filter(string_split_regex(w, '[._+\\-/]+'), lambda p: length(p) > 1)"
_STOP = ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS)
_WORDS = "list_filter(flatten(list_transform(" + _WHOLE + f", lambda w: CASE WHEN {_PARTS} = [w] THEN [w] ELSE list_prepend(w, {_PARTS}) END)), lambda x: (length(x) > 1 OR regexp_full_match(x, '[0-9]')) AND x NOT IN ({_STOP}))"
_NAMES = ["Title", "Space", "Summary", "Tags", "Quest evidence", "Cluster", "App", "README"]
_WEIGHTS = [4.0, 3.2, 2.4, 2.0, 1.6, 1.4, 1.0, 0.9]
_FIELD = [f"c{i}" for i in range(8)]
_CENTRE = "coalesce(list_min(list_filter([strpos(" + _FOLD.format("{0}") + ", t) - 1 for t in ['src1', 'tion', 'strasse', 'quality']], lambda p: p >= 0)), 0)"
_TO = "least(length({0}), greatest(0, " + _CENTRE + " - 85) + 170)"
_EXCERPT = f"(CASE WHEN {_TO} > 170 THEN '... ' ELSE '' END || trim(substring({{0}}, greatest(0, {_TO} - 170) + 1, least({_TO}, 170))) || CASE WHEN {_TO} < length({{0}}) THEN ' ...' ELSE '' END)"
ORACLE_SQL["search_projects"] = f"""
        WITH {CLUSTERS}, {MATCHES}, {_BODY.rstrip()},
        cl AS (SELECT raw, coalesce(label, titles, 'Mixed projects') || CASE WHEN keywords IS NULL THEN ' ' ELSE ' ' || replace(keywords, ',', ' ') END AS c5 FROM ids LEFT JOIN kw USING (raw) LEFT JOIN t2 USING (raw)),
        ev AS (SELECT doc_id, string_agg(label || ' was marked', ' ' ORDER BY label) AS c4 FROM m GROUP BY 1),
        dd AS (SELECT d.doc_id, n_chars, split_part(text, chr(10), 1) AS title, source || '-doc_' || d.doc_id AS slug, pt.raw, CASE WHEN {CLEAN.format('title')} = '' THEN 'Untitled project' ELSE {CLEAN.format('title')} END AS c0,
          'org/' || slug || ' ' || slug || ' ' || translate(slug, '-_', '  ') AS c1, {CLEAN.format('left(text, 60)')} AS c2, source || ' ' || lang || ' static' AS c3, coalesce(c4, '') AS c4, coalesce(c5, '') AS c5, 'app.py  ' || right(text, 50) AS c6, text AS c7
          FROM documents d LEFT JOIN (SELECT vec_id AS doc_id, label AS raw FROM embeddings) pt USING (doc_id) LEFT JOIN cl USING (raw) LEFT JOIN ev ON ev.doc_id = d.doc_id),
        w AS (SELECT doc_id, {', '.join(f"{_WORDS.format(c)} AS w{i}" for i, c in enumerate(_FIELD))} FROM dd),
        tk AS ({' UNION ALL '.join(f"SELECT doc_id, {x}::DOUBLE AS x, unnest(w{i}) AS term FROM w" for i, x in enumerate(_WEIGHTS))}),
        post AS (SELECT doc_id, term, sum(x) AS tf FROM tk GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1),
        st AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS average, (SELECT count(*) FROM documents) AS n FROM l), f AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        hit AS (SELECT doc_id, sum({BM25}) AS score, string_agg(term, ',' ORDER BY list_position(['src1', 'tion', 'strasse', 'quality'], term)) AS matched FROM post JOIN f USING (term) JOIN l USING (doc_id), st WHERE term IN ('src1', 'tion', 'strasse', 'quality') GROUP BY doc_id),
        g AS (SELECT dd.*, score, matched, count(*) OVER () AS total, max(score) OVER () AS best FROM dd JOIN hit USING (doc_id) WHERE score > 0),
        top AS (SELECT * FROM g ORDER BY score DESC, n_chars DESC, lower(title) DESC, doc_id LIMIT 12),
        cc AS (SELECT * REPLACE ({', '.join(f"{CLEAN.format(c)} AS {c}" for c in _FIELD)}) FROM top),
        own AS (SELECT doc_id, string_agg(label, ',' ORDER BY confidence DESC, label) AS q FROM m GROUP BY 1)
        SELECT doc_id, slug, round(score / best, 6) AS score, round(score, 6) AS raw_score, total, matched, CASE WHEN pt.raw IS NULL THEN NULL ELSE cluster_id END AS cluster_id, CASE WHEN pt.raw IS NULL THEN NULL ELSE coalesce(q, '') END AS quest_ids,
          to_json(list_filter([{', '.join(f"CASE WHEN len(list_intersect(w{i}, ['src1', 'tion', 'strasse', 'quality'])) > 0 AND {_EXCERPT.format(c)} <> '' THEN {{'source': '{_NAMES[i]}', 'text': {_EXCERPT.format(c)}}} END" for i, c in enumerate(_FIELD))}], lambda x: x IS NOT NULL)[:2])::VARCHAR AS snippets
        FROM cc pt JOIN w USING (doc_id) LEFT JOIN ids USING (raw) LEFT JOIN own USING (doc_id)"""

_QLIST = "\n".join(f"- {i}: {x}" for i, x in LABELS).replace("'", "''")
_VALID = "','".join(("contradiction", "empty", "hard_negative"))
_TRAIN_ALL = TRAIN.rstrip()
_CODEX = '{"quest":"Codex","confidence":0.5,"evidence":"made","source":"readme"}'
ORACLE_SQL["sft_file"] = f"""
        WITH {TRAIN.split("ex AS (SELECT *")[0].rstrip().rstrip(',').replace("md5(left({0}, 3000))", "x").replace("md5(", "(")},
        picked AS (SELECT doc_id FROM n WHERE a ORDER BY doc_id LIMIT 16),
        more AS (FROM every UNION ALL SELECT doc_id, 'remote_app_only', title, tags, '(no README description provided)', app, a, false FROM n WHERE split_part(tags, ',', 1) = 'src1' AND doc_id NOT IN (FROM picked)),
        ex AS (SELECT doc_id, variant, title, tags, readme, app, a::INTEGER + b::INTEGER AS k, '{{"matches":[' || CASE WHEN b THEN '{{"quest":"Modal","confidence":0.75,"evidence":"toxic","source":"readme"}}' ELSE '' END || CASE WHEN a AND b THEN ',' ELSE '' END
            || CASE WHEN a THEN '{{"quest":"Codex","confidence":0.5,"evidence":"quality","source":"app_file"}}' ELSE '' END || ']}}' AS completion, CASE WHEN a AND b THEN '["Codex","Modal"]' WHEN a THEN '["Codex"]' WHEN b THEN '["Modal"]' ELSE '[]' END AS quests, a, b FROM more
          UNION ALL SELECT -1 - item_id, ['contradiction', 'empty', 'hard_negative'][item_id % 4 + 1], 'made ' || item_id, 'gradio', left({CLEAN.format('text')}, 3000), 'app', (item_id % 4 <> 1)::INTEGER, CASE WHEN item_id % 4 = 1 THEN '{{"matches":[]}}' ELSE '{{"matches":[{_CODEX}]}}' END, CASE WHEN item_id % 4 = 1 THEN '[]' ELSE '["Codex"]' END, item_id % 4 <> 1, false FROM benchmark WHERE item_id % 4 < 3),
        pr AS (SELECT *, '{_HEAD}' || chr(10) || '{_QLIST}' || chr(10) || '{_RULES}' || chr(10) || 'METADATA: {{"title": ' || to_json(title) || ', "sdk": "static", "declared_models": [], "tags": ["' || replace(tags, ',', '", "') || '"]}}' || chr(10) || chr(10) || '[README]' || chr(10) || {_CLIPPED.format('readme', 1500, '(no README description provided)')}
            || chr(10) || chr(10) || '[APP_FILE] app.py' || chr(10) || app AS prompt FROM ex),
        li AS (SELECT doc_id, variant, '{{"type":"lora_sft_example","schema_version":1,"base_model":"base","adapter_task":"labels","example_kind":"quest_classification","project_id":"' || doc_id || '","variant":"' || variant || '","match_count":' || k || ',"quests":' || quests
            || ',"messages":[{{"role":"system","content":"You label projects."}},{{"role":"user","content":' || to_json(prompt) || '}},{{"role":"assistant","content":' || to_json(completion) || '}}]}}' AS line FROM pr),
        ma AS (SELECT '{{"type":"lora_sft_manifest","schema_version":1,"format":"chat-jsonl","source":"documents","example_count":' || count(*) || ',"empty_match_examples":' || count(*) FILTER (k = 0) || ',"variant_counts":{{' || (SELECT string_agg('"' || variant || '":' || c, ',' ORDER BY variant) FROM (SELECT variant, count(*) AS c FROM ex GROUP BY 1))
            || '}},"quest_positive_counts":{{"Codex":' || count(*) FILTER (a) || ',"Modal":' || count(*) FILTER (b) || ',"Nemotron":0}}}}' AS line FROM ex)
        SELECT 0 AS pos, NULL::BIGINT AS doc_id, NULL::VARCHAR AS variant, md5(line) AS digest, line AS manifest FROM ma UNION ALL SELECT 1, doc_id, variant, md5(line), NULL FROM li"""
ORACLE_SQL["sft_split"] = f"WITH {TRAIN} SELECT variant, count(*) * CASE WHEN variant = 'natural' THEN 1 ELSE 3 END AS n, count(DISTINCT doc_id) AS examples, count(DISTINCT doc_id) AS sides FROM ex GROUP BY variant"
_TRACED = """
        p AS (SELECT conv_id, turn, text AS prompt, a AS answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(a) <> ''),
        x AS (SELECT conv_id, turn, left(prompt, 40) AS i, left(answer, 60) AS o, length(prompt) % 3 > 0 AS valid, CASE WHEN length(prompt) % 5 > 0 THEN 'search_projects' ELSE '' END AS tool, '{"n":1,"query":' || to_json(left(prompt, 9)) || '}' AS args, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM p)"""
ORACLE_SQL["trace_file"] = f"""
        WITH {_TRACED}
        SELECT conv_id, 0 AS pos, '{{"idea_count":0,"index":{{"algorithm":"dense","index_generated_at":"","snapshot_digest":"x","snapshot_generated_at":""}},"schema_version":1,"turn_count":' || count(*) || ',"type":"trace_manifest"}}' AS line FROM x GROUP BY conv_id
        UNION ALL SELECT conv_id, k, '{{"artifact_title":"","input":' || to_json(i) || ',"overall":' || CASE WHEN turn > 0 THEN turn::VARCHAR ELSE 'null' END || ',"plan_steps":0,"response":' || to_json(o) || ',"schema_version":1,"tool_resolution":{{"call":{{"arguments":' || args || ',"name":"' || tool || '"}},"errors":[],"status":"' || CASE WHEN valid THEN 'valid' ELSE 'defaulted' END
          || '"}},"tools":[{{"name":"search","summary":"Found 1."}}],"turn_index":' || k || ',"type":"agent_turn","verdict":""}}' FROM x"""
ORACLE_SQL["trace_training"] = f"""
        WITH {_TRACED}, f AS (SELECT conv_id, k, {CLEAN.format('i')} AS i, {CLEAN.format('o')} AS o, '<function name="search_projects">' || args || '</function>' AS call FROM x WHERE valid AND tool <> ''),
        g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS nth FROM f WHERE i <> '' AND o <> '')
        SELECT conv_id, k AS turn_index, 2 * nth - 1 AS example_index, 'tool_call' AS kind, '[{{"role":"system","content":"Call a tool."}},{{"role":"user","content":' || to_json(i) || '}},{{"role":"assistant","content":' || to_json(call) || '}}]' AS messages FROM g
        UNION ALL SELECT conv_id, k, 2 * nth, 'advisor_response', '[{{"role":"system","content":"Answer."}},{{"role":"user","content":' || to_json(i || chr(10) || chr(10) || 'Tool call: ' || call) || '}},{{"role":"assistant","content":' || to_json(o) || '}}]' FROM g"""
ORACLE_SQL["index_header"] = """
        WITH n AS (SELECT count(*) AS c, max(len(embedding)) AS dims FROM documents JOIN embeddings ON doc_id = vec_id)
        SELECT 'header' AS what, '{"schema_version":3,"algorithm":"dense-cosine","generated_at":"","snapshot_generated_at":"2024-01-01","snapshot_source":"a","snapshot_digest":"x","document_count":' || c || ',"embedding":{"dimensions":' || dims || ',"normalized":"true","repo":"r","runtime":"external"}}' AS value FROM n
        UNION ALL SELECT 'problem', unnest(['built from a snapshot of another time', 'the snapshot''s digest differs']) UNION ALL SELECT 'problem', 'another number of documents' FROM n WHERE c <> (SELECT count(*) FROM documents)"""

_STEPS = [s.replace("'", "''") for s in advice.PLAN_STEPS]
_TIME, _PREFERENCE = (dict(advice.PROFILE_STEPS)[k].replace("'", "''").split("{}") for k in ("time", "preferences"))
ORACLE_SQL["session_plans"] = f"""
        WITH c AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n FROM conversations GROUP BY 1),
        s AS (SELECT *, {CLEAN.format('last')} AS f FROM c),
        v AS (SELECT *, CASE WHEN length(f) <= 84 THEN f ELSE rtrim(left(f, 81), ' ,.;:') || '...' END AS short FROM s),
        p AS (SELECT *, ['{_STEPS[0]}'] || CASE WHEN n % 2 = 0 THEN CASE WHEN short <> '' THEN ['{_TIME[0]}' || short || '{_TIME[1]}'] ELSE [] END || ['{_PREFERENCE[0]}short words{_PREFERENCE[1]}'] ELSE [] END || ['{"','".join(_STEPS[1:4])}'] || CASE WHEN n % 3 = 0 THEN ['{advice.TUNING_STEP}'] ELSE [] END || ['{_STEPS[4]}'] AS made FROM v),
        t AS (SELECT conv_id, string_agg('- ' || role, chr(10) ORDER BY turn) AS context FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY 1)
        SELECT conv_id, ['Trainable', 'Field Notes', 'Off-Brand'][n % 3 + 1] AS goals, len(made)::INTEGER AS n, md5(array_to_string(made, '|')) AS digest, context FROM p JOIN t USING (conv_id)"""
_AT = "(8 + ('0x' || substring(sha256({0}), {1}, 4))::BIGINT % 84)::INTEGER"
ORACLE_SQL["idea_map"] = f"""
        WITH v AS (SELECT vec_id AS doc_id, {UNIT} AS v FROM embeddings),
        k AS (SELECT b.doc_id, greatest(0, least(1, (list_inner_product(a.v, b.v) + 1) / 2)) - 0.4 AS score, list_inner_product(a.v, b.v) AS s FROM v a, v b WHERE a.doc_id = 0 AND b.doc_id > 0 ORDER BY s DESC, b.doc_id LIMIT 12),
        h AS (SELECT k.*, split_part(text, chr(10), 1) AS title FROM k JOIN documents USING (doc_id)),
        c AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 22),
        d AS (SELECT 'inked' AS kind, doc_id, title, 3 AS radius FROM (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY n_chars DESC, doc_id LIMIT 16)
          UNION ALL SELECT 'echo', doc_id, title, greatest(5, least(9, round_even(score * 14 + 4, 0)::INTEGER)) FROM (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 5)),
        l AS (SELECT vec_id AS doc_id, floor(embedding[1]::DOUBLE * 40 + 50)::INTEGER AS x, floor(embedding[2]::DOUBLE * 40 + 50)::INTEGER AS y FROM embeddings WHERE vec_id % 2 = 0)
        SELECT kind, doc_id::VARCHAR AS item, md5(title) AS title, coalesce(x, {_AT.format('doc_id::VARCHAR', 1)}) AS x, coalesce(y, {_AT.format('doc_id::VARCHAR', 5)}) AS y, radius FROM d LEFT JOIN l USING (doc_id)
        UNION ALL SELECT 'idea', 'idea-1', md5('Tide Clock'), {_AT.format("'idea:idea-1:Tide Clock'", 1)}, {_AT.format("'idea:idea-1:Tide Clock'", 5)}, 8"""
ORACLE_SQL["result_digests"] = """
        WITH r AS (SELECT *, '  - label: "' || left(text, 20) || '", share: 1.5' AS item FROM documents)
        SELECT doc_id, md5('about:' || chr(10) || '  language: "' || lang || '"' || chr(10) || '  place:' || chr(10) || '    name: "' || source || '"' || chr(10) || 'count: ' || n_chars || chr(10) || 'examples:' || chr(10) || item || chr(10) || item || chr(10)
          || 'long: ' || CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END || chr(10) || 'names:' || chr(10) || '  - "a"' || chr(10) || '  - "' || source || '"') AS digest FROM r"""

_SPELLED = [(x, y) for i, label in LABELS for x, y in ((i, i), (label.upper(), i), (f"Best Use of {i}", i), (f"{i} (track)", i), (i.replace(" ", "--"), i), (f"not {i}", None), (f"{label} / Codex", f"{i},Codex" if i != "Codex" else "Codex"), (f"{label} / not {i}", None))] + list(ALIASES.items())
ORACLE_SQL["canonical_labels"] = """
        WITH k(pos, name, label) AS (VALUES {}), l(o, id, shown) AS (VALUES {}),
        q AS (SELECT doc_id, name, label, lower('who did ' || name) AS low FROM documents JOIN k ON pos = length(text) % {}),
        f AS (SELECT doc_id, arg_min(id, o) AS asked FROM q JOIN l ON contains(low, lower(id)) OR contains(low, lower(shown)) GROUP BY 1)
        SELECT doc_id, name, label, asked FROM q LEFT JOIN f USING (doc_id)""".format(
    ", ".join("({}, '{}', {})".format(n, a.replace("'", "''"), f"'{b}'" if b else "NULL") for n, (a, b) in enumerate(_SPELLED)), ", ".join(f"({n}, '{i}', '{x}')" for n, (i, x) in enumerate(LABELS)), len(_SPELLED)
)

_PARTS_SQL = f"""
        WITH {LAYOUT}, {MATCHES}, {_BODY.rstrip()},
        cl AS (SELECT raw, cluster_id, n, {CLEAN.format("coalesce(label, titles, 'Mixed projects')")} AS label FROM ids LEFT JOIN kw USING (raw) LEFT JOIN t2 USING (raw) JOIN t1 USING (raw)),
        own AS (SELECT doc_id, string_agg(label, ',' ORDER BY confidence DESC, label) AS q, count(*) AS k FROM m GROUP BY 1),
        pts AS (SELECT doc_id, shown, n_chars, source, cl.label AS cluster_label, coalesce(q, '') AS q, coalesce(k, 0) AS k FROM named JOIN cl USING (raw) LEFT JOIN own USING (doc_id))"""
ORACLE_SQL["atlas_overview"] = f"""{_PARTS_SQL},
        lb AS (SELECT label, count(DISTINCT doc_id) AS rows, CASE label WHEN 'quality' THEN 0 ELSE 1 END AS pos FROM m WHERE doc_id IN (SELECT doc_id FROM pr) GROUP BY 1)
        SELECT 'projects' AS what, 0 AS pos, 'analyzed' AS item, count(*) AS n FROM pts UNION ALL SELECT 'clusters', 0, '', count(*) FROM cl
        UNION ALL (SELECT 'cluster', row_number() OVER (ORDER BY n DESC, length(cluster_id), cluster_id) AS p, label, n FROM cl ORDER BY p LIMIT 3)
        UNION ALL (SELECT 'label', row_number() OVER (ORDER BY rows DESC, lower(label), pos) AS p, label, rows FROM lb ORDER BY p LIMIT 3)
        UNION ALL (SELECT 'liked', row_number() OVER (ORDER BY n_chars DESC, lower(shown) DESC, doc_id) AS p, doc_id::VARCHAR, n_chars FROM pts ORDER BY p LIMIT 3)"""
ORACLE_SQL["atlas_leaders"] = f"{_PARTS_SQL} SELECT doc_id, n_chars AS likes, k::INTEGER AS labels, q AS quest_ids, count(*) OVER () AS total FROM pts WHERE k > 0 ORDER BY k DESC, n_chars DESC, lower(shown) DESC, doc_id LIMIT 8"
ORACLE_SQL["atlas_recent"] = f"{_PARTS_SQL} SELECT doc_id, n_chars AS likes, source AS last_modified, cluster_label FROM pts ORDER BY source DESC, doc_id LIMIT 6"
ORACLE_SQL["atlas_projects"] = f"""{_PARTS_SQL},
        dz AS (SELECT doc_id, 'org/item-' || lpad(doc_id::VARCHAR, 7, '0') AS id, {CLEAN.format("split_part(text, chr(10), 1)")} AS title, {CLEAN.format('left(text, 80)')} AS summary, left({CLEAN.format('text')}, 3000) AS readme FROM documents),
        nm AS (SELECT doc_id, id AS name, 0 AS place FROM dz UNION ALL SELECT doc_id, split_part(id, '/', 2), 1 FROM dz UNION ALL SELECT doc_id, lower(CASE WHEN title = '' THEN 'Untitled project' ELSE title END), 2 FROM dz),
        qs AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN upper(id) WHEN 1 THEN 'What about ' || split_part(id, '/', 2) || '?' ELSE 'zq ' || doc_id END AS question FROM dz),
        ez AS (SELECT question, min(doc_id) AS exact FROM qs JOIN nm ON lower(question) = name GROUP BY 1),
        hz AS (SELECT question, arg_min(doc_id, (-length(name), doc_id, place)) AS contained FROM qs JOIN nm ON contains(lower(question), name) AND length(name) >= 4 GROUP BY 1),
        fz AS (SELECT question, coalesce(exact, contained) AS doc_id FROM qs LEFT JOIN ez USING (question) LEFT JOIN hz USING (question))
        SELECT question, fz.doc_id, md5(summary) AS summary, md5(CASE WHEN length(readme) <= 1500 THEN readme ELSE rtrim(left(readme, 1500)) || ' ...' END) AS readme, n_chars AS likes, cluster_label, q AS quest_ids FROM fz LEFT JOIN dz USING (doc_id) LEFT JOIN pts USING (doc_id)"""
ORACLE_SQL["folded_tokens"] = f"SELECT doc_id, len({_WORDS.format('text')})::INTEGER AS n_tokens FROM documents"
ORACLE_SQL["packed_chunks"] = f"""
        WITH w AS (SELECT conv_id, turn, string_split({CLEAN.format('text')}, ' ') AS w FROM conversations),
        r AS (SELECT conv_id, turn, list_reduce(list_prepend(chr(1), w), lambda s, x: CASE WHEN length(split_part(s, chr(1), 2) || x || ' ') >= 28
          THEN split_part(s, chr(1), 1) || CASE WHEN split_part(s, chr(1), 1) = '' THEN '' ELSE '|' END || split_part(s, chr(1), 2) || x || ' ' || chr(1) ELSE s || x || ' ' END) AS s FROM w)
        SELECT conv_id, turn, CASE WHEN rtrim(split_part(s, chr(1), 2)) = '' THEN split_part(s, chr(1), 1) ELSE split_part(s, chr(1), 1) || CASE WHEN split_part(s, chr(1), 1) = '' THEN '' ELSE '|' END || rtrim(split_part(s, chr(1), 2)) END AS chunks FROM r"""
