"""SQL for DuckDB that gives the results of the catalog's queries."""

from __future__ import annotations

from gleaner.operators import discovery, rank
from gleaner.plans import interpret

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"
_STOPS = "['the','of','a','and','to','in','what','why']"


def words(c: str) -> str:
    return f"list_filter(list_distinct({_WORDS.format(c)}), lambda x: NOT list_contains({_STOPS}, x))"


def all_words(c: str) -> str:
    return _WORDS.format(c)


def tokens(c: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({c})), '[\p{{L}}\p{{N}}]+')"


def trigrams(c: str) -> str:
    w = all_words(c)
    return f"list_distinct(CASE WHEN len({w}) >= 3 THEN list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i+2], ' ')) ELSE {w} END)"


#: CTE: the runs of three words of the lists w of a table, or its words if there are fewer than three.
_GRAMS = """each_word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {0}),
        grams AS (
            SELECT doc_id, CASE WHEN n < 3 THEN word ELSE word || ' ' || second || ' ' || third END AS gram
            FROM (SELECT *, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM each_word WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE n < 3 OR third IS NOT NULL
        )"""
#: A word character, and what is none, as Unicode has it.
_W, _NOT_W = r"[\p{L}\p{M}\p{N}\p{Pc}]", r"[^\p{L}\p{M}\p{N}\p{Pc} ]"


def title_key(c: str) -> str:
    return f"trim(regexp_replace(lower(replace({c}, '_', ' ')), '{_NOT_W}', '', 'g'))"


def entity_key(c: str) -> str:
    plain = rf"regexp_replace(translate({c}, '_’', ' ' || chr(39)), '\s*\([^)]{{1,60}}\)\s*$', '')"
    return rf"lower(trim(regexp_replace(regexp_replace({plain}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\-'' ]+', ' ', 'g'), '\s+', ' ', 'g')))"


def haystack(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}} ]+', ' ', 'g')"


def sql_list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def intent(q: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({q}), '{pattern}') THEN '{name}'" for name, pattern in interpret.INTENTS)
    return f"CASE {cases} ELSE 'general' END"


def plan(source: str) -> str:
    """CTEs up to `plan` (query_id, intent, broad, subject, seeds, names, hints, article_limit) of (query_id, question); for questions without a plural of two."""
    run = rf"[A-Z](?:{_W}|[''’-])*(?:\s+(?:of|the|and|de|von|[A-Z](?:{_W}|[''’-])*)){{0,6}}"
    generic, phrases = sql_list(sorted(interpret.GENERIC)), sql_list(sorted(interpret.GENERIC_PHRASES))
    cause = ", ".join(f"subject || ' {x}'" for x in interpret.CAUSE_SEEDS)
    wide = ", ".join(f"subject || ' {x}'" for x in interpret.BROAD_SEEDS)
    return rf"""
        questions AS ({source}),
        named AS (
            SELECT query_id, 1 AS stage, unnest(runs) AS name, generate_subscripts(runs, 1) AS place FROM (
                SELECT query_id, list_filter(list_transform(list_transform(regexp_extract_all(question, '(?:^|{_NOT_W.replace(" ]", "]")})({run})', 1), lambda r: regexp_split_to_array(r, '\s+')),
                    lambda p: array_to_string(p[coalesce(nullif(list_position(list_transform(p, lambda w: NOT list_contains({generic}, w)), true), 0), len(p) + 1):], ' ')), lambda x: x != '') AS runs
                FROM questions
            )
            UNION ALL
            SELECT query_id, 2, unnest(sides), generate_subscripts(sides, 1) FROM (
                SELECT query_id, list_filter(list_transform(regexp_split_to_array(question, '[/;]'), lambda x: trim(x, ' ?!.,')),
                    lambda x: regexp_matches(x, '^\p{{Lu}}') AND len(regexp_split_to_array(x, '\s+')) <= 5) AS sides FROM questions
            )
        ),
        keyed AS (SELECT *, {entity_key('name')} AS key FROM named),
        firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY stage, place) AS k FROM keyed WHERE length(key) >= 3 AND NOT list_contains({phrases}, key)) WHERE k = 1),
        entities AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, place) AS no FROM firsts) WHERE no <= 8),
        found_names AS (SELECT query_id, list(name ORDER BY no) AS names, list(key ORDER BY no) AS keys FROM entities GROUP BY query_id),
        read_plan AS (
            SELECT query_id, question, trim(question) AS resolved, {intent('question')} AS intent,
                left(trim(regexp_replace(question, '(?i){interpret.OPENING}', ''), ' ?!.,'), 220) AS subject
            FROM questions
        ),
        broad_plan AS (SELECT *, intent IN ('cause', 'comparison', 'timeline') OR regexp_matches(resolved, '(?i){interpret.BROAD}') AS broad FROM read_plan),
        plan AS (
            SELECT query_id, question, resolved, intent, broad, subject, CASE WHEN broad THEN 12 ELSE 2 END AS article_limit, coalesce(names, []) AS names, coalesce(keys, []) AS keys,
                list_transform(list_sort(list_transform(list_distinct(all_seeds), lambda x: {{'at': list_position(all_seeds, x), 'x': x}})), lambda y: y.x)[:4] AS seeds,
                list_distinct(regexp_extract_all(resolved, '(?i){interpret.DATE_HINT}'))[:8] AS hints
            FROM (
                SELECT *, list_filter(list_concat([resolved], CASE
                    WHEN intent = 'cause' THEN [{cause}]
                    WHEN intent = 'comparison' THEN list_transform(list_filter(list_transform(
                        regexp_split_to_array(regexp_replace(regexp_replace(subject, '(?i)^compare\s+', ''), '(?i)\s+(?:and|versus|vs\.?)\s+', chr(1)), chr(1)), lambda x: trim(x, ' ?!.,')),
                        lambda x: x != ''), lambda x: x || ' {interpret.COMPARISON_SEED}')
                    WHEN broad THEN [{wide}] ELSE [] END), lambda x: trim(x) != '') AS all_seeds
                FROM broad_plan
            ) LEFT JOIN found_names USING (query_id)
        )"""


def features(cands: str) -> str:
    """CTEs up to `reranked` of candidates (query_id, chunk_id, article_path, section, text, score) and `plan`: features and rerank_score before the order."""
    weights = {"semantic": "semantic", "lexical": "lexical", "title": "title", "section": "in_section", "entity": "entity", "date": "dated", "direct": "0.35::DOUBLE", "completeness": "completeness", "low_value": "low_value", "topic_conflict": "conflict"}
    total = "0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {weights[k]}" for k, w in rank.WEIGHTS.items())
    density = rf"CASE WHEN len(allw) < 18 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, 0.35::DOUBLE + len(regexp_extract_all(text, '[.!?](?:\s|$)')) * 0.12::DOUBLE + least(len(allw), 160) / 400.0::DOUBLE) END"
    return rf"""
        worded AS (
            SELECT c.*, p.names, p.keys, p.hints, p.intent, p.resolved, {words("array_to_string(p.seeds, ' ')")} AS qw, {words('c.text')} AS tw, {words("replace(c.article_path, '_', ' ')")} AS aw,
                {words('c.section')} AS hw, {all_words('c.text')} AS allw, {haystack("concat_ws(' ', replace(c.article_path, '_', ' '), c.section, c.text)")} AS hay
            FROM {cands} c JOIN plan p USING (query_id)
        ),
        measured AS (
            SELECT *, list_distinct(list_concat(list_concat(tw, aw), hw)) AS everything, max(score) OVER w AS high, min(score) OVER w AS low FROM worded WINDOW w AS (PARTITION BY query_id)
        ),
        scored_features AS (
            SELECT *, CASE WHEN abs(high - low) <= 1e-9 * greatest(abs(low), abs(high)) THEN 0.5::DOUBLE ELSE (score - low) / (high - low) END AS semantic,
                {overlap('qw', 'everything')} AS lexical, {overlap('aw', 'qw')} AS title, {overlap('hw', 'qw')} AS in_section,
                CASE WHEN len(names) = 0 THEN 0.5::DOUBLE ELSE list_max(list_transform(names, lambda n: CASE WHEN contains(hay, {haystack('n')}) THEN 1.0::DOUBLE
                    ELSE 0.35::DOUBLE * {overlap(words('n'), 'everything')} END)) END AS entity,
                CASE WHEN len(hints) = 0 THEN 0.5::DOUBLE ELSE (len(list_filter(hints, lambda h: contains(lower(section || ' ' || text), lower(h))) ) > 0)::INT::DOUBLE END AS dated,
                {density} AS completeness, coalesce(regexp_matches(trim(section), '{rank.LOW_VALUE}'), false)::INT::DOUBLE AS low_value,
                (list_contains(qw, 'republic') AND list_contains(aw, 'empire') AND NOT list_contains(aw, 'republic'))::INT::DOUBLE AS conflict
            FROM measured
        ),
        reranked AS (SELECT *, round({total}, 8) AS rerank_score FROM scored_features)"""


def overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len({a})))"


def bm25(asked: str, pool: str, pooled: bool = False) -> str:
    """CTEs up to `scored` (query_id, chunk_id, score); asked gives (query_id, query), pool (chunk_id, title, section, body)."""
    key, by = ("query_id, ", "query_id") if pooled else ("", "")
    using = "USING (query_id, token)" if pooled else "USING (token)"
    totals = f"GROUP BY {by}" if pooled else ""
    return rf"""
        asked AS ({asked}),
        first_terms AS (
            SELECT query_id, term FROM (
                SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS place FROM (
                    SELECT query_id, term, min(pos) AS first_at FROM (
                        SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos
                        FROM (SELECT query_id, regexp_extract_all(lower(query), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM asked)
                    ) GROUP BY query_id, term
                )
            ) WHERE place <= 96
        ),
        wanted AS (
            SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens('term')}) AS token FROM first_terms) GROUP BY query_id, token
        ),
        pool AS ({pool}),
        sized AS (SELECT {key}chunk_id, len({tokens('title')}) + len({tokens('section')}) + len({tokens('body')}) AS size FROM pool),
        each_token AS (
            SELECT {key}chunk_id, unnest({tokens('title')}) AS token, 2.0 AS weight FROM pool
            UNION ALL SELECT {key}chunk_id, unnest({tokens('section')}), 1.5 FROM pool
            UNION ALL SELECT {key}chunk_id, unnest({tokens('body')}), 1.0 FROM pool
        ),
        freqs AS (SELECT {key}chunk_id, token, sum(weight)::DOUBLE AS freq FROM each_token GROUP BY {key}chunk_id, token),
        totals AS (SELECT {key}count(*) AS total, avg(size) AS mean FROM sized {totals}),
        holding AS (SELECT {key}token, count(*) AS holding FROM freqs GROUP BY {key}token),
        scored AS (
            SELECT w.query_id, f.chunk_id, -sum(floor(w.times * ((CASE WHEN ln((t.total - h.holding + 0.5) / (h.holding + 0.5)) > 0
                THEN ln((t.total - h.holding + 0.5) / (h.holding + 0.5)) ELSE 1e-6 END) * f.freq * 2.2 / (f.freq + 1.2 * (0.25 + 0.75 * s.size / t.mean))) / 1e-12 + 0.5)::BIGINT) * 1e-12 AS score
            FROM wanted w JOIN freqs f {using} JOIN holding h {using} JOIN sized s ON s.chunk_id = f.chunk_id {"AND s.query_id = f.query_id" if pooled else ""}
                {"JOIN totals t ON t.query_id = f.query_id" if pooled else "CROSS JOIN totals t"}
            GROUP BY w.query_id, f.chunk_id
        )"""


_INDEX = "SELECT doc_id AS chunk_id, source AS title, lang AS section, text AS body FROM documents"
_PASSAGES = "SELECT item_id AS query_id, text AS query FROM benchmark"
_HITS = f"""{bm25(_PASSAGES, _INDEX)},
        hits AS (
            SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM scored) WHERE rank <= 40
        )"""


def cosine(modulo: int, name: str) -> str:
    shift = f"q.vec_id - {modulo}" if modulo else "q.vec_id"
    return f"""
        {name}_scored AS (
            SELECT {shift} AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score
            FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 100 = {modulo}
        ),
        {name} AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_scored) WHERE rank <= 40
        )"""


_DOC_QUERIES = "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)"
_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_FACETS = r"""facets AS (
            SELECT item_id AS query_id, unnest(string_split(text, '. ')) AS span, generate_subscripts(string_split(text, '. '), 1) - 1 AS facet FROM benchmark
        ),
        spans AS (SELECT query_id, facet, array_to_string(""" + all_words("span") + r""", ' ') AS plain FROM facets WHERE length(span) > 0),
        matched AS (
            SELECT DISTINCT h.query_id, s.facet, h.rank FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN spans s ON s.query_id = h.query_id
            WHERE s.plain != '' AND contains(array_to_string(""" + all_words("d.text") + r""", ' '), s.plain)
        )"""
_CANDIDATES = f"""{_HITS},
        cands AS (
            SELECT h.query_id, d.doc_id, 'doc_' || d.doc_id AS chunk_id, h.rank, -h.score AS score, d.source AS article_path, d.lang AS section, d.text, a.query
            FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN asked a USING (query_id)
        ),
        lists AS (
            SELECT *, {words('query')} AS qw, {words('text')} AS tw, {words("replace(article_path, '_', ' ')")} AS aw, {words('section')} AS hw, {all_words('text')} AS allw FROM cands
        )"""
_SHORTLIST = f"""{_CANDIDATES},
        good AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 24 AS is_initial, {overlap('aw', 'qw')} AS match FROM lists
        ),
        strong AS (SELECT * FROM good WHERE score >= 0.15),
        grouped AS (
            SELECT query_id, article_path, max(score) AS best, avg(score) FILTER (is_initial) AS mean, count(*) FILTER (is_initial) AS occurrences, any_value(match) AS match
            FROM strong GROUP BY query_id, article_path HAVING count(*) FILTER (is_initial) > 0 OR any_value(match) >= 0.3
        ),
        articles AS (
            SELECT query_id, article_path, 0.65 * best + 0.25 * coalesce(mean, best) + 0.10 * occurrences / greatest(1, sum(occurrences) OVER (PARTITION BY query_id)) + 0.08 * match AS article_score, occurrences
            FROM grouped
        ),
        shortlist AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY article_score DESC, article_path) AS article_rank FROM articles) WHERE article_rank <= 6
        )"""
_TURNS = r"""
        messages AS (
            SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM conversations WHERE role IN ('user', 'assistant')
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
        ),
        sessions AS (SELECT *, sum((trim(text) = '/new')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM messages WHERE role = 'user'),
        turns AS (
            SELECT conv_id, session, row_number() OVER (PARTITION BY conv_id, session ORDER BY turn) AS turn_no, trim(text) AS question, next AS answer
            FROM sessions WHERE trim(text) != '' AND NOT starts_with(trim(text), '/') AND lower(trim(text)) NOT IN ('exit', 'quit') AND next_role = 'assistant'
        ),
        memory AS (
            SELECT conv_id, session, turn_no, question, answer,
                list({'q': left(question, 300), 'a': left(regexp_replace(answer, '\[S\d+\]', '', 'g'), 600)}) OVER (PARTITION BY conv_id, session ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS turns,
                left(question, 220) AS focus
            FROM turns
        )"""

ORACLES: dict[str, str] = {
    "bm25_topk": f"WITH {_HITS} SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM hits",
    "bm25_pool": f"""
        WITH {bm25(_PASSAGES, "SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.source AS title, d.lang AS section, d.text AS body FROM benchmark b JOIN documents d ON d.lang = ['de', 'en', 'es', 'fr'][b.item_id % 4 + 1]", True)}
        SELECT query_id, chunk_id, round(score, 8) AS score, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM scored) WHERE rank <= 10
    """,
    "cosine_topk": f"WITH {cosine(0, 'base')} SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM base",
    "cosine_blend": f"""
        WITH {cosine(0, 'base')}, {cosine(1, 'intent')}
        SELECT query_id, chunk_id, round(0.6 * b.score + 0.4 * i.score, 8) AS score FROM base b JOIN intent i USING (query_id, chunk_id)
    """,
    "cosine_max_consolidated": f"""
        WITH {cosine(0, 'base')}, {cosine(1, 'intent')}
        SELECT query_id, chunk_id, round(max(score), 8) AS score FROM (SELECT * FROM base UNION ALL SELECT * FROM intent) GROUP BY query_id, chunk_id
    """,
    "rrf_hybrid": f"""
        WITH {bm25(_DOC_QUERIES, _INDEX)}, {cosine(0, 'base')},
        ranked AS (
            SELECT query_id, chunk_id, 'dense' AS branch, rank FROM base UNION ALL
            SELECT query_id, chunk_id, 'bm25', rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM scored) WHERE rank <= 40
        ),
        fused AS (
            SELECT query_id, chunk_id AS candidate_id, sum(1.0 / (60 + rank)) AS fused_score, min(rank) AS best_rank, string_agg(branch, ',' ORDER BY branch) AS origins
            FROM ranked GROUP BY query_id, chunk_id
        )
        SELECT query_id, candidate_id, round(fused_score, 8) AS fused_score, fused_rank, best_rank, origins
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 14) DESC, best_rank, candidate_id) AS fused_rank FROM fused) WHERE fused_rank <= 80
    """,
    "rrf_single_branch": f"""
        WITH {_HITS} SELECT query_id, chunk_id AS candidate_id, round(1.0 / (60 + rank), 8) AS fused_score, rank AS fused_rank FROM hits WHERE rank <= 20
    """,
    "dense_backfill": f"""
        WITH {bm25(_DOC_QUERIES, _INDEX)}, {cosine(0, 'base')},
        ranked AS (
            SELECT query_id, chunk_id, 'dense' AS branch, rank FROM base UNION ALL
            SELECT query_id, chunk_id, 'bm25', rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM scored) WHERE rank <= 40
        ),
        fused AS (
            SELECT query_id, chunk_id AS candidate_id, sum(1.0 / (60 + rank)) AS fused_score, min(rank) AS best_rank, bool_or(branch = 'dense') AS has_dense
            FROM ranked GROUP BY query_id, chunk_id
        )
        SELECT f.query_id, f.candidate_id, f.fused_rank, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 8) AS dense_pool_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 14) DESC, best_rank, candidate_id) AS fused_rank FROM fused) f
        JOIN embeddings q ON q.vec_id = f.query_id LEFT JOIN embeddings c ON c.vec_id = f.candidate_id WHERE f.fused_rank <= 80 AND NOT has_dense
    """,
    "embedding_cache_misses": """
        SELECT doc_id FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND text IS NOT NULL)
    """,
    "minmax_features": f"""
        WITH {_HITS} SELECT query_id, chunk_id, round(CASE WHEN abs(max(score) OVER w - min(score) OVER w) <= 1e-9 * greatest(abs(min(score) OVER w), abs(max(score) OVER w)) THEN 0.5
            ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS semantic
        FROM hits WINDOW w AS (PARTITION BY query_id)
    """,
    "overlap_features": rf"""
        WITH {_CANDIDATES}
        SELECT query_id, doc_id, round({overlap('qw', 'tw')}, 8) AS lexical,
            round(CASE WHEN len(allw) < 18 THEN 0.1 ELSE least(1.0, 0.35 + len(regexp_extract_all(text, '[.!?](?:\s|$)')) * 0.12 + least(len(allw), 160) / 400.0) END, 8) AS completeness,
            ceil(strlen(text) / 3.0)::BIGINT AS tokens
        FROM lists
    """,
    "section_affinity": f"""
        WITH {_CANDIDATES}
        SELECT query_id, doc_id, round(0.3 * len(list_intersect(qw, hw)) / greatest(1, len(hw)), 8) AS affinity FROM lists
    """,
    "article_shortlist": f"WITH {_SHORTLIST} SELECT query_id, article_path, round(article_score, 6) AS article_score, occurrences, article_rank FROM shortlist",
    "section_caps": f"""
        WITH {_SHORTLIST},
        expanded AS (
            SELECT l.query_id, l.chunk_id, l.article_path, l.section, l.score + 0.18 * (0.3 * len(list_intersect(qw, hw)) / greatest(1, len(hw))) + 0.08 * s.article_score AS expansion_score
            FROM lists l JOIN shortlist s USING (query_id, article_path) WHERE l.score >= 0.15
        ),
        by_section AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_path, section ORDER BY expansion_score DESC, chunk_id) AS k FROM expanded) WHERE k <= 3
        )
        SELECT query_id, chunk_id, article_path, round(expansion_score, 6) AS expansion_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_path ORDER BY expansion_score DESC, chunk_id) AS n FROM by_section) WHERE n <= 6
    """,
    "token_estimate": "SELECT doc_id, ceil(strlen(coalesce(text, '')) / 3.0)::BIGINT AS tokens FROM documents",
    "text_words": rf"""
        WITH lists AS (
            SELECT doc_id, {all_words('text')} AS w, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS terms, len({tokens('text')}) AS n_tokens FROM documents
        ),
        {_GRAMS.format("lists")},
        counted AS (SELECT doc_id, count(DISTINCT gram) AS n_trigrams FROM grams GROUP BY doc_id)
        SELECT doc_id, len(list_filter(list_distinct(w), lambda x: NOT list_contains({_STOPS}, x)))::INT AS n_words, least(96, len(list_distinct(terms)))::INT AS n_terms,
            n_tokens::INT AS n_tokens, md5(array_to_string(w, ' ')) AS normalized_md5, coalesce(n_trigrams, 0)::INT AS n_trigrams
        FROM lists LEFT JOIN counted USING (doc_id)
    """,
    "trigram_redundancy": f"""
        WITH lists AS (SELECT doc_id, {all_words('text')} AS w FROM documents),
        {_GRAMS.format("lists")},
        sets AS (SELECT DISTINCT doc_id, gram FROM grams),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id, count(*) AS n FROM sets a JOIN sets b ON b.doc_id = a.doc_id + 1 AND b.gram = a.gram GROUP BY a.doc_id)
        SELECT d.doc_id, round(coalesce(c.n, 0) / greatest(1, coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c.n, 0)), 8) AS redundancy
        FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN common c ON c.doc_id = d.doc_id LEFT JOIN sizes x ON x.doc_id = d.doc_id LEFT JOIN sizes y ON y.doc_id = e.doc_id
    """,
    "paragraph_dedup": r"""
        WITH hits AS (SELECT source AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, text FROM documents),
        parts AS (SELECT query_id, chunk_id, position, unnest(string_split(text, chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM hits),
        keyed AS (SELECT *, lower(trim(regexp_replace(paragraph, '\s+', ' ', 'g'))) AS key FROM parts),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY position, nth) AS k FROM keyed WHERE key != '') WHERE k = 1),
        joined AS (SELECT query_id, chunk_id, position, string_agg(paragraph, chr(10) ORDER BY nth) AS text FROM kept GROUP BY query_id, chunk_id, position)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position, md5(text) AS text_md5 FROM joined
    """,
    "even_sample": """
        WITH rows AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_no, count(*) OVER (PARTITION BY source) AS n FROM documents)
        SELECT source, doc_id, chunk_no FROM rows WHERE n <= 10 OR list_contains(list_transform(range(10), lambda k: round_even(k * (n - 1) / 9.0, 0)::BIGINT), chunk_no)
    """,
    "redirect_resolution": """
        WITH RECURSIVE entries AS (
            SELECT 'order_' || o_orderkey AS path, 'order_' || lead(o_orderkey) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS redirect_to FROM orders
        ),
        walk AS (
            SELECT path, path AS target, redirect_to AS next, 0 AS hops FROM entries
            UNION ALL
            SELECT w.path, e.path, e.redirect_to, w.hops + 1 FROM walk w JOIN entries e ON e.path = w.next WHERE w.hops < 64
        )
        SELECT path, target, hops::BIGINT AS hops FROM walk WHERE next IS NULL
    """,
    "intent_detection": r"""
        WITH rows AS (
            SELECT conv_id * 1000 + turn AS query_id, lower(['', 'Why did it end? ', 'Compare A and B. ', 'A timeline: ', 'Who was X? ', 'And '][(conv_id * 1000 + turn) % 6 + 1] || text) AS q
            FROM conversations WHERE role = 'user'
        )
        SELECT query_id, CASE
            WHEN regexp_matches(q, '\b(timeline|chronolog\w*)\b|when did .*events|what happened between|what happened (?:next|after)') THEN 'timeline'
            WHEN regexp_matches(q, '\b(compar\w*|versus|vs\.?|differences?|similarities?|differ)\b') THEN 'comparison'
            WHEN regexp_matches(q, '\b(why|caus\w*|explain|explanation|reason\w*|lead to|led to|contribut\w*|collapse\w*|immediate|mattered)\b') THEN 'cause'
            WHEN regexp_matches(q, '^(who|where|what) (?:was|were|is|are)\b|^tell me about\b') THEN 'lookup' ELSE 'general' END AS intent,
            regexp_matches(trim(q), '\b(that|those|these|it|its|he|she|they|their|them|his|her)\b|^what about\b|^which (?:one|cause)|what happened (?:next|after)|^and\b')
            OR regexp_replace(trim(q), '[?! .]+$', '') IN ('why', 'how', 'when', 'why not') AS follow_up
        FROM rows
    """,
    "date_extraction": """
        SELECT o_orderkey AS order_id, strftime(o_orderdate, '%-d %B %Y') AS date_text, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day,
            'day' AS precision, false AS approximate FROM orders
    """,
    "extract_events": """
        WITH e AS (
            SELECT o_custkey AS query_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, 'order_' || o_orderkey AS chunk_id,
                'Date: ' || strftime(o_orderdate, '%-d %B %Y') || '; Event: order ' || o_orderkey || ' was signed.' AS event FROM orders
        ),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id, year ORDER BY month, day, chunk_id) = 1 AS first FROM e),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, year, month, day, chunk_id) AS k FROM best) WHERE k <= 24)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY year, month, day, chunk_id) AS event_no, year, month, day, 'day' AS precision, false AS approximate, event, chunk_id FROM kept
    """,
    "dated_records": """
        WITH rows AS (
            SELECT o_custkey AS query_id, lpad(o_orderkey::VARCHAR, 12, '0') AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
        )
        SELECT query_id, chunk_id FROM rows WHERE n <= 10 OR list_contains(list_transform(range(10), lambda i: round_even(i * (n - 1) / 9.0, 0)::BIGINT), k)
    """,
    "ir_metrics": f"""
        WITH {_HITS}, {_GOLD}, {{each}}
        SELECT round(avg(hit_1), 8) AS hit_rate_1, round(avg(hit_3), 8) AS hit_rate_3, round(avg(hit_5), 8) AS hit_rate_5, round(avg(recall_1), 8) AS recall_1, round(avg(recall_3), 8) AS recall_3,
            round(avg(recall_5), 8) AS recall_5, round(avg(rr_5), 8) AS mrr_5, count(*) FILTER (judged) AS judged, count(*) FILTER (NOT judged) AS unjudged FROM each_query
    """,
    "ir_metrics_by_query": f"""
        WITH {_HITS}, {_GOLD}, {{each}}
        SELECT query_id, judged, round(hit_1, 8) AS hit_1, round(recall_1, 8) AS recall_1, round(hit_3, 8) AS hit_3, round(recall_3, 8) AS recall_3, round(hit_5, 8) AS hit_5,
            round(recall_5, 8) AS recall_5, round(rr_5, 8) AS rr_5 FROM each_query
    """,
    "metric_summary": f"""
        WITH {_HITS}, {_GOLD}, {{each}}
        SELECT {", ".join(f"round({f}({c}), 8) AS {c}_{n}" for c in ("recall_5", "rr_5") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))}
        FROM each_query WHERE judged
    """,
    "facet_coverage": f"""
        WITH {_HITS}, {_FACETS},
        total AS (SELECT query_id, count(DISTINCT facet) AS facets FROM facets WHERE length(span) > 0 GROUP BY query_id),
        found AS (SELECT query_id, count(DISTINCT facet) AS covered FROM matched GROUP BY query_id)
        SELECT query_id, facets, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / facets, 8) AS coverage FROM total LEFT JOIN found USING (query_id)
    """,
    "ndcg_partial": f"""
        WITH {_HITS}, {_FACETS},
        gains AS (SELECT h.query_id, h.rank, CASE WHEN (h.query_id, h.rank) IN (SELECT (query_id, rank) FROM matched) THEN 2 ELSE 0 END AS gain FROM hits h),
        own AS (
            SELECT query_id, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, coalesce(1.0 / min(rank) FILTER (gain > 0), 0) AS mrr FROM gains WHERE rank <= 10 GROUP BY query_id
        ),
        best AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS place FROM gains),
        ideals AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(place + 1)) AS ideal FROM best WHERE place <= 10 GROUP BY query_id)
        SELECT query_id, round(dcg, 8) AS dcg, round(ideal, 8) AS ideal, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 8) AS ndcg, round(mrr, 8) AS mrr FROM own JOIN ideals USING (query_id)
    """,
    "repeated_trigram_share": f"""
        WITH w AS (SELECT source AS query_id, doc_id AS source_no, {all_words('text')} AS w FROM documents),
        grams AS (SELECT query_id, source_no, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS gram FROM w WHERE len(w) >= 3),
        marked AS (SELECT query_id, source_no > min(source_no) OVER (PARTITION BY query_id, gram) AS again FROM grams)
        SELECT query_id, count(*) AS grams, count(*) FILTER (again) AS repeated, round(count(*) FILTER (again) / count(*), 8) AS share FROM marked GROUP BY query_id
    """,
    "citation_check": r"""
        WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, text || ' [S1] [S' || turn || ']' AS answer FROM conversations WHERE role = 'assistant'),
        c AS (SELECT answer_id, list_sort(list_distinct(regexp_extract_all(answer, '\[(S\d+)\]', 1))) AS cited FROM a)
        SELECT answer_id, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda x: x NOT IN ('S1', 'S2', 'S3')), ',') AS unknown, len(cited) > 0 AS has_citations FROM c
    """,
    "usage_accounting": """
        WITH r AS (
            SELECT event_id, floor(value) AS p, CASE WHEN event_id % 3 = 0 THEN value ELSE floor(value) END AS o, (event_id % 5) * 1e9 AS d FROM events
        ),
        n AS (SELECT event_id, CASE WHEN p >= 0 THEN p::BIGINT END AS prompt_tokens, CASE WHEN o >= 0 AND o = floor(o) THEN o::BIGINT END AS output_tokens, nullif(d, 0) / 1e9 AS s FROM r)
        SELECT event_id, prompt_tokens, output_tokens, prompt_tokens + output_tokens AS total_tokens, round(output_tokens / s, 8) AS tokens_per_second FROM n
    """,
    "run_summary": f"""
        WITH {_HITS}, r AS (SELECT h.query_id, h.rank, d.source FROM hits h JOIN documents d ON d.doc_id = h.chunk_id)
        SELECT query_id, count(*) AS candidates, count(DISTINCT source) AS candidates_articles, count(*) FILTER (rank <= 12) AS selected,
            count(DISTINCT source) FILTER (rank <= 12) AS selected_articles FROM r GROUP BY query_id
    """,
    "label_precision": f"""
        WITH {_HITS} SELECT query_id, round(avg(quality), 8) AS quality, round(avg(toxic), 8) AS toxic, count(*) AS labelled FROM hits h JOIN labels l ON l.doc_id = h.chunk_id GROUP BY query_id
    """,
    "turn_window_state": rf"""
        WITH {_TURNS},
        years AS (
            SELECT conv_id, session, turn_no, unnest(y) AS y, generate_subscripts(y, 1) AS k FROM (SELECT *, regexp_extract_all(question || ' ' || answer, '\b\d{{3,4}}\b') AS y FROM memory)
        ),
        firsts AS (SELECT conv_id, session, turn_no, y, min(k) AS k FROM years GROUP BY conv_id, session, turn_no, y),
        periods AS (
            SELECT conv_id, session, turn_no, string_agg(y, ',' ORDER BY k) AS periods
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, session, turn_no ORDER BY k) AS n FROM firsts) WHERE n <= 10 GROUP BY conv_id, session, turn_no
        )
        SELECT m.conv_id, m.turn_no, len(m.turns)::INT AS turns, coalesce(p.periods, '') AS periods, m.focus, md5(array_to_string(list_transform(m.turns, lambda x: x.a), '|')) AS summaries_md5
        FROM memory m LEFT JOIN periods p USING (conv_id, session, turn_no)
    """,
    "turn_context": f"""
        WITH {_TURNS},
        parts AS (
            SELECT conv_id, turn_no, left('Subject: ' || focus, 250) AS head,
                array_to_string(list_transform(turns[-2:], lambda x: 'Asked: ' || x.q || chr(10) || 'Answered (not checked): ' || x.a), chr(10)) AS rest FROM memory
        )
        SELECT conv_id, turn_no, head || chr(10) || right(rest, 1800 - length(head)::INT - 1) AS context FROM parts
    """,
    "store_upsert": f"""
        WITH {_TURNS}, ids AS (SELECT DISTINCT conv_id FROM turns)
        SELECT 'c' || conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'New ' ELSE '' END || 'Conversation ' || conv_id AS title, 1.6e9 + conv_id AS created,
            CASE WHEN conv_id % 2 = 0 THEN 1.7e9 ELSE 1.6e9 + conv_id END AS updated, 0::INT AS archived, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END::INT AS revision FROM ids
    """,
    "store_list": f"""
        WITH {_TURNS}, ids AS (SELECT DISTINCT conv_id FROM turns)
        SELECT 'c' || conv_id AS id, 'Conversation ' || conv_id AS title, 1.6e9 + conv_id AS created, 1.6e9 + conv_id AS updated, 1::INT AS revision
        FROM ids WHERE contains(lower('Conversation ' || conv_id), 'conversation 1')
    """,
}
_QUESTIONS = "SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user'"
_PASSAGE_PLANS = plan("SELECT item_id AS query_id, text AS question FROM benchmark")
_RERANKED = f"""{_CANDIDATES}, {_PASSAGE_PLANS},
        own_cands AS (SELECT query_id, chunk_id, article_path, section, text, score, rank FROM cands), {features('own_cands')},
        ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, article_path, chunk_id) AS rerank_rank FROM reranked)"""
ORACLES |= {
    "question_plans": f"""
        WITH {plan(_QUESTIONS)}
        SELECT query_id, intent, CASE WHEN broad THEN 'broad' ELSE 'narrow' END AS breadth, array_to_string(seeds, '|') AS seeds, len(names)::INT AS entities, article_limit::INT AS article_limit FROM plan
    """,
    "seed_queries": f"WITH {plan(_QUESTIONS)} SELECT query_id, (generate_subscripts(seeds, 1) - 1)::INT AS seed_no, unnest(seeds) AS query FROM plan",
    "rerank_deterministic": f"""
        WITH {_RERANKED} SELECT query_id, chunk_id, rerank_score, rerank_rank::INT AS rerank_rank, round(lexical, 8) AS lexical, round(title, 8) AS title FROM ordered
    """,
    "timeline_pool": f"""
        WITH {_RERANKED},
        good AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_path, section ORDER BY chunk_id) = 1 AS opens FROM ordered WHERE rerank_score >= 0.1)
        SELECT query_id, position::INT AS position, chunk_id
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN opens THEN 1 ELSE 2 END, rerank_score DESC, chunk_id) AS position FROM good) WHERE position <= 32
    """,
    "text_keys": rf"""
        SELECT page_id, {title_key('url')} AS title_key, {entity_key('url')} AS entity_key,
            CASE WHEN trim(name) = '' THEN 'conversation' ELSE trim(name) END || '.md' AS export_name, trim(translate(url, chr(10) || chr(13), ' ')) AS single_line
        FROM (SELECT *, left(trim(regexp_replace(url, '[^\p{{L}}\p{{N}} _-]', '-', 'g')), 80) AS name FROM pages)
    """,
    "preview_excerpt": r"""
        WITH squeezed AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
        clipped AS (SELECT *, left(t, 281) AS c, reverse(left(t, 281)) AS r, length(left(t, 281)) AS n FROM squeezed),
        marks AS (
            SELECT *, greatest(CASE WHEN contains(r, ' .') THEN n - strpos(r, ' .') - 1 ELSE -1 END, CASE WHEN contains(r, ' ?') THEN n - strpos(r, ' ?') - 1 ELSE -1 END,
                CASE WHEN contains(r, ' !') THEN n - strpos(r, ' !') - 1 ELSE -1 END) AS sentence, CASE WHEN contains(r, ' ') THEN n - strpos(r, ' ') ELSE -1 END AS word
            FROM clipped
        )
        SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 280 THEN t
            ELSE CASE WHEN sentence >= 140 THEN left(c, sentence + 1) ELSE rtrim(left(c, CASE WHEN word >= 80 THEN word ELSE 280 END)) END || '…' END AS preview
        FROM marks
    """,
    "sentence_trim": r"""
        WITH clipped AS (SELECT doc_id, text, left(text, 502) AS c FROM documents),
        ends AS (
            SELECT doc_id, max(n) AS n FROM (SELECT doc_id, c, unnest(range(1, 501)) AS n FROM clipped)
            WHERE substr(c, n, 1) IN ('.', '!', '?') AND (n = length(c) OR regexp_matches(substr(c, n + 1, 1), '\s')) AND ceil(strlen(left(c, n)) / 3.0) <= 200 GROUP BY doc_id
        )
        SELECT doc_id, CASE WHEN length(text) <= 500 AND ceil(strlen(text) / 3.0) <= 200 THEN text ELSE coalesce(rtrim(left(text, n), ' '), '') END AS excerpt FROM clipped LEFT JOIN ends USING (doc_id)
    """,
    "embedding_texts": """
        SELECT 'doc_' || doc_id || '_000' AS chunk_id, md5(coalesce(text, '')) AS text, md5(concat_ws(chr(10) || chr(10), 'Introduction', text)) AS section,
            md5(concat_ws(chr(10) || chr(10), 'doc ' || doc_id || ' > Introduction', text)) AS title FROM documents
    """,
    "path_validation": r"""
        WITH p AS (SELECT page_id, url, regexp_extract(url, '^\w+://[^/]+/(.*)$', 1) AS rest FROM pages)
        SELECT page_id, url != '' AND NOT regexp_matches(url, '^/|\\|[\x00-\x1f]|(^|/)\.\.?(/|$)') AS whole, rest != '' AND NOT regexp_matches(rest, '^/|\\|[\x00-\x1f]|(^|/)\.\.?(/|$)') AS inside FROM p
    """,
    "title_search": f"""
        WITH titles AS (SELECT p_name || '_' || p_partkey AS path, {title_key("p_name || '_' || p_partkey")} AS key FROM part),
        asked AS (SELECT p_partkey AS query_id, {title_key('p_name')} AS wanted FROM part WHERE p_partkey % 100 = 0),
        by_word AS (SELECT path, key, unnest(list_distinct(string_split(key, ' '))) AS word FROM titles),
        by_asked AS (SELECT query_id, wanted, unnest(list_distinct(string_split(wanted, ' '))) AS word FROM asked),
        shared AS (SELECT query_id, path, count(*) AS shared, any_value(key) AS key, any_value(wanted) AS wanted FROM by_word JOIN by_asked USING (word) GROUP BY query_id, path),
        tiers AS (SELECT *, CASE WHEN key = wanted THEN 0 WHEN starts_with(key, wanted) THEN 1 ELSE 2 END AS tier FROM shared)
        SELECT query_id, path, tier::INT AS tier, shared, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, shared DESC, length(key), path) AS rank FROM tiers) WHERE rank <= 5
    """,
    "candidate_identity": """
        SELECT 'doc_' || doc_id || '_000' AS chunk_id, sha256('["corpus-1","chunker-1","doc_' || doc_id || '","Introduction",null,null,null,' || to_json(text) || ']') AS candidate_id,
            'doc_' || doc_id AS canonical_article, ceil(strlen(text) / 3.0)::BIGINT AS estimated_text_tokens FROM documents
    """,
    "lexical_manifest": """
        WITH c AS (
            SELECT doc_id, sha256('doc_' || doc_id || '_000' || chr(31) || sha256('["corpus-1","chunker-1","doc_' || doc_id || '","Introduction",null,null,null,' || to_json(text) || ']')) AS h FROM documents
        )
        SELECT 1 AS schema, 'corpus-1' AS corpus_version, 'chunker-1' AS chunker_version, count(*) AS chunks, count(DISTINCT doc_id) AS articles,
            sha256(concat_ws(',', sum(('0x' || substr(h, 1, 8))::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::HUGEINT)::VARCHAR,
                sum(('0x' || substr(h, 17, 8))::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::HUGEINT)::VARCHAR)) AS pool_sha256 FROM c
    """,
}
_OWN_INDEX = "SELECT 'doc_' || doc_id || '_000' AS chunk_id, 'doc ' || doc_id AS title, 'Introduction' AS section, text AS body FROM documents"
_INTENT_HITS = "CASE intent2 " + " ".join(
    f"WHEN '{kind}' THEN " + " + ".join(f"contains(lower(section), '{x}')::INT" for x in parts) for kind, parts in rank.INTENT_TERMS.items()
) + " ELSE 0 END"
_OFF = " OR ".join(f"contains(lower(section), '{x}')" for x in rank.AFTERMATH)
#: CTEs up to `retrieved`: passages through both branches, fusion and hybrid reranking; the passage's vector is that of the document with its id.
_HYBRID = f"""{bm25(_PASSAGES.replace("text AS query", "trim(text) AS query"), _OWN_INDEX)}, {_PASSAGE_PLANS},
        near AS (
            SELECT q.vec_id AS query_id, 'doc_' || c.vec_id || '_000' AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score
            FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark)
        ),
        both_branches AS (
            SELECT query_id, chunk_id, score, 'dense' AS branch, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= 40
            UNION ALL SELECT query_id, chunk_id, score, 'bm25', rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM scored) WHERE rank <= 40
        ),
        fused AS (
            SELECT query_id, chunk_id, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (branch = 'bm25'), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (branch = 'dense'), 0) AS fused_score,
                min(rank) AS best_rank, string_agg(branch, ',' ORDER BY branch) AS origins, max(score) FILTER (branch = 'dense') AS dense_score FROM both_branches GROUP BY query_id, chunk_id
        ),
        fused_ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, best_rank, chunk_id) AS fused_rank FROM fused),
        fused_texts AS (
            SELECT f.query_id, f.chunk_id, 'doc_' || d.doc_id AS article_path, 'Introduction' AS section, d.text, coalesce(dense_score, fused_score) AS score, fused_score, fused_rank, origins
            FROM fused_ranks f JOIN documents d ON f.chunk_id = 'doc_' || d.doc_id || '_000' WHERE fused_rank <= 80
        ), {features('fused_texts')},
        with_intent AS (
            SELECT *, CASE WHEN intent = 'comparison' AND regexp_matches(resolved, '(?i)caus') THEN 'cause' ELSE intent END AS intent2, fused_score / (2 / 61.0::DOUBLE) AS share,
                {words('resolved')} AS rw, lower(replace(article_path, '_', ' ')) AS low_title FROM reranked
        ),
        fitted AS (
            SELECT *, least(1.0, ({_INTENT_HITS}) / 2.0) + 0.3 * (len(list_intersect(rw, hw)) / greatest(1, len(hw)))
                - CASE WHEN intent2 = 'cause' AND ({_OFF}) AND len(list_intersect(rw, {sql_list(rank.AFTERMATH_WORDS)})) = 0 THEN 1.0 ELSE 0.0 END AS affinity,
                (regexp_matches(low_title, '\\b\\d{{3,4}}\\b') AND len(hints) = 0 AND len(list_filter(keys, lambda k: starts_with(low_title, k || ' '))) > 0)::INT AS stale
            FROM with_intent
        ),
        final_scores AS (
            SELECT *, round(rerank_score + 0.10::DOUBLE * share + 0.18::DOUBLE * greatest(-1.0, least(1.0, affinity)) - 0.25 * stale, 8) - CASE WHEN regexp_matches(section, '{rank.REFERENCE_LIKE}') THEN 0.65 ELSE 0.0 END AS final
            FROM fitted
        ),
        retrieved AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS final_rank FROM final_scores)"""
#: CTEs up to `chunks` (doc_id, chunk_no, chunk): lines joined up to 2000 characters, with whole lines of up to 300 carried over, a line a step.
_CHUNKS = r"""paragraphs AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS p FROM documents),
        walk AS (
            SELECT doc_id, p, 1 AS i, 0 AS chunk_no, []::VARCHAR[] AS now, NULL::VARCHAR AS chunk FROM paragraphs
            UNION ALL
            SELECT doc_id, p, i + 1, chunk_no + full_now::INT,
                CASE WHEN i > len(p) THEN [] WHEN full_now THEN list_append(now[len(now) - greatest(1, len(list_filter(range(1, len(now) + 1), lambda j: list_sum(list_transform(now[len(now) - j + 1:], lambda x: length(x))) <= 300))) + 1:], p[i])
                    ELSE list_append(now, p[i]) END,
                CASE WHEN full_now THEN trim(array_to_string(now, chr(10) || chr(10))) END
            FROM (SELECT *, len(now) > 0 AND (i > len(p) OR length(array_to_string(list_append(now, p[i]), chr(10) || chr(10))) > 2000) AS full_now FROM walk) WHERE i <= len(p) + 1
        ),
        chunks AS (SELECT doc_id, chunk_no - 1 AS chunk_no, chunk FROM walk WHERE chunk IS NOT NULL)"""
ORACLES |= {
    "discovery_merge": f"""
        WITH {_HITS}, {_PASSAGE_PLANS},
        found AS (
            SELECT h.query_id, CASE WHEN h.rank <= 10 THEN 0 ELSE 1 END AS stage, h.rank, 'doc_' || h.chunk_id AS article_path, p.broad, p.article_limit, least(2, len(p.names)) AS entity_places,
                CASE WHEN p.broad AND p.article_limit >= 6 THEN least(3, greatest(0, p.article_limit - least(2, len(p.names)) - 1)) ELSE 0 END AS related_places FROM hits h JOIN plan p USING (query_id)
        ),
        ranked_found AS (
            SELECT *, row_number() OVER (PARTITION BY query_id, stage ORDER BY rank, article_path) AS k, greatest(1, article_limit - entity_places - related_places) AS seed_places,
                count(*) FILTER (stage = 0) OVER (PARTITION BY query_id) AS seeds FROM found WHERE stage = 0 OR broad
        ),
        kept AS (SELECT * FROM ranked_found WHERE CASE WHEN stage = 0 THEN k <= seed_places ELSE least(seeds, seed_places) + k <= article_limit - entity_places END)
        SELECT query_id, article_path, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, article_path)::INT AS position, CASE WHEN stage = 0 THEN 'question search' ELSE 'related' END AS reasons FROM kept
    """,
    "chunk_documents": f"""
        WITH RECURSIVE {_CHUNKS}
        SELECT 'doc_' || doc_id AS article_path, chunk_no::INT AS chunk_no, 'doc_' || doc_id || '_' || lpad(chunk_no::VARCHAR, 3, '0') AS chunk_id, 'Introduction' AS section, length(chunk)::INT AS chars, md5(chunk) AS text_md5 FROM chunks
    """,
    "pool_cap": f"""
        WITH RECURSIVE {_HITS}, {_CHUNKS},
        pooled AS (
            SELECT h.query_id, 'doc_' || c.doc_id AS article_path, h.rank AS article_position, c.chunk_no, 'doc_' || c.doc_id || '_' || lpad(c.chunk_no::VARCHAR, 3, '0') AS chunk_id,
                row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank, c.chunk_no) AS n FROM hits h JOIN chunks c ON c.doc_id = h.chunk_id
        )
        SELECT query_id, article_path, article_position::INT AS article_position, chunk_no::INT AS chunk_no, chunk_id FROM pooled WHERE n <= 480
    """,
    "html_tables": "SELECT -1::BIGINT AS page_id, 0 AS table_no, 'Key: ' || r_regionkey || '; Name: ' || r_name AS row_text FROM region",
    "hybrid_retrieve": f"""
        WITH {_HYBRID} SELECT query_id, chunk_id, final AS rerank_score, final_rank::INT AS rerank_rank, fused_rank::INT AS fused_rank, origins FROM retrieved
    """,
    "lexical_only_support": f"""
        WITH {_HYBRID}, {_FACETS.replace("FROM hits h JOIN documents d ON d.doc_id = h.chunk_id", "FROM (SELECT query_id, final_rank AS rank, text FROM retrieved) h").replace("d.text", "h.text")}
        SELECT query_id, final_rank::INT AS rank, chunk_id FROM retrieved WHERE origins = 'bm25' AND (query_id, final_rank) IN (SELECT (query_id, rank) FROM matched)
    """,
    "comparison_leaders": f"""
        WITH {_SHORTLIST},
        expanded AS (
            SELECT l.query_id, l.chunk_id, l.article_path, l.section, l.text, s.article_rank, l.score + 0.18 * (0.3 * len(list_intersect(qw, hw)) / greatest(1, len(hw))) + 0.08 * s.article_score AS score
            FROM lists l JOIN shortlist s USING (query_id, article_path) WHERE l.score >= 0.15
        ),
        in_section AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_path, section ORDER BY score DESC, chunk_id) AS k FROM expanded) WHERE k <= 3),
        in_article AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_path ORDER BY score DESC, chunk_id) AS n FROM in_section) WHERE n <= 6),
        counted AS (SELECT *, (SELECT count(DISTINCT article_path) FROM in_article b WHERE b.query_id = a.query_id) > 1 AND n = 1 AS leads FROM in_article a),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN leads THEN 0 ELSE 1 END, CASE WHEN leads THEN article_rank ELSE -score END, chunk_id) AS position FROM counted
        ),
        parts AS (SELECT query_id, chunk_id, article_path, position, unnest(string_split(text, chr(10) || chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS nth FROM placed),
        keyed_parts AS (SELECT *, lower(trim(regexp_replace(paragraph, '\\s+', ' ', 'g'))) AS part_key FROM parts),
        kept AS (SELECT DISTINCT query_id, chunk_id, article_path, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, part_key ORDER BY position, nth) AS f FROM keyed_parts WHERE part_key != '') WHERE f = 1)
        SELECT query_id, position::INT AS position, chunk_id, article_path
        FROM (SELECT query_id, chunk_id, article_path, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position FROM kept) WHERE position <= 10
    """,
    "phrase_titles": f"""
        WITH titles AS (SELECT DISTINCT regexp_extract(text, '^(\\S+)', 1) AS path FROM documents WHERE regexp_extract(text, '^(\\S+)', 1) != ''),
        keyed_titles AS (SELECT path, {title_key('path')} AS key FROM titles),
        q AS ({_QUESTIONS}),
        split AS (SELECT query_id, regexp_extract_all(regexp_replace(question, '[’'']s\\b', '', 'g'), '(?:{_W}|’)+') AS w FROM q),
        runs AS (
            SELECT query_id, size, start, w[start:start + size - 1] AS p FROM (SELECT query_id, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM split, (SELECT unnest(range(1, 7)) AS size))
        ),
        phrases AS (
            SELECT query_id, array_to_string(p, ' ') AS phrase, min((6 - size) * 1000000 + start) AS first_at FROM runs
            WHERE NOT list_contains({sql_list(discovery.STOPWORDS)}, lower(p[1])) AND NOT list_contains({sql_list(discovery.STOPWORDS)}, lower(p[-1])) GROUP BY query_id, phrase
        ),
        numbered AS (SELECT *, {title_key('phrase')} AS key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_at) - 1 AS phrase_no FROM phrases) WHERE phrase_no < 48),
        found AS (
            SELECT * FROM (SELECT n.query_id, n.phrase_no, n.key, t.path, row_number() OVER (PARTITION BY n.query_id, n.key ORDER BY n.phrase_no, t.path) AS k
                FROM numbered n JOIN keyed_titles t USING (key) WHERE key != '' AND NOT list_contains({sql_list(discovery.GENERIC_TITLES)}, key)) WHERE k = 1
        ),
        ranked_titles AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phrase_no, key, path) AS r FROM found),
        first_title AS (SELECT * FROM ranked_titles WHERE r = 1),
        second_title AS (
            SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY b.r) AS again FROM ranked_titles b JOIN first_title a USING (query_id) WHERE b.r > 1 AND NOT contains(a.key, b.key)) WHERE again = 1
        )
        SELECT query_id, 0 AS position, path FROM first_title UNION ALL SELECT query_id, 1, path FROM second_title
    """,
    "link_scores": f"""
        WITH links AS (
            SELECT doc_id AS article_path, (doc_id + step)::VARCHAR AS href, array_to_string(string_split(text, ' ')[1:2], ' ') AS anchor, text AS context, step AS position FROM documents, (SELECT unnest([1, 2, 3]) AS step)
        ),
        asked AS (SELECT doc_id AS query_id, doc_id AS article_path, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % 100 = 0),
        lists AS (
            SELECT query_id, href, position, list_filter(list_distinct({all_words('query')}), lambda x: NOT list_contains({sql_list(discovery.LINK_STOPS)}, x)) AS qw,
                list_distinct({all_words('anchor')}) AS aw, list_distinct({all_words("anchor || ' ' || context")}) AS bw FROM links JOIN asked USING (article_path)
        ),
        scored AS (
            SELECT query_id, href, position, 0.48 * (len(list_intersect(qw, bw)) / greatest(1, len(qw)))
                + 0.27 * least(1.0, (len(list_intersect(qw, aw)) + len(list_intersect({sql_list(discovery.CUES)}, aw))) / 2)
                + 0.15 * (len(list_intersect({sql_list(discovery.CUES)}, bw)) / {len(discovery.CUES)}.0::DOUBLE) + 0.10 * greatest(0.0, 1 - position / 180.0::DOUBLE) AS score FROM lists
        )
        SELECT query_id, href, round(score, 8) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, href) AS rank FROM scored) WHERE rank <= 2
    """,
    "store_export": rf"""
        WITH {_TURNS},
        saved AS (
            SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || '_Created ' || strftime(to_timestamp(1600000000 + conv_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || ' UTC_' || chr(10) || chr(10)
                || string_agg('## Question' || chr(10) || chr(10) || trim(question) || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || trim(answer) || chr(10) || chr(10), '' ORDER BY turn_no, question) AS markdown
            FROM turns GROUP BY conv_id
        )
        SELECT 'c' || conv_id AS id, md5(regexp_replace(markdown, '\s+$', '') || chr(10)) AS markdown_md5, length(regexp_replace(markdown, '\s+$', '') || chr(10))::INT AS chars FROM saved
    """,
}
_EACH = """relevant AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY query_id),
        found AS (
            SELECT h.query_id, min(rank) AS first, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 3) AS f3, count(*) FILTER (rank <= 5) AS f5
            FROM hits h JOIN gold g USING (query_id, chunk_id) GROUP BY h.query_id
        ),
        each_query AS (
            SELECT a.query_id, r.relevant IS NOT NULL AS judged, CASE WHEN r.relevant IS NOT NULL THEN (coalesce(first, 999999) <= 1)::INT::DOUBLE END AS hit_1,
                CASE WHEN r.relevant IS NOT NULL THEN (coalesce(first, 999999) <= 3)::INT::DOUBLE END AS hit_3, CASE WHEN r.relevant IS NOT NULL THEN (coalesce(first, 999999) <= 5)::INT::DOUBLE END AS hit_5,
                coalesce(f1, 0) / r.relevant AS recall_1, coalesce(f3, 0) / r.relevant AS recall_3, coalesce(f5, 0) / r.relevant AS recall_5,
                CASE WHEN r.relevant IS NOT NULL THEN CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END END AS rr_5
            FROM asked a LEFT JOIN relevant r USING (query_id) LEFT JOIN found f USING (query_id)
        )"""
ORACLES = {name: sql.replace("{each}", _EACH) for name, sql in ORACLES.items()}
