"""The registered queries again as DuckDB SQL over the same tables.

Written from the definitions, with none of the Spark code; the tests and the
check compare both row by row.
"""

ROLES_IN_SYSTEM_MEETINGS = "conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')"


def chunked(source: str = "conversations") -> str:
    return rf"""
    chunks AS (
      SELECT conv_id, turn, CAST(i AS INTEGER) AS chunk, role, array_to_string(w[i * 30 + 1 : i * 30 + 40], ' ') AS text
      FROM (
        SELECT conv_id, turn, role, w, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 40, 0) / 30.0) AS BIGINT))) AS i
        FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '\S+') AS w FROM {source})
        WHERE len(w) > 0))"""


def counted(source: str, key: str, name: str) -> str:
    return rf"""
    {name} AS (
      SELECT {key}, term, count(*) AS tf
      FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {source})
      GROUP BY ALL)"""


UNIT = "conv_id, turn, chunk"
REQUESTS = "requests AS (SELECT item_id AS req_id, text FROM benchmark)"
TF = f"{chunked()}, {counted('chunks', UNIT + ', role', 'tf')}"
RTF = f"{REQUESTS}, {counted('requests', 'req_id', 'rtf')}"

DF = f"""
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    n AS (SELECT count(*) AS n, sum(len) AS words FROM (SELECT sum(tf) AS len FROM tf GROUP BY {UNIT}))"""

IDF = "(ln((n + 1) / (coalesce(df, 0) + 1)) + 1)"

WEIGHTED = f"""
    raw AS (SELECT tf.*, (1 + ln(tf)) * {IDF} AS w FROM tf JOIN df USING (term), n),
    weighted AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {UNIT})) AS weight FROM raw),
    rraw AS (SELECT rtf.*, (1 + ln(tf)) * {IDF} AS w FROM rtf LEFT JOIN df USING (term), n),
    rweighted AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY req_id)) AS weight FROM rraw)"""


def ranked(scored: str, key: str, k: int) -> str:
    return f"""
    hits AS (
      SELECT req_id, {key}, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
      FROM (
        SELECT req_id, {key}, score, row_number() OVER (PARTITION BY req_id ORDER BY round(score, 9) DESC, {key}) AS rank
        FROM {scored} WHERE score IS NOT NULL AND NOT isnan(score))
      WHERE rank <= {k})"""


TERM_SCORES = f"""
    scored AS (
      SELECT req_id, {UNIT}, sum(r.weight * u.weight) AS score
      FROM rweighted r JOIN weighted u USING (term) GROUP BY ALL)"""

BM25_SCORES = f"""
    lens AS (SELECT {UNIT}, sum(tf) AS len FROM tf GROUP BY ALL),
    scored AS (
      SELECT req_id, {UNIT},
             sum(r.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len / (words / n)))) AS score
      FROM rtf r JOIN tf t USING (term) JOIN df USING (term) JOIN lens USING ({UNIT}), n GROUP BY ALL)"""


def hashed(source: str, key: str, name: str) -> str:
    """Long form of the hashed vectors: one row per non-zero bucket."""
    return f"""
    {name} AS (
      SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket,
             CAST(sum(tf * CASE WHEN CAST('0x' || substr(md5(term), 9, 4) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS value
      FROM {source} GROUP BY ALL HAVING value <> 0)"""


def long_form(vectors: str = "hv", encoder: str = "hash-md5-256") -> str:
    return f"""
    SELECT {UNIT}, '{encoder}' AS encoder, bucket, value,
           round(sqrt(sum(value * value) OVER (PARTITION BY {UNIT})), 6) AS norm
    FROM {vectors}"""


HASH_PAIRS = f"""
    rnorm AS (SELECT req_id, sqrt(sum(value * value)) AS a FROM rv GROUP BY ALL),
    unorm AS (SELECT {UNIT}, role, sqrt(sum(value * value)) AS b FROM hv GROUP BY ALL),
    dots AS (SELECT req_id, {UNIT}, sum(rv.value * hv.value) AS d FROM rv JOIN hv USING (bucket) GROUP BY ALL),
    pairs AS (
      SELECT req_id, {UNIT}, role, coalesce(d, 0) / (a * b) AS score
      FROM rnorm CROSS JOIN unorm LEFT JOIN dots USING (req_id, {UNIT}))"""

HASHED = f"{TF}, {RTF}, {hashed('tf', UNIT + ', role', 'hv')}, {hashed('rtf', 'req_id', 'rv')}, {HASH_PAIRS}"

def sides(tables: int, bits: int) -> str:
    return f"""
    planes AS (
      SELECT t, b, d AS bucket, CASE WHEN (strpos('0123456789abcdef', md5(t || ':' || b || ':' || d)[1]) - 1) % 2 = 0 THEN 1 ELSE -1 END AS s
      FROM range({tables}) x(t), range({bits}) y(b), range(256) z(d))"""


def signature(vectors: str, key: str, name: str) -> str:
    return f"""
    {name} AS (
      SELECT {key}, t, sum(CASE WHEN side >= 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS code
      FROM (SELECT {key}, t, b, sum(value * s) AS side FROM {vectors} JOIN planes USING (bucket) GROUP BY ALL) GROUP BY ALL)"""


CONTEXT = """
    SELECT req_id, string_agg(line[1:{budget}], chr(10) ORDER BY rank) AS context, count(*) AS n_hits
    FROM (
      SELECT *, sum(length(line)) OVER so_far + count(*) OVER so_far - 1 AS used
      FROM lines WINDOW so_far AS (PARTITION BY req_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
    WHERE used <= {budget} OR rank = 1 GROUP BY req_id"""

CORRECTED = """
    corrected AS (
      SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 0 THEN '' WHEN role = 'system' THEN 'corrected ' || text ELSE text END AS text
      FROM conversations
      UNION ALL SELECT conv_id + 1000000, turn, role, text FROM conversations WHERE conv_id % 5 = 0)"""

MEANING = r"""
    said AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM SOURCE),
    placed AS (SELECT conv_id, turn, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM said),
    beside AS (
      SELECT a.term, CAST(CAST('0x' || substr(md5(b.term), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket,
             CAST(sum(CASE WHEN CAST('0x' || substr(md5(b.term), 9, 4) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value
      FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND a.turn = b.turn AND abs(a.i - b.i) BETWEEN 1 AND 2
      GROUP BY ALL HAVING value <> 0)"""


def meaning(source: str = "conversations") -> str:
    return MEANING.replace("SOURCE", source)


MEANING_PAIRS = f"""
    unit_length AS (SELECT term, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY term)) AS x FROM beside),
    uv AS (SELECT {UNIT}, bucket, sum(weight * x) AS value FROM weighted JOIN unit_length USING (term) GROUP BY ALL),
    rv AS (SELECT req_id, bucket, sum(weight * x) AS value FROM rweighted JOIN unit_length USING (term) GROUP BY ALL),
    un AS (SELECT {UNIT}, sqrt(sum(value * value)) AS b FROM uv GROUP BY ALL HAVING b > 0),
    rn AS (SELECT req_id, sqrt(sum(value * value)) AS a FROM rv GROUP BY ALL HAVING a > 0),
    dots AS (SELECT req_id, {UNIT}, sum(rv.value * uv.value) AS d FROM rv JOIN uv USING (bucket) GROUP BY ALL),
    pairs AS (SELECT req_id, {UNIT}, coalesce(d, 0) / (a * b) AS score FROM rn CROSS JOIN un LEFT JOIN dots USING (req_id, {UNIT}))"""

NEAREST = f"""
    WITH means AS (
      SELECT label, i, avg(x) AS x
      FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
      GROUP BY ALL),
    requests AS (SELECT label AS req_id, list(x ORDER BY i) AS vec FROM means GROUP BY label),
    scored AS (
      SELECT req_id, vec_id, list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])) AS score FROM requests, embeddings),
    {ranked('scored', 'vec_id', 10)} SELECT * FROM hits"""

REBUILT = f"WITH {CORRECTED}, {chunked('corrected')}, {counted('chunks', UNIT, 'tf')}, {hashed('tf', UNIT, 'hv')} {long_form()}"

MERGED = """
    marked AS (
      SELECT *, CASE WHEN chunk * 30 > lag(chunk * 30 + 40) OVER w THEN 1 ELSE 0 END AS fresh
      FROM hits WINDOW w AS (PARTITION BY req_id, conv_id, turn ORDER BY chunk)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY req_id, conv_id, turn ORDER BY chunk) AS island FROM marked),
    spans AS (
      SELECT req_id, conv_id, turn, min(chunk) * 30 AS lo, max(chunk) * 30 + 40 AS hi, min(rank) AS rank
      FROM islands GROUP BY req_id, conv_id, turn, island),
    lines AS (
      SELECT req_id, rank, role || ': ' || array_to_string(regexp_extract_all(text, '\\S+')[lo + 1 : hi], ' ') AS line
      FROM spans JOIN conversations USING (conv_id, turn))"""

VERSIONS = """
    SELECT conv_id, turn, role, text, TIMESTAMP '2026-01-02' AS seen, 'export-b' AS file FROM conversations
    UNION ALL SELECT conv_id, turn, role, 'corrected: ' || text, TIMESTAMP '2026-01-03', 'export-a' FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn, role, 'stale: ' || text, TIMESTAMP '2026-01-01', 'export-z' FROM conversations WHERE role = 'user'
    UNION ALL SELECT conv_id, turn, role, 'again: ' || text, TIMESTAMP '2026-01-03', 'export-a' FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn, role, 'tie: ' || text, TIMESTAMP '2026-01-02', 'export-c' FROM conversations WHERE role = 'system'"""

ALL_TURNS = "SELECT conv_id, turn, role, text FROM conversations"
TERM_HITS = f"{TF}, {RTF}, {DF}, {WEIGHTED}, {TERM_SCORES}, {ranked('scored', UNIT, 5)}"


def statements() -> dict[str, str]:
    return {
        "read_transcripts": ALL_TURNS,
        "read_transcripts_json": ALL_TURNS,
        "quarantine": """
            SELECT count(*) AS n_records,
                   count(*) FILTER (role <> 'system' AND turn <> 7) AS n_good,
                   count(*) FILTER (role = 'system') AS n_corrupt,
                   count(*) FILTER (role <> 'system' AND turn = 7) AS n_keyless,
                   count(*) FILTER (role <> 'system' AND turn = 6) AS n_no_text
            FROM conversations""",
        "ingest_stream": ALL_TURNS,
        "current_view": f"""
            SELECT conv_id, turn, role, text FROM ({VERSIONS})
            QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY seen DESC, file DESC, role DESC, text DESC) = 1""",
        "store_vectors": f"WITH {TF}, {hashed('tf', UNIT, 'hv')} {long_form()}",
        "refresh_store": REBUILT,
        "stream_to_store": REBUILT,
        "compacted_view": f"WITH {CORRECTED} SELECT conv_id, turn, role, text FROM corrected",
        "chunk": f"WITH {chunked()} SELECT conv_id, turn, chunk, role, text FROM chunks",
        "sentences": r"""
            SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS sentence, role, text
            FROM (
              SELECT conv_id, turn, role, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS text
              FROM (
                SELECT conv_id, turn, role, string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(10), 'g'), chr(10)) AS p
                FROM conversations))
            WHERE text <> ''""",
        "terms": f"WITH {TF} SELECT {UNIT}, role, term, tf FROM tf",
        "restrict": f"{ALL_TURNS} WHERE role IN ('user', 'assistant') AND {ROLES_IN_SYSTEM_MEETINGS}",
        "tfidf": f"WITH {TF}, {RTF}, {DF}, {WEIGHTED} SELECT {UNIT}, term, tf, round(weight, 6) AS weight FROM weighted",
        "hash_vectors": f"WITH {TF}, {hashed('tf', UNIT, 'hv')} {long_form()}",
        "encode": f"""
            WITH {chunked()}, counts AS (
              SELECT {UNIT}, CAST(i - 1 AS INTEGER) AS bucket,
                     CAST(length(text) - length(replace(lower(text), chr(CAST(96 + i AS INTEGER)), '')) AS DOUBLE) AS value
              FROM chunks, range(1, 27) letters(i))
            , hv AS (SELECT * FROM counts WHERE value <> 0) {long_form('hv', 'letters')}""",
        "semantic_search": NEAREST,
        "pruned_search": NEAREST,
        "hash_search": f"WITH {HASHED}, {ranked('pairs', UNIT, 5)} SELECT * FROM hits",
        "restricted_search": f"""
            WITH {HASHED}, said AS (SELECT * FROM pairs WHERE role = 'user'), {ranked('said', UNIT, 3)} SELECT * FROM hits""",
        "context_vectors": f"WITH {meaning()} SELECT term, bucket, value FROM beside",
        "meaning_search": f"""
            WITH {TF}, {RTF}, {DF}, {WEIGHTED}, {meaning()}, {MEANING_PAIRS}, {ranked('pairs', UNIT, 3)}
            SELECT hits.*, role, text FROM hits JOIN chunks USING ({UNIT})""",
        "stored_meaning_search": f"WITH {TF}, {RTF}, {DF}, {WEIGHTED}, {meaning()}, {MEANING_PAIRS}, {ranked('pairs', UNIT, 3)} SELECT * FROM hits",
        "refresh_meaning": f"""
            WITH {CORRECTED}, {chunked('corrected')}, {counted('chunks', UNIT, 'tf')}, {RTF}, {DF}, {WEIGHTED}, {meaning('corrected')},
            {MEANING_PAIRS}, {ranked('pairs', UNIT, 3)} SELECT * FROM hits""",
        "stored_search": f"""
            WITH {HASHED}, met AS (SELECT * FROM pairs WHERE {ROLES_IN_SYSTEM_MEETINGS}), {ranked('met', UNIT, 5)} SELECT * FROM hits""",
        "quarantine_rows": """
            WITH lines AS (
              SELECT conv_id, turn, role, text,
                '{' || CASE WHEN turn <> 7 THEN '"conv_id":' || conv_id || ',' ELSE '' END || '"turn":' || turn || ',"role":' || to_json(role)
                || CASE WHEN turn <> 6 THEN ',"text":' || to_json(text) ELSE '' END || '}' AS line FROM conversations)
            SELECT CASE WHEN role = 'system' OR turn = 7 THEN 'bad' ELSE 'good' END AS part,
                   CASE WHEN role <> 'system' AND turn <> 7 THEN conv_id END AS conv_id, CASE WHEN role <> 'system' THEN turn END AS turn,
                   CASE WHEN role <> 'system' THEN role END AS role, CASE WHEN role <> 'system' AND turn <> 6 THEN text END AS text,
                   CASE WHEN role = 'system' THEN line[1:length(line) // 2] END AS line
            FROM lines""",
        "parse_lines": """
            SELECT conv_id, turn, role, CASE WHEN turn <> 6 THEN text END AS text FROM conversations WHERE role <> 'system' AND turn <> 7""",
        "neighbours_spans": """
            SELECT conv_id, turn, role, text,
                   coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
                   coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after
            FROM conversations""",
        "term_search": f"WITH {TERM_HITS} SELECT * FROM hits",
        "bm25_search": f"WITH {TF}, {RTF}, {DF}, {BM25_SCORES}, {ranked('scored', UNIT, 5)} SELECT * FROM hits",
        "stored_bm25_search": f"WITH {TF}, {RTF}, {DF}, {BM25_SCORES}, {ranked('scored', UNIT, 5)} SELECT * FROM hits",
        "lsh_search": f"""
            WITH {HASHED}, {sides(40, 6)}, {signature('hv', UNIT, 'usig')}, {signature('rv', 'req_id', 'rsig')},
            met AS (SELECT DISTINCT req_id, {UNIT} FROM rsig JOIN usig USING (t, code)),
            near AS (SELECT req_id, {UNIT}, score FROM pairs JOIN met USING (req_id, {UNIT})),
            {ranked('near', UNIT, 5)} SELECT * FROM hits""",
        "lsh_near_search": f"""
            WITH {HASHED}, {sides(32, 10)}, {signature('hv', UNIT, 'usig')}, {signature('rv', 'req_id', 'rsig')},
            met AS (SELECT DISTINCT req_id, {UNIT} FROM rsig JOIN usig USING (t) WHERE bit_count(xor(rsig.code::BIGINT, usig.code::BIGINT)) <= 1),
            near AS (SELECT req_id, {UNIT}, score FROM pairs JOIN met USING (req_id, {UNIT})),
            {ranked('near', UNIT, 5)} SELECT * FROM hits""",
        "probed_search": f"""
            WITH {HASHED}, {sides(1, 12)}, {signature('hv', UNIT, 'usig')}, {signature('rv', 'req_id', 'rsig')},
            rside AS (SELECT req_id, b, sum(value * s) AS side FROM rv JOIN planes USING (bucket) GROUP BY ALL),
            cost AS (
              SELECT req_id, m, sum(CASE WHEN (m >> b) & 1 = 1 THEN side * side ELSE 0 END) AS cost
              FROM rside CROSS JOIN range(4096) x(m) GROUP BY ALL),
            probe AS (SELECT req_id, m FROM cost QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY cost, m) <= 2048),
            met AS (
              SELECT req_id, {UNIT} FROM probe JOIN rsig USING (req_id) JOIN usig ON usig.code::BIGINT = xor(rsig.code::BIGINT, m)),
            near AS (SELECT req_id, {UNIT}, score FROM pairs JOIN met USING (req_id, {UNIT})),
            {ranked('near', UNIT, 5)} SELECT * FROM hits""",
        "meeting_details": r"""
            SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_speakers,
                   CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars,
                   min(turn) AS first_turn, max(turn) AS last_turn,
                   round(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / sum(length(text)), 6) AS speaker_share
            FROM conversations GROUP BY conv_id""",
        "neighbours": """
            SELECT conv_id, turn, role, text, lag(turn) OVER w AS prev_turn, lag(text) OVER w AS prev_text,
                   lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
        "assemble_context": f"""
            WITH {TERM_HITS}, lines AS (SELECT req_id, rank, role || ': ' || text AS line FROM hits JOIN chunks USING ({UNIT}))
            {CONTEXT.format(budget=600)}""",
        "merged_context": f"WITH {TERM_HITS}, {MERGED} {CONTEXT.format(budget=600)}",
        "around_hits": f"""
            WITH {TERM_HITS},
            met AS (
              SELECT req_id, conv_id, turn, CAST(row_number() OVER (PARTITION BY req_id ORDER BY min(rank)) AS INTEGER) AS rank
              FROM hits GROUP BY req_id, conv_id, turn),
            near AS (
              SELECT conv_id, turn,
                     coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
                     coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after
              FROM conversations)
            SELECT req_id, rank, conv_id, turn, before, after FROM met JOIN near USING (conv_id, turn)""",
        "answer_contexts": f"""
            WITH {TERM_HITS},
            met AS (
              SELECT req_id, conv_id, turn, row_number() OVER (PARTITION BY req_id ORDER BY min(rank)) AS rank
              FROM hits GROUP BY req_id, conv_id, turn),
            spoken AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations),
            near AS (
              SELECT conv_id, turn, concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w) AS line
              FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            lines AS (SELECT req_id, rank, line FROM met JOIN near USING (conv_id, turn))
            {CONTEXT.format(budget=4000)}""",
    }
