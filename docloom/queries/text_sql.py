"""SQL forms of parsing, chunking, embedding and search, for the check against the Spark jobs."""

from docloom.functions import text as tx
from docloom.model import CHUNK_OVERLAP, CHUNK_SIZE, SUPPORTED_EXTENSIONS

STEP = CHUNK_SIZE - CHUNK_OVERLAP
# The references that the given pages have, and what they stand for.
REFERENCES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "'"), ("&amp;", "&")]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(tx.WHITESPACE)}, ' ', 'g'))"


def sql_non_empty(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda e: {sql_collapse('e')}), lambda e: e <> '')"


def sql_lines(x: str) -> str:
    return sql_non_empty(f"string_split({x}, chr(10))")


def sql_html(x: str) -> str:
    t = f"replace({x}, chr(30), ' ')"
    for pattern, to in (
        (tx.HTML_COMMENT, "' '"),
        (tx.HTML_HIDDEN, "' '"),
        (tx.HTML_BLOCK, "chr(30)"),
        (tx.HTML_BREAK, "' '"),
        (tx.HTML_TAG, "''"),
    ):
        t = f"regexp_replace({t}, {lit(pattern)}, {to}, 'g')"
    for entity, char in REFERENCES:
        t = f"replace({t}, {lit(entity)}, {lit(char)})"
    return sql_non_empty(f"string_split({t}, chr(30))")


def sql_clean(els: str) -> str:
    return f"regexp_replace(regexp_replace(array_to_string({els}, chr(10)), '[\\t\\n]', ' ', 'g'), ' +', ' ', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split(lower({sql_collapse(x)}), ' '), lambda w: w <> '')"


def sql_sentences(x: str) -> str:
    return sql_non_empty(f"regexp_extract_all({x}, {lit(tx.SENTENCE)})")


def sentence_chunks(size: int, overlap: int) -> str:
    """Chunks of whole sentences: from a chunk's first piece the next one is looked up in the running word counts."""
    words = "len(string_split(e, ' '))"
    cut = f"list_transform(range(0, {words}, {size}), lambda i: array_to_string(string_split(e, ' ')[i+1 : i+{size}], ' '))"
    pieces = f"flatten(list_transform({sql_sentences('text')}, lambda e: CASE WHEN {words} <= {size} THEN [e] ELSE {cut} END))"
    return f"""
        SELECT org_id, doc_id||'#'||k AS node_id, doc_id, CAST(k AS BIGINT) AS chunk_idx, process_date, array_to_string(ps[b+1 : e], ' ') AS text
        FROM (
          WITH RECURSIVE piece AS (SELECT org_id, doc_id, process_date, {pieces} AS ps FROM document),
          counted AS (SELECT *, list_transform(ps, lambda e: {words}) AS ws FROM piece WHERE len(ps) > 0),
          run AS (SELECT *, list_transform(range(len(ps) + 1), lambda i: CAST(coalesce(list_sum(ws[1 : i]), 0) AS BIGINT)) AS cum FROM counted),
          walk AS (
            SELECT org_id, doc_id, process_date, ps, cum, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS b,
                   CAST(len(list_filter(cum, lambda x: x <= {size})) - 1 AS BIGINT) AS e
            FROM run
            UNION ALL
            SELECT org_id, doc_id, process_date, ps, cum, k + 1, nb, CAST(len(list_filter(cum, lambda x: x <= cum[nb+1] + {size})) - 1 AS BIGINT)
            FROM (SELECT *, CAST(len(list_filter(cum, lambda x: x < greatest(cum[e+1] - {overlap}, cum[e+2] - {size}))) AS BIGINT) AS nb
                  FROM walk WHERE e < len(ps)))
          SELECT * FROM walk)"""


SQL_EXT = "string_split(name, '.')[-1]"
SUPPORTED = ", ".join(lit(e) for e in SUPPORTED_EXTENSIONS)
NOT_EMPTY_LIST = "list_filter(string_split(text, ' '), lambda w: w <> '')"


def counts(source: str, key: str, text: str) -> str:
    """Word counts per hash bucket, and only that: one row per (key, bucket)."""
    return f"""
        SELECT {key}, b, count(*) AS c
        FROM (SELECT {key}, substr(md5(unnest({sql_words(text)})),1,2) AS b FROM {source}) GROUP BY ALL"""


def norms(source: str, key: str) -> str:
    return f"SELECT {key}, sum(c*c) AS n FROM {source} GROUP BY ALL"


TEXT_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "checked": (
        ("file",),
        f"""
        SELECT *, {SQL_EXT} AS ext,
               CAST(CASE WHEN name IS NULL OR {SQL_EXT} NOT IN ({SUPPORTED}) THEN 4102 WHEN content IS NULL THEN 4005
                    WHEN {SQL_EXT} NOT IN ('html','txt','csv','rtf','docx','pptx','xlsx') THEN 4901 END AS BIGINT) AS code,
               CASE WHEN name IS NULL OR {SQL_EXT} NOT IN ({SUPPORTED}) THEN 'File type not supported'
                    WHEN content IS NULL THEN 'Could not download file'
                    WHEN {SQL_EXT} NOT IN ('html','txt','csv','rtf','docx','pptx','xlsx') THEN 'No parser for this file type' END AS reason
        FROM file""",
    ),
    "parsed": (
        ("checked",),
        f"""
        SELECT org_id, id AS doc_id, process_date,
               CASE WHEN ext = 'html' THEN {sql_html('content')} ELSE {sql_lines('content')} END AS els
        FROM checked WHERE code IS NULL""",
    ),
    "document": (
        ("parsed",),
        f"SELECT org_id, doc_id, process_date, {sql_clean('els')} AS text FROM parsed",
    ),
    "chunk": (
        ("document",),
        f"""
        SELECT org_id, doc_id||'#'||i AS node_id, doc_id, CAST(i AS BIGINT) AS chunk_idx, process_date,
               array_to_string(w[i*{STEP}+1 : i*{STEP}+{CHUNK_SIZE}], ' ') AS text
        FROM (SELECT org_id, doc_id, process_date, w,
                     unnest(range(CASE WHEN len(w)=0 THEN 0
                       ELSE 1 + CAST(ceil(greatest(len(w)-{CHUNK_SIZE},0) / {STEP}.0) AS BIGINT) END)) AS i
              FROM (SELECT *, {NOT_EMPTY_LIST} AS w FROM document))""",
    ),
    "node_count": (("chunk",), counts("chunk", "node_id", "text")),
    "node_norm": (("node_count",), norms("node_count", "node_id")),
    "asked": (
        ("question", "member"),
        f"""
        SELECT qid, org_id, {sql_collapse('text')} AS question FROM question
        WHERE (org_id, user_id) IN (SELECT org_id, user_id FROM member)""",
    ),
    "q_count": (("asked",), counts("asked", "qid", "question")),
    "q_norm": (("q_count",), norms("q_count", "qid")),
    "scored": (
        ("chunk", "node_count", "node_norm", "asked", "q_count", "q_norm"),
        """
        SELECT qid, org_id, node_id,
               round(CASE WHEN nn.n > 0 AND qn.n > 0 THEN coalesce(dot, 0)::DOUBLE / sqrt(nn.n::DOUBLE * qn.n::DOUBLE)
                     ELSE 0 END, 9) AS score
        FROM asked JOIN chunk USING (org_id)
        LEFT JOIN (SELECT q.qid, n.node_id, sum(q.c*n.c) AS dot
                   FROM asked a JOIN q_count q USING (qid) JOIN chunk k USING (org_id)
                   JOIN node_count n ON n.node_id = k.node_id AND n.b = q.b GROUP BY ALL) USING (qid, node_id)
        LEFT JOIN node_norm nn USING (node_id) LEFT JOIN q_norm qn USING (qid)""",
    ),
    "topk": (
        ("scored",),
        """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM scored)
        WHERE rank <= 10""",
    ),
    "reranked": (
        ("topk", "chunk", "asked"),
        f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, score DESC, node_id) AS rerank_rank
          FROM (SELECT t.*, k.doc_id, k.text, k.process_date, a.question,
                       CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, {sql_words('k.text')}))::DOUBLE / len(qw)
                            ELSE 0 END AS rerank_score
                FROM topk t JOIN chunk k USING (node_id)
                JOIN (SELECT qid, question, list_distinct({sql_words('question')}) AS qw FROM asked) a USING (qid)))
        WHERE rerank_rank <= 3""",
    ),
    "recent": (
        ("reranked",),
        """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY qid
                 ORDER BY strptime(process_date, '%m/%d/%Y, %H:%M:%S') DESC, score DESC, node_id) AS recency_rank
          FROM reranked) WHERE recency_rank <= 5""",
    ),
    "sentence": (
        ("recent",),
        f"""
        SELECT qid, node_id, recency_rank, doc_id, pos, s[pos+1] AS sentence
        FROM (SELECT *, unnest(range(len(s))) AS pos
              FROM (SELECT *, {sql_sentences('text')} AS s FROM recent))""",
    ),
    "s_count": (("sentence",), counts("sentence", "qid, node_id, pos", "sentence")),
    "kept": (
        ("sentence", "s_count", "q_count", "q_norm"),
        """
        SELECT qid, node_id, recency_rank, doc_id, pos, sentence, sentence_score
        FROM (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY sentence_score DESC, pos) AS rk,
                     count(*) OVER (PARTITION BY qid, node_id) AS cnt
              FROM (SELECT s.*, round(CASE WHEN sn.n > 0 AND qn.n > 0
                                 THEN coalesce(dot, 0)::DOUBLE / sqrt(sn.n::DOUBLE * qn.n::DOUBLE) ELSE 0 END, 9) AS sentence_score
                    FROM sentence s
                    LEFT JOIN (SELECT qid, node_id, pos, sum(sc.c * q.c) AS dot FROM s_count sc JOIN q_count q USING (qid, b)
                               GROUP BY ALL) USING (qid, node_id, pos)
                    LEFT JOIN (SELECT qid, node_id, pos, sum(c*c) AS n FROM s_count GROUP BY ALL) sn USING (qid, node_id, pos)
                    LEFT JOIN q_norm qn USING (qid)))
        WHERE rk <= greatest(floor(cnt * 0.7), 1)""",
    ),
    "optimized": (
        ("kept",),
        """
        SELECT qid, node_id, any_value(recency_rank) AS recency_rank, any_value(doc_id) AS doc_id,
               string_agg(sentence, ' ' ORDER BY pos) AS text
        FROM kept GROUP BY qid, node_id""",
    ),
    "answer": (
        ("optimized",),
        f"""
        SELECT qid, string_agg(sentence, ' ' ORDER BY recency_rank, pos) AS response
        FROM (SELECT qid, recency_rank, pos, s[pos+1] AS sentence
              FROM (SELECT *, unnest(range(len(s))) AS pos
                    FROM (SELECT *, {sql_sentences('text')} AS s FROM optimized)))
        GROUP BY qid""",
    ),
    "src": (
        ("optimized", "file"),
        """
        SELECT DISTINCT qid, f.name, f.file_url AS url, f.id FROM optimized o JOIN file f ON f.id = o.doc_id""",
    ),
    "payload": (
        ("asked", "answer", "src"),
        """
        SELECT qid, CAST(to_json({'response': coalesce(response, 'Please try again later'),
                             'sources': CASE WHEN response IS NULL THEN [] ELSE coalesce(l, []) END}) AS VARCHAR) AS payload
        FROM asked LEFT JOIN answer USING (qid)
        LEFT JOIN (SELECT qid, list({'name': name, 'url': url} ORDER BY name, url) AS l FROM src GROUP BY qid) USING (qid)""",
    ),
    "next_node": (
        ("chunk", "change", "checked"),
        """
        SELECT * FROM chunk WHERE (org_id, doc_id) NOT IN (SELECT org_id, file_id FROM change)
        UNION ALL
        SELECT * FROM chunk WHERE (org_id, doc_id) IN (SELECT org_id, file_id FROM change WHERE operation <> 'DELETED')""",
    ),
}
