"""What SQL can say of the operators: the same results by plain joins, for small tables."""

COMPONENTS = """
walk(node, seen) AS (
  SELECT a, a FROM links UNION SELECT l.b, w.seen FROM walk w JOIN links l ON l.a = w.node),
reach AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)
"""

VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(r.component, e.vec_id) AS component_id,
  coalesce(r.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN reach r ON r.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

MINHASH = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM w WHERE w IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.component, d.doc_id) AS component_id,
  coalesce(r.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.node = d.doc_id
"""

MIXING = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS weight FROM documents GROUP BY source),
k AS (SELECT source, weight * (SELECT sum(n) FROM n) / ((SELECT sum(weight) FROM n) * n) AS rate FROM n),
p AS (SELECT source, rate, greatest(ceil(rate / 64.0), 1.0)::INT AS parts FROM k),
t(source, mean, k, p, c, last) AS (
  SELECT source, rate / parts, 0, exp(-rate / parts), exp(-rate / parts), ceil(rate / parts + 12 * sqrt(rate / parts) + 20) FROM p
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), last FROM t WHERE k < last),
sums AS (SELECT source, list(c ORDER BY k) AS sums FROM t GROUP BY source),
parts AS (SELECT d.doc_id, d.source, d.lang, md5(d.text) AS text_md5, sums.sums, unnest(range(1, p.parts + 1)) AS part
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN sums ON sums.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM parts),
copies AS (SELECT doc_id, source, lang, text_md5, sum(len(list_filter(sums, lambda x: u >= x))) AS copies FROM drawn GROUP BY ALL),
e AS (SELECT doc_id, source, lang, text_md5, unnest(range(0, copies::BIGINT)) AS replica FROM copies WHERE copies > 0)
SELECT doc_id, source, lang, text_md5, replica::INT AS replica,
  ('0x' || substr(md5('17|position|' || coalesce(doc_id::VARCHAR, 'null') || '|' || replica), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS position
FROM e
"""

PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, w, n AS a, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.n AS l, r.n AS r, ((2000000::HUGEINT * x.a) // (l.n::HUGEINT + r.n))::BIGINT AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[cut + 1:len(x.w)], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, k, n, w, size, unnest(range(1, k - size + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS size) WHERE k > size),
longer AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(n) AS n FROM parts GROUP BY ALL),
rest AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.n IS NULL OR 100::HUGEINT * o.n < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM rest)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def simhash(radius: int = 4) -> str:
    """Fingerprints of texts and of their edited forms, and the pairs within the radius, bit by bit."""
    upper, lower = (
        ", ".join(f"sum(CASE WHEN (h{half} >> {k}) & 1 = 1 THEN weight ELSE -weight END) > 0 AS {half}{k}" for k in range(64)) for half in "ul"
    )
    number = lambda half: " + ".join(f"(coalesce({half}{k}, false)::INT::UBIGINT << {k})" for k in range(64))
    term = lambda half: ", ".join(
        f"CASE WHEN len(w) > {k} THEN md5_number_{half}('{k}:' || w[i + {k}]) ELSE 0::UBIGINT END" for k in range(5)
    )
    xor5 = lambda half: f"list_reduce([{term(half)}], lambda a, b: xor(a, b))"
    differ = lambda a, b: f"(bit_count(xor({a}u, {b}u)) + bit_count(xor({a}l, {b}l)))"
    shown = lambda p: f"lower(lpad(hex({p}u), 16, '0') || lpad(hex({p}l), 16, '0'))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT doc_id, t, left(t, length(t) - length(t) // 2) || left(next, length(t) // 2) AS e, next_id
  FROM (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS next, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
    FROM d WINDOW o AS (ORDER BY doc_id DESC))),
forms AS (SELECT doc_id, 0 AS form, t FROM e UNION ALL SELECT doc_id, 1, e FROM e),
w AS (
  SELECT doc_id, form, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM forms),
s AS (SELECT doc_id, form, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, form, {xor5("upper")} AS hu, {xor5("lower")} AS hl FROM s),
t AS (SELECT doc_id, form, hu, hl, length(bin(count(*))) AS weight FROM h GROUP BY ALL),
v AS (SELECT doc_id, form, {upper}, {lower} FROM t GROUP BY ALL),
f AS MATERIALIZED (SELECT w.doc_id, w.form, len(w.w) > 0 AS has, {number("u")} AS u, {number("l")} AS l FROM w LEFT JOIN v USING (doc_id, form)),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.doc_id <> y.doc_id AND x.form = 0 AND y.form = 0 AND x.has AND y.has
  WHERE {differ("x.", "y.")} <= {radius}),
{COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.e) AS edited_sha256, {shown("x.")} AS fingerprint, {shown("y.")} AS edited_fingerprint,
  1 - {differ("x.", "y.")} / 128 AS near_edited, 1 - {differ("x.", "z.")} / 128 AS near_next,
  coalesce(n.n, 0)::BIGINT AS n_near, coalesce(r.component, e.doc_id) AS group_id
FROM e JOIN f x ON x.doc_id = e.doc_id AND x.form = 0 JOIN f y ON y.doc_id = e.doc_id AND y.form = 1
JOIN f z ON z.doc_id = e.next_id AND z.form = 0 LEFT JOIN n ON n.a = e.doc_id LEFT JOIN reach r ON r.node = e.doc_id
"""


def centroids(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and division, one after another, all vectors against all centroids."""
    steps = ["c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c, q FROM v QUALIFY c < " + str(k) + ")"]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v.q, c.c, {distance} AS distance FROM v CROSS JOIN c{r} c "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c.c) = 1)"
        )
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(q[i])::HUGEINT AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN n{r} n ON n.c = c.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{", ".join(steps)}
SELECT a.vec_id, a.c AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""
