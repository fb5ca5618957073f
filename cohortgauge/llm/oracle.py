"""SQL for the contract queries that SQL can express, in DuckDB's dialect.

The classifiers, the fingerprints' hash, the alignment and the tokenizers have no SQL form;
tests compare those with brute force.
"""

from __future__ import annotations

from cohortgauge.llm import centroids, feistel, fences, lehmer, linkrank, recompression

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def repeats(window: int = recompression.WINDOW) -> str:
    """Every window as a string of its words, counted; words are kept one by one."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - {window} + 2)) AS i, w FROM d WHERE len(w) >= {window}),
s AS (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS t FROM p),
again AS (SELECT r, i FROM s WHERE t IN (SELECT t FROM s GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS k FROM again),
lost AS (SELECT r, list(k) AS ks FROM gone GROUP BY r),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
         CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END AS k
  FROM d LEFT JOIN lost USING (r))
SELECT doc_id, n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


def archive() -> str:
    """Base 32 from hexadecimal digits, twenty bits at a time."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    part = "('0x' || substr(h, 5 * g + 1, 5))::BIGINT"
    letters = " || ".join(f"substr({digits}, (({part} >> {s}) & 31)::BIGINT + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS least FROM p GROUP BY html),
j AS (SELECT p.*, CASE WHEN page_id <> least THEN least END AS refers_to FROM p JOIN f USING (html))
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: {letters}), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""


def rules(least_rows: int = fences.LEAST_ROWS) -> str:
    """Counts by plain lists, quartiles over the sorted values of each group."""
    ratios = {
        "symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "dup_lines": "n_dup_lines / n_lines",
        "capitals": "n_capitals / word_chars", "marks": "n_marks / n_words", "length": "word_chars / n_words",
    }
    quartiles = ", ".join(f"quantile_disc({k}, 0.25) AS {k}_l, quantile_disc({k}, 0.75) AS {k}_h" for k in ratios)
    chosen = ", ".join(
        f"CASE WHEN g.n >= {least_rows} THEN g.{k}_{e} WHEN l.n >= {least_rows} THEN l.{k}_{e} ELSE a.{k}_{e} END AS {k}_{e}" for k in ratios for e in "lh"
    )
    inside = " AND ".join(
        f"{k} <= {k}_h + {fences.REACH} * greatest({k}_h - {k}_l, {least})" + (f" AND {k} >= {k}_l - {fences.REACH} * greatest({k}_h - {k}_l, {least})" if both else "")
        for k, (least, both) in fences.RATIOS.items()
    )
    count = lambda chars: f"len(regexp_extract_all(t, '[{chars}]'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
s AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS x FROM p),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM s) WHERE n > 1),
c AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM m) GROUP BY r),
b AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) > 0) AS ls FROM d),
n AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         {count("#*$%&|<>")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, {count("A-Z")} AS n_capitals, {count("!?")} AS n_marks
  FROM d JOIN b USING (r) LEFT JOIN c USING (r)),
q AS (SELECT *, {", ".join(f"coalesce(CASE WHEN {v.split(' / ')[1]} > 0 THEN ({v.split(' / ')[0]})::DOUBLE / {v.split(' / ')[1]} END, 0) AS {k}" for k, v in ratios.items())} FROM n),
g AS (SELECT lang, source, count(*) AS n, {quartiles} FROM q WHERE n_words > 0 GROUP BY ALL),
l AS (SELECT lang, count(*) AS n, {quartiles} FROM q WHERE n_words > 0 GROUP BY ALL),
a AS (SELECT count(*) AS n, {quartiles} FROM q WHERE n_words > 0),
f AS (SELECT g.lang, g.source, {chosen} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a),
v AS (
  SELECT q.*, n_words < {fences.LEAST_WORDS} OR 100 * n_repeat_words > {fences.MOST_REPEATED} * n_words AS base_failed, ({inside}) AS fits
  FROM q LEFT JOIN f ON q.lang IS NOT DISTINCT FROM f.lang AND q.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fits, false) AS kept FROM v"""


def verdicts() -> str:
    """The propagation as one statement per pass, with the passes unrolled."""
    d = linkrank.DAMPING
    fits = "\n".join(
        f"SELECT page_id, '{rule}' AS rule, '{verdict}' AS verdict, {len(rule)} AS n FROM h WHERE (host = '{rule.partition('/')[0]}'"
        f" OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') UNION ALL"
        for verdict, rule in linkrank.RULES
    ).removesuffix("UNION ALL")
    passes = []
    for k in range(linkrank.PASSES):
        passes.append(f"""r{k + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
  SELECT e.target AS host, {d} * e.pages / e.out * r.trust AS trust, 0 AS distrust FROM e JOIN r{k} r ON r.host = e.source
  UNION ALL SELECT e.source, 0, {d} * e.pages / e.into * r.distrust FROM e JOIN r{k} r ON r.host = e.target
  UNION ALL SELECT * FROM r0) GROUP BY host)""")
    link = linkrank.LINK.replace("'", "''")
    return f"""
WITH h AS (
  SELECT page_id, html, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS ({fits}),
one AS (SELECT page_id, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1),
j AS (SELECT h.*, rule, verdict FROM h LEFT JOIN one USING (page_id)),
t AS (SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: lower(x)))) AS target
      FROM h WHERE host <> ''),
n AS (SELECT source, target, count(*) AS pages FROM t WHERE source <> target GROUP BY ALL),
e AS (SELECT *, sum(pages) OVER (PARTITION BY source) AS out, sum(pages) OVER (PARTITION BY target) AS into FROM n),
r0 AS (SELECT host, (1 - {d}::DOUBLE) * avg(coalesce(verdict = 'allow', false)::INT) AS trust,
              (1 - {d}::DOUBLE) * avg(coalesce(verdict = 'block', false)::INT) AS distrust FROM j WHERE host <> '' GROUP BY host),
{", ".join(passes)}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > trust AND distrust >= {linkrank.LIMIT} * (1 - {d}::DOUBLE)
  THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN r{linkrank.PASSES} USING (host)"""


def shards() -> str:
    """Checksums over lists of bytes, the network as nested selects, walks by recursion."""

    def network(source: str, number: str) -> str:
        text = f"SELECT row, a, b, n, {number} % a AS l, {number} // a AS r FROM {source}"
        for turn in range(feistel.ROUNDS):
            side, other, size = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
            drawn = f"('0x' || substr(md5('{feistel.SEED}:{turn}:' || {other}), 1, 15))::BIGINT"
            text = f"SELECT row, a, b, n, ({side} + {drawn} % {size}) % {size} AS {side}, {other} FROM ({text})"
        return f"SELECT row, n, a, b, r * a + l AS place FROM ({text})"

    half = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    entries = "list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, i: " + half + "))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, strlen(t) + 1 AS size, hex(encode(t)) AS x FROM d),
s AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, v: xor(c >> 8, e[(xor(c, v) & 255) + 1]))) AS text_crc32 FROM h, (SELECT {entries} AS e)),
z AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM s),
k AS (SELECT row, n, a, (n + a - 1) // a AS b FROM g, z),
w AS (
  {network("k", "row")}
  UNION ALL
  {network("(SELECT * FROM w WHERE place >= n)", "place")}),
p AS (SELECT row, place FROM w WHERE place < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {feistel.SHARDS})::INT AS shard, place // {feistel.SHARDS} AS slot,
       NULL::INT AS grown_shard FROM g JOIN p USING (row)"""


def clusters(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Rounds as a chain of tables: all distances side by side, the nearest kept, floors of means."""

    def near(turn: int) -> str:
        return f"""a{turn} AS MATERIALIZED (SELECT v.r, arg_min(c.i, struct_pack(d := d, i := c.i)) AS cluster, min(d) AS distance
  FROM v, c{turn} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d) GROUP BY v.r)"""

    def moved(turn: int) -> str:
        return f"""m{turn} AS MATERIALIZED (SELECT i, list(f ORDER BY p) AS c FROM (
  SELECT a.cluster AS i, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f
  FROM (SELECT r, unnest(v) AS x, unnest(range(len(v))) AS p FROM v) JOIN a{turn} a USING (r) GROUP BY ALL) GROUP BY i),
c{turn + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.c, c.c) AS c FROM c{turn} c LEFT JOIN m{turn} m ON m.i = c.i)"""

    chain = ",\n".join([near(0), *(f"{moved(t)},\n{near(t + 1)}" for t in range(rounds))])
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = {centroids.DIMENSION}),
v AS MATERIALIZED (
  SELECT r, vec_id, list_transform(x, lambda y: floor(y * {centroids.SCALE})::BIGINT) AS v FROM e
  WHERE len(list_filter(x, lambda y: isfinite(y))) = {centroids.DIMENSION}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS i, v AS c FROM (SELECT *, sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v)
  ORDER BY h, vec_id, v LIMIT {k}),
{chain},
s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, a.cluster::INT AS cluster, distance, cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN s USING (cluster) JOIN c{rounds} c ON c.i = a.cluster"""


def orders() -> str:
    """Every order judged for every kind of row, one by one."""
    letter = f"SELECT unnest(string_split('{lehmer.LETTERS}', '')) AS x"
    return f"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(w) < {lehmer.FEWEST_WORDS} THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < {lehmer.LEAST_DISTINCT} * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {lehmer.MOST_CAPITALS} * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[{lehmer.SYMBOLS.decode()}]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM d),
m AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS ({letter}),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
j AS (SELECT *, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM s),
g AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (len(list_intersect(string_split(fails, ''), string_split(earlier || letter, ''))) = 0 OR fails = '') AS kept,
         sum(n) FILTER (contains(fails, letter) AND NOT gone) AS removed, sum(n) FILTER (contains(fails, letter) AND gone) AS redundant,
         sum(n) FILTER (fails = letter) AS unique_fails, sum(good) FILTER (contains(fails, letter) AND NOT gone) AS good_lost,
         sum(toxic) FILTER (contains(fails, letter) AND NOT gone) AS toxic_lost
  FROM (SELECT m.*, j.*, earlier <> '' AND fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone FROM m, j)
  GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g"""


STATEMENTS = {
    "op12_centroids": clusters(), "op13_lehmer": orders(),
    "op5_feistel": shards(), "op1_recompression": repeats(), "op2_warczip": archive(), "op6_fences": rules(), "op9_linkrank": verdicts(),
}
