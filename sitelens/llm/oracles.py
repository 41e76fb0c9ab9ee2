"""DuckDB twins of the training-data queries, where SQL can express them."""



def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, over the byte table ``t`` of ``_CRC_TABLE``."""
    byte = f"CAST(('0x' || substr(hex(encode({text})), 2 * k + 1, 2)) AS BIGINT)"
    folded = f"list_transform(range(strlen({text})), lambda k: {byte})"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {folded}),"
        " lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)"
    )


_CRC_TABLE = """crc AS (
            SELECT list(v ORDER BY i) AS t
            FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                  FROM range(256) r(i)) b)"""


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _features(table: str, key: str) -> str:
    return f"""SELECT {key}, unnest(regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
            FROM (SELECT *, row_number() OVER () AS row FROM {table}) s"""


ORACLES = {
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        flagged AS (
            SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < s.largest, false) AS dropped
            FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, cast(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id
    """,
    "op10_warc_revisits": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o USING (payload_digest)
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (
            SELECT doc_id, run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents) r
            GROUP BY ALL),
        hashed AS (
            SELECT run, k, {_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, crc),
        words AS (
            SELECT word, CAST(sum(k) AS BIGINT) AS n
            FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                            ELSE run END AS word FROM hashed) d
            WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        gaps AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT *, unnest(range(length(word))) AS i FROM words) u),
        near AS (
            SELECT g.word, w.word AS other, w.n AS other_n FROM gaps g JOIN words w ON w.word = g.rest
            UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.rest
            UNION SELECT g.word, h.word, h.n FROM gaps g JOIN gaps h ON g.i = h.i AND g.rest = h.rest AND g.word <> h.word),
        best AS (
            SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near
            FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
        forms AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
                   CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
                   CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        chain(word, depth, here) AS (
            SELECT word, 0, word FROM forms
            UNION ALL SELECT c.word, c.depth + 1, f.form FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
        FROM forms f JOIN (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word) c ON c.word = f.word
    """,
    "op12_importance_resampling": f"""
        WITH {_CRC_TABLE},
        mine AS ({_features("documents", "row")}),
        theirs AS ({_features("benchmark", "row")}),
        hashed AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM mine UNION SELECT w FROM theirs) u, crc),
        s AS (SELECT bucket, count(*) AS n FROM mine JOIN hashed USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM theirs JOIN hashed USING (w) GROUP BY bucket),
        totals AS (SELECT (SELECT count(*) FROM mine) AS s, (SELECT count(*) FROM theirs) AS t),
        gains AS (
            SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (totals.s + 10000.0::DOUBLE)
                / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (totals.t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
            FROM range(10000) b(bucket) CROSS JOIN totals
            LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
        weighed AS (
            SELECT row, count(*) AS n, sum(gain) AS total
            FROM mine JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
        scored AS (
            SELECT d.row, d.doc_id, coalesce(x.n, 0) AS n_features,
                   CAST(coalesce(floor(x.total / x.n::DOUBLE), 0) AS BIGINT) AS weight,
                   CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM (SELECT *, row_number() OVER () AS row FROM documents) d LEFT JOIN weighed x ON x.row = d.row),
        final AS (
            SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM scored),
        ranked AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
            FROM final WHERE n_features >= 20)
        SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN r.rank <= 10 * r.n // 100 THEN r.rank END AS rank
        FROM final f LEFT JOIN ranked r ON r.row = f.row
    """,
}
