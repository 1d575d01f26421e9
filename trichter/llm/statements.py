"""Equivalent SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

# Base32 of a SHA-1: eight groups of five hex digits give four characters each.
WARC = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
),
marked AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM hashed
),
parts AS (
    SELECT *, list_transform(range(8), lambda i: ('0x' || substr(digest, 1 + 5 * CAST(i AS INTEGER), 5))::INTEGER) AS groups
    FROM marked
)
SELECT
    page_id,
    CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(
        list_transform(
            groups,
            lambda g: array_to_string(
                list_transform(
                    [15, 10, 5, 0],
                    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> CAST(s AS INTEGER)) & 31) + 1, 1)
                ), ''
            )
        ), ''
    ) AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM parts
"""

# Words and five-word shingles of a text column, by row.
_SHINGLES = """
    list_distinct(
        CASE
            WHEN len(words) >= 5 THEN
                list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' '))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
            ELSE []
        END
    )
"""


def _words(text: str) -> str:
    return (
        "list_filter(string_split_regex(translate(coalesce(" + text + ", ''), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    )


NEAR_DEDUP = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, {_words('text')} AS words FROM documents
),
sets AS (
    SELECT doc_id, {_SHINGLES} AS shingles FROM worded
),
entries AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM shared WHERE 100 * common >= 75 * (na + nb - common)
),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
),
least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT
    s.doc_id,
    CAST(len(s.shingles) AS BIGINT) AS n_shingles,
    l.component_id,
    s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""

CONTAMINATION = f"""
WITH doc_words AS (
    SELECT doc_id, {_words('text')} AS words FROM documents
),
item_words AS (
    SELECT item_id, {_words('text')} AS words FROM benchmark
),
held AS (
    SELECT doc_id, unnest({_SHINGLES}) AS shingle FROM doc_words
    UNION
    SELECT doc_id, shingle FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i : i + n - 1], ' '))) AS shingle
        FROM doc_words JOIN (SELECT DISTINCT len(words) AS n FROM item_words WHERE len(words) BETWEEN 1 AND 4) ON len(words) >= n
    )
),
item_sets AS (
    SELECT item_id, {_SHINGLES} AS shingles FROM item_words
),
wanted AS (
    SELECT item_id, len(shingles) AS item_shingles, unnest(shingles) AS shingle FROM item_sets
),
shared AS (
    SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
    FROM held JOIN wanted USING (shingle)
    GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, shared, CAST(item_shingles AS BIGINT) AS item_shingles, shared / item_shingles AS containment
FROM shared
WHERE 4 * shared >= 3 * item_shingles
"""

def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks round by round. Distances are whole numbers, exact as doubles; the index rides along for ties."""

    def assigned(book: str, columns: str) -> str:
        distance = "CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT)"
        return f"SELECT {columns}, min({distance} * {entries} + e) AS best FROM cut JOIN {book} USING (p) GROUP BY ALL"

    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({assigned(f'c{n}', 'row, p, x')})")
        steps.append(
            f"s{n} AS (SELECT p, best % {entries} AS e, unnest(range(len(x))) AS i, unnest(x) AS y FROM a{n}), "
            f"m{n} AS (SELECT p, e, i, floor(sum(y) / count(*)) AS y FROM s{n} GROUP BY p, e, i), "
            f"l{n} AS (SELECT p, e, list(y ORDER BY i) AS c FROM m{n} GROUP BY p, e), "
            f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(l{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN l{n} USING (p, e))"
        )
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row,
        list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS MATERIALIZED (
    SELECT row, p, v[CAST(len(v) / {parts} * p AS BIGINT) + 1 : CAST(len(v) / {parts} * (p + 1) AS BIGINT)] AS x
    FROM kept, range({parts}) AS places(p)
),
c0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM cut WHERE row <= {entries}),
{", ".join(steps)},
last AS MATERIALIZED ({assigned(f"c{rounds}", "row, p")}),
coded AS (
    SELECT row, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
    FROM last GROUP BY row
),
final AS (
    SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS digest
    FROM (SELECT p, e, unnest(range(len(c))) AS i, CAST(unnest(c) AS BIGINT) AS y FROM c{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (row), final
"""


def _terms(table: str, keys: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {keys}, unnest(regexp_extract_all({lower}, '{pattern}')) AS term FROM {table}"


RANKED = f"""
WITH held AS (
    {_terms("(SELECT *, row_number() OVER () AS row FROM documents)", "row, doc_id")}
),
counted AS (
    SELECT row, doc_id, term, count(*) AS tf FROM held GROUP BY row, doc_id, term
),
sized AS (
    SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row
),
totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized
),
spans AS (
    SELECT row, 25 + (75 * n * docs) // terms AS m FROM sized, totals
),
wanted AS (
    SELECT item, item_id, term, count(*) AS repeats
    FROM ({_terms("(SELECT *, row_number() OVER () AS item FROM benchmark)", "item, item_id")})
    GROUP BY item, item_id, term
),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term
),
scored AS (
    SELECT item, item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN spans USING (row)
    GROUP BY item, item_id, row, doc_id
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


STATEMENTS: dict[str, str] = {
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op7_benchmark_decontamination": CONTAMINATION,
    "op10_warc_normaliser": WARC,
    "op11_ranked_search": RANKED,
    "op13_vector_codes": _vector_codes(),
}
