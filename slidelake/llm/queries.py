"""Queries of the corpus operators and the SQL that they must agree with, where SQL can express them."""

from __future__ import annotations

from .bagminhash import near_classes
from .bit_planes import id_digest
from .collocations import collocations
from .common import table
from .exact_dedup import exact_groups
from .fill_middle import fim_digest
from .fingerprint import digests
from .html_blocks import extracted
from .langid import languages
from .mixing import mixed
from .sharding import sharded
from .token_count import token_counts
from .unigram import encoded
from .warc import archived


def op1_mixing(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))


def op11_token_ids(spark, sf_dir):
    return id_digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return fim_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_fingerprints, op3_warc, op4_exact_dedup, op5_token_counts, op6_near_dedup,
        op7_language_id, op8_sharding, op9_sentencepiece, op10_html_extraction,
        op11_token_ids, op12_collocations, op13_fill_in_middle,
    )
}

ORACLE = {
    "op3_warc": r"""
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                 coalesce(html, '') AS payload
          FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM m""",
    "op4_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op12_collocations": r"""
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        o AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM i, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE i + k - 1 <= len(ws)),
        f AS (SELECT lang, ws, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        inside AS (
          SELECT lang, ws[j:j + m - 1] AS ws, max(f) AS longer
          FROM f, (VALUES (2), (3)) AS ms(m), (VALUES (1), (2), (3)) AS js(j)
          WHERE m < k AND j + m - 1 <= k GROUP BY ALL),
        c AS (
          SELECT f.* FROM f LEFT JOIN inside USING (lang, ws)
          WHERE k >= 2 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * f.f::HUGEINT)),
        cuts AS (
          SELECT c.lang, c.ws, c.f AS a, cut, l.f AS l, r.f AS r, ((2000000 * c.f::HUGEINT) // (l.f + r.f))::BIGINT AS score
          FROM c JOIN (VALUES (1), (2), (3)) AS x(cut) ON cut < c.k
          JOIN f AS l ON l.lang = c.lang AND l.ws = c.ws[1:cut]
          JOIN f AS r ON r.lang = c.lang AND r.ws = c.ws[cut + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
        ranked AS (
          SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score,
                 row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank
          FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_fill_in_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
                 sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
          FROM documents),
        e AS (
          SELECT *, len(ls) AS n, ('0x' || h[1:8])::BIGINT % (len(ls) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(ls) + 1) AS c2,
                 ('0x' || h[17:24])::BIGINT % 100 AS chosen, ('0x' || h[25:32])::BIGINT % 100 AS way
          FROM d),
        f AS (
          SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR chosen >= 100 THEN 'plain'
                         WHEN way < 50 THEN 'spm' ELSE 'psm' END AS form,
                 array_to_string(ls[1:least(c1, c2)], '') AS pre,
                 array_to_string(ls[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
                 array_to_string(ls[greatest(c1, c2) + 1:], '') AS suf
          FROM e)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM f""",
}
