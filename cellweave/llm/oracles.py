"""DuckDB SQL for those corpus queries that SQL can express: the same rows by plain joins over all pairs, for small tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT w, min(doc_id) AS copy_id FROM d WHERE len(w) > 0 GROUP BY w)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN g ON g.a = doc_id LEFT JOIN k ON k.a = doc_id LEFT JOIN c ON c.w = d.w AND len(d.w) > 0"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM win JOIN low USING (s) CROSS JOIN (SELECT unnest(range(0, 50)) AS k) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

URLS = r"""
WITH u AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
    SELECT page_id, host, path, rh || rp AS rule, v,
           row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS k
    FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""

#: For pages that mark their article with a bare tag and use the references &amp; and &quot; only.
PAGES = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'),
      '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM b"""

#: For items of at least five words; every window that shares a shingle.
LEAKS = f"""
WITH i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
si AS (SELECT item_id, n, o, array_to_string(w[o:o + 4], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, n - 3)) AS o FROM i)),
f AS (SELECT s, ln(1 + (SELECT count(*) FROM i) / count(DISTINCT item_id)) AS weight FROM si GROUP BY s),
t AS (SELECT item_id, sum(weight) AS total FROM (SELECT DISTINCT item_id, s FROM si) JOIN f USING (s) GROUP BY item_id),
d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
sd AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, n - 3)) AS p FROM d WHERE n >= 5)),
met AS (SELECT DISTINCT doc_id, item_id, p, si.n FROM sd JOIN si USING (s)),
laid AS (SELECT DISTINCT doc_id, item_id, unnest(range(greatest(p - n + 5, 1), p + 1)) AS b, n FROM met),
win AS (SELECT laid.*, least(laid.n, d.n - b + 1) AS size FROM laid JOIN d USING (doc_id)),
own AS (SELECT DISTINCT win.doc_id, item_id, b, size, s FROM win JOIN sd ON sd.doc_id = win.doc_id AND p BETWEEN b AND b + size - 5),
sim AS (SELECT doc_id, item_id, b, size, round(least(sum(CASE WHEN x.s IS NOT NULL THEN weight ELSE 0 END)
        / greatest(any_value(total), sum(coalesce(weight, ln(1 + (SELECT count(*) FROM i))))), 1), 9) AS similarity
    FROM own JOIN t USING (item_id) LEFT JOIN f USING (s) LEFT JOIN (SELECT DISTINCT item_id AS xi, s FROM si) x ON x.xi = item_id AND x.s = own.s GROUP BY ALL)
SELECT doc_id, item_id, CAST(b - 1 AS BIGINT) AS start, CAST(size AS BIGINT) AS n_words, CAST(similarity AS DOUBLE) AS similarity FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, b) = 1"""



def _crc32(bytes_: str) -> str:
    """CRC-32 of a list of bytes, bit by bit; 3988292384 is its reversed polynomial."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {bits}), 4294967295)"


def _bytes(hexed: str) -> str:
    return f"list_transform(range(1, length({hexed}) + 1, 2), lambda k: CAST('0x' || substr({hexed}, k, 2) AS BIGINT))"


def _little(value: str) -> str:
    """Four bytes of a number, the lowest first."""
    return " || ".join(f"unhex(substr(printf('%08x', {value}), {k}, 2))" for k in (7, 5, 3, 1))


#: The stored form is a WAVE file: mono, 8000 samples a second, 8 bits.
MEDIA = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, raw || unhex(repeat('00', CAST(greatest(64, ceil(octet_length(raw) / 64) * 64) AS INTEGER) - octet_length(raw))) AS payload FROM d),
h AS (SELECT *, CAST(octet_length(payload) AS BIGINT) AS n, right(hex(payload), 128) AS tail FROM p),
m AS (SELECT *, encode('RIFF') || {_little("n + 36")} || encode('WAVEfmt ') || unhex('1000000001000100401F0000401F000001000800') || encode('data') || {_little("n")} || payload AS media FROM h)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(payload) AS payload_sha256, CAST({_crc32(_bytes("tail"))} AS BIGINT) AS tail_crc32, CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256 FROM m"""

#: The empty string stands for the end of a text, as no word is empty.
BASE = f"""
WITH d AS (SELECT doc_id, {_crc32(_bytes("hex(encode(CAST(doc_id AS VARCHAR)))"))} % 5 = 1 AS held_out,
           list_append({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS t FROM documents),
e AS (SELECT doc_id, held_out, unnest(t) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM e WHERE NOT held_out GROUP BY x),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM e LEFT JOIN c USING (x), n GROUP BY doc_id, held_out, n, v"""

ORACLES = {
    "op2_ngram_jaccard_join": NEAR,
    "op4_substring_dedup": REPEATS,
    "op5_url_filters": URLS,
    "op7_html_extraction": PAGES,
    "op10_benchmark_decontamination": LEAKS,
    "media_payloads": MEDIA,
    "lm_base_scores": BASE,
}
